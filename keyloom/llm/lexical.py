"""Ranked lexical search: items against all documents, scored with integers.

1. Each document is split into terms in its task. What leaves it are *postings* ``(bucket, term, doc, id, tf, n)`` of the
   terms that some item holds, where ``bucket`` is a hash of the term, and sums of documents and terms for the
   corpus statistics. The items' terms reach these tasks as a table of bounded size; a larger set of terms isn't
   sent, and postings of all terms are kept.
2. Postings are written as a table bucketed by term (a folder for each bucket). A frequent term's postings are dealt over
   several files by document. Document frequencies are counted from it.
3. A search reads only the buckets of its items' terms, joins the item terms, scores each match with integers and sums by
   item and document. Postings are dealt by document before the join multiplies them, so these sums need no further
   shuffle; of each split only its best rows for an item go on to the window that numbers them.

Items are broadcast in slices of at most ``SLICE`` term rows; each slice costs one reading of its buckets.

Score: a term's weight ``w`` is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, a document's length norm ``m`` is
``1000 * (1 - b) + (1000 * b * n * N) div L`` in thousandths scaled to ``b``'s hundredths (see ``Scoring``), and a match
adds ``w * (10**9 * tf div (1000 * tf + 12 * m))``; N documents with terms, L their terms, n a document's terms.

Defined results: a null or empty text has no terms; a document without terms doesn't count in N. Every document row is a
document, repeated ids or not, also with a null id (which ranks before others in a tie). Item rows that repeat an id
are one item whose terms add up; items with a null id or without terms give no rows, nor do items that no
document matches. Equal scores go by ascending id. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, integral, shuffle_parts

#: Terms of a text whose A-Z are in lower case, as bytes: digits, a-z and all beyond ASCII.
TERM = rb"[0-9a-z\x80-\xff]+"
BUCKETS = 16
#: Term rows of items in one broadcast, and bytes of distinct terms that may travel to the tasks that read documents.
SLICE = 200_000
VOCABULARY_BYTES = 16 << 20
FLUSH = 100_000

POSTINGS = "term string, doc long, id long, tf long, n long"


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, term, times)``; the same terms as in documents, by the same pattern."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for b in batches:
            for item, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = Counter(find((text or b"").lower()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), b.schema.field(0).type), pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["item", "term", "times"])

    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).filter(F.col("item").isNotNull())
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(split, f"item {kind}, term string, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def _postings(docs: DataFrame, vocabulary: list[bytes] | None) -> DataFrame:
    """Postings of each document, and for each task rows without a term: ``tf`` their terms and ``n`` their documents."""
    wanted = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        keep = None if wanted is None else frozenset(wanted.value)
        rows: list[tuple] = []
        terms = holders = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["term", "doc", "id", "tf", "n"])

        for b in batches:
            for doc, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = find((text.as_py() or b"").lower())
                if not found:
                    continue
                n = len(found)
                terms += n
                holders += 1
                counts = Counter(found)
                rows.extend((t, doc, own, c, n) for t, c in counts.items() if keep is None or t in keep)
                if len(rows) > FLUSH:
                    yield flush()
        rows.append((None, None, None, terms, holders))
        yield flush()

    return docs.mapInArrow(split, POSTINGS)


class Scoring:
    """Constants of the score: saturation ``k1 = 1.2`` and length share ``b = 0.25``, in thousandths and hundredths."""

    SCALE, K1, B = 1_000_000_000, 12, 25


def search(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", vocabulary_bytes: int = VOCABULARY_BYTES, slice_rows: int = SLICE) -> DataFrame:
    """The ``k`` best documents of each item: ``(item id, rank, document id, score)``."""
    integral(docs, id_col)
    spark = docs.sparkSession
    stage, parts = Stage(spark, "lexical"), shuffle_parts(spark)
    asked = stage.put("items", _item_terms(items, item_col, item_text_col))
    distinct = asked.select("term").distinct()
    n_terms, n_bytes = distinct.agg(F.count("*"), F.sum(F.octet_length("term").cast("long") + 64)).first()
    vocabulary = [r.term.encode() for r in distinct.collect()] if (n_bytes or 0) <= vocabulary_bytes else None
    base = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    posted = _postings(base, vocabulary).withColumn("bucket", F.when(F.col("term").isNull(), F.lit(-1)).otherwise(bucket))
    # a bucket's postings are dealt by document: one frequent term fills no task
    dealt = posted.repartition(parts, "bucket", F.pmod(F.xxhash64("doc"), F.lit(max(1, parts // BUCKETS) + 1)))
    stage.write("postings", dealt.sortWithinPartitions("bucket", "term"), by=("bucket",))
    postings = spark.read.schema(posted.schema).parquet(stage.path("postings"))

    total = postings.filter(F.col("bucket") == -1).agg(F.sum("n").alias("N"), F.sum("tf").alias("L")).select(F.coalesce("N", F.lit(0)).alias("N"), F.coalesce("L", F.lit(0)).alias("L")).first()
    terms = asked.withColumn("bucket", bucket)
    slices = max(1, -(-asked.count() // slice_rows))
    counted = postings.filter(F.col("bucket") >= 0)
    if vocabulary is None:
        counted = counted.join(distinct.withColumn("bucket", bucket), ["bucket", "term"], "left_semi")
    df = counted.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * total.N + 2)) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = stage.put("weights", terms.join(df, ["bucket", "term"]).select("item", "bucket", "term", (F.col("times") * weight).alias("weight")))

    out = None
    for s in range(slices):
        some = weighed if slices == 1 else weighed.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == s)
        found = _scored(postings, some, total.N, total.L, k, parts)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _scored(postings: DataFrame, weighed: DataFrame, n_docs: int, n_terms: int, k: int, parts: int) -> DataFrame:
    buckets = [r.bucket for r in weighed.select("bucket").distinct().collect()]
    hits = postings.filter(F.col("bucket").isin(buckets)).select("bucket", "term", "doc", "id", "tf", "n")
    norm = F.expr(f"{100 - Scoring.B} + ({Scoring.B} * n * {n_docs}L) div {max(1, n_terms)}L")
    part = F.expr(f"({Scoring.SCALE}L * tf) div (1000 * tf + {Scoring.K1} * m)")
    dealt = hits.repartition(parts, "doc").withColumn("m", norm).withColumn("part", part).select("term", "doc", "id", "part")
    matches = dealt.join(F.broadcast(weighed.select("item", "term", "weight")), "term")
    sums = matches.groupBy("item", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("score"), F.first("id").alias("id")).filter(F.col("score") > 0)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"), "doc")
    return sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
