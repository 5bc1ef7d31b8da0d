"""The thin queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, katz, langid, lexical, licences, linededup, lshforest, packing, passages, tokenbin, vamana, variants

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; another folder can be set in TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), cut="drop", end_id=2, capacity=4096, cache_pieces=1_200_000)


def op2_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"), min_words=50, similarity=0.8)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(langid.fold() % 5 == 0, F.lit(False)))
    model = langid.fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.tokens_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), cut="lead", end_id=2)


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), langid.fold() % 7 == 2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"), threshold=0.9)
    names = F.array_join(F.array_sort(F.array_distinct("found.licence")), ",")
    return found.select("doc_id", "n_licences", "licence", "dice", names.alias("licences"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.search(table(spark, sf_dir, "embeddings"), k=10, query_every=100)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(chat.format_conversations(turns, budget=2048, history=256))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = back.select("conv_id", "window", F.size("turns").cast("long").alias("n"), told.alias("told"), F.array_join("targets", "").alias("loss"), "n_chars")
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "told", "loss"))).alias("w"), F.sum("n_chars").alias("formatted_chars"))
    joined = whole.select("conv_id", "n_turns", F.array_join("w.told", "").alias("told"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")
    return joined.select("conv_id", "n_turns", _sha256("told").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), _sha256("loss").alias("loss_sha256"), "formatted_chars")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = variants.word_counts(table(spark, sf_dir, "documents"), min_chars=5, min_count=3, damage=97)
    return variants.spelling_variants(counts, factor=2).select("word", "form", "root", "n", "n_near", "form_n")


def _sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY doc_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT g.doc_id, g.s, g.n, win.item_id FROM grams g JOIN win ON g.win = win.win AND g.n = win.n
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
    SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP11_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS MATERIALIZED (
  SELECT conv_id, role, text, (strlen(text) + 3) // 4 + 4 AS cost,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS pos,
         (SELECT sum(length(e) - length(replace(e, c, ''))) FROM (SELECT role || chr(1) || text AS e) x, (SELECT chr(92) AS c) y) AS slashes,
         length(regexp_replace(role || chr(1) || text, '(\[INST\]|\[/INST\]|</s>)', '\1#', 'g')) + 16 AS broken
  FROM raw
), h AS (
  SELECT conv_id, CASE WHEN role = 'system' AND cost <= 512 THEN cost END AS sys FROM t WHERE pos = 0
), tops AS (SELECT conv_id, max(cost) FILTER (cost <= 640) AS top FROM t GROUP BY conv_id
), b AS (
  SELECT t.*, broken + slashes AS chars, h.sys, 2048 - 256 - coalesce(h.sys, 0) - coalesce(tops.top, 0) AS stride,
         coalesce(sum(cost) OVER e, 0) AS before, coalesce(sum(CASE WHEN cost > 640 THEN 1 ELSE 0 END) OVER e, 0) AS larger, cost > 640 AS large
  FROM t JOIN h ON t.conv_id IS NOT DISTINCT FROM h.conv_id JOIN tops ON t.conv_id IS NOT DISTINCT FROM tops.conv_id
  WINDOW e AS (PARTITION BY t.conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s AS (SELECT *, CASE WHEN large THEN 0 ELSE before // stride END AS span FROM b
), wins AS (SELECT conv_id, min(pos) AS win, min(before) AS begins, any_value(sys) AS sys FROM s GROUP BY conv_id, larger, large, span
), copies AS (
  SELECT w.conv_id, sum(s.chars) AS chars FROM wins w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.win > 0
   AND ((s.pos = 0 AND s.sys IS NOT NULL) OR (s.pos < w.win AND s.before >= w.begins - 256 AND NOT (s.pos = 0 AND s.sys IS NOT NULL)))
  GROUP BY w.conv_id
), told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM s GROUP BY conv_id
)
SELECT told.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(told.chars + coalesce(copies.chars, 0) AS BIGINT) AS formatted_chars
FROM told LEFT JOIN copies ON told.conv_id IS NOT DISTINCT FROM copies.conv_id
"""

OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT doc_id, doc, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, doc, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, doc, term
), g AS (SELECT count(*) AS all_docs, CAST(sum(len(w)) AS BIGINT) AS all_terms FROM d WHERE len(w) > 0
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term
), df AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(all_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term
), scores AS (
  SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms)))) AS score
  FROM q JOIN df USING (term) JOIN p USING (term), g GROUP BY item_id, doc
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, doc) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""


class ship:  # noqa: N801  it is used like a function
    """Python workers find this package where the driver has it, unless they are told another place.

    Arrow batches are kept at 2,000 rows at most, as a row is a whole text; in a ``with`` statement only while it lasts.
    Beyond it Spark's own limit of bytes in a batch holds, and operators take batches in slices.
    """

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, spark.conf.get(self.KEY)
        rows = int(self.before)
        spark.conf.set(self.KEY, str(min(2000, rows) if rows > 0 else 2000))
        spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)

    def __enter__(self) -> None:
        pass

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.before)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with ship(spark):
            return query(spark, sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_packing, op2_shared_passages, op3_language_id, op4_token_binary, op5_katz_scores, op6_line_dedup, op7_decontamination, op8_licence_scan, op9_nearest_neighbours, op10_jaccard_join, op11_chat_format, op12_lexical_search, op13_spelling_variants)}
ORACLES = {"op6_line_dedup": OP6_SQL, "op7_decontamination": OP7_SQL, "op11_chat_format": OP11_SQL, "op12_lexical_search": OP12_SQL}
