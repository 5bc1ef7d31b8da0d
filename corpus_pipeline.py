"""A training-data pipeline over ``documents``: five stages, each one operator of ``keyloom.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``; rows and texts that a stage
drops or changes are so for all later stages.

1. language ID: rejected documents go, all others stay; ``lang`` becomes the predicted language.
2. line deduplication: lines found in ``MIN_DOCS`` documents go; ``n_chars`` follows the new text.
3. n-gram Jaccard join: of each class of near duplicates the document with the smallest id stays.
4. benchmark decontamination: documents that hold a window of a benchmark item go.
5. packing: the rows are pieces with their place in a sequence.

Rows that share a ``doc_id`` are kept or dropped together in stages 3 and 4; documents with a null id pass
through stage 3 and, if clean as a whole, stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, langid, linededup, lshforest, packing, queries
from keyloom.llm.common import Stage, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_DOCS = 10
CACHE_PIECES = 100_000  # about 25 MB in a Python worker, which keeps it while later stages run there
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with queries.ship(spark):
        model = langid.fit(docs)
        kept = langid.identify(docs.select(*COLUMNS), model).filter(~F.col("lang_rejected"))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with queries.ship(spark):
        kept = linededup.drop_frequent_lines(docs.select(*COLUMNS), min_docs=MIN_DOCS, min_chars=1)
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with queries.ship(spark):
        found = lshforest.near_duplicates(docs, n=5, threshold=0.8)
    later = found.filter(F.col("class_id") != F.col("doc_id")).select("doc_id")
    return without(docs.select(*COLUMNS), later, Stage(spark, "later"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, queries.table(spark, sf_dir, "benchmark"), size=10)
    return without(docs.select(*COLUMNS), found.filter(F.col("n_hit") > 0).select("doc_id"), Stage(spark, "hit"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with queries.ship(spark):
        return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"), cut="drop", end_id=2, capacity=4096, cache_pieces=CACHE_PIECES)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    stage = Stage(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, step) in enumerate(STAGES):
        docs = stage.put(str(k), step(spark, docs, sf_dir))
    return docs
