"""A corpus pipeline of five stages, each on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again for
the next. All stages but the last return the columns of documents. Every row is judged for itself, by a key that the stage
gives it, whatever its id: rows with null or repeated ids are filtered, deduplicated and masked like all others. No rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewell.llm import bpe_codec, decontaminate, jaccard_join, language_id, secrets, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has less than this mean probability is of no learned language.
LEAST_SCORE = 0.4
#: Lists of row keys up to this length (some 16 MB) are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Entries of the encoder's caches in a worker (some 330 bytes each, four times): the stages before have left their share of an executor's memory.
CACHE = 30_000


def _without(rows: DataFrame, gone: DataFrame, since: int) -> DataFrame:
    """rows without those whose keys are listed (one column row); what has been written for the list since mark() is deleted."""
    gone = shared.settle(gone.distinct(), since)
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "row", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a learned language: null texts, those without a letter and those that fit no language go. If no row has a language, nothing can be learned, and all stay."""
    docs = docs.select(*COLUMNS)
    net = language_id.train(docs, F.lit(True))
    return language_id.of_known_language(docs, net, LEAST_SCORE) if net.languages else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones (Jaccard of five-word shingles 0.8 or more): that with the least id, null ids last. Rows without words are linked with nothing and stay."""
    rows, since = shared.keyed(docs.select(*COLUMNS), "row"), shared.mark()
    groups = jaccard_join.jaccard_components(rows, size=5, num=80, den=100, id_col="row").where("n_shingles > 0").join(rows.select("row", "doc_id"), "row")
    groups = shared.cut(groups.select("row", "doc_id", "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    best = groups.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("size")).where("size > 1")
    best = shared.cut(best.select("component_id", F.col("first.row").alias("stays"), "size"))
    return _without(rows, shared.spread_join(groups, best, ["component_id"], "size").where("row <> stays").select("row"), since)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; null and empty texts stay."""
    rows, since = shared.keyed(docs.select(*COLUMNS), "row"), shared.mark()
    return _without(rows, decontaminate.leaks(rows, shared.read(spark, sf_dir, "benchmark"), id_col="row").select("row"), since)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live-looking secrets masked; widely copied examples, null and empty texts stay as they are."""
    return secrets.mask(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with the digests of ids and decoded text; null and empty texts have no ids."""
    return bpe_codec.digests(docs.select(*COLUMNS), with_ids=True, cache=CACHE)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmarks),
    ("secret_scan", secret_scan),
    ("bpe_encoding", encode),
]

#: Trained networks and tokenizers cannot be expressed in SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each is a table in the shared folder that the session names. What a stage has read or written on the way is deleted after it."""
    docs, last = shared.read(spark, sf_dir, "documents"), None
    folder = f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        since, done = shared.mark(), f"{folder}/{k}-{name}"
        shared.write(stage(spark, docs, sf_dir), done)
        shared.release(spark, since)
        if last:
            shared.delete(spark, last)
        docs, last = spark.read.parquet(done), done
    return docs
