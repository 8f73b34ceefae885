"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's rows to the shared folder and reads them again,
so a lost executor never costs more than the stage at hand.

Defined results: see the operators; null texts are empty texts, and an empty
table passes through.  The near-copy stage goes by rows, not by ids: of each group
of near copies one row stays, so rows that share an id but not their text all
stay, and so do rows without an id that are unlike all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.bpe import bpe_encode
from tensorloom.llm.common import discard, documents, materialize, scratch
from tensorloom.llm.line_dedup import line_dedup
from tensorloom.llm.mixing import mix
from tensorloom.llm.ngram_join import jaccard_components
from tensorloom.llm.queries import tokenizer_path
from tensorloom.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW_STRIDE = 41_473_391


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs.select(*COLUMNS), labels).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` plus _row, a unique number per row; written once, so that all who read it see the same."""
    # Partitions start far apart modulo the bits of the join's filter, so that their rows seldom share a bit.
    key = F.monotonically_increasing_id() + F.spark_partition_id().cast("long") * ROW_STRIDE
    return materialize(docs.select(*COLUMNS).withColumn("_row", key), "rows")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, or any if none has an id.

    Groups are found by row: a text without n-grams is its own group, whatever its id.
    """
    rows = with_row_key(docs)
    found = jaccard_components(rows, id_col="_row", n=5, percent=80)
    ids = rows.select("_row", F.col("doc_id").isNull().alias("_none"), "doc_id")
    first = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("_none", "doc_id", "_row")).alias("_first"))
    return rows.join(first.select(F.col("_first._row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to half a pass more; every document is seen at least once."""
    return mix(docs.select(*COLUMNS), budget=None, max_repeats=1.5).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed as little-endian unsigned 32-bit integers."""
    return bpe_encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path()).select("doc_id", "source", "lang", "n_tokens", "ids_packed")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage fits a model: SQL cannot express it, so brute force tests it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the tables of a stage go when its rows are written, and its input when the next stage's are."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch() as kept:
            rows = materialize(stage(spark, docs, sf_dir), name)
            kept.append(rows)
        discard(docs)
        docs = rows
    return docs
