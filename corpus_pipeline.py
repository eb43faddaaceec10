"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the documents that it keeps, the last their tokens."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.llm import bpe, linededup, mixing, similar, toxicity
from verdigraph.llm.common import BATCH, BATCH_DEFAULT, WORD, stored, table

#: Rows that go to a Python worker at a time. Whole texts are many bytes a row, and both sides hold a batch.
ROWS = 500
#: Columns of documents.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def whole_rows(stage):
    """A stage whose operator sees further columns under names that it doesn't use itself, and which come out as they were."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark.conf.get(BATCH)) == BATCH_DEFAULT:  # a session's own number stays
            spark.conf.set(BATCH, ROWS)
        aside = {c: f"further column {i}" for i, c in enumerate(docs.columns) if c not in OWN}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.select([out[aside.get(c, c)].alias(c) for c in docs.columns])

    return run


@whole_rows
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of at least 0.7."""
    field = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.tagged(docs, "text", field).where("_predicted = 0")


@whole_rows
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of at least 10 code points that an earlier document holds; n_chars follows the text."""
    cut = linededup.kept_text(linededup.keep_bitmaps(docs))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut


@whole_rows
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return similar.one_of_each(docs, "doc_id", "text")


@whole_rows
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as its source's target asks for, and drops those that it doesn't."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    mixed = mixing.mix(docs, "doc_id", "source", size, tie=F.col("text"), **mixing.PRODUCTION)
    return mixed.where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    import public_tokenizers

    out = bpe.encoded(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "source"], compared=True)
    return out.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: A trained field, wide fingerprints and merge rounds are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
