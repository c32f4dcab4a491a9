"""From raw documents to token ids in five stages: quality, near duplicates, repeated passages, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import encode_decode
from ledgerlens.llm.common import materialize, table, text_key
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.near_dedup import near_duplicates
from ledgerlens.llm.quality import fit_quality, rate_quality
from ledgerlens.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or the classifier; null and empty texts fail."""
    docs = docs.select(COLUMNS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return rate_quality(docs, model, keep_text=True).filter("quality.kept").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group that five-word shingles link at 0.8 or more: that with the smallest doc_id.

    Rows are told apart by their place, so of repeated rows one stays, and rows without doc_id stay only where their
    group has no other.  Rows without words are linked with nothing and stay.
    """
    rows = materialize(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    kept = near_duplicates(rows.select(place.alias("doc_id"), "text"), words=5, percent=80).filter("kept").select("doc_id._row")
    return rows.join(kept, "_row", "left_semi").select(COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that a string of 200 bytes covers which also starts elsewhere; n_chars follows the text.

    Every row stays, with an empty text where nothing is left; a null text becomes an empty one.
    """
    docs = docs.select(COLUMNS)
    left = remove_repeats(docs, with_text=True).select("k1", "k2", "kept_text")
    rows = docs.select("doc_id", *text_key(F.col("text")), "lang", "source").join(left, ["k1", "k2"])
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mixture takes it, which may be never; rows are rows, whatever their doc_id."""
    taken = mix_sources(docs.select(COLUMNS), keep=COLUMNS).filter("copies > 0")
    return taken.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("kept.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every taken document, checked by decoding them."""
    return encode_decode(docs, keep=["doc_id", "source"], with_ids=True)


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("repeated passages", suffix_dedup), ("mixture", mixing), ("encoding", encode)]

#: The stages are models, similarities and encodings that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
