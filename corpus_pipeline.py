"""The corpus pipeline: documents to token files, one operator a stage."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartledger.llm import decontaminate, mixing, neardup, quality, tokens
from chartledger.llm.common import read_table, written
from chartledger.llm.queries import MIX_WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(spark, docs, read_table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.near_unique(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a random order."""
    return mixing.mix(docs, MIX_WEIGHTS).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixed table's files and rows: doc_id, start, n_tokens,
    ids_crc32 of every copy."""
    import public_tokenizers

    name = F.col("_metadata.file_name")
    placed = docs.select(
        "doc_id", "text",
        F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("file"),
        name.alias("name"), F.col("_metadata.row_index").alias("row"))
    return tokens.token_files(
        placed, public_tokenizers.path("word_bpe_49k.json"), order=("file", "name", "row"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", clean),
    ("mixing", mix),
    ("tokens", encode),
]

# The classifier's neighbours and the token files cannot be expressed in SQL; the whole pipeline
# is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
