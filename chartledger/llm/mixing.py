"""Mixing sources to target weights by Poisson replication."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.llm.common import (
    hex_to_long,
    shuffle_partitions,
    small_side,
    text_or_empty,
    written,
)

# A mean above this is the sum of several Poisson counts of at most this mean.
PIECE_MEAN = 8.0
# Counts of one piece. For a mean of 8 the chance of more is under 2**-80, far below the 2**-52
# steps of the hash, so no hash value reaches it.
PIECE_COUNTS = 50
HASH_DIGITS = 13


def repetition_rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0,
                     epochs: float = 1.0) -> DataFrame:
    """Source, size and mean repetition rate, over all documents.

    The size of a source is its number of characters plus one for each document's end. The rate
    of a source is (its share of the weights) * epochs * (size of all) / (size of the source), so
    the expected output has the size of ``epochs`` passes and the sources meet their weights.
    Weights of sources that do not occur play no part; a null source is one of its own.
    """
    sizes = docs.select(
        F.col("source").cast("string").alias("source"),
        (F.length(text_or_empty()) + 1).cast("long").alias("size"),
    ).groupBy("source").agg(F.sum("size").alias("size"))
    weight = F.lit(float(default))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    weighted = written(sizes.withColumn("weight", weight), "sizes")
    total = weighted.agg(F.sum("weight").alias("weight"), F.sum("size").alias("size")).first()
    return weighted.select(
        "source", "size",
        (F.col("weight") / F.lit(total["weight"]) * F.lit(float(epochs)) * F.lit(total["size"])
         / F.col("size")).alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Add the number of pieces and the cumulative distribution of one piece."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE_MEAN)).cast("int")
    mean = F.col("rate") / F.col("pieces")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(
            p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    counts = F.sequence(F.lit(1), F.lit(PIECE_COUNTS))
    return rates.withColumn("pieces", pieces).withColumn("mean", mean).withColumn(
        "cdf", F.aggregate(counts, start, step)["cdf"]).drop("mean")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts, in steps of 2**-52."""
    digest = F.md5(F.concat_ws("|", *parts))
    return hex_to_long(digest, HASH_DIGITS).cast("double") / F.lit(float(16 ** HASH_DIGITS))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, epochs: float = 1.0,
        seed: str = "mix") -> DataFrame:
    """Repeat or leave out documents so that the sources meet their weights, in a random order.

    Each document's number of copies is the inverse of its source's Poisson distribution at a
    hash of seed and document id: the count of cumulative values not above the hash. It needs no
    state and is the same in every run. A mean above 8 is split into equal pieces with a hash
    each. Copies are dealt over the partitions by a second hash and sorted by it within them:
    partition p holds the p-th range of the hash, so the whole output is in the order of
    ``mix_key``.

    Returns all columns of ``docs`` in the struct ``row``, and replica (from 1), copies, mix_key.

    Null and empty texts have size 1, null ids hash as the text "null". Rows with equal ids get
    equal counts, and their copies keep separate rows. An empty table gives an empty result.
    Columns of any name are carried along. The only join has one row per source on its small
    side, broadcast behind a check of its size; a source with a third of all rows costs nothing
    extra there, and copies are dealt by hash, not by source.
    """
    rates = small_side(written(
        with_distribution(repetition_rates(docs, weights, default, epochs)), "rates")
        .select(F.col("source").alias("_source"), "pieces", "cdf"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("_key"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"))
    drawn = rows.join(rates, F.col("_key").eqNullSafe(F.col("_source")))

    def below(u: Column) -> Column:
        return F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces")), F.lit(0),
        lambda n, piece: n + below(
            hash_unit(F.lit(seed), F.col("_id"), piece.cast("string"))))
    counted = drawn.withColumn("copies", count).filter("copies > 0")
    copies = counted.select(
        "row", "_id", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("replica"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("_id"),
                               F.col("replica").cast("string")))
    keyed = copies.withColumn("mix_key", hex_to_long(digest, HASH_DIGITS))
    parts = shuffle_partitions(docs.sparkSession)
    # The key is uniform on [0, 2**52), so its range gives even partitions without a sampling pass.
    span = (16 ** HASH_DIGITS + parts - 1) // parts
    dealt = keyed.repartitionById(parts, F.floor(F.col("mix_key") / span).cast("int"))
    return dealt.sortWithinPartitions("mix_key", "_id").drop("_id")
