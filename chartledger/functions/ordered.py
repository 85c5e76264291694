"""Order-dependent columns that do not put one large group into one task.

A plain window over a key sorts every row of that key in a single task. When one key may hold a
large part of the table that does not scale. The helpers here cut a key into consecutive chunks,
work inside each chunk, reduce each chunk to one row, and carry values from chunk to chunk over
those small summaries. The caller names a chunk expression that never decreases along the order,
for example ``seq div 1000000``, the day of a timestamp or `range_chunk`; the result is the same
for any choice.

Group keys must not be null.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CHUNK, _CARRY, _HERE = "_chunk", "_carry", "_here"

# Cuts of `range_chunk` at most; a row is placed among them by a search of 8 comparisons.
MOST_CUTS = 256


def range_chunk(df: DataFrame, column: str, chunks: int | None = None) -> Column:
    """A chunk expression taken from the data: ranges of a whole-number column that hold about
    equally many rows, as many as there are shuffle partitions (`MOST_CUTS` at most).

    For order columns whose values may lie far apart or close together (times, hashes), where a
    fixed step would give a chunk per row or one for all. Reads the column once, for its quantiles.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / min(n, MOST_CUTS) for i in range(1, min(n, MOST_CUTS))]
    if not shares:
        return F.lit(0)
    found = df.agg(F.percentile_approx(F.col(column).cast("long"), shares, 10_000)).first()[0]
    cuts = sorted(set(found or []))

    def place(low: int, high: int) -> str:
        # The number of cuts at or below the value, known to be within [low, high].
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return (f"CASE WHEN `{column}` < {cuts[middle]} THEN {place(low, middle)} "
                f"ELSE {place(middle + 1, high)} END")

    return F.expr(place(0, len(cuts)))


def _keys(group):
    return [*group, _CHUNK]


def _carry_back(rows: DataFrame, carry: DataFrame, group) -> DataFrame:
    return rows.join(carry.select(*_keys(group), _CARRY), _keys(group), "left")


def with_previous(
    df: DataFrame, group: list[str], order: list[str], chunk: Column, cols: list[str], out: str,
    position: str | None = None,
) -> DataFrame:
    """Add `out`: a STRUCT of `cols` from the row just before, null on a group's first row.

    With ``position``, also add the row's zero-based place in its group.
    """
    rows = df.withColumn(_CHUNK, chunk)
    payload = F.struct(*cols)
    here = W.partitionBy(*_keys(group)).orderBy(*order)
    inside = rows.withColumn(_HERE, F.lag(payload).over(here))
    tails = rows.groupBy(*_keys(group)).agg(
        F.max_by(payload, F.struct(*order)).alias("_tail"), F.count(F.lit(1)).alias("_rows"),
    )
    over_chunks = W.partitionBy(*group).orderBy(_CHUNK)
    carry = tails.withColumn(_CARRY, F.lag("_tail").over(over_chunks))
    extra = []
    if position is not None:
        inside = inside.withColumn(position, F.row_number().over(here) - 1)
        before = over_chunks.rowsBetween(W.unboundedPreceding, -1)
        carry = carry.withColumn("_before", F.sum("_rows").over(before))
        extra = ["_before"]
    joined = inside.join(carry.select(*_keys(group), _CARRY, *extra), _keys(group), "left")
    joined = joined.withColumn(out, F.coalesce(_HERE, _CARRY))
    if position is not None:
        joined = joined.withColumn(
            position, F.col(position) + F.coalesce("_before", F.lit(0))).drop("_before")
    return joined.drop(_CHUNK, _CARRY, _HERE)


def with_running_max(
    df: DataFrame, group: list[str], order: list[str], chunk: Column, value: Column, out: str
) -> DataFrame:
    """Add `out`: the largest value from the group's first row up to this one."""
    rows = df.withColumn(_CHUNK, chunk).withColumn("_value", value)
    upto = W.partitionBy(*_keys(group)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn(_HERE, F.max("_value").over(upto))
    before = W.partitionBy(*group).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*_keys(group))
        .agg(F.max("_value").alias("_top"))
        .withColumn(_CARRY, F.max("_top").over(before))
    )
    return (
        _carry_back(inside, carry, group)
        .withColumn(out, F.greatest(_HERE, _CARRY))
        .drop(_CHUNK, _CARRY, _HERE, "_value")
    )


def with_next_marked(
    df: DataFrame, group: list[str], order: list[str], chunk: Column, mark: Column, value: str,
    out: str,
) -> DataFrame:
    """Add `out`: `value` of the first later row of the group where `mark` holds, else null."""
    rows = df.withColumn(_CHUNK, chunk).withColumn("_marked", F.when(mark, F.col(value)))
    after = W.partitionBy(*_keys(group)).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    inside = rows.withColumn(_HERE, F.first("_marked", ignorenulls=True).over(after))
    later = W.partitionBy(*group).orderBy(_CHUNK).rowsBetween(1, W.unboundedFollowing)
    heads = rows.groupBy(*_keys(group)).agg(
        F.min_by("_marked", F.when(F.col("_marked").isNotNull(), F.struct(*order))).alias("_head")
    )
    carry = heads.withColumn(_CARRY, F.first("_head", ignorenulls=True).over(later))
    return (
        _carry_back(inside, carry, group)
        .withColumn(out, F.coalesce(_HERE, _CARRY))
        .drop(_CHUNK, _CARRY, _HERE, "_marked")
    )


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join where one key of the big side may be hot.

    Rows of the big side are spread over `salts` sub-keys by a hash of `spread`; the small side,
    which must hold few rows per key, is repeated once per sub-key. ``how`` is inner or left.
    Without ``salts``, a hot key is spread over a quarter of the shuffle partitions, 16 at least.
    """
    if salts is None:
        salts = max(16, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.withColumn("_salt", F.col("_salt").cast("long"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def wide_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the input, of which one may hold a hot key.

    Always by sorted shuffles. Rows repeated or exploded behind an aggregation are not in the sizes
    the optimizer knows, so it would send such a side whole through the driver. A partition with a
    hot key is split when it is read (`spark.sql.adaptive.skewJoin`), and no row is repeated.
    """
    return left.join(right.hint("merge"), on, how)


def keyed_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of a table of any size with a narrow one of about one row per key.

    ``keys`` is a hash table in each partition and ``rows`` are read past it: they are not sorted,
    which takes memory with the rows of a task, since small partitions of narrow rows are merged by
    their compressed size. Neither side goes through the driver, whatever sizes the optimizer takes
    them for, and a hot key of ``rows`` is split as in `wide_join`. ``how`` is inner, left or
    left_semi.
    """
    return rows.join(keys.hint("shuffle_hash"), on, how)
