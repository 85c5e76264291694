"""Which of many short texts stand inside which: counts and the first few, without all pairs.

A text holds another one exactly if one of its runs of that length equals it, so containment is an
equi-join on runs of letters. Only runs of the lengths that occur among the wanted texts are made.
Runs are counted and their first owners picked before they meet the wanted texts, so a run that a
third of all texts share is one row by then.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_lengths(texts: DataFrame, column: str) -> list[int]:
    """The lengths that occur, in order; as many as there are different ones."""
    return sorted(r["n"] for r in texts.select(F.length(column).alias("n")).distinct().collect()
                  if r["n"])


def runs_of(text: Column, length: Column) -> Column:
    """The different runs of that many letters."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.when(F.length(text) >= length, F.array_distinct(
        F.transform(starts, lambda i: F.substring(text, i, length))))


def text_runs(texts: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """Every row of ``texts`` with each different run (`run`) of the given lengths, once."""
    sized = texts.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast(
        "array<int>")))
    return sized.withColumn("run", F.explode(runs_of(F.col(column), F.col("_length")))).drop(
        "_length")


def first_of(rows: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; ranks are trimmed in every task before rows meet."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def owners(texts: DataFrame, column: str, item: str, k: int) -> DataFrame:
    """One row per different text: `column`, `n` (its items) and `first` (the k smallest items)."""
    counts = texts.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    firsts = first_of(texts.select(column, item), [column], [item], k).groupBy(column).agg(
        F.sort_array(F.collect_list(item)).alias("first"))
    return counts.join(firsts, column)


def run_owners(shown: DataFrame, column: str, lengths: list[int], k: int) -> DataFrame:
    """Per run of the given lengths in the texts of `owners`: run, n (items whose text holds it)
    and first (the k smallest of them)."""
    runs = text_runs(shown, column, lengths)
    counts = runs.groupBy("run").agg(F.sum("n").alias("n"))
    return counts.join(_smallest(runs, "run", k), "run")


def _smallest(rows: DataFrame, group: str, k: int) -> DataFrame:
    one = rows.select(group, F.explode("first").alias("_item"))
    return first_of(one, [group], ["_item"], k).groupBy(group).agg(
        F.sort_array(F.collect_list("_item")).alias("first"))


def containing(wanted: DataFrame, shown: DataFrame, wanted_column: str, column: str, k: int
               ) -> DataFrame:
    """For each wanted text, the items whose text holds it (equal ones included): the wanted
    column, n and first. Wanted texts that stand in none are left out."""
    lengths = text_lengths(wanted, wanted_column)
    found = run_owners(shown, column, lengths, k)
    return wanted.join(found, F.col(wanted_column) == F.col("run")).select(
        wanted_column, "n", "first")


def contained(wanted: DataFrame, shown: DataFrame, wanted_column: str, column: str, k: int
              ) -> DataFrame:
    """For each wanted text, the items whose text stands in it, equal ones left out: the wanted
    column, n and first. A text of m letters holds at most m runs of each length."""
    runs = text_runs(wanted.select(wanted_column), wanted_column, text_lengths(shown, column))
    pairs = runs.filter(F.col("run") != F.col(wanted_column)).join(
        shown.select(F.col(column).alias("run"), "n", "first"), "run")
    counts = pairs.groupBy(wanted_column).agg(F.sum("n").alias("n"))
    return counts.join(_smallest(pairs, wanted_column, k), wanted_column)
