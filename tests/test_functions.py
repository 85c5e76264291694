"""Column functions and ordered helpers against hand-made cases and plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chartledger.functions.conditions import condition, map_lookup
from chartledger.functions.dates import with_dates
from chartledger.functions.ordered import (
    salted_join,
    with_next_marked,
    with_previous,
    with_running_max,
)
from chartledger.functions.text import mask_identifier, normalise_term
from chartledger.functions.values import make_value


def values_of(spark, facts):
    rows = [(p, k, t) for p, (k, t) in facts.items()]
    df = spark.createDataFrame(rows or [("x", "text", None)], "p string, k string, t string")
    pairs = df.filter("t IS NOT NULL").select(
        F.struct("p", make_value(F.col("k"), F.col("t")).alias("v")).alias("e"))
    return pairs.groupBy().agg(F.map_from_entries(F.collect_list("e")).alias("m"))


FACTS = {
    "site": ("text", "chest"), "sev": ("number", "7"), "sevtext": ("text", "7.5"),
    "assoc": ("list", "fever|sweating"), "flag": ("bool", "true"), "word": ("text", "high"),
}


@pytest.mark.parametrize("clause, expected", [
    (("site", "eq", "chest"), True), (("site", "eq", "head"), False),
    (("site", "ne", "head"), True), (("gone", "ne", "head"), False),
    (("assoc", "eq", "fever"), True), (("assoc", "in", ["bleeding", "sweating"]), True),
    (("assoc", "not_in", ["bleeding"]), True), (("assoc", "not_in", ["fever"]), False),
    (("gone", "not_in", ["fever"]), False), (("site", "contains", "HES"), True),
    (("sev", "gte", 7), True), (("sev", "gt", 7), False), (("sevtext", "lt", 8), True),
    (("word", "gt", 1), False), (("flag", "gt", 0), False), (("flag", "eq", True), True),
    (("flag", "eq", 1), False), (("site", "recorded", True), True),
    (("gone", "recorded", False), True), (("gone", "not_recorded", True), True),
    (("site", "not_recorded", True), False),
    (("any", [("gone", "eq", "x"), ("site", "eq", "chest")]), True),
    (("all", [("gone", "eq", "x"), ("site", "eq", "chest")]), False),
])
def test_condition(spark, clause, expected):
    df = values_of(spark, FACTS)
    assert df.select(condition(clause, map_lookup("m"))).first()[0] is expected


@pytest.mark.parametrize("text, day, precision", [
    ("Date: 14/03/2026", "2026-03-14", "exact"), ("seen 2024-1-5 again", "2024-01-05", "exact"),
    ("3 March 2019", "2019-03-03", "exact"), ("since SEPT 2018", "2018-09-01", "month"),
    ("in 1999 only", "1999-01-01", "year"), ("31/02/2020", "2020-01-01", "year"),
    ("45/13/2021 then 2020-05-06", "2020-05-06", "exact"), ("no date", None, "unknown"),
    ("room 12345", None, "unknown"), ("1/2/0000", None, "unknown"),
])
def test_dates(spark, text, day, precision):
    df = spark.createDataFrame([(text,)], "t string")
    got = with_dates(df, "t", "d", "p").first()
    assert (got.d and got.d.isoformat(), got.p) == (day, precision)


def test_text(spark):
    df = spark.createDataFrame([("Crème-brûlée, ÉTÉ  (2)", "1234567890")], "a string, b string")
    row = df.select(normalise_term(F.col("a")), mask_identifier(F.col("b"))).first()
    assert tuple(row) == ("creme brulee ete 2", "**** **** 7890")


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b"]), i, rng.randint(0, 9), f"f{i}",
             rng.random() < 0.2) for i in rng.sample(range(2000), 400)]
    return rows, spark.createDataFrame(rows, "g string, seq long, v int, id string, m boolean")


@pytest.mark.parametrize("chunk", [1, 7, 100, 100000])
def test_ordered_helpers_do_not_depend_on_the_chunk(groups, chunk):
    rows, df = groups
    df = df.repartition(5)
    by_group = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by_group.setdefault(r[0], []).append(r)
    prev, top, nxt, at = {}, {}, {}, {}
    for items in by_group.values():
        best = -1
        for i, r in enumerate(items):
            at[r[3]], prev[r[3]] = i, items[i - 1][3] if i else None
            best = max(best, r[2])
            top[r[3]] = best
            nxt[r[3]] = next((x[3] for x in items[i + 1:] if x[4]), None)
    ch = F.expr(f"seq div {chunk}")
    got = with_previous(df, ["g"], ["seq"], ch, ["id"], "p", position="n").collect()
    assert {r.id: r.p and r.p.id for r in got} == prev
    assert {r.id: r.n for r in got} == at
    got = with_running_max(df, ["g"], ["seq"], ch, F.col("v"), "t").collect()
    assert {r.id: r.t for r in got} == top
    got = with_next_marked(df, ["g"], ["seq"], ch, F.col("m"), "id", "x").collect()
    assert {r.id: r.x for r in got} == nxt


def test_salted_join_equals_join(groups, spark):
    _rows, df = groups
    small = spark.createDataFrame([("hot", "H"), ("a", "A")], "g string, w string")
    plain = sorted(map(tuple, df.join(small, "g").select("id", "w").collect()))
    assert sorted(map(tuple, salted_join(df, small, ["g"], "id").select("id", "w").collect())) == plain
    left = salted_join(df, small, ["g"], "id", "left")
    assert left.count() == df.count()
    assert left.filter("w IS NULL").count() == df.filter("g = 'b'").count()


def test_timestamps_are_utc(spark):
    got = spark.sql("SELECT CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' AS TIMESTAMP) AS t")
    assert got.selectExpr("unix_timestamp(t)").first()[0] == int(
        dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
