from helpers import contamination_by_hand, documents
from pyspark.sql import types as T

from chartledger.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def items(spark, rows):
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("doc_id", T.LongType())])) if len(rows[0]) == 3 else spark.createDataFrame(
            rows, T.StructType([T.StructField("item_id", T.LongType()),
                                T.StructField("text", T.StringType())]))


def found(docs, bench):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"])
            for r in decontaminate.contamination(docs, bench).collect()}


CASES = [
    (1, "before " + ITEM + " after"), (2, ITEM.upper().replace(" ", " - ")), (3, None), (4, ""),
    (5, "one two three four five six seven eight nine"), (6, "x short item y short item"),
    (7, "word"), (8, "Élan élan solo"), (9, " ".join(["the"] * 40)), (10, ITEM + " " + ITEM),
    (11, "eleven twelve " + ITEM + " one two"), (12, "ten eleven twelve one two"),
]
BENCH = [(1, ITEM), (2, ITEM), (10, "Short, item!"), (3, "solo"), (4, " .,! "), (5, None),
         (6, "the the the the the the the the the the the"), (7, "Élan")]


def test_equals_brute_force_with_all_edges(spark):
    assert found(documents(spark, CASES), items(spark, BENCH)) == contamination_by_hand(
        CASES, BENCH)


def test_both_joins_agree(spark, monkeypatch):
    docs, bench = documents(spark, CASES), items(spark, BENCH)
    want = found(docs, bench)
    monkeypatch.setattr(decontaminate, "small_side", lambda df: df)
    assert found(docs, bench) == want


def test_a_hot_passage_in_a_third_of_all_rows(spark):
    cases = [(i, (f"w{i} " + ITEM if i % 3 == 0 else f"w{i} clean words")) for i in range(900)]
    got = found(documents(spark, cases), items(spark, [(1, ITEM)]))
    assert sum(n > 0 for _, n, _ in got.values()) == 300
    assert got == contamination_by_hand(cases, [(1, ITEM)])


def test_filter_keeps_clean_rows_and_columns(spark):
    docs = documents(spark, [*CASES, (None, ITEM), (None, "clean"), (1, "clean twin id")])
    kept = decontaminate.without_contaminated(docs, items(spark, [(1, ITEM)]))
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "12", "3", "4", "5", "6", "7", "8", "9", "None"])


def test_empty_tables(spark):
    docs, bench = documents(spark, CASES), items(spark, BENCH)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    clean = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(CASES) and not any(r["contaminated"] for r in clean)
    assert decontaminate.without_contaminated(docs, bench.limit(0)).count() == len(CASES)


def test_no_python_in_the_plan(spark):
    plan = decontaminate.contamination(documents(spark, CASES), items(spark, BENCH))
    assert "Python" not in plan._jdf.queryExecution().toString()
