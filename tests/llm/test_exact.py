import hashlib
from collections import Counter

from helpers import documents
from pyspark.sql import functions as F

from chartledger.llm import exact


def groups(docs, size=8192):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"],
                   r["text_sha256"]) for r in exact.exact_groups(docs, size).collect())


def by_hand(pairs):
    size = Counter(t or "" for _, t in pairs)
    out = []
    for d, t in pairs:
        ids = [i for i, u in pairs if (u or "") == (t or "") and i is not None]
        keep = max(ids) if ids else None
        out.append((str(d), str(keep), size[t or ""], d == keep,
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


LONG = "".join(chr(97 + i % 23) for i in range(1000))
CASES = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "é"), (7, "é"),
         (8, LONG), (9, LONG), (10, LONG + "x"), (11, LONG[:-1]), (12, "x" + LONG),
         (13, LONG[:512]), (14, LONG[:512]), (15, LONG[512:] + LONG[:512]), (None, "a"),
         (None, "only null"), (None, "only null"), (2, "a"), (2, "other text of 2"),
         (16, "ab" * 64), (17, "ab" * 32)]


def test_equals_brute_force_at_many_block_sizes(spark):
    docs = documents(spark, CASES)
    for size in (7, 64, 8192):
        assert groups(docs, size) == by_hand(CASES)


def test_hashes_that_collide_are_told_apart_by_content(spark, monkeypatch):
    docs = documents(spark, CASES)
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    assert groups(docs, 64) == by_hand(CASES)


def test_a_third_of_all_rows_in_one_group(spark):
    cases = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(600)]
    assert groups(documents(spark, cases)) == by_hand(cases)


def test_empty_table_and_no_python(spark):
    docs = documents(spark, CASES)
    assert exact.exact_groups(docs.limit(0)).count() == 0
    assert "Python" not in exact.exact_groups(docs)._jdf.queryExecution().toString()
