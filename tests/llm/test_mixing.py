import math
from collections import Counter

from helpers import collected, documents

from chartledger.llm import mixing


def poisson_inverse(u, mean):
    """The count whose cumulative probability first exceeds u."""
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def test_counts_are_the_inverse_of_the_distribution(spark):
    import hashlib

    docs = documents(spark, [(i, "x" * 9, "a" if i % 3 else "b") for i in range(120)])
    got = {(r["doc_id"], r["replica"]): r["copies"] for r in mixing.mix(
        docs, {"b": 3.0}).select("row.doc_id", "replica", "copies").collect()}
    sizes = {"a": 80 * 10, "b": 40 * 10}
    want = {}
    for i in range(120):
        s, w = ("a", 1.0) if i % 3 else ("b", 3.0)
        digest = hashlib.md5(f"mix|{i}|1".encode()).hexdigest()
        n = poisson_inverse(int(digest[:13], 16) / 16 ** 13, w / 4.0 * 1200 / sizes[s])
        want.update({(i, r): n for r in range(1, n + 1)})
    assert got == want


def test_large_means_and_a_hot_source_meet_their_weights(spark):
    docs = documents(spark, [(i, "y" * 19, "hot") for i in range(2000)]
                     + [(5000 + i, "z" * 19, "rare") for i in range(20)])
    out = mixing.mix(docs, {"hot": 1.0, "rare": 1.0}).select("row.source", "row.doc_id").collect()
    share = Counter(r["source"] for r in out)
    assert 850 < share["hot"] < 1170 and 850 < share["rare"] < 1170
    assert len({r["doc_id"] for r in out if r["source"] == "rare"}) == 20


def test_nulls_repeated_rows_and_extra_columns_are_carried(spark):
    docs = documents(spark, [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "q" * 50, "s")])
    out = mixing.mix(docs, {}, epochs=30.0)
    assert out.select("row.*").columns == docs.columns
    counts = Counter(r["doc_id"] for r in out.select("row.doc_id").collect())
    assert counts[None] > 0 and counts[1] > 0 and counts[1] % 2 == 0
    assert mixing.mix(docs.limit(0), {}).count() == 0


def test_the_order_is_global_and_the_same_in_every_run(spark):
    docs = documents(spark, [(i, "t", "s") for i in range(300)])
    runs = [[r["mix_key"] for r in mixing.mix(docs, {}).select("mix_key").collect()]
            for _ in range(2)]
    assert runs[0] == runs[1] == sorted(runs[0])
    ids = [r["doc_id"] for r in mixing.mix(docs, {}).select("row.doc_id").collect()]
    assert ids != sorted(ids)
    assert collected(mixing.mix(docs, {}), "mix_key")
