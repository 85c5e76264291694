import numpy as np
import pytest
from helpers import table
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartledger.llm import negatives as N

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()),
    T.StructField("tile", T.LongType()), T.StructField("anchor", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, "a") for r in rows], VECTORS)


def by_hand(rows, step, positives=5, negatives=3):
    """All pairs, in plain integers."""
    import math

    seen, clean = set(), []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(
                x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(math.floor(256 * x) for x in v)
        if (i, label, w) not in seen:
            seen.add((i, label, w))
            clean.append((i, label, w))
    out = []
    for i, label, v in clean:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, k == label)
                  for j, k, w in clean if j != i]
        scored.sort()
        for s, j, same in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, step):
    got = N.hard_negatives(vectors(spark, rows), F.col("vec_id") % step == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def random_rows(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.standard_normal(dims).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Sizes at which a hundred rows make many blocks, tiles, pages, parts and merges."""
    for name, value in (("BLOCK", 4), ("TILE", 3), ("PAGE", 2), ("PART", 2), ("MERGED", 2)):
        monkeypatch.setattr(N, name, value)


def test_equals_brute_force_over_many_blocks(spark, small):
    rows = random_rows(150, 5, 1)
    assert mined(spark, rows, 6) == by_hand(rows, 6) != []


def test_nulls_ties_repeats_and_odd_vectors(spark, small):
    rows = random_rows(40, 3, 2)
    rows += [(None, [1.0, 1.0, 1.0], 1), (60, None, 1), (61, [1.0, None, 2.0], 1),
             (62, [float("nan")] * 3, 0), (63, [float("inf"), 0.0, 0.0], 0), (64, [1.0] * 3, None),
             (65, [], 1), (66, [1.0], 2), (67, [0.0] * 3, 0), (68, [-1e-20, 0.0, 0.1], 1)]
    rows += [(100 + i, [0.5, 0.5, 0.5], i % 2) for i in range(20)]  # one very common vector
    rows += [(200 + i, [0.3, 0.3, 0.5], 2) for i in range(9)]
    rows += rows[:5] + [(0, [0.1, 0.2, 0.3], 1)]
    assert mined(spark, rows, 4) == by_hand(rows, 4) != []


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)], 50) == []
    assert mined(spark, [(0, [1.0], 1)], 50) == []


def test_large_numbers_are_exact():
    big = np.array([[2.0 ** 40, 3.0], [-(2.0 ** 41), 7.0]])
    assert N.products(big, big).tolist() == [
        [min(int(x) * int(p) + int(y) * int(q), 2 ** 63 - 1) if int(x) * int(p) > 0 else
         max(int(x) * int(p) + int(y) * int(q), -(2 ** 63) + 2) for p, q in big] for x, y in big]
    middle = np.array([[2.0 ** 20 + 1, 5.0]])
    assert N.products(middle, middle)[0, 0] == (2 ** 20 + 1) ** 2 + 25


def test_packed_matrices_come_back():
    for x in (np.zeros((0, 3)), np.array([[1.0, -5.0]]), np.array([[2.0 ** 60, -1.0]])):
        assert (N.unpack(N.pack(x)) == x).all() and N.unpack(N.pack(x)).shape == x.shape


def test_hilbert_keys_visit_neighbours():
    side = np.arange(8)
    cells = np.array([(x, y, z) for x in side for y in side for z in side])
    order = np.argsort(N.hilbert_keys(cells, 3))
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert len(set(N.hilbert_keys(cells, 3).tolist())) == 512 and (steps == 1).all()


def test_bounds_hold_and_choose_few_blocks_of_clustered_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.rint(rng.standard_normal((50, 6)) * 100)
    a = np.rint(rng.standard_normal((9, 6)) * 100)
    under, over = N.bounds(a, x.min(axis=0, keepdims=True), x.max(axis=0, keepdims=True))
    scores = a @ x.T
    assert (scores >= under).all() and (scores <= over).all()
    # Twelve far clusters of a label: an anchor's positives are all in its own block.
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "TILE", 4)
    centres = np.eye(12) * 4
    rows = [(i, (centres[i % 12] + rng.random(12) * 0.02).tolist(), 1) for i in range(192)]
    clean = N.clean_rows(vectors(spark, rows).select(
        "vec_id", "label", "embedding", (F.col("vec_id") % 50 == 0).alias("anchor")))
    blocks = N.candidate_blocks(clean, 5)
    tiles, pages = N.anchor_tiles(blocks), N.zone_pages(blocks)
    chosen = N.chosen_blocks(tiles, pages, pages.count())
    assert 0 < chosen.count() < 0.5 * blocks.count() * tiles.count()


def test_whole_table_reads_every_anchor(spark):
    """The registered query keeps every anchor that has a negative in reach."""
    from chartledger.llm.queries import QUERIES

    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0
             else r["label"]) for r in table("embeddings") if r["label"] is not None]
    got = QUERIES["op12_zone_map_negatives"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, 50)
