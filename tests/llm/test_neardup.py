import random

import numpy as np
import pandas as pd
import pyarrow as pa
from helpers import documents, near_groups_by_hand

from chartledger.llm import common, neardup
from chartledger.llm import shingles as S
from chartledger.llm.common import in_pieces


def family(r, base, changes):
    words = list(base)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(words)


def cases(seed=1):
    r = random.Random(seed)
    out = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one two three"),
           (7, "w"), (8, "w")]
    for f in range(6):
        base = [f"f{f}w{r.randrange(500)}" for _ in range(r.choice([8, 60, 200]))]
        for k in range(14):
            out.append((len(out) + 1, family(r, base, r.randrange(1 + len(base) // 12))))
    return out


def told(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in neardup.near_groups(docs).collect()}


def test_equals_brute_force(spark):
    rows = cases()
    assert told(documents(spark, rows)) == near_groups_by_hand(rows)


def test_blocks_find_links_that_stars_miss(spark, monkeypatch):
    rows = cases(2)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 60)
    monkeypatch.setattr(neardup, "star_links", lambda members, sets, sizes: members.select(
        neardup.F.col("rid").alias("a"), neardup.F.col("hub").alias("b")).limit(0))
    assert told(documents(spark, rows)) == near_groups_by_hand(rows)


def test_a_hot_group_of_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(900)}" for _ in range(80)]
    rows = [(i, " ".join(base) if i % 2 else family(r, base, 1)) for i in range(1, 301)]
    rows += [(i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(301, 600)]
    got = told(documents(spark, rows))
    assert got == near_groups_by_hand(rows)
    assert sum(c == 1 for _, c in got.values()) == 300


def test_common_counts_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 8)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64))
            for _ in range(12)]
    got = neardup.common_counts(sets[:5], sets[5:])
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert got.tolist() == want


def test_signatures_are_super_minhash():
    """Against the definition, element by element."""
    rng = np.random.default_rng(3)
    ranks = S.RANKS
    for n in (1, 2, 40, 900):
        values = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        want = [2 ** 64 - 1] * ranks
        for v in values:
            place = list(range(ranks))
            for j in range(ranks):
                draw = int(S.mixed(np.array([v], np.uint64) + S._STEPS[j])[0])
                k = j + ((draw & 0xFFFFFFFF) * (ranks - j) >> 32)
                place[j], place[k] = place[k], place[j]
                want[place[j]] = min(want[place[j]], (j << 32) | (draw >> 32))
        assert S.super_minhash([values])[0].tolist() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2 ** 63, 1250).astype(np.uint64)
    got = []
    for _ in range(30):
        pool = S.mixed(pool)
        a, b = np.unique(pool[:1000]), np.unique(pool[250:])
        x, y = S.super_minhash([a, b])
        got.append((x == y).mean())
    assert abs(np.mean(got) - 750 / 1250) < 0.03


def test_nulls_repeats_and_the_filter(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (9, text + " more"), (None, "alone here"),
            (None, "alone here"), (7, None), (7, "x y z")]
    docs = documents(spark, rows)
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"])
                   for r in neardup.near_groups(docs).collect())
    assert found == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("7", "7", True),
                     ("9", "5", False), ("None", "5", False), ("None", "None", True),
                     ("None", "None", True)]
    kept = neardup.near_unique(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert neardup.near_groups(docs.limit(0)).count() == 0
    assert neardup.near_unique(docs.limit(0)).count() == 0


def test_one_row_of_repeated_rows_stays_whatever_its_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [(5, text, "a"), (5, text, "b"), (5, text, "a"), (8, "z", "c")])
    kept = neardup.near_unique(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 8]
    again = neardup.near_unique(docs.repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_linked_sets_share_a_necessary_shingle():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 7, 40, 200):
        for _ in range(30):
            base = rng.choice(10 ** 6, size + 60, replace=False).astype(np.uint64)
            a = np.sort(base[:size])
            gone = int(rng.integers(0, size // 4 + 1))
            b = np.sort(np.concatenate([base[gone:size], base[size:size + int(
                rng.integers(0, size // 8 + 1))]]))
            cells = np.zeros(neardup.CELLS, dtype=np.int64)
            for s in (a, b, base[:50]):
                cells += np.bincount(neardup._cell(s), minlength=neardup.CELLS)
            if neardup.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert len(np.intersect1d(neardup.necessary_prefix(a, cells),
                                          neardup.necessary_prefix(b, cells)))


def test_alike_texts_without_links_meet_in_few_blocks(spark):
    """A family of texts that share half of their words in a row: one bucket, no link."""
    shared = " ".join(f"common{i}" for i in range(60))
    docs = documents(spark, [(i, shared + " " + " ".join(f"own{i}x{k}" for k in range(40)))
                             for i in range(400)])
    base = docs.select(neardup.F.col("doc_id").alias("rid"), "text").mapInArrow(
        neardup._set_batches, "rid long, members binary")
    sets = neardup.written(base, "sets-test")
    members = sets.select(neardup.F.lit(1).cast("long").alias("bucket"), "rid",
                          (neardup.F.octet_length("members") / 8).cast("long").alias("n"),
                          neardup.F.lit(400).cast("long").alias("n_members"))
    labels = spark.createDataFrame([], "rid long, component long")
    # Of 400 x 399 / 2 pairs none is compared: no rare shingle is shared.
    assert neardup.open_members(members, sets, labels).count() == 0
    got = neardup.near_groups(docs)
    assert got.filter("kept").count() == 400


def test_blocks_of_many_short_sets_are_multiplied_by_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 14, 9).astype(np.uint64)) for _ in range(90)]
    group = pd.DataFrame({
        "side": [i % 2 for i in range(90)], "rid": range(90), "component": range(90),
        "members": [s.tobytes() for s in sets]})

    def links(tile):
        monkeypatch.setattr(neardup, "TILE", tile)
        return neardup._block_links(group)

    def groups(found):
        root = list(range(90))
        for a, b in found.itertuples(index=False):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    want = pd.DataFrame([(i, j) for i in range(0, 90, 2) for j in range(1, 90, 2)
                         if neardup.linked(len(np.intersect1d(sets[i], sets[j])),
                                           len(sets[i]), len(sets[j]))])
    assert groups(links(7)) == groups(links(1024)) == groups(want)


def test_pieces_cover_all_rows_and_long_values():
    texts = ["a" * 3, None, "b" * 50, "", "c" * 4, "d" * 4, "e" * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["text", "n"])
    pieces = list(in_pieces(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [t for p in pieces for t in p["text"].to_pylist()] == texts
    assert len(pieces) > 2
    for p in pieces:
        sizes = [len(t or "") for t in p["text"].to_pylist()]
        assert p.num_rows == 1 or sum(sizes[:-1]) <= 10


def test_no_growing_table_goes_through_the_driver(spark, monkeypatch):
    """Spark may take a table for small that is not, as after an explode: whatever it is allowed to
    broadcast, only what is proven small is broadcast."""
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    written = neardup.written
    monkeypatch.setattr(neardup, "written", kept)
    monkeypatch.setattr(common.small_side, "__defaults__", (0, 0))
    rows = cases(2)
    docs = documents(spark, rows + rows[:9])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        groups, unique = neardup.near_groups(docs), neardup.near_unique(docs)
        plans += [(n, d._jdf.queryExecution().executedPlan().toString())
                  for n, d in (("groups", groups), ("unique", unique))]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in groups.collect()}
        assert got == near_groups_by_hand(rows) and unique.count() == sum(
            d == c for d, (_, c) in got.items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {"members", "wanted", "sets", "edges", "open", "found", "groups"} <= {n for n, _ in plans}
    assert [n for n, plan in plans if "Broadcast" in plan] == []
    # No side is repeated for the sake of a hot key.
    assert not [n for n, plan in plans if "_salt" in plan]
