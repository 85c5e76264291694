"""Near-duplicate groups by SuperMinHash: banding, exact verification, union by components.

1. Each text's set of word shingles gets a signature of 128 ranks and 32 band keys of 4 ranks.
   Two sets with similarity 0.75 agree in no band with a chance of 5e-6.
2. Equal sets are one class; from here on a class is one node, however many copies it has.
3. Classes that share a band key are a bucket. Each member is verified against the bucket's first
   class (a star), so the links of a bucket of copies grow with its size and not with its square.
4. Components of the verified links are found by label propagation with pointer jumping.
5. Buckets that still hold several components may hide a link between members other than the
   first. Sets with similarity 0.75 share a shingle among the first quarter of each in any common
   order; the order here is rarest first, by a sketch of counts of fixed size. Only members that
   share such a shingle with another component go on. They are cut into blocks of bounded size, and
   a task counts the common shingles of one pair of blocks as a matrix product; of the links it
   finds between components, only a spanning forest leaves the task. Pairs of blocks of one
   component, or of sizes too far apart, are not compared. Nothing is capped, and no pair of
   documents is ever a row.
6. Components are found once more.

Similarities are exact over full sets of 64-bit shingle hashes.

Tables that grow with the input meet by sorted shuffles alone (`wide_join`): the optimizer takes a
table of exploded or repeated rows for as small as the file it came from, and would send it whole
through the driver. A hot key's partition is split when it is read.
"""

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartledger.functions.ordered import wide_join
from chartledger.llm import shingles as S
from chartledger.llm.common import discard, in_pieces, small_join, text_or_empty, written

# Linked: HUNDREDTHS * intersection >= LEAST * union.
HUNDREDTHS, LEAST = 100, 75
# Shingles of a block of members (one longer set is a block of its own), columns of a matrix
# product and sets on each side of it, and cells of the sketch of shingle counts.
BLOCK_SHINGLES = 65_536
COLUMNS = 4096
TILE = 1024
CELLS = 1 << 18
SLICE = 1 << 12
# Elements whose permutations are drawn at a time; one longer set is drawn alone.
WINDOW = 60_000

SIGNATURES = "doc_id long, key long, n_shingles long, set_id binary, bands array<long>"


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, fingerprint and band keys of every text.

    Sets are held for about WINDOW elements at a time, so a task needs no more memory for a batch
    of long texts than for one of short texts.
    """
    hashes = S.WordHashes()
    for batch in batches:
        count = batch.num_rows
        sizes, prints, bands = [0] * count, [None] * count, [None] * count
        held: dict[int, np.ndarray] = {}

        def settle():
            for i, row in zip(held, S.band_keys(S.super_minhash(list(held.values()))), strict=True):
                bands[i] = row
            held.clear()

        waiting = 0
        for i in range(count):
            found = S.shingle_set(batch["text"][i].as_py(), hashes)
            if not len(found):
                continue
            if held and waiting + len(found) > WINDOW:
                settle()
                waiting = 0
            sizes[i], prints[i], held[i] = len(found), S.fingerprint(found), found
            waiting += len(found)
        if held:
            settle()
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], batch["key"], pa.array(sizes, pa.int64()),
            pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
        ], names=["doc_id", "key", "n_shingles", "set_id", "bands"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = S.WordHashes()
    for batch in in_pieces(batches, "text"):
        sets = [S.shingle_set(t, hashes).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["rid"], pa.array(sets, pa.binary())], names=["rid", "members"])


def linked(common: int, a: int, b: int) -> bool:
    return HUNDREDTHS * common >= LEAST * (a + b - common)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, exact.

    Shingles that only one set holds are left out; the others are the columns of 0/1 matrices,
    multiplied some columns at a time.
    """
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, uses = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    width = int(shared.sum())
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, min(at + COLUMNS, width)])
        dense = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        out += dense[:len(left)] @ dense[len(left):].T
    return out.astype(np.int64)


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between components in one pair of blocks."""
    group = group.drop_duplicates(["side", "rid"])
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    if not len(right):
        right = left
    links = []
    if len(left) and len(right) and group["component"].nunique() > 1:
        a = [np.frombuffer(m, np.uint64) for m in left["members"]]
        b = [np.frombuffer(m, np.uint64) for m in right["members"]]
        size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        comp_a, comp_b = left["component"].to_numpy(), right["component"].to_numpy()
        ids_a, ids_b = left["rid"].to_numpy(), right["rid"].to_numpy()
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        # A block of short sets holds thousands: they are multiplied TILE by TILE.
        for at, to in product(range(0, len(a), TILE), range(0, len(b), TILE)):
            of_a, of_b = slice(at, at + TILE), slice(to, to + TILE)
            common = common_counts(a[of_a], b[of_b])
            union = size_a[of_a, None] + size_b[None, of_b] - common
            hits = (HUNDREDTHS * common >= LEAST * union) & (
                comp_a[of_a, None] != comp_b[None, of_b])
            for i, j in zip(*np.nonzero(hits), strict=True):
                x, y = top(int(comp_a[at + i])), top(int(comp_b[to + j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(ids_a[at + i]), int(ids_b[to + j])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node reaches: rid, component.

    Each round takes the least label among neighbours and then the label of the label, so chains
    halve. Tables of a row per linked class are written after every round.
    """
    both = written(
        links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(
            links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("x").agg(F.min("y").alias("y")).select(
        F.col("x").alias("rid"), F.least("x", "y").alias("component")), "labels")
    while True:
        near = wide_join(both, labels.withColumnRenamed("rid", "y"), ["y"]).groupBy("x").agg(
            F.min("component").alias("near"))
        lower = wide_join(labels, near.withColumnRenamed("x", "rid"), ["rid"]).select(
            "rid", F.col("component").alias("old"),
            F.least("component", "near").alias("component"))
        lower = written(lower, "lower")
        jump = lower.select(
            F.col("rid").alias("component"), F.col("component").alias("further"))
        discard(labels)
        new = written(wide_join(lower, jump, ["component"]).select(
            "rid", F.col("further").alias("component"),
            (F.col("further") != F.col("old")).alias("moved")), "labels")
        labels = new.drop("moved")
        discard(lower)
        if not new.filter("moved").limit(1).count():
            discard(both)
            return labels


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return wide_join(rows, labels, ["rid"], "left").withColumn(
        "component", F.coalesce("component", "rid"))


def bucket_members(classes: DataFrame) -> DataFrame:
    """Members of buckets of two or more: bucket, rid, n, hub, n_members. Buckets of exactly the
    same members are one."""
    rows = classes.select("rid", "n", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("rid", F.lit("bucket"))
    stats = written(rows.groupBy("bucket").agg(
        F.min("rid").alias("hub"), F.count("*").alias("n_members"),
        F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("m1"),
        F.sum(F.shiftrightunsigned(mark, 32)).alias("m2")).filter("n_members > 1"), "buckets")
    alone = stats.groupBy("hub", "n_members", "m1", "m2").agg(F.min("bucket").alias("bucket"))
    return written(wide_join(rows, alone.drop("m1", "m2"), ["bucket"]), "members")


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full shingle sets of the wanted classes: rid, members (sorted 64-bit hashes)."""
    chosen = written(wide_join(classes, wanted, ["rid"], "left_semi").select(
        "rid", F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key")), "wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    texts = small_join(rows, chosen, on).groupBy("rid").agg(F.first("text").alias("text"))
    return written(texts.mapInArrow(_set_batches, "rid long, members binary"), "sets")


def _hub_links(hub: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """The members of one part of a bucket that are linked with its first class."""
    links = []
    if len(hub) and len(members):
        a, s = int(hub["hub"].iloc[0]), np.frombuffer(hub["set_a"].iloc[0], np.uint64)
        for b, other in zip(members["b"], members["set_b"], strict=True):
            t = np.frombuffer(other, np.uint64)
            at = np.minimum(np.searchsorted(s, t), len(s) - 1)
            if linked(int((s[at] == t).sum()), len(s), len(t)):
                links.append((a, int(b)))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def star_links(members: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Verified links between the members and the first class of their buckets: a, b.

    A first class's members are dealt into parts of about BLOCK_SHINGLES shingles; its own set is
    sent once to each part.
    """
    edges = members.filter("rid != hub").select(
        F.col("hub").alias("a"), F.col("rid").alias("b"), "n").distinct()
    hubs = sizes.select(F.col("rid").alias("a"), F.col("n").alias("n_a"))
    fit = written(wide_join(edges, hubs, ["a"]).filter(
        F.least("n", "n_a") * HUNDREDTHS >= F.greatest("n", "n_a") * LEAST).select(
            "a", "b", "n"), "edges")
    parts = fit.groupBy("a").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    dealt = wide_join(fit, parts, ["a"]).withColumn(
        "part", F.pmod(F.xxhash64("b"), "parts"))
    told = wide_join(
        dealt, sets.select(F.col("rid").alias("b"), F.col("members").alias("set_b")), ["b"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("place")
    heads = wide_join(
        parts, sets.select(F.col("rid").alias("a"), F.col("members").alias("set_a")), ["a"])
    return heads.select(F.col("a").alias("hub"), every, "set_a").groupBy("hub", "place").cogroup(
        told.select("a", "part", "b", "set_b").groupBy("a", "part")).applyInPandas(
            _hub_links, "a long, b long")


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CELLS, dtype=np.int64)
    for batch in in_pieces(batches, "members"):
        for members in batch["members"].to_pylist():
            cells += np.bincount(_cell(np.frombuffer(members, np.uint64)), minlength=CELLS)
    if cells.any():
        slices = cells.reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(slices)), pa.int32()), pa.array([x.tobytes() for x in slices])],
            names=["slice", "counts"])


def _cell(members: np.ndarray) -> np.ndarray:
    return (members % np.uint64(CELLS)).astype(np.int64)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
    return pd.DataFrame([{"slice": int(group["slice"].iloc[0]), "counts": total.tobytes()}])


def shingle_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of shingles by hash cell: CELLS numbers, whatever the input."""
    schema = "slice int, counts binary"
    told = sets.select("members").mapInArrow(_sketch_batches, schema).groupBy(
        "slice").applyInPandas(_added, schema).collect()
    cells = np.zeros(CELLS, dtype=np.int64)
    for r in told:
        cells[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return cells


def necessary_prefix(members: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The first shingles in the order of (count in the sketch, hash) that a linked set has one of,
    without those that no other set holds."""
    count = cells[_cell(members)]
    n = len(members)
    first = np.lexsort((members, count))[:n - -(-LEAST * n // HUNDREDTHS) + 1]
    return members[first][count[first] > 1]


def _prefix_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "members"):
            found = [necessary_prefix(np.frombuffer(m, np.uint64), shared.value)
                     for m in batch["members"].to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            tokens = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch[c].take(pa.array(at)) for c in ("rid", "component", "n")]
                + [pa.array(tokens.view(np.int64))], names=["rid", "component", "n", "bucket"])

    return run


def open_members(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, each of which shares a shingle of its
    necessary prefix with a member of another component: bucket, rid, component, n.

    A set that shares none is linked with nothing outside its component, however alike the texts
    of its buckets are; only the others' sets are sent to be compared.
    """
    rows = written(_labelled(members.filter("n_members > 2").select(
        "bucket", "rid", "n"), labels), "labelled")
    ends = [F.min("component").alias("low"), F.max("component").alias("high")]
    several = rows.groupBy("bucket").agg(*ends).filter("low != high").select("bucket")
    rows = wide_join(rows, several, ["bucket"], "left_semi")
    wanted = written(wide_join(
        rows.select("rid", "component", "n").distinct(), sets, ["rid"]), "open-sets")
    shared = wanted.sparkSession.sparkContext.broadcast(shingle_sketch(wanted))
    tokens = written(wanted.mapInArrow(
        _prefix_batches(shared), "rid long, component long, n long, bucket long"), "prefixes")
    discard(wanted)
    meeting = tokens.groupBy("bucket").agg(*ends).filter("low != high").select("bucket")
    able = written(
        wide_join(tokens, meeting, ["bucket"], "left_semi").select("rid").distinct(), "able")
    discard(tokens)
    left = wide_join(rows, able, ["rid"], "left_semi")
    still = left.groupBy("bucket").agg(*ends).filter("low != high").select("bucket")
    return written(wide_join(left, still, ["bucket"], "left_semi"), "open")


def block_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their block of a bucket, and the pairs of blocks (bucket, i, j) that may hold a
    link between components. A block is a run of members in the order of component and size."""
    upto = Window.partitionBy("bucket").orderBy("component", "n", "rid").rowsBetween(
        Window.unboundedPreceding, -1)
    cut = written(rows.withColumn("block", F.floor(F.coalesce(
        F.sum("n").over(upto), F.lit(0)) / BLOCK_SHINGLES).cast("int")), "blocks")
    told = cut.groupBy("bucket", "block").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("n").alias("least"), F.max("n").alias("most"))
    left = told.withColumnsRenamed({c: f"{c}_i" for c in ("block", "low", "high", "least", "most")})
    right = told.withColumnsRenamed({c: f"{c}_j" for c in ("block", "low", "high", "least", "most")})
    apart = (F.col("low_i") != F.col("high_i")) | (F.col("low_j") != F.col("high_j")) | (
        F.col("low_i") != F.col("low_j"))
    near = (F.col("most_i") * HUNDREDTHS >= F.col("least_j") * LEAST) & (
        F.col("most_j") * HUNDREDTHS >= F.col("least_i") * LEAST)
    pairs = wide_join(left, right, ["bucket"]).filter("block_i <= block_j").filter(apart & near)
    return cut, pairs.select("bucket", F.col("block_i").alias("i"), F.col("block_j").alias("j"))


def block_links(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components within the buckets that hold several: a, b."""
    cut, pairs = block_pairs(open_members(members, sets, labels))
    side = F.explode(F.array(
        F.struct(F.col("i").alias("block"), F.lit(0).alias("side")),
        F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))).alias("at")
    sides = pairs.select("bucket", "i", "j", side).select("bucket", "i", "j", "at.*").filter(
        "side = 0 OR i < j")
    full = wide_join(wide_join(cut.drop("n"), sides, ["bucket", "block"]), sets, ["rid"])
    return full.groupBy("bucket", "i", "j").applyInPandas(_block_links, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), n_shingles, component_id, kept.

    Null texts, empty texts and texts of white space have an empty set and are linked with nothing.
    The component id is the smallest doc_id of the group; null ids count as larger than all, and a
    group of null ids alone has a null id and keeps its rows. Rows of equal doc_id and text are the
    same document and share its fate. An empty table gives an empty result. Other columns are not
    read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = written(rows.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(
        _signature_batches, SIGNATURES), "signatures")
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("at")
    classes = written(base.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        at, F.max("n_shingles").alias("n"), F.first("bands").alias("bands")).withColumn(
            "rid", F.monotonically_increasing_id()), "classes")
    members = bucket_members(classes)
    sets = class_sets(docs, classes, members.select("rid").distinct())
    links = written(star_links(members, sets, classes.select("rid", "n")), "star-links")
    labels = components(links)
    more = written(block_links(members, sets, labels), "block-links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    named = written(_labelled(classes.select("rid", "set_id", F.col("at.doc_id").alias("first")),
                              labels), "named")
    for table in (members, sets, links, more, labels):
        discard(table)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    found = written(
        wide_join(named, smallest, ["component"]).select("set_id", "component_id"), "found")
    discard(named)
    # A set may be that of a third of all rows.
    grouped = wide_join(base.filter("set_id IS NOT NULL"), found, ["set_id"]).select(
        "doc_id", "key", "n_shingles", "component_id")
    alone = base.filter("set_id IS NULL").select(
        "doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one row of each group, all columns as they are.

    Rows that share doc_id and text are one document: of several, the one whose hash over all
    columns is smallest stays.
    """
    gone = written(near_groups(docs).filter("NOT kept").select(
        "doc_id", "key").distinct(), "dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64(text_or_empty()).alias("_key"))
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    kept = small_join(rows, gone, on, "left_anti")
    again = written(rows.groupBy("_id", "_key").count().filter("count > 1").select(
        F.col("_id").alias("doc_id"), F.col("_key").alias("key")), "repeated")
    if not again.limit(1).count():
        return kept.select("row.*")
    told = F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))
    first = small_join(kept, again, on, "left_semi").groupBy("_id", "_key").agg(
        F.min_by("row", told).alias("row"))
    return small_join(kept, again, on, "left_anti").select("row.*").unionByName(
        first.select("row.*"))
