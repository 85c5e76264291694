"""Hard negatives by zone maps: candidates in Hilbert order, in Parquet blocks with bounds.

1. Rows are ordered by label and by their place on a Hilbert curve through the dimensions that
   vary most, and cut into blocks of one label, one Parquet row a block: ids, vectors, and the
   least and greatest value of every dimension (the zone map). A block also tells, for the anchors
   in it, the score of the last positive found in the block itself: a floor for all others.
2. Anchors are ordered alike and packed into tiles of one label.
3. Zone maps are packed into pages. For a tile and a page, interval arithmetic bounds the scores of
   every anchor with every block from below and above. Positives need the blocks of the anchor's
   label whose upper bound reaches its floor; negatives need the other labels' blocks whose bounds
   meet one of its windows. Only those blocks are read.
4. A task scores a tile against at most ``PART`` blocks and returns one row with each anchor's best;
   such rows are merged in a tree until one is left.

A tile meets a block as two rows, so tasks hold TILE x BLOCK scores whatever the table's size.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartledger.llm.common import shuffle_partitions, written

# Rows of a block, anchors of a tile, zone maps of a page, blocks scored by one task at a time,
# and results merged at a time.
BLOCK = 512
TILE = 512
PAGE = 1024
PART = 64
MERGED = 32
# The curve runs through this many dimensions, each cut into 2 ** BITS cells: 60 bits in all.
CURVE_DIMS, BITS = 12, 5

# Score of no row; all real scores are higher.
NONE = np.iinfo(np.int64).min + 1


def clean_rows(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id, label, vector of whole numbers floor(256 x), as doubles.

    Left out are rows with a null id, label or vector, or any component that is null or no finite
    number.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"),
                          F.col("label").cast("long").alias("label"), x.alias("x"), "anchor")
    return rows.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(
        finite.isNull() | finite).select(
        "id", "label", F.transform("x", lambda v: _whole(v * 256)).alias("vector"), "anchor")


def _whole(v: Column) -> Column:
    # From 2 ** 52 on every double is a whole number; floor() gives a long.
    return F.when(F.abs(v) < 2.0 ** 52, F.floor(v).cast("double")).otherwise(
        F.greatest(F.least(v, F.lit(1.7e308)), F.lit(-1.7e308)))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points on the Hilbert curve; ``cells`` holds a column of numbers of ``bits`` bits
    for each dimension. Axes are turned into the curve's transposed index bit by bit, which is then
    interleaved."""
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    one = np.uint64(1)
    level = 1 << (bits - 1)
    while level > 1:
        low, q = np.uint64(level - 1), np.uint64(level)
        for d in range(len(x)):
            high = (x[d] & q) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        level >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros(len(cells), dtype=np.uint64)
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[-1] & np.uint64(level)) > 0, turn ^ np.uint64(level - 1), turn)
        level >>= 1
    key = np.zeros(len(cells), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for column in x:
            key = (key << one) | (((column ^ turn) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def matrix(lists, width: int | None = None) -> np.ndarray:
    """Rows of numbers as a matrix; missing components at the end count as 0."""
    width = max((len(v) for v in lists), default=0) if width is None else width
    if all(len(v) == width for v in lists):
        return np.array([np.asarray(v, dtype=np.float64) for v in lists]).reshape(-1, width)
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floats while they are exact, else in integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    most = _norm(a) * _norm(b)
    if most < 2.0 ** 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    exact = [[int(v) for v in row] for row in a.tolist()]
    other = [[int(v) for v in row] for row in b.tolist()]
    low, high = NONE + 1, np.iinfo(np.int64).max
    return np.array([[min(max(sum(p * q for p, q in zip(x, y, strict=True)), low), high)
                      for y in other] for x in exact], dtype=np.int64).reshape(len(a), len(b))


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _norm(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).sum(axis=1).max())) if x.size else 0.0


def pack(x: np.ndarray) -> bytes:
    """A matrix of whole numbers as bytes: 2 each if they fit, else 8, with its shape before."""
    small = not x.size or np.abs(x).max() < 2 ** 15
    head = np.array([x.shape[0], x.shape[1], small], dtype=np.int64).tobytes()
    return head + x.astype(np.int16 if small else np.float64).tobytes()


def unpack(data: bytes) -> np.ndarray:
    rows, width, small = np.frombuffer(data[:24], dtype=np.int64)
    values = np.frombuffer(data, dtype=np.int16 if small else np.float64, offset=24)
    return values.reshape(rows, width).astype(np.float64)


def top_columns(scores: np.ndarray, ids: np.ndarray, use: np.ndarray, k: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores in use and their ids, ties by smaller id. Columns must be
    in the order of ids. Where there are fewer, the score is NONE."""
    n = scores.shape[1]
    k = min(k, n)
    held = np.where(use, scores, NONE)
    if held.size and np.abs(np.where(use, scores, 0)).max() < 2 ** 52 // max(n, 1):
        # Score and column in one number: the highest are found without sorting a row.
        place = np.where(use, scores * n + (n - 1 - np.arange(n)), NONE)
        at = np.argpartition(place, n - k, axis=1)[:, n - k:] if k < n else \
            np.broadcast_to(np.arange(n), place.shape)
        order = np.argsort(-np.take_along_axis(place, at, 1), axis=1, kind="stable")
        at = np.take_along_axis(at, order, 1)
    else:
        at = np.argsort(-held, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(held, at, 1), ids[at]


def better(scores: list[np.ndarray], ids: list[np.ndarray], k: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """The k best of several lists of best scores and ids; filled up to k with NONE."""
    held, cells = np.concatenate(scores, axis=-1), np.concatenate(ids, axis=-1)
    order = np.lexsort((cells, -held), axis=-1)[..., :k]
    held, cells = np.take_along_axis(held, order, -1), np.take_along_axis(cells, order, -1)
    more = [(0, 0)] * (held.ndim - 1) + [(0, k - held.shape[-1])]
    return np.pad(held, more, constant_values=NONE), np.pad(cells, more)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible scores of anchors (rows) with blocks (columns), widened by what
    rounding may cost."""
    width = max(a.shape[1], low.shape[1])
    a, low, high = _wide(a, width), _wide(low, width), _wide(high, width)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    under, over = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1 + 1e-12 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
    return under - slack, over + slack


def windows(scores: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score, in hundredths of the positive's; none for no positive."""
    low, high = np.empty(scores.shape, np.int64), np.empty(scores.shape, np.int64)
    big = np.abs(scores) > 2 ** 55
    s = np.where(big, 0, scores)
    low[...], high[...] = -((-s * share[0]) // 100), (s * share[1]) // 100
    for i, j in zip(*np.nonzero(big), strict=True):
        value = int(scores[i, j])
        if value != NONE:
            low[i, j], high[i, j] = -((-value * share[0]) // 100), value * share[1] // 100
    none = scores == NONE
    low[none], high[none] = 1, 0
    return low, high


def _with_curve(rows: DataFrame) -> DataFrame:
    """Add `curve`: the row's place on a Hilbert curve through the most varied dimensions, whose
    means and deviations (a row a dimension) come to the driver."""
    told = rows.select(F.posexplode("vector").alias("d", "v")).groupBy("d").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).orderBy(
            F.desc("sd"), "d").limit(CURVE_DIMS).collect()
    axes = [(r["d"], r["mean"], r["sd"] or 0.0) for r in told]

    @F.pandas_udf("long")
    def place(vectors: pd.Series) -> pd.Series:
        x = matrix(vectors.tolist())
        cells = np.zeros((len(x), max(1, len(axes))), dtype=np.int64)
        for k, (d, mean, sd) in enumerate(axes):
            if d < x.shape[1] and sd > 0:
                side = (x[:, d] - mean) / (4 * sd) + 0.5
                cells[:, k] = np.clip(side * 2 ** BITS, 0, 2 ** BITS - 1)
        return pd.Series(hilbert_keys(cells))

    return rows.withColumn("curve", place("vector"))


def _packed(size: int, positives: int):
    """Cut sorted rows into packed groups of one label: blocks, with their anchors' floors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = held[_new(held)].reset_index(drop=True)
            out = []
            while len(held) > size or (len(held) and held["label"].iloc[0] != held["label"].iloc[-1]):
                same = int((held["label"] == held["label"].iloc[0]).sum())
                group = held.iloc[:min(size, same)]
                out.append(_one_block(group, number, positives))
                number, held = number + 1, held.iloc[len(group):].reset_index(drop=True)
            if out:
                yield pd.DataFrame(out)
        if held is not None and len(held):
            yield pd.DataFrame([_one_block(held, number, positives)])

    return run


def _new(rows: pd.DataFrame) -> list[bool]:
    """Which of sorted rows differ from the row before in id, label or vector."""
    keys = [(i, k, np.asarray(v).tobytes()) for i, k, v in
            zip(rows["id"], rows["label"], rows["vector"], strict=True)]
    return [at == 0 or key != keys[at - 1] for at, key in enumerate(keys)]


def _one_block(rows: pd.DataFrame, number: int, positives: int) -> dict:
    x, ids = matrix(rows["vector"].tolist()), rows["id"].to_numpy(np.int64)
    anchor = rows["anchor"].to_numpy(bool)
    if positives:
        scores = products(x[anchor], x)
        order = np.argsort(ids, kind="stable")
        found, _ = top_columns(scores[:, order], ids[order],
                               ids[anchor][:, None] != ids[order][None, :], positives)
        floors = better([found], [found], positives)[0][:, -1]
    else:
        floors = rows["floor"].to_numpy(np.int64)
    return {"block": number, "label": int(rows["label"].iloc[0]), "n": len(rows),
            "ids": ids.tobytes(), "vectors": pack(x), "floors": floors.tobytes(),
            "anchors": np.nonzero(anchor)[0].astype(np.int32).tobytes(),
            "curves": rows["curve"].to_numpy(np.int64).tobytes(),
            "low": pack(x.min(axis=0, keepdims=True)), "high": pack(x.max(axis=0, keepdims=True))}


_BLOCKS = ("block long, label long, n int, ids binary, vectors binary, floors binary, "
           "anchors binary, curves binary, low binary, high binary")


def candidate_blocks(rows: DataFrame, positives: int) -> DataFrame:
    """Write the rows in blocks in the order of (label, curve, id); rows that agree in id, label
    and vector lie side by side and count once."""
    parts = shuffle_partitions(rows.sparkSession)
    dealt = _with_curve(rows).repartitionByRange(parts, "label", "curve", "id")
    return written(dealt.sortWithinPartitions(
        "label", "curve", "id", "vector", F.desc("anchor")).mapInPandas(
            _packed(BLOCK, positives), _BLOCKS), "blocks")


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            at = np.frombuffer(r.anchors, np.int32)
            if len(at):
                x = unpack(r.vectors)[at]
                yield pd.DataFrame({
                    "id": np.frombuffer(r.ids, np.int64)[at], "label": r.label,
                    "curve": np.frombuffer(r.curves, np.int64)[at], "vector": list(x),
                    "floor": np.frombuffer(r.floors, np.int64), "anchor": True})


def anchor_tiles(blocks: DataFrame) -> DataFrame:
    """The anchors of all blocks, packed into tiles of one label."""
    rows = blocks.select("label", "ids", "vectors", "curves", "anchors", "floors").mapInPandas(
        _anchor_rows, "id long, label long, curve long, vector array<double>, floor long, "
        "anchor boolean")
    parts = shuffle_partitions(blocks.sparkSession)
    dealt = rows.repartitionByRange(parts, "label", "curve", "id")
    packed = dealt.sortWithinPartitions("label", "curve", "id", "vector").mapInPandas(
        _packed(TILE, 0), _BLOCKS)
    return written(packed.select(F.col("block").alias("tile"), F.col("label").alias("own"),
                                 F.col("ids").alias("anchor_ids"),
                                 F.col("vectors").alias("anchor_vectors"), "floors"), "tiles")


def zone_pages(blocks: DataFrame) -> DataFrame:
    """Zone maps, at most PAGE to a row, numbered from 0: page, zones. One row stands for up to
    PAGE x BLOCK candidates, so the numbering sorts few rows."""
    deal, run = F.shiftright("block", 32), F.floor(F.expr("block & 4294967295") / PAGE)
    pages = written(blocks.select(
        deal.alias("deal"), run.alias("run"),
        F.struct("block", "label", "low", "high").alias("zone")).groupBy("deal", "run").agg(
            F.collect_list("zone").alias("zones")), "zones")
    numbers = pages.select("deal", "run", (F.row_number().over(
        Window.orderBy("deal", "run")) - 1).alias("page"))
    return written(pages.join(numbers, ["deal", "run"]).select("page", "zones"), "zone-pages")


def _choose(share: tuple[int, int] | None):
    """Blocks that some anchor of the tile needs, from a tile and a page of zone maps a row: for
    its positives, or with ``share`` for the windows of its negatives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tiles, chosen = [], []
            for r in batch.itertuples():
                zones = [z for z in r.zones if (z["label"] == r.own) == (share is None)]
                if not zones:
                    continue
                a = unpack(r.anchor_vectors)
                under, over = bounds(a, matrix([unpack(z["low"])[0] for z in zones]),
                                     matrix([unpack(z["high"])[0] for z in zones]))
                if share is None:
                    need = ~(over < np.frombuffer(r.floors, np.int64)[:, None])
                else:
                    need = np.zeros(over.shape, dtype=bool)
                    for low, high in zip(*(w.T for w in windows(
                            np.frombuffer(r.scores, np.int64).reshape(len(a), -1), share)),
                            strict=True):
                        some = (low <= high)[:, None]
                        need |= some & ~(over < low[:, None]) & ~(under > high[:, None])
                blocks = [z["block"] for z, n in zip(zones, need.any(axis=0), strict=True) if n]
                tiles += [r.tile] * len(blocks)
                chosen += blocks
            yield pd.DataFrame({"tile": tiles, "block": chosen}).astype("int64")

    return run


def chosen_blocks(tiles: DataFrame, pages: DataFrame, n_pages: int,
                  share: tuple[int, int] | None = None) -> DataFrame:
    """Which blocks each tile has to read: tile, block. A tile and a page meet as one row."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))
    return written(tiles.withColumn("page", every).join(pages, "page").mapInPandas(
        _choose(share), "tile long, block long"), "chosen")


def _score(k: int, share: tuple[int, int] | None):
    """The best of at most about PART blocks for each anchor of a tile."""

    def run(blocks: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(tile):
            return pd.DataFrame({"tile": [], "part": [], "scores": [], "ids": []})
        own = tile.iloc[0]
        a, anchors = unpack(own["anchor_vectors"]), np.frombuffer(own["anchor_ids"], np.int64)
        if share is not None:
            low, high = windows(np.frombuffer(own["scores"], np.int64).reshape(len(a), -1), share)
        held = None
        for r in blocks.sort_values("block").itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            order = np.argsort(ids, kind="stable")
            ids, scores = ids[order], products(a, unpack(r.vectors)[order])
            other = anchors[:, None] != ids[None, :]
            if share is None:
                found = top_columns(scores, ids, other, k)
            else:
                each = [top_columns(scores, ids, other & (scores >= low[:, j:j + 1])
                                    & (scores <= high[:, j:j + 1]), k)
                        for j in range(low.shape[1])]
                found = tuple(np.stack(x, axis=1) for x in zip(*each, strict=True))
            held = better(*([x] for x in found), k) if held is None else better(
                *zip(held, found, strict=True), k)
        return pd.DataFrame([{"tile": int(own["tile"]), "part": int(own["deal"]),
                              "scores": held[0].tobytes(), "ids": held[1].tobytes()}])

    return run


def _merge(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        lists = [[np.frombuffer(x, np.int64).reshape(-1, k) for x in group[c]]
                 for c in ("scores", "ids")]
        held = better(*lists, k)
        return pd.DataFrame([{"tile": int(group["tile"].iloc[0]),
                              "part": int(group["part"].iloc[0]),
                              "scores": held[0].tobytes(), "ids": held[1].tobytes()}])

    return run


def search(tiles: DataFrame, chosen: DataFrame, blocks: DataFrame, n_blocks: int, k: int,
           share: tuple[int, int] | None = None) -> DataFrame:
    """Each anchor's k best rows in the chosen blocks: one row a tile with scores and ids."""
    parts = -(-n_blocks // PART)
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    dealt = chosen.withColumn("part", part)
    wanted = tiles.join(dealt.select("tile", F.col("part").alias("deal")).distinct(), "tile")
    read = dealt.join(blocks.select("block", "ids", "vectors"), "block")
    schema = "tile long, part int, scores binary, ids binary"
    found = written(read.groupBy("tile", "part").cogroup(wanted.groupBy("tile", "deal"))
                    .applyInPandas(_score(k, share), schema), "found")
    while parts > 1:
        parts = -(-parts // MERGED)
        found = written(found.withColumn("part", F.pmod("part", F.lit(parts))).groupBy(
            "tile", "part").applyInPandas(_merge(k), schema), "merged")
    return found.select("tile", "scores", "ids")


def _result_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            anchors = np.frombuffer(r.anchor_ids, np.int64)
            shape = (len(anchors), -1)
            positive = np.frombuffer(r.scores, np.int64).reshape(shape)
            positive_id = np.frombuffer(r.positive_ids, np.int64).reshape(shape)
            negative = np.frombuffer(r.found_scores, np.int64).reshape(*positive.shape, -1)
            negative_id = np.frombuffer(r.found_ids, np.int64).reshape(negative.shape)
            i, j, k = np.nonzero((negative > NONE) & (positive > NONE)[:, :, None])
            yield pd.DataFrame({
                "anchor_id": anchors[i], "positive_id": positive_id[i, j],
                "rank": (k + 1).astype(np.int32), "negative_id": negative_id[i, j, k],
                "positive_score": positive[i, j], "negative_score": negative[i, j, k]})


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
                   share: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels in a score window.

    ``vectors`` holds vec_id, embedding (array of numbers) and label; ``anchor`` says which rows
    are anchors. A component counts as floor(256 x), a score is the exact inner product. Positives
    are the ``positives`` best other rows of the anchor's label. A negative's score lies between
    ``share`` hundredths of the positive's; the first ``negatives`` are returned. Returned per row:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector or a null or non-finite component take no part. Ties go to
    the smaller id. Rows that agree in id, label and vector count once; rows of one id that differ
    are rows of their own, but never positives or negatives of an anchor of that id. In vectors of
    unequal lengths missing components are 0. Scores beyond a long are held at its ends. An empty
    table, or one without anchors, gives an empty result. Other columns are not read.
    """
    rows = clean_rows(vectors.select(
        "vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor")))
    blocks = candidate_blocks(written(rows, "vectors"), positives)
    tiles, pages = anchor_tiles(blocks), zone_pages(blocks)
    n_blocks, n_pages = max(1, blocks.count()), max(1, pages.count())
    near = search(tiles, chosen_blocks(tiles, pages, n_pages), blocks, n_blocks, positives)
    told = written(tiles.drop("floors").join(
        near.withColumnRenamed("ids", "positive_ids"), "tile"), "positives")
    chosen = chosen_blocks(told, pages, n_pages, share)
    found = search(told, chosen, blocks, n_blocks, negatives, share).select(
        "tile", F.col("scores").alias("found_scores"), F.col("ids").alias("found_ids"))
    return told.join(found, "tile").mapInPandas(
        _result_rows, "anchor_id long, positive_id long, rank int, negative_id long, "
        "positive_score long, negative_score long")
