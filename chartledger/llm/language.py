"""Language of whole texts: nearest of several clustered centroids of TF-IDF n-gram vectors.

1. A text is its lower-cased letters; every run of other characters is one word boundary. Its
   n-grams of 1 to 3 characters are counted in a hashed table of ``WIDTH`` columns.
2. Document frequencies are counted over all documents that may be learnt from, a partial sum in
   every task. A vector is (1 + log count) x idf, of length 1.
3. Of each language a bounded sample of different texts is clustered by spherical k-means, in one
   task a language. Each centroid keeps the cosine below which a text is too far from it.
4. The centroids are broadcast; a text gets the language of the nearest one by cosine.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartledger.llm.common import text_or_empty, written

# Bounds of the model: different texts clustered of each language, clusters of each, columns of
# the n-gram table, and languages told apart. Broadcast are LANGUAGES x CLUSTERS x WIDTH floats at
# most; one task holds SAMPLE x WIDTH floats.
SAMPLE = 600
CLUSTERS = 6
WIDTH = 4096
LANGUAGES = 1000
FOLDS = 5
NONE = "und"

# Texts are read in pieces of so many characters, so one very long text needs bounded memory.
PIECE = 1_000_000
ROWS = 256
# A text is too far from a centroid below the mean cosine of its members less so many deviations.
DEVIATIONS = 6.0
# What a cosine of 32-bit floats may differ by with the number of rows multiplied at once: members
# that are all alike have no deviation, and none of them is too far.
ROUNDING = 1e-5
# Sharpness of the score: a lead of 0.1 in cosine over the next language gives odds of e to 1.
SHARPNESS = 10.0


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether a code point is part of a word: letters (1) and the marks on them (2)."""
    import unicodedata

    table = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LM":
            table[code] = 1 if kind == "L" else 2
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of text pieces of bounded size, each piece with the number of its text. A long text
    is cut after a character that is part of no word, or after PIECE characters without any."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            upto = len(text) if len(text) - at <= PIECE else at + PIECE
            if upto < len(text):
                blank = max(text.rfind(" ", at, upto), text.rfind("\n", at, upto))
                upto = blank + 1 if blank >= at else upto
            if size and (size + upto - at > PIECE or len(rows) >= ROWS):
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(text[at:upto])
            size += upto - at + 1
            at = upto
            if at >= len(text):
                break
    if rows:
        yield rows, parts


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed n-grams of each text (rows x WIDTH), and each text's letters."""
    table = letter_table()
    counts = np.zeros((len(texts), WIDTH), dtype=np.float32)
    letters = np.zeros(len(texts), dtype=np.int64)
    for rows, parts in _pieces(texts):
        lowered = [p.lower() for p in parts]
        codes = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat(np.array(rows), [len(p) + 1 for p in lowered])
        kind = table[codes]
        letters += np.bincount(owner[kind == 1], minlength=len(texts))
        word = kind > 0
        keep = word.copy()
        keep[1:] |= word[:-1]  # the first of other characters ends a word
        c = np.where(word, codes, 0)[keep].astype(np.uint64)
        owner = owner[keep]
        if not len(c):
            continue
        before = np.concatenate([[np.uint64(0)], c[:-1]])
        second = np.where(before == 0, np.uint64(0), np.concatenate([[np.uint64(0)], before[:-1]]))
        two = (before << np.uint64(21)) | c | np.uint64(1 << 62)
        three = (second << np.uint64(42)) | (before << np.uint64(21)) | c
        spread = np.uint64(52)  # the highest 12 bits: WIDTH is 2 to the 12
        real = c > 0
        for gram, use in ((c[real], real), (two, slice(None)), (three[before > 0], before > 0)):
            at = owner[use] * WIDTH + (_mix(gram) >> spread).astype(np.int64)
            counts += np.bincount(at, minlength=counts.size).reshape(counts.shape)
    return counts, letters


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1; a text without n-grams has the zero vector."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """What is broadcast: idf, centroids, their languages (numbers) and limits, language names."""

    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    limits: np.ndarray
    names: list[str]


def held_out(doc_id: Column) -> Column:
    """Rows that are not learnt from. A null id is in no fold."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def _runs(count: int) -> Iterator[slice]:
    for at in range(0, count, ROWS):
        yield slice(at, min(at + ROWS, count))


def _frequency_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, docs = np.zeros(WIDTH, dtype=np.int64), 0
    for batch in batches:
        texts = batch["text"].tolist()
        for run in _runs(len(texts)):
            seen += (gram_counts(texts[run])[0] > 0).sum(axis=0)
        docs += len(texts)
    yield pd.DataFrame({"gram": np.arange(-1, WIDTH), "docs": np.concatenate([[docs], seen])})


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """The idf of every column over all rows of ``texts``; WIDTH + 1 sums reach the driver."""
    told = texts.select("text").mapInPandas(_frequency_batches, "gram int, docs long").groupBy(
        "gram").agg(F.sum("docs").alias("docs")).collect()
    sums = np.zeros(WIDTH + 1, dtype=np.float64)
    for r in told:
        sums[r["gram"] + 1] = r["docs"]
    return (np.log((1 + sums[0]) / (1 + sums[1:])) + 1).astype(np.float32)


def _sampled_texts(rows: DataFrame, sample: int) -> DataFrame:
    """Of each language the ``sample`` texts with the smallest hashes, copies once: lang, text.

    Ranks are trimmed in every task before they meet, so a language with most rows is no hot group.
    """
    keyed = rows.withColumn("key", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = written(keyed.select("lang", "key").distinct().withColumn("rank", rank).filter(
        F.col("rank") <= sample).drop("rank"), "language-sample")
    if chosen.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    # At most LANGUAGES x sample rows of a name and a number.
    return keyed.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(
        F.min("text").alias("text"))


def cluster(x: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and the members' cosines with their own one.

    The first centre is the row nearest the mean, each further one the row farthest from those
    before; no chance is involved. Centres without members fall away.
    """
    mean = x.mean(axis=0)
    picked = [int(np.argmax(x @ mean))]
    best = x @ x[picked[0]]
    while len(picked) < min(clusters, len(x)):
        far = int(np.argmin(best))
        if best[far] > 1 - 1e-6:
            break
        picked.append(far)
        best = np.maximum(best, x @ x[far])
    centres = x[picked]
    for _ in range(12):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == k].sum(axis=0) for k in np.unique(own)])
        moved = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        if moved.shape == centres.shape and np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres, own_cosines(x, centres)


def own_cosines(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each row's nearest centre and its cosine with it."""
    cosine = x @ centres.T
    own = np.argmax(cosine, axis=1)
    return np.stack([own, cosine[np.arange(len(x)), own]], axis=1)


def _cluster_language(clusters: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        x = np.stack([np.frombuffer(v, dtype=np.float32) for v in group["vector"]])
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "low": []})
        centres, near = cluster(x, clusters)
        out = []
        for k, centre in enumerate(centres):
            mine = near[near[:, 0] == k, 1]
            low = float(mine.mean() - DEVIATIONS * mine.std()) - ROUNDING if len(mine) else 1.0
            out.append((group["lang"].iloc[0], centre.astype(np.float32).tobytes(), low))
        return pd.DataFrame(out, columns=["lang", "centroid", "low"])

    return run


def _vector_batches(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _runs(len(texts)):
                x = weighted(gram_counts(texts[part])[0], shared.value)
                yield batch[["lang", "key"]].iloc[part].assign(vector=[v.tobytes() for v in x])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model | None:
    """Learn from text and lang of the rows outside the held-out fold; None without any.

    Rows with a null lang or without text teach nothing.
    """
    spark = docs.sparkSession
    rows = docs.filter(~held_out(F.col("doc_id"))).select(
        F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")).filter(
            "lang IS NOT NULL AND text <> ''")
    idf = document_frequencies(rows)
    vectors = _sampled_texts(rows, sample).mapInPandas(
        _vector_batches(spark.sparkContext.broadcast(idf)), "lang string, key long, vector binary")
    found = vectors.groupBy("lang").applyInPandas(
        _cluster_language(clusters), "lang string, centroid binary, low double").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    names = sorted({r["lang"] for r in found})
    return Model(idf, np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]),
                 np.array([names.index(r["lang"]) for r in found]),
                 np.array([r["low"] for r in found]), names)


def nearest(model: Model, texts: list[str]) -> pd.DataFrame:
    """Language, score, cosine and rejection of each text of a short list."""
    counts, letters = gram_counts(texts)
    cosine = weighted(counts, model.idf) @ model.centroids.T
    own = np.argmax(cosine, axis=1)
    top = cosine[np.arange(len(texts)), own].astype(np.float64)
    by_name = np.full((len(texts), len(model.names)), -1.0)
    for k, name in enumerate(model.language):
        by_name[:, name] = np.maximum(by_name[:, name], cosine[:, k])
    odds = np.exp(SHARPNESS * (by_name - by_name.max(axis=1, keepdims=True)))
    none = letters == 0
    names = np.array(model.names, dtype=object)[model.language[own]]
    names[none] = NONE
    score = np.where(none, 0.0, 1.0 / odds.sum(axis=1))
    return pd.DataFrame({
        "lang_pred": names, "score": np.clip(score, 0.0, 1.0),
        "similarity": np.where(none, 0.0, np.clip(top, 0.0, 1.0)),
        "rejected": none | (top < model.limits[own])})


def _predict_batches(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _runs(len(texts)):
                told = batch[["doc_id", "held_out"]].iloc[part].reset_index(drop=True)
                if model is None:
                    yield told.assign(lang_pred=NONE, score=0.0, similarity=0.0, rejected=True)
                else:
                    yield pd.concat([told, nearest(model, texts[part])], axis=1)

    return run


def languages(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE,
              clusters: int = CLUSTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, similarity, rejected.

    ``rejected`` marks texts farther from their nearest centroid than its members ever are; their
    language is still named. Null texts, empty texts and texts without a letter are ``und``,
    rejected, with score 0; so is every text if there is nothing to learn from. Repeated rows are
    predicted alike; of equally near languages the first by name is taken. A null id is never held
    out. An empty table gives an empty result. Only doc_id, text and lang are read, and lang only
    to learn.
    """
    shared = spark.sparkContext.broadcast(fit(docs, sample, clusters))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInPandas(_predict_batches(shared),
                            "doc_id long, held_out boolean, lang_pred string, score double, "
                            "similarity double, rejected boolean")
