"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's vector has two parts. The words, of length `WORD_LENGTH`: counts of its lower-cased
words in a hashed table, (1 + log count) x idf with document frequencies counted over all documents.
The shape, of length 1: counts of how its character classes follow one another (letters of a case
are one class, digits one, every mark its own) and of repeated words, as square roots of relative
counts. A truncated singular value decomposition of a bounded sample of labelled documents gives the
latent space and, with their labels, the reference vectors, which are broadcast. Every document's
cosines with all references are computed exactly, in blocks, and its nearest references vote with
their similarity as weight.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartledger.llm.common import text_or_empty

# Bounds of the model: labelled documents used (of each label, half of it), columns of the word
# table and of the shape table, latent dimensions and neighbours. Broadcast are SAMPLE x LATENT and
# WIDTH x LATENT floats.
SAMPLE = 4096
WORDS = 2048
SHAPES = 2048
WIDTH = WORDS + SHAPES
LATENT = 64
WORD_LENGTH = 0.35
NEIGHBOURS = 31
FOLDS = 5
THRESHOLD = 0.3

_TRIGRAMS = SHAPES - 64
_CLASSES = 48
# Rounds of the subspace iteration, and directions it carries beside the wanted ones.
_ROUNDS, _BESIDE = 4, 16


def class_table() -> np.ndarray:
    """Class of every code point: 0 lower, 1 upper, 2 other letter, 3 digit, 4 space, 5 line end,
    6 other sign, 7 to 38 ASCII marks, 39 text end."""
    table = np.full(0x110000, 6, dtype=np.uint8)
    for code in [*range(0x3400), *range(0xA000, 0xE000), *range(0xF900, 0x20000)]:
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            table[code] = {"Ll": 0, "Lu": 1}.get(kind, 2)
        elif kind[0] == "N":
            table[code] = 3
        elif kind[0] == "Z":
            table[code] = 4
    table[0x3400:0xA000] = 2
    table[0x20000:0x32000] = 2
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for i, code in enumerate(marks):
        table[code] = 7 + i
    table[ord("\t")], table[ord("\n")], table[ord("\r")] = 4, 5, 5
    return table


def _trigram_bins() -> np.ndarray:
    """The feature of each class trigram, spread by a multiplicative hash."""
    code = np.arange(_CLASSES ** 3, dtype=np.uint64)
    mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(_TRIGRAMS)).astype(np.int64)


class Features:
    """Feature vectors of whole texts, a batch at a time. A vector depends on its text alone."""

    def __init__(self):
        self.classes, self.bins = class_table(), _trigram_bins()

    def word_counts(self, texts: list[str]) -> np.ndarray:
        """Counts of hashed words (runs of letters and digits, lower-cased): rows x WORDS."""
        lowered = [t.lower() for t in texts]
        codes = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
        inside = self.classes[codes] <= 3
        out = np.zeros((len(texts), WORDS), dtype=np.float32)
        starts = np.nonzero(inside & ~np.concatenate([[False], inside[:-1]]))[0]
        if len(starts):
            ends = np.nonzero(inside & ~np.concatenate([inside[1:], [False]]))[0] + 1
            begun = np.zeros(len(codes), dtype=np.int64)
            begun[starts] = starts
            place = np.arange(len(codes)) - np.maximum.accumulate(begun)
            mixed = (codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))
                     + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            upto = np.concatenate([[np.uint64(0)], np.cumsum(mixed * inside, dtype=np.uint64)])
            word = (upto[ends] - upto[starts]) * np.uint64(0x94D049BB133111EB)
            at = owner[starts] * WORDS + ((word >> np.uint64(40)) % np.uint64(WORDS)).astype(np.int64)
            out += np.bincount(at, minlength=out.size).reshape(out.shape)
        return out

    def shapes(self, texts: list[str]) -> np.ndarray:
        """Square roots of relative counts of character-class trigrams and repeats, of length 1."""
        codes = np.frombuffer(
            "\0".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
        sizes = np.array([len(t) + 1 for t in texts])
        kind = self.classes[codes].astype(np.int32)
        ends = np.cumsum(sizes) - 1
        kind[ends] = 39
        first = np.concatenate([[39], kind[:-1]])
        second = np.concatenate([kind[1:], [39]])
        second[ends] = 39  # not the beginning of the next text
        bins = self.bins[(first * _CLASSES + kind) * _CLASSES + second]
        row = np.repeat(np.arange(len(texts)), sizes)
        out = np.bincount(row * SHAPES + bins, minlength=len(texts) * SHAPES).astype(
            np.float32).reshape(len(texts), SHAPES)
        for i, text in enumerate(texts):
            words = text.split()
            same = sum(a == b for a, b in zip(words, words[1:], strict=False))
            alike = max(1, len(words))
            # In units of characters, so that they weigh as much as the trigrams do together.
            scale = sizes[i] / alike
            out[i, _TRIGRAMS] = scale * same
            out[i, _TRIGRAMS + 1] = scale * (len(words) - len(set(words))) / 4
        total = np.maximum(out.sum(axis=1, keepdims=True), 1)
        return np.sqrt(out / total)

    def vectors(self, texts: list[str], idf: np.ndarray) -> np.ndarray:
        counts = self.word_counts(texts)
        words = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
        return np.concatenate([WORD_LENGTH * unit(words), self.shapes(texts)], axis=1).astype(np.float32)


@dataclass
class Model:
    """What is broadcast: idf of the words, projection into the latent space, reference vectors,
    labels, weights."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """A bounded sample of the labelled ids outside the held-out fold, and both labels' numbers.

    Of each label at most half of ``sample``: those with the smallest hashes of their ids. A
    document labelled several times has its mean label, rounded up. Null labels are none.
    """
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "quality")
    told = told.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in
              told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [told.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id")
             .limit(sample // 2) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def word_idf(texts: DataFrame) -> np.ndarray:
    """The idf of every word column over all rows; WORDS + 1 sums reach the driver."""
    told = texts.select("text").mapInPandas(_frequency_batches, "word int, docs long").groupBy(
        "word").agg(F.sum("docs").alias("docs")).collect()
    sums = np.zeros(WORDS + 1, dtype=np.float64)
    for r in told:
        sums[r["word"] + 1] = r["docs"]
    return (np.log((1 + sums[0]) / (1 + sums[1:])) + 1).astype(np.float32)


def leading_directions(x: np.ndarray, count: int) -> np.ndarray:
    """The first right singular vectors of x as columns, by subspace iteration from a fixed start."""
    count = min(count, *x.shape)
    basis = np.random.default_rng(7).standard_normal(
        (x.shape[1], min(count + _BESIDE, *x.shape))).astype(np.float32)
    for _ in range(_ROUNDS):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _left, _values, right = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ right.T[:, :count]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit the latent space and the references; None without labelled documents.

    At most ``sample`` documents' feature vectors come to the driver (WIDTH half floats each). Of
    several texts under one id the one with the smallest hash is taken.
    """
    chosen, counts = labelled_sample(labels, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    idf = word_idf(texts)
    # The sample holds at most `sample` ids, so this broadcast has a fixed bound.
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.mapInPandas(
        _feature_batches(docs.sparkSession.sparkContext.broadcast(idf)),
        "doc_id long, label int, vector binary").toPandas().sort_values("doc_id")
    if not len(rows):
        return None
    x = np.empty((len(rows), WIDTH), dtype=np.float32)
    for i, vector in enumerate(rows["vector"]):
        x[i] = np.frombuffer(vector, dtype=np.float16)
    y = rows["label"].to_numpy(dtype=np.float32)
    projection = leading_directions(x, LATENT)
    # References stand for all labelled documents of their label.
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / drawn[1], counts.get(0, 0) / drawn[0])
    return Model(idf, projection, unit(x @ projection), y, weight.astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(model: Model, x: np.ndarray, block: int = 512) -> np.ndarray:
    """Scores: the similarity-weighted share of label 1 among the nearest references.

    Cosines with all references, a block of documents at a time. Of equally near references the
    first ones vote.
    """
    out = np.empty(len(x), dtype=np.float64)
    k = min(NEIGHBOURS, len(model.labels))
    for at in range(0, len(x), block):
        cosine = unit(x[at:at + block] @ model.projection) @ model.vectors.T
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k, None]
        over, even = cosine > last, cosine == last
        keep = over | (even & (np.cumsum(even, axis=1) <= k - over.sum(axis=1, keepdims=True)))
        near = np.nonzero(keep)[1].reshape(-1, k)
        similar = np.take_along_axis(cosine, near, axis=1).astype(np.float64)
        # The eighth power: a neighbour at 0.9 counts less than half of one at 1.
        power = np.maximum(similar, 1e-3) ** 8 * model.weights[near]
        out[at:at + block] = (power * model.labels[near]).sum(axis=1) / power.sum(axis=1)
    return out


def _runs(texts: list[str], chars: int = 1_000_000) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= chars) \
                and upto - at < 512:
            size += len(texts[upto])
            upto += 1
        yield slice(at, upto)
        at = upto


def _frequency_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tool, seen, docs = Features(), np.zeros(WORDS, dtype=np.int64), 0
    for batch in batches:
        texts = batch["text"].tolist()
        for part in _runs(texts):
            seen += (tool.word_counts(texts[part]) > 0).sum(axis=0)
        docs += len(texts)
    yield pd.DataFrame({"word": np.arange(-1, WORDS), "docs": np.concatenate([[docs], seen])})


def _feature_batches(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Features()
        for batch in batches:
            texts = batch["text"].tolist()
            vectors = [v.astype(np.float16).tobytes() for part in _runs(texts)
                       for v in tool.vectors(texts[part], shared.value)]
            yield batch[["doc_id", "label"]].assign(vector=vectors)

    return run


def scores(model: Model | None, tool: Features, texts: list[str]) -> np.ndarray:
    """Scores of texts between 0 and 1; 0.5 each without a model."""
    parts = [np.full(p.stop - p.start, 0.5) if model is None
             else vote(model, tool.vectors(texts[p], model.idf)) for p in _runs(texts)]
    return np.clip(np.concatenate(parts), 0.0, 1.0) if parts else np.zeros(0)


def _score_batches(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tool = shared.value, Features()
        for batch in batches:
            told = scores(model, tool, batch["text"].tolist())
            yield batch.drop(columns=["text"]).assign(score=told)

    return run


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame,
                   sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), held_out, score, predicted.

    Null and empty texts have the vector of no characters and get the vote of its neighbours.
    Null ids are never held out. Without any labelled document every score is 0.5. Repeated rows
    score alike. Only doc_id and text are read; ids serve for the fold, never for the score.
    """
    shared = spark.sparkContext.broadcast(fit(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select(
        "doc_id", F.xxhash64("text").alias("key"),
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInPandas(
        _score_batches(shared), "doc_id long, key long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are.

    Scores are computed row by row beside the row itself; nothing is joined.
    """
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, tool = shared.value, Features()
        for batch in texts:
            yield pd.Series(scores(model, tool, batch.tolist()))

    return docs.filter(score(text_or_empty()) >= THRESHOLD)
