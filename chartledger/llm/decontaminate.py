"""Benchmark decontamination by a prefix-filtered set join."""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.llm.common import small_side, text_or_empty, written

WINDOW = 10
SHINGLE = 2

# What separates words (all of ASCII but digits and letters), and the letters that
# are folded.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(column: str = "text") -> Column:
    return F.array_remove(F.split(folded(text_or_empty(column)), SEPARATORS), "")


def shingle_at(words: str, pos: str, size: int) -> Column:
    parts = [F.try_element_at(words, F.col(pos) + 1 + i) for i in range(size)]
    return F.concat_ws(" ", *parts)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """All windows of each item: item_id, words. An item of fewer words is one window."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("w"))
    some = cut.filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.size("w") - window)
    starts = some.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("s"))
    return starts.select(
        "item_id", F.slice("w", F.col("s") + 1, F.lit(window)).alias("words")).distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Every shingle of every window with its place; a window of fewer words is one shingle."""
    last = F.greatest(F.lit(0), F.size("words") - shingle)
    at = windows.select("words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return at.select("words", "at", F.concat_ws(
        " ", F.slice("words", F.col("at") + 1, F.lit(shingle))).alias("shingle"),
        F.least(F.size("words"), F.lit(shingle)).alias("size"))


def document_shingles(docs: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """The shingles of the given sizes at each word of each document."""
    at = docs.select(*keep, "words", F.posexplode("words").alias("pos", "_word"))
    if sizes == [1]:
        return at.withColumnRenamed("_word", "shingle")
    if len(sizes) == 1:
        return at.drop("_word").withColumn("shingle", shingle_at("words", "pos", sizes[0]))
    each = F.explode(F.array(*[shingle_at("words", "pos", n) for n in sizes]))
    return at.select(*keep, "words", "pos", each.alias("shingle"))


def rarest_first(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """One necessary prefix per window: its rarest shingle over all documents, with its place.

    A contained window has all its shingles in the document, so the prefix that the set join needs
    has length 1: the shingle that is first in the order of rarity.
    """
    wanted = small_side(written(shingles.select("shingle").distinct(), "vocabulary"))
    counts = document_shingles(docs, sizes, []).select("shingle").join(
        wanted, "shingle").groupBy("shingle").agg(F.count("*").alias("uses"))
    ranked = shingles.join(counts, "shingle", "left").withColumn(
        "uses", F.coalesce("uses", F.lit(0)))
    first = F.min(F.struct("uses", "shingle", "at")).alias("first")
    return ranked.groupBy("words").agg(first).filter("first.uses > 0").select(
        "words", F.col("first.shingle").alias("shingle"), F.col("first.at").alias("at"))


def occurrences(docs: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """Where windows occur: doc_id, key, start, words.

    A document's shingle that is a window's prefix fixes where the window would start. It must
    fit between the document's ends (bounds of position and length); then the words from there
    on are compared with the window's.
    """
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
    same = F.slice("words", start + 1, F.size("window")) == F.col("window")
    table = prefixes.withColumnRenamed("words", "window")
    side = small_side(table)
    found = document_shingles(docs, sizes, ["doc_id", "key"])
    if side is table:
        # Too many windows to broadcast: send places alone, and words only of documents with one.
        places = written(found.drop("words").join(table, "shingle").select(
            "doc_id", "key", "pos", "at", "window"), "places")
        asked = small_side(written(places.select(
            F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "places-of"))
        told = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
        texts = docs.select("doc_id", "key", "words").join(asked, told, "left_semi")
        texts = texts.dropDuplicates(["doc_id", "key"])
        on = places["doc_id"].eqNullSafe(texts["doc_id"]) & (places["key"] == texts["key"])
        joined = places.join(texts, on).select(
            places["doc_id"], places["key"], "words", "pos", "at", "window")
    else:
        joined = found.join(side, "shingle")
    return joined.filter(fits).filter(same).select(
        "doc_id", "key", start.alias("start"), F.col("window").alias("words"))


def covered(spans: Column) -> Column:
    """The number of places in the union of sorted spans (start, size)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_words, n_hit, n_items, items, contaminated.

    ``key`` is a hash of the text that tells apart rows of equal doc_id; ``items`` the sorted ids.

    Null and empty texts have no words and are never hit. Items without words have no window.
    Repeated documents get a row each, repeated items of one id count once, null item ids and
    null doc_ids are values of their own (a null item id is never listed). Empty tables: no
    documents give no rows, no items leave every document clean. Other columns are not read.

    The documents are read as they lie and never shuffled as text while the windows fit the
    broadcast bound; beyond it, places are joined by shuffle, and then the words of the documents
    that have places. Only hits are grouped.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("key"),
        words_of().alias("words"))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("key"),
        F.size(words_of()).cast("long").alias("n_words"))
    windows = written(item_windows(items, window), "windows")
    shingles = written(
        window_shingles(windows.select("words").distinct(), shingle), "window-shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect()) or [shingle]
    prefixes = written(rarest_first(rows, shingles, sizes), "prefixes")
    hits = written(occurrences(rows, prefixes, sizes).distinct(), "hits")
    spans = hits.groupBy("doc_id", "key").agg(covered(F.array_sort(F.collect_set(
        F.struct("start", F.size("words").alias("size"))))).cast("long").alias("n_hit"))
    listed = hits.select("doc_id", "key", "words").distinct().join(
        small_side(windows), "words").select("doc_id", "key", "item_id").distinct()
    listed = listed.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_list("item_id")).alias("items"))
    found = _with(spans, listed)
    return _with(sized, found).select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by doc_id (null joins null) and key."""
    other = right.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return left.join(other, on, "left").drop("_id", "_key")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, all columns as they are."""
    dirty = contamination(docs, items).filter("contaminated").select("doc_id", "key").distinct()
    dirty = small_side(written(dirty, "contaminated"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64(text_or_empty()).alias("_key"))
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    return rows.join(dirty, on, "left_anti").select("row.*")
