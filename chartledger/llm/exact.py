"""Exact deduplication by deterministic block naming."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartledger.llm.common import text_or_empty, written

BLOCK_BYTES = 8192


def blocks_of(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row per fixed-size block of each text; an empty text has one empty block."""
    body = F.col("text").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_bytes))).cast("int")
    cut = rows.select("doc_id", "text_sha256", "text", n.alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")
    block = F.substring(body, F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    return cut.select("doc_id", "text_sha256", "n", "text", at).select(
        "doc_id", "text_sha256", "n", "pos", block.alias("block"))


def number(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Integer names in the order of the keys, for a frame without repeated keys.

    Sorted by ranges; each partition numbers its rows from its own start. Written, so that the
    names are fixed.
    """
    ranged = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ranged.withColumn("name", F.monotonically_increasing_id()), name)


def name_blocks(blocks: DataFrame) -> DataFrame:
    """Names of all blocks: equal names if and only if the bytes are equal.

    Blocks are sorted by a 64-bit hash and then by content, and numbered in that order. One
    aggregation finds the smallest and the largest content of each hash, combined before the
    shuffle, so a block shared by a third of all documents is sent once a task. Where both agree
    the hash stands for one content; hashes of several contents (expected on none) are numbered
    by the contents themselves.
    """
    hashed = blocks.withColumn("h", F.xxhash64("block"))
    spread = written(hashed.groupBy("h").agg(
        F.min("block").alias("low"), F.max("block").alias("high")).select(
            "h", (F.col("low") != F.col("high")).alias("mixed")), "hashes")
    mixed = spread.filter("mixed").select("h")
    keyed = hashed.drop("block").withColumn("content", F.lit(None).cast("binary"))
    single = spread.filter(~F.col("mixed")).select("h", F.lit(None).cast("binary").alias("content"))
    if mixed.limit(1).count():
        keyed = hashed.join(mixed.withColumn("several", F.lit(True)), "h", "left").withColumn(
            "content", F.when(F.col("several"), F.col("block"))).drop("block", "several")
        contents = keyed.filter("content IS NOT NULL").select("h", "content").distinct()
        single = single.unionByName(contents)
    names = number(single, ["h", "content"], "block-names")
    if mixed.limit(1).count():
        plain = keyed.filter("content IS NULL").drop("content").join(
            names.filter("content IS NULL").drop("content"), "h")
        told = keyed.filter("content IS NOT NULL").join(
            names.filter("content IS NOT NULL"), ["h", "content"]).drop("content")
        return plain.unionByName(told).drop("h")
    return keyed.drop("content").join(names.drop("content"), "h").drop("h")


def document_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One identity (n blocks, name) per distinct (doc_id, text): doc_id, text_sha256, n, name.

    Level 0 names the blocks. Each further level names adjacent pairs of names and halves the
    number per document; a last name without a partner is paired with -1. A document is done when
    one name is left. Documents of equal block counts are done at the same level, where equal
    names mean equal pairs and so, level by level, equal bytes.
    """
    level = written(name_blocks(blocks_of(rows, block_bytes)), "level-0")
    # A row that occurs several times names its blocks several times, always alike.
    level = level.groupBy("doc_id", "text_sha256", "n", "pos").agg(F.min("name").alias("name"))
    done = level.filter("n = 1").select("doc_id", "text_sha256", "n", "name")
    longest = level.agg(F.max("n")).first()[0] or 1
    level, width, k = level.filter("n > 1"), longest, 0
    while width > 1:
        k, width = k + 1, (width + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy(
            "doc_id", "text_sha256", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")
        ).agg(F.max(F.when(even, F.col("name"))).alias("a"),
              F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = written(pairs, f"pairs-{k}")
        names = number(pairs.select("a", "b").distinct(), ["a", "b"], f"names-{k}")
        level = written(pairs.join(names, ["a", "b"]).drop("a", "b"), f"level-{k}")
        whole = F.col("n") <= F.lit(2 ** k)
        done = done.unionByName(level.filter(whole).select("doc_id", "text_sha256", "n", "name"))
        level = level.filter(~whole)
    return done


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts and form one group. Of a group the row with the largest doc_id
    stays; null ids never win over others, and a group of null ids alone has a null keep_id and
    keeps its rows. Repeated rows are rows of their group; copies of the row that stays have its
    id and stay too. An empty table gives an empty result. Other columns are not read.

    The text is shuffled once, as distinct blocks of each task. A group of any size meets only
    its one row of (keep_id, group_size), in a join whose hot side can be split.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    names = document_names(rows, block_bytes)
    counted = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    named = written(counted.join(names.withColumnsRenamed(
        {"doc_id": "_id", "text_sha256": "_sha"}), same).drop("_id", "_sha"), "named")
    groups = named.groupBy("n", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    joined = named.join(groups, ["n", "name"])
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row")).drop("_row")
