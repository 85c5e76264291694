"""Whole JSON documents, written row by row.

Each row becomes a fragment of its document's text: the first opens the document, the last closes
it, and those between carry the commas. The rows are sorted by document, so Spark's text writer
puts the fragments one after another, and no document is ever one value on the way. A document of
any length costs a sort that spills; it lies in one file, on one line. Files are compressed: the
names of fields and references come again in every entry.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what the writer puts between fragments. White space between JSON tokens means nothing.
BETWEEN = " "


def fragments(rows: DataFrame, key: str, sections: tuple[str, ...], head: Column,
              order: list[str], item: Column | None = None,
              late: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: ``key`` and the fragment's text, in the order of the documents.

    ``rows`` holds ``section`` and ``item`` (JSON text; null becomes null). A document is an object
    with the fields of ``head`` (a struct, the same for all rows of a key) and one list for each of
    its sections, which come in the order of ``sections`` and after them by name; items are sorted
    by ``order`` and then by their text. Rows of a null key make one document of their own, repeated
    rows stay, a null section is named "", and without rows there is no document.

    With ``item``, an expression over the columns of ``rows``, the rows are shuffled and sorted as
    they are, and a text is made of a row in its place only (and where it alone tells two rows
    apart); ``late`` are columns, such as hashes, that are made between the shuffle and the sort.
    """
    name = F.coalesce("section", F.lit(""))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[
        F.lit(s) for s in sections]), name), F.lit(0)), F.lit(len(sections) + 1))
    text = F.coalesce(F.col("item") if item is None else item, F.lit("null"))
    sort = ["_place", "_section", *order]
    if item is None:
        # Only a document's first row needs the head's text, so the sort carries the values alone.
        base = rows.select(
            key, name.alias("_section"), place.alias("_place"), text.alias("_item"),
            head.alias("_head"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)])
        sort = ["_place", "_section", *[f"_by{i}" for i in range(len(order))], "_item"]
        text, head = F.col("_item"), F.col("_head")
    else:
        base = rows.repartition(key).withColumns({**(late or {}), "_section": name, "_place": place})
        # A window would make the text before its sort; here it is made when two rows tie.
        base = base.sortWithinPartitions(key, *sort, text)
    by = Window.partitionBy(key).orderBy(*sort)
    before, after = F.lag("_section").over(by), F.lead("_section").over(by)
    opened = F.to_json(head)
    shut = F.substring(opened, F.lit(1), F.length(opened) - 1)
    quoted = F.to_json(F.struct(F.col("_section").alias("s")))
    label = F.concat(F.substring(quoted, F.lit(6), F.length(quoted) - 6), F.lit(":["))
    comma = F.when(shut == "{", F.lit("")).otherwise(F.lit(","))
    start = (
        F.when(F.col("_before").isNull(), F.concat(shut, comma, label))
        .when(F.col("_before") != F.col("_section"), F.concat(F.lit("],"), label))
        .otherwise(F.lit(",")))
    end = F.when(F.col("_after").isNull(), F.lit("]}\n")).otherwise(F.lit(""))
    told = base.withColumns({"_before": before, "_after": after})
    return told.select(key, F.concat(start, text, end).alias("value"))


def write_documents(parts: DataFrame, path: str) -> None:
    """Write what `fragments` gives, as it lies: one document a line."""
    parts.select("value").write.mode("error").option("lineSep", BETWEEN).option(
        "compression", "gzip").text(path)


def read_documents(spark, path: str) -> DataFrame:
    """The documents' lines: value. A reader holds one document at a time."""
    return spark.read.text(path).filter(F.trim("value") != "")
