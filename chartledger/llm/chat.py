"""Chat formatting with a grammar round trip.

Grammar of the output, from which it is parsed back:

    conversation := turn*
    turn         := "### " role ": " body "</turn>" newline

A backslash in a role or body stands for the character after it. Control strings are broken by a
backslash inside them: ``<\\/turn>``, ``#\\## `` and, in roles, ``:\\ ``.

Beside each formatted text stands its loss mask: the ranges of the bodies that are learnt from.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER, COLON, END = "### ", ": ", "</turn>\n"
# The role whose turns are learnt from.
LEARNT = "assistant"
_UNESCAPE = r"(?s)\\(.)"


def escaped(text: Column) -> Column:
    """The text with backslashes doubled and control strings broken."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    out = F.replace(out, F.lit("### "), F.lit("#\\## "))
    return F.replace(out, F.lit(COLON), F.lit(":\\ "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEADER), role, F.lit(COLON), body, F.lit(END))


def parsed(text: Column) -> Column:
    """The turns (role, text) that the grammar finds in a formatted text.

    Cuts at every end mark and before every header, takes the role up to the first colon and
    blank, and undoes the backslashes. What does not start with a header has a null role.
    """
    parts = F.split(text, r"</turn>\n?|(?=### )", -1)

    def turn(part: Column) -> Column:
        at = F.instr(part, COLON)
        headed = part.startswith(HEADER) & (at > 0)
        role = F.when(headed, F.substring(part, F.lit(5), at - 5))
        body = F.when(headed, F.substr(part, at + 2)).otherwise(part)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.filter(parts, lambda p: p != ""), turn)


def format_turns(turns: DataFrame) -> DataFrame:
    """Add ``out``, each turn's formatted text, escaped only where the round trip needs it.

    A turn is first written as it is and parsed. If what comes back is not exactly that turn, its
    role and text are written with escapes, which the grammar always reads back; the result is
    parsed and compared again, and a turn that still differs fails the job.
    """
    want = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    plain = rendered(F.col("role"), F.col("text"))
    once = turns.withColumn("out", plain).withColumn("safe", parsed(F.col("out")) == want)
    safe = rendered(escaped(F.col("role")), escaped(F.col("text")))
    twice = once.withColumn("out", F.when(F.col("safe"), F.col("out")).otherwise(safe)).drop("safe")
    checked = F.when(parsed(F.col("out")) == want, F.col("out")).otherwise(
        F.raise_error(F.lit("a formatted turn does not parse back")))
    return twice.withColumn("out", checked)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One formatted text per conversation: conv_id, formatted, mask, turns (those it was made from).

    ``mask`` lists the ranges (start, from 0, and length, in characters of the formatted text) of
    the bodies of ``LEARNT`` turns, as they are written there.

    Columns: conv_id, turn, role, text. Null roles and texts are empty. Turns are in the order of
    turn, role, text, null turns first; equal rows are all turns. Null conv_ids are one
    conversation. An empty table gives an empty result; other columns are not read.

    A conversation is one value in the output, so its rows meet in one task; turns are rendered,
    parsed and escaped before, row by row.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    out = format_turns(rows).withColumn("at", F.coalesce(
        F.sum(F.length("out").cast("long")).over(before), F.lit(0)))
    gathered = out.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "out", "at"))).alias("turns"))
    # array_sort puts null turns first within the struct order.
    return gathered.select(
        "conv_id", F.concat_ws("", F.col("turns.out")).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == LEARNT), _body_range).alias("mask"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        .alias("turns"))


def _body_range(turn: Column) -> Column:
    """Where a turn's body lies; the role ``LEARNT`` is written as it is."""
    head = len(HEADER) + len(LEARNT) + len(COLON)
    return F.struct((turn["at"] + head).alias("start"),
                    (F.length(turn["out"]) - head - len(END)).cast("long").alias("length"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the formatted texts and compare them with their source turns: conv_id, formatted, mask,
    turns as recovered. A conversation that differs fails the job."""
    got = formatted.withColumn("recovered", parsed(F.col("formatted")))
    same = F.col("recovered") == F.col("turns")
    return got.withColumn(
        "turns", F.when(same, F.col("recovered")).otherwise(
            F.raise_error(F.lit("a formatted conversation does not parse back")))
    ).drop("recovered")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """What the training loss sees of each conversation: the formatted text under its mask."""
    told = F.concat_ws("", F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("mask", lambda m: unescaped(F.substr(
        F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))))
    return conversations.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
