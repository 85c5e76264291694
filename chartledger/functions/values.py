"""The fact value: one STRUCT that can hold a text, a number, a boolean or a list of texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_TYPE = "struct<kind:string,s:string,n:double,b:boolean,a:array<string>>"


def make_value(kind: Column, text: Column) -> Column:
    """Build a value from its kind (text, number, bool, list) and its text form.

    A list is written with ``|`` between its elements. A null text gives a null value.
    """
    value = F.struct(
        kind.alias("kind"),
        F.when(kind == "text", text).alias("s"),
        F.when(kind == "number", text.try_cast("double")).alias("n"),
        F.when(kind == "bool", text.try_cast("boolean")).alias("b"),
        F.when(kind == "list", F.split(text, r"\|")).alias("a"),
    )
    return F.when(text.isNotNull(), value)


def number_text(n: Column) -> Column:
    """A number as text: whole numbers without a decimal point."""
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def value_items(value: Column) -> Column:
    """The value as an array of texts; a scalar is a list of one."""
    return F.when(value["kind"] == "list", value["a"]).otherwise(F.array(scalar_text(value)))


def scalar_text(value: Column) -> Column:
    return F.coalesce(value["s"], number_text(value["n"]), value["b"].cast("string"))


def value_text(value: Column, sep: str = ", ") -> Column:
    """Any value as one text."""
    return F.when(value["kind"] == "list", F.array_join(value["a"], sep)).otherwise(
        scalar_text(value)
    )


def value_number(value: Column) -> Column:
    """The value as a number, or null. A boolean or a list is never a number."""
    return F.coalesce(value["n"], value["s"].try_cast("double"))


def rank_of(values, default=None):
    """A lookup from fixed text to its position, as a function of a column."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    table = F.create_map(*pairs)

    def look(col: Column) -> Column:
        got = F.try_element_at(table, col)
        return got if default is None else F.coalesce(got, F.lit(default))

    return look
