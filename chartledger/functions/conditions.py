"""The condition language over sparse path-to-value facts, compiled to boolean SQL text.

``get`` maps a path to the SQL text of its value (a column name, a map lookup), or to None where
the path cannot be recorded. Text is used because one expression then takes one call to build.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<="}
Lookup = Callable[[str], str | None]


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _equals(value: str, wanted) -> str:
    """Typed membership: the wanted scalar is one of the value's elements."""
    if isinstance(wanted, bool):
        return f"coalesce({value}.b = {str(wanted).lower()}, false)"
    if isinstance(wanted, (int, float)):
        return f"coalesce({value}.n = {float(wanted)}D, false)"
    word = quote(wanted)
    return (f"(coalesce({value}.s = {word}, false) "
            f"OR coalesce(array_contains({value}.a, {word}), false))")


def _any_of(value: str, wanted) -> str:
    return "(" + (" OR ".join(_equals(value, w) for w in wanted) or "false") + ")"


def _items(value: str) -> str:
    number = (f"CASE WHEN {value}.n = floor({value}.n) THEN CAST(CAST({value}.n AS BIGINT) AS "
              f"STRING) ELSE CAST({value}.n AS STRING) END")
    return (f"CASE WHEN {value}.kind = 'list' THEN {value}.a ELSE array(coalesce({value}.s, "
            f"{number}, CAST({value}.b AS STRING))) END")


def condition_sql(clause, get: Lookup) -> str:
    """One condition as a total boolean.

    ``clause`` is (path, operator, argument), or ("any", [conditions]) / ("all", [conditions]). A
    path that is not recorded is false for everything except ``not_recorded`` (or
    ``recorded: False``).
    """
    if clause[0] in ("any", "all"):
        word = " OR " if clause[0] == "any" else " AND "
        return "(" + word.join(condition_sql(c, get) for c in clause[1]) + ")"
    path, op, arg = clause
    value = get(path)
    present = "false" if value is None else f"({value} IS NOT NULL)"
    if op in ("recorded", "not_recorded"):
        return present if bool(arg) == (op == "recorded") else f"(NOT {present})"
    if value is None:
        return "false"
    if op == "eq":
        test = _equals(value, arg)
    elif op == "ne":
        test = f"NOT {_equals(value, arg)}"
    elif op == "in":
        test = _any_of(value, arg)
    elif op == "not_in":
        test = f"NOT {_any_of(value, arg)}"
    elif op == "contains":
        test = f"exists({_items(value)}, x -> contains(lower(x), {quote(str(arg).lower())}))"
    elif op in _COMPARE:
        number = f"coalesce({value}.n, try_cast({value}.s AS DOUBLE))"
        test = f"{number} {_COMPARE[op]} {float(arg)}D"
    else:
        raise ValueError(f"unknown operator {op!r}")
    return f"({present} AND coalesce({test}, false))"


def condition(clause, get: Lookup) -> Column:
    return F.expr(condition_sql(clause, get))


def all_of(conditions, get: Lookup) -> Column:
    return F.expr(" AND ".join(condition_sql(c, get) for c in conditions) or "true")


def map_lookup(column: str) -> Lookup:
    """`get` over a MAP<STRING, value> column."""
    return lambda path: f"try_element_at({column}, {quote(path)})"


def column_lookup(names: dict[str, str]) -> Lookup:
    """`get` over one value column per path."""
    return names.get


def paths_in(conditions) -> list[str]:
    """Every path a list of conditions reads, sorted."""
    found = set()
    for c in conditions:
        if c[0] in ("any", "all"):
            found.update(paths_in(c[1]))
        else:
            found.add(c[0])
    return sorted(found)
