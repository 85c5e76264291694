"""Dates written in text, with the precision each one was written to."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartledger.config.vocabulary import MONTHS
from chartledger.functions.once import computed_once

_MONTH = "(" + "|".join(MONTHS) + ")"

# Date notations in the order they are tried: pattern, how its groups spell a date,
# the format of that spelling, and the precision.
DATE_PATTERNS = (
    (r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b", "$3 $2 $1", "yyyy M d", "exact"),
    (r"\b(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\b", "$1 $2 $3", "yyyy M d", "exact"),
    (rf"\b(\d{{1,2}})\s+{_MONTH}[a-z]*\s+(\d{{4}})\b", "$3 $2 $1", "yyyy MMM d", "exact"),
    (rf"\b{_MONTH}[a-z]*\s+(\d{{4}})\b", "$2 $1 1", "yyyy MMM d", "month"),
    (r"\b((?:19|20)\d{2})\b", "$1 1 1", "yyyy M d", "year"),
)
DATE_CUE = (
    r"(?i)\b(?:date|dated|dt|on|report(?:ed)? on|collected(?: on)?|sample date|visit date)\b"
)
_MARK = "\u0001"


def with_dates(rows: DataFrame, text: str, day: str, precision: str) -> DataFrame:
    """Add the date written in a text: of the first notation whose first match is a real date.

    Each notation runs once per row and rewrites the text to its parts; a text without four
    digits in a row runs none.
    """
    may_hold = F.col(text).rlike(r"\d{4}")
    spelled, days = {}, {}
    for i, (pattern, parts, fmt, _precision) in enumerate(DATE_PATTERNS):
        found = F.regexp_replace(F.col(text), rf"(?is)^.*?{pattern}.*$", _MARK + parts)
        spelled[f"_s{i}"] = F.when(may_hold, found)
        here = F.col(f"_s{i}")
        days[f"_d{i}"] = F.when(
            here.startswith(_MARK) & ~here.startswith(_MARK + "0000"), F.try_to_date(F.initcap(F.substr(here, F.lit(2))), fmt))
    rows = computed_once(computed_once(rows, **spelled), **days)
    first = F.coalesce(*[
        F.when(F.col(f"_d{i}").isNotNull(), kind) for i, (_p, _s, _f, kind) in
        enumerate(DATE_PATTERNS)
    ], F.lit("unknown"))
    return rows.withColumns(
        {day: F.coalesce(*[F.col(d) for d in days]), precision: first}
    ).drop(*spelled, *days)
