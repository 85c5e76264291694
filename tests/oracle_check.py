"""Run a registered query and its SQL side by side and compare the rows."""

import datetime as dt
import math
import tempfile
from decimal import Decimal

import duckdb

from chartledger.plans.bindings import BASE_TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET memory_limit='8GB'")
    con.execute("SET max_temp_directory_size='1GB'")
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='run-')}'")
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, (int, Decimal)):
        return str(int(x)) if x == int(x) else repr(float(x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (str(int(x)) if x == int(x) else repr(round(x, 9)))
    if isinstance(x, dt.datetime) and x.time() == dt.time(0):
        return str(x.date())
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(same, note, row count)."""
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, "", len(a)
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return False, f"{sorted(cols)} rows {len(a)} vs {len(b)}; spark {only_a}; sql {only_b}", len(a)
