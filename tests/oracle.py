"""Compare a query's rows with those of its SQL."""

import math
from pathlib import Path

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return repr(float(value) + 0.0)
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(records, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in records)


def check(spark, folder, function, sql):
    got = function(spark, folder)
    relation = connect(folder).execute(sql)
    columns = sorted(d[0] for d in relation.description)
    assert sorted(got.columns) == columns
    names = [d[0] for d in relation.description]
    want = [dict(zip(names, r)) for r in relation.fetchall()]
    assert rows_of([r.asDict() for r in got.collect()], columns) == rows_of(want, columns)
