"""Compare a query with its SQL: schema, row count and all values, whatever the row order."""

import glob
import os

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def differences(df, con, sql):
    """Nothing when equal, else what differs."""
    want_rel = con.execute(f"SELECT * FROM ({sql}) AS q")
    want_types = {d[0]: str(d[1]) for d in want_rel.description}
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got_types = {n: TYPES.get(t, t.upper()) for n, t in got_types.items()}
    if got_types != want_types:
        pairs = {n: (got_types.get(n), want_types.get(n)) for n in sorted({*got_types, *want_types})}
        return f"schema (got, want): { {n: p for n, p in pairs.items() if p[0] != p[1]} }"
    names = sorted(got_types)
    at = [list(want_types).index(n) for n in names]
    want = sorted(tuple(text(r[i]) for i in at) for r in want_rel.fetchall())
    got = sorted(tuple(text(r[n]) for n in names) for r in df.collect())
    if got == want:
        return None
    extra = sorted(set(got) - set(want))[:3]
    missing = sorted(set(want) - set(got))[:3]
    return f"rows {len(got)} want {len(want)}; columns {names}; extra {extra}; missing {missing}"
