"""Runs a query and its SQL twin over the same tables and compares columns, types' kinds and values, whatever the order."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"
KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool"}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        path = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(df, sql: str, sf_dir: str = DATA) -> list[str]:
    """What differs; empty when nothing does."""
    want = duck(sf_dir).sql(sql)
    names = sorted(df.columns)
    if names != sorted(want.columns):
        return [f"columns {names} against {sorted(want.columns)}"]
    out = []
    integers = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UBIGINT"}
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    for name, kind in df.dtypes:
        if (kind in ("bigint", "int", "smallint", "tinyint")) != (kinds[name] in integers):
            out.append(f"type of {name}: {kind} against {kinds[name]}")
        elif kinds[name] == "HUGEINT":
            out.append(f"type of {name} is HUGEINT")
    key = lambda row: tuple((v is not None, repr(v)) for v in row)
    place = {c: k for k, c in enumerate(want.columns)}
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    have = sorted((tuple(r[place[c]] for c in names) for r in want.fetchall()), key=key)
    if len(got) != len(have):
        out.append(f"{len(got)} rows against {len(have)}")
    for a, b in zip(got, have, strict=False):
        if key(a) != key(b):
            out.append(f"{a} against {b}")
            break
    return out
