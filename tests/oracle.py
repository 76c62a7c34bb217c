"""Comparison of a query's rows with those of its SQL, run on the same files."""

import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

DATA = os.environ.get("LOAM_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings extracted_jobs companies geo_locations company_enrichment_rows "
    "id_sample_700 gold_holdout_snapshots snapshot_files crawl_logs benchmark labels reading_labels fx_rates pay_periods"
).split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(x):
    """A value both engines give alike: times without zone, numbers as floats rounded to nine digits."""
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, Decimal)):
        return float(f"{float(x):.9g}")
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return str(x)


def rows(names: list[str], values: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in values)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if the rows agree, else what differs."""
    rel = con.sql(sql)
    ours = [[v.asDict(True) if hasattr(v, "asDict") else v for v in r] for r in df.collect()]
    a, b = rows(df.columns, ours), rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only here {only[0]}; only there {only[1]}"
    return "" if a else "no rows"
