"""Run registered queries next to their SQL in DuckDB and compare every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def compare(df, con, sql: str) -> str | None:
    """None where both agree, else a short account of the difference."""
    names = sorted(df.columns)
    table = df.select(*[f"`{n}`" for n in names]).toArrow()
    ours = sorted(tuple(cell(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names]))
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    if sorted(columns) != names:
        return f"columns {names} / {sorted(columns)}"
    at = [columns.index(n) for n in names]
    rows = rel.fetchall()
    kinds_sql = {columns[i]: str(d[1]) for i, d in enumerate(rel.description)}
    theirs = sorted([tuple(cell(r[i]) for i in at) for r in rows])
    kind = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for f in df.schema.fields:
        want = kind.get(f.dataType.simpleString(), "?")
        if want not in kinds_sql[f.name].upper() and not (want == "VARCHAR" and "STRING" in kinds_sql[f.name].upper()):
            return f"type of {f.name}: {f.dataType.simpleString()} / {kinds_sql[f.name]}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, names {names}, first: {str(bad[0][0])[:500]} / {str(bad[0][1])[:500]}"
    return None if ours else "no rows"


def main(folder: str, wanted: list[str]):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from pairloom.session import local_session

    spark = local_session(8)
    con, sqls = database(folder), entry.oracle_sql()
    for name, plan in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = plan(spark, folder)
            if name in sqls:
                result = compare(df, con, sqls[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            result = "ERROR " + str(error)[:1500]
        print(f"{name:24s} {time.time() - start:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
