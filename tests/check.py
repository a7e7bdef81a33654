"""Run registered queries next to their SQL and compare: names, types, every value.

    python tests/check.py [sf] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _types(arrow_schema) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "").replace("[us, tz=UTC]", "[us]") for f in arrow_schema}


def _normal(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = [
        tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in row)
        for row in pdf.itertuples(index=False, name=None)
    ]
    return sorted(rows, key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    problems = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = _normal(got), _normal(want)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        problems.append(f"values differ\n   spark  {str(only_a)[:700]}\n   oracle {str(only_b)[:700]}")
    return problems


def check(spark, con, folder, name, fn, sql) -> tuple[list[str], int]:
    got = fn(spark, folder).toArrow()
    if sql is None:
        return ([] if got.num_rows else ["no rows"]), got.num_rows
    want = con.sql(sql).to_arrow_table()
    problems = []
    ta, tb = _types(got.schema), _types(want.schema)
    if ta != tb:
        problems.append(f"types {[(c, ta.get(c), tb.get(c)) for c in sorted(set(ta) | set(tb)) if ta.get(c) != tb.get(c)]}")
    return problems + compare(got.to_pandas(date_as_object=False), want.to_pandas(date_as_object=False)), got.num_rows


def main() -> None:
    import __spark_entry__ as entry
    from newsloom.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = get_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    con, queries, oracle = connect(folder), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    if names[0].startswith("@"):
        names = [n for n in queries if queries[n].__module__.endswith(names[0][1:])]
    bad = 0
    for name in names:
        t = time.time()
        try:
            problems, rows = check(spark, con, folder, name, queries[name], oracle.get(name))
        except Exception as e:  # report and go on with the next query
            problems, rows = [f"{type(e).__name__}: {str(e)[:1500]}"], 0
        bad += bool(problems)
        kind = "exact" if name in oracle else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name:32} {kind:5} {rows:8} rows {time.time() - t:6.2f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
