"""Compare registered queries with DuckDB on an input folder: python tests/compare.py SF [name...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for row in pdf.itertuples(index=False):
        rows.append(tuple("" if v is None or v != v else (repr(float(v)) if isinstance(v, float) else str(v)) for v in row))
    return sorted(rows)


def frame_rows(df) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def duck_rows(con, sql: str) -> pd.DataFrame:
    cur = con.execute(sql)
    return pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)


def difference(df, con, sql: str) -> str | None:
    left, right = frame_rows(df), duck_rows(con, sql)
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    a, b = canon(left), canon(right)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} / {len(b)}; columns {sorted(left.columns)}\n   spark {only_a}\n   duck  {only_b}"


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = session()
    con = connect(folder)
    names = sys.argv[2:]
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                diff = difference(df, con, sqls[name])
                note = "" if diff is None else diff
            else:
                diff, note = None, f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            diff, note = "error", str(e)[:1500]
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'BAD '} {name} {time.time() - start:.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
