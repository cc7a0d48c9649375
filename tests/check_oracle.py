"""Runs every catalog query and its SQL and compares the rows.  Usage: check_oracle.py [sf_dir] [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from riskloom.plans.catalog import catalog  # noqa: E402
from riskloom.plans.oracle import oracle  # noqa: E402


def connect(sf_dir):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_plain(row[i]) for i in order) for row in data), key=lambda r: [(v is None, str(v)) for v in r]
    )


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def compare(spark, db, sf_dir, name):
    """None when equal, else a description of the difference."""
    df = catalog()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = db.execute(oracle()[name])
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if different:
        return f"{len(different)} rows differ, first: {different[0]}"
    if not ours[1]:
        return "no rows"
    return None


if __name__ == "__main__":
    from riskloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    for query in sys.argv[2:] or catalog():
        started = time.time()
        try:
            difference = compare(session, database, folder, query)
        except Exception as error:
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if difference is None else 'FAIL'} {query} {time.time() - started:.1f}s {difference or ''}", flush=True)
