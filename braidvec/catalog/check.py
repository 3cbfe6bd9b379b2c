"""Run registered queries against their SQL in DuckDB: ``python -m braidvec.catalog.check FOLDER [name ...]``."""

from __future__ import annotations

import math
import sys
import time


def normal(value):
    """Comparable form of a result value; the kind of number is kept."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"f{value + 0.0!r}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return f"{type(value).__name__[0]}{value}"


def compare(spark, connection, root: str, name: str) -> str:
    """'ok', 'rows-only', or what differs."""
    from braidvec.catalog import load

    queries, sql = load()
    frame = queries[name](spark, root)
    columns = sorted(frame.columns)
    ours = sorted(tuple(normal(v) for v in row) for row in frame.select(*columns).collect())
    if name not in sql:
        return f"rows-only ({len(ours)})"
    result = connection.execute(sql[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(normal(row[i]) for i in order) for row in result.fetchall())
    if ours == theirs:
        return f"ok ({len(ours)})"
    only = [r for r in ours if r not in set(theirs)][:3]
    other = [r for r in theirs if r not in set(ours)][:3]
    return f"DIFF {len(ours)}/{len(theirs)} rows {columns} ours {only} theirs {other}"


def main() -> int:
    import duckdb

    from braidvec.catalog import load
    from braidvec.session import get_session

    root, wanted = sys.argv[1], sys.argv[2:]
    spark = get_session(master="local[8]", partitions=8)
    connection = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    bad = 0
    for name in wanted or load()[0]:
        begin = time.time()
        try:
            outcome = compare(spark, connection, root, name)
        except Exception as problem:  # noqa: BLE001
            outcome = f"FAIL {type(problem).__name__}: {str(problem)[:600]}"
        bad += not outcome.startswith(("ok", "rows-only"))
        print(f"{name:28s} {time.time() - begin:6.2f}s {outcome}", flush=True)
    print(f"{bad} problems")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
