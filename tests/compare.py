"""Run named queries on Spark and their SQL on DuckDB and compare all rows."""

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "timestamp": "TIMESTAMP",
}


def compare(spark, con, folder, fn, sql, clock=None):
    """Returns (number of rows, list of problems)."""
    t0 = time.time()
    df = fn(spark, folder)
    cols = df.columns
    collected = df.collect()
    if clock is not None:
        clock["spark"] = time.time() - t0
    got = rows_of(cols, [tuple(r) for r in collected])
    if sql is None:
        return len(got), [] if got else ["no rows, and no SQL to say that there are none"]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    want = rows_of(names, cur.fetchall())
    problems = []
    if sorted(cols) != sorted(names):
        problems.append(f"columns {sorted(cols)} vs {sorted(names)}")
        return len(got), problems
    for c, t in df.dtypes:
        if KINDS.get(t, t) != kinds[c]:
            problems.append(f"type of {c}: {t} vs {kinds[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    diff = sorted(set(got) ^ set(want))
    if diff:
        a = [g for g in got if g not in set(want)][:3]
        b = [w for w in want if w not in set(got)][:3]
        problems.append(f"{sorted(cols)}: {len(diff)} differing rows, spark {a} sql {b}")
    elif got != want:
        problems.append("multiplicity differs")
    return len(got), problems


def main(argv):
    from hotgrid import plans, session

    folder = argv[1]
    names = argv[2:]
    spark = session.local_session()
    con = duck(folder)
    qs, ora = plans.queries(), plans.oracle_sql()
    bad = 0
    for name in names or qs:
        t0, clock = time.time(), {}
        try:
            n, problems = compare(spark, con, folder, qs[name], ora.get(name), clock)
        except Exception as e:  # report and go on with the next query
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        print(f"{'OK ' if not problems else 'BAD'} {name} rows={n} {clock.get('spark', 0):.1f}s of {time.time() - t0:.1f}s {'' if name in ora else '(no sql)'}", flush=True)
        for p in problems:
            print("    ", p[:1800], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
