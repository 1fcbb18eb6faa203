"""Compare registered queries with their SQL on one data folder.

python tests/compare.py [folder] [name ...]
"""

import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def cell(value):
    if value is None or value != value:
        return "∅"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, connection, folder, query, sql):
    frame = query(spark, folder)
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    answer = connection.execute(sql)
    theirs = canonical([c[0] for c in answer.description], answer.fetchall())
    return ours, theirs


def main(argv):
    import __spark_entry__ as entry
    from sessionlens.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name not in oracles:
                rows = query(spark, folder).count()
                print(f"rows  {name} {rows} {time.time() - start:.1f}s")
                continue
            ours, theirs = compare(spark, connection, folder, query, oracles[name])
        except Exception as problem:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {type(problem).__name__} {str(problem)[:1500]}")
            continue
        same = ours == theirs
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name} {len(ours[1])} {len(theirs[1])} {time.time() - start:.1f}s", flush=True)
        if not same:
            print("  columns", ours[0], theirs[0])
            left, right = set(ours[1]), set(theirs[1])
            for row in sorted(left - right)[:4]:
                print("  ours  ", str(row)[:300])
            for row in sorted(right - left)[:4]:
                print("  sql   ", str(row)[:300])
    print("bad", bad)


if __name__ == "__main__":
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    main(sys.argv[1:])
