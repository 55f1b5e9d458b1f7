"""Compare registered queries with their SQL: python tests/check_sql.py [sf dir] [names...]"""

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = "nan" if math.isnan(v) else repr(v + 0.0)
            cells.append(str(v))
        out.append("\x1f".join(cells))
    return sorted(out)


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if digest(got) == digest(want):
        return True, f"{len(got)} rows"
    a, b = set(got), set(want)
    return False, f"{len(got)} rows against {len(want)}; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}".replace("\x1f", " | ")


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            ok, detail = compare(spark, con, sf_dir, name, fn, checks.get(name))
        except Exception as e:  # report and go on
            ok, detail = False, f"{type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {detail}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
