"""Compare registered queries with their SQL: ``python tests/oracle.py [sf] [names…]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, ordered([tuple(plain(v) for v in r) for r in df.select(*names).collect()])


def duck_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    place = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in place) for r in cursor.fetchall()]
    return [names[i] for i in place], ordered(rows)


def differences(spark_result, duck_result):
    (sn, sr), (dn, dr) = spark_result, duck_result
    if sn != dn:
        return [f"columns: only spark {sorted(set(sn) - set(dn))}, only sql {sorted(set(dn) - set(sn))}"]
    found = [] if len(sr) == len(dr) else [f"rows: spark {len(sr)}, sql {len(dr)}"]
    for a, b in zip(sr, dr):
        for name, x, y in zip(sn, a, b):
            if x != y or type(x) is not type(y):
                found.append(f"{name}: spark {x!r}, sql {y!r}  row {a[:4]}")
                break
    return found


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as driver
    from relpoint.session import configure

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = driver.queries(), driver.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, folder))
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name:32s} {took:6.2f}s {len(got[1])}", flush=True)
                continue
            bad = differences(got, duck_rows(sql[name], folder))
        except Exception as error:  # report and go on with the next query
            bad, took = [f"{type(error).__name__}: {str(error)[:1500]}"], time.time() - start
        failed += bool(bad)
        state = "FAIL" if bad else "ok"
        rows = len(got[1]) if not bad else ""
        print(f"{state:5s} {name:32s} {took:6.2f}s {rows} {len(bad) or ''}", flush=True)
        for line in bad[:6]:
            print("      ", line)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
