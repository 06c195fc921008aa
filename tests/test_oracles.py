import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = entry.queries()[name](spark, DIR)
    wanted = db.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = rows_of(found.columns, [tuple(r) for r in found.collect()]), rows_of(wanted.columns, wanted.fetchall())
    assert a == b, (len(list(a.elements())), len(list(b.elements())), list((a - b).items())[:3], list((b - a).items())[:3])


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
