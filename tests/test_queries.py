"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {"pipeline"}))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_crc32c(spark):
    from blocksmith.functions.checksum import crc32c

    for row in entry.queries()["crc32c"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").limit(20).collect():
        assert row["crc"] == crc32c(row["text"].encode())


def test_bench_arguments_and_report():
    import bench

    from blocksmith.plans import measure, workloads

    assert bench.arguments([]) == [1_000_000, 21, 100_000] and bench.arguments(["7", "3"]) == [7, 3, 100_000]
    for bad in (["0"], ["1", "1", "1", "1"], ["x"]):
        with pytest.raises((SystemExit, ValueError)):
            bench.arguments(bad)
    for threads in (1, 4):
        report = {x["format"]: x for x in measure.compare(workloads.sequence_table(2000), 500, 2, threads)}
        assert set(report) == {"blocks", "parquet"} and all(x["encode_mib_s"] > 0 and x["ratio"] < 1 for x in report.values())
