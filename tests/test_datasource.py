"""The data source: scans, blocks, columns, appends, filters, streams."""

import datetime
import decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blocksmith.sources.container import BlockWriter
from blocksmith.sources.datasource import block_index, list_files, register
from blocksmith.streaming.ingest import append_blocks


@pytest.fixture()
def table(spark, tmp_path):
    register(spark)
    df = spark.range(1000).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("s"), (F.col("id") % 3 == 0).alias("b"), F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("d"))
    df.repartitionByRange(2, "id").sortWithinPartitions("id").write.format("blocks").mode("append").option("block_rows", 150).save(str(tmp_path / "t"))
    return df, str(tmp_path / "t")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scans(spark, table):
    df, path = table
    read = spark.read.format("blocks")
    assert same(read.load(path), df)
    assert read.option("columns", "s,id").load(path).columns == ["id", "s"]
    numbered = spark.read.format("blocks").option("block_column", "true").load(path)
    third = [r["id"] for r in numbered.where("_block = 3").collect()]
    assert 0 < len(third) <= 150 and sorted(third) == [r["id"] for r in spark.read.format("blocks").option("blocks", "3").load(path).orderBy("id").collect()]
    index = block_index(spark, path)
    assert index.select("file", "block").distinct().count() == numbered.select("_block").distinct().count()
    with pytest.raises(Exception, match="BlockOutOfRange|of 8"):
        spark.read.format("blocks").option("blocks", "99").load(path).count()


def test_pushed_filter(spark, table):
    _, path = table
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("blocks").option("block_column", "true").option("push_filters", "true").load(path).where("_block = 1")
        assert df.rdd.getNumPartitions() == 1 and df.count() == 150
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_append_and_overwrite(spark, table):
    df, path = table
    df.limit(10).write.format("blocks").mode("append").save(path)
    assert spark.read.format("blocks").load(path).count() == 1010
    df.limit(10).write.format("blocks").mode("overwrite").save(path)
    assert spark.read.format("blocks").load(path).count() == 10


def test_types_that_spark_lacks(spark, tmp_path):
    register(spark)
    batch = pa.record_batch(
        [pa.array([2**64 - 1, None], pa.uint64()), pa.array([255, 1], pa.uint8()), pa.array(["x", None], pa.large_string()), pa.array([1, None], pa.date32()), pa.array([[1], None])], ["u", "b", "s", "d", "l"]
    )
    with open(tmp_path / "one.blk", "wb") as f:
        writer = BlockWriter(f, batch.schema)
        writer.write_batch(batch)
        writer.finish()
    rows = spark.read.format("blocks").load(str(tmp_path / "one.blk")).collect()
    assert rows[0]["u"] == decimal.Decimal(2**64 - 1) and rows[0]["d"] == datetime.date(1970, 1, 2) and rows[1]["s"] is None and rows[0]["b"] == 255


def test_stream(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "in"))
    query = append_blocks(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 30)
    query.awaitTermination()
    assert spark.read.format("blocks").load(str(tmp_path / "out")).count() == 100


def _one_file(path, rows):
    batch = pa.record_batch([pa.array(rows, pa.int64())], ["id"])
    with open(path, "wb") as f:
        writer = BlockWriter(f, batch.schema)
        writer.write_batch(batch)
        writer.finish()


def test_append_keeps_files_without_a_manifest(spark, tmp_path):
    register(spark)
    (tmp_path / "t").mkdir()
    _one_file(tmp_path / "t" / "a.blk", list(range(50)))
    spark.range(50, 57).write.format("blocks").mode("append").save(str(tmp_path / "t"))
    assert sorted(r["id"] for r in spark.read.format("blocks").load(str(tmp_path / "t")).collect()) == list(range(57))
    spark.range(3).write.format("blocks").mode("overwrite").save(str(tmp_path / "t"))
    assert spark.read.format("blocks").load(str(tmp_path / "t")).count() == 3 and not (tmp_path / "t" / "a.blk").exists()


def test_append_of_another_schema_is_refused(spark, table):
    df, path = table
    for other in (df.drop("b"), df.withColumn("id", F.col("id").cast("int")), df.select("s", "id", "b", "d")):
        with pytest.raises(Exception, match="SchemaChanged|the table has"):
            other.write.format("blocks").mode("append").save(path)
    assert same(spark.read.format("blocks").load(path), df)


def test_empty_table_keeps_its_schema(spark, table, tmp_path):
    df, path = table
    df.limit(0).write.format("blocks").mode("append").save(str(tmp_path / "none"))
    read = spark.read.format("blocks").load(str(tmp_path / "none"))
    assert read.dtypes == df.dtypes and read.count() == 0
    df.limit(0).write.format("blocks").mode("append").save(path)
    assert spark.read.format("blocks").load(path).count() == 1000
    df.limit(0).write.format("blocks").mode("overwrite").save(path)
    assert spark.read.format("blocks").load(path).count() == 0 and spark.read.format("blocks").load(path).dtypes == df.dtypes


def test_unequal_blocks_with_nulls_through_appends(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id long, reading long").coalesce(1)
    two = spark.createDataFrame([(4, None), (5, None)], "id long, reading long").coalesce(1)
    for x in (one, two):
        x.write.format("blocks").mode("append").save(path)
    rows = spark.read.format("blocks").option("block_column", "true").load(path).collect()
    assert [(r["_block"], r["id"], r["reading"]) for r in rows] == [(0, 1, 10), (0, 2, None), (0, 3, 30), (1, 4, None), (1, 5, None)]


def test_commits_that_read_the_same_manifest(spark, table, monkeypatch):
    """The later one sees that the other came between and adds to it."""
    from blocksmith.sources import datasource

    df, path = table
    sink = datasource.BlockSink(path, df.schema, 100, False)
    names = ["x.blk", "y.blk"]
    for name in names:
        with open(f"{path}/{name}", "wb") as f:
            BlockWriter(f, pa.schema([])).finish()
    real, calls = datasource.read_manifest, []

    def first_read_then_other_commit(store, root):
        found = real(store, root)
        calls.append(1)
        if len(calls) == 2:  # the check after our move: another commit replaced it
            found = {"files": [n for n in found["files"] if n != "x.blk"], "batches": {}}
        return found

    monkeypatch.setattr(datasource, "read_manifest", first_read_then_other_commit)
    sink.commit([datasource.Written("x.blk", 0)])
    monkeypatch.undo()
    sink.commit([datasource.Written("y.blk", 0)])
    assert {x.rsplit("/", 1)[-1] for x in datasource.list_files(path)} >= {"x.blk", "y.blk"}


def test_replayed_batches_are_added_once(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "t")
    for batch in (0, 0, 1, 0, 1):
        spark.range(10).write.format("blocks").mode("append").option("batch_query", "q").option("batch_id", batch).save(path)
    assert spark.read.format("blocks").load(path).count() == 20
    kept = {x.rsplit("/", 1)[-1] for x in list_files(path)}
    assert {x.name for x in (tmp_path / "t").iterdir() if x.suffix == ".blk"} == kept
    spark.range(10).write.format("blocks").mode("append").option("batch_query", "other").option("batch_id", 0).save(path)
    assert spark.read.format("blocks").load(path).count() == 30


def test_runs_of_blocks_are_partitions(spark, table):
    _, path = table
    assert spark.read.format("blocks").load(path).rdd.getNumPartitions() == 2
    assert spark.read.format("blocks").option("partition_bytes", "1").load(path).rdd.getNumPartitions() == 8
    assert spark.read.format("blocks").option("blocks", "0,2").load(path).rdd.getNumPartitions() == 2
