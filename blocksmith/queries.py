"""Registered queries over the test tables, with equivalent SQL."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bits import packed_length, required_bits, unzigzag, zigzag
from .functions.checksum import crc32c_column
from .operators import booleans, floats, integers, strings
from .operators.blocks import concat_blocks, fill_nulls, validity_profile, with_blocks
from .plans import profile, workloads
from .plans.measure import write_blocks
from .sources.container import validate
from .sources.datasource import block_index, register
from .sources.scratch import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_blocks(_read(spark, sf_dir, "orders"), "o_orderkey", 1000)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return with_blocks(_read(spark, sf_dir, "events"), "event_id", 1000).withColumn("us", micros)


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_blocks(_read(spark, sf_dir, "customer"), "c_custkey", 500)


#: Shared parts of the SQL: blocked tables, unsigned bit lengths, differences in 128 bits.
O = "o AS (SELECT *, o_orderkey AS pos, o_orderkey // 1000 AS block_id FROM orders)"  # noqa: E741
E = "e AS (SELECT *, event_id AS pos, event_id // 1000 AS block_id, epoch_us(ts) AS us FROM events)"
C = "c AS (SELECT *, c_custkey AS pos, c_custkey // 500 AS block_id FROM customer)"
BITS = lambda x: f"CASE WHEN ({x}) = 0 THEN 0 ELSE length(bin(CAST({x} AS UBIGINT))) END"
ZIG = lambda x: f"CASE WHEN ({x}) >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END"
FITS = lambda x: f"CASE WHEN ({x}) BETWEEN -9223372036854775808 AND 9223372036854775807 THEN {x} END"
LAG = lambda x: f"lag({x}) OVER (PARTITION BY block_id ORDER BY pos)"
PACKED = lambda n, w: f"CAST((({n}) * ({w}) + 7) // 8 AS BIGINT)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Bits


@_query(f"WITH {O} SELECT o_orderkey, CAST({ZIG('o_custkey - 700')} AS BIGINT) AS z FROM o")
def zigzag_values(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", zigzag(F.col("o_custkey") - 700).alias("z"))


@_query("SELECT o_orderkey, o_custkey - 700 AS v FROM orders")
def unzigzag_values(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", unzigzag(zigzag(F.col("o_custkey") - 700)).alias("v"))


@_query(f"SELECT c_custkey, CAST({BITS('c_custkey * c_custkey * 1000003')} AS INTEGER) AS bits FROM customer")
def required_bits_values(spark, sf_dir):
    return _customer(spark, sf_dir).select("c_custkey", required_bits(F.col("c_custkey") * F.col("c_custkey") * 1000003).alias("bits"))


@_query(f"SELECT c_custkey, {PACKED('c_custkey', 'c_custkey % 65')} AS bytes FROM customer")
def packed_length_values(spark, sf_dir):
    return _customer(spark, sf_dir).select("c_custkey", packed_length(F.col("c_custkey"), F.col("c_custkey") % 65).alias("bytes"))


# Integers


@_query(f"WITH {O}, w AS (SELECT block_id, pos, min(o_custkey) OVER (PARTITION BY block_id) AS minimum, max(o_custkey) OVER (PARTITION BY block_id) AS high, o_custkey FROM o) SELECT block_id, pos, minimum, o_custkey - minimum AS \"offset\", CAST({BITS('high - minimum')} AS INTEGER) AS width FROM w")
def for_encode(spark, sf_dir):
    return integers.for_encode(_orders(spark, sf_dir), "o_custkey")


@_query(f"WITH {O} SELECT block_id, pos, o_custkey AS v FROM o")
def for_decode(spark, sf_dir):
    return integers.for_decode(integers.for_encode(_orders(spark, sf_dir), "o_custkey"))


@_query(f"WITH {O}, d AS (SELECT block_id, pos, first(o_custkey) OVER (PARTITION BY block_id ORDER BY pos) AS \"first\", o_custkey - {LAG('o_custkey')} AS d FROM o) SELECT block_id, pos, \"first\", CASE WHEN d IS NOT NULL THEN CAST({ZIG('d')} AS BIGINT) END AS z, true AS fits FROM d")
def delta_encode(spark, sf_dir):
    return integers.delta_encode(_orders(spark, sf_dir), "o_custkey")


@_query(f"WITH {E} SELECT block_id, pos, us AS v FROM e")
def delta_decode(spark, sf_dir):
    return integers.delta_decode(integers.delta_encode(_events(spark, sf_dir), "us"))


@_query(
    f"WITH {E}, d AS (SELECT *, us - {LAG('us')} AS d, row_number() OVER (PARTITION BY block_id ORDER BY pos) AS r FROM e), dd AS (SELECT *, d - {LAG('d')} AS dd FROM d) "
    f"SELECT block_id, pos, first(us) OVER (PARTITION BY block_id ORDER BY pos) AS \"first\", max(CASE WHEN r = 2 THEN d END) OVER (PARTITION BY block_id) AS first_delta, CASE WHEN dd IS NOT NULL THEN CAST({ZIG('dd')} AS BIGINT) END AS z, true AS fits FROM dd"
)
def dod_encode(spark, sf_dir):
    return integers.dod_encode(_events(spark, sf_dir), "us")


@_query(f"WITH {E} SELECT block_id, pos, us AS v FROM e")
def dod_decode(spark, sf_dir):
    return integers.dod_decode(integers.dod_encode(_events(spark, sf_dir), "us"))


def _selector_sql(source: str, table: str, value: str) -> str:
    return f"""
WITH {source},
a AS (SELECT block_id, pos, CAST({value} AS HUGEINT) AS v, CAST({value} AS HUGEINT) - {LAG(f"CAST({value} AS HUGEINT)")} AS d0 FROM {table}),
b AS (SELECT *, {FITS('d0')} AS d, d0 IS NOT NULL AND {FITS('d0')} IS NULL AS bad FROM a),
bb AS (SELECT *, d - {LAG('d')} AS dd0 FROM b),
bbb AS (SELECT *, {FITS('dd0')} AS dd, dd0 IS NOT NULL AND {FITS('dd0')} IS NULL AS bad2 FROM bb),
g AS (SELECT block_id, count(*) AS n, max(v) - min(v) AS spread, max({ZIG('d')}) AS z, max({ZIG('dd')}) AS zz, bool_or(bad) AS bad, bool_or(bad OR bad2) AS bad2 FROM bbb GROUP BY block_id),
w AS (SELECT block_id, n, CAST({BITS('spread')} AS INTEGER) AS for_width, CASE WHEN NOT bad THEN CAST(coalesce({BITS('z')}, 0) AS INTEGER) END AS delta_width, CASE WHEN NOT bad2 THEN CAST(coalesce({BITS('zz')}, 0) AS INTEGER) END AS dod_width FROM g),
s AS (SELECT *, n * 8 AS raw_bytes, {PACKED('n', 'for_width')} AS for_bytes, {PACKED('n - 1', 'delta_width')} AS delta_bytes, {PACKED('greatest(n - 2, 0)', 'dod_width')} AS dod_bytes FROM w),
x AS (SELECT *, least(raw_bytes, for_bytes, delta_bytes, dod_bytes) AS payload_bytes FROM s)
SELECT block_id, n, for_width, delta_width, dod_width, raw_bytes, for_bytes, delta_bytes, dod_bytes,
  CASE payload_bytes WHEN raw_bytes THEN 'raw' WHEN for_bytes THEN 'for' WHEN delta_bytes THEN 'delta' ELSE 'dod' END AS encoding, payload_bytes,
  payload_bytes + CASE payload_bytes WHEN raw_bytes THEN 1 WHEN for_bytes THEN 10 WHEN delta_bytes THEN 10 ELSE 18 END AS chunk_bytes
FROM x"""


@_query(_selector_sql(O, "o", "o_custkey"))
def int_selector(spark, sf_dir):
    return integers.integer_profile(_orders(spark, sf_dir), "o_custkey")


@_query(_selector_sql(E, "e", "us"))
def timestamp_selector(spark, sf_dir):
    return integers.integer_profile(_events(spark, sf_dir), "us")


# Floats


@_query(f"""
WITH {C}, b AS (SELECT block_id, pos, CAST(CAST(c_acctbal AS DOUBLE) AS BIT) AS b FROM c),
x AS (SELECT block_id, CAST(xor(b, {LAG('b')}) AS VARCHAR) AS x FROM b)
SELECT block_id, count(*) AS n, CAST(coalesce(max(length(ltrim(x, '0'))), 0) AS INTEGER) AS width FROM x GROUP BY block_id""")
def xor_widths(spark, sf_dir):
    return floats.float_profile(_customer(spark, sf_dir), floats.double_bits("c_acctbal")).select("block_id", "n", "width")


def _float_sql(source: str, table: str, value: str) -> str:
    return f"""
WITH {source}, b AS (SELECT block_id, pos, CAST(CAST({value} AS DOUBLE) AS BIT) AS b FROM {table}),
x AS (SELECT block_id, CAST(xor(b, {LAG('b')}) AS VARCHAR) AS x FROM b),
w AS (SELECT block_id, count(*) AS n, CAST(coalesce(max(length(ltrim(x, '0'))), 0) AS INTEGER) AS width FROM x GROUP BY block_id),
s AS (SELECT *, n * 8 AS raw_bytes, {PACKED('n - 1', 'width')} AS xor_bytes FROM w)
SELECT *, CASE WHEN xor_bytes + 9 < raw_bytes THEN 'xor' ELSE 'raw' END AS encoding, 1 + CASE WHEN xor_bytes + 9 < raw_bytes THEN xor_bytes + 9 ELSE raw_bytes END AS chunk_bytes FROM s"""


@_query(_float_sql(O, "o", "o_totalprice"))
def float_selector(spark, sf_dir):
    return floats.float_profile(_orders(spark, sf_dir), floats.double_bits("o_totalprice"))


@_query(f"WITH {C} SELECT block_id, pos, CAST(c_acctbal AS DOUBLE) AS v FROM c")
def xor_decode(spark, sf_dir):
    decoded = floats.xor_decode(floats.xor_encode(_customer(spark, sf_dir), floats.double_bits("c_acctbal")))
    return decoded.select("block_id", "pos", floats.bits_double("b").alias("v"))


# Booleans

CLICK = "event_type = 'click'"
RUNS_SQL = f"""
r0 AS (SELECT block_id, pos, {CLICK} AS b FROM e), r1 AS (SELECT *, CAST(coalesce(b <> {LAG('b')}, false) AS BIGINT) AS turn FROM r0),
r2 AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY block_id ORDER BY pos) AS BIGINT) AS run FROM r1),
runs AS (SELECT block_id, run, first(b) AS "value", min(pos) AS start, count(*) AS "length" FROM r2 GROUP BY block_id, run)"""


def _clicks(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).withColumn("b", F.expr(CLICK))


@_query(f"WITH {E} SELECT block_id, count(*) AS n, count(*) FILTER ({CLICK}) AS n_true, (count(*) + 7) // 8 AS bytes FROM e GROUP BY block_id")
def bool_bitmap(spark, sf_dir):
    return booleans.bitmap_profile(_clicks(spark, sf_dir), "b")


@_query(f'WITH {E}, {RUNS_SQL} SELECT block_id, run, "value", start, "length" FROM runs')
def rle_runs(spark, sf_dir):
    return booleans.rle_runs(_clicks(spark, sf_dir), "b")


@_query(f'WITH {E} SELECT block_id, pos, {CLICK} AS "value" FROM e')
def rle_expand(spark, sf_dir):
    return booleans.rle_expand(booleans.rle_runs(_clicks(spark, sf_dir), "b"))


BCA_SQL = f"""
bit AS (SELECT block_id, string_agg(CASE WHEN {CLICK} THEN '1' ELSE '0' END, '' ORDER BY pos) AS s FROM e GROUP BY block_id),
walk AS (
  SELECT block_id, s, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS byte, CAST(0 AS BIGINT) AS k FROM bit
  UNION ALL
  SELECT block_id, s, CAST(i + CASE WHEN reps >= 3 THEN 3 * reps ELSE least(7, length(s) - i + 1) END AS BIGINT),
    CAST(CASE WHEN reps >= 3 THEN 128 + 16 * (ascii(s[i]) - 48) + 32 * (ascii(s[i + 1]) - 48) + 64 * (ascii(s[i + 2]) - 48) + reps - 1
      ELSE list_sum(list_transform(range(least(7, length(s) - i + 1)), lambda j: (ascii(s[i + j]) - 48) << j)) END AS BIGINT), k + 1
  FROM (SELECT *, coalesce(list_max(list_filter(range(1, least(16, (length(s) - i + 1) // 3) + 1), lambda m: substr(s, i, 3 * m) = repeat(substr(s, i, 3), m))), 0) AS reps FROM walk WHERE i <= length(s)))"""


@_query(f"WITH RECURSIVE {E}, {BCA_SQL} SELECT block_id, CAST(any_value(length(s)) AS BIGINT) AS n, string_agg(printf('%02X', byte), '' ORDER BY k) AS blocks FROM walk WHERE k > 0 GROUP BY block_id")
def bca_encode(spark, sf_dir):
    return booleans.bca_encode(_clicks(spark, sf_dir), "b").select("block_id", "n", F.hex("blocks").alias("blocks"))


@_query(f'WITH {E} SELECT block_id, pos % 1000 AS "row", {CLICK} AS "value" FROM e')
def bca_decode(spark, sf_dir):
    return booleans.bca_decode(booleans.bca_encode(_clicks(spark, sf_dir), "b"))


@_query(f"""
WITH RECURSIVE {E}, {RUNS_SQL}, {BCA_SQL},
s AS (SELECT * FROM (SELECT block_id, count(*) AS n, (count(*) + 7) // 8 AS bitmap_bytes FROM e GROUP BY block_id) JOIN (SELECT block_id, 1 + 4 * count(*) AS rle_bytes FROM runs GROUP BY block_id) USING (block_id)
  JOIN (SELECT block_id, count(*) AS bca_bytes FROM walk WHERE k > 0 GROUP BY block_id) USING (block_id))
SELECT *, CASE least(bitmap_bytes, rle_bytes, bca_bytes) WHEN bitmap_bytes THEN 'bitmap' WHEN rle_bytes THEN 'rle' ELSE 'bca' END AS encoding, 1 + least(bitmap_bytes, rle_bytes, bca_bytes) AS chunk_bytes FROM s""")
def bool_selector(spark, sf_dir):
    return booleans.boolean_profile(_clicks(spark, sf_dir), "b")


# Strings

DICT_SQL = "first AS (SELECT block_id, o_orderpriority AS s, min(pos) AS f, count(*) AS \"rows\" FROM o GROUP BY ALL), d AS (SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY f) - 1 AS code, s, \"rows\" FROM first)"


def _string_sql(source: str, table: str, value: str) -> str:
    return f"""
WITH {source}, g AS (SELECT block_id, {value} AS s, count(*) AS c FROM {table} GROUP BY ALL),
a AS (SELECT block_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS entries, CAST(sum(strlen(s) * c) AS BIGINT) AS t, CAST(sum(8 + strlen(s)) AS BIGINT) AS w FROM g GROUP BY block_id),
b AS (SELECT block_id, n, entries, 4 * (n + 1) + t AS raw_bytes, 5 + w + n * CASE WHEN entries <= 256 THEN 1 WHEN entries <= 65536 THEN 2 ELSE 4 END AS dict_bytes FROM a)
SELECT *, CASE WHEN dict_bytes < raw_bytes THEN 'dictionary' ELSE 'raw' END AS encoding, 1 + least(raw_bytes, dict_bytes) AS chunk_bytes FROM b"""


@_query(f"WITH {C} SELECT block_id, 4 * (count(*) + 1) + CAST(sum(strlen(c_name)) AS BIGINT) AS raw_bytes FROM c GROUP BY block_id")
def str_raw_size(spark, sf_dir):
    return strings.string_profile(_customer(spark, sf_dir), "c_name").select("block_id", "raw_bytes")


@_query(f"WITH {O}, {DICT_SQL} SELECT o.block_id, pos, CAST(code AS INTEGER) AS code FROM o JOIN d ON o.block_id = d.block_id AND o_orderpriority = s")
def dict_encode(spark, sf_dir):
    return strings.dict_encode(_orders(spark, sf_dir), "o_orderpriority")


@_query(f"WITH {O}, {DICT_SQL} SELECT block_id, CAST(code AS INTEGER) AS code, s, \"rows\" FROM d")
def dict_entries(spark, sf_dir):
    return strings.dictionary(_orders(spark, sf_dir), "o_orderpriority")


@_query(f"WITH {O} SELECT block_id, pos, o_orderpriority AS s FROM o")
def dict_decode(spark, sf_dir):
    df = _orders(spark, sf_dir)
    return strings.dict_decode(strings.dict_encode(df, "o_orderpriority"), strings.dictionary(df, "o_orderpriority"))


@_query(_string_sql(E, "e", "event_type"))
def str_selector(spark, sf_dir):
    return strings.string_profile(_events(spark, sf_dir), "event_type")


# Nulls


@_query(f"WITH {E}, v AS (SELECT *, nullif(user_id, user_id // 3 * 3) AS v FROM e) SELECT block_id, pos, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY pos), 0) AS v FROM v")
def null_fill(spark, sf_dir):
    return _events(spark, sf_dir).select("block_id", "pos", fill_nulls(F.expr("nullif(user_id, user_id div 3 * 3)"), 0).alias("v"))


@_query(f"WITH {E}, v AS (SELECT block_id, nullif(user_id, user_id // 3 * 3) AS v FROM e WHERE block_id > 0 UNION ALL SELECT block_id, NULL FROM e WHERE block_id = 0), g AS (SELECT block_id, count(*) AS n, count(v) AS n_valid FROM v GROUP BY block_id) SELECT *, CASE n_valid WHEN n THEN 0 WHEN 0 THEN 1 ELSE 2 END AS mode, CASE WHEN n_valid IN (0, n) THEN 1 ELSE 1 + (n + 7) // 8 END AS bytes FROM g")
def validity_sections(spark, sf_dir):
    v = F.when(F.col("block_id") > 0, F.expr("nullif(user_id, user_id div 3 * 3)"))
    return validity_profile(_events(spark, sf_dir).withColumn("v", v), "v")


# Tables


@_query("SELECT column_name, CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 1 WHEN data_type IN ('FLOAT', 'DOUBLE') THEN 2 WHEN data_type = 'BOOLEAN' THEN 3 WHEN data_type = 'VARCHAR' THEN 4 ELSE 255 END AS codec FROM information_schema.columns WHERE table_name = 'lineitem'")
def codec_choice(spark, sf_dir):
    return profile.codec_choice(_read(spark, sf_dir, "lineitem"))


def _int_part(source: str, table: str, column: str) -> str:
    return f"SELECT '{column}' AS column_name, block_id, n, encoding, chunk_bytes + 1 AS chunk_bytes FROM ({_selector_sql(source, table, column)})"


def _string_part(source: str, table: str, column: str) -> str:
    return f"SELECT '{column}' AS column_name, block_id, n, encoding, chunk_bytes + 1 AS chunk_bytes FROM ({_string_sql(source, table, column)})"


def _float_part(source: str, table: str, column: str) -> str:
    return f"SELECT '{column}' AS column_name, block_id, n, encoding, chunk_bytes + 1 AS chunk_bytes FROM ({_float_sql(source, table, column)})"


@_query(" UNION ALL ".join([*(_int_part(O, "o", c) for c in ("o_orderkey", "o_custkey")), _float_part(O, "o", "o_totalprice"), *(_string_part(O, "o", c) for c in ("o_orderstatus", "o_orderpriority"))]))
def table_profile(spark, sf_dir):
    return profile.table_profile(_orders(spark, sf_dir))


# The data source


def _stored(spark, sf_dir, table: str, key: str, block_rows: int) -> str:
    """``table`` in key order as a block directory."""
    register(spark)
    path = scratch(spark, table)
    _read(spark, sf_dir, table).repartitionByRange(3, key).sortWithinPartitions(key).write.format("blocks").mode("append").option("block_rows", block_rows).save(path)
    return path


@_query("SELECT * FROM orders")
def full_scan(spark, sf_dir):
    return spark.read.format("blocks").load(_stored(spark, sf_dir, "orders", "o_orderkey", 1000))


@_query("SELECT c_custkey, c_name FROM customer")
def column_scan(spark, sf_dir):
    return spark.read.format("blocks").option("columns", "c_custkey,c_name").load(_stored(spark, sf_dir, "customer", "c_custkey", 500))


def block_scan(spark, sf_dir):
    """Block 1 of a file in key order."""
    register(spark)
    path = scratch(spark, "one")
    _read(spark, sf_dir, "part").orderBy("p_partkey").coalesce(1).write.format("blocks").mode("append").option("block_rows", 100).save(path)
    return spark.read.format("blocks").option("blocks", "1").load(path)


_query("SELECT * FROM part WHERE p_partkey BETWEEN 100 AND 199")(block_scan)


@_query("SELECT column_name, codec, CAST((SELECT count(*) FROM customer) AS BIGINT) AS \"rows\" FROM (VALUES ('c_custkey', 1), ('c_name', 4), ('c_nationkey', 1), ('c_acctbal', 2), ('c_mktsegment', 4)) t(column_name, codec)")
def block_index_rows(spark, sf_dir):
    found = block_index(spark, _stored(spark, sf_dir, "customer", "c_custkey", 500))
    return found.groupBy("column_name", "codec").agg(F.sum("rows").alias("rows"))


@_query("SELECT (count(*) + 99) // 100 AS n_blocks, count(*) AS n_rows FROM part")
def block_count(spark, sf_dir):
    register(spark)
    path = scratch(spark, "count")
    _read(spark, sf_dir, "part").orderBy("p_partkey").coalesce(1).write.format("blocks").mode("append").option("block_rows", 100).save(path)
    blocks = block_index(spark, path).select("file", "block", "rows").distinct()
    return blocks.agg(F.count("*").alias("n_blocks"), F.sum("rows").alias("n_rows"))


#: What is done to a file of the regions, and the error that validation then names.
DAMAGE = {
    "none": (lambda x: x, None),
    "cut to 20 bytes": (lambda x: x[:20], "UnexpectedEnd"),
    "another header": (lambda x: b"X" + x[1:], "InvalidMagic"),
    "another trailer": (lambda x: x[:-1] + b"X", "InvalidMagic"),
    "footer longer than the file": (lambda x: x[:-16] + b"\xff" * 7 + b"\x7f" + x[-8:], "InvalidMetadata"),
    "another checksum": (lambda x: x[:-8] + bytes([x[-8] ^ 1]) + x[-7:], "ChecksumMismatch"),
    "a byte of the footer": (lambda x: x[:-20] + bytes([x[-20] ^ 1]) + x[-19:], "ChecksumMismatch"),
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {repr(v[1]) if v[1] else 'CAST(NULL AS VARCHAR)'})" for k, v in DAMAGE.items()) + ") t(damage, error)")
def damaged_files(spark, sf_dir):
    table = _read(spark, sf_dir, "region").toArrow()
    sound = write_blocks(table.combine_chunks().to_batches())
    found = [(k, (validate(io.BytesIO(change(sound)), chunks=True) or "").split(":")[0] or None) for k, (change, _) in DAMAGE.items()]
    return spark.createDataFrame(found, "damage string, error string")


@_query(f"WITH {C} SELECT block_id + CASE WHEN twice THEN (SELECT max(block_id) + 1 FROM c) ELSE 0 END AS block_id, pos, c_name FROM c, (VALUES (false), (true)) t(twice)")
def concat_two(spark, sf_dir):
    df = _customer(spark, sf_dir).select("block_id", "pos", "c_name")
    return concat_blocks(df, df)


def _roundtrip(table: str, key: str):
    def run(spark, sf_dir):
        return spark.read.format("blocks").load(_stored(spark, sf_dir, table, key, 700))

    run.__name__ = f"roundtrip_{table}"
    return run


for _table, _key in (("events", "event_id"), ("documents", "doc_id"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("embeddings", "vec_id"), ("lineitem", "l_orderkey")):
    _query(f"SELECT * FROM {_table}")(_roundtrip(_table, _key))


@_query("SELECT * FROM events")
def parquet_roundtrip(spark, sf_dir):
    path = scratch(spark, "parquet")
    _read(spark, sf_dir, "events").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@_query("""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END)) AS tab),
b AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)
SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(text)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))), lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) AS crc
FROM b, tab""")
def crc32c(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", crc32c_column("text").alias("crc"))


# Workloads

#: Two blocks of the size that the reference workloads have by default.
ROWS, BLOCK = 200_000, 100_000
H1 = lambda v: f"(CAST(xor(CAST({v} AS UBIGINT), CAST({v} AS UBIGINT) >> 30) AS UHUGEINT) * {workloads.MIX_ONE}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
H2 = lambda v: f"(CAST(xor({v}, {v} >> 27) AS UHUGEINT) * {workloads.MIX_TWO}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _hashes(inputs: dict[str, str]) -> str:
    """CTEs r, m1, m2, h: h has pos, block_id and the mix of each input as UBIGINT."""
    cols = list(inputs)
    return (
        f"r AS (SELECT range AS pos, range // {BLOCK} AS block_id FROM range({ROWS})), m1 AS (SELECT pos, block_id, {', '.join(f'{H1(x)} AS {c}' for c, x in inputs.items())} FROM r), "
        f"m2 AS (SELECT pos, block_id, {', '.join(f'{H2(c)} AS {c}' for c in cols)} FROM m1), h AS (SELECT pos, block_id, {', '.join(f'xor({c}, {c} >> 31) AS {c}' for c in cols)} FROM m2)"
    )


TELEMETRY = f"""{_hashes({'h0': 'pos', 'h1': '(pos + 1)', 'h2': '(pos + 2)'})}, telemetry AS (
SELECT block_id, pos, {workloads.START_MS} + pos * 1000 AS "time", CAST(h0 % 20000 AS BIGINT) AS customer, CAST(h1 % 800 AS BIGINT) AS product, CAST(h0 % 20000 % 32 AS BIGINT) AS country,
  CAST(1 + h2 % 5 AS BIGINT) AS quantity, CAST(199 + 17 * (h1 % 800) AS BIGINT) AS price FROM h)"""
SIGNED = lambda c: f"CAST(CASE WHEN {c} >= 9223372036854775808 THEN CAST({c} AS HUGEINT) - 18446744073709551616 ELSE CAST({c} AS HUGEINT) END AS BIGINT) AS {c}"
RANDOM = f"{_hashes({c: f'xor(pos, {i})' for i, c in enumerate('abcdef', 1)})}, random AS (SELECT block_id, pos, {', '.join(map(SIGNED, 'abcdef'))} FROM h)"
MIXED = f"""{_hashes({'h0': 'pos'})}, mixed AS (
SELECT block_id, pos, {workloads.START_MS} + pos * 1000 AS "time", pos % 20000 AS customer, CAST(h0 % 100000 AS DOUBLE) / 100 AS amount, ['IL', 'US', 'DE', 'JP', 'BR'][pos % 5 + 1] AS country, pos % 11 <> 0 AS success FROM h)"""


@_query(f"WITH {TELEMETRY} SELECT * FROM telemetry")
def workload_telemetry(spark, sf_dir):
    return workloads.telemetry(spark, ROWS, BLOCK)


@_query(f"WITH {RANDOM} SELECT * FROM random")
def workload_random(spark, sf_dir):
    return workloads.random_i64(spark, ROWS, BLOCK)


@_query(f"WITH {MIXED} SELECT * FROM mixed")
def workload_mixed(spark, sf_dir):
    return workloads.mixed(spark, ROWS, BLOCK)


def _bool_part(source: str, table: str, column: str) -> str:
    """The walk over a block's bit patterns as a jump from each position to the next; 18 rounds of doubling count the jumps."""
    jumps = ", ".join(
        f"j{k} AS MATERIALIZED (SELECT a.block_id, a.p, b.nx, a.c + b.c AS c FROM j{k - 1} a JOIN j{k - 1} b ON a.block_id = b.block_id AND a.nx = b.p)" for k in range(1, 19)
    )
    return f"""
WITH {source}, x AS (SELECT block_id, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY block_id) AS n, {column} AS b, lead({column}, 3) OVER w AS third, lag({column}) OVER w AS before FROM {table} WINDOW w AS (PARTITION BY block_id ORDER BY pos)),
y AS (SELECT *, coalesce(min(CASE WHEN third IS NULL OR b <> third THEN p END) OVER (PARTITION BY block_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p) - p AS same FROM x),
wk AS (SELECT *, CASE WHEN p + 3 <= n THEN least(16, 1 + same // 3) ELSE 0 END AS reps FROM y),
j0 AS MATERIALIZED (SELECT block_id, p, least(n, p + CASE WHEN reps >= 3 THEN 3 * reps ELSE 7 END) AS nx, CAST(1 AS BIGINT) AS c FROM wk UNION ALL SELECT DISTINCT block_id, n, n, CAST(0 AS BIGINT) FROM wk), {jumps},
g AS (SELECT block_id, any_value(n) AS n, (any_value(n) + 7) // 8 AS bitmap, CAST(5 + 4 * count(*) FILTER (b <> before) AS BIGINT) AS rle FROM x GROUP BY block_id),
s AS (SELECT g.*, c AS bca FROM g JOIN j18 ON g.block_id = j18.block_id AND p = 0)
SELECT '{column}' AS column_name, block_id, n, CASE least(bitmap, rle, bca) WHEN bitmap THEN 'bitmap' WHEN rle THEN 'rle' ELSE 'bca' END AS encoding, 2 + least(bitmap, rle, bca) AS chunk_bytes FROM s"""


def _workload_sql() -> str:
    parts = [("telemetry", "telemetry", TELEMETRY, "time customer product country quantity price".split()), ("random-i64", "random", RANDOM, list("abcdef")), ("mixed-arrow", "mixed", MIXED, ["time", "customer"])]
    out = [f"SELECT '{name}' AS workload, * FROM ({_int_part(source, table, c)})" for name, table, source, columns in parts for c in columns]
    out += [f"SELECT 'mixed-arrow' AS workload, * FROM ({part})" for part in (_float_part(MIXED, "mixed", "amount"), _string_part(MIXED, "mixed", "country"), _bool_part(MIXED, "mixed", "success"))]
    return " UNION ALL ".join(out)


@_query(_workload_sql())
def workload_profile(spark, sf_dir):
    """Sizes of all three workloads, by column and block."""
    parts = [profile.table_profile(make(spark, ROWS, BLOCK)).withColumn("workload", F.lit(name)) for name, make in workloads.WORKLOADS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
