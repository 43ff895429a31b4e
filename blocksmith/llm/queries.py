"""One query for each operator over its whole table, with SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import benchmark_hits
from .idfiles import write_id_files
from .minhash import near_duplicates
from .packing import pack_documents
from .preferences import format_preferences
from .quality import quality_verdicts, text_counts
from .shards import balanced_shards
from .suffixes import remove_repeats
from .toxicity import fit_on_labels, held_out
from .wordpieces import token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k (chosen) and 2 k + 1 (rejected) make a pair."""
    turns = _read(spark, sf_dir, "conversations")
    return format_preferences(turns.select(F.expr("conv_id div 2").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"))


def op2_wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op3_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_id_files(_read(spark, sf_dir, "documents"), end=0).digests()


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_read(spark, sf_dir, "documents")).drop("distance")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5's base rules and vectors rest on."""
    counts = text_counts(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "n_lines")
    return counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(_read(spark, sf_dir, "documents"), shards=16)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = fit_on_labels(docs, _read(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), capacity=2048, end=1)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {
    "op1_preferences": op1_preferences,
    "op2_wordpieces": op2_wordpieces,
    "op3_idfiles": op3_idfiles,
    "op4_decontam": op4_decontam,
    "op5_quality": op5_quality,
    "quality_counts": quality_counts,
    "op6_shards": op6_shards,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_suffixes": op10_suffixes,
}
#: Words of whole texts, of more than white space, as they are and with A-Z lowered.
WORDS = r"""coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"""
LOWERED = WORDS.replace("(text,", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")

ORACLE: dict[str, str] = {
    "op7_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWERED} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op10_suffixes": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(1, n - 198)) AS p FROM d),
h AS (SELECT doc_id, p, md5(x[p:p + 199]) AS h FROM p JOIN d USING (doc_id)),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, p, lag(p) OVER w AS before, lead(p) OVER w AS after FROM h JOIN again USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, p AS start, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r WHERE before IS NULL OR p - before > 200),
stops AS (SELECT doc_id, p + 200 AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r WHERE after IS NULL OR after - p > 200),
span AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 1) AS since FROM runs JOIN stops USING (doc_id, k)),
piece AS (
  SELECT doc_id, since AS a, start - 1 AS b FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(stop), 1), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(CASE WHEN b >= a THEN x[a:b] ELSE ''::BLOB END), '' ORDER BY a))) AS kept_sha256 FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(sum(stop - start) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d LEFT JOIN s USING (doc_id) JOIN kept USING (doc_id)
""",
    "quality_counts": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
""",
    "op1_preferences": """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM conversations),
same AS (SELECT pair_id, i FROM t a JOIN t b USING (pair_id, i) WHERE a.chosen AND NOT b.chosen AND a.role = b.role AND a.text = b.text),
p AS (
  SELECT pair_id, count(*) FILTER (s) AS n_prefix FROM (
    SELECT pair_id, bool_and(s) OVER (PARTITION BY pair_id ORDER BY i) AS s
    FROM (SELECT DISTINCT t.pair_id, t.i, same.i IS NOT NULL AS s FROM t LEFT JOIN same ON t.pair_id = same.pair_id AND t.i = same.i))
  GROUP BY pair_id),
c AS (
  SELECT t.*, n_prefix, i <= n_prefix AS common, sum(length(shown)) OVER (PARTITION BY t.pair_id, chosen, i <= n_prefix ORDER BY i) - length(text) - 8 AS pos0
  FROM t JOIN p USING (pair_id))
SELECT pair_id, n_prefix,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (common AND chosen), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (NOT common AND chosen), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (NOT common AND NOT chosen), '') AS rejected,
  coalesce(string_agg(pos0 || ':' || (length(text) + 8), ',' ORDER BY i) FILTER (NOT common AND chosen AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(pos0 || ':' || (length(text) + 8), ',' ORDER BY i) FILTER (NOT common AND NOT chosen AND role = 'assistant'), '') AS rejected_mask
FROM c GROUP BY pair_id, n_prefix
""",
    "op6_shards": """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
b AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(text)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))), lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM b, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size) - size AS start, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(15, (2 * start + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""",
    "op4_decontam": r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT item_id, ws, least(8, len(ws)) AS n FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, ws[p:p + n - 1] AS win FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM g)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, n, p, ws[p:p + n - 1] AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes)),
h AS (SELECT d.doc_id, d.n, d.p, win.item_id FROM d JOIN win ON d.win = win.win),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
