"""Quality rules: base counts and robust multivariate outliers, in DataFrame operations only.

Each text gives a vector of logarithms. For every language and source a minimum
covariance determinant estimate is made by concentration steps from three
deterministic starts (scaled medians, correlations of tanh scores, spatial signs):
the vectors nearest to the current estimate, three quarters of the group, give the
next one; the start that ends with the least determinant counts. A text whose
Mahalanobis distance passes the cutoff is rejected.

A covariance is shrunk towards that of its language, and that towards the one of all
texts: with n vectors it is (n * own + PRIOR * wider) / (n + PRIOR), about the group's own
mean. So there is no least size of a group; a small one has the shape of its language.

Vectors are rounded to integers, so that all sums are exact and do not depend on the
order in which tasks end. A step is one pass that sums moments by group and distance
bin, and a running sum over the bins of a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Units of a rounded vector in one.
SCALE = 256
#: Deviations below which a component is not judged: words, word length, symbols, repeats, equal lines (in logarithms).
#: Each can pass the cutoff alone: in a group without any, 20 % of words in repeats do, and 29 % of equal lines.
FLOORS = (1.0, 0.15, 0.5, 0.6, 0.67)
DIMS = len(FLOORS)
#: Share of a group that an estimate rests on, steps from each start, vectors that the wider group's covariance counts as.
SHARE, STEPS, PRIOR = 0.75, 3, 50
#: Groups up to which estimates are broadcast.
MOST_BROADCAST = 20_000


def chi2_cdf(x: float, k: int) -> float:
    """Of a chi-square variable with ``k`` degrees of freedom, by the series of the lower incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > 1e-15 * total:
        term *= z / (a + n)
        total += term
        n += 1
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 1e-9, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


#: Makes the covariance of the nearest SHARE of normal vectors that of all.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, DIMS), DIMS + 2)
CUTOFF = chi2_quantile(0.9999, DIMS)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of its texts (null: none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    out = docs.withColumn("_w", words).withColumn("n_words", F.size("_w").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    out = out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    out = out.withColumn("n_symbols", symbols.cast("long"))
    out = out.withColumn("_l", lines).withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    windows = F.slice(F.transform("_w", lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))), 1, F.greatest(F.size("_w") - 2, F.lit(0)))
    out = out.withColumn("_h", F.when(F.size("_w") >= 3, windows))
    # The low bits of a hash give way to its position; sorted, equal hashes are neighbours.
    out = out.withColumn("_mask", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.expr("shiftleft(1L, length(bin(size(_h)))) - 1L")))
    out = out.withColumn("_s", F.sort_array(F.expr("transform(_h, (x, i) -> (x & ~_mask) | i)")))
    near = "((x & ~_mask) = (get(_s, j {0} 1) & ~_mask))"
    same = "(get(_h, int(x & _mask)) = get(_h, int(get(_s, j {0} 1) & _mask)))"
    out = out.withColumn("_clash", F.expr(f"exists(transform(_s, (x, j) -> {near.format('+')} and not {same.format('+')}), x -> x)"))
    fast = f"transform(_s, (x, j) -> case when {near.format('-')} and {same.format('-')} or {near.format('+')} and {same.format('+')} then int(x & _mask) else -1 end)"
    out = out.withColumn("_p", F.expr(f"case when _clash then null else sort_array(filter({fast}, x -> x >= 0)) end"))
    out = out.withColumn("_t", F.expr("case when _clash then sort_array(transform(_h, (x, i) -> struct(x as h, i as i))) end"))
    slow = "transform(_t, (x, j) -> case when x.h = get(_t, j - 1).h or x.h = get(_t, j + 1).h then x.i else -1 end)"
    out = out.withColumn("_p", F.expr(f"case when _clash then sort_array(filter({slow}, x -> x >= 0)) else _p end"))
    covered = F.expr("aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))), 0L, (a, x) -> a + x)")
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return out.drop("_w", "_l", "_h", "_mask", "_s", "_clash", "_p", "_t")


V = [f"v{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _vectors(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda part, whole: F.log1p(100 * F.col(part) / whole)
    parts = [F.log1p("n_words"), F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), share("n_symbols", words), share("n_repeat_words", words), share("n_dup_lines", F.greatest("n_lines", F.lit(1)))]
    return rows.withColumns({v: F.round(x * SCALE).cast("long") for v, x in zip(V, parts)})


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """By group, medians of integer columns: m0, m1, ...; sums of counts over the distinct values only."""
    long = rows.select("g", F.posexplode(F.array(*values)).alias("dim", "x")).groupBy("g", "dim", "x").agg(F.count("*").alias("c"))
    key = Window.partitionBy("g", "dim")
    run = long.withColumn("run", F.sum("c").over(key.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(key))
    found = run.where("2 * run >= n").groupBy("g", "dim").agg(F.min("x").alias("x"))
    return found.groupBy("g").agg(*[F.max(F.when(F.col("dim") == i, F.col("x"))).alias(f"m{i}") for i in range(len(values))])


def _moments(values: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(values)], *[F.sum(values[i] * values[j]).alias(f"q{i}{j}") for i, j in PAIRS]]


MEANS, COVARIANCES = [f"mu{i}" for i in range(DIMS)], [f"c{i}{j}" for i, j in PAIRS]


def _estimated(sums: DataFrame, unit: float, factor: float, floors: list[Column]) -> DataFrame:
    """From moments in ``unit``s: means mu and the floored covariance c, its other entries times ``factor``."""
    n = F.col("n").cast("double")
    out = sums.withColumns({f"mu{i}": F.col(f"s{i}") / n for i in range(DIMS)})
    cov = {f"c{i}{j}": (F.col(f"q{i}{j}") / n - F.col(f"mu{i}") * F.col(f"mu{j}")) * (factor / unit**2) + (floors[i] if i == j else F.lit(0.0)) for i, j in PAIRS}
    return out.withColumns(cov).withColumns({f"mu{i}": F.col(f"mu{i}") / unit for i in range(DIMS)})


def _whitened(out: DataFrame) -> DataFrame:
    """With the inverse w of the Cholesky factor of the covariance c, and its log determinant."""
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(DIMS):
        for i in range(j, DIMS):
            rest = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("det", 2 * sum((F.log(f"l{i}{i}") for i in range(DIMS)), F.lit(0.0)))


PARAMS = ["g", "start", *MEANS, *[f"w{i}{j}" for i, j in PAIRS], "det"]


def _distance() -> Column:
    """Squared Mahalanobis distance of V from mu under w."""
    x = [F.col(v) / SCALE - F.col(f"mu{i}") for i, v in enumerate(V)]
    return sum((F.pow(sum((F.col(f"w{i}{j}") * x[j] for j in range(i + 1)), F.lit(0.0)), 2) for i in range(DIMS)), F.lit(0.0))


def outlier_estimates(rows: DataFrame, work: Workspace) -> DataFrame:
    """Vectors, means and covariances by group: g, n, mu, c of ``rows`` (g, v0, ...)."""
    sizes = work.table("sizes", rows.groupBy("g").agg(F.count("*").alias("n")))
    hint = F.broadcast if sizes.count() <= MOST_BROADCAST else (lambda x: x)
    floors = [F.lit(x * x) for x in FLOORS]
    middle = work.table("middle", _medians(rows, [F.col(v) for v in V]))
    spread = work.table("spread", _medians(rows.join(hint(middle), "g"), [F.abs(F.col(v) - F.col(f"m{i}")) for i, v in enumerate(V)]).select("g", *[F.greatest(F.col(f"m{i}") * 1.4826, F.lit(FLOORS[i] * SCALE)).alias(f"d{i}") for i in range(DIMS)]))
    scaled = middle.join(hint(spread), "g")

    z = [(F.col(v) - F.col(f"m{i}")) / F.col(f"d{i}") for i, v in enumerate(V)]
    norm = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    scored = rows.join(hint(scaled), "g")
    unit = 1024
    starts = []
    for start, scores in ((1, [F.tanh(x) for x in z]), (2, [F.when(norm > 0, x / norm).otherwise(0.0) for x in z])):
        sums = scored.groupBy("g").agg(*_moments([F.round(x * unit).cast("long") for x in scores]))
        shape = _whitened(_estimated(sums, unit, 1.0, [F.lit(0.01)] * DIMS)).drop(*[f"mu{i}" for i in range(DIMS)]).join(hint(scaled), "g")
        starts.append(shape.withColumn("start", F.lit(start)).withColumns({f"w{i}{j}": F.col(f"w{i}{j}") * SCALE / F.col(f"d{j}") for i, j in PAIRS}))
    plain = scaled.withColumn("start", F.lit(0)).withColumn("det", F.lit(0.0)).withColumns({f"w{i}{j}": SCALE / F.col(f"d{i}") if i == j else F.lit(0.0) for i, j in PAIRS})
    params = [x.withColumns({f"mu{i}": F.col(f"m{i}") / SCALE for i in range(DIMS)}).select(PARAMS) for x in (plain, *starts)]
    params = work.table("start", params[0].unionByName(params[1]).unionByName(params[2]))
    for step in range(2 * STEPS):
        if step == STEPS:
            best = Window.partitionBy("g").orderBy("det", "start")
            params = work.table("best", params.withColumn("k", F.row_number().over(best)).where("k = 1").select(PARAMS))
        near = rows.join(hint(params), "g").withColumn("bin", F.floor(F.log1p(_distance()) * 64).cast("int"))
        bins = near.groupBy("g", "start", "bin").agg(*_moments([F.col(v) for v in V]))
        key = Window.partitionBy("g", "start")
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(key))
        sums = bins.where(F.col("before") < F.col("all") * SHARE).groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(DIMS)], *[f"q{i}{j}" for i, j in PAIRS])])
        params = work.table(f"step{step}", _whitened(_estimated(sums, SCALE, CONSISTENCY, floors)).select(*PARAMS, *COVARIANCES))
    return params.join(hint(sizes), "g").select("g", "n", *MEANS, *COVARIANCES)


def shrunk(estimates: DataFrame, wider: DataFrame, work: Workspace, levels: int) -> DataFrame:
    """PARAMS of the narrowest groups. ``wider`` (level, g, up): the group that each estimate leans on; levels from 0, the narrowest."""
    up = estimates.join(wider.where(F.col("level") == levels), "g", "left_semi")
    for level in range(levels - 1, -1, -1):
        own = estimates.join(wider.where(F.col("level") == level).select("g", "up"), "g")
        lean = up.select(F.col("g").alias("up"), *[F.col(x).alias(f"up_{x}") for x in COVARIANCES])
        blended = [((F.col("n") * F.col(x) + PRIOR * F.col(f"up_{x}")) / (F.col("n") + PRIOR)).alias(x) for x in COVARIANCES]
        up = own.join(lean, "up").select("g", "n", *MEANS, *blended)
        up = work.table(f"level{level}", up)
    return _whitened(up.withColumn("start", F.lit(0))).select(PARAMS)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Base rules reject texts of fewer than 50 words and texts with over half of their
    words in repeated three-word windows. The others are judged by squared
    Mahalanobis distance from the robust estimate of their group, the rows alike in all
    ``by`` columns; its covariance is shrunk towards that of the rows alike in one column
    less, at last towards that of all. Nulls in the ``by`` columns are a
    value like others; null texts have no words. Deviations below FLOORS are never
    held against a text. Ids are only carried; rows may repeat. An empty table gives
    no rows. Further columns are ignored.
    """
    work = Workspace(docs.sparkSession, "quality")
    keys = [F.concat(F.lit(f"{n} "), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in by[:n]]))) for n in range(len(by), 0, -1)]
    base = docs.select(F.col(id_col).alias("id"), F.array(*keys, F.lit("")).alias("keys"), F.col(text_col).alias("_text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = _vectors(text_counts(base, "_text").drop("_text")).withColumn("base_failed", failed).withColumn("own", F.col("keys")[0])
    counts = work.table("counts", counts)
    wider = counts.select("keys").distinct().select(F.posexplode("keys").alias("level", "g"), "keys")
    wider = work.table("wider", wider.select("level", "g", F.get("keys", F.col("level") + 1).alias("up")).distinct())
    hint = F.broadcast if wider.count() <= MOST_BROADCAST else (lambda x: x)
    estimates = outlier_estimates(counts.where("not base_failed").select(F.explode("keys").alias("g"), *V), work)
    params = work.table("params", shrunk(work.table("estimates", estimates), wider, work, len(by)))
    judged = counts.join(hint(params.withColumnRenamed("g", "own")), "own", "left").withColumn("distance", _distance())
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    return judged.select(F.col("id").alias(id_col), *columns, (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
