"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

#: Rows of one key that a task of a join should have at most; keys with more are salted.
HOT = 50_000
#: Hot keys up to which they are broadcast; there is at most one for each HOT rows.
MOST_BROADCAST = 1_000_000


def _salted(many: DataFrame, one: DataFrame, key: str, spread: str, how: str) -> DataFrame:
    """``many`` joined with ``one`` (a row a key) on ``key``; the rows of a hot key are dealt by ``spread``, and its row in ``one`` is repeated for each deal."""
    hot = many.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > HOT).select(key, F.ceil(F.col("c") / HOT).cast("int").alias("salts"))
    found = hot.count()
    if not found:
        return many.join(one, key, how)
    hint = F.broadcast if found <= MOST_BROADCAST else (lambda x: x)
    salts = F.coalesce("salts", F.lit(1))
    left = many.join(hint(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("salts")
    right = one.join(hint(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b); label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then follows
    labels of labels, so a chain of n links needs about log n rounds. Rounds are
    written to the shared folder; only a count of changes reaches the driver. Neighbours
    of a hub and members of a large component are dealt over several tasks.
    Rows with a null end are ignored. No links: no rows.
    """
    both = work.table(
        f"{name}-both",
        links.where("a is not null and b is not null and a <> b")
        .select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .distinct(),
    )
    labels = work.table(
        f"{name}-0", both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed"))
    )
    step = 0
    while labels.where("changed").limit(1).count():
        step += 1
        near = _salted(both, labels.select(F.col("node").alias("v"), "label"), "v", "u", "inner").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        lowered = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        lowered = work.table(f"{name}-{step}a", lowered)
        root = lowered.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = _salted(lowered, root, "label", "node", "left").select("node", F.coalesce("up", "label").alias("label"), (F.coalesce("up", "label") < F.col("old")).alias("changed"))
        labels = work.table(f"{name}-{step}", jumped)
        work.drop(f"{name}-{step}a", f"{name}-{step - 1}")
    return labels.select("node", "label")
