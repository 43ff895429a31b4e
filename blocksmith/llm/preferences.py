"""Preference formatting of chosen and rejected conversations, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is rendered as head, role, middle, text, tail; the loss counts text and tail of the assistant's turns.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(TAIL)))


def _mask(turns: Column, assistant: str) -> Column:
    """``start:length`` of each assistant turn's text and tail in the rendered turns, comma-joined; in characters."""
    sizes = F.transform(turns, lambda t: F.length(t["role"]) + F.length(t["text"]) + len(HEAD + MIDDLE + TAIL))
    spans = F.transform(
        turns,
        lambda t, i: F.when(
            t["role"] == assistant,
            F.concat_ws(":", F.aggregate(F.slice(sizes, 1, i), F.lit(len(HEAD + MIDDLE)), lambda a, x: a + x) + F.length(t["role"]), F.length(t["text"]) + len(TAIL)),
        ),
    )
    return F.array_join(F.filter(spans, lambda x: x.isNotNull()), ",")


def format_preferences(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``turns`` has pair_id, chosen (boolean), turn, role, text. The longest common
    prefix of turns, equal in role and text, is rendered once as the prompt; what
    follows in either conversation is its completion. Masks list the spans of a
    completion that the loss counts. Turns are in ascending order of turn (nulls
    first), ties by role and text; rows that repeat a turn wholly count once. Null
    roles and texts are empty; rows with a null pair_id or side are left out. A pair
    with one side has an empty prompt and an empty completion on the other, and so
    have both sides of equal conversations. An empty table gives no rows. Further
    columns are ignored. A conversation is one value: its turns meet in one row.
    """
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.where("pair_id is not null and chosen is not null")
    pairs = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("chosen"), row))).alias("c"), F.array_sort(F.collect_set(F.when(~F.col("chosen"), row))).alias("r")
    )
    said = lambda side: F.transform(side, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = pairs.select("pair_id", said(F.col("c")).alias("c"), said(F.col("r")).alias("r"))
    first = F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False)
    pairs = pairs.withColumn("n_prefix", F.when(first == 0, F.size("c")).otherwise(first - 1).cast("long"))
    after = lambda side: F.slice(side, F.col("n_prefix").cast("int") + 1, F.greatest(F.size(side), F.lit(0)))
    pairs = pairs.withColumns({"p": F.slice("c", F.lit(1), F.col("n_prefix").cast("int")), "c": after("c"), "r": after("r")})
    text = lambda side: F.array_join(_rendered(F.col(side)), "")
    return pairs.select(
        "pair_id", "n_prefix", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), _mask(F.col("c"), assistant).alias("chosen_mask"), _mask(F.col("r"), assistant).alias("rejected_mask")
    )
