"""Mixing sources to target weights.

Words are summed for each source, targets come from the weights (never above ``most`` times what a source has), and the
repetition rate of a source is target / size.  Each document is then emitted floor(rate) times, and once more if a number
in [0, 1) drawn from a hash of its id and the seed lies below the fraction, so reruns agree on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspark.llm.common import materialise, small_keys, words_of

#: A source's target is at most this many times its size.
MOST = 3


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(_source, source_size) to target: shares by weight of all words, what exceeds a source's cap reshared by weight.

    Resharing until no target is above its cap ends at targets ``min(cap, level * weight)`` with one level for all; the
    sources are capped in the order of cap / weight, so a running sum over one row per source finds the level.
    """
    place = Window.orderBy(F.col("_source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(place) - 1) % len(cycle) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    # the first source, in order, whose cap is not reached at the level that is then left fixes the level
    fixed = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return (
        ranked.withColumn("_level", level)
        .withColumn("_fixed", fixed)
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_fixed") * F.col("_weight")), F.col("_cap")))
        .select("_source", "source_size", "target")
    )


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the key; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_rates(docs: DataFrame, seed: str = "mix:", cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, _source, size, source_size, target, copies.

    Null texts have no words; a null source is a source of its own, the last.  Sources without words have target 0 and
    their documents are taken 0 times.  Rows that repeat an id draw the same number.  An empty table gives no rows.
    """
    base = docs.select("doc_id", F.col("source").alias("_source"), words_of(F.col("text")).alias("size"))
    targets = source_targets(base.groupBy("_source").agg(F.sum("size").alias("source_size")), cycle, most).select(F.col("_source").alias("_target_source"), "source_size", "target")
    targets = small_keys(materialise(targets, "targets"))  # a row for each source: broadcast if they are few, so a hot source is not shuffled
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return (
        base.join(targets, F.col("_source").eqNullSafe(F.col("_target_source")))
        .withColumn("_rate", rate)
        .withColumn("copies", (F.floor("_rate") + (unit_draw(F.col("doc_id"), seed) < F.col("_rate") - F.floor("_rate")).cast("long")).cast("long"))
        .drop("_rate", "_target_source")
    )


def mix_documents(docs: DataFrame, seed: str = "mix:") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its source's rate and its own draw say, columns as they were.

    A document is joined to its source's rate (one row for each source) and repeated in place; its text is not shuffled
    unless there are too many sources to broadcast.  Null texts have no words and are taken like others of their source; a
    null source is one of its own; rows that repeat an id draw the same number; an empty table gives no rows.  Helper
    columns begin with ``_mix_``; other columns, whatever their names, come out as they were.
    """
    base = docs.withColumn("_mix_size", words_of(F.col("text")))
    targets = source_targets(base.groupBy(F.col("source").alias("_source")).agg(F.sum("_mix_size").alias("source_size"))).select(F.col("_source").alias("_mix_source"), F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0).alias("_mix_rate"))
    targets = small_keys(materialise(targets, "targets"))
    copies = F.floor("_mix_rate").cast("int") + (unit_draw(F.col("doc_id"), seed) < F.col("_mix_rate") - F.floor("_mix_rate")).cast("int")
    joined = docs.join(targets, docs["source"].eqNullSafe(F.col("_mix_source")))
    return joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
