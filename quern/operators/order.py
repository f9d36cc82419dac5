"""Places in a total order, and exact quantiles, without a task that holds all rows of a group.

Rows are dealt to sorted ranges; each range numbers its own rows, and a small table of range counts gives what stands before them.
Equal keys are told apart by where a row comes from, so that one value, however common, is split as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ranking import small_side


def numbered(df: DataFrame, order: list[str], by: tuple[str, ...] = (), name: str = "i") -> DataFrame:
    """df with each row's place from 0 in the order (nulls first) within its group, and _n, the rows of the group. Groups may be null."""
    placed = kept(df.withColumn("_salt", F.monotonically_increasing_id()), "unordered")
    keys = [*by, *order, "_salt"]
    at = kept(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part"), *(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("_c"), F.min("_at").alias("_low"))
    group = Window.partitionBy(*(f"_{c}" for c in by))
    # as many rows as ranges and groups
    before = F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    shifts = counts.select("_part", *(f"_{c}" for c in by), (before - F.col("_low")).alias("_shift"), F.sum("_c").over(group).alias("_n"))
    same = part == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = at.join(small_side(kept(shifts, "range-counts"), 100_000), same)
    return met.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", *(f"_{c}" for c in by))


def exact_quantiles(df: DataFrame, value: str, ps: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., q array<double>): the quantiles of a column's values, interpolated as percentile() does; nulls are left out.

    One row a group; a group without a value has none, and without groups there is one row at most.
    """
    own = df.select(*by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    rows = numbered(own, ["v"], by)
    # the two places between which each quantile lies
    places = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("_n") - 1)).alias("at")) for k, p in enumerate(ps)))
    held = rows.select(*by, "v", "i", F.explode(F.filter(places, lambda x: (F.floor(x["at"]) == F.col("i")) | (F.ceil(x["at"]) == F.col("i")))).alias("x"))
    weight = F.when(F.floor("x.at") == F.ceil("x.at"), F.lit(1.0)).when(F.col("i") == F.floor("x.at"), F.ceil("x.at") - F.col("x.at")).otherwise(F.col("x.at") - F.floor("x.at"))
    each = held.groupBy(*by, F.col("x.k").alias("k")).agg(F.sum(F.col("v") * weight).alias("q"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q")).filter(F.size("q") == len(ps))
