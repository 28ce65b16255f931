"""Per-key results from value frequencies, so that a key with most of the rows is no large task.

Rows are first counted by (key, value), which combines before the shuffle and spreads the values
of one key over all tasks; what is wanted per key follows from the weighted values.

Defined cases: a null key is a group of its own in the profiles and percentiles, and no key of
``heavy_keys``; null values count as rows but not as values; ties of a mode go to the smallest
value; empty tables give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _named(keys: list[str]) -> tuple[list[str], list[Column]]:
    inner = [f"__k{k}" for k in range(len(keys))]
    return inner, [F.col(i).alias(k) for i, k in zip(inner, keys)]


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``__k0 ...`` (the keys), ``__v`` (the value) and ``__n``, the rows that have them."""
    inner, _ = _named(keys)
    rows = df.select(*[F.col(c).alias(i) for c, i in zip(keys, inner)], F.col(value).alias("__v"))
    return rows.groupBy(*inner, "__v").agg(F.count(F.lit(1)).alias("__n"))


def key_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: rows, non-null rows, exact distinct values, the mode and its rows.

    The second grouping again combines before its shuffle: of each task only one row per key.
    """
    inner, outer = _named(keys)
    some = F.col("__v").isNotNull()
    top = F.min(F.when(some, F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v"))))
    out = value_counts(df, keys, value).groupBy(*inner).agg(
        F.sum("__n").alias("n_rows"),
        F.coalesce(F.sum(F.when(some, F.col("__n"))), F.lit(0)).alias("n_values"),
        F.count(F.when(some, 1)).alias("n_distinct"),
        top.alias("__top"),
    )
    return out.select(*outer, "n_rows", "n_values", "n_distinct", F.col("__top.v").alias("mode"), (-F.col("__top.n")).alias("mode_rows"))


def heavy_keys(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``field_name, key_value``: the values that hold at least the given share of all rows.

    ``shares`` names the fields, usually two.  Their joint frequencies are counted once, and all
    fields' totals come from the weighted rows.  Nulls count as rows but are no value.
    """
    inner = [f"__k{k}" for k in range(len(shares))]
    weighted = df.select(*[F.col(c).alias(i) for c, i in zip(shares, inner)]).groupBy(*inner).agg(F.count(F.lit(1)).alias("__n"))
    fields = [
        F.struct(F.lit(f).alias("field_name"), F.col(i).cast("string").alias("key_value"), F.lit(float(share)).alias("__share"))
        for i, (f, share) in zip(inner, shares.items())
    ]
    sums = weighted.select(F.inline(F.array(*fields)), "__n").groupBy("field_name", "key_value", "__share").agg(F.sum("__n").alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))  # one row, of no column
    heavy = sums.where(F.col("key_value").isNotNull()).crossJoin(F.broadcast(total))
    return heavy.where("__n >= __share * __all * (1 - 1e-12D)").select("field_name", "key_value")


def weighted_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float], width: int = 4096) -> DataFrame:
    """Exact lower percentiles of whole-number values per key: the smallest value at which at
    least ``ceil(p * values)`` values are reached (the first value for p = 0).

    Values are ranked in two steps, blocks of ``width`` adjacent values and values in a block, so
    that no task sees all values of a key.  Output: ``keys, prob, value``.
    """
    inner, outer = _named(keys)
    counts = value_counts(df.where(F.col(value).isNotNull()), keys, value).withColumn("__b", F.floor(F.col("__v") / F.lit(width)))
    upto = Window.partitionBy(*inner).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*inner, "__b").agg(F.sum("__n").alias("__in"))
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__in").over(upto), F.lit(0))).withColumn("__of", F.sum("__in").over(Window.partitionBy(*inner)))
    wanted = blocks.withColumn("prob", F.explode(F.array(*map(F.lit, probs)))).withColumn("__rank", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("__of"))))
    wanted = wanted.where("__rank > __before and __rank <= __before + __in")
    wanted = wanted.select(*[F.col(i).alias(f"{i}_") for i in inner], F.col("__b").alias("__b_"), "prob", "__rank", "__before")
    same = reduce(Column.__and__, [F.col(i).eqNullSafe(F.col(f"{i}_")) for i in inner], F.col("__b") == F.col("__b_"))
    inside = Window.partitionBy(*inner, "prob").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hit = counts.join(wanted, same).withColumn("__cum", F.col("__before") + F.sum("__n").over(inside)).where("__cum >= __rank")
    return hit.groupBy(*inner, "prob").agg(F.min("__v").alias("value")).select(*outer, "prob", "value")
