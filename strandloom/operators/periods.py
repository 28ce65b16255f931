"""Continuous periods and gaps of the intervals of an entity, from independently sorted boundaries.

The starts and the ends of an entity are sorted independently.  Between the i-th and the next
start lies a gap exactly if the next-ranked start exceeds the i-th end; the start after a gap and
the end before the next one bound a continuous period.  Touching intervals have no gap.

An entity that holds many rows is cut into blocks of successive starts: each block does the above on
its own and blocks are linked by their outer boundaries only, one row per block.  Blocks come from a
range partitioning of the rows by (entity, start), whose bounds are quantiles of the starts, so a
dense locus is cut too.  Rows are counted by entity only within those of ``BUCKETS`` hash buckets
that could hold a large entity.

Defined cases: rows with a null in the entity, start or end, or with end <= start, don't count;
repeated rows change nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage

#: Bound of what is collected to plan the blocks.
BUCKETS = 16384
#: Up to so many large entities are broadcast to tell their rows apart.
ENTITIES = 20_000
ROWS_PER_BLOCK = 250_000

_SMALL = (T.IntegerType, T.ShortType, T.ByteType)


def _boundaries(grouped: DataFrame, keys: list[str], packed: bool) -> DataFrame:
    """Per group the starts and the ends, each sorted, and the ranks after which a gap lies."""
    if packed:
        start, end = (lambda x: F.shiftright(x, 32)), (lambda x: F.shiftright(F.shiftleft(x, 32), 32))
    else:
        start, end = (lambda x: x["__s"]), (lambda x: x["__t"])
    rows = grouped.select(
        *keys,
        F.sort_array(F.transform("__set", lambda x: start(x))).alias("__starts"),
        F.sort_array(F.transform("__set", lambda x: end(x))).alias("__ends"),
    )
    ranks = F.when(F.size("__starts") > 1, F.sequence(F.lit(1), F.size("__starts") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("__gaps", F.filter(ranks, lambda i: F.get("__starts", i) > F.get("__ends", i - 1)))


def _periods(keys: list[str]) -> list[Column]:
    return [
        *map(F.col, keys),
        F.arrays_zip(
            F.concat(F.slice("__starts", 1, 1), F.transform("__gaps", lambda i: F.get("__starts", i))).alias("f"),
            F.concat(F.transform("__gaps", lambda i: F.get("__ends", i - 1)), F.slice("__ends", -1, 1)).alias("t"),
        ).alias("__p"),
    ]


def _last(p: str) -> Column:
    return F.get(p, F.size(p) - 1)


def _event(kind: str, from_pos: Column, to_pos: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), from_pos.alias("from_pos"), to_pos.alias("to_pos"))


def _inner_events(p: str) -> Column:
    """Periods of the array ``p``, and the gaps between successive ones."""
    ranks = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(
        F.transform(p, lambda x: _event("period", x["f"], x["t"])),
        F.transform(ranks, lambda i: _event("gap", F.get(p, i - 1)["t"], F.get(p, i)["f"])),
    )


def periods_and_gaps(df: DataFrame, entity: list[str], start: str = "start", end: str = "end", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``entity``, ``kind`` ('period' or 'gap'), ``from_pos``, ``to_pos``, half-open."""
    packed = all(isinstance(df.schema[c].dataType, _SMALL) for c in (start, end))
    kind = "int" if packed else df.schema[start].dataType.simpleString()
    keys = [f"__e{k}" for k in range(len(entity))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__t"))
    for c in (*keys, "__s", "__t"):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where("__t > __s")
    if packed:  # one long holds both, with their signs
        rows = rows.withColumn("__x", F.shiftleft("__s", 32).bitwiseOR(F.col("__t").bitwiseAND(F.lit(0xFFFFFFFF))))
    else:
        rows = rows.withColumn("__x", F.struct("__s", "__t"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counted = rows.groupBy(bucket.alias("__h")).agg(F.count(F.lit(1)).alias("n"))
    full = [r["__h"] for r in counted.where(F.col("n") > rows_per_block).collect()]
    n_large = 0
    if full:
        near = rows.select(*keys) if len(full) > BUCKETS // 2 else rows.select(*keys).where(bucket.isin(full))
        large = cut_lineage(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_block))
        n_large, n_rows = large.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if not n_large:
        out = _whole(rows, keys, packed)
    else:
        names = large.select(*keys)
        names = F.broadcast(names) if n_large <= ENTITIES else names
        blocks = max(2, math.ceil(2 * n_rows / rows_per_block))
        cut = rows.join(names, keys, "left_semi").repartitionByRange(blocks, *keys, "__s").withColumn("__b", F.spark_partition_id())
        out = _whole(rows.join(names, keys, "left_anti"), keys, packed).unionByName(_blocked(cut, keys, packed))
    return out.select(*[F.col(k).alias(c) for c, k in zip(entity, keys)], "kind", F.col("from_pos").cast(kind), F.col("to_pos").cast(kind))


def _whole(rows: DataFrame, keys: list[str], packed: bool) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.collect_set("__x").alias("__set"))
    periods = _boundaries(grouped, keys, packed).select(*_periods(keys))
    return periods.select(*keys, F.inline(_inner_events("__p")))


def _blocked(cut: DataFrame, keys: list[str], packed: bool) -> DataFrame:
    at = [*keys, "__b"]
    # a block holds each distinct interval once, so copies of one interval are no load
    grouped = cut.groupBy(*at).agg(F.collect_set("__x").alias("__set"))
    local = _boundaries(grouped, at, packed).select(*_periods(at))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.select(*at, _last("__p")["t"].alias("__t")).select(*at, F.max("__t").over(before).alias("__reach"))
    linked = local.join(carry, at).select(
        *at,
        "__reach",
        F.filter("__p", lambda x: F.col("__reach").isNull() | (x["f"] > F.col("__reach"))).alias("__own"),
        F.array_max(F.transform(F.filter("__p", lambda x: x["f"] <= F.col("__reach")), lambda x: x["t"])).alias("__joined"),
    )
    inside = linked.select(*keys, F.inline(F.filter(_inner_events("__own"), lambda x: (x["kind"] == "gap") | (x["to_pos"] < _last("__own")["t"]))))
    # the last period of a block ends where the next block with periods of its own found the reach
    ends = linked.select(*at, F.get("__own", F.lit(0))["f"].alias("__first"), _last("__own")["f"].alias("__last"), F.greatest("__reach", "__joined").alias("__closed"), F.greatest("__reach", "__joined", _last("__own")["t"]).alias("__far"))
    whole = Window.partitionBy(*keys)
    outer = ends.withColumn("__all", F.max("__far").over(whole)).where(F.col("__first").isNotNull())
    w = whole.orderBy("__b")
    outer = outer.withColumn("__until", F.coalesce(F.lead("__closed").over(w), F.col("__all"))).withColumn("__next", F.lead("__first").over(w))
    edges = F.array(_event("period", F.col("__last"), F.col("__until")), F.when(F.col("__next").isNotNull(), _event("gap", F.col("__until"), F.col("__next"))))
    return inside.unionByName(outer.select(*keys, F.inline(F.filter(edges, lambda x: x.isNotNull()))))


def covered(df: DataFrame, entity: list[str], start: str = "start", end: str = "end", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per entity the number of periods and the positions that its intervals cover at least once."""
    periods = periods_and_gaps(df, entity, start, end, rows_per_block).where("kind = 'period'")
    return periods.groupBy(*entity).agg(F.count(F.lit(1)).alias("n_periods"), F.sum(F.col("to_pos").cast("bigint") - F.col("from_pos").cast("bigint")).alias("covered"))
