"""Statistics of sparse matrices in which every element counts, stored or not.

All sums go over stored entries; zeros enter by closed forms.  Rows or columns without stored
entries have a result too.  Quantiles and ranks sort the stored values of a row or column only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matrix import SparseMatrix
from .ranges import checked_broadcast


def _axis(m: SparseMatrix, axis: str) -> tuple[DataFrame, int, DataFrame | None, DataFrame | None]:
    """All indexes of the axis, the length of the other, own and other shift."""
    if axis == "row":
        return m.rows(), m.ncol, m.row_shift, m.col_shift
    return m.cols(), m.nrow, m.col_shift, m.row_shift


def axis_stats(m: SparseMatrix, axis: str) -> DataFrame:
    """``axis, nonzero, total, mean, variance`` (sample variance); shifts are counted in."""
    every, n, own, other = _axis(m, axis)
    if other is not None:
        return _shifted_stats(m, axis)
    v = F.col("val")
    agg = m.entries.groupBy(axis).agg(F.count(F.lit(1)).alias("k"), F.sum(v).alias("s"), F.avg(v).alias("m"), F.var_pop(v).alias("vp"))
    out = every.join(agg, axis, "left").select(axis, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k", "s", "m", "vp")])
    add: Column = F.lit(m.shift)
    if own is not None:
        out = out.join(own.select(F.col("idx").alias(axis), F.col("v").alias("__a")), axis, "left")
        add = add + F.coalesce("__a", F.lit(0.0))
    k = F.col("k")
    variance = (F.col("vp") * k + F.col("m") * F.col("m") * k * (n - k) / n) / (n - 1) if n > 1 else F.lit(None).cast("double")
    return out.select(axis, k.alias("nonzero"), (F.col("s") + n * add).alias("total"), (F.col("s") / n + add).alias("mean"), variance.alias("variance"))


def _shifted_stats(m: SparseMatrix, axis: str) -> DataFrame:
    """With a shift along the axis: sums of x, x^2 and x times the shift give all that is needed."""
    every, n, own, other = _axis(m, axis)
    across = "col" if axis == "row" else "row"
    c = other.select(F.col("idx").alias(across), F.col("v").alias("c"))
    e = m.entries.join(checked_broadcast(c), across, "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    agg = e.groupBy(axis).agg(F.count(F.lit(1)).alias("k"), F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("ss"), F.sum(F.col("val") * F.col("c")).alias("sc"))
    whole = c.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("c1"), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("c2"))  # one row
    out = every.join(agg, axis, "left").select(axis, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("k", "s", "ss", "sc")]).crossJoin(F.broadcast(whole))
    add: Column = F.lit(m.shift)
    if own is not None:
        out = out.join(own.select(F.col("idx").alias(axis), F.col("v").alias("__a")), axis, "left")
        add = add + F.coalesce("__a", F.lit(0.0))
    s, ss = F.col("s") + F.col("c1"), F.col("ss") + 2 * F.col("sc") + F.col("c2")
    return out.select(axis, F.col("k").alias("nonzero"), (s + n * add).alias("total"), (s / n + add).alias("mean"), ((ss - s * s / n) / (n - 1)).alias("variance"))


def axis_max(m: SparseMatrix, axis: str) -> DataFrame:
    """``axis, max``; an element that isn't stored is 0."""
    every, n, _, _ = _axis(m, axis)
    m._plain("a maximum")
    agg = m.entries.groupBy(axis).agg(F.count(F.lit(1)).alias("k"), F.max("val").alias("x"))
    value = F.when(F.col("k") == n, F.col("x")).otherwise(F.greatest(F.coalesce("x", F.lit(0.0)), F.lit(0.0)))
    return every.join(agg, axis, "left").select(axis, value.alias("max"))


def _value_ranks(m: SparseMatrix, axis: str) -> DataFrame:
    """``axis, val, n, upto, k``: rows with the value, up to it and in all.  Equal values are counted
    before any sorting, so a row with most of the entries is no large task unless all differ."""
    counts = m.entries.groupBy(axis, "val").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(axis)
    return counts.select("*", F.sum("n").over(w.orderBy("val").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("k"))


_QUANTILE_FORMS = {4: (0.0, 1.0), 5: (0.5, 0.5), 6: (0.0, 0.0), 7: (1.0, 1.0), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}


def axis_quantiles(m: SparseMatrix, axis: str, probs: list[float], form: int = 7) -> DataFrame:
    """``axis, prob, quantile`` of the continuous forms 4 to 9, zeros included.

    A stored value's ranks are those among the stored ones, plus the zeros if it is positive; the
    two order statistics are picked from the counted values, and are 0 at ranks of zeros."""
    if form not in _QUANTILE_FORMS:
        raise ValueError("forms 4 to 9 are possible")
    m._plain("a quantile")
    every, n, _, _ = _axis(m, axis)
    alpha, beta = _QUANTILE_FORMS[form]
    if form == 4:
        alpha, beta = 0.0, 1.0
    stored = _value_ranks(m, axis)
    stored = stored.withColumn("last", F.col("upto") + F.when(F.col("val") > 0, n - F.col("k")).otherwise(0)).withColumn("r", F.col("last") - F.col("n") + 1)
    spots = []
    for p in probs:
        at = p * n + alpha + p * (1 - alpha - beta)
        low = int(max(min(n - 1, at + 4 * 2.220446049250313e-16), 1)) if n > 1 else 1
        spots.append((p, low, min(max(at - low, 0.0), 1.0)))
    ask = F.array(*[F.struct(F.lit(p).alias("prob"), F.lit(k).alias("low"), F.lit(g).alias("g")) for p, k, g in spots])
    want = every.select(axis, F.inline(ask))
    ranks = sorted({r for _, k, _ in spots for r in (k, k + 1)})
    asked = F.filter(F.array(*map(F.lit, ranks)), lambda x: (x >= F.col("r")) & (x <= F.col("last")))
    picked = stored.select(axis, "val", F.explode(asked).alias("r"))
    lo = picked.select(axis, F.col("r").alias("low"), F.col("val").alias("x0"))
    hi = picked.select(axis, (F.col("r") - 1).alias("low"), F.col("val").alias("x1"))
    zero = F.lit(0.0)
    out = want.join(lo, [axis, "low"], "left").join(hi, [axis, "low"], "left")
    return out.select(axis, "prob", ((1 - F.col("g")) * F.coalesce("x0", zero) + F.when(F.col("g") > 0, F.col("g") * F.coalesce("x1", zero)).otherwise(0.0)).alias("quantile"))


def pseudobulk(m: SparseMatrix, groups: DataFrame, axis: str = "row") -> DataFrame:
    """``axis, cell_group, nonzeros, total, mean, variance`` over the columns of each group
    (``idx, cell_group``); a row without entries in a group has no row of results."""
    other = "col" if axis == "row" else "row"
    g = groups.select(F.col("idx").alias(other), "cell_group")
    size = g.groupBy("cell_group").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("val")
    agg = m.entries.join(checked_broadcast(g), other).groupBy(axis, "cell_group").agg(F.count(F.lit(1)).alias("k"), F.sum(v).alias("s"), F.avg(v).alias("m"), F.var_pop(v).alias("vp"))
    k, n = F.col("k"), F.col("n")
    variance = F.when(n > 1, (F.col("vp") * k + F.col("m") * F.col("m") * k * (n - k) / n) / (n - 1))
    return agg.join(checked_broadcast(size), "cell_group").select(axis, "cell_group", k.alias("nonzeros"), F.col("s").alias("total"), (F.col("s") / n).alias("mean"), variance.alias("variance"))


def rank_transform(m: SparseMatrix, axis: str) -> SparseMatrix:
    """Average ranks along an axis (``row``: within each row), moved so that zeros have rank 0."""
    m._plain("a rank")
    _, n, _, _ = _axis(m, axis)
    v = _value_ranks(m, axis)
    ranks = v.select(axis, "val", _moved_rank(n, v["n"], F.sum(F.when(F.col("val") < 0, F.col("n")).otherwise(0)).over(Window.partitionBy(axis))).alias("rank"))
    e = m.entries.join(ranks, [axis, "val"]).select("row", "col", F.col("rank").alias("val"))
    return SparseMatrix(e.where("val <> 0"), m.nrow, m.ncol)


def _moved_rank(n: int, t: Column, neg: Column) -> Column:
    """The average rank of ``t`` equal values that end at ``upto`` of ``k`` stored ones, less that of
    the zeros."""
    zeros = n - F.col("k")
    average = F.col("upto") - (t - 1) / 2 + F.when(F.col("val") > 0, zeros).otherwise(0)
    at_zero = F.when(zeros > 0, neg + (1 + zeros) / 2).otherwise(0.0)
    return (average - at_zero).cast("double")


def tie_statistics(m: SparseMatrix, axis: str) -> DataFrame:
    """``axis, ties``: the sum of t^3 - t over groups of equal values, zeros being one."""
    every, n, _, _ = _axis(m, axis)
    t = F.col("t")
    each = m.entries.groupBy(axis, "val").agg(F.count(F.lit(1)).alias("t")).groupBy(axis).agg(F.sum(t * t * t - t).alias("s"), F.sum(t).alias("k"))
    z = n - F.coalesce("k", F.lit(0))
    return every.join(each, axis, "left").select(axis, (F.coalesce("s", F.lit(0)) + z * z * z - z).alias("ties"))


def marker_features(m: SparseMatrix, groups: DataFrame, with_p: bool = True) -> DataFrame:
    """Rank-sum test of each row, columns of a group against the others: ``row, cell_group, u, z``
    and ``p_val`` (corrected for ties and continuity), ``foreground_mean, background_mean``."""
    from ..functions.tails import erfc

    n = m.ncol
    g = checked_broadcast(groups.select(F.col("idx").alias("col"), "cell_group"))
    # all from the frequencies of (row, value, group); one shuffle of them
    counts = m.entries.join(g, "col", "left").groupBy("row", "val", "cell_group").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("row")
    counts = counts.select(
        "*", F.sum("c").over(Window.partitionBy("row", "val")).alias("n"), F.sum("c").over(w.orderBy("val").rangeBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("c").over(w).alias("k"), F.sum(F.when(F.col("val") < 0, F.col("c")).otherwise(0)).over(w).alias("neg"),
    )
    ranked = counts.select("row", "cell_group", (F.col("c") * _moved_rank(n, F.col("n"), F.col("neg"))).alias("r"), (F.col("c") * F.col("val")).alias("s"))
    by = ranked.groupBy("row", "cell_group").agg(F.sum("r").alias("rg"), F.sum("s").alias("sg"))
    total = by.groupBy("row").agg(F.sum("rg").alias("rt"), F.sum("sg").alias("st"))
    size = groups.groupBy("cell_group").agg(F.count(F.lit(1)).alias("n1"))
    full = m.rows().crossJoin(checked_broadcast(size)).join(by, ["row", "cell_group"], "left").join(total, "row", "left").join(tie_statistics(m, "row"), "row")
    z0 = F.lit(0.0)
    rg, rt, sg, st = (F.coalesce(c, z0) for c in ("rg", "rt", "sg", "st"))
    n1, n2 = F.col("n1"), n - F.col("n1")
    off = (n * (n + 1) / 2 - rt) / n
    u1 = rg + off * n1 - n1 * (n1 + 1) / 2
    u2 = (rt - rg) + off * n2 - n2 * (n2 + 1) / 2
    u, half = F.greatest(u1, u2), n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1.0))))
    out = full.select("row", "cell_group", u1.alias("u"), u.alias("__u"), half.alias("__h"), sd.alias("__sd"), (sg / n1).alias("foreground_mean"), F.when(n2 > 0, (st - sg) / n2).alias("background_mean"))
    moved = F.col("__u") - F.when(F.col("__u") > F.col("__h"), 0.5).otherwise(0.0) - F.col("__h")
    out = out.withColumn("z", F.when(F.col("__sd") > 0, moved / F.col("__sd")).otherwise(0.0))
    if with_p:
        out = out.withColumn("p_val", F.when(F.col("__sd") > 0, F.least(F.lit(1.0), erfc(F.col("z") / F.sqrt(F.lit(2.0))))).otherwise(1.0))
    return out.drop("__u", "__h", "__sd")


def rolling_mean(df: DataFrame, group: list[str], order: str, value: str, k: int, out: str) -> DataFrame:
    """Centred mean of ``k`` rows, null where the window is cut off."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-((k - 1) // 2), k // 2)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == k, F.avg(value).over(w)))


def top_features(m: SparseMatrix, k: int, by: str = "variance") -> DataFrame:
    """``row, score`` of the ``k`` rows with the largest mean, variance or dispersion (variance over
    mean), ties to the smaller index."""
    score = {"mean": F.col("mean"), "variance": F.col("variance"), "dispersion": F.try_divide(F.col("variance"), F.col("mean"))}[by]
    return axis_stats(m, "row").select("row", score.alias("score")).orderBy(F.desc_nulls_last("score"), "row").limit(k)
