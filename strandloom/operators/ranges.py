"""Genomic ranges: forms, joins by overlap, distances, greedy merging.

Coordinates are 0-based and half-open.  Overlap joins bin the genome, so that Catalyst plans them
as equi joins on (chr, bin); long ranges use coarser bins, so no range makes many rows.  Rows with
a null chr, start or end overlap nothing; repeated rows are separate; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bins of the finest level, and how much coarser each further level is.
BIN = 4096
COARSER = 256
LEVELS = 3
#: A table is broadcast only after it was counted to have no more rows and bytes than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _bytes(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return F.greatest(F.size(field.name), F.lit(0)) * 8
    return F.lit(8)


def checked_broadcast(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``bound`` rows and
    BROADCAST_BYTES; else as it is, for a shuffled join."""
    n = df.limit(bound + 1).count()  # reads no column
    if n > bound:
        return df
    wide = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType))]
    if wide:  # numbers are 8 bytes each, other values are measured
        size = df.agg(F.sum(reduce(Column.__add__, map(_bytes, df.schema.fields), F.lit(0).cast("bigint")))).first()[0]
        return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df
    return F.broadcast(df)


def _level(start: Column, end: Column) -> Column:
    """The finest level at which a range covers no more than COARSER bins."""
    width = end - start
    return F.when(width <= BIN * COARSER, 0).when(width <= BIN * COARSER**2, 1).otherwise(2)


def _bins(start: Column, end: Column, level: Column) -> Column:
    size = F.element_at(F.array(*[F.lit(BIN * COARSER**k) for k in range(LEVELS)]), level + 1)
    return F.sequence(F.floor(start / size).cast("int"), F.floor((end - 1) / size).cast("int"))


def _levels_of(ranges: DataFrame) -> list[int]:
    return sorted(r[0] for r in ranges.select(_level(F.col("__rs"), F.col("__re")).alias("l")).distinct().collect())


def _binned_ranges(ranges: DataFrame, levels: Column) -> DataFrame:
    out = ranges.withColumn("__rl", _level(F.col("__rs"), F.col("__re"))).withColumn("__l", F.explode(levels))
    return out.withColumn("__b", F.explode(_bins(F.col("__rs"), F.col("__re"), F.col("__l"))))


def points_in_ranges(points: DataFrame, pos: str, ranges: DataFrame) -> DataFrame:
    """Each point (``chr`` and ``pos``) with each range (``chr, start, end``, other columns) that
    holds it, as columns of the points and, with the prefix ``r_``, of the ranges."""
    r = ranges.where("chr is not null and start is not null and end is not null and end > start")
    r = r.select(F.col("chr").alias("__rc"), F.col("start").alias("__rs"), F.col("end").alias("__re"), *[F.col(c).alias(f"r_{c}") for c in ranges.columns if c != "chr"])
    levels = _levels_of(r)
    binned = _binned_ranges(r, F.array(F.col("__rl")))
    size = [BIN * COARSER**k for k in levels]
    keys = F.array(*[F.struct(F.lit(k).alias("l"), F.floor(F.col(pos) / s).cast("int").alias("b")) for k, s in zip(levels, size)])
    if not levels:
        keys = F.array().cast("array<struct<l:int,b:int>>")
    elif len(levels) == 1:  # no Generate in the usual case
        p = points.withColumn("__pl", F.lit(levels[0])).withColumn("__pb", F.floor(F.col(pos) / size[0]).cast("int"))
        return _hold(p, pos, binned)
    p = points.withColumn("__k", F.explode(keys)).withColumn("__pl", F.col("__k.l")).withColumn("__pb", F.col("__k.b")).drop("__k")
    return _hold(p, pos, binned)


def _hold(p: DataFrame, pos: str, binned: DataFrame) -> DataFrame:
    cond = (F.col("chr") == F.col("__rc")) & (F.col("__pl") == F.col("__l")) & (F.col("__pb") == F.col("__b")) & (F.col(pos) >= F.col("__rs")) & (F.col(pos) < F.col("__re"))
    return p.join(checked_broadcast(binned), cond).drop("__pl", "__pb", "__rc", "__rs", "__re", "__rl", "__l", "__b")


def range_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of overlapping ranges once each: the columns of ``left`` and, prefixed ``r_``, of
    ``right``; both have ``chr, start, end``."""
    whole = "chr is not null and start is not null and end is not null and end > start"
    r = right.where(whole).select(F.col("chr").alias("__rc"), F.col("start").alias("__rs"), F.col("end").alias("__re"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    levels = _levels_of(r)
    # a pair meets at the coarser level of the two
    rb = _binned_ranges(r, F.filter(F.array(*map(F.lit, range(LEVELS))), lambda k: k >= F.col("__rl")))
    lv = _level(F.col("start"), F.col("end"))
    own = F.array_distinct(F.concat(F.array(F.col("__ll")), F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda k: k > F.col("__ll"))))
    lb = left.where(whole).withColumn("__ll", lv).withColumn("__m", F.explode(own)).withColumn("__lb", F.explode(_bins(F.col("start"), F.col("end"), F.col("__m"))))
    size = F.element_at(F.array(*[F.lit(BIN * COARSER**k) for k in range(LEVELS)]), F.col("__m") + 1)
    # both cover several bins: the pair counts in the first one they share
    first = F.floor(F.greatest("start", "__rs") / size)
    cond = (
        (F.col("chr") == F.col("__rc")) & (F.col("__m") == F.col("__l")) & (F.col("__lb") == F.col("__b")) & (F.greatest("__ll", "__rl") == F.col("__m"))
        & (F.col("start") < F.col("__re")) & (F.col("end") > F.col("__rs")) & (F.col("__lb") == first)
    )
    return lb.join(checked_broadcast(rb), cond).drop("__ll", "__m", "__lb", "__rc", "__rs", "__re", "__rl", "__l", "__b")


def select_overlapping(df: DataFrame, ranges: DataFrame, invert: bool = False) -> DataFrame:
    """Rows of ``df`` that overlap any range (or, inverted, none); rows with nulls overlap none.

    Ranges are merged first, then put into their bins and the bin before the first one, at each
    level.  A row no wider than a bin of its level meets every range it overlaps in the bin where it
    starts, so a semi-join on that bin suffices: rows are neither repeated nor tagged."""
    from .periods import periods_and_gaps

    merged = periods_and_gaps(ranges, ["chr"]).where("kind = 'period'").select(F.col("chr").alias("__rc"), F.col("from_pos").alias("__rs"), F.col("to_pos").alias("__re"))
    sizes = [BIN * COARSER**k for k in range(LEVELS)]
    spans = F.array(*[F.struct(F.lit(k).alias("l"), F.sequence(F.floor(F.col("__rs") / s) - 1, F.floor((F.col("__re") - 1) / s)).alias("b")) for k, s in enumerate(sizes)])
    binned = merged.select("*", F.inline(spans)).select("__rc", "__rs", "__re", F.col("l").alias("__l"), F.explode("b").alias("__b"))
    width = F.col("end") - F.col("start")
    level = F.when(width > sizes[1], 2).when(width > sizes[0], 1).otherwise(0)
    place = F.floor(F.col("start") / F.element_at(F.array(*map(F.lit, sizes)), level + 1))
    cond = (F.col("chr") == F.col("__rc")) & (level == F.col("__l")) & (place == F.col("__b")) & (F.col("start") < F.col("__re")) & (F.col("end") > F.col("__rs")) & (width > 0)
    return df.join(checked_broadcast(binned), cond, "left_anti" if invert else "left_semi")


def normalize_ranges(df: DataFrame, text: str = "range", zero_based: bool = False) -> DataFrame:
    """``chr:start-end`` texts, thousands separators allowed, into ``chr, start, end``; 1-based
    texts get start - 1.  Texts of another form give nulls."""
    form = r"^([^:]+):([0-9,]+)-([0-9,]+)$"
    part = lambda k: F.nullif(F.regexp_extract(text, form, k), F.lit(""))
    number = lambda k: F.regexp_replace(part(k), ",", "").cast("int")
    return df.withColumns({"chr": part(1), "start": number(2) - (0 if zero_based else 1), "end": number(3)})


def strand_is_plus(strand: Column) -> Column:
    """Strand texts to booleans; all but ``-`` count as plus."""
    return strand != "-"


def extend_ranges(df: DataFrame, upstream: int = 0, downstream: int = 0, chrom_sizes: DataFrame | None = None) -> DataFrame:
    """Ranges made longer against and along their strand (``strand``: true is plus), cut at 0 and
    at the end of the chromosome where its size (``chr, chr_size``) is known."""
    start = F.greatest(F.lit(0), F.col("start") - F.when(F.col("strand"), upstream).otherwise(downstream))
    end = F.col("end") + F.when(F.col("strand"), downstream).otherwise(upstream)
    out = df.withColumns({"start": start, "end": end})
    if chrom_sizes is not None:
        sizes = chrom_sizes.select("chr", F.col("chr_size").alias("__size"))
        out = out.join(checked_broadcast(sizes), "chr", "left").withColumn("end", F.least("end", F.coalesce("__size", "end"))).drop("__size")
    return out


def order_ranges(df: DataFrame, chr_levels: list[str], sort_by_end: bool = True) -> DataFrame:
    """``df`` with ``ord`` (from 1): by the position of chr in the levels, then (end, start) or (start, end).

    Ranks are made per chromosome and shifted by the rows of the chromosomes before it."""
    level = F.array_position(F.array(*map(F.lit, chr_levels)), F.col("chr"))
    by = ("end", "start") if sort_by_end else ("start", "end")
    inner = F.row_number().over(Window.partitionBy("__lev").orderBy(*by))
    rows = df.withColumn("__lev", level).where("__lev > 0")
    sizes = rows.groupBy("__lev").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("a.__lev") > F.col("b.__lev"), "left").groupBy(F.col("a.__lev").alias("__lev")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__lev").withColumn("ord", inner + F.col("__before")).drop("__lev", "__before")


def distance_to_nearest(df: DataFrame, id_col: str) -> DataFrame:
    """``id_col, upstream, downstream``: the distance to the next range against and along the
    strand, infinite at the ends of a chromosome, 0 for ranges nested in another."""
    inf, zero = F.lit(float("inf")), F.lit(0.0)
    mine = df.select(id_col, "chr", "start", "end", "strand")
    own = F.col(id_col)
    # In this order only a range before can hold another, so the farthest end before it tells; a
    # range isn't nested in its own id, so the farthest end of another id than that is kept too.
    seen = Window.partitionBy("chr").orderBy("start", F.desc("end"), id_col).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("chr").isNotNull() & (F.col("end") > F.col("start")) & own.isNotNull()
    marked = mine.withColumn("__top", F.max(F.when(whole, F.struct(F.col("end").alias("e"), own.alias("k")))).over(seen))
    marked = marked.withColumn("__next", F.max(F.when(whole & (F.col("__top.k") != own), F.least("end", "__top.e"))).over(seen))
    holder = F.when(F.col("__top.k") == own, F.col("__next")).otherwise(F.col("__top.e"))
    marked = marked.withColumn("__in", F.coalesce(whole & (holder >= F.col("end")), F.lit(False)))
    same = Window.partitionBy(id_col)  # an id with a nested range counts as nested, once
    marked = marked.withColumn("__nested", F.max("__in").over(same)).withColumn("__n", F.row_number().over(same.orderBy("start")))
    w = Window.partitionBy("chr", "__nested").orderBy("start", "end", id_col)
    before = F.greatest(zero, F.coalesce(F.col("start") + 1 - F.lag("end").over(w), inf))
    after = F.greatest(zero, F.coalesce(F.lead("start").over(w) + 1 - F.col("end"), inf))
    gaps = marked.where("not __nested or __n = 1").withColumn("__b", before).withColumn("__a", after)
    side = lambda plus, minus: F.when(F.col("__nested"), zero).when(F.col("strand"), F.col(plus)).otherwise(F.col(minus))
    return gaps.select(id_col, side("__b", "__a").alias("upstream"), side("__a", "__b").alias("downstream"))


def merge_ranked(df: DataFrame, rank: str) -> DataFrame:
    """Ranges kept greedily by ``rank`` (unique, smaller first): a range goes if it overlaps a kept one.

    Rounds over the whole table: a range stays if no better one that overlaps it is left, and those
    that overlap it go.  Each round removes the overlaps of all such ranges at once."""
    from ..session import cut_lineage

    df = cut_lineage(df)  # read by every round
    mine = df.select("chr", "start", "end", F.col(rank).alias("k"))
    links = cut_lineage(range_join(mine, mine.withColumnRenamed("k", "o")).where("k < r_o").select("k", F.col("r_o").alias("o")))
    gone: list[DataFrame] = []
    while links.limit(1).count():
        worse = links.select(F.col("o").alias("k")).distinct()
        best = links.select("k").distinct().join(worse, "k", "left_anti")
        drop = cut_lineage(links.join(best, "k", "left_semi").select(F.col("o").alias("k")).distinct())
        gone.append(drop)
        rest = links.join(drop, "k", "left_anti")
        links = cut_lineage(rest.join(drop.withColumnRenamed("k", "o"), "o", "left_anti").select("k", "o"))
    if not gone:
        return df
    return df.join(reduce(DataFrame.union, gone).withColumnRenamed("k", rank), rank, "left_anti").select(df.columns)


def tile_ranges(regions: DataFrame) -> DataFrame:
    """``chr, start, end, region_id, tile_no``: the tiles of regions with a ``tile_width``; the
    last of a region may be short."""
    w = F.col("tile_width")
    starts = F.sequence(F.col("start"), F.col("end") - 1, w)
    return regions.select("region_id", "chr", "end", "tile_width", F.posexplode(starts).alias("tile_no", "start")).select(
        "chr", "start", F.least("end", F.col("start") + w).alias("end"), "region_id", "tile_no"
    )


def canonical_symbols(query: DataFrame, mapping: DataFrame) -> DataFrame:
    """``symbol, canonical``: the symbol's entry in ``mapping`` (``alias, canonical``), or null."""
    m = mapping.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    return query.select("symbol").join(checked_broadcast(m), F.col("symbol") == F.col("alias"), "left").select("symbol", "canonical")


def match_symbols(query: DataFrame, subject: DataFrame, mapping: DataFrame) -> DataFrame:
    """``symbol, matched``: the subject's symbol that equals it, else one with the same canonical
    form, else null."""
    have = subject.select(F.col("symbol").alias("s")).distinct()
    exact = query.select("symbol").join(have, F.col("symbol") == F.col("s"), "left").withColumnRenamed("s", "exact")
    canon = canonical_symbols(subject, mapping).where("canonical is not null").groupBy("canonical").agg(F.min("symbol").alias("via"))
    q = canonical_symbols(query, mapping).select(F.col("symbol").alias("q"), F.col("canonical").alias("qc")).distinct()
    via = q.join(canon, F.coalesce("qc", "q") == F.col("canonical"), "left").select("q", "via")
    plain = q.join(have, F.col("qc") == F.col("s"), "left").select(F.col("q").alias("p"), F.col("s").alias("by_canon"))
    out = exact.join(via, F.col("symbol") == F.col("q"), "left").join(plain, F.col("symbol") == F.col("p"), "left")
    return out.select("symbol", F.coalesce("exact", "by_canon", "via").alias("matched"))


def without_version(ident: Column) -> Column:
    """Gene identifiers without their version."""
    form = r"^ENS(MUS)?G[0-9]{11}\.[0-9]+"
    return F.when(ident.rlike(form), F.regexp_replace(ident, r"\..*", "")).otherwise(ident)


def gene_region(genes: DataFrame, symbol: str, upstream: int = 10_000, downstream: int = 10_000) -> DataFrame:
    """``chr, start, end, strand`` of one gene, made longer 5' to 3'."""
    return extend_ranges(genes.where(F.col("gene_name") == symbol), upstream, downstream).select("chr", "start", "end", "strand")


def file_names(df: DataFrame, name: str = "name", order: str | None = None) -> DataFrame:
    """``df`` with ``file_name``: characters other than letters, digits, ``-``, ``_`` and ``.``
    replaced by ``_``, and a number appended to all but the first (by ``order``) of equal results."""
    clean = df.withColumn("__f", F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"))
    n = F.row_number().over(Window.partitionBy("__f").orderBy(order or name))
    return clean.withColumn("file_name", F.when(n == 1, F.col("__f")).otherwise(F.concat_ws("_", "__f", n.cast("string")))).drop("__f")


def require_ranges(df: DataFrame, *further: str) -> DataFrame:
    """``df`` if it has ``chr, start, end`` and the further columns with whole-number positions;
    else an error that names what is missing or of another kind."""
    missing = [c for c in ("chr", "start", "end", *further) if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    wrong = [c for c in ("start", "end") if not isinstance(df.schema[c].dataType, T.IntegralType)]
    if wrong:
        raise TypeError(f"positions must be whole numbers: {', '.join(wrong)}")
    return df
