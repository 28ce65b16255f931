"""Sparse matrices as DataFrames of stored entries; what is not stored is 0.

Entries have ``row, col`` (from 0) and ``val`` and are unique; explicit zeros are dropped whenever a
matrix is made.  Row and column vectors are DataFrames ``idx, v`` that are broadcast only if they
were counted to be small.  Operations that make zeros non-zero keep the stored part sparse and add
a row vector, a column vector and a number, so that sums, statistics and products never densify;
only ``densify`` does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import checked_broadcast


@dataclass(frozen=True)
class SparseMatrix:
    entries: DataFrame
    nrow: int
    ncol: int
    row_shift: DataFrame | None = None  # idx, v: added to all elements of the row
    col_shift: DataFrame | None = None
    shift: float = 0.0

    # -- construction ---------------------------------------------------------------------------

    @staticmethod
    def of(df: DataFrame, nrow: int, ncol: int, row: str = "row", col: str = "col", val: str = "val") -> "SparseMatrix":
        """Entries of a table; repeated places are added up."""
        e = df.select(F.col(row).cast("bigint").alias("row"), F.col(col).cast("bigint").alias("col"), F.col(val).cast("double").alias("val"))
        return SparseMatrix(e.groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0"), nrow, ncol)

    def _with(self, entries: DataFrame) -> "SparseMatrix":
        return replace(self, entries=entries.where("val <> 0"))

    def _plain(self, what: str) -> None:
        if self.shifted:
            raise ValueError(f"{what} needs a matrix without dense terms; densify it first")

    def map(self, expr: Column) -> "SparseMatrix":
        """An element-wise function with f(0) = 0."""
        self._plain("an element-wise function")
        return self._with(self.entries.select("row", "col", expr.alias("val")))

    # -- selection ------------------------------------------------------------------------------

    def select(self, rows: list[int] | None = None, cols: list[int] | None = None) -> "SparseMatrix":
        """Rows and columns by index, in the order given; negative indexes count from the end."""
        self._plain("a selection")
        e, n, m = self.entries, self.nrow, self.ncol
        for name, sel, size in (("row", rows, n), ("col", cols, m)):
            if sel is None:
                continue
            sel = [k + size if k < 0 else k for k in sel]
            if len(set(sel)) != len(sel) or not all(0 <= k < size for k in sel):
                raise ValueError("indexes must be distinct and within the matrix")
            place = e.sparkSession.createDataFrame([(k, at) for at, k in enumerate(sel)], "old bigint, new bigint")
            e = e.join(checked_broadcast(place), F.col(name) == F.col("old")).withColumn(name, F.col("new")).drop("old", "new")
        return SparseMatrix(e.select("row", "col", "val"), n if rows is None else len(rows), m if cols is None else len(cols))

    def col_slice(self, a: int, b: int) -> "SparseMatrix":
        """Columns a to b - 1: a filter that reaches the scan."""
        self._plain("a slice")
        e = self.entries.where((F.col("col") >= a) & (F.col("col") < b))
        return SparseMatrix(e.withColumn("col", F.col("col") - a), self.nrow, b - a)

    def __getitem__(self, key) -> "SparseMatrix":
        """Indexing as of arrays: numbers, slices, lists, masks and an ellipsis, also negative."""
        rows, cols = normalize_index(key, (self.nrow, self.ncol))
        return self.select(rows, cols)

    @property
    def shifted(self) -> bool:
        return self.row_shift is not None or self.col_shift is not None or bool(self.shift)

    def _with_shift(self, cells: DataFrame) -> DataFrame:
        """``cells`` (with ``row, col``) and ``__d``, what the dense terms add there."""
        add = F.lit(float(self.shift))
        for axis, vec, name in (("row", self.row_shift, "__rv"), ("col", self.col_shift, "__cv")):
            if vec is not None:
                cells = cells.join(checked_broadcast(vec.select(F.col("idx").alias(axis), F.col("v").alias(name))), axis, "left")
                add = add + F.coalesce(name, F.lit(0.0))
        return cells.withColumn("__d", add).drop("__rv", "__cv")

    def assign(self, rows: list[int], cols: list[int], value: "SparseMatrix") -> "SparseMatrix":
        """The matrix with the submatrix at ``rows, cols`` replaced.  If either has dense terms, all
        its cells (the caller names them) are stored, less what the terms add there."""
        if (value.nrow, value.ncol) != (len(rows), len(cols)):
            raise ValueError("the value has another shape")
        spark = self.entries.sparkSession
        r = F.broadcast(spark.createDataFrame(list(enumerate(rows)), "ri bigint, r bigint"))  # given by the caller
        c = F.broadcast(spark.createDataFrame(list(enumerate(cols)), "ci bigint, c bigint"))
        inside = self.entries.join(r, F.col("row") == F.col("r"), "left").join(c, F.col("col") == F.col("c"), "left")
        kept = inside.where("r is null or c is null").select("row", "col", "val")
        cells = value.densify() if self.shifted or value.shifted else value.entries
        new = cells.join(r, F.col("row") == F.col("ri")).join(c, F.col("col") == F.col("ci")).select(F.col("r").alias("row"), F.col("c").alias("col"), "val")
        if self.shifted:
            new = self._with_shift(new).select("row", "col", (F.col("val") - F.col("__d")).alias("val"))
        return self._with(kept.unionByName(new))

    def mask(self, other: "SparseMatrix", invert: bool = False) -> "SparseMatrix":
        """Elements where ``other`` is zero, or inverted, where it isn't; the rest becomes 0."""
        other._plain("a mask")
        cells = other.entries.select("row", "col")
        if not self.shifted:
            return self._with(self.entries.join(cells, ["row", "col"], "left_semi" if invert else "left_anti"))
        there = self._with_shift(cells)
        if invert:
            found = there.join(self.entries, ["row", "col"], "left").select("row", "col", (F.coalesce("val", F.lit(0.0)) + F.col("__d")).alias("val"))
            return SparseMatrix(found.where("val <> 0"), self.nrow, self.ncol)
        kept = self.entries.join(cells, ["row", "col"], "left_anti")
        return self._with(kept.unionByName(there.select("row", "col", (-F.col("__d")).alias("val"))))

    @property
    def t(self) -> "SparseMatrix":
        e = self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
        return SparseMatrix(e, self.ncol, self.nrow, self.col_shift, self.row_shift, self.shift)

    def bind_rows(self, *others: "SparseMatrix") -> "SparseMatrix":
        return _bind((self, *others), "row")

    def bind_cols(self, *others: "SparseMatrix") -> "SparseMatrix":
        return _bind((self, *others), "col")

    # -- element-wise ---------------------------------------------------------------------------

    def log1p(self) -> "SparseMatrix":
        return self.map(F.log1p("val"))

    def expm1(self) -> "SparseMatrix":
        return self.map(F.expm1("val"))

    def power(self, p: float) -> "SparseMatrix":
        if p <= 0:
            raise ValueError("the exponent must be positive")
        return self if p == 1 else self.map(F.col("val") * F.col("val") if p == 2 else F.pow("val", F.lit(float(p))))

    def min_scalar(self, c: float) -> "SparseMatrix":
        if c <= 0:
            raise ValueError("the bound must be positive")
        return self.map(F.least("val", F.lit(float(c))))

    def round(self, digits: int = 0) -> "SparseMatrix":
        """Half to even."""
        if digits == 0:
            return self.map(F.rint("val"))
        return self.map(F.rint(F.col("val") * 10.0**digits) / 10.0**digits)

    def binarize(self, threshold: float = 0, strict: bool = True) -> "SparseMatrix":
        if threshold < 0 or (threshold == 0 and not strict):
            raise ValueError("zeros must stay zero")
        test = F.col("val") > threshold if strict else F.col("val") >= threshold
        return self.map(F.when(test, 1.0).otherwise(0.0))

    def cast_whole(self) -> "SparseMatrix":
        """Values cut toward zero."""
        return self.map(F.col("val").cast("bigint").cast("double"))

    def _vector(self, axis: str, vec: DataFrame, expr: Column, how: str) -> "SparseMatrix":
        self._plain("this function")
        v = checked_broadcast(vec.select("idx", "v"))
        e = self.entries.join(v, F.col(axis) == F.col("idx"), how).select("row", "col", expr.alias("val"))
        return self._with(e)

    def min_by(self, axis: str, vec: DataFrame) -> "SparseMatrix":
        """At most the number of the row or column; those the vector lacks stay as they are.  A
        bound that isn't positive would change zeros and raises."""
        bound = F.when(F.col("v") > 0, F.col("v")).when(F.col("v").isNotNull(), F.raise_error(F.lit("bounds must be positive")).cast("double"))
        return self._vector(axis, vec, F.least("val", F.coalesce(bound, "val")), "left")

    def multiply_by(self, axis: str, vec: DataFrame) -> "SparseMatrix":
        """Each row or column times its number; those the vector lacks become 0."""
        return self._vector(axis, vec, F.col("val") * F.col("v"), "inner")

    def divide_by(self, axis: str, vec: DataFrame) -> "SparseMatrix":
        """Each row or column divided by its number, which must not be 0."""
        inverse = F.when(F.col("v") != 0, 1 / F.col("v")).otherwise(F.raise_error(F.lit("division by zero")).cast("double"))
        return self.multiply_by(axis, vec.select("idx", inverse.alias("v")))

    def __truediv__(self, c: float) -> "SparseMatrix":
        return self.scale(1 / c)

    def __rtruediv__(self, c: float) -> "SparseMatrix":
        raise ValueError("a number divided by a sparse matrix is infinite nearly everywhere")

    def scale(self, c: float) -> "SparseMatrix":
        if c == 1:
            return self
        times = lambda d: None if d is None else d.select("idx", (F.col("v") * c).alias("v"))
        e = self.entries.select("row", "col", (F.col("val") * c).alias("val"))
        return SparseMatrix(e, self.nrow, self.ncol, times(self.row_shift), times(self.col_shift), self.shift * c)

    def add(self, c: float) -> "SparseMatrix":
        return self if c == 0 else replace(self, shift=self.shift + c)

    def add_by(self, axis: str, vec: DataFrame) -> "SparseMatrix":
        have = self.row_shift if axis == "row" else self.col_shift
        new = vec.select("idx", "v")
        if have is not None:
            new = have.unionByName(new).groupBy("idx").agg(F.sum("v").alias("v"))
        return replace(self, **{f"{axis}_shift": new})

    def __gt__(self, c: float) -> "SparseMatrix":
        return self.binarize(c, True)

    def __ge__(self, c: float) -> "SparseMatrix":
        return self.binarize(c, False)

    def __lt__(self, c: float) -> "SparseMatrix":
        raise ValueError("zeros must stay zero: only > and >= are possible")

    __le__ = __lt__

    # -- dense forms ----------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        return self.entries.sparkSession.range(self.nrow).withColumnRenamed("id", "row")

    def cols(self) -> DataFrame:
        return self.entries.sparkSession.range(self.ncol).withColumnRenamed("id", "col")

    def densify(self) -> DataFrame:
        """``row, col, val`` of all elements: a sink for matrices known to be small."""
        cells = self.rows().crossJoin(self.cols())
        out = cells.join(self.entries, ["row", "col"], "left")
        val = F.coalesce("val", F.lit(0.0)) + F.lit(self.shift)
        for axis, vec, name in (("row", self.row_shift, "__rv"), ("col", self.col_shift, "__cv")):
            if vec is not None:
                out = out.join(vec.select(F.col("idx").alias(axis), F.col("v").alias(name)), axis, "left")
                val = val + F.coalesce(name, F.lit(0.0))
        return out.select("row", "col", val.alias("val"))

    # -- products -------------------------------------------------------------------------------

    def times_vector(self, vec: DataFrame) -> DataFrame:
        """``idx, v`` of the product with a column vector ``idx, v``; every row has one."""
        spark_sum = self.entries.join(checked_broadcast(vec), F.col("col") == F.col("idx")).groupBy("row").agg(F.sum(F.col("val") * F.col("v")).alias("v"))
        out = self.rows().join(spark_sum, "row", "left").select(F.col("row").alias("idx"), F.coalesce("v", F.lit(0.0)).alias("v"))
        if self.row_shift is None and self.col_shift is None and not self.shift:
            return out
        # (x + r 1' + 1 c' + g 1 1') v = x v + r sum(v) + (c'v + g sum(v))
        total = vec.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("__s"))  # one row
        add = F.lit(self.shift) * F.col("__s")
        out = out.crossJoin(F.broadcast(total))
        if self.col_shift is not None:
            dot = self.col_shift.join(vec.withColumnRenamed("v", "w"), "idx").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("__d"))
            out, add = out.crossJoin(F.broadcast(dot)), add + F.col("__d")
        if self.row_shift is not None:
            out = out.join(self.row_shift.select("idx", F.col("v").alias("__r")), "idx", "left")
            add = add + F.coalesce("__r", F.lit(0.0)) * F.col("__s")
        return out.select("idx", (F.col("v") + add).alias("v"))

    def times_dense(self, dense: DataFrame, k: int) -> DataFrame:
        """``idx, vector`` of the product with a dense matrix given as rows ``idx, vector`` of k
        numbers; rows without entries are zero."""
        self._plain("a product")
        wide = self.entries.join(checked_broadcast(dense), F.col("col") == F.col("idx"))
        sums = wide.groupBy("row").agg(*[F.sum(F.col("val") * F.get("vector", F.lit(c))).alias(f"c{c}") for c in range(k)])
        out = self.rows().join(sums, "row", "left")
        return out.select(F.col("row").alias("idx"), F.array(*[F.coalesce(f"c{c}", F.lit(0.0)) for c in range(k)]).alias("vector"))

    def multiply(self, other: "SparseMatrix") -> "SparseMatrix":
        """The product of two sparse matrices: a join on the inner index, added up."""
        self._plain("a product")
        other._plain("a product")
        if self.ncol != other.nrow:
            raise ValueError("the shapes don't fit")
        a = self.entries.select("row", F.col("col").alias("k"), F.col("val").alias("x"))
        b = other.entries.select(F.col("row").alias("k"), "col", F.col("val").alias("y"))
        e = a.join(b, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("val"))
        return SparseMatrix(e.where("val <> 0"), self.nrow, other.ncol)

    def persist(self) -> "SparseMatrix":
        return replace(self, entries=self.entries.persist())


def normalize_index(key, shape: tuple[int, int]) -> tuple[list[int] | None, list[int] | None]:
    """The rows and columns that an index names; None is all of them."""
    parts = list(key) if isinstance(key, tuple) else [key]
    if parts.count(Ellipsis) > 1 or len(parts) - parts.count(Ellipsis) > 2:
        raise IndexError("too many indexes")
    if Ellipsis in parts:
        at = parts.index(Ellipsis)
        parts[at : at + 1] = [slice(None)] * (3 - len(parts))
    parts += [slice(None)] * (2 - len(parts))
    return tuple(_one_index(p, n) for p, n in zip(parts, shape))  # type: ignore[return-value]


def _one_index(part, n: int) -> list[int] | None:
    if isinstance(part, slice):
        return None if part == slice(None) else list(range(*part.indices(n)))
    values = [part] if isinstance(part, int) and not isinstance(part, bool) else list(part)
    if values and all(isinstance(v, bool) or type(v).__name__ in ("bool_", "bool") for v in values):
        if len(values) != n:
            raise IndexError("a mask must be as long as its axis")
        return [k for k, v in enumerate(values) if v]
    if any(not -n <= v < n for v in values):
        raise IndexError("an index is out of bounds")
    return [int(v) % n for v in values]


def named_entries(m: SparseMatrix, row_names: DataFrame, col_names: DataFrame) -> DataFrame:
    """``row_name, col_name, val``: names (``idx, name``) joined last; missing ones are null."""
    r = row_names.select(F.col("idx").alias("row"), F.col("name").alias("row_name"))
    c = col_names.select(F.col("idx").alias("col"), F.col("name").alias("col_name"))
    return m.entries.join(checked_broadcast(r), "row", "left").join(checked_broadcast(c), "col", "left").select("row_name", "col_name", "val")


def rows_by_name(m: SparseMatrix, names: list[str], row_names: DataFrame) -> SparseMatrix:
    """Rows in the order of ``names``; a name that is missing or not unique raises."""
    found: dict[str, list[int]] = {}
    for r in row_names.where(F.col("name").isin(names)).select("name", "idx").collect():
        found.setdefault(r["name"], []).append(r["idx"])
    if any(len(found.get(n, ())) != 1 for n in names):
        raise KeyError("names must each belong to one row")
    return m.select(rows=[found[n][0] for n in names])


def apply_by(m: SparseMatrix, axis: str, fn, schema: str) -> DataFrame:
    """``fn(index, other, val) -> dict`` of the fields of ``schema`` for every row or column, also
    empty ones, from the positions and values of its entries; the result has the index too."""
    import pandas as pd

    other = "col" if axis == "row" else "row"
    every = m.rows() if axis == "row" else m.cols()
    full = every.join(m.entries, axis, "left")

    def run(group: "pd.DataFrame") -> "pd.DataFrame":
        some = group[group["val"].notna()]
        index = int(group[axis].iloc[0])
        return pd.DataFrame([{axis: index, **fn(index, some[other].to_numpy("int64"), some["val"].to_numpy())}])

    return full.groupBy(axis).applyInPandas(run, f"{axis} bigint, {schema}")


def _bind(parts: tuple[SparseMatrix, ...], axis: str) -> SparseMatrix:
    other = "ncol" if axis == "row" else "nrow"
    parts = tuple(p for p in parts if (p.nrow if axis == "row" else p.ncol))
    if len({getattr(p, other) for p in parts}) > 1:
        raise ValueError("the shapes don't fit")
    at, out = 0, None
    for p in parts:
        p._plain("a bind")
        e = p.entries.withColumn(axis, F.col(axis) + at).select("row", "col", "val")
        out = e if out is None else out.unionByName(e)
        at += p.nrow if axis == "row" else p.ncol
    first = parts[0]
    return SparseMatrix(out, at if axis == "row" else first.nrow, first.ncol if axis == "row" else at)


def same(a: SparseMatrix, b: SparseMatrix) -> DataFrame:
    """One row ``identical``."""
    from .fragments import identical

    if (a.nrow, a.ncol) != (b.nrow, b.ncol):
        return a.entries.sparkSession.createDataFrame([(False,)], "identical boolean")
    return identical(a.entries, b.entries)


def value_histogram(m: SparseMatrix, max_value: int) -> DataFrame:
    """``value, n`` of the stored values; those above ``max_value`` count as max_value + 1."""
    return m.entries.groupBy(F.least(F.col("val").cast("bigint"), F.lit(max_value + 1)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def checksum(m: SparseMatrix, by: str = "col", row_names: DataFrame | None = None, col_names: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """One row ``md5``: of the elements in the storage order ``by``, the shape and the names
    (``idx, name``).  Digests of rows or columns are digested in blocks of ``block`` indexes, so only
    one digest a block comes together in the end; a single row or column is one task's work."""
    other = "row" if by == "col" else "col"
    cell = F.struct(other, F.concat_ws(":", F.col(other).cast("string"), F.col("val").cast("string")).alias("t"))
    lines = m.entries.groupBy(by).agg(F.md5(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["t"]))).alias("d"))
    parts = [lines.select(F.lit(0).alias("part"), F.col(by).alias("idx"), "d")]
    for k, names in ((1, row_names), (2, col_names)):
        if names is not None:
            parts.append(names.select(F.lit(k).alias("part"), F.col("idx").cast("bigint").alias("idx"), F.md5("name").alias("d")))
    all_parts = reduce(DataFrame.unionByName, parts)
    line = F.struct("idx", F.concat_ws("=", F.col("idx").cast("string"), "d").alias("t"))
    blocks = all_parts.groupBy("part", F.floor(F.col("idx") / block).alias("b")).agg(F.md5(F.concat_ws(";", F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]))).alias("d"))
    whole = F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("part", "b", "d"))), lambda x: x["d"]))
    return blocks.agg(F.md5(F.concat_ws("|", F.lit(f"{by}|{m.nrow}|{m.ncol}"), whole)).alias("md5"))


@dataclass(frozen=True)
class MatrixPlan:
    """A result together with the matrices it is made from, so that these can be listed and
    replaced: ``build`` makes the result from the inputs."""

    inputs: tuple[SparseMatrix, ...]
    build: Callable[..., SparseMatrix]

    def result(self) -> SparseMatrix:
        return self.build(*self.inputs)

    def with_inputs(self, *inputs: SparseMatrix) -> "MatrixPlan":
        if [(m.nrow, m.ncol) for m in inputs] != [(m.nrow, m.ncol) for m in self.inputs]:
            raise ValueError("as many inputs of the same shapes are needed")
        return replace(self, inputs=inputs)


def membership(groups: DataFrame, order: list[str]) -> SparseMatrix:
    """The indicator matrix of ``idx, cell_group``: cells by groups, in the order given."""
    n = groups.agg(F.max("idx")).first()[0]
    col = F.array_position(F.array(*map(F.lit, order)), F.col("cell_group")) - 1
    e = groups.select(F.col("idx").alias("row"), col.cast("bigint").alias("col"), F.lit(1.0).alias("val")).where("col >= 0")
    return SparseMatrix(e, 0 if n is None else n + 1, len(order))
