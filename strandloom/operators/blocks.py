"""Blocks of numpy state that exchange messages in supersteps.

A graph too large for one task is held in blocks of bounded size, one per partition.  In a
superstep every block reads the messages sent to it, changes its state and sends arrays to other
blocks; only these are shuffled, while states stay where they are (persisted, and checkpointed
every few steps, so a lost executor costs the steps since then).  A step on a DataFrame of single
edges would shuffle and sort all edges and states again.

A step is ``fn(block, count, state, inbox, *args) -> (state, out, stats)``: ``inbox`` holds
(sender, payload) by sender, ``out`` (receiver, payload); ``stats`` are a few numbers that the
driver sees, one set per block.  Programs are loops of steps; the same program runs over many
blocks or, once what is left fits one block, within the task that holds it (``LocalBlock``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import AccumulatorParam, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import drop_folder, ensure_checkpoint_dir

#: Supersteps between two checkpoints.
KEPT_STEPS = 8
Out = list[tuple[int, dict]]


def mixed(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def home(ids: np.ndarray, count: int) -> np.ndarray:
    """The block of each id; ``count`` is a power of two, so halving it joins whole blocks."""
    return (mixed(ids) >> np.uint64(20)).astype(np.int64) & (count - 1)


def by_home(to: np.ndarray, /, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Columns of the rows that go to each block."""
    order = np.argsort(to, kind="stable")
    blocks, at = np.unique(to[order], return_index=True)
    for b, rows in zip(blocks.tolist(), np.split(order, at[1:])):
        yield b, {k: v[rows] for k, v in columns.items()}


def gathered(inbox: list[tuple[int, dict]], kind: str) -> dict[str, np.ndarray] | None:
    """The messages of a kind put together, with ``src``, their senders; None if there are none."""
    some = [(src, m[kind]) for src, m in inbox if kind in m]
    if not some:
        return None
    out = {k: np.concatenate([m[k] for _, m in some]) for k in some[0][1]}
    out["src"] = np.concatenate([np.full(len(next(iter(m.values()))), src, np.int32) for src, m in some])
    return out


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted ``keys`` and whether each wanted value is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _same(block: int) -> int:
    return block


class _ByBlock(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        a.update(b)
        return a


class LocalBlock:
    """The only block, within a task."""

    count = 1

    def __init__(self, state: dict, out: Out):
        self.state, self.out = state, out

    def step(self, fn: Callable, *args, held: bool = True) -> list:
        self.state, self.out, stats = fn(0, 1, self.state, [(0, m) for _, m in self.out], *args)
        return [stats]


class Blocks:
    """All blocks, as an RDD of (block, (state, out))."""

    def __init__(self, spark: SparkSession, rdd, count: int):
        self.spark, self.rdd, self.count = spark, rdd.persist(StorageLevel.MEMORY_AND_DISK), count
        self.steps, self.folder, self.kept, self.still = 0, None, KEPT_STEPS, None

    @classmethod
    def load(cls, parts: DataFrame, count: int, build: Callable) -> Blocks:
        """From rows ``block, data`` (one column of bytes): ``build(block, count, [data]) -> state``."""

        def run(block: int, items: Iterable) -> Iterator:
            yield block, (build(block, count, [x for _, x in items]), [])

        rows = parts.rdd.map(lambda r: (r[0], r[1])).partitionBy(count, _same)
        return cls(parts.sparkSession, rows.mapPartitionsWithIndex(run, preservesPartitioning=True), count)

    def _replace(self, after) -> None:
        after = after.persist(StorageLevel.MEMORY_AND_DISK)
        self.steps += 1
        saved = self.steps % self.kept == 0
        if saved:
            ensure_checkpoint_dir(self.spark)
            after.checkpoint()
        after._jrdd.count()
        after._jrdd.rdd().cleanShuffleDependencies(False)  # the files of this step's messages
        self.rdd.unpersist()
        if saved:
            drop_folder(self.spark, self.folder)
            self.folder = after.getCheckpointFile()
        self.rdd = after

    def hold(self, keys: frozenset) -> None:
        """Keep these entries of the states apart: from now on steps read them, but no step writes
        them again, and a step with ``held=False`` does not even read them."""
        self.still = self.rdd.mapValues(lambda v: (None, {k: a for k, a in v[0].items() if k in keys})).persist(StorageLevel.MEMORY_AND_DISK)
        self.still._jrdd.count()
        self._replace(self.rdd.mapValues(lambda v: ({k: a for k, a in v[0].items() if k not in keys}, v[1])))

    def step(self, fn: Callable, *args, held: bool = True) -> list:
        count, told = self.count, self.spark.sparkContext.accumulator({}, _ByBlock())

        def run(block: int, items: Iterable) -> Iterator:
            state, inbox, still = {}, [], {}
            for _, (mine, x) in items:
                if mine:
                    state = x
                elif mine is None:
                    still = x
                else:
                    inbox.append(x)
            inbox.sort(key=lambda m: m[0])
            state, out, stats = fn(block, count, still | state, inbox, *args)
            told.add({block: stats})  # a repeated task says the same again
            yield block, ({k: a for k, a in state.items() if k not in still}, out)

        states = self.rdd.mapValues(lambda v: (True, v[0]))
        if held and self.still is not None:
            states = states.union(self.still)
        mail = self.rdd.flatMap(lambda x: [(to, (False, (x[0], m))) for to, m in x[1][1]]).partitionBy(count, _same)
        after = states.union(mail).mapPartitionsWithIndex(run, preservesPartitioning=True)
        self._replace(after)
        return list(told.value.values())

    def fewer(self, count: int, join: Callable) -> None:
        """Join blocks to ``count``, a smaller power of two: ``join([state]) -> state``."""

        def run(block: int, items: Iterable) -> Iterator:
            found = sorted((x for _, x in items), key=lambda x: x[0])
            yield block, (join([s for _, s, _ in found]), [m for _, _, out in found for m in out])

        moved = self.rdd.map(lambda x: (x[0] & (count - 1), (x[0], x[1][0], [(to & (count - 1), m) for to, m in x[1][1]])))
        self._replace(moved.partitionBy(count, _same).mapPartitionsWithIndex(run, preservesPartitioning=True))
        self.count = count

    def within(self, program: Callable, *args) -> None:
        """Run a program over the only block within its task."""

        def run(items: Iterable) -> Iterator:
            for block, (state, out) in items:
                only = LocalBlock(state, out)
                program(only, *args)
                yield block, (only.state, only.out)

        self._replace(self.rdd.mapPartitions(run, preservesPartitioning=True))

    def frame(self, rows: Callable, schema: str) -> DataFrame:
        """A DataFrame of ``rows(state)``, a dict of columns per block; the blocks end here."""

        def packed(x) -> Iterator:
            table = pa.table(rows(x[1][0]))
            for batch in table.to_batches(max_chunksize=50_000):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                yield (bytearray(sink.getvalue().to_pybytes()),)

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0):
                    yield from pa.ipc.open_stream(x.as_buffer())

        def joined(items: Iterable) -> Iterator:
            parts = list(items)
            still = next(v[1] for _, v in parts if v[0] is None)
            for block, (state, out) in parts:
                if state is not None:
                    yield block, (still | state, out)

        ensure_checkpoint_dir(self.spark)
        whole = self.rdd if self.still is None else self.rdd.union(self.still).mapPartitions(joined, preservesPartitioning=True)
        final = whole.flatMap(packed)
        final.checkpoint()
        final.count()
        self.rdd.unpersist()
        if self.still is not None:
            self.still.unpersist()
        drop_folder(self.spark, self.folder)
        return self.spark.createDataFrame(final, "data binary").mapInArrow(unpacked, schema)
