"""Encoding of a corpus in which chunks shared by documents are encoded once.

1. Each text is cut where a rolling hash of the preceding bytes says so, hence equal passages are
   cut alike wherever they stand (content-defined chunks).
2. Chunks are put together by their digests and every distinct one is encoded once.  A text stands
   with the first reference of a task only.  A chunk that a task has met ``COMMON`` times is encoded
   in this task too, once, and its further references go to any partition: a passage in a third of
   the corpus is no hot key, as each task sends no more than COMMON references of it to one place.
3. The ids of a document are those of its chunks, joined.  A position with white space after a
   character that is none is a boundary of the tokenizer's words in every context.  So a chunk's
   ids are exact between its first and its last such position, and at a join the text from the
   last one before it to the first one after it is encoded again; a chunk without any such
   position is encoded with its neighbours.  The result agrees exactly with the whole text's.

Defined cases: null and empty texts give an empty list; repeated rows are encoded each (one row in,
one row out); a null id is kept; texts of any length are whole, never prefixes; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZERS, WHITE_SPACE, tokenizer

WINDOW = 32
COMMON = 4
MIN_CHUNK, MAX_CHUNK = 96, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _table() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def cut_points(data: np.ndarray, average: int) -> np.ndarray:
    """Positions p of ``data`` (bytes) where the hash of the WINDOW bytes before p asks for a cut
    and p starts a character after which nothing is split: p itself may be any character start."""
    if len(data) <= WINDOW:
        return np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h, power, width = _table()[data], np.uint64(0x100000001B3), 1
        while width < WINDOW:  # hash of 2w bytes from two hashes of w bytes
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        h = (h ^ (h >> np.uint64(31))) * _MIX
    hit = np.flatnonzero((h[:-1] >> np.uint64(40)) % np.uint64(average) == 0) + WINDOW
    return hit[(data[hit] & 0xC0) != 0x80]


def chunk_spans(data: np.ndarray, average: int) -> list[tuple[int, int]]:
    """Spans that cover ``data``, cut at content-defined points, MIN_CHUNK to MAX_CHUNK bytes long
    (the last may be shorter)."""
    n, at, spans = len(data), 0, []
    cuts = cut_points(data, average).tolist()
    k = 0
    while at < n:
        while k < len(cuts) and cuts[k] < at + MIN_CHUNK:
            k += 1
        to = cuts[k] if k < len(cuts) and cuts[k] <= at + MAX_CHUNK else min(n, at + MAX_CHUNK)
        while to < n and data[to] & 0xC0 == 0x80:
            to -= 1
        spans.append((at, to))
        at = to
    return spans


def hard_boundaries(text: str) -> tuple[int, int]:
    """First and last position with white space after a character that is none; -1 if there is none."""
    first = last = -1
    n = len(text)
    p = 1
    while p < n:
        if text[p] in WHITE_SPACE and text[p - 1] not in WHITE_SPACE:
            first = p
            break
        p += 1
    if first > 0:
        p = n - 1
        while not (text[p] in WHITE_SPACE and text[p - 1] not in WHITE_SPACE):
            p -= 1
        last = p
    return first, last


def _tokens_upto(lengths: np.ndarray, size: int) -> int:
    k = int(np.searchsorted(np.cumsum(lengths), size, side="left")) + 1 if size else 0
    if size and int(lengths[:k].sum()) != size:
        raise AssertionError("a boundary of words lies inside a token")
    return k


def encode_chunk(text: str, tok) -> tuple[list[int], str, int, str, int]:
    """ids; the text before the first hard boundary and its tokens; that after the last and its.
    Without a hard boundary the head is the whole text and the tail has -1 tokens."""
    ids = tok.encode(text)
    first, last = hard_boundaries(text)
    if first < 0:
        return ids, text, len(ids), "", -1
    lengths = tok.lengths[np.asarray(ids)]
    head, tail = text[:first], text[last:]
    n_head = _tokens_upto(lengths, len(head.encode()))
    n_tail = _tokens_upto(lengths[::-1], len(tail.encode()))
    return ids, head, n_head, tail, n_tail


def join_chunks(chunks: list[tuple], tok) -> np.ndarray:
    """The ids of the text that the chunks (ids, head, n_head, tail, n_tail) make up."""
    out: list = []
    pending, known = "", None  # text since the last hard boundary, and its ids if they are exact
    for ids, head, n_head, tail, n_tail in chunks:
        thin = n_tail < 0
        if pending and pending[-1] not in WHITE_SPACE and head[0] in WHITE_SPACE:  # the join is hard itself
            out.append(known if known is not None else tok.encode(pending))
            pending = ""
        if not pending:
            if thin:
                pending, known = head, ids
            else:
                out.append(ids[: len(ids) - n_tail])
                pending, known = tail, ids[len(ids) - n_tail :]
        elif thin:
            pending, known = pending + head, None
        else:
            out.append(tok.encode(pending + head))
            out.append(ids[n_head : len(ids) - n_tail])
            pending, known = tail, ids[len(ids) - n_tail :]
    if pending:
        out.append(known if known is not None else tok.encode(pending))
    return np.concatenate([np.asarray(x, dtype=np.int32) for x in out]) if out else np.empty(0, np.int32)


_CODED = pa.struct([("ids", pa.list_(pa.int32())), ("head", pa.string()), ("n_head", pa.int32()), ("tail", pa.string()), ("n_tail", pa.int32())])
_CODED_DDL = "struct<ids:array<int>,head:string,n_head:int,tail:string,n_tail:int>"
_FIELDS = ("ids", "head", "n_head", "tail", "n_tail")


def _codes(codes: list[tuple | None]) -> pa.Array:
    columns = [pa.array([None if c is None else c[k] for c in codes], f.type) for k, f in enumerate(_CODED)]
    return pa.StructArray.from_arrays(columns, fields=list(_CODED), mask=pa.array([c is None for c in codes]))


def _chunker(average: int, folder: str):
    """References ``id, rid, seq, place, digest, chunk, code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        met: dict[bytes, int] = {}
        known: dict[bytes, tuple] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            size = 0
            for r, text in enumerate(batch.column(0).to_pylist()):
                raw = text.encode() if text else b""
                for seq, (a, b) in enumerate(chunk_spans(np.frombuffer(raw, np.uint8), average) if raw else [(0, 0)]):
                    piece = raw[a:b]
                    digest = xxhash.xxh3_128_digest(piece)
                    n = met[digest] = met.get(digest, 0) + 1
                    place, chunk, code = int.from_bytes(digest[:8], "little", signed=True), None, None
                    if n == 1:
                        chunk = piece.decode()
                    elif n > COMMON:
                        code = known.get(digest) or known.setdefault(digest, encode_chunk(piece.decode(), tokenizer(folder)))
                        place = place + n * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF
                    for column, value in zip(out, (r, seq, place, digest, chunk, code)):
                        column.append(value)
                    size += b - a
                if size > 8 << 20:
                    yield _chunk_batch(batch, out)
                    out, size = ([], [], [], [], [], []), 0
            if out[0]:
                yield _chunk_batch(batch, out)

    return run


def _chunk_batch(batch: pa.RecordBatch, out: tuple) -> pa.RecordBatch:
    row, seq, place, digest, chunk, code = out
    at = pa.array(row, pa.int64())
    columns = [batch.column(1).take(at), batch.column(2).take(at), pa.array(seq, pa.int32()), pa.array(place, pa.int64()), pa.array(digest, pa.binary()), pa.array(chunk, pa.string()), _codes(code)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "rid", "seq", "place", "digest", "chunk", "code"])


def _encoder(folder: str):
    """``id, rid, seq, code`` from references sorted by digest, the one with the text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder)
        last, code = None, None
        for batch in batches:
            ready, new, at = batch.column("code"), [code], []
            chunks, coded = batch.column("chunk"), ready.is_valid().to_pylist()
            for k, digest in enumerate(batch.column("digest").to_pylist()):
                if coded[k]:
                    at.append(-k - 1)
                    continue
                if digest != last:
                    last, code = digest, encode_chunk(chunks[k].as_py(), tok)
                    new.append(code)
                at.append(len(new) - 1)
            both = pa.concat_arrays([_codes(new), ready])
            place = np.asarray(at, np.int64)
            both = both.take(pa.array(np.where(place < 0, len(new) - 1 - place, place)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "rid", "seq")), *both.flatten()], names=["id", "rid", "seq", *_FIELDS])

    return run


def _joiner(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder)
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            flat = lists.values
            ids, heads, n_heads, tails, n_tails = (flat.field(k) for k in ("ids", "head", "n_head", "tail", "n_tail"))
            at, values = np.asarray(ids.offsets), np.asarray(ids.values)
            n_heads, n_tails = n_heads.to_pylist(), n_tails.to_pylist()
            heads, tails = heads.to_pylist(), tails.to_pylist()
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                if b - a == 1:
                    out.append(values[at[a] : at[b]])
                else:
                    out.append(join_chunks([(values[at[k] : at[k + 1]], heads[k], n_heads[k], tails[k], n_tails[k]) for k in range(a, b)], tok))
            sizes = np.cumsum([0, *map(len, out)], dtype=np.int32)
            joined = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(out) if out else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), joined], names=["id", "ids"])

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, average: int = 512) -> DataFrame:
    """``id_col`` and ``ids``, one row for each row of ``docs``.

    Shuffles: the chunk references with the distinct texts of each task, and the coded references
    by document.  A document is one row, so a group is never larger than its text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"))
    refs = rows.mapInArrow(_chunker(average, folder), f"id {id_type}, rid bigint, seq int, place bigint, digest binary, chunk string, code {_CODED_DDL}")
    refs = refs.repartition("place").sortWithinPartitions("digest", F.col("chunk").isNull())
    parts = refs.mapInArrow(_encoder(folder), f"id {id_type}, rid bigint, seq int, ids array<int>, head string, n_head int, tail string, n_tail int")
    parts = parts.groupBy("id", "rid").agg(F.sort_array(F.collect_list(F.struct("seq", *_FIELDS))).alias("chunks"))
    ids = parts.select("id", "chunks").mapInArrow(_joiner(folder), f"id {id_type}, ids array<int>")
    return ids.select(F.col("id").alias(id_col), "ids")
