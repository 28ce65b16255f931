"""Texts above a token limit cut into overlapping pieces at natural boundaries.

Recursive bisection: a span of more than ``limit - overlap`` tokens is cut at the strongest
boundary of its middle half (end of a paragraph, line, sentence or word, else between characters),
among equally strong ones the nearest to the midpoint, and both halves are cut on.  Afterwards each
piece but the first gets the last ``overlap`` tokens of the one before; where these begin inside a
character (of several tokens), also the one to three tokens before them, so that pieces hold whole
characters only.

Pieces are spans of the tokens of the whole text, so without overlaps they give its ids and its
text again.  A piece of more than ``limit`` tokens, or whose text would take more than ``limit`` tokens if encoded by itself is bisected further.

Defined cases: null, empty and short texts give no piece (``with_short=True``: one piece with all
tokens); repeated rows are cut each; an empty table gives no rows; further columns are ignored.
Narrow: no shuffle, whatever the length of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZERS, tokenizer

_STRENGTHS = (  # strongest first; a boundary is the end of a match
    rb"\n[ \t\r]*\n\s*",
    rb"\n\s*",
    rb"[.!?][\"')\]]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f",
    rb"(?<=\S)(?=\s)",
)


def boundary_strengths(data: bytes, ends: np.ndarray) -> np.ndarray:
    """For each token end (byte offset): 0 inside a character, 1 between characters, 2 at the end
    of a word, 3 of a sentence, 4 of a line, 5 of a paragraph."""
    raw = np.frombuffer(data, np.uint8)
    strength = np.ones(len(ends), dtype=np.int8)
    inner = ends < len(raw)
    strength[inner] = (raw[ends[inner]] & 0xC0) != 0x80
    for k, pattern in enumerate(reversed(_STRENGTHS)):
        spans = np.array([m.span() for m in re.finditer(pattern, data)], dtype=np.int64).reshape(-1, 2)
        at = np.searchsorted(ends, spans[:, 1], side="right") - 1  # the last token that ends in the match
        low = np.minimum(spans[:, 0] + 1, spans[:, 1])
        at = at[(at >= 0) & (ends[at] >= low)]
        at = at[strength[at] > 0]
        strength[at] = k + 2
    return strength


def _cut(strength: np.ndarray, a: int, b: int) -> int:
    """The token after which [a, b) is cut; strength[k] is that of the end of token k.  No cut (b)
    where [a, b) is one character."""
    quarter = max(1, (b - a) // 4)
    low, high = a + quarter, b - quarter
    window = strength[low - 1 : high]
    if not window.any():
        low, window = a + 1, strength[a : b - 1]
        if not window.any():
            return b
    best = np.flatnonzero(window == window.max()) + low
    return int(best[np.argmin(np.abs(2 * best - (a + b)))])


def split_ids(ids: np.ndarray, data: bytes, tok, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece in tokens: ids[start:core] repeat the piece before."""
    n = len(ids)
    if n <= limit:
        return [(0, 0, n)] if n else []
    ends = np.cumsum(tok.lengths[ids])
    strength = boundary_strengths(data, ends)
    room = limit - overlap
    whole = np.concatenate([[0], np.where(strength[:-1] > 0, np.arange(1, n), 0)])  # tokens that begin a character
    begin = np.maximum.accumulate(whole)
    first = lambda a: int(begin[max(0, a - overlap)])
    stack, cores = [(0, n)], []
    while stack:
        a, b = stack.pop()
        m = b
        if b - a > room or (b - a > 1 and (b - first(a) > limit or _too_long(ids, first(a), b, tok, limit))):
            m = _cut(strength, a, b)
        if m < b:
            stack += [(m, b), (a, m)]
        else:
            cores.append((a, b))
    return [(first(a), a, b) for a, b in cores]


def _too_long(ids: np.ndarray, a: int, b: int, tok, limit: int) -> bool:
    """Cut at word ends the text of a span has the span's tokens again; elsewhere rarely more."""
    if b - a <= limit // 2:
        return False
    return len(tok.encode(tok.decode(ids[a:b].tolist()).decode())) > limit


def _splitter(folder: str, limit: int, overlap: int, with_short: bool):
    names = ["id", "piece_no", "n_pieces", "start_token", "core_token", "end_token", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder)
        for batch in batches:
            rows: list[tuple] = []
            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                # a token is a byte at least: what is short in bytes is short in tokens
                data = text.encode() if text else b""
                if not data or (len(data) <= limit and not with_short):
                    continue
                ids = np.asarray(tok.encode(text), dtype=np.int64)
                if len(ids) <= limit and not with_short:
                    continue
                spans = split_ids(ids, data, tok, limit, overlap)
                offset = np.concatenate([[0], np.cumsum(tok.lengths[ids])])
                rows += [(at, k, len(spans), a, c, b, data[offset[a] : offset[b]].decode()) for k, (a, c, b) in enumerate(spans)]
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int32()] * 5 + [pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names=names)

    return run


def split_oversized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, limit: int = 1024, overlap: int = 64, with_short: bool = False) -> DataFrame:
    """``id_col, piece_no`` (from 0)``, n_pieces, start_token, core_token, end_token, piece``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be below half of the limit")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, piece_no int, n_pieces int, start_token int, core_token int, end_token int, piece string"
    return rows.mapInArrow(_splitter(folder, limit, overlap, with_short), schema).withColumnRenamed("id", id_col)
