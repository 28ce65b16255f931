"""The public byte-level tokenizer, read from vocabulary files whose folder is a parameter."""

from __future__ import annotations

import base64
import re
import sys

import numpy as np

#: Folder of the public vocabulary files; they are never copied.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# What ``\s`` matches there (Unicode White_Space).
WHITE_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

LONG_RUN = 2000
_RUNS = re.compile(f"[{''.join(sorted(WHITE_SPACE))}]{{{LONG_RUN},}}")


class Tokenizer:
    """``encode`` gives ids without special tokens: their strings are ordinary text."""

    def __init__(self, folder: str, name: str = "byte_bpe_50k"):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        """Long runs of white space are encoded apart, as the library's pattern matching runs out of
        stack on them: a run is a word of its own up to its last character, or to the text's end."""
        if len(text) < LONG_RUN:
            return self._encoding.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for run in _RUNS.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += self._encoding.encode_ordinary(text[at : run.start()])
            out += self._encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return out + self._encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Tokenizer:
    """One instance per process; Python workers are reused between tasks."""
    kept = sys.__dict__.setdefault("_strandloom_tokenizers", {})
    if (folder, name) not in kept:
        kept[folder, name] = Tokenizer(folder, name)
    return kept[folder, name]
