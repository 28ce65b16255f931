import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import encode
from strandloom.llm.encode import chunk_spans, encode_chunk, encode_corpus, join_chunks
from strandloom.llm.tokens import tokenizer

TEXTS = [
    None, "", " ", "\n\n", "a", "it's we'll  they'Ve", "<|endoftext|> is text", "x" * 30000, " " * 5000, "日本語の文章" * 900,
    "a b" + " " * 40000 + "c  \n" + "\n" * 30000, "x" + " \t\u3000" * 9000 + "\ny" + " " * 2500 + "'ll", "a\x1cb \x85c​d e", "word " * 4000, "tab\t\tand  \n spaces   " * 300, "🙂🙃" * 700, "'" * 3000 + "ll",
]


def test_every_text_as_if_encoded_whole(spark):
    passage = "The same passage stands in many documents, again and again, without any change at all. " * 12
    texts = TEXTS + [f"{i} {passage}" for i in range(80)] + [passage] * 40
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (0, "again", "x")], "doc_id long, text string, ids string")
    tok = tokenizer()
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in encode_corpus(df.repartition(3), average=256).collect())
    want = [(i, tok.encode(t) if t else []) for i, t in enumerate(texts)] + [(-1, tok.encode("no id")), (0, tok.encode("again"))]
    assert got == sorted(want)
    assert encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "l", " ", "  ", "\n", "'", "'ll", "é", "日", "1", "-", "\x1c", " ", "the", "🙂", "."]), max_size=120))
def test_joins_of_small_chunks(parts):
    tok, text = tokenizer(), "".join(parts)
    raw = text.encode()
    old, encode.MIN_CHUNK, encode.MAX_CHUNK = (encode.MIN_CHUNK, encode.MAX_CHUNK), 3, 17
    try:
        spans = chunk_spans(np.frombuffer(raw, np.uint8), 8)
    finally:
        encode.MIN_CHUNK, encode.MAX_CHUNK = old
    assert b"".join(raw[a:b] for a, b in spans) == raw
    assert join_chunks([encode_chunk(raw[a:b].decode(), tok) for a, b in spans], tok).tolist() == tok.encode(text)


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    tail = rng.integers(97, 123, 20000).astype(np.uint8)
    one, other = chunk_spans(np.concatenate([tail[:777], tail]), 256), chunk_spans(tail, 256)
    ends = {b - 777 for _, b in one} & {b for _, b in other}
    assert len(ends) > 0.9 * len(other)


def test_agrees_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    tok = tokenizer()
    for t in filter(None, TEXTS):
        assert other.encode(t, add_special_tokens=False).ids == tok.encode(t)


def test_very_long_runs():
    tok = tokenizer()
    for text in (" " * 1_000_000, "a" + "\n" * 500_000 + "b", "x" * 1_000_000, "日本" * 200_000):
        assert tok.decode(tok.encode(text)).decode() == text
