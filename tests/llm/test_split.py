import pytest

from strandloom.llm.split import split_oversized
from strandloom.llm.tokens import tokenizer

TEXTS = [
    None, "", "short", "word " * 3000, "x" * 9000, "日本語の文章。" * 700, "🙂" * 2500, "Щука и Ёж 𝔘𝔫 ゔ" * 400,
    "\n\n".join("A sentence stands here. Another one follows it! Is it the last?\nA line." for _ in range(200)),
    "Line without end. " * 1000, " " * 6000, "\r\n" * 3000,
]


def test_pieces(spark):
    tok = tokenizer()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int")
    rows = split_oversized(df, limit=256, overlap=16).orderBy("doc_id", "piece_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in enumerate(TEXTS) if t and len(tok.encode(t)) > 256}
    for i, pieces in by.items():
        ids = tok.encode(TEXTS[i])
        assert [p.piece_no for p in pieces] == list(range(pieces[0].n_pieces))
        assert pieces[0].start_token == pieces[0].core_token == 0 and pieces[-1].end_token == len(ids)
        for p, q in zip(pieces, pieces[1:]):
            assert q.core_token == p.end_token and q.core_token - 19 <= q.start_token <= q.core_token - 16
        for p in pieces:
            assert p.end_token - p.start_token <= 256
            assert p.piece == tok.decode(ids[p.start_token : p.end_token]).decode()
            assert len(tok.encode(p.piece)) <= 256 and p.piece in TEXTS[i]
        assert "".join(tok.decode(ids[p.core_token : p.end_token]).decode() for p in pieces) == TEXTS[i]
    paragraphs = by[8]
    assert all(p.piece.endswith("\n\n") or p.piece.endswith("line.") for p in paragraphs[:-1])
    assert all(p.piece.rstrip().endswith(".") for p in by[9][:-1])
    assert all(p.piece.strip().endswith("word") for p in by[3])


def test_short_ones_and_limits(spark):
    df = spark.createDataFrame([(1, "short"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.piece) for r in split_oversized(df, with_short=True).collect()] == [(1, "short")]
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, limit=100, overlap=50)
