import random

import pytest

from strandloom.llm import leaks
from strandloom.llm.leaks import leaked_items, leaked_passages
from strandloom.llm.words import plain_words


@pytest.mark.parametrize(
    "text, words",
    [
        (None, []), ("", []), (" \n", []), ("… -- !", []),
        ("The Gl⁠aCier", ["the", "glacier"]), ("wi­nd​mill", ["windmill"]), ("ﬁne Ｆｕｌｌ １２", ["fine", "full", "12"]),
        ("[b]in[/b] [color=red]a[/color] [i]b[/i]c", ["in", "a", "bc"]), ("a<br>b <i>c</i>d", ["a", "b", "cd"]),
        ("> x\n> > y &quot;z&quot;&nbsp;w &lt;b&gt;v", ["x", "y", "z", "w", "v"]), ("don't “stop”", ["dont", "stop"]), ("1 < 2 [1] a", ["1", "2", "1", "a"]),
        ("STRASSE straße", ["strasse", "strasse"]), ("{{attach:3}} k", ["k"]), ("a <!-- b <i> --> c <!-- d", ["a", "c", "d"]), ("<!--" * 50000 + "x", ["x"]),
    ],
)
def test_words(text, words):
    assert plain_words(text) == words


def brute(docs, items, n):
    out = set()
    for i, t in items:
        w = plain_words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, x in docs:
            v = plain_words(x)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("vocabulary", [leaks.VOCABULARY, 0])
def test_against_brute_force(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(leaks, "VOCABULARY", vocabulary)
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(25)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "w1 " * 20)]
    items.append((93, items[0][1]))  # the same passage in two items
    docs = []
    for d in range(120):
        words = rnd.choices([*vocab, "other", "more"], k=rnd.randrange(0, 60))
        if rnd.random() < 0.5:
            src = plain_words(rnd.choice(items)[1])
            a, n = rnd.randrange(max(1, len(src))), rnd.randrange(1, 20)
            words[10:10] = [w.upper() + rnd.choice(["", ".", "<br>", "​"]) for w in src[a : a + n]]
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "w1 " * 300), docs[3]]
    dd = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, pos int").repartition(3)
    ii = spark.createDataFrame([(*i, "t") for i in items], "item_id long, text string, term string")
    got = [tuple(r) for r in leaked_items(dd, ii, n_words=6).collect()]
    want = brute(docs, items, 6)
    assert sorted(got) == sorted(want) and len(want) > 20
    spans = leaked_passages(dd, ii, n_words=6).collect()
    by_doc, by_item = dict(docs), dict(items)
    for r in spans:
        assert plain_words(by_doc[r.doc_id])[r.doc_pos : r.doc_pos + r.n_matched] == plain_words(by_item[r.item_id])[r.item_pos : r.item_pos + r.n_matched]
    assert leaked_items(dd.limit(0), ii).count() == 0 and leaked_items(dd, ii.limit(0)).count() == 0


def test_changed_words(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item.replace("five", "changed")), (2, item.replace("four five six", "a b c")), (3, item)]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.doc_id, r.n_matched) for r in leaked_passages(dd, ii, n_words=8, slop=1).collect()} == {(1, 9), (3, 10)}
    assert {r.doc_id for r in leaked_items(dd, ii, n_words=8).collect()} == {3}


def longest(v, w, slop):
    """The most matches in a chain with at most ``slop`` words between two, on both sides."""
    best = {}
    for a in range(len(v)):
        for b in range(len(w)):
            if v[a] == w[b]:
                best[a, b] = 1 + max((best.get((a - x, b - y), 0) for x in range(1, slop + 2) for y in range(1, slop + 2)), default=0)
    return max(best.values(), default=0)


def test_proximity_of_rare_changed_words(spark):
    """The rarest terms of every window are changed in one copy, or lie beyond its part."""
    w = [f"w{k}" for k in range(30)]
    part = ["x" if k in (8, 17) else w[k] for k in range(23)]
    less = [x for k, x in enumerate(w[:20]) if k not in (5, 11)]  # missing words change the offset
    docs = [(1, " ".join(w)), (2, " ".join(part)), (3, " ".join(less))]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    assert {tuple(r)[::4] for r in leaked_passages(dd, ii, n_words=12, slop=2).collect()} == {(1, 30), (2, 21), (3, 18)}


@pytest.mark.parametrize("n_words, slop", [(6, 2), (2, 1)])
def test_proximity_against_brute_force(spark, n_words, slop):
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(4, 30)))) for i in range(20)]
    docs = []
    for d in range(80):
        src = rnd.choice(items)[1].split()
        kept = [x for y in src for x in rnd.choice([[y]] * 6 + [["other"], [], [y, "more"]])]
        docs.append((d, " ".join([*rnd.choices(vocab, k=5), *kept, *rnd.choices(vocab, k=5)])))
    want = {(d, i): n for d, x in docs for i, t in items if (n := longest(x.split(), t.split(), slop)) >= n_words}
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in leaked_passages(dd, ii, n_words=n_words, slop=slop).collect():
        got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), r.n_matched)
    assert got == want and len(want) > 20
