"""Passages of held-out items that stand in a corpus, by a distributed positional inverted index.

1. The words of every text become postings (document, position, term).  A match of ``n_words``
   successive words lies in a run of words that all occur in some item, so only such runs are
   posted; they are stored once and read by all later steps.
2. Exact phrases: each window of ``n_words`` words of an item is looked up by its rarest terms
   (fewest postings).  The posting lists of the three rarest are intersected at the distances the
   terms have in the item: what is left are places (document, item, offset of one to the other).
   At these places all terms of the item are intersected with the postings, and runs of at least
   ``n_words`` matches are returned.
3. Proximity matches: ``slop`` words may be missing, added or changed between successive matches,
   on either side, so any term may be lost and the offset may change.  Every three successive
   matches are three terms with at most ``slop`` words between two; all such triples of the stored
   postings are met with those of the items (sent to the tasks up to LOOKUPS words, else joined),
   triples outside of chains of ``n_words`` matches are dropped, and the longest chains returned.
   The chains of a document and an item have no match in common.

Defined cases: null, empty and blank texts match nothing, nor do items of fewer than ``n_words``
words; repeated rows of a document or an item give the same results once; words are compared as
``words.plain_words`` says; whole texts of any length are read; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .words import plain_words

#: Up to this many distinct terms of the items are sent to the tasks to post only runs of them;
#: above it the postings are restricted by a shuffled join instead.
VOCABULARY = 500_000
#: Up to this many look-ups (windows' term pairs) are broadcast.
LOOKUPS = 200_000
#: Postings and places of a document meet in bins of so many positions.
BIN = 256
#: Postings held at once, about (whole documents), and matched with the items' triples at once.
SCANNED, SLICE = 50_000, 5_000


def _post(vocabulary, n_words: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value if vocabulary is not None else None
        for batch in batches:
            row, position, term = [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                words = plain_words(text)
                if known is None:
                    runs = [list(enumerate(words))]
                else:
                    runs, last = [], -slop - 2
                    for k, w in enumerate(words):
                        if w in known:
                            if k - last > slop + 1:
                                runs.append([])
                            runs[-1].append((k, w))
                            last = k
                for r in runs:
                    if len(r) >= n_words:
                        row += [at] * len(r)
                        position += [k for k, _ in r]
                        term += [w for _, w in r]
                if len(row) > 500_000:
                    yield _posting_batch(batch, row, position, term)
                    row, position, term = [], [], []
            if row:
                yield _posting_batch(batch, row, position, term)

    return run


def _posting_batch(batch: pa.RecordBatch, row: list, position: list, term: list) -> pa.RecordBatch:
    at = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(position, pa.int32()), pa.array(term, pa.string())], names=["doc", "rid", "pos", "term"])


def _words_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, term`` of all words."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_post(None, 1, 0), f"doc {kind}, rid bigint, pos int, term string")


def _grams(words: DataFrame, keys: list[str], pos: str, q: int, slop: int) -> DataFrame:
    """``keys, at, gram``: the positions of each ``q`` (1 to 3) terms in a row with at most ``slop``
    words between two, and a hash of the terms."""
    ahead = Window.partitionBy(keys[0]).orderBy(pos).rangeBetween(1, max(1, (q - 1) * (slop + 1)))
    near = words.withColumn("near", F.collect_list(F.struct(F.col(pos).alias("p"), F.col("term").alias("t"))).over(ahead))
    after = lambda p: F.filter("near", lambda y: (y["p"] > p) & (y["p"] <= p + slop + 1))
    gram = lambda *x: F.struct(F.array(F.col(pos), *[y["p"] for y in x]).alias("at"), F.xxhash64("term", *[y["t"] for y in x]).alias("gram"))
    if q == 1:
        grams = F.array(gram())
    elif q == 2:
        grams = F.transform(after(F.col(pos)), lambda x: gram(x))
    else:
        grams = F.flatten(F.transform(after(F.col(pos)), lambda x: F.transform(after(x["p"]), lambda y: gram(x, y))))
    return near.select(*keys, F.explode(grams).alias("g")).select(*keys, "g.at", "g.gram")


def _longest_chains(points: set[tuple[int, int]], n_words: int, slop: int) -> Iterator[tuple[int, int, int]]:
    """First positions and length of chains of matches (position in the document, in the item) of
    at least ``n_words``, the longest first; a match is in one chain only."""
    steps = [(d, i) for d in range(1, slop + 2) for i in range(1, slop + 2)]
    while len(points) >= n_words:
        best: dict[tuple[int, int], tuple[int, tuple[int, int] | None]] = {}
        end = None
        for p in sorted(points):
            size, before = 1, None
            for d, i in steps:
                o = (p[0] - d, p[1] - i)
                if o in best and best[o][0] >= size:
                    size, before = best[o][0] + 1, o
            best[p] = (size, before)
            if end is None or size > best[end][0]:
                end = p
        size = best[end][0]
        if size < n_words:
            return
        while end is not None:
            points.discard(first := end)
            end = best[end][1]
        yield *first, size


def _chain(n_words: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, hits in enumerate(batch.column(2)):
                points = {p for h in hits.as_py() for p in zip(h["at"], h["iat"])}
                for x in _longest_chains(points, n_words, slop):
                    row.append(k)
                    found.append(x)
            at = pa.array(row, pa.int64())
            columns = [pa.array([x[c] for x in found], pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc", "item", "doc_pos", "item_pos", "n_matched"])

    return run


class _Grams:
    """All triples of terms of the items with at most ``slop`` words between two, by their code."""

    def __init__(self, words: list[tuple], slop: int):
        """``words``: (row of an item, item, position, term), any order."""
        words = sorted(words, key=lambda w: (w[0], w[2]))
        self.terms = sorted({w[3] for w in words})
        number = {w: k for k, w in enumerate(self.terms)}
        self.items = [w[1] for w in words]
        self.row = np.array([w[0] for w in words], np.int64)
        self.pos = np.array([w[2] for w in words], np.int64)
        term = np.array([number[w[3]] for w in words], np.int64)
        codes, at = _codes(self.row, self.pos, term, len(self.terms), slop)
        order = np.argsort(codes, kind="stable")
        self.codes, self.at = codes[order], at[:, order]


def _codes(row: np.ndarray, pos: np.ndarray, term: np.ndarray, n_terms: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each triple of terms, exact as there are few terms, and the places of the three."""
    n = len(row)
    codes, places = [], []
    near = {}
    for a in range(1, slop + 2):
        near[a] = np.zeros(n, bool)
        if a < n:
            near[a][:-a] = (row[a:] == row[:-a]) & (pos[a:] - pos[:-a] <= slop + 1)
    for a in near:
        for b in near:
            k = np.flatnonzero(near[a])
            k = k[near[b][k + a]]
            codes.append((term[k] * n_terms + term[k + a]) * n_terms + term[k + a + b])
            places.append(np.stack([k, k + a, k + a + b]))
    return (np.concatenate(codes), np.concatenate(places, axis=1)) if codes else (np.empty(0, np.int64), np.empty((3, 0), np.int64))


def _in_chains(start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Which links ``start -> end`` lie on a path of at least ``least`` links; without cycles."""
    alive = np.arange(len(start))
    ahead, back = np.ones(len(start), np.int64), np.ones(len(start), np.int64)
    for turn in range(1, least):
        s, e = start[alive], end[alive]
        keys, at = np.unique(np.concatenate([s, e]), return_inverse=True)
        s, e = at[: len(s)], at[len(s) :]
        best_ahead, best_back = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.maximum.at(best_ahead, s, ahead)
        np.maximum.at(best_back, e, back)
        ahead, back = best_ahead[e] + 1, best_back[s] + 1
        # a length below turn + 1 is final
        keep = (ahead > turn) | (back > turn) | (ahead + back - 1 >= least)
        alive, ahead, back = alive[keep], ahead[keep], back[keep]
        if not len(alive):
            return alive
    return alive[ahead + back - 1 >= least]


def _scan(shared, n_words: int, slop: int):
    """Chains of stored postings, which stand document by document, with the items' triples."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        g = shared.value
        part = pa.Table.from_batches(rows).combine_chunks()
        row, pos = part.column("rid").to_numpy(), part.column("pos").to_numpy().astype(np.int64)
        term = pc.index_in(part.column("term"), value_set=pa.array(g.terms, pa.string())).to_numpy().astype(np.int64)
        width, alive = len(g.items), []
        pair = lambda p, q: p * 64 + (q // width - p // width) * 8 + (q % width - p % width)
        margin = n_words * (slop + 1)  # no chain of n_words reaches further
        for a in range(0, len(row), SLICE):
            first, to = max(0, a - margin), a + SLICE + margin
            codes, at = _codes(row[first:to], pos[first:to], term[first:to], len(g.terms), slop)
            low = np.searchsorted(g.codes, codes, side="left")
            n = np.searchsorted(g.codes, codes, side="right") - low
            k = np.repeat(np.arange(len(codes)), n)
            j = np.repeat(low, n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            points = (at[:, k] + first) * width + g.at[:, j]  # a place in the documents and one in the items
            some = _in_chains(pair(points[0], points[1]), pair(points[1], points[2]), n_words - 2)
            alive.append(np.unique(points[:, some]))
        every = np.unique(np.concatenate(alive))
        if not len(every):
            return None
        d, i = every // width, every % width
        order = np.lexsort((g.row[i], row[d]))
        d, i = d[order], i[order]
        cut = np.flatnonzero((row[d][1:] != row[d][:-1]) | (g.row[i][1:] != g.row[i][:-1])) + 1
        at_row, out = [], []
        for dd, ii in zip(np.split(d, cut), np.split(i, cut)):
            for c in _longest_chains(set(zip(pos[dd].tolist(), g.pos[ii].tolist())), n_words, slop):
                at_row.append(int(dd[0]))
                out.append((g.items[ii[0]], *c))
        if not out:
            return None
        docs = part.column("doc").take(pa.array(at_row)).combine_chunks()
        return pa.RecordBatch.from_arrays([docs, pa.array([x[0] for x in out]), *(pa.array([x[k] for x in out], pa.int32()) for k in (1, 2, 3))], names=["doc", "item", "doc_pos", "item_pos", "n_matched"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = batch.column("rid").to_numpy()
            other = np.flatnonzero(rid != rid[-1])
            last = int(other[-1]) + 1 if len(other) else 0  # where the last document begins
            if size + last > SCANNED:
                ended = not last and held and held[-1].column("rid")[-1].as_py() != rid[0]
                if last or ended:
                    out = found([*held, batch.slice(0, last)])
                    if out is not None:
                        yield out
                    held, size, batch = [], 0, batch.slice(last)
            held.append(batch)
            size += batch.num_rows
        if held and (out := found(held)) is not None:
            yield out

    return run


def _chained(postings: DataFrame, item_words: DataFrame, n_words: int, slop: int) -> DataFrame:
    """``doc, item, doc_pos, item_pos, n_matched`` of proximity matches."""
    q = min(3, n_words)
    in_items = cut_lineage(_grams(item_words, ["iid", "item"], "ipos", q, slop).withColumnRenamed("at", "iat"))
    looked = F.broadcast(in_items) if in_items.count() <= LOOKUPS else in_items
    hits = _grams(postings, ["rid", "doc"], "pos", q, slop).join(looked, "gram")
    # a chain of n_words matches has grams that begin at so many positions
    starts = F.size(F.collect_set(F.get("iat", F.lit(0))))
    pairs = hits.groupBy("doc", "rid", "item", "iid").agg(starts.alias("n"), F.collect_list(F.struct("at", "iat")).alias("hits")).where(F.col("n") >= n_words - q + 1).select("doc", "item", "hits")
    kinds = {c: t for c, t in pairs.dtypes}
    return pairs.mapInArrow(_chain(n_words, slop), f"doc {kinds['doc']}, item {kinds['item']}, doc_pos int, item_pos int, n_matched int")


def leaked_passages(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text", n_words: int = 12, slop: int = 0) -> DataFrame:
    """``doc_col, item_col, doc_pos, item_pos, n_matched``: the runs of matching words, by the
    positions (from 0) of their first words."""
    spark = docs.sparkSession
    item_words = cut_lineage(_words_of(items, item_col, item_text).select(F.col("doc").alias("item"), F.col("rid").alias("iid"), F.col("pos").alias("ipos"), "term"))
    terms = item_words.select("term").distinct()
    n_terms = terms.count()
    vocabulary = None
    if n_terms <= VOCABULARY:
        vocabulary = spark.sparkContext.broadcast(frozenset(r[0] for r in terms.collect()))
    kind = docs.schema[doc_col].dataType.simpleString()
    rows = docs.select(F.col(doc_col).alias("doc"), F.monotonically_increasing_id().alias("rid"), F.col(doc_text).alias("text"))
    postings = rows.mapInArrow(_post(vocabulary, n_words, slop), f"doc {kind}, rid bigint, pos int, term string")
    if vocabulary is None:
        postings = postings.join(terms, "term", "left_semi")
    postings = cut_lineage(postings.select("doc", "rid", "pos", "term"))
    kinds = {c: t for c, t in [*postings.dtypes, *item_words.dtypes]}
    if slop > 0 and vocabulary is not None and n_words > 2 and slop < 7 and item_words.limit(LOOKUPS + 1).count() <= LOOKUPS:
        # the items' triples are sent to the tasks; documents meet them without a shuffle
        grams = spark.sparkContext.broadcast(_Grams([tuple(r) for r in item_words.select("iid", "item", "ipos", "term").collect()], slop))
        schema = f"doc {kinds['doc']}, item {kinds['item']}, doc_pos int, item_pos int, n_matched int"
        found = postings.mapInArrow(_scan(grams, n_words, slop), schema)
        return found.select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "doc_pos", "item_pos", "n_matched").distinct()
    if slop > 0:
        return _chained(postings, item_words, n_words, slop).select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "doc_pos", "item_pos", "n_matched").distinct()
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    # the two rarest terms of each window of each item
    known = item_words.join(frequency, "term")
    in_window = known.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - (n_words - 1)), F.col("ipos"))))
    by_rarity = Window.partitionBy("iid", "w").orderBy("df", "term", "ipos")
    of_window = Window.partitionBy("iid", "w")
    ranked = in_window.withColumn("r", F.row_number().over(by_rarity)).withColumn("found", F.count(F.lit(1)).over(of_window))
    third = n_words > 2
    kept = ranked.where((F.col("r") <= (3 if third else 2)) & (F.col("found") >= n_words))  # words that the corpus lacks end a window
    terms_of = kept.groupBy("iid", "item", "w").agg(F.sort_array(F.collect_list(F.struct(F.col("r") > 2, "ipos", "term"))).alias("t")).where(F.size("t") == (3 if third else 2))
    t = lambda k, f: F.get("t", F.lit(k))[f]
    lookups = cut_lineage(
        terms_of.select(
            "iid", "item", t(0, "ipos").alias("ipos"), t(0, "term").alias("t1"), (t(1, "ipos") - t(0, "ipos")).alias("gap"), t(1, "term").alias("t2"),
            *([(t(2, "ipos") - t(0, "ipos")).alias("gap3"), t(2, "term").alias("t3")] if third else []),
        ).distinct()
    )
    few = lookups.count() <= LOOKUPS
    small = F.broadcast if few else (lambda x: x)

    # intersect the two lists at the distance of the window: only rare terms are paired
    rare = lookups.select(F.col("t1").alias("term")).union(lookups.select("t2")).distinct()
    listed = postings.join(small(rare), "term", "left_semi")
    ahead = Window.partitionBy("rid").orderBy("pos").rangeBetween(1, n_words - 1)
    near = listed.withColumn("near", F.collect_list(F.struct("pos", "term")).over(ahead))
    pairs = near.select("doc", "rid", "pos", F.col("term").alias("t1"), F.explode("near").alias("x")).select("doc", "rid", "pos", "t1", (F.col("x.pos") - F.col("pos")).alias("gap"), F.col("x.term").alias("t2"))
    places = pairs.join(small(lookups), ["t1", "gap", "t2"]).withColumn("shift", F.col("pos") - F.col("ipos"))
    if third:  # and with the list of the window's third term, which chance rarely meets
        also = postings.join(small(lookups.select(F.col("t3").alias("term")).distinct()), "term", "left_semi").select("rid", F.col("pos").alias("pos3"), F.col("term").alias("t3"))
        places = places.withColumn("pos3", F.col("pos") + F.col("gap3")).join(also, ["rid", "pos3", "t3"], "left_semi")
    places = places.select("doc", "rid", "item", "iid", "shift").distinct()

    # the postings within these places that are the item's terms there, and runs of them
    texts = item_words.groupBy("iid").agg(F.sort_array(F.collect_list(F.struct("ipos", "term"))).alias("t")).select("iid", F.col("t.term").alias("words"))
    texts = small(texts) if few else texts
    spans = places.join(texts.select("iid", F.size("words").alias("n")), "iid")
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.col("shift"), F.lit(0)) / BIN), F.floor((F.col("shift") + F.col("n") - 1) / BIN))))
    inside = postings.select("rid", "pos", "term", F.floor(F.col("pos") / BIN).alias("bin")).join(spans, ["rid", "bin"]).withColumn("ipos", F.col("pos") - F.col("shift"))
    matched = inside.where("ipos >= 0 and ipos < n").join(texts, "iid").where(F.get("words", "ipos") == F.col("term")).select("doc", "rid", "item", "iid", "shift", "ipos", "pos")
    along = Window.partitionBy("rid", "iid", "shift").orderBy("ipos")
    steps = matched.withColumn("new", (F.col("ipos") - F.lag("ipos").over(along) > 1).cast("int"))
    runs = steps.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("doc", "rid", "item", "iid", "shift", "run").agg(F.min("pos").alias("doc_pos"), F.min("ipos").alias("item_pos"), F.count(F.lit(1)).alias("n_matched"))
    return found.where(F.col("n_matched") >= n_words).select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "doc_pos", "item_pos", F.col("n_matched").cast("int").alias("n_matched")).distinct()


def leaked_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", **kw) -> DataFrame:
    """``doc_col, item_col``: each document that holds a passage of an item."""
    return leaked_passages(docs, items, doc_col=doc_col, item_col=item_col, **kw).select(doc_col, item_col).distinct()
