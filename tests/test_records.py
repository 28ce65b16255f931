import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.operators.periods import covered, periods_and_gaps
from strandloom.operators.weighted import heavy_keys, key_profile, weighted_percentiles
from strandloom.sources.raw_records import load_records, rejected_records, valid_records

GTF = 'chr1\thavoc\tgene\t10\t20\t.\t+\t.\tgene_id "A"; level 2;'
GTF_CASES = {
    GTF: None,
    GTF + "\r": None,
    GTF[:-1]: None,
    GTF.replace('"A"', '"a; b"'): None,
    GTF.replace("\t10\t", "\t0\t"): "start_too_small",
    GTF.replace("\t10\t", "\t20\t"): None,
    GTF.replace("\t10\t", "\t21\t"): "start_after_end",
    GTF.replace("\t10\t", "\t+10\t"): "start_not_digits",
    GTF.replace("\t20\t", "\t20.0\t"): "end_not_digits",
    GTF.replace("\t20\t", "\t2147483648\t"): "position_too_large",
    GTF.replace("\t20\t", "\t0000000000020\t"): None,
    GTF.replace("\t10\t", "\t１０\t"): "start_not_digits",
    GTF + "\tx": "field_count",
    GTF.replace('"A"', '"A'): "attributes_quoting",
    GTF.replace('"A"', "A"): "attributes_form",
    GTF.replace("gene_id ", "gene_id  "): "attributes_quoting",
    GTF + " ": "attributes_quoting",
    "# a comment": "none",
    "": "none",
    "\r": "none",
    None: "null_line",
}
BED_CASES = {
    "chr1\t0\t5\tx": None,
    "chr1\t0\t5\t": None,
    'chr1\t0\t5\t"a\tb"': None,
    'chr1\t0\t5\t"a ""b"""': None,
    'chr1\t0\t5\t"a" x': "name_quoting",
    'chr1\t0\t5\ta"b': "name_quoting",
    "chr1\t0\t5\ta\tb": "field_count",
    "chr1\t5\t5\ta": "start_after_end",
    "chr1\t-1\t5\ta": "start_not_digits",
    "chr1\t1\t5": "field_count",
    "track name=x": "none",
    "browser position": "none",
    "#x": "none",
}


@pytest.mark.parametrize("fmt, cases", [("gtf", GTF_CASES), ("bed", BED_CASES)])
def test_each_case_alone_and_in_blocks(spark, fmt, cases):
    rows = [(k * 100 + j, line, 7) for k in range(5) for j, line in enumerate(cases)]
    df = spark.createDataFrame(rows, "line_id long, line string, score int").repartition(2)
    loaded = load_records(df, fmt)
    got = {r.line_id % 100: r.reason for r in rejected_records(loaded).collect()}
    assert got == {j: why for j, why in enumerate(cases.values()) if why not in (None, "none")}
    ok = valid_records(loaded)
    assert ok.count() == 5 * sum(why is None for why in cases.values())
    assert ok.where("start is null or end is null").count() == 0
    assert load_records(df.limit(0), fmt).count() == 0
    with pytest.raises(ValueError):
        load_records(df, fmt, keep=("start",))


def brute_periods(rows):
    by = defaultdict(list)
    for e, s, t in rows:
        if None not in (e, s, t) and t > s:
            by[e].append((s, t))
    out = Counter()
    for e, spans in by.items():
        spans.sort()
        merged = []
        for s, t in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out.update((e, "period", s, t) for s, t in merged)
        out.update((e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]))
    return out


@pytest.mark.parametrize("kind", ["int", "bigint"])
@pytest.mark.parametrize("block", [250_000, 7])
def test_periods_whole_and_in_blocks(spark, kind, block):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaaaab"), s := rnd.randrange(600), s + rnd.choice([0, 1, 2, 5, 9, -3, 200 if rnd.random() < 0.02 else 3])) for _ in range(400)]
    rows += [("a", 300, 305)] * 50 + [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("one", 4, 5), ("t", 1, 3), ("t", 3, 6), ("n", -9, -4), ("n", -5, -1), ("n", 2, 2147483647)]
    df = spark.createDataFrame(rows, f"e string, start {kind}, end {kind}").withColumn("kind", F.lit("clash"))
    got = Counter(tuple(r) for r in periods_and_gaps(df, ["e"], rows_per_block=block).collect())
    assert got == brute_periods(rows)
    want = defaultdict(int)
    for (e, kind_, a, b), n in brute_periods(rows).items():
        if kind_ == "period":
            want[e] += b - a
    assert {r.e: r.covered for r in covered(df, ["e"], rows_per_block=block).collect()} == want
    assert periods_and_gaps(df.limit(0), ["e"]).count() == 0


def test_dense_locus_is_cut(spark):
    """Nearly all starts of an entity in a small part of its range."""
    rows = [("a", k % 1500, k % 1500 + 1 + k % 3) for k in range(0, 6000, 2)] + [("a", 10**9, 10**9 + 5), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "e string, start int, end int")
    assert Counter(tuple(r) for r in periods_and_gaps(df, ["e"], rows_per_block=500).collect()) == brute_periods(rows)
    cut = df.repartitionByRange(12, "e", "start").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in cut) < 1000


def test_weighted_results(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["x", "x", "x", "y", None]), rnd.choice([None, 1, 2, 3, 5000, 9000]), rnd.choice("pq")) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, n string")
    got = {r.k: r for r in key_profile(df.drop("n"), ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        values = [v for q, v, _ in rows if q == k and v is not None]
        c = Counter(values)
        mode = min(c, key=lambda v: (-c[v], v))
        assert (got[k].n_rows, got[k].n_values, got[k].n_distinct, got[k].mode, got[k].mode_rows) == (sum(q == k for q, _, _ in rows), len(values), len(c), mode, c[mode])
    for r in weighted_percentiles(df, ["k"], "v", [0.0, 0.5, 0.9, 1.0]).collect():
        values = sorted(v for q, v, _ in rows if q == r.k and v is not None)
        assert r.value == values[max(1, -(-int(r.prob * 10) * len(values) // 10)) - 1]
    heavy = {tuple(r) for r in heavy_keys(df, {"k": 0.3, "n": 0.4}).collect()}
    c = Counter(r[0] for r in rows)
    assert heavy == {("k", k) for k in c if k and c[k] >= 90} | {("n", "p"), ("n", "q")}
    assert key_profile(df.limit(0), ["k"], "v").count() == 0
    assert heavy_keys(df.limit(0), {"k": 0.3, "n": 0.4}).count() == 0
