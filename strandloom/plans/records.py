"""Queries of the general data problems 1, 4 and 5 over their whole tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import covered, periods_and_gaps
from ..operators.weighted import heavy_keys, key_profile, weighted_percentiles
from ..session import table
from ..sources.raw_records import load_records, rejected_records, valid_records

Query = Callable[[SparkSession, str], DataFrame]


def _rejects(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    return rejected_records(load_records(table(spark, d, fmt), fmt)).withColumn("src", F.lit(fmt))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _rejects(spark, d, "gtf").unionByName(_rejects(spark, d, "bed")).select("src", "line_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _rejects(spark, d, "gtf").unionByName(_rejects(spark, d, "bed")).groupBy("src", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def p1_gtf_records(spark: SparkSession, d: str) -> DataFrame:
    return valid_records(load_records(table(spark, d, "gtf"), "gtf"))


def p1_bed_records(spark: SparkSession, d: str) -> DataFrame:
    return valid_records(load_records(table(spark, d, "bed"), "bed"))


CELL = ["sample_id", "cell_id", "chr"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "fragments"), CELL)


def p4_covered(spark: SparkSession, d: str) -> DataFrame:
    return covered(table(spark, d, "fragments"), CELL)


def p4_chr_covered(spark: SparkSession, d: str) -> DataFrame:
    """Few entities with very many rows each."""
    return covered(table(spark, d, "fragments"), ["chr"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "fragments"), {"cell_id": 0.02, "chr": 0.08})


def p5_cell_profile(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragments").select("cell_id", (F.col("end").cast("bigint") - F.col("start")).alias("frag_len"))
    return key_profile(f, ["cell_id"], "frag_len")


def p5_chr_profile(spark: SparkSession, d: str) -> DataFrame:
    return key_profile(table(spark, d, "fragments").select("chr", "cell_id"), ["chr"], "cell_id")


def p5_chr_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return weighted_percentiles(table(spark, d, "fragments").select("chr", "start"), ["chr"], "start", [0.0, 0.1, 0.5, 0.9, 1.0])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_reasons, p1_gtf_records, p1_bed_records, p4_found, p4_covered, p4_chr_covered, p5_found, p5_cell_profile, p5_chr_profile, p5_chr_percentiles)
}

_ATTR = r"""[^ ";]+ ([0-9]+|"[^"]*")(; [^ ";]+ ([0-9]+|"[^"]*"))*;?"""
_LINES = r"""
gtf_l AS (SELECT line_id, line AS raw, regexp_replace(line, '\r$', '') AS l FROM gtf),
gtf_f AS (SELECT *, string_split(l, chr(9)) AS f FROM gtf_l WHERE l IS NULL OR NOT (regexp_full_match(l, '\s*') OR starts_with(l, '#'))),
gtf_p AS (SELECT *, CASE WHEN len(f) = 9 AND regexp_full_match(f[4], '[0-9]+') AND regexp_full_match(f[5], '[0-9]+')
   THEN f[4]::HUGEINT >= 1 AND f[4]::HUGEINT <= f[5]::HUGEINT AND f[5]::HUGEINT <= 2147483647 AND regexp_full_match(f[9], 'ATTR') ELSE false END AS ok FROM gtf_f),
bed_l AS (SELECT line_id, line AS raw, regexp_replace(line, '\r$', '') AS l FROM bed),
bed_f AS (SELECT *, regexp_extract(l, '^([^\t]*)\t([0-9]+)\t([0-9]+)\t([^"\t]*|"(?:[^"]|"")*")$', ['c', 's', 'e', 'n']) AS f,
   regexp_matches(l, '^([^\t]*)\t([0-9]+)\t([0-9]+)\t([^"\t]*|"(?:[^"]|"")*")$') AS m
   FROM bed_l WHERE l IS NULL OR NOT (regexp_full_match(l, '\s*') OR starts_with(l, '#') OR starts_with(l, 'track') OR starts_with(l, 'browser'))),
bed_p AS (SELECT *, CASE WHEN m THEN f.s::HUGEINT < f.e::HUGEINT AND f.e::HUGEINT <= 2147483647 ELSE false END AS ok FROM bed_f)
""".replace("ATTR", _ATTR)
_OK = '''ok AS (SELECT DISTINCT sample_id, cell_id, chr, start, "end" AS e FROM fragments
 WHERE sample_id IS NOT NULL AND cell_id IS NOT NULL AND chr IS NOT NULL AND start IS NOT NULL AND "end" > start)'''
_ISLANDS = """
r AS (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS g FROM r),
p AS (SELECT {k}, g, min(start) AS f, max(e) AS t FROM i GROUP BY {k}, g)"""
_CELL_ISLANDS = _ISLANDS.format(k="sample_id, cell_id, chr")

SQL: dict[str, str] = {
    "p1_found": f"WITH {_LINES} SELECT 'gtf' AS src, line_id FROM gtf_p WHERE NOT coalesce(ok, false) UNION ALL SELECT 'bed', line_id FROM bed_p WHERE NOT coalesce(ok, false)",
    "p1_reasons": f"""WITH {_LINES}, g AS (SELECT 'gtf' AS src, CASE WHEN l IS NULL THEN 'null_line' WHEN len(f) <> 9 THEN 'field_count'
 WHEN NOT regexp_full_match(f[4], '[0-9]+') THEN 'start_not_digits' WHEN NOT regexp_full_match(f[5], '[0-9]+') THEN 'end_not_digits' WHEN f[4]::HUGEINT < 1 THEN 'start_too_small'
 WHEN greatest(f[4]::HUGEINT, f[5]::HUGEINT) > 2147483647 THEN 'position_too_large' WHEN f[4]::HUGEINT > f[5]::HUGEINT THEN 'start_after_end'
 WHEN contains(f[9], '"') THEN 'attributes_quoting' ELSE 'attributes_form' END AS reason FROM gtf_p WHERE NOT coalesce(ok, false)),
 s AS (SELECT *, string_split(l, chr(9)) AS p FROM bed_p WHERE NOT coalesce(ok, false)),
 b AS (SELECT 'bed' AS src, CASE WHEN l IS NULL THEN 'null_line' WHEN len(p) < 4 THEN 'field_count' WHEN NOT regexp_full_match(p[2], '[0-9]+') THEN 'start_not_digits'
 WHEN NOT regexp_full_match(p[3], '[0-9]+') THEN 'end_not_digits' WHEN greatest(p[2]::HUGEINT, p[3]::HUGEINT) > 2147483647 THEN 'position_too_large'
 WHEN p[2]::HUGEINT >= p[3]::HUGEINT THEN 'start_after_end' WHEN len(p) > 4 AND NOT starts_with(p[4], '"') THEN 'field_count' ELSE 'name_quoting' END AS reason FROM s)
 SELECT src, reason, count(*) AS n_lines FROM (FROM g UNION ALL FROM b) GROUP BY ALL""",
    "p1_gtf_records": f"""WITH {_LINES} SELECT line_id, f[1] AS chr, f[2] AS source, f[3] AS feature, f[4]::INT AS start, f[5]::INT AS "end",
 f[6] AS score, f[7] AS strand, f[8] AS frame, f[9] AS attributes FROM gtf_p WHERE ok""",
    "p1_bed_records": f'WITH {_LINES} SELECT line_id, f.c AS chr, f.s::INT AS start, f.e::INT AS "end", f.n AS name FROM bed_p WHERE ok',
    "p4_found": f"""WITH {_OK}, {_CELL_ISLANDS}
 SELECT sample_id, cell_id, chr, 'period' AS kind, f AS from_pos, t AS to_pos FROM p
 UNION ALL SELECT * FROM (SELECT sample_id, cell_id, chr, 'gap', t, lead(f) OVER (PARTITION BY sample_id, cell_id, chr ORDER BY f) AS n FROM p) WHERE n IS NOT NULL""",
    "p4_covered": f"WITH {_OK}, {_CELL_ISLANDS} SELECT sample_id, cell_id, chr, count(*) AS n_periods, sum(t - f)::BIGINT AS covered FROM p GROUP BY ALL",
    "p4_chr_covered": f"""WITH ok AS (SELECT DISTINCT chr, start, "end" AS e FROM fragments WHERE chr IS NOT NULL AND start IS NOT NULL AND "end" > start), {_ISLANDS.format(k='chr')}
 SELECT chr, count(*) AS n_periods, sum(t - f)::BIGINT AS covered FROM p GROUP BY ALL""",
    "p5_found": """SELECT 'cell_id' AS field_name, cell_id AS key_value FROM fragments WHERE cell_id IS NOT NULL GROUP BY cell_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM fragments)
 UNION ALL SELECT 'chr', chr FROM fragments WHERE chr IS NOT NULL GROUP BY chr HAVING count(*) >= 0.08 * (SELECT count(*) FROM fragments)""",
    "p5_cell_profile": """WITH v AS (SELECT cell_id, "end"::BIGINT - start AS x, count(*) AS n FROM fragments GROUP BY ALL)
 SELECT cell_id, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (x IS NOT NULL), 0)::BIGINT AS n_values, count(x) AS n_distinct,
 first(x ORDER BY n DESC, x) FILTER (x IS NOT NULL) AS mode, max(n) FILTER (x IS NOT NULL) AS mode_rows FROM v GROUP BY cell_id""",
    "p5_chr_profile": """WITH v AS (SELECT chr, cell_id AS x, count(*) AS n FROM fragments GROUP BY ALL)
 SELECT chr, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (x IS NOT NULL), 0)::BIGINT AS n_values, count(x) AS n_distinct,
 first(x ORDER BY n DESC, x) FILTER (x IS NOT NULL) AS mode, max(n) FILTER (x IS NOT NULL) AS mode_rows FROM v GROUP BY chr""",
    "p5_chr_percentiles": """SELECT chr, prob, min(start) AS value FROM (SELECT chr, start, row_number() OVER (PARTITION BY chr ORDER BY start) AS r, count(*) OVER (PARTITION BY chr) AS c FROM fragments WHERE start IS NOT NULL),
 (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0])::DOUBLE AS prob) WHERE r >= greatest(1, ceil(prob * c)) GROUP BY chr, prob""",
}
