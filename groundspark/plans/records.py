"""Linkage, grading and importers over inline records, held against what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundspark.operators import grade, linkage
from groundspark.plans.registry import query

RECORDS = "source string, source_id string, title string, year int, authors array<string>, doi string, venue string, abstract string, url string, work_type string, peer_reviewed string"
ROWS = [
    ("crossref", "c1", "Grounded Models of Plants", 2024, ["Doe, Jane"], "10.1/a", None, None, None, "journal-article", "yes"),
    ("arxiv", "x1", "Grounded models of plants", 2023, ["Jane Doe"], None, None, "An abstract", None, None, "unknown"),
    ("openalex", "o1", "Grounded models for plants", 2024, ["Jane Doe"], None, None, None, None, None, "unknown"),
    ("crossref", "c2", "Another Work", 2020, [], "10.1/b", None, None, None, None, "unknown"),
    ("openalex", "o2", "Another work", 2020, ["A. Person"], "10.1/c", None, None, None, None, "unknown"),
    ("arxiv", "x2", "Preprint with another name", 2020, [], "10.1/b", None, "text", None, None, "unknown"),
]
GRADES = [
    ("INSUFFICIENT: missing", "Yes", "refused"),
    ("error: timeout", "Yes", "error"),
    ("", "Yes", "error"),
    ("Yes, it is not blocked", "yes - guard holds", "correct"),
    ("It is not permitted", "No", "correct"),
    ("Well", "None", "incorrect"),
    ("L1_FIL_PT0301_PV and L1-CAP", "L1_FIL_PT0301_PV, L1-CAP", "correct"),
    ("only l1-cap", "L1_FIL_PT0301_PV, L1-CAP", "partial"),
    ("about 353 kW", "353 kW", "correct"),
    ("353", "353 kW", "incorrect"),
    ("400 kW", "353 kW", "incorrect"),
    ("pressure is low at discharge", "Discharge pressure below limit", "incorrect"),
    ("the discharge pressure is below its limit", "Discharge pressure below limit", "correct"),
    ("anything", "a b c", "unknown"),
]


def _values(columns: str, rows: list[tuple]) -> str:
    text = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


@query(_values("answer, gold, grade", GRADES))
def p_grades(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in GRADES], "answer string, gold string")
    return rows.withColumn("grade", grade.grade(F.col("answer"), F.col("gold")))


_RECORDS = "records(source, source_id, title, year, author, doi, abstract, peer_reviewed) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'" for v in (r[0], r[1], r[2], r[3], (r[4] or [None])[0], r[5], r[7], r[10])) + ")" for r in ROWS) + ")"
#: Works by union of all that agree, over the few records here.
_WORKS = f"""WITH RECURSIVE {_RECORDS}, r AS (SELECT *, row_number() OVER () AS ord, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm,
 CASE WHEN contains(author, ',') THEN lower(string_split(author, ',')[1]) ELSE lower(string_split(author, ' ')[-1]) END AS who,
 CASE WHEN starts_with(source, 'openalex') THEN 6 WHEN starts_with(source, 'arxiv') THEN 8 ELSE 9 END AS place FROM records),
e AS (SELECT a.ord AS x, b.ord AS y FROM r a JOIN r b ON a.doi = b.doi OR (a.norm = b.norm AND NOT coalesce(a.doi <> b.doi, false) AND coalesce(abs(a.year - b.year) <= 1, true) AND coalesce(a.who = b.who, true)) OR a.ord = b.ord),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
w AS (SELECT r.*, (SELECT min(y) FROM reach WHERE reach.x = r.ord) AS work FROM r),
m AS (SELECT work, first(title ORDER BY k) AS title, first(year ORDER BY k) AS year, first(norm ORDER BY k) AS norm, first(source || ':' || source_id ORDER BY k) AS record_id, first(doi ORDER BY k) FILTER (doi IS NOT NULL) AS doi,
 CASE WHEN bool_or(peer_reviewed = 'yes') THEN 'yes' ELSE first(peer_reviewed ORDER BY k) END AS peer_reviewed, string_agg(source || ':' || source_id, ',' ORDER BY source || ':' || source_id) AS ids, count(*) AS n
 FROM (SELECT *, [CASE WHEN peer_reviewed = 'yes' THEN 0 ELSE 1 END, place, -length(coalesce(abstract, '')), ord] AS k FROM w) GROUP BY 1)
"""


@query(_WORKS + "SELECT title, year, coalesce(doi, '-') AS doi, peer_reviewed, ids, n FROM m")
def p_merged_records(spark, sf_dir):
    m = linkage.merged(spark.createDataFrame(ROWS, RECORDS).coalesce(1))
    return m.select("title", "year", F.coalesce("doi", F.lit("-")).alias("doi"), "peer_reviewed", F.array_join("ids", ",").alias("ids"), "n")


@query()
def p_uncertain_pairs(spark, sf_dir):
    """Alike titles of merged works; tests hold it against difflib over all pairs."""
    return linkage.uncertain(linkage.merged(spark.createDataFrame(ROWS, RECORDS).coalesce(1))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ratio")


@query(f"WITH {_RECORDS} SELECT source_id, CASE WHEN NOT regexp_matches(title || ' ' || coalesce(abstract, ''), 'plants an', 'i') THEN 'A1_plants' WHEN NOT regexp_matches(title || ' ' || coalesce(abstract, ''), 'abstract', 'i') THEN 'A2_abstract' ELSE '-' END AS reason FROM records")
def p_screened(spark, sf_dir):
    out = linkage.screened(spark.createDataFrame(ROWS, RECORDS), {"A2_abstract": "abstract", "A1_plants": "plants an", "note": "never asked"})
    return out.select("source_id", F.coalesce("reason", F.lit("-")).alias("reason"))
