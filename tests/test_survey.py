"""Linkage, screening, sheets, the flow and saved pages."""

import difflib
import json
import random
import re
import unicodedata
from itertools import combinations

import pytest

from groundspark.operators import linkage, survey
from groundspark.plans.records import RECORDS
from groundspark.sources import biblio, harvest


def norm(t):
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip()


def who(authors):
    if not authors:
        return None
    name = authors[0].strip()
    return norm(name.split(",")[0] if "," in name else name.split()[-1] if name.split() else "")


def make(rng, n):
    titles = ["Plants and agents", "Plants and Agents!", "Editorial", "Modèle du système", "Modele du systeme", "日本語", "A survey of industrial agents", "A survey of industrial agent"]
    people = [[], ["Müller, J."], ["J. Muller"], ["Jane Doe"], ["Doe, Jane"], ["李"]]
    return [(rng.choice(["arxiv", "ieee", "openalex", "other"]), f"i{k}", rng.choice(titles), rng.choice([None, 2019, 2020, 2021, 2023]), rng.choice(people), rng.choice([None, None, "10.1/a", "10.1/b"]), None, rng.choice([None, "text", "longer text"]), None, None, rng.choice(["yes", "no", "unknown"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_works_are_those_of_pairwise_union(spark, seed):
    rows = make(random.Random(seed), 60)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        same_doi = a[5] is not None and a[5] == b[5]
        title = norm(a[2]) and norm(a[2]) == norm(b[2]) and not (a[5] and b[5] and a[5] != b[5])
        if same_doi or (title and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 1) and (who(a[4]) is None or who(b[4]) is None or who(a[4]) == who(b[4]))):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(top(i), []).append(f"{r[0]}:{r[1]}")
    works = linkage.merged(spark.createDataFrame(rows, RECORDS).coalesce(1)).cache()
    got = works.collect()
    assert sorted(r.ids for r in got) == sorted(sorted(x) for x in want.values())
    by = {f"{r[0]}:{r[1]}": r for r in rows}
    prefer = linkage.PREFERRED
    for r in got:
        members = sorted((by[x] for x in r.ids), key=lambda m: (m[10] != "yes", next((k for k, p in enumerate(prefer) if m[0].startswith(p)), len(prefer)), -len(m[7] or ""), int(m[1][1:])))
        assert r.record_id == f"{members[0][0]}:{members[0][1]}" and r.doi == next((m[5] for m in members if m[5]), None)
        assert r.peer_reviewed == ("yes" if any(m[10] == "yes" for m in members) else members[0][10])
    order = [(r.year or 0, norm(r.title)) for r in got]
    assert order == sorted(order)

    pairs, first = set(), {}
    for r in sorted(got, key=lambda r: r.ord):
        key = (r.year, norm(r.title))
        if key in first and not (r.doi and first[key].doi and r.doi != first[key].doi):
            pairs.add((*sorted((first[key].record_id, r.record_id)), 1.0))
        first.setdefault(key, r)
    for a, b in combinations(got, 2):
        ta, tb = sorted((norm(a.title), norm(b.title)))
        if a.year == b.year and ta != tb and ta.split()[:1] == tb.split()[:1] and not (a.doi and b.doi and a.doi != b.doi):
            ratio = difflib.SequenceMatcher(None, ta, tb).ratio()
            if ratio >= 0.93:
                pairs.add((*sorted((a.record_id, b.record_id)), round(ratio, 3)))
    assert {(*sorted((r.a, r.b)), r.ratio) for r in linkage.uncertain(works).collect()} == pairs and pairs


def test_survey_steps(spark):
    rows = [("ieee", "1", "A survey of industrial agents", 2022, ["Doe"], None, None, "digital twin validation", None, None, "yes"), ("arxiv", "2", "Survey of cooking", 2021, [], None, None, None, None, None, "no"), ("arxiv", "3", "Industrial review of ontologies", 2023, [], None, "V", "retracted", None, None, "unknown"), ("arxiv", "4", "Nothing", 2020, [], None, None, "industrial", None, None, "no")]
    out = survey.run(spark.createDataFrame(rows, RECORDS).coalesce(1), {"A1": "survey|industr", "other": "never"}, 0.5, 7)
    assert [r.title for r in out["shortlist"].collect()] == ["A survey of industrial agents", "Industrial review of ontologies"]
    assert [r.topic_overlap for r in out["shortlist"].collect()] == [4, 2] and out["candidates"].count() == 3 and out["excluded"].count() == 0
    sheet = out["sheet"].cache()
    assert sheet.columns == survey.TITLE_ABSTRACT and sheet.where("double_code = 'yes'").count() == 2
    old = sheet.withColumns({"final_decision": survey.F.when(survey.F.col("record_id") == "ieee:1", "include").otherwise("exclude"), "double_code": survey.F.lit("no"), "title": survey.F.lit("old")})
    again = survey.title_abstract_sheet(out["kept"], 0.5, 7, old).cache()
    assert again.where("double_code = 'no' and title <> 'old'").count() == 4 and again.where("final_decision = 'include'").count() == 1
    full = survey.full_text_sheet(again, 1.0, 7)
    assert [(r.record_id, r.final_decision, r.double_code) for r in full.collect()] == [("ieee:1", "", "yes")]
    counts = survey.flow(out["identified"], again, full)
    assert (counts["identified"], counts["duplicates_removed"], counts["ta_excluded"], counts["ft_sought"], counts["ft_pending"], counts["complete"]) == (4, 0, 3, 1, 1, False)
    assert "Records identified: 4" in survey.flow_diagram(counts)
    with pytest.raises(ValueError):
        survey.flow(out["identified"].limit(0), again, full)
    files = spark.createDataFrame([("ieee_F1.csv",), ("scopus-R1 (2).csv",), ("F12.csv",)], "name string")
    assert {r.name: r.family for r in survey.family_of(files, ["F1_agents", "R1_related"]).collect()} == {"ieee_F1.csv": "F1_agents", "scopus-R1 (2).csv": "R1_related", "F12.csv": None}
    codes = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "b")], "id int, x string, y string")
    assert tuple(survey.agreement(codes, "x", "y").first()) == (2, 0.5) and [tuple(r) for r in survey.disagreements(codes, "id", "x", "y").collect()] == [(2, "a", "b")]


def test_saved_pages(spark, tmp_path):
    openalex = {"meta": {"count": 2}, "results": [{"id": "https://openalex.org/W1", "title": " A work ", "publication_year": 2024, "type": "article", "doi": "https://doi.org/10.1/X", "authorships": [{"author": {"display_name": "Jane"}}], "primary_location": {"source": {"display_name": "J", "type": "journal"}}, "abstract_inverted_index": {"two": [1], "one": [0]}}, {"id": "https://openalex.org/W2", "title": None, "type": "article", "primary_location": {"source": {"type": "repository"}}}]}
    crossref = {"message": {"total-results": 2, "items": [{"DOI": "10.2/Y", "title": ["Of  things"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2023, 5]]}, "container-title": ["K"], "abstract": "<p>An <b>abstract</b></p>", "type": "posted-content", "URL": "u"}, {"DOI": "10.2/Z", "title": []}]}}
    semantic = {"total": 1, "data": [{"paperId": "p1", "title": "T", "year": 2022, "authors": [{"name": "N"}], "externalIds": {"DOI": "10.3/Q"}, "venue": "V", "abstract": None, "url": "u", "publicationTypes": ["JournalArticle", "Review"]}]}
    atom = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:a="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.1v2</id><published>2024-01-02T00:00:00Z</published><title>On
      agents</title><summary>Some   text</summary><author><name>X Y</name></author><author><name>Z</name></author><a:doi>10.4/W</a:doi></entry>
      <entry><id>http://arxiv.org/abs/1901.1</id><published>2019-01-02T00:00:00Z</published><title>Old</title></entry></feed>"""
    for source, name, body in (("openalex", "page_000.json", json.dumps(openalex)), ("crossref", "page_000.json", json.dumps(crossref)), ("semanticscholar", "page_000.json", json.dumps(semantic)), ("arxiv", "page_000.xml", atom)):
        (tmp_path / "raw" / source / "F1" / "q0").mkdir(parents=True)
        (tmp_path / "raw" / source / "F1" / "q0" / name).write_text(body)
    (tmp_path / "protocol.json").write_text(json.dumps({"search_families": [{"id": "F1", "queries": {"openalex": "q", "crossref": ["q"], "semanticscholar": "q", "arxiv": "q", "nowhere": "q"}}, {"id": "F2", "queries": {"openalex": ["a", "b"]}}], "harvest": {"max_records_per_query": 50, "max_records_arxiv": 10}}))
    asked = harvest.queries(spark, str(tmp_path / "protocol.json"))
    assert {(r.family, r.source, r.position): r.most for r in asked.collect()}["F1", "arxiv", 0] == 10 and asked.count() == 7
    records, log = harvest.run(spark, asked, str(tmp_path / "raw"), (2020, 2030))
    got = {r.source_id: r for r in records.collect()}
    assert set(got) == {"W1", "W2", "10.2/y", "p1", "2401.1v2"}
    assert (got["W1"].title, got["W1"].abstract, got["W1"].doi, got["W1"].peer_reviewed, got["W1"].authors) == ("A work", "one two", "10.1/x", "yes", ["Jane"]) and got["W2"].peer_reviewed == "no"
    assert (got["10.2/y"].title, got["10.2/y"].authors, got["10.2/y"].abstract, got["10.2/y"].year, got["10.2/y"].peer_reviewed) == ("Of things", ["A B", "C"], "An abstract", 2023, "no")
    assert (got["p1"].work_type, got["p1"].peer_reviewed) == ("JournalArticle,Review", "yes")
    assert (got["2401.1v2"].title, got["2401.1v2"].authors, got["2401.1v2"].doi, got["2401.1v2"].abstract) == ("On agents", ["X Y", "Z"], "10.4/w", "Some text")
    assert sorted((e["source"], e["status"]) for e in log) == [("arxiv", "ok"), ("crossref", "ok"), ("nowhere", "failed"), ("openalex", "failed"), ("openalex", "failed"), ("openalex", "ok"), ("semanticscholar", "ok")]
    failed = harvest.failures(spark.createDataFrame([(e["family"], e["source"], e["status"]) for e in log], "family string, source string, status string")).first()
    assert (failed.failed_sources, failed.families) == (["nowhere", "openalex"], 2)
    harvest.write_lines(records, str(tmp_path / "lines"))
    assert harvest.read_lines(spark, str(tmp_path / "lines"), "source_id string, authors array<string>, none string").where("source_id = 'p1'").first().authors == ["N"]
    harvest.write_table(records, str(tmp_path / "table"), ["source_id", "title", "note"])
    assert {(r.source_id, r.note) for r in harvest.read_table(spark, str(tmp_path / "table")).collect()} == {(k, "") for k in got}


def test_bibtex_grammar():
    text = """@string{ J = "Journal of " # {Things} } junk @article(k1, title = "A {B} C" # { and D}, journal = J, year = 2020,, note = {x, y = z})
    @Preamble{"x"} @book{k2, title={One {Two {Three}}}, title={Last}, author={A and B}} @misc{broken, title={never ends"""
    one, two, three = biblio.bibtex_entries(text)
    assert one == {"entry": "article", "title": "A B C and D", "journal": "Journal of Things", "year": "2020", "note": "x, y = z"}
    assert two == {"entry": "book", "title": "Last", "author": "A and B"} and three["title"] == "never ends"


def test_encodings_and_unknown_exports(spark, tmp_path):
    (tmp_path / "a.ris").write_bytes("TY  - JOUR\r\nTI  - Über\r\nER  - \r\n".encode("utf-16"))
    (tmp_path / "b.csv").write_bytes("\ufeffTitle,DT,Content Type\nOne,,Journal\n".encode())
    (tmp_path / "c.doc").write_text("x")
    assert biblio.read(spark, str(tmp_path / "a.ris"), "s").first().title == "Über"
    assert biblio.read(spark, str(tmp_path / "b.csv"), "s").first().peer_reviewed == "yes"
    with pytest.raises(ValueError):
        biblio.read(spark, str(tmp_path / "c.doc"), "s")
