from groundspark.operators import rules
from groundspark.sources import biblio
from groundspark.streaming.gate import gate

RIS = """TY  - JOUR
TI  - First title
AU  - Doe, Jane
AU  - Roe, Max
PY  - 2021/03
DO  - https://doi.org/10.5/ABC
ER  - 

TY  - BOOK
T1  - Second
ER  - 
TY  - JOUR
AU  - No Title
ER  - 
"""
BIB = """@comment{x} @article{k1, title = {A {Nested} Title}, author = {Jane Doe and Max Roe}, year = 2019, journal="Some, Journal", doi={10.1/x}}
@inproceedings{k2, title={Two
  lines}, year={2020}, booktitle={Conf}}
@misc{k3, year=1999}"""


def test_exports(spark, tmp_path):
    for name, body in (("a.ris", RIS), ("b.bib", BIB), ("c.csv", "Document Title,Authors,Publication Year,DOI\n\"One, two\",\"Doe; Roe\",2020,10.2/Y\n,x,2020,\n"), ("d.tsv", "Title\tAuthor\tYear\nTab, title\tDoe, Roe\t2018\n")):
        (tmp_path / name).write_text(body)
    got = {n: sorted(biblio.read(spark, str(tmp_path / n), "s").collect(), key=lambda r: r.title) for n in ("a.ris", "b.bib", "c.csv", "d.tsv")}
    first, second = got["a.ris"]
    assert (first.title, first.authors, first.year, first.doi, first.peer_reviewed) == ("First title", ["Doe, Jane", "Roe, Max"], 2021, "10.5/abc", "yes")
    assert (second.title, second.authors, second.year, second.peer_reviewed) == ("Second", [], None, "unknown")
    nested, two = got["b.bib"]
    assert (nested.title, nested.authors, nested.venue, nested.doi, nested.year, nested.peer_reviewed) == ("A Nested Title", ["Jane Doe", "Max Roe"], "Some, Journal", "10.1/x", 2019, "yes")
    assert (two.title, two.venue) == ("Two lines", "Conf")
    (row,) = got["c.csv"]
    assert (row.title, row.authors, row.doi, row.year) == ("One, two", ["Doe", "Roe"], "10.2/y", 2020)
    (row,) = got["d.tsv"]
    assert (row.title, row.authors) == ("Tab, title", ["Doe", "Roe"])


def test_gate_on_a_stream(spark, tmp_path):
    actions = spark.createDataFrame([("a", "write", None, "L1_FIL_PIC0301_SP", None, None, "2.5", "BAR", None, None), ("b", "write", None, "L1_FIL_PIC0301_SP", None, None, "true", "BAR", None, None), ("c", "command", None, None, "L1-FIL", "Start", None, None, None, None)], rules.ACTION)
    actions.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rules.ACTION).parquet(str(tmp_path / "in"))
    q = gate(stream, rules.World(spark)).writeStream.format("memory").queryName("verdicts").start()
    q.processAllAvailable()
    q.stop()
    got = {r.cid: (r.disposition, r.faults) for r in spark.table("verdicts").collect()}
    assert got == {"a": ("accept", []), "b": ("reject", ["F-CARD"]), "c": ("reject", ["F-STATE"])}
