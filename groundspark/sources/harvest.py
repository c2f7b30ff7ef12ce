"""Saved pages of bibliographic services as records, and the protocol that asked for them.

There is no network here: pages are files, read whole with their hash. JSON pages are read by schema, Atom
pages by XPath; a page that cannot be read has its own row in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions import text

RECORD = ["source", "source_id", "title", "year", "authors", "doi", "venue", "abstract", "url", "work_type", "peer_reviewed"]
# Kinds of works that count as reviewed.
OPENALEX_REVIEWED = ["article", "review", "book-chapter", "proceedings-article"]
SEMANTIC_REVIEWED = ["JournalArticle", "Conference"]

OPENALEX = """meta struct<count:bigint,next_cursor:string>, results array<struct<id:string,title:string,publication_year:int,type:string,doi:string,
authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string,type:string>>,abstract_inverted_index:map<string,array<int>>>>"""
SEMANTIC = """total bigint, data array<struct<paperId:string,title:string,year:int,authors:array<struct<name:string>>,externalIds:struct<DOI:string>,venue:string,abstract:string,url:string,publicationTypes:array<string>>>"""
CROSSREF = """message struct<`total-results`:bigint,items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,abstract:string,type:string,URL:string>>>"""


def pages(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, content of each page."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _parsed(pages_: DataFrame, schema: str) -> DataFrame:
    return pages_.select("file", F.from_json("content", schema).alias("p"))


def openalex(pages_: DataFrame) -> DataFrame:
    w = _parsed(pages_, OPENALEX).select(F.explode("p.results").alias("w"))
    c, of = F.col, F.col("w.primary_location.source")
    preprint = F.coalesce(of["type"] == "repository", F.lit(False)) | F.coalesce(c("w.type") == "preprint", F.lit(False))
    reviewed = F.when(preprint, "no").when(c("w.type").isin(OPENALEX_REVIEWED), "yes").otherwise("unknown")
    index = F.when(F.size(F.map_keys("w.abstract_inverted_index")) > 0, text.positions_to_text(c("w.abstract_inverted_index")))
    return w.select(
        F.lit("openalex").alias("source"), F.regexp_extract("w.id", r"([^/]*)$", 1).alias("source_id"), F.trim(F.coalesce("w.title", F.lit(""))).alias("title"), c("w.publication_year").alias("year"),
        F.coalesce(F.transform("w.authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), F.array().cast("array<string>")).alias("authors"),
        text.normalized_doi(c("w.doi")).alias("doi"), of["display_name"].alias("venue"), index.alias("abstract"), F.coalesce("w.doi", "w.id").alias("url"), c("w.type").alias("work_type"), reviewed.alias("peer_reviewed"))


def semantic_scholar(pages_: DataFrame) -> DataFrame:
    w, c = _parsed(pages_, SEMANTIC).select(F.explode("p.data").alias("w")), F.col
    types = F.coalesce("w.publicationTypes", F.array().cast("array<string>"))
    return w.select(
        F.lit("semanticscholar").alias("source"), c("w.paperId").alias("source_id"), F.coalesce("w.title", F.lit("")).alias("title"), c("w.year").alias("year"),
        F.coalesce(F.transform("w.authors", lambda a: F.coalesce(a["name"], F.lit(""))), F.array().cast("array<string>")).alias("authors"), text.normalized_doi(c("w.externalIds.DOI")).alias("doi"), c("w.venue").alias("venue"), c("w.abstract").alias("abstract"), c("w.url").alias("url"),
        F.nullif(F.array_join(types, ","), F.lit("")).alias("work_type"), F.when(F.arrays_overlap(types, F.array(*map(F.lit, SEMANTIC_REVIEWED))), "yes").otherwise("unknown").alias("peer_reviewed"))


def crossref(pages_: DataFrame) -> DataFrame:
    """Works without a title are left out."""
    w, c = _parsed(pages_, CROSSREF).select(F.explode("p.message.items").alias("w")), F.col
    name = lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))
    first = lambda x: F.try_element_at(x, F.lit(1))
    rows = w.select(
        F.lit("crossref").alias("source"), text.normalized_doi(c("w.DOI")).alias("source_id"), _squeezed(first(c("w.title"))).alias("title"), first(first(c("w.issued")["date-parts"])).alias("year"),
        F.coalesce(F.transform("w.author", name), F.array().cast("array<string>")).alias("authors"), text.normalized_doi(c("w.DOI")).alias("doi"), first(c("w")["container-title"]).alias("venue"), text.strip_tags(c("w.abstract")).alias("abstract"), c("w.URL").alias("url"),
        c("w.type").alias("work_type"), F.when(c("w.type") == "posted-content", "no").otherwise("yes").alias("peer_reviewed"))
    return rows.where("title <> ''")


def arxiv(pages_: DataFrame, years: tuple[int, int] = (0, 9999)) -> DataFrame:
    """Entries of Atom pages published in the years (both included)."""
    # XPath knows no default namespace, so prefixes go and entries are cut out as texts.
    plain = F.regexp_replace(F.regexp_replace("content", r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    e = pages_.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("e"))
    get = lambda path: F.nullif(F.xpath_string("e", F.lit(f"entry/{path}")), F.lit(""))
    year = F.coalesce(F.substring(get("published"), 1, 4).try_cast("int"), F.lit(0))
    rows = e.select(
        F.lit("arxiv").alias("source"), F.regexp_extract(F.coalesce(get("id"), F.lit("")), r"(?:.*/abs/)?(.*)$", 1).alias("source_id"), _squeezed(F.coalesce(get("title"), F.lit(""))).alias("title"), year.alias("year"), F.xpath("e", F.lit("entry/author/name/text()")).alias("authors"),
        text.normalized_doi(get("doi")).alias("doi"), F.lit("arXiv").alias("venue"), _squeezed(F.coalesce(get("summary"), F.lit(""))).alias("abstract"), get("id").alias("url"), F.lit("preprint").alias("work_type"), F.lit("no").alias("peer_reviewed"))
    return rows.where(F.col("year").between(*years))


READERS = {"openalex": openalex, "arxiv": arxiv, "semanticscholar": semantic_scholar, "crossref": crossref}


def queries(spark: SparkSession, path: str) -> DataFrame:
    """family, source, position, query, most (records): what a protocol file asks of each source, one row a query."""
    protocol = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("p"))
    families = protocol.select("p", F.explode(F.expr("variant_get(p, '$.search_families', 'array<variant>')")).alias("f"))
    asked = families.select("p", F.expr("variant_get(f, '$.id', 'string')").alias("family"), F.explode(F.expr("variant_get(f, '$.queries', 'map<string,variant>')")).alias("source", "q"))
    many = F.coalesce(F.expr("try_variant_get(q, '$', 'array<string>')"), F.array(F.expr("try_variant_get(q, '$', 'string')")))
    limits = F.expr("try_variant_get(p, '$.harvest', 'map<string,variant>')")
    most = F.coalesce(F.try_element_at(limits, F.concat(F.lit("max_records_"), "source")), F.try_element_at(limits, F.lit("max_records_per_query")))
    rows = asked.select("family", "source", F.posexplode(many).alias("position", "query"), most.alias("m"))
    return rows.select("family", "source", "position", "query", F.expr("try_variant_get(m, '$', 'int')").alias("most")).where("query is not null and query <> ''")


def run(spark: SparkSession, asked: DataFrame, raw: str, years: tuple[int, int] = (0, 9999)) -> tuple[DataFrame | None, list[dict]]:
    """Records of all queries whose pages lie under raw/<source>/<family>/q<position>, and the log: a row a query with status and counts.

    A query without pages, or of a source without a reader, fails and says why; the others go on.
    """
    records, log = None, []
    for q in asked.orderBy("family", "source", "position").collect():  # a protocol's queries
        entry = {"family": q["family"], "source": q["source"], "query": q["query"]}
        try:
            found = pages(spark, f"{raw}/{q['source']}/{q['family']}/q{q['position']}")
            read = READERS[q["source"]]
            rows = read(found, years) if read is arxiv else read(found)
            rows = rows.limit(q["most"]) if q["most"] else rows
            rows = rows.withColumn("query_family", F.lit(q["family"]))
            log.append(entry | {"status": "ok", "retrieved": rows.count(), "pages": [r.asDict() for r in found.select("file", "sha256").orderBy("file").collect()]})
            records = rows if records is None else records.unionByName(rows)
        except Exception as error:  # whatever a page holds, it is this query's failure
            log.append(entry | {"status": "failed", "retrieved": 0, "error": str(error).split("\n")[0]})
    return records, log


def failures(log: DataFrame) -> DataFrame:
    """One row: failed_sources (sorted), families (how many) of a log (family, source, status)."""
    return log.agg(F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("source")))).alias("failed_sources"), F.countDistinct("family").alias("families"))


def write_lines(records: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order, nulls written."""
    records.select(*sorted(records.columns)).write.option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields of the schema; others are ignored, missing ones null."""
    return spark.read.schema(schema).json(path)


def write_table(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, of the columns named, missing ones empty."""
    rows.select(*[F.col(c).cast("string") if c in rows.columns else F.lit("").alias(c) for c in columns]).write.csv(path, header=True, escape='"', emptyValue="", nullValue="")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as texts; empty cells are empty texts, a byte order mark is no part of a name."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns]).fillna("")
