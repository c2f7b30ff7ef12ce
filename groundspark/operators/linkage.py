"""Record linkage: exact clusters, merged records, fuzzy pairs, screening."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions import text
from groundspark.operators import graph
from groundspark.operators.joins import join_once
from groundspark.session import checkpointed

# Sources by preference, told by how their names begin.
PREFERRED = ["ieee", "scopus", "wos", "acm", "sciencedirect", "springer", "openalex", "semanticscholar", "arxiv"]
#: Each step of length is so many times the one before.
STEP = 1.16
#: Frequent characters of titles, each counted for itself; all others count as one.
CHARACTERS = "etaoinshrdlcu "
#: Titles of a step that meet their partners in one part.
DEALT = 64


def keyed(records: DataFrame) -> DataFrame:
    """records with ord (rising in the order of the input, not gapless), norm_title and author (null where none is named)."""
    author = F.when(F.size("authors") > 0, text.first_author(F.col("authors")))
    rows = records.withColumn("ord", F.monotonically_increasing_id()).withColumn("norm_title", text.normalized_title(F.coalesce("title", F.lit("")))).withColumn("author", author)
    return checkpointed(rows)


def same_work(rows: DataFrame) -> DataFrame:
    """src, dst: links that connect records of one DOI, and records of one title whose DOIs, years and authors agree or are missing.

    Records of a DOI, and those of a title that have the same DOI, year and author, are tied to the first of
    them. Further links of a title need one side without a DOI; sides meet by author (or for want of one), so
    a title that many unrelated works share makes no pairs of all of them.
    """
    c = F.col
    with_doi = rows.where("doi is not null").select("doi", c("ord").alias("src"))
    doi = join_once(with_doi, with_doi.groupBy("doi").agg(F.min("src").alias("dst"), F.count("*").alias("n")), ["doi"]).select("src", "dst")
    kinds = ["norm_title", "doi", "year", "author"]
    titled = rows.where("norm_title <> ''").select("ord", F.struct(*kinds).alias("kind"))
    first = checkpointed(titled.groupBy("kind").agg(F.min("ord").alias("dst"), F.count("*").alias("n")))
    alike = join_once(titled, first, ["kind"]).select(c("ord").alias("src"), "dst")
    # A named author meets the same one and none; no author meets all.
    named, nobody, anybody = F.concat(F.lit("="), c("kind.author")), F.lit(""), F.lit("*")
    side = lambda x, keys: first.select(c("kind.norm_title").alias("title"), F.explode(keys).alias("key"), c("dst").alias(f"{x}_ord"), c("kind.doi").alias(f"{x}_doi"), c("kind.year").alias(f"{x}_year"))
    a = side("a", F.when(c("kind.author").isNull(), F.array(anybody)).otherwise(F.array(named, nobody))).where("a_doi is null")
    b = side("b", F.array(F.coalesce(named, nobody), anybody))
    near = F.coalesce(F.abs(c("a_year") - c("b_year")) <= 1, F.lit(True))
    across = a.join(b, ["title", "key"]).where(near & (c("a_ord") != c("b_ord"))).select(F.greatest("a_ord", "b_ord").alias("src"), F.least("a_ord", "b_ord").alias("dst"))
    return doi.unionByName(alike).unionByName(across).where("src <> dst").distinct()


def merged(records: DataFrame) -> DataFrame:
    """One row a work: record_id, title, year, authors, doi, venue, abstract, url, work_type, peer_reviewed, sources, ids, query_families (sorted), n, norm_title, ord.

    records: source, source_id, the other fields of a record and, if there is one, query_family. A work's own
    fields are those of its first record by peer review, source and length of abstract; DOI and abstract
    come from the first that has one. Rows are in the order of year (none first) and normalised title.
    """
    c = F.col
    rows = keyed(records if "query_family" in records.columns else records.withColumn("query_family", F.lit(None).cast("string")))
    roots = graph.components(same_work(rows))
    rows = rows.join(roots, c("ord") == c("node"), "left").withColumn("cluster", F.coalesce("root", "ord")).withColumn("record_id", F.concat_ws(":", "source", "source_id"))
    place = F.coalesce(*[F.when(F.startswith(F.lower("source"), F.lit(p)), i) for i, p in enumerate(PREFERRED)], F.lit(len(PREFERRED)))
    key = F.struct(F.coalesce(c("peer_reviewed") != "yes", F.lit(True)).alias("a"), place.alias("b"), (-F.length(F.coalesce("abstract", F.lit("")))).alias("c"), "ord")
    own = F.min_by(F.struct("record_id", "title", "year", "authors", "venue", "url", "work_type", "peer_reviewed", "norm_title", "ord"), key).alias("own")
    first = lambda x: F.min_by(x, F.when(F.coalesce(c(x), F.lit("")) != "", key)).alias(x)
    sets = [F.array_sort(F.collect_set(x)).alias(name) for x, name in (("source", "sources"), (F.nullif("query_family", F.lit("")), "query_families"))]
    out = rows.groupBy("cluster").agg(own, first("doi"), first("abstract"), F.bool_or(c("peer_reviewed") == "yes").alias("reviewed"), F.array_sort(F.collect_list("record_id")).alias("ids"), *sets, F.count("*").alias("n"))
    whole = out.select("own.*", "doi", "abstract", "ids", "sources", "query_families", "n", F.when(c("reviewed"), "yes").otherwise(c("own.peer_reviewed")).alias("reviewed")).withColumn("peer_reviewed", c("reviewed")).drop("reviewed")
    return whole.orderBy(F.coalesce("year", F.lit(0)), "norm_title", "ord")


def uncertain(works: DataFrame, least: float = 0.93) -> DataFrame:
    """a, b (record ids), ratio (three places): merged works of one year and first word, not of different DOIs, whose titles are alike.

    Titles of equal length steps or neighbouring ones are compared, which loses no pair of 0.86 or more. Of
    works with one and the same title (also an empty one) each is paired with the first.
    """
    c = F.col
    rows = works.select(F.coalesce(c("year").cast("string"), F.lit("")).alias("y"), F.split_part("norm_title", F.lit(" "), F.lit(1)).alias("word"), "norm_title", "record_id", "doi", "ord")
    rows = checkpointed(rows.withColumn("step", F.floor(F.log(F.length("norm_title") + 1.0) / math.log(STEP))))
    apart = ~F.coalesce(c("da") != c("db"), F.lit(False))
    side = lambda x: rows.select("y", "word", "step", c("norm_title").alias(f"t{x}"), c("record_id").alias(x), c("ord").alias(f"o{x}"), c("doi").alias(f"d{x}"))
    a, b = side("a"), side("b")
    first = rows.groupBy("y", "word", "norm_title").agg(F.min_by(F.struct("record_id", "doi", "ord"), "ord").alias("f"))
    equal = rows.join(first, ["y", "word", "norm_title"]).select(c("f.record_id").alias("a"), c("record_id").alias("b"), c("f.doi").alias("da"), c("doi").alias("db"), c("f.ord").alias("oa"), c("ord").alias("ob")).where((c("oa") != c("ob")) & apart)
    # No ratio can exceed twice the shorter length over the sum of both.
    close = 2 * F.least(F.length("ta"), F.length("tb")) >= least * (F.length("ta") + F.length("tb"))
    pairs = a.withColumn("step", F.explode(F.array(*[c("step") + k for k in (-1, 0, 1)]))).join(b, ["y", "word", "step"]).where((c("ta") < c("tb")) & apart & close)
    alike = pairs.withColumn("ratio", text.sequence_ratio("ta", "tb")).where(c("ratio") >= least)
    return equal.select("a", "b", F.lit(1.0).alias("ratio")).unionByName(alike.select("a", "b", F.bround("ratio", 3).alias("ratio")))


def alike_titles(titles: DataFrame, keys: list[str], least: float) -> DataFrame:
    """a, b (ids, a < b), ratio (not rounded): pairs of rows with equal keys (without nulls) whose titles are `least` (0.93 to 1) alike or more.

    titles: keys, id, title (not empty; a-z, 0-9 and spaces). What rules a pair out is asked from cheap to dear, and loses none: steps of
    length, since lengths of a pair of 0.93 differ by less than a step; lengths; counts of characters, since what
    one title has more of is matched by nothing; then, in Python, common grams. Only the rest are aligned. The rows of a
    step that many titles share are dealt into parts of about DEALT, and each part meets all of its partners apart from the others.
    """
    c = F.col
    many = [F.length("title") - F.length(F.replace(c("title"), F.lit(x))) for x in CHARACTERS] + [F.length(F.translate("title", CHARACTERS, ""))]
    rows = titles.select(*keys, "id", "title", F.floor(F.log(F.length("title").cast("double")) / math.log(STEP)).alias("step"))
    large = rows.groupBy(*keys, "step").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts")).where("parts > 1")
    dealt = checkpointed(rows.join(F.broadcast(large), [*keys, "step"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    side = lambda df, x: df.select(*keys, "step", "part", c("id").alias(x), c("title").alias(f"t{x}"), *[n.alias(f"{x}{i}") for i, n in enumerate(many)])
    b = side(dealt.withColumn("part", F.pmod(F.xxhash64("title", "id"), c("parts")).cast("int")), "b")
    near = dealt.drop("parts").withColumn("step", F.explode(F.array(*[c("step") + k for k in (-1, 0, 1)])))
    near = near.join(F.broadcast(large), [*keys, "step"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    both, shorter = F.length("ta") + F.length("tb"), F.least(F.length("ta"), F.length("tb"))
    apart = sum((F.abs(c(f"a{i}") - c(f"b{i}")) for i in range(len(many))), F.lit(0))
    able = (c("a") < c("b")) & (2 * shorter / both >= least) & ((both - apart) / both >= least)
    # A number of partitions that is asked for is not lowered: little to move may be much to align.
    tasks, place = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "step", "part"]
    pairs = side(near, "a").repartition(tasks, *place).join(b.repartition(tasks, *place), place).where(able).select("a", "b", "ta", "tb")
    return pairs.withColumn("ratio", text.ratio_if_at_least(c("ta"), c("tb"), least)).where("ratio is not null").select("a", "b", "ratio")


def screened(records: DataFrame, rules: dict[str, str]) -> DataFrame:
    """records with reason: the first rule, by name, that title and abstract do not match; null if all do. Rules are those named A and a digit."""
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    used = {name: pattern for name, pattern in sorted(rules.items()) if name[:1] == "A" and name[1:2].isdigit()}
    reasons = [F.when(~body.rlike(f"(?i){pattern}"), name) for name, pattern in used.items()]
    return records.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))


def kept_decisions(sheet: DataFrame, old: DataFrame, key: str, human: list[str], sticky: tuple[str, ...] = ("double_code",)) -> DataFrame:
    """sheet with the human columns of an older one wherever those are filled in; sticky columns keep what the older one has."""
    human = [c for c in human if c in old.columns]
    stuck = [c for c in sticky if c in old.columns and c in sheet.columns]
    before = old.dropDuplicates([key]).select(key, *[F.nullif(F.trim(c), F.lit("")).alias(f"old_{c}") for c in human], *[F.col(c).alias(f"old_{c}") for c in stuck if c not in human])
    joined = sheet.join(before, key, "left")
    return joined.select(*[F.coalesce(f"old_{c}", c).alias(c) if c in human or c in stuck else F.col(c) for c in sheet.columns])
