"""The operators bound to the testdata tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundspark.functions import stats, text
from groundspark.operators import coverage, graph, lexical, linkage
from groundspark.operators.joins import join_once
from groundspark.plans.registry import query, table

#: Share of the base unit that a line number's unit stands for: a unit is assigned by l_linenumber % 4.
FACTORS = (1.0, 1000.0, 0.001, 60.0)
RULES = (("A1_length", r"^.{200,}"), ("A2_sentence", r"\."), ("A3_no_secret", r"^(?!.*token).*$"))


@query("""SELECT r.r_name, count(*) AS n, round(sum(l.l_quantity * [1.0, 1000.0, 0.001, 60.0][1 + l.l_linenumber % 4]) / 1000, 4) AS total
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1""")
def t_region_unit_sum(spark, sf_dir):
    """Quantities in units by line number, in thousands of the base unit, summed over a hierarchy; suppliers are summed before they are joined."""
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), F.col("l_linenumber") % 4 + 1)
    by_supplier = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity") * factor).alias("q"))
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = by_supplier.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.sum("n").alias("n"), F.round(F.sum("q") / 1000, 4).alias("total"))


@query("""WITH RECURSIVE e(src, dst) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
up(src, dst) AS (SELECT * FROM e UNION SELECT up.src, e.dst FROM up JOIN e ON up.dst = e.src) SELECT dst, count(*) AS below FROM up GROUP BY 1""")
def t_hierarchy_closure(spark, sf_dir):
    edge = lambda t, a, k, b, p: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k)).alias("src"), F.concat(F.lit(b), F.col(p)).alias("dst"))
    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    return graph.closure(edges).groupBy("dst").agg(F.count("*").alias("below"))


@query("""SELECT event_id, event_type, value FROM events WHERE value < CASE event_type WHEN 'error' THEN 20 WHEN 'click' THEN 5 END OR value > CASE event_type WHEN 'purchase' THEN 480 WHEN 'error' THEN 470 END""")
def t_alarm_sweep_events(spark, sf_dir):
    """Limits by type, either of which may be missing."""
    low = F.when(F.col("event_type") == "error", 20.0).when(F.col("event_type") == "click", 5.0)
    high = F.when(F.col("event_type") == "purchase", 480.0).when(F.col("event_type") == "error", 470.0)
    return table(spark, sf_dir, "events").where((F.col("value") < low) | (F.col("value") > high)).select("event_id", "event_type", "value")


@query("""SELECT c.c_mktsegment, count(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1""")
def t_event_window_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-12 00:00:00'").groupBy("user_id").agg(F.count("*").alias("k"))
    return e.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("k").alias("n"))


@query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-29 23:45:00') AS stale, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 23:45:00') AS fresh FROM events GROUP BY 1")
def t_stale_events(spark, sf_dir):
    stale = F.col("ts") < F.expr("timestamp_ntz'2024-01-29 23:45:00'")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(stale).alias("stale"), F.count_if(~stale).alias("fresh"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]{1,4}|[0-9]{1,4}|\s+|[^\sA-Za-z0-9]')) AS BIGINT) AS tokens FROM documents")
def t_tokens_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.surrogate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS term FROM documents) GROUP BY 1")
def t_df_documents(spark, sf_dir):
    return lexical.document_frequency(lexical.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("""WITH t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS term FROM documents) GROUP BY 1, 2),
df AS (SELECT term, ln((d.n + 1) / (count(*) + 1)) + 1 AS idf FROM t, (SELECT count(*) AS n FROM documents) d GROUP BY term, d.n),
r AS (SELECT doc_id, term, (1 + ln(n)) * idf AS r FROM t JOIN df USING (term)), norm AS (SELECT doc_id, sqrt(sum(r * r)) AS norm FROM r GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
rq AS (SELECT item_id, term, (1 + ln(n)) * coalesce(idf, 1.0) AS rq FROM q LEFT JOIN df USING (term)), nq AS (SELECT item_id, sqrt(sum(rq * rq)) AS nq FROM rq GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(r * rq / nq) / any_value(norm), 9) AS score FROM r JOIN rq USING (term) JOIN nq USING (item_id) JOIN norm USING (doc_id) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 5""")
def t_tfidf_topk(spark, sf_dir):
    found = lexical.rank(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 5)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS text FROM pages")
def t_strip_tags_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("SELECT doc_id, first_id, n FROM (SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY lang, text)) WHERE n > 1")
def t_doc_exact_groups(spark, sf_dir):
    """Documents that others of their language equal, each with the first of its group and the group's size; a group is never one row."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("lang", "text").alias("a"), F.xxhash64("text", F.lit(1), "lang").alias("b"))
    groups = d.groupBy("a", "b").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return join_once(d, groups.withColumn("rows", F.col("n")), ["a", "b"], "rows").select("doc_id", "first_id", "n")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, lang, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM d a JOIN d b ON a.title = b.title AND a.lang = b.lang AND a.title <> ''),
c(u, v) AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u) SELECT d.doc_id, coalesce(min(c.v), d.doc_id) AS cluster_id FROM d LEFT JOIN c ON c.u = d.doc_id GROUP BY d.doc_id""")
def t_doc_exact_clusters(spark, sf_dir):
    """Documents of one language whose first lines agree as titles; links go to a key's first document, so no pairs are made."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", text.ascii_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    first = d.where("title <> ''").groupBy("lang", "title").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    edges = join_once(d.where("title <> '' and lang is not null"), first.withColumn("n", F.col("rows")).drop("rows"), ["lang", "title"]).select(F.col("doc_id").alias("src"), F.col("least").alias("dst"))
    return d.select("doc_id").join(graph.components(edges), F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("cluster_id"))


@query(r"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '(?is)^.{200,}') THEN 'A1_length' WHEN NOT regexp_matches(text, '(?i)\.') THEN 'A2_sentence' WHEN contains(lower(text), 'token') THEN 'A3_no_secret' END AS reason FROM documents""")
def t_doc_screening(spark, sf_dir):
    """The first rule, by name, that a document fails; null if it passes all."""
    rules = [F.when(~F.col("text").rlike("(?is)" + pattern), name) for name, pattern in RULES]
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(*rules).alias("reason"))


@query("""WITH p AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a <> b) AS o, sum(a)::DOUBLE AS a1, sum(b)::DOUBLE AS b1 FROM p)
SELECT CAST(n AS BIGINT) AS n, round(1 - (o / n) / ((a1 * (n - b1) + (n - a1) * b1) / (n * n)), 9) AS kappa FROM n""")
def t_kappa_labels(spark, sf_dir):
    return stats.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.col("n").cast("long").alias("n"), F.round("kappa", 9).alias("kappa"))


@query("""WITH c AS (SELECT doc_id, quality AS c FROM labels UNION ALL SELECT doc_id, toxic FROM labels), k AS (SELECT doc_id FROM c WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) = 2),
v AS (SELECT quality AS a, toxic AS b FROM labels JOIN k USING (doc_id)), o AS (SELECT 2.0 * count(*) AS n, 2.0 * count(*) FILTER (a <> b) AS o, 1.0 * (sum(a) + sum(b)) AS n1 FROM v)
SELECT round(n, 6)::DOUBLE AS n, round(1 - o * (n - 1) / (2 * n1 * (n - n1)), 9) AS alpha FROM o""")
def t_alpha_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    codes = labels.select("doc_id", F.explode(F.array("quality", "toxic")).alias("code"))
    return stats.krippendorff_alpha(codes, "doc_id", "code").select(F.round("n", 6).alias("n"), F.round("alpha", 9).alias("alpha"))


@query("""WITH c AS (SELECT d.lang, count(*) FILTER (l.quality = 1 AND d.n_chars > 500) AS tp, count(*) FILTER (l.quality <> 1 AND d.n_chars > 500) AS fp, count(*) FILTER (l.quality = 1 AND d.n_chars <= 500) AS fn, count(*) FILTER (l.quality <> 1 AND d.n_chars <= 500) AS tn
FROM labels l JOIN documents d USING (doc_id) GROUP BY 1) SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c""")
def t_binary_scores(spark, sf_dir):
    """Long documents as a guess at good ones, by language."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    found = stats.confusion(joined, F.col("quality") == 1, F.col("n_chars") > 500, "lang")
    return found.select("lang", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "f1", "fpr", "accuracy")])


@query("""WITH c AS (SELECT d.lang, count(*) AS n, count(*) FILTER (l.quality = 1) AS k FROM labels l JOIN documents d USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, 3.8416 AS z2 FROM c)
SELECT lang, n, k, round(greatest(0, (p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high FROM p""")
def t_wilson_by_lang(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    c = joined.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(r"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM (SELECT conv_id, turn, CAST(1 + len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{1,4}|[0-9]{1,4}|\s+|[^\sA-Za-z0-9]')) AS BIGINT) AS cost FROM conversations)),
f(conv_id, o, used, taken) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM c UNION ALL SELECT f.conv_id, c.o, CASE WHEN f.used + c.cost <= 300 THEN f.used + c.cost ELSE f.used END,
CASE WHEN f.used + c.cost <= 300 THEN f.taken || CASE WHEN f.taken = '' THEN '' ELSE ',' END || c.turn ELSE f.taken END FROM f JOIN c ON c.conv_id = f.conv_id AND c.o = f.o + 1)
SELECT conv_id, used, taken FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o DESC) AS n FROM f) WHERE n = 1""")
def t_budget_pack_turns(spark, sf_dir):
    """Turns of a conversation in order within 300 tokens; a turn that does not fit is skipped."""
    cost = text.surrogate_tokens(F.coalesce(F.col("text"), F.lit(""))) + 1
    return lexical.pack_greedily(table(spark, sf_dir, "conversations").withColumn("cost", cost), "conv_id", "turn", "cost", 300)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def t_anti_join_integrity(spark, sf_dir):
    """References from line items to suppliers that a filtered definition leaves without a target."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    defined = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return graph.unresolved(counted, defined, ["l_suppkey"])


@query("""WITH s AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 0 THEN 'exclude' WHEN l.toxic = 1 THEN 'maybe' ELSE 'include' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS screened, count(*) FILTER (decision = 'exclude') AS excluded, count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER (decision IN ('include', 'maybe')) AS sought FROM s""")
def t_prisma_flow(spark, sf_dir):
    """Counts of a screening flow; they must add up, or the query fails."""
    decision = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 0, "exclude").when(F.col("toxic") == 1, "maybe").otherwise("include")
    s = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("decision", decision)
    n = s.agg(F.count("*").alias("screened"), F.count_if(F.col("decision") == "exclude").alias("excluded"), F.count_if(F.col("decision") == "pending").alias("pending"), F.count_if(F.col("decision").isin("include", "maybe")).alias("sought"))
    return n.where(F.assert_true(F.col("screened") == F.col("excluded") + F.col("pending") + F.col("sought"), "decisions do not add up").isNull())


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) b ON a.k = b.k""")
def t_union_merge(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full").select("k", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1")
def t_homograph_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@query("""SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) FILTER (l_linenumber = 1), 6) AS cat_1, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) FILTER (l_linenumber = 2), 6) AS cat_2, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) FILTER (l_linenumber = 3), 6) AS cat_3 FROM lineitem GROUP BY 1""")
def t_pivot_rates(spark, sf_dir):
    rates = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linenumber", [1, 2, 3]).agg(F.avg((F.col("l_linestatus") == "O").cast("double")))
    return rates.select("l_returnflag", *[F.round(str(k), 6).alias(f"cat_{k}") for k in (1, 2, 3)])


@query("""WITH f AS (SELECT event_id, ts, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT coalesce(before, '-') AS before, event_type, count(*) AS n FROM f GROUP BY 1, 2""")
def t_event_transitions(spark, sf_dir):
    """Steps from one event of a user to the next."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.coalesce(before, F.lit("-")).alias("before"), "event_type").groupBy("before", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, replace(replace(replace(string_split(text, chr(10))[1], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, nullif(regexp_extract(text, '(19|20)\\d{2}'), '') AS year, substr(sha1(source || '|' || string_split(text, chr(10))[1] || '|None'), 1, 16) AS record FROM documents""".replace("\\\\", "\\"))
def t_record_fields(spark, sf_dir):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", text.xml_escape(first).alias("escaped"), F.nullif(F.regexp_extract("text", r"(19|20)\d{2}", 0), F.lit("")).alias("year"), text.record_id(F.col("source"), first, F.lit(None)).alias("record"))


@query()
def t_title_nfkd(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


@query()
def t_fuzzy_pairs(spark, sf_dir):
    """Titles of one language and first word that are alike but not equal, each title once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", text.ascii_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    d = d.where("title <> ''").groupBy("lang", "title").agg(F.min("doc_id").alias("id")).withColumn("block", F.split_part("title", F.lit(" "), F.lit(1)))
    return linkage.alike_titles(d, ["lang", "block"], 0.93).select("a", "b", F.bround("ratio", 4).alias("ratio"))


_PART_FACTS = """WITH r AS (SELECT 'size' AS category, p_partkey AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'brand', p_partkey, p_brand FROM part),
a AS (SELECT category, key, CASE WHEN key % 7 = 0 THEN value || '9' WHEN key % 11 = 0 THEN value || '.0' ELSE value END AS value FROM r WHERE key % 5 <> 0), b AS (SELECT category, key, CASE WHEN key % 3 = 0 THEN 'x' ELSE value END AS value FROM r WHERE key % 2 = 0),
"""
_SAME = "({0} = {1} OR coalesce(abs(TRY_CAST({0} AS DOUBLE) - TRY_CAST({1} AS DOUBLE)) <= 1e-9, false))"


def _part_facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fact = lambda c, v: p.select(F.lit(c).alias("category"), F.col("p_partkey").alias("key"), F.col(v).cast("string").alias("value"))
    r = fact("size", "p_size").unionByName(fact("brand", "p_brand"))
    a = r.where("key % 5 <> 0").withColumn("value", F.when(F.col("key") % 7 == 0, F.concat("value", F.lit("9"))).when(F.col("key") % 11 == 0, F.concat("value", F.lit(".0"))).otherwise(F.col("value")))
    b = r.where("key % 2 = 0").withColumn("value", F.when(F.col("key") % 3 == 0, "x").otherwise(F.col("value")))
    return r, a, b


@query(_PART_FACTS + f"""o AS (SELECT r.category, CASE WHEN a.value IS NULL THEN 'missing' WHEN {_SAME.format('a.value', 'r.value')} THEN 'correct' ELSE 'conflict' END AS outcome FROM r LEFT JOIN a USING (category, key))
SELECT category, count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'conflict') AS conflict, count(*) FILTER (outcome = 'missing') AS missing FROM o GROUP BY 1""")
def t_facts_compared(spark, sf_dir):
    r, a, _ = _part_facts(spark, sf_dir)
    return coverage.counted(coverage.compared(r, a))


@query(_PART_FACTS + f"""m AS (SELECT category, key, a.value AS va, b.value AS vb, r.value AS vr FROM a FULL JOIN b USING (category, key) LEFT JOIN r USING (category, key))
SELECT category, key, CASE WHEN vb IS NULL OR (va IS NOT NULL AND {_SAME.format('va', 'vr')}) THEN va ELSE vb END AS value FROM m""")
def t_facts_merged(spark, sf_dir):
    r, a, b = _part_facts(spark, sf_dir)
    return coverage.merged(a, b, r)
