"""Secret scan with corpus-wide ownership frequency.

Base spans come from patterns. The method then looks at where values occur: each candidate value's
hash is counted by distinct owners and repositories. A value that several owners hold, or many
repositories of one, is a copied example; of the others, one that looks random is live and one that does
not is plain. Every other place where a live value stands, without the words that gave it away, becomes a
further span; there it may be joined to other text by the characters of JOINTS. Only DataFrame functions:
a pattern's places come from the lengths of its matches and of the pieces between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import HOT, held, join_once, text_or_empty

# The patterns of the three base kinds and the least length of their value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Runs of the value alphabet in which values may stand, and what joins a value to its neighbours there.
BARE = r"[A-Za-z0-9+/_.=-]{12,}"
JOINED = "./=-"
JOINTS = f"[{JOINED}]"
#: The long ones among the runs of HEX; a shorter run has no long part.
LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
#: A value of more owners, or of more repositories, is a copied example.
OWNERS, REPOSITORIES = 1, 8
#: What a random value has: so many different characters at least, none of them in more than this part of it.
DIFFERENT, PART = 6, 3
#: Words of placeholders.
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|change_me|your[_-]?|redacted|xxxx|1234567|abcdefg|qwerty|password|secret"
FOUND = "array<struct<gap:int,len:int,value:string>>"


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that do not overlap, in order: gap (code points since the match before), len, and value if it has `least` characters."""
    pattern = F.lit(pattern)
    matches, pieces, values = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(group))
    rows = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(pieces, F.lit(1), F.size(matches)).alias("p"))
    return F.transform(rows, lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("len"), F.when(F.length(x["v"]) >= least, x["v"]).alias("value")))


def matches(text: Column) -> list[Column]:
    """What the patterns find, a column for each of KINDS and one, `bare`, of runs in which values may stand."""
    some = {
        "assign": F.when(text.rlike(ASSIGN), _found(text, ASSIGN, 2, LEAST["assign"])),
        "access": F.when(text.contains("AKIA"), _found(text, ACCESS, 0, LEAST["access"])),
        "hex": F.when(text.rlike(LONG_HEX), _found(text, LONG_HEX, 0, LEAST["hex"])),
        "bare": F.when(text.rlike(BARE), _found(text, BARE, 0, 12)),
    }
    return [F.coalesce(x, F.array().cast(FOUND)).alias(name) for name, x in some.items()]


def _placed(found: DataFrame, *order: str) -> DataFrame:
    """found (row, gap, len, ...; in order of `order` within a row) with start, from a running sum over what comes before."""
    so_far = Window.partitionBy("row", *order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("start", F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far) - F.col("len")).drop("gap")


def base_spans(rows: DataFrame) -> DataFrame:
    """row, owner, repository, rank (of the kind), start, end, value of what the patterns found."""
    one = lambda k, kind: F.transform(kind, lambda x: F.struct(F.lit(k).alias("rank"), x["gap"].alias("gap"), x["len"].alias("len"), x["value"].alias("value")))
    every = F.concat(*[one(k, F.col(kind)) for k, kind in enumerate(KINDS, 1)])
    found = rows.select("row", "owner", "repository", F.posexplode(every).alias("k", "x")).select("row", "owner", "repository", "k", "x.*")
    return _placed(found, "rank", "k").where("value is not null").withColumn("end", F.col("start") + F.col("len")).drop("k", "len")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def looks_random(value: Column) -> Column:
    """DIFFERENT characters or more, none in more than one PARTth of it, no period, no word of a placeholder."""
    kinds = F.array_distinct(F.split(value, ""))
    most = F.array_max(F.transform(kinds, lambda c: F.length(value) - F.length(F.replace(value, c, F.lit("")))))
    again = F.substring(F.concat(value, value), F.lit(2), 2 * F.length(value) - 2)
    return (F.size(kinds) >= DIFFERENT) & (most * PART <= F.length(value)) & ~F.contains(again, value) & ~F.lower(value).rlike(PLACEHOLDER)


def ownership(found: DataFrame) -> DataFrame:
    """hash -> value, n (places), owners, repositories (distinct), live, copied. found: hash, value, owner, repository; a null owner or repository is one of its own."""
    once = found.groupBy("hash", "value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = once.groupBy("hash", "value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    counted = by_owner.groupBy("hash", "value").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    copied = (F.col("owners") > OWNERS) | (F.col("repositories") > REPOSITORIES)
    return counted.select("*", (~copied & looks_random(F.col("value"))).alias("live"), copied.alias("copied"))


def _cut(value: Column) -> dict[str, Column]:
    """A value's leading joints, what is between, its words there, and its trailing joints."""
    core, left, right = F.btrim(value, F.lit(JOINED)), F.ltrim(value, F.lit(JOINED)), F.rtrim(value, F.lit(JOINED))
    lead, trail = F.left(value, F.length(value) - F.length(left)), F.right(value, F.length(value) - F.length(right))
    return {"lead": lead, "core": core, "words": F.split(core, f"{JOINTS}+", -1), "trail": trail}


def _pieces(rows: DataFrame, starting: DataFrame) -> DataFrame:
    """row, k (of the run), start (in the run), before, core, after: what lies between joints in runs, wherever it begins with a word of
    `starting` (word, counts) and has as many words as one of its counts; before and after are the joints around it.

    Only runs that hold such a word are cut up.
    """
    runs = rows.select("row", F.posexplode("bare").alias("k", "run")).select("row", "k", F.col("run.value").alias("run"))
    words = F.split("run", f"{JOINTS}+", -1)
    each = runs.select("row", "k", F.explode(F.array_distinct(words)).alias("word"))
    many = starting.withColumn("n", F.lit(1)) if starting.limit(HOT + 1).count() <= HOT else each.groupBy("word").agg(F.count("*").alias("n")).join(starting, "word")
    searched = join_once(each, many, ["word"], spread=False).select("row", "k").distinct()
    cut = runs.join(searched, ["row", "k"]).select("row", "k", words.alias("words"), F.regexp_extract_all("run", F.lit(f"{JOINTS}+"), F.lit(0)).alias("joints"))
    cut = cut.select("row", "k", F.size("words").alias("of"), F.posexplode(F.arrays_zip("words", F.concat(F.array(F.lit("")), "joints").alias("before"), F.concat("joints", F.array(F.lit(""))).alias("after"))).alias("t", "x"))
    cut = cut.select("row", "k", "of", "t", F.col("x.words").alias("word"), "x.before", "x.after").where("word <> ''")
    parts = held(_placed(cut.withColumns({"gap": F.length("before"), "len": F.length("word")}), "k", "t"))
    asked = join_once(parts, many, ["word"], spread=False).select("row", "k", "t", "of", "start", "before", "word", "after", F.explode("counts").alias("count")).where("t + count <= of")
    alone = asked.where("count = 1").select("row", "k", "start", "before", F.col("word").alias("core"), "after")
    longer = asked.where("count > 1").select("row", "k", "t", "count", "start", "before", F.explode(F.sequence(F.col("t"), F.col("t") + F.col("count") - 1)).alias("s"))
    joined = longer.join(parts.select("row", "k", F.col("t").alias("s"), "word", "after"), ["row", "k", "s"])
    listed = joined.groupBy("row", "k", "t", "count", "start", "before").agg(F.array_sort(F.collect_list(F.struct("s", "word", "after"))).alias("l")).where("size(l) = count")
    text = F.array_join(F.transform("l", lambda x: F.concat(x["word"], F.when(x["s"] < F.col("t") + F.col("count") - 1, x["after"]).otherwise(""))), "")
    return alone.unionByName(listed.select("row", "k", "start", "before", text.alias("core"), F.element_at("l", -1)["after"].alias("after")))


def _apart(places: DataFrame) -> DataFrame:
    """places (row, k, value, start, end) without those that overlap an earlier one of the same value that is left.

    Places that overlap form clusters; only within one, and there are few, is the choice made one after the other.
    """
    by = Window.partitionBy("row", "k", "value").orderBy("start")
    marked = places.withColumn("_new", F.coalesce(F.col("start") >= F.lag("end").over(by), F.lit(True)).cast("int"))
    clusters = marked.withColumn("_c", F.sum("_new").over(by)).groupBy("row", "k", "value", "_c").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    size = F.length("value")
    chosen = F.aggregate("starts", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x >= F.element_at(acc, -1) + size), F.concat(acc, F.array(x))).otherwise(acc))
    start = F.explode(F.when(F.size("starts") == 1, F.col("starts")).otherwise(chosen)).alias("start")
    return clusters.select("row", "k", "value", start).withColumn("end", F.col("start") + size)


def further(rows: DataFrame, live: DataFrame) -> DataFrame:
    """row, start, end, value: places of live values within the runs of rows (row, bare).

    A place begins and ends at a joint or at an end of its run. Runs are cut at joints, and a piece meets
    the values by the whole of what it says, so values that share words meet no more than those that do not.
    """
    cut = _cut(F.col("value"))
    values = held(live.select("value", *[c.alias(name) for name, c in cut.items()]))
    starting = held(values.groupBy(F.element_at("words", 1).alias("word")).agg(F.collect_set(F.size("words")).alias("counts")))
    pieces = held(_pieces(rows, starting))
    by_core = values.groupBy("core").agg(F.collect_list(F.struct("lead", "trail", "value")).alias("values"))  # which differ in joints at their ends only
    wanted = pieces.groupBy("core").agg(F.count("*").alias("n")).join(by_core, "core")
    met = join_once(pieces, wanted, ["core"], spread=False).select("row", "k", "start", "before", "after", F.explode("values").alias("v")).where("endswith(before, v.lead) and startswith(after, v.trail)")
    here = met.select("row", "k", F.col("v.value").alias("value"), (F.col("start") - F.length("v.lead")).alias("start"))
    places = held(_apart(here.withColumn("end", F.col("start") + F.length("value"))))
    runs = rows.join(places.select("row").distinct(), "row", "left_semi").select("row", F.posexplode("bare").alias("k", "run")).select("row", "k", "run.gap", "run.len")
    at = _placed(runs, "k").select("row", "k", F.col("start").alias("at"))
    return places.join(at, ["row", "k"]).select("row", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "value")


def _free(found: DataFrame, base: DataFrame) -> DataFrame:
    """Spans of found (row, start, end, value) that overlap no span of base: none of those that begin before its end reaches beyond its start."""
    both = found.select("row", "start", "end", "value", F.col("end").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("reach"))
    both = both.unionByName(base.select("row", "start", "end", "value", F.col("start").alias("at"), F.lit(1).alias("turn"), F.col("end").alias("reach")))
    before = Window.partitionBy("row").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reach", F.max("reach").over(before)).where("turn = 0 and coalesce(reach, 0) <= start").select("row", "start", "end", "value")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Every row with what was found: doc_id, spans (all, in order), base (the patterns' own), n_live, n_copied, n_plain (base spans by ownership and look).

    docs: doc_id, text and the columns named by owner and repository; others are ignored. Where there are no
    such columns, the source owns a text and a document is a repository of its own. A null text counts as
    empty; a null owner or repository is one of its own. Rows of equal id and text are counted as one
    place, and each of them is returned. Kinds of further spans: `owned`. Time grows with a text's length, not with its square.
    """
    rows = docs.select("doc_id", F.col(owner).alias("owner"), F.col(repository).cast("string").alias("repository"), *matches(text_or_empty()))
    rows = held(rows.withColumn("row", F.monotonically_increasing_id()))
    base = held(base_spans(rows).withColumn("hash", F.sha2("value", 256)))
    owned = held(ownership(base))
    judged = join_once(base.drop("owner", "repository"), owned.select("hash", "n", "live", "copied"), ["hash"], spread=False)
    more = _free(further(rows, owned.where("live").select("value")), base).select("row", F.lit(len(KINDS) + 1).alias("rank"), "start", "end", "value", F.lit(False).alias("live"), F.lit(False).alias("copied"))
    every = judged.drop("hash").unionByName(more)
    based = F.col("rank") <= len(KINDS)
    kinds = {"n_live": based & F.col("live"), "n_copied": based & F.col("copied"), "n_plain": based & ~F.col("live") & ~F.col("copied")}
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "end", "value")))  # a document's own
    of_row = every.groupBy("row").agg(listed.alias("all"), *[F.sum(c.cast("long")).alias(name) for name, c in kinds.items()])
    named = F.array(*map(F.lit, (*KINDS, "owned")))
    spans = lambda some: F.transform(some, lambda x: F.struct(F.element_at(named, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,value:string>>")
    joined = rows.select("row", "doc_id").join(of_row, "row", "left").withColumn("all", F.coalesce("all", none))
    own = F.filter("all", lambda x: x["rank"] <= len(KINDS))
    return joined.select("doc_id", spans(own).alias("base"), spans(F.col("all")).alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in kinds])
