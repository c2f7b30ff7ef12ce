"""Text functions: token cost, search tokens, identifiers, titles, escapes. JVM-side but for NFKD and difflib."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that cost one token each: up to four letters or digits of a run, a run of white space, any other character.
COST = r"(?U)[A-Za-z]{1,4}|[0-9]{1,4}|\s+|[^\sA-Za-z0-9]"


def surrogate_tokens(text: Column) -> Column:
    """Token cost; a run of n letters or of n digits costs ceil(n/4). Null costs 0."""
    return F.coalesce(F.regexp_count(text, F.lit(COST)), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and of digits; all else separates them."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def normalized_doi(doi: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.nullif(bare, F.lit(""))


@F.pandas_udf(T.StringType())
def _fold(titles: pd.Series) -> pd.Series:
    def fold(t):
        if t is None:
            return None
        ascii_only = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", " ", ascii_only.lower()).strip()

    return titles.map(fold)


def ascii_title(title: Column) -> Column:
    """The ASCII case of normalized_title, without Python."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def normalized_title(title: Column) -> Column:
    """NFKD, ASCII only, lower case, runs of other characters as one space. Python only where a title is not ASCII."""
    return F.when(title.rlike(r"^\p{ASCII}*$"), ascii_title(title)).otherwise(_fold(title))


def first_author(authors: Column) -> Column:
    """Surname of the first author: before the comma, or the last word."""
    first = F.trim(F.try_element_at(authors, F.lit(1)))
    surname = F.when(first.contains(","), F.split_part(first, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(first), r"\s+"), -1))
    return F.coalesce(normalized_title(surname), F.lit(""))


def year_of(text: Column) -> Column:
    return F.expr("nullif('', '')").cast("int") if text is None else F.nullif(F.regexp_extract(text, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")


def peer_reviewed(types: Column, known: list[str]) -> Column:
    parts = F.transform(F.split(F.lower(F.coalesce(types, F.lit(""))), "[;,]"), lambda x: F.trim(x))
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, known))), "yes").otherwise("unknown")


def record_id(source: Column, title: Column, year: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.lit("|"), title, F.lit("|"), F.coalesce(year.cast("string"), F.lit("None")))), 1, 16)


def strip_tags(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def percent_encoded(text: Column) -> Column:
    """Every reserved character encoded, a space as %20; ~ stays."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def expanded_node_id(raw: Column, namespaces: Column) -> Column:
    """`ns=i;id` as `nsu=<uri>;<id>`; no index is namespace 0."""
    index = F.coalesce(F.nullif(F.regexp_extract(raw, r"^ns=(\d+);", 1), F.lit("")).cast("int"), F.lit(0))
    return F.concat(F.lit("nsu="), F.element_at(namespaces, index + 1), F.lit(";"), F.regexp_replace(raw, r"^ns=\d+;", ""))


def general_format(value: Column) -> Column:
    """%g: six significant digits, no zeros at the end; exponents below -4 or from 6 on."""
    exponent = F.floor(F.log10(F.abs(value))).cast("int")
    digits = F.format_string("%.5e", value)
    e = F.when(value == 0, 0).otherwise(F.regexp_extract(digits, r"e([+-]\d+)$", 1).try_cast("int"))
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(digits, r"^([^e]+)e", 1), "0+$", ""), r"\.$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(digits, r"e([+-]\d+)$", 1))
    # Fixed notation with 5 - e digits after the point.
    fixed = F.when(F.lit(False), F.lit(""))
    for k in range(-4, 6):
        fixed = fixed.when(e == k, F.regexp_replace(F.regexp_replace(F.format_string(f"%.{5 - k}f", value), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return F.when(value.isNull(), F.lit(None)).when(value == 0, "0").when((e < -4) | (e >= 6) | exponent.isNull(), scientific).otherwise(fixed)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity as difflib gives it, not rounded; thresholds are asked before any rounding."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


#: Characters a gram of `ratio_if_at_least`.
GRAM = 4


def _grams(x: str) -> Counter:
    return Counter(x[i : i + GRAM] for i in range(len(x) - GRAM + 1))


_kept_grams = functools.lru_cache(1024)(_grams)


def most_matched(a: str, b: str) -> int:
    """No common subsequence of a and b is longer.

    A character that only one has destroys GRAM grams of its own text at most, or GRAM - 1 of the other's, so the
    grams that both have bound how many such characters there are.
    """
    mine, other = (_kept_grams(x) if len(x) < 2000 else _grams(x) for x in (a, b))
    common = sum(min(mine[g], other[g]) for g in mine.keys() & other.keys())
    return min(len(a), len(b), (common + (GRAM - 1) * (len(a) + len(b) + 1)) // (2 * GRAM - 1))


def ratio_if_at_least(a: Column, b: Column, least: float) -> Column:
    """sequence_ratio where it is at least `least`, else null; pairs whose common grams rule that out are not aligned."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b, strict=True):
            able = x is not None and y is not None and (x == y or 2.0 * most_matched(x, y) / (len(x) + len(y)) >= least)
            r = difflib.SequenceMatcher(None, x, y).ratio() if able else None
            found.append(r if r is not None and r >= least else None)
        return pd.Series(found, dtype="float64")

    return ratio(a, b)


def positions_to_text(index: Column) -> Column:
    """An inverted index, map word -> positions, as text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " ")
