"""Text functions as Column expressions: names, addresses, n-grams, markup, amounts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that decide results.
STREET_SUFFIXES = {"STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL"}
NAME_STOP_WORDS = (
    "INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "CO", "COMPANY", "CORP", "CORPORATION", "PLLC", "PLC", "PC", "PA", "DBA", "THE", "AND", "OF",
)
GENERIC_PHRASES = (
    "UNITED STATES", "UNITED STATES DISTRICT", "UNITED STATES ATTORNEY", "DISTRICT COURT", "ATTORNEYS OFFICE", "JUSTICE DEPARTMENT", "DEPARTMENT JUSTICE",
    "SMALL BUSINESS", "SMALL BUSINESS ADMINISTRATION", "BUSINESS ADMINISTRATION", "PAYCHECK PROTECTION", "PAYCHECK PROTECTION PROGRAM",
    "PROTECTION PROGRAM", "ECONOMIC INJURY", "ECONOMIC INJURY DISASTER", "DISASTER LOAN", "GRAND JURY", "INTERNAL REVENUE", "INTERNAL REVENUE SERVICE",
    "SOCIAL SECURITY", "FEDERAL BUREAU", "PUBLIC RELATIONS", "INSPECTOR GENERAL",
)
PPP_WORDS = ("paycheck protection", "ppp loan", " ppp ", "(ppp)")
EIDL_WORDS = ("economic injury disaster", " eidl", "eidl ", "(eidl)")
LOAN_WORDS = ("sba loan", "covid-19 relief loan", "covid relief loan", "pandemic relief loan", "small business administration")
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}
UNIT_WORDS = "SUITE|STE|UNIT|APT|APARTMENT"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def norm_street(address: str | Column) -> Column:
    """Upper case without suites and punctuation, street types abbreviated on every word."""
    s = F.upper(F.col(address) if isinstance(address, str) else address)
    s = F.regexp_replace(s, rf"(?U)\b(?:{UNIT_WORDS})\b\.?\s*#?\s*[\w-]+", " ")
    s = F.regexp_replace(s, r"(?U)#\s*[\w-]+", " ")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    table = F.create_map(*[F.lit(x) for kv in STREET_SUFFIXES.items() for x in kv])
    return F.array_join(F.transform(_words(s), lambda w: F.coalesce(table[w], w)), " ")


def building_key(address: str = "borrower_address", city: str = "borrower_city", state: str = "borrower_state", zip_: str = "borrower_zip") -> Column:
    """Street | town | state | zip5 without blank parts; null if no street is left."""
    street = norm_street(address)
    town = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.col(city)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    parts = [street, town, F.upper(F.trim(F.col(state))), F.substring(F.trim(F.col(zip_)), 1, 5)]
    return F.when(street != "", F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts]))


def name_tokens(name: str | Column) -> Column:
    """Upper-case words of a name without legal forms and joining words; [] for null."""
    c = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    return F.filter(F.split(F.regexp_replace(F.upper(c), "[^A-Z0-9 ]+", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*NAME_STOP_WORDS))


def norm_name(name: str | Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def entity_key(name: str = "borrower_name", **address: str) -> Column:
    """name @ building; null if either is missing."""
    n, b = norm_name(name), building_key(**address)
    return F.when((n != "") & b.isNotNull(), F.concat(n, F.lit(" @ "), b))


def ngrams(tokens: Column, least: int = 2, most: int = 6) -> Column:
    """All different runs of least to most tokens, without generic phrases."""

    def of(t: Column, n: int) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # bound to a variable, so that the words are found once and not again for every run
    runs = F.flatten(F.flatten(F.transform(F.array(tokens), lambda t: F.array(*[of(t, n) for n in range(least, most + 1)]))))
    return F.filter(F.array_distinct(runs), lambda g: ~g.isin(*GENERIC_PHRASES))


def run_hashes(words: Column, least: int = 2, most: int = 6) -> Column:
    """Hashes of all different runs of least to most words of an array, for joins on runs."""

    def of(t: Column, n: int) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i, n), " ")))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.flatten(F.transform(F.array(words), lambda t: F.array(*[of(t, n) for n in range(least, most + 1)])))))


def runs_after_pairs(words: Column, pairs: Column, least: int = 2, most: int = 6) -> Column:
    """Those of run_hashes() whose first two words are one of the pairs, which are hashes of runs of two."""

    def of(t: Column, at: Column, n: int) -> Column:
        return F.transform(F.filter(at, lambda i: i + n - 1 <= F.size(t)), lambda i: F.xxhash64(F.array_join(F.slice(t, i, n), " ")))

    def begun(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.array_contains(pairs, F.xxhash64(F.array_join(F.slice(t, i, 2), " "))))
        # bound to variables, so that words and places are found once
        return F.flatten(F.flatten(F.transform(F.array(at), lambda a: F.array(*[of(t, a, n) for n in range(least, most + 1)]))))

    return F.array_distinct(F.flatten(F.transform(F.array(words), begun)))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Entities of markup; there is no built-in function for them."""
    return s.map(html.unescape, na_action="ignore")


def clean_markup(c: str | Column) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]+>", " ")), r"(?U)\s+", " "))


def largest_amount(text: str | Column) -> Column:
    """The largest dollar figure of a text, with thousand, million and billion; null if there is none."""
    c = F.col(text) if isinstance(text, str) else text
    pattern = r"(?i)\$\s?([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?"
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("u"))
    unit = lambda u: F.when(u == "thousand", 1e3).when(u == "million", 1e6).when(u == "billion", 1e9).otherwise(1.0)
    return F.array_max(F.transform(pairs, lambda p: F.regexp_replace(p["n"], ",", "").try_cast("double") * unit(F.lower(p["u"]))))


def dollar_figures(text: str | Column, least: float = 5000.0) -> Column:
    """Different whole-dollar figures of a text, with thousands commas or four digits and more, from `least` on."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(c, F.lit(r"\$\s?(\d{1,3}(?:,\d{3})+|\d{4,})(?:\.\d{2})?"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("long")), lambda x: x >= least)))


def _any(blob: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | blob.contains(w)
    return out


def program(blob: Column) -> Column:
    """ppp, eidl, both or other, of a lower-case text."""
    p, e = _any(blob, PPP_WORDS), _any(blob, EIDL_WORDS)
    return F.when(p & e, "both").when(p, "ppp").when(e, "eidl").otherwise("other")


def about_loans(blob: Column) -> Column:
    return _any(blob, (*PPP_WORDS, *EIDL_WORDS, *LOAN_WORDS))


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def amount_in_text(amount: Column, text: Column) -> Column:
    """Whether the rounded amount stands in the text, with or without thousands commas."""
    whole = F.bround(amount, 0).cast("long")
    return text.contains(F.format_number(whole, 0)) | text.contains(whole.cast("string"))
