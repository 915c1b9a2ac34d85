"""Problem 1: the same postal address written differently, by probabilistic linkage with weights from EM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STATES
from ._runtime import stored
from .components import boruvka_groups
from .places import towns_of, with_place

# Street types and directions with the forms people type.
TYPES = {
    "AVE": "AVENUE AVE AV", "ST": "STREET STR ST", "RD": "ROAD RD", "BLVD": "BOULEVARD BLVD BOUL BLV", "DR": "DRIVE DRV DR", "LN": "LANE LN", "CT": "COURT CT CRT", "PL": "PLACE PL",
    "PKWY": "PARKWAY PKWY PKY PWY PKWAY", "CIR": "CIRCLE CIR CIRC", "TER": "TERRACE TER TERR", "WAY": "WAY WY", "SQ": "SQUARE SQ", "TRL": "TRAIL TRL TR", "PLZ": "PLZ", "LOOP": "LOOP", "ALY": "ALLEY ALY", "XING": "CROSSING XING", "PIKE": "PIKE", "EXPY": "EXPRESSWAY EXPY",
}
DIRECTIONS = {"N": "NORTH NO N NTH", "S": "SOUTH SO S STH", "E": "EAST E", "W": "WEST W", "NE": "NORTHEAST NE", "NW": "NORTHWEST NW", "SE": "SOUTHEAST SE", "SW": "SOUTHWEST SW"}
ORDINALS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH TWENTIETH".split()
TYPE_OF = {w: k for k, ws in TYPES.items() for w in ws.split()}
DIRECTION_OF = {w: k for k, ws in DIRECTIONS.items() for w in ws.split()}
ORDINAL_OF = {w: str(i + 1) for i, w in enumerate(ORDINALS)} | {f"{t}{o}": str(20 + 10 * a + b + 1) for a, t in enumerate(("TWENTY", "THIRTY", "FORTY", "FIFTY", "SIXTY", "SEVENTY", "EIGHTY", "NINETY")) for b, o in enumerate(ORDINALS[:9])}
#: Words of street names that look like a misspelt type.
NO_TYPES = set("LAKE LAND LANES PARK PLAIN PLAINS COUNT ROAM TRAIN STEEP COURTS PLACER".split())
WORDS = {"FT": "FORT", "MT": "MOUNT", "SAINT": "SAINT", "CNTY": "COUNTY"}

CARE = re.compile(r"\b(?:C/O|CARE OF|ATTN:?|ATTENTION:?)[^,]*(?:,|$)")
BOX = re.compile(r"\b(?:P\W{0,2}O\W{0,2}|POST\s+OFFICE\s+)?B(?:O?X)\W{0,2}(?:NO\.?|NUMBER|#)?\W{0,2}(\d+)|\bP\W?O\W?B\W{0,2}(\d+)")
FLOOR = re.compile(r"\b\d+\s?(?:ST|ND|RD|TH)\s+(?:FLOOR\b|FLR?\b(?!\s*\d))|\b(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|GROUND|TOP)\s+FL(?:OOR|R)?\b")
UNIT = re.compile(r"(?:\b(?:SUITE|STE|UNIT|APARTMENT|APT|ROOM|RM|OFFICE|OFC|DEPARTMENT|DEPT|BUILDING|BLDG|BLD|FLOOR|FLR|FL|LOT|SPACE|SPC|TOWER|TWR|PMB|WING|LEVEL|LVL)\b\.?\s*(?:NO\.?\s*|#\s*)?|#\s*)(?:[A-Z]?\d+(?:\s?-\s?[A-Z\d]+)*[A-Z]?|[A-Z](?:\s?-\s?\d+)?|ONE|TWO|THREE|FOUR|FIVE)\b")
REAR = re.compile(r"\bREAR(?:\s+OF)?\b")
NUMBER = re.compile(r"\b(?:NO|NUM|NUMBER|NR)\b\.?\s*(\d+)\b")
HIGHWAY = re.compile(r"\b(?:(?:U\.?\s?S\.?|STATE|ST|COUNTY|CO|INTERSTATE)\.?\s+)?(?:HIGHWAY|HWY|HIWAY|ROUTE|RTE|RT)\b\.?\s*(?:NO\.?\s*)?#?(\d+)\b")
ORDINAL = re.compile(r"\b(\d*?)(1?\d)(\s?)(ST|ND|RD|TH)\b")
TWO_LETTERS = re.compile(r"\b([NS])\.\s?([EW])\b\.?")
PLAIN_FRONT = re.compile(r"\W*\d+\b(?!\s?(?:ST|ND|RD|TH)\b)")
#: States, as they end an address that repeats the town.
STATE_CODE = {name.upper(): code for code, name in STATES.items()} | {"PUERTO RICO": "PR"}
TAIL = re.compile(rf",\s*[A-Z][A-Z .']*?,?\s+(?:{'|'.join([*STATE_CODE, *STATE_CODE.values()])})\W*(?:\d{{5}}(?:-\d{{4}})?)?\W*$")
TENS = re.compile(r"\b(TWENTY|THIRTY|FORTY|FIFTY|SIXTY|SEVENTY|EIGHTY|NINETY)[\s-]+(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH)\b")
TOKEN = re.compile(r"[^\W_]+")


def _ordinal(m: re.Match) -> str:
    """26TH and 26 TH become one token; "4815 ST. ORIEL" stays as it is."""
    n, last, gap, end = m[1] + m[2], m[2], m[3], m[4]
    right = "TH" if len(last) == 2 or last in "0456789" else ("ST", "ND", "RD")[int(last) - 1]
    return f" {n}TH " if not gap or (end == right and len(n) < 4) else m[0]


@lru_cache(1)
def _near_types() -> dict[str, str]:
    """One letter left out of a long street type."""
    return {w[:i] + w[i + 1 :]: k for k, ws in TYPES.items() for w in ws.split() if len(w) >= 4 for i in range(len(w))}


@lru_cache(100_000)
def street_type(w: str) -> str | None:
    """A street type, or a word one typing error away from a long one."""
    if w in TYPE_OF:
        return TYPE_OF[w]
    if len(w) < 3 or w in NO_TYPES:
        return None
    for i in range(len(w) - 1 if len(w) > 3 else 0):
        if (v := w[:i] + w[i + 1] + w[i] + w[i + 2 :]) in TYPE_OF:
            return TYPE_OF[v]
    near = _near_types()
    if w in near:
        return near[w]
    for i in range(len(w)):
        d = w[:i] + w[i + 1 :]
        if d in TYPE_OF and len(d) >= 4:
            return TYPE_OF[d]
        if d in near and len(w) >= 4:
            return near[d]
    return None


def parse(address: str | None, city: str | None = None) -> tuple[str, str, str, str] | None:
    """(number, street, type, direction) of an address; the street is "PO BOX" for boxes; None if unusable.

    Addressees, floors, suites and a repeated town are left out; type and direction may be "".
    """
    if not address:
        return None
    a = address.upper().replace("\xa0", " ")
    a = CARE.sub(" ", a)
    if city and (c := re.sub(r"^(?:CITY|TOWN) OF ", "", city.upper().strip())) and len(c) > 3:
        i = a.rfind(c)
        if i > 5:
            a = a[:i]
    if m := BOX.search(a):
        return (m[1] or m[2]).lstrip("0") or "0", "PO BOX", "", ""
    a = TWO_LETTERS.sub(r"\1\2 ", FLOOR.sub(" ", a))
    number = None
    if (m := NUMBER.search(a)) and not PLAIN_FRONT.match(UNIT.sub(" ", a[: m.start()])):
        number = m[1]
        a = a[: m.start()] + " " + a[m.end() :]
    a = REAR.sub(" ", UNIT.sub(" ", a))
    if (m := TAIL.search(a)) and re.search(r"[A-Z]{3}|\d(?:ST|ND|RD|TH)", a[: m.start()]):
        a = a[: m.start()]
    if number is None and (m := re.match(r"[^\d,]*,\W*(?=\d+\W+\w)", a)):
        a = a[m.end() :]  # the building's name in front
    elif m := re.match(r"[^\d,]*\b(?:PLAZA|CENTER|CENTRE|MALL|COMPLEX|TOWERS?)\s*,(?=[^,]*[A-Z]{3})", a):
        a = a[m.end() :]
    road = None
    if m := HIGHWAY.search(a):
        road = "HWY " + m[1]
        a = a[: m.start()] + " " + a[m.end() :]
    a = TENS.sub(r"\1\2", a)
    a = ORDINAL.sub(_ordinal, a)
    t = TOKEN.findall(a)
    if number is None:
        # a number in front, else at the end; ordinals are no house numbers
        for i in (0, -1):
            if t and t[i][0].isdigit() and not t[i].endswith("TH"):
                number = t.pop(i)
                break
        else:
            digits = [i for i, w in enumerate(t) if w.isdigit()]
            if digits:
                number = t.pop(digits[0])
    if number is None:
        return None
    if road:
        return number.lstrip("0"), road, "", next((DIRECTION_OF[w] for w in t if w in DIRECTION_OF), "")
    kind = way = ""
    # directions in front or at the end; "NO" is north here, numbers were taken before
    if len(t) > 1 and t[0] in DIRECTION_OF:
        way = DIRECTION_OF[t.pop(0)]
    if len(t) > 1 and t[-1] in DIRECTION_OF:
        way = way or DIRECTION_OF[t[-1]]
        t.pop()
    if len(t) > 1 and (k := street_type(t[-1])):
        kind = k
        t.pop()
    if len(t) > 1 and t[-1] in DIRECTION_OF:
        way = way or DIRECTION_OF[t[-1]]
        t.pop()
    if not t:
        return None
    if len(t) > 1 and t[0] == "ST":
        t[0] = "SAINT"
    name = "".join(ORDINAL_OF.get(w, w[:-2] if w[0].isdigit() and w.endswith("TH") else WORDS.get(w, w)) for w in t)
    return number.lstrip("0"), name, kind, way


# Agreement levels of the linkage model; each field has a level for a value missing on a side.
STREET, ZIP, TOWN = ("same", "part missing", "misspelt", "other type", "different"), ("same", "misspelt", "missing", "different"), ("same", "missing", "different")
# Start values by level; m for matches, u for the rest.
M0 = ((0.60, 0.24, 0.158, 0.001, 0.001), (0.93, 0.02, 0.04, 0.01), (0.96, 0.03, 0.01))
U0 = ((0.01, 0.005, 0.01, 0.10, 0.875), (0.70, 0.02, 0.03, 0.25), (0.90, 0.05, 0.05))
#: m of these street levels is held: whatever the counts, another street is no spelling of the same place. The
#: street's u is held too: the chance that two streets agree is set by how many street names there are; candidates
#: of one block say nothing about it, as most of them are matches.
HELD = (3, 4)
#: Weight of the start values, in pairs, so that no level goes to 0.
PRIOR = 200.0


def estimate(cells: list[tuple[int, int, int, float]], rounds: int = 500) -> tuple[dict[tuple[int, int, int], float], list[np.ndarray], list[np.ndarray], float]:
    """Fellegi-Sunter by EM over counts of agreement patterns: posterior of each pattern, m, u, share of matches."""
    x = np.array([c[:3] for c in cells], int).reshape(-1, 3)
    n = np.array([c[3] for c in cells], float)
    m, u, p = [np.array(v) for v in M0], [np.array(v) for v in U0], 0.5
    held = list(HELD)
    for _ in range(rounds):
        a = p * np.prod([m[f][x[:, f]] for f in range(3)], axis=0)
        b = (1 - p) * np.prod([u[f][x[:, f]] for f in range(3)], axis=0)
        g = a / (a + b)
        new = (float((g * n).sum()) + 1) / (float(n.sum()) + 2)
        done = abs(new - p) < 1e-9
        p = new
        for f, (m0, u0) in enumerate(zip(M0, U0)):
            for v, w, prior in ((m, g, m0), (u, 1 - g, u0)):
                c = np.bincount(x[:, f], w * n, len(prior)) + PRIOR * np.array(prior)
                if f or v is m:
                    v[f] = c / c.sum()
        free = [i for i in range(len(STREET)) if i not in held]
        fixed = np.array(M0[0])
        m[0][free] *= (1 - fixed[held].sum()) / m[0][free].sum()
        m[0][held] = fixed[held]
        if done:
            break
    post = {}
    for s in range(len(STREET)):
        for z in range(len(ZIP)):
            for t in range(len(TOWN)):
                a, b = p * m[0][s] * m[1][z] * m[2][t], (1 - p) * u[0][s] * u[1][z] * u[2][t]
                post[s, z, t] = float(a / (a + b))
    return post, m, u, p


def _sound(c: str) -> F.Column:
    """A key of a street's sound: Soundex for words, the text itself for numbered ones."""
    return F.when(F.col(c).rlike("^[A-Z]+$"), F.soundex(c)).otherwise(F.col(c))


def same_places(loans: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(loan_number, spot) and links(spot_a, spot_b, probability) with spot_a < spot_b.

    A spot is one distinct parsed address: number, street, type, direction, post code, town. Loans of one spot share
    a place; links join different spots of one place. Spots are compared only within the blocks number + post code
    and number + town + sound of the street; a block holds distinct spellings, not loans, so a building with a
    third of all loans stays small. Agreement patterns are counted over all candidate pairs, EM on the (at most 60)
    counts gives the weights, and each candidate gets its posterior.

    Loans without a usable address, or without both town and post code, have no spot. Null loan numbers are dropped;
    repeated rows count once; a loan typed with two addresses has two spots. A spelling without a street type or
    direction agrees with every one at its number and street.
    """
    rows = with_place(loans.select("loan_number", "borrower_address", "borrower_city", "borrower_state", "borrower_zip").where(F.col("loan_number").isNotNull()), towns_of(loans))
    rows = rows.select("loan_number", "borrower_address", "borrower_city", "zip5", "place")
    loan_kind = rows.schema["loan_number"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse(a, c) or (None,) * 4 for a, c in zip(b["borrower_address"], b["borrower_city"])]
            out = b[["loan_number", "zip5", "place"]].copy()
            for i, k in enumerate(("num", "street", "kind", "way")):
                out[k] = [g[i] for g in got]
            yield out[out["street"].notna()]

    parsed = rows.where(F.col("borrower_address").rlike("[0-9]")).mapInPandas(read, f"loan_number {loan_kind}, zip5 string, place string, num string, street string, kind string, way string")
    spot = F.xxhash64("num", "street", "kind", "way", F.coalesce("zip5", F.lit("-")), F.coalesce("place", F.lit("-")))
    parsed = stored(parsed.where("zip5 is not null or place is not null").withColumn("spot", spot).dropDuplicates(["loan_number", "spot"]), "addresses")
    spots = parsed.select("spot", "num", "street", "kind", "way", "zip5", "place").dropDuplicates(["spot"])
    keyed = spots.withColumn("block", F.explode(F.array(F.xxhash64(F.lit("z"), "num", "zip5", F.col("street") == "PO BOX"), F.xxhash64(F.lit("t"), "num", "place", _sound("street")))))
    keyed = keyed.where(~((F.col("block") == F.xxhash64(F.lit("z"), "num", "zip5", F.col("street") == "PO BOX")) & F.col("zip5").isNull()) & ~((F.col("block") == F.xxhash64(F.lit("t"), "num", "place", _sound("street"))) & F.col("place").isNull()))
    a, b = (keyed.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("spot", "num", "street", "kind", "way", "zip5", "place")]) for s in "ab")
    pair = a.join(b, "block").where((F.col("spot_a") < F.col("spot_b")) & (F.col("num_a") == F.col("num_b")))
    differ = lambda c: (F.col(f"{c}_a") != F.col(f"{c}_b")) & (F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != "")
    lacking = lambda c: (F.col(f"{c}_a") == "") != (F.col(f"{c}_b") == "")
    far = F.levenshtein("street_a", "street_b", 4)
    shorter = F.least(F.length("street_a"), F.length("street_b"))
    letters = F.levenshtein(F.array_join(F.array_sort(F.split("street_a", "")), ""), F.array_join(F.array_sort(F.split("street_b", "")), ""), 2)
    words = F.col("street_a").rlike("^[A-Z]") & F.col("street_b").rlike("^[A-Z]") & ~F.col("street_a").startswith("HWY ") & ~F.col("street_b").startswith("HWY ") & (F.col("street_a") != "PO BOX") & (F.col("street_b") != "PO BOX")
    close = words & (far >= 0) & ((far <= F.when(shorter >= 10, 3).when(shorter >= 6, 2).otherwise(1)) | ((shorter >= 4) & (far <= F.when(shorter >= 7, 4).otherwise(2)) & (letters >= 0)))
    street = F.when(F.col("street_a") == F.col("street_b"), F.when(differ("kind") | differ("way"), 3).when(lacking("kind") | lacking("way"), 1).otherwise(0)).when(close & ~differ("kind") & ~differ("way"), 2).otherwise(4)
    z = F.levenshtein("zip5_a", "zip5_b", 2)
    swapped = F.array_sort(F.split("zip5_a", "")) == F.array_sort(F.split("zip5_b", ""))
    zip_ = F.when(F.col("zip5_a").isNull() | F.col("zip5_b").isNull(), 2).when(F.col("zip5_a") == F.col("zip5_b"), 0).when((z == 2) & swapped, 1).otherwise(3)
    place = F.when(F.col("place_a").isNull() | F.col("place_b").isNull(), 1).when(F.col("place_a") == F.col("place_b"), 0).otherwise(2)
    cand = stored(pair.select("spot_a", "spot_b", street.alias("s"), zip_.alias("z"), place.alias("t")).distinct(), "candidates")
    cells = [tuple(r) for r in cand.groupBy("s", "z", "t").count().collect()]  # at most 60 patterns
    post, *_ = estimate(cells)
    table = F.create_map(*[F.lit(v) for (s, zz, t), p in post.items() for v in (s * 100 + zz * 10 + t, p)])
    links = cand.withColumn("probability", table[F.col("s") * 100 + F.col("z") * 10 + F.col("t")]).where(F.col("probability") >= least).select("spot_a", "spot_b", "probability")
    return parsed.select("loan_number", "spot"), links


def same_address_pairs(loans: DataFrame, least: float = 0.5) -> DataFrame:
    """(loan_a, loan_b) of two different loan numbers at one place, loan_a < loan_b, each pair once."""
    members, links = same_places(loans, least)
    both = links.select("spot_a", "spot_b").unionByName(members.groupBy(F.col("spot").alias("spot_a")).count().where("count > 1").select("spot_a", F.col("spot_a").alias("spot_b")))
    a, b = (members.select(F.col("spot").alias(f"spot_{s}"), F.col("loan_number").alias(f"n_{s}")) for s in "ab")
    got = both.join(a, "spot_a").join(b, "spot_b").where("n_a <> n_b").select(F.least("n_a", "n_b").alias("loan_a"), F.greatest("n_a", "n_b").alias("loan_b"))
    return got.distinct()


def place_members(loans: DataFrame, least: float = 0.5) -> DataFrame:
    """(loan_number, place_id, links): one row a loan with a usable address, not one a pair.

    place_id is the same for all loans linked directly or indirectly; links counts the loans that a loan is linked to
    directly. So a building with a third of all loans takes a row for each loan.
    """
    members, links = same_places(loans, least)
    ends = stored(links.select("spot_a", "spot_b"), "spot_links")
    groups = boruvka_groups(ends, "spot_a", "spot_b").select(F.col("node").alias("spot"), F.col("group_id").alias("place_id"))
    size = members.groupBy("spot").agg(F.count(F.lit(1)).alias("n"))
    there = ends.select(F.col("spot_a").alias("spot"), F.col("spot_b").alias("other")).unionByName(ends.select(F.col("spot_b").alias("spot"), F.col("spot_a").alias("other")))
    near = there.join(size.select(F.col("spot").alias("other"), "n"), "other").groupBy("spot").agg(F.sum("n").alias("near"))
    spots = size.join(near, "spot", "left").join(groups, "spot", "left").select("spot", F.coalesce("place_id", "spot").alias("place_id"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    # a loan typed with two addresses counts once, in the place with the smaller id
    return members.join(spots, "spot").groupBy("loan_number").agg(F.min("place_id").alias("place_id"), F.sum("links").alias("links"))
