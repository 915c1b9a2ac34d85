"""Towns and post codes as people typed them, made comparable. Used by the address, name and release operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import stored, stored_counted

#: Abbreviations in town names.
TOWN_WORDS = {"FT": "FORT", "MT": "MOUNT", "ST": "SAINT", "STE": "SAINT", "HTS": "HEIGHTS", "HGTS": "HEIGHTS", "HEIGTS": "HEIGHTS", "SPGS": "SPRINGS", "SPG": "SPRINGS", "JCT": "JUNCTION", "PT": "PORT", "LK": "LAKE", "N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "BCH": "BEACH", "PK": "PARK"}


def zip5(c: str) -> Column:
    """The first five digits of a post code, a lost leading 0 put back; null where there are fewer or all are 0."""
    d = F.translate(F.coalesce(F.col(c), F.lit("")), "- ", "")
    d = F.when(d.rlike("^[0-9]*$"), d).otherwise(F.regexp_replace(d, "[^0-9]", ""))
    d = F.when(F.length(d).isin(4, 8), F.concat(F.lit("0"), d)).otherwise(d)
    z = F.substring(d, 1, 5)
    return F.when((F.length(d) >= 5) & (z != "00000"), z)


def town(c: str) -> Column:
    """Upper-case letters of a town name in full words without blanks; null where nothing is left."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^A-Z]+", " "), "^ ?(CITY|TOWN|VILLAGE) OF ", "")), " ")
    table = F.create_map(*[F.lit(x) for kv in TOWN_WORDS.items() for x in kv])
    full = F.array_join(F.transform(words, lambda w: F.coalesce(table[w], w)), "")
    typed = F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^A-Z]", "")
    return F.when(typed.isin("", "NA", "TBD", "UNKNOWN", "NONE"), None).otherwise(full)


class Towns(NamedTuple):
    """zips(zip5, ztown, zstate): the most frequent town of each post code. known(_town, _state): those towns, once
    each. cities(_raw, _town): every spelling of a town with its standard form, read once and not for every row.

    All three are written, so their sizes are known; a table is sent to the executors only up to MOST_SENT rows.
    """

    zips: DataFrame
    known: DataFrame
    cities: DataFrame


MOST_SENT = 500_000


def _sent(df: DataFrame, name: str) -> DataFrame:
    df, n = stored_counted(df, name)
    return F.broadcast(df) if n <= MOST_SENT else df


def towns_of(df: DataFrame, city: str = "borrower_city", state: str = "borrower_state", zip_: str = "borrower_zip") -> Towns:
    """The towns of a table of addresses."""
    # the combinations of the table in one pass; all else comes from them
    raw = df.select(F.col(city).alias("_raw"), zip5(zip_).alias("zip5"), F.upper(F.trim(F.coalesce(F.col(state), F.lit("")))).alias("zstate"))
    raw = stored(raw.where(F.col("_raw").isNotNull()).groupBy("zip5", "_raw", "zstate").agg(F.count(F.lit(1)).alias("n")), "typed_towns")
    cities = _sent(raw.select("_raw").distinct().select("_raw", town("_raw").alias("_town")).where(F.col("_town").isNotNull()), "cities")
    seen = raw.where(F.col("zip5").isNotNull()).join(cities, "_raw").groupBy("zip5", F.col("_town").alias("ztown"), "zstate").agg(F.sum("n").alias("n"))
    zips = _sent(seen.groupBy("zip5").agg(F.max(F.struct("n", "ztown", "zstate")).alias("b")).where("b.n >= 2").select("zip5", "b.ztown", "b.zstate"), "towns")
    known = _sent(zips.select(F.col("ztown").alias("_town"), F.col("zstate").alias("_state")).distinct().withColumn("_known", F.lit(True)), "known")
    return Towns(zips, known, cities)


def known_places(towns: Towns) -> DataFrame:
    return towns.known.select(F.concat_ws("/", "_town", "_state").alias("place")).distinct()


def with_place(df: DataFrame, towns: Towns, city: str = "borrower_city", state: str = "borrower_state", zip_: str = "borrower_zip") -> DataFrame:
    """Adds zip5 and place (town and state; null if unknown).

    A town is known if it is the most frequent one of some post code. Where the typed town isn't known in its state
    (a typing error or a blank), the town of the post code takes its place; so does its state where that is blank.
    """
    d = df.withColumn("zip5", zip5(zip_)).withColumn("_raw", F.col(city)).withColumn("_state", F.upper(F.trim(F.coalesce(F.col(state), F.lit("")))))
    got = d.join(towns.cities, "_raw", "left").join(towns.zips, "zip5", "left").join(towns.known, ["_town", "_state"], "left")
    blank = F.col("_state") == ""
    name = F.when(F.col("_known"), F.col("_town")).when(F.col("ztown").isNotNull() & (blank | (F.col("zstate") == F.col("_state"))), F.col("ztown")).otherwise(F.coalesce("_town", "ztown"))
    region = F.when(blank & F.col("ztown").isNotNull(), F.col("zstate")).otherwise(F.col("_state"))
    return got.withColumn("place", F.concat_ws("/", name, F.when(name.isNotNull(), region))).withColumn("place", F.when(F.col("place") != "", F.col("place"))).drop("_raw", "_town", "_state", "ztown", "zstate", "_known")
