"""Towns, states and names that press releases mention."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import stored
from .addresses import STATE_CODE
from .places import TOWN_WORDS

#: Towns up to this number are sent to the executors as a set.
MOST_TOWNS = 100_000
WORDS = re.compile(r"[\w'’-]+")
RUN = re.compile(r"\b[^\W\d_a-z][\w'’-]*(?:[^\w'’-]+[^\W\d_a-z][\w'’-]*)*")
STATE_SHORT = re.compile(r"[(,]\s*([A-Z]{2})\b")
# a branch for each first letter, so that other places are passed over quickly
STATE_NAME = re.compile("(?:" + "|".join(rf"{c}(?<!\w{c})(?:{'|'.join(sorted((s[1:] for s in STATE_CODE if s[0] == c), key=len, reverse=True))})" for c in sorted({s[0] for s in STATE_CODE})) + r")\b")


CODES = set(STATE_CODE.values())


def states_in(text: str) -> list[str]:
    """Codes of the states that a text names in full, or as two capitals in brackets or after a comma."""
    full = set().union(*map(_states, text.split("\n")))
    return sorted(full | {m for m in STATE_SHORT.findall(text) if m in CODES})


@lru_cache(4000)
def _states(line: str) -> frozenset[str]:
    return frozenset(STATE_CODE[m] for m in STATE_NAME.findall(line.upper()))


@lru_cache(50_000)
def _letters(word: str) -> str:
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    return TOWN_WORDS.get(w, w)


def capitals(text: str) -> set[str]:
    """One to three capitalised words in a row of a line, as town() writes them; lines that come back are read once."""
    return set().union(*map(_capitals, text.split("\n")))


@lru_cache(4000)
def _capitals(line: str) -> frozenset[str]:
    out = set()
    for run in RUN.findall(line):
        full = [_letters(w) for w in WORDS.findall(run)]
        for i, s in enumerate(full):
            out.add(s)
            if i + 1 < len(full):
                s += full[i + 1]
                out.add(s)
                if i + 2 < len(full):
                    out.add(s + full[i + 2])
    return frozenset(out)


def known_towns(places: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(place, town, state) of known places(place), and their towns as a set on the executors.

    The set is there so that only known towns leave Python. Beyond MOST_TOWNS towns it is None and all words leave;
    the join with the places gives the same rows either way.
    """
    known = stored(places, "places").select("place", F.substring_index("place", "/", 1).alias("town"), F.substring_index("place", "/", -1).alias("state"))
    few = [x[0] for x in known.select("town").distinct().limit(MOST_TOWNS + 1).collect()]
    return known, places.sparkSession.sparkContext.broadcast(frozenset(few) if len(few) <= MOST_TOWNS else None)


def towns_in(text: str, towns: frozenset[str] | None) -> tuple[list[str], list[str]]:
    """(towns, states) that a text mentions; all runs of capitalised words where towns is None."""
    said = capitals(text)
    said = sorted(said & towns if towns is not None else said - {""})
    return said, states_in(text) if said else []


def places_of(said: DataFrame, known: DataFrame) -> DataFrame:
    """(id, place) of said(id, towns, states): places of each town, those of states that are named if any is."""
    hit = said.select("id", "states", F.explode("towns").alias("town")).join(known, "town")
    inside = F.array_contains("states", F.col("state"))
    per = hit.groupBy("id", "town").agg(F.collect_set(F.when(inside, F.col("place"))).alias("named"), F.collect_set("place").alias("all"))
    return per.select("id", F.explode(F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("all"))).alias("place")).distinct()


def release_places(releases: DataFrame, places: DataFrame, id: str, text: str) -> DataFrame:
    """(id, place): known places(place) that a text mentions by town; those of states it names, if it names any.

    Null ids and texts give nothing; repeated rows count once.
    """
    r = releases.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())  # repeated rows give the same places again
    known, sent = known_towns(places)
    strings = pa.list_(pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            towns, states = zip(*(towns_in(t, sent.value) for t in b.column("text").to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(towns, strings), pa.array(states, strings)], names=["id", "towns", "states"])

    said = r.mapInArrow(read, f"id {r.schema['id'].dataType.simpleString()}, towns array<string>, states array<string>")
    return places_of(said, known)
