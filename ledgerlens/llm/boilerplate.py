"""Problem 2: lines that come back across the documents of one source, found by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import few, stored

WINDOW, AVERAGE = 5, 16


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letter (0: none) of each code point of the basic plane; two random words a code point."""
    low = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if (s := chr(c)).isalpha():
            low[c] = ord(s.lower()[0])
    r = np.random.default_rng(20240229)
    return low, r.integers(1, 1 << 63, 1 << 16, dtype=np.uint64), r.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def _letters(code: np.ndarray) -> np.ndarray:
    low, _, _ = _tables()
    out = low[np.minimum(code, 0xFFFF)]
    for c in np.unique(code[code > 0xFFFF]):
        s = chr(c)
        out[code == c] = ord(s.lower()[0]) if s.isalpha() else 0
    return out


def chunks_of(texts: list[str], by_line: bool, window: int = WINDOW, average: int = AVERAGE) -> pd.DataFrame:
    """(doc, line, hash, start, end) for every chunk of the letters of each text; start and end in code points.

    A rolling hash over the last `window` letters cuts where it falls on a multiple of `average`, so a cut depends
    on the letters just before it and on nothing else. by_line also cuts at line ends and starts the window anew
    there, so that the chunks of a line depend on the line alone, however short it is.
    """
    code = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(c) for c in code], np.int64)
    empty = pd.DataFrame({k: np.array([], np.int64) for k in ("doc", "line", "hash", "start", "end")})
    if not size.sum():
        return empty
    flat = np.concatenate(code)
    doc = np.repeat(np.arange(len(texts)), size)
    first = np.cumsum(size) - size
    breaks = np.cumsum(flat == 10)
    line = breaks - np.where(size > 0, (breaks - (flat == 10))[np.minimum(first, len(flat) - 1)], 0)[doc] - (flat == 10)
    low = _letters(flat)
    at = np.flatnonzero(low)
    if not len(at):
        return empty
    _, g1, g2 = _tables()
    x = low[at]
    d, ln = doc[at], line[at]
    unit = np.r_[True, (d[1:] != d[:-1]) | ((ln[1:] != ln[:-1]) if by_line else False)]
    n = np.arange(len(at))
    pos = n - np.maximum.accumulate(np.where(unit, n, 0))
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for j in range(window):
            h[j:] += g1[x[: len(x) - j] & 0xFFFF] << np.uint64(j)
        cut = (pos >= window - 1) & (((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(average) == 0)
        new = np.flatnonzero(unit | np.r_[False, cut[:-1]])
        inside = n - np.repeat(new, np.diff(np.r_[new, len(n)]))
        power = np.ones(int(inside.max()) + 1, np.uint64)
        power[1:] = np.uint64(0xD6E8FEB86659FD93)
        power = np.multiply.accumulate(power)
        value = np.add.reduceat(g2[x & 0xFFFF] * power[inside] + x.astype(np.uint64), new)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
    last = np.r_[new[1:], len(n)] - 1
    return pd.DataFrame({"doc": d[new], "line": ln[new] + 1, "hash": value.view(np.int64), "start": at[new] - first[d[new]], "end": at[last] - first[d[new]] + 1})


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\0"))


def _thresholds(docs: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(src, least): the number of documents from which on something is repeated excessively in a source."""
    return docs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select("src", F.greatest(F.lit(min_docs), F.ceil(F.col("n") * min_share - 1e-9)).cast("long").alias("least"))


def _often(keyed: DataFrame, what: str, least: DataFrame) -> DataFrame:
    """(src, what) found in at least `least` distinct documents of the source; counts are combined before shuffles."""
    per = keyed.select("src", what, "id").distinct().groupBy("src", what).agg(F.count(F.lit(1)).alias("docs"))
    return per.join(least, "src").where("docs >= least").select("src", what, "docs")


def repeated_lines(df: DataFrame, id: str = "id", source: str = "source", text: str = "body", min_docs: int = 3, min_share: float = 0.05, letters: bool = True) -> DataFrame:
    """(id, line_no, line_letters, docs): lines of a text that come back in the documents of its source.

    Only letters count, without case. Texts are cut into chunks by a rolling hash (with line ends as further cuts,
    see chunks_of); chunks are counted per source. A line all of whose chunks are frequent is a candidate: every line
    that is itself frequent is one, as each of its chunks is in at least as many documents. The distinct documents of
    the candidates' whole lines are then counted, by 128 bits of hashes of their letters. Without `letters` the column
    line_letters is left out, and no text is sent anywhere.

    docs is the number of distinct ids of the source that have the line: at least min_docs and min_share of all
    distinct ids of the source. Rows with a null id or text are skipped (a null text still counts as a document of
    its source), a null source is a source of its own, repeated rows count once, lines without letters are never
    found. Empty in, empty out.
    """
    base = df.select(F.col(id).alias("id"), _key(source).alias("src"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    kind = base.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["text"].notna()]
            # one very long text at a time, else a few thousand characters each
            parts = max(1, int(b["text"].str.len().sum() // 2_000_000))
            for part in (b.iloc[i::parts] for i in range(parts)):
                texts = part["text"].tolist()
                c = chunks_of(texts, True)
                if not len(c):
                    continue
                ids, srcs = part["id"].to_numpy(), part["src"].to_numpy()
                new = np.flatnonzero(np.r_[True, (np.diff(c["doc"]) != 0) | (np.diff(c["line"]) != 0)])
                end = np.r_[new[1:], len(c)]
                doc, line, start, stop = c["doc"].to_numpy(), c["line"].to_numpy(), c["start"].to_numpy(), c["end"].to_numpy()
                value = c["hash"].to_numpy()
                said = ["".join(filter(str.isalpha, texts[doc[i]][start[i] : stop[j - 1]])).lower() for i, j in zip(new, end)]
                yield pd.DataFrame({"id": ids[doc[new]], "src": srcs[doc[new]], "line_no": line[new], "letters": said, "chunks": [np.unique(value[i:j]) for i, j in zip(new, end)]})

    # lines travel by the hashes of their letters, 128 bits in all; the letters themselves stay in the table
    hashed = base.distinct().mapInPandas(cut, f"id {kind}, src string, line_no long, letters string, chunks array<long>")
    lines = stored(hashed.withColumns({"h1": F.xxhash64("letters"), "h2": F.xxhash64(F.reverse("letters"), F.length("letters"))}), "lines")
    least = stored(_thresholds(base.select("src", "id").distinct(), min_docs, min_share), "sources")
    # lines are counted here, not documents: no less, so no chunk that is frequent is missed, and combined before the shuffle
    frequent = lines.select("src", F.explode("chunks").alias("chunk")).groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n")).join(least, "src").where("n >= least")
    frequent = few(frequent.select(F.xxhash64("src", "chunk").alias("key")).distinct())
    place = lines.select("id", "src", "line_no", "h1", "h2", F.size("chunks").alias("k"), F.explode("chunks").alias("chunk"))
    whole = place.withColumn("key", F.xxhash64("src", "chunk")).join(frequent, "key", "left_semi")
    # a line's chunks stand in one part, so nearly all is combined before the shuffle
    candidates = stored(whole.groupBy("id", "src", "line_no", "h1", "h2", "k").agg(F.count(F.lit(1)).alias("hits")).where("hits >= k").drop("k", "hits"), "candidates")
    per = candidates.select("src", "h1", "h2", "id").distinct().groupBy("src", "h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
    exact = per.join(least, "src").where("docs >= least").select("src", "h1", "h2", "docs")
    found = candidates.join(exact, ["src", "h1", "h2"])
    if not letters:
        return found.select("id", "line_no", "docs").distinct()
    said = lines.select("src", "h1", "h2", "letters").join(exact.select("src", "h1", "h2"), ["src", "h1", "h2"], "left_semi").groupBy("src", "h1", "h2").agg(F.min("letters").alias("line_letters"))
    return found.join(said, ["src", "h1", "h2"]).select("id", "line_no", "line_letters", "docs").distinct()


def without_repeated_lines(df: DataFrame, id: str = "id", source: str = "source", text: str = "body", min_docs: int = 3, min_share: float = 0.05) -> DataFrame:
    """The distinct (id, source, text) of df with the found lines taken out, and lines_cut, their number."""
    found = repeated_lines(df, id, source, text, min_docs, min_share, letters=False).groupBy(F.col("id").alias("_id")).agg(F.collect_set("line_no").alias("_cut"))
    rows = df.select(id, source, text).distinct()
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(F.transform(lines, lambda s, i: F.struct(s.alias("s"), (i + 1).cast("long").alias("i"))), lambda x: ~F.array_contains("_cut", x["i"]))
    got = rows.join(found, F.col(id) == F.col("_id"), "left")
    return got.select(id, source, F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda x: x["s"]), "\n")).alias(text), F.coalesce(F.size("_cut"), F.lit(0)).alias("lines_cut"))


def without_repeated_chunks(df: DataFrame, id: str = "id", source: str = "source", text: str = "body", min_docs: int = 3, min_share: float = 0.05) -> DataFrame:
    """As without_repeated_lines, but for texts without usable line ends: repeated chunks are cut wherever they stand.

    (id, source, text, letters_cut). Edges of a repeated passage share a chunk with its surroundings and stay.
    """
    base = df.select(F.col(id).alias("id"), _key(source).alias("src"), F.col(text).alias("text")).where(F.col("id").isNotNull()).distinct()
    kind = base.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["text"].notna()]
            c = chunks_of(b["text"].tolist(), False)
            yield pd.DataFrame({"id": b["id"].to_numpy()[c["doc"]], "src": b["src"].to_numpy()[c["doc"]], "chunk": c["hash"], "a": c["start"], "z": c["end"]})

    parts = stored(base.mapInPandas(cut, f"id {kind}, src string, chunk long, a long, z long"), "chunks")
    least = _thresholds(base.select("src", "id").distinct(), min_docs, min_share)
    spans = parts.join(_often(parts, "chunk", least), ["src", "chunk"]).groupBy(F.col("id").alias("_id"), F.col("src").alias("_src")).agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("spans"))
    start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at"))
    joined = df.select(id, source, text).distinct().join(spans, (F.col(id) == F.col("_id")) & (_key(source) == F.col("_src")), "left")
    rest = F.aggregate("spans", start, lambda s, x: F.struct(F.concat(s["t"], F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["a"] - s["at"]).cast("int"))).alias("t"), x["z"].alias("at")))
    whole = F.concat(rest["t"], F.substring(F.col(text), (rest["at"] + 1).cast("int"), F.length(text)))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["z"] - x["a"])
    return joined.select(id, source, F.when(F.col("spans").isNull(), F.col(text)).otherwise(whole).alias(text), F.coalesce(gone, F.lit(0)).alias("letters_cut"))
