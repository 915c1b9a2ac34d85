"""Problem 8: passages of evaluation items inside a corpus, by SimHash windows and a multi-index of Hamming blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import total_bytes

WORD = re.compile(r"[a-z0-9]+")
SHINGLE, SIMILAR = 5, 0.8


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and lengths of all texts in a row, and the text of each word."""
    lists = [words_of(t) for t in texts]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = [w for x in lists for w in x]
    if not flat:
        return np.array([], np.uint64), np.array([], np.int64), doc
    codes, unique = pd.factorize(np.array(flat, object))
    return np.array([xxhash.xxh64_intdigest(w) for w in unique], np.uint64)[codes], np.array([len(w) for w in unique])[codes], doc


def shingles(word: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (1 to 4, more for more letters) of the five words from each position on."""
    n = len(word) - SHINGLE + 1
    if n <= 0:
        return np.array([], np.uint64), np.array([], np.int32)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            h = _mix(h * np.uint64(3) + word[j : j + n])
    chars = sum(length[j : j + n] for j in range(SHINGLE))
    return h, (1 + (chars >= 15) + (chars >= 22) + (chars >= 30)).astype(np.int32)


def simhashes(shingle: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """64-bit SimHash of every run of k shingles."""
    bits = np.unpackbits(shingle.view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.zeros((len(shingle) + 1, 64), np.int32)
    np.cumsum(np.where(bits, weight[:, None], -weight[:, None]), axis=0, dtype=np.int32, out=votes[1:])
    return np.packbits(votes[k:] - votes[:-k] > 0, axis=1).view(np.uint64).ravel()


class Index:
    """SimHashes of all item windows, in radius + 1 blocks of bits.

    Two fingerprints within the radius differ in at most radius blocks, so they agree in at least one: looking up
    every block finds all of them.
    """

    def __init__(self, items: list[tuple[object, str | None]], size: int, radius: int):
        self.size, self.radius, self.ids = size, radius, [i for i, _ in items]
        word, length, item = hashed([t for _, t in items])
        self.word, self.item_of = word, item
        s, w = shingles(word, length)
        k = size - SHINGLE + 1
        self.k, self.shingle, self.weight = k, s, w
        n = len(s) - k + 1
        if n <= 0:
            self.at = np.array([], np.int64)
            return
        at = np.flatnonzero(item[:n] == item[size - 1 : size - 1 + n])
        self.at, self.print = at, simhashes(s, w, k)[at]
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, z in zip(edges[:-1], edges[1:]):
            key = self._block(self.print, a, z)
            order = np.argsort(key, kind="stable")
            low = np.searchsorted(key[order], np.arange(1 << min(16, z - a) if z - a <= 16 else 0, dtype=np.uint64))
            self.blocks.append((a, z, order, key[order], np.r_[low, len(order)] if z - a <= 16 else None))

    @staticmethod
    def _block(x: np.ndarray, a: int, z: int) -> np.ndarray:
        return (x >> np.uint64(a)) & np.uint64((1 << int(z - a)) - 1)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of the text, window of the items) of all fingerprints within the radius, once each."""
        left, right = [], []
        for b, (a, z, order, key, low) in enumerate(self.blocks):
            mine = self._block(prints, a, z)
            if low is not None:
                lo, hi = low[mine], low[mine + np.uint64(1)]
            else:
                lo, hi = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
            hit = np.flatnonzero(hi > lo)
            count = hi[hit] - lo[hit]
            step = max(1, int(2_000_000 / max(1.0, count.mean() if len(count) else 1)))
            for s in range(0, len(hit), step):
                h, c = hit[s : s + step], count[s : s + step]
                i = np.repeat(h, c)
                j = order[np.repeat(lo[h] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                differ = prints[i] ^ self.print[j]
                near = np.bitwise_count(differ) <= self.radius
                for a0, z0, *_ in self.blocks[:b]:  # found by an earlier block
                    near &= self._block(differ, a0, z0) != 0
                left.append(i[near])
                right.append(j[near])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.array([], np.int64),) * 2

    def matches(self, texts: list[str | None]) -> pd.DataFrame:
        """(doc, item, similarity, exact_windows) for each text and item with a window pair of similarity >= 0.8."""
        word, length, doc = hashed(texts)
        out = []
        n_all = len(word) - self.size + 1
        if not len(self.at) or n_all <= 0:
            return pd.DataFrame(columns=["doc", "item", "similarity", "exact_windows"])
        for s in range(0, n_all, 60_000):
            n = min(60_000, n_all - s)
            w, d = word[s : s + n + self.size - 1], doc[s : s + n + self.size - 1]
            sh, we = shingles(w, length[s : s + n + self.size - 1])
            inside = np.flatnonzero(d[:n] == d[self.size - 1 :])
            i, j = self.candidates(simhashes(sh, we, self.k)[inside])
            if not len(i):
                continue
            i, j = inside[i], self.at[j]
            sim = self._similarity(sh, we, i, j)
            same = np.ones(len(i), bool)
            for t in range(self.size):
                same &= w[i + t] == self.word[j + t]
            keep = sim >= SIMILAR - 1e-12
            out.append(pd.DataFrame({"doc": d[i][keep], "item": self.item_of[j][keep], "similarity": sim[keep], "exact_windows": same[keep].astype(np.int64)}))
        if not out:
            return pd.DataFrame(columns=["doc", "item", "similarity", "exact_windows"])
        return pd.concat(out).groupby(["doc", "item"], as_index=False).agg(similarity=("similarity", "max"), exact_windows=("exact_windows", "sum"))

    def _similarity(self, sh: np.ndarray, we: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the two windows' shingle sets."""
        at = np.arange(self.k)
        got = np.empty(len(i))
        for s in range(0, len(i), 20_000):
            a, wa = np.sort(sh[i[s : s + 20_000, None] + at], 1), we[i[s : s + 20_000, None] + at]
            b, wb = self.shingle[j[s : s + 20_000, None] + at], self.weight[j[s : s + 20_000, None] + at]
            a0 = sh[i[s : s + 20_000, None] + at]
            first_a = ~np.tril(a0[:, :, None] == a0[:, None, :], -1).any(2)
            first_b = ~np.tril(b[:, :, None] == b[:, None, :], -1).any(2)
            shared = ((b[:, :, None] == a0[:, None, :]).any(2) & first_b) * wb
            both = shared.sum(1)
            got[s : s + 20_000] = both / ((wa * first_a).sum(1) + (wb * first_b).sum(1) - both)
        return got


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, radius: int = 3, slice_bytes: int = 1 << 20
) -> DataFrame:
    """(doc_id, item_id, similarity, exact_windows) for every document and item with a nearly equal passage.

    Windows of `size` words (the shortest passage that counts as leaked) of items and documents get 64-bit SimHashes
    over weighted five-word shingles. All pairs of fingerprints within `radius` bits are found by the multi-index;
    they are verified by the exact weighted Jaccard similarity of their shingles, 0.8 or more. exact_windows counts
    the verified pairs of windows that are equal word by word, so it is above 0 exactly if text and item share at
    least `size` consecutive words: equal windows have equal fingerprints and cannot be missed.

    The items are the query set: they are sent to the executors in slices of at most about slice_bytes of text, one
    pass over the documents' windows per slice; documents are never shuffled. Texts are processed whole. Null texts,
    null ids and texts of fewer than `size` words match nothing; items with equal text are all reported; repeated
    rows give one row. Empty in, empty out.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    q = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    out = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {q.schema['item_id'].dataType.simpleString()}, similarity double, exact_windows long"
    spark = docs.sparkSession
    _, size_of_items = total_bytes(q, "text")
    slices = max(1, -(-size_of_items // slice_bytes))
    got = None
    for part in range(slices):
        rows = [(r[0], r[1]) for r in q.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part).collect()]
        sent = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(sent.value, size, radius)
            ids = np.array(index.ids, object)
            for b in batches:
                m = index.matches(b["text"].tolist())
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[m["doc"].to_numpy(np.int64)], "item_id": ids[m["item"].to_numpy(np.int64)], "similarity": m["similarity"].astype(float), "exact_windows": m["exact_windows"].astype("int64")})

        one = d.mapInPandas(scan, out)
        got = one if got is None else got.unionByName(one)
    return got.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("exact_windows").alias("exact_windows"))
