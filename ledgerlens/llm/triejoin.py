"""Approximate string join: a forest of tries, one a shard, walked by Levenshtein automata, many words at a time."""

from __future__ import annotations

import numpy as np

FAR = 9
#: Pairs of query and node that advance at a time; it bounds the memory, not the result.
MOST_PAIRS = 250_000


def trie_join(query_shard: np.ndarray, query: list[str], member_shard: np.ndarray, member: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, distance) of all words of equal shard within k edits; a swap of neighbours is one edit.

    If members and queries are the same objects, each pair of different words comes once, in either order.

    The distinct (shard, member) words form tries; each level is an array of nodes. The automaton of a query is the
    band of 2k + 1 cells of its edit table; all pairs of query and node of a level advance together, and a pair whose
    band holds nothing up to k is dropped with the whole branch. Pairs that would grow to more than MOST_PAIRS on the
    next level are cut into parts, which go on one after the other.
    """
    none = (np.array([], np.int64),) * 3
    if not len(query) or not len(member):
        return none
    qs, ms = np.asarray(query_shard, np.int64), np.asarray(member_shard, np.int64)
    chars = {c: i + 1 for i, c in enumerate(sorted(set("".join(query)) | set("".join(member))))}
    kind = np.uint8 if len(chars) < 250 else np.uint32

    def matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(w) for w in words])
        out = np.zeros((len(words), int(n.max(initial=0)) + 2), kind)
        flat = np.array([chars[c] for w in words for c in w], kind)
        if len(flat):
            row = np.repeat(np.arange(len(words)), n)
            out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out, n

    # distinct queries and members; results are spread to the given rows at the end
    def distinct(shard: np.ndarray, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        order = np.lexsort((np.array(words), shard))
        sw, ss = [words[i] for i in order], shard[order]
        new = np.r_[True, (ss[1:] != ss[:-1]) | np.fromiter((x != y for x, y in zip(sw[1:], sw)), bool, len(sw) - 1)]
        at = np.flatnonzero(new)
        return ss[at], [sw[i] for i in at], order, np.r_[at, len(order)]

    own = member is query and member_shard is query_shard
    ms_u, mw, m_rows, m_at = distinct(ms, member)
    m, mlen = matrix(mw)
    if own:
        qs_u, q, qlen, q_rows, q_at = ms_u, m, mlen, m_rows, m_at
    else:
        qs_u, qw, q_rows, q_at = distinct(qs, query)
        q, qlen = matrix(qw)
    q = np.c_[q, np.zeros((len(q), 2 * k + 2), kind)]
    same = np.r_[False, ms_u[1:] == ms_u[:-1]]
    differ = np.ones((len(m), m.shape[1] + 1), bool)
    differ[1:, :-1] = m[1:] != m[:-1]
    lcp = np.where(same, differ.argmax(1), -1)
    # depth 0: one node a shard
    levels = [np.flatnonzero(~same)]
    start = levels[0]
    node = np.searchsorted(ms_u[start], qs_u)
    ok = (node < len(start)) & (ms_u[start[np.minimum(node, len(start) - 1)]] == qs_u)
    if own:  # each pair once: a word alone in its shard has none
        ok &= np.diff(np.r_[start, len(m)])[np.minimum(node, len(start) - 1)] > 1
    fq, fn = np.flatnonzero(ok), node[ok]
    band = np.full((len(fq), 2 * k + 1), FAR, np.int8)
    band[:, k:] = np.arange(k + 1)
    band[:, k:][np.arange(k + 1)[None, :] > qlen[fq][:, None]] = FAR
    left, right, dist = [], [], []
    todo = [(0, fq, fn, band, np.full_like(band, FAR), np.zeros(len(fq), kind))]
    while todo:
        depth, fq, fn, band, before, last = todo.pop()
        start = levels[depth]
        if len(levels) == depth + 1:
            levels.append(np.flatnonzero((lcp < depth + 1) & (mlen >= depth + 1)))
        nxt = levels[depth + 1]
        row, stop = start[fn], np.r_[start[1:], len(m)]
        lo, hi = np.searchsorted(nxt, row), np.searchsorted(nxt, stop[fn])
        upto = np.cumsum(hi - lo)
        if len(fq) > 1 and upto[-1] > MOST_PAIRS:
            part = (upto - 1) // MOST_PAIRS
            cuts = np.flatnonzero(np.diff(part)) + 1
            half = len(fq) // 2
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(fq)]) if len(cuts) else ((0, half), (half, len(fq))):
                todo.append((depth, *(x[i:j].copy() for x in (fq, fn, band, before, last))))
            continue
        ends = mlen[row] == depth
        o = qlen[fq] - depth + k
        good = ends & (o >= 0) & (o <= 2 * k)
        good[good] = band[good, o[good]] <= k
        if own:
            good &= row > fq
        left.append(fq[good]), right.append(row[good]), dist.append(band[good, o[good]])
        depth += 1
        count = hi - lo
        i = np.repeat(np.arange(len(fq)), count)
        fn = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        fq, old, old2, prev = fq[i], band[i], before[i], last[i]
        c = m[nxt[fn], depth - 1] if len(fn) else np.array([], kind)
        new = np.full_like(old, FAR)
        for off in range(2 * k + 1):
            j = depth + off - k
            if j < 0:
                continue
            if j == 0:
                new[:, off] = min(depth, FAR)
                continue
            if j > q.shape[1] - 1:
                continue
            ch = q[fq, j - 1]
            v = old[:, off] + (ch != c)
            if off < 2 * k:
                v = np.minimum(v, old[:, off + 1] + 1)
            if off:
                v = np.minimum(v, new[:, off - 1] + 1)
            if depth > 1 and j > 1:
                swap = (q[fq, j - 2] == c) & (ch == prev)
                v = np.where(swap, np.minimum(v, old2[:, off] + 1), v)
            new[:, off] = np.where(j > qlen[fq], FAR, np.minimum(v, FAR))
        live = (new.min(1, initial=FAR) <= k) | (old.min(1, initial=FAR) < k) if len(fq) else np.array([], bool)
        if own and len(fq):  # branches that end before the query were walked from the other side
            live &= np.r_[nxt[1:], len(m)][fn] > fq + 1
        if live.any():
            todo.append((depth, fq[live], fn[live], new[live], old[live], c[live]))
    if not left:
        return none
    a, b, d = np.concatenate(left), np.concatenate(right), np.concatenate(dist)
    na, nb = q_at[a + 1] - q_at[a], m_at[b + 1] - m_at[b]
    n = na * nb
    i = np.repeat(np.arange(len(a)), n)
    t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return q_rows[q_at[a[i]] + t // nb[i]], m_rows[m_at[b[i]] + t % nb[i]], d[i].astype(np.int64)
