"""Problem 5: variant spellings of names, linked by a trie join of canonical parts within a town."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import few, stored
from .mentions import release_places
from .nameforms import parse_name
from .places import known_places, towns_of, with_place
from .triejoin import trie_join

#: Words of one trie task, about.
TASK_WORDS = 40_000
#: Words cut at a time by a Python worker: a word has some 60 signatures.
CUT_WORDS = 500
#: Shards with more distinct words than this are cut by PassJoin signatures, which lose nothing.
HOT_WORDS = 20_000
EDITS = 2


NAME_PARTS = ("kind", "shard", "core", "turned", "fillers", "legal", "initial")


def with_name_parts(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Adds the NAME_PARTS; rows without a usable name are dropped, or have nulls there if keep."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    none = (None,) * len(NAME_PARTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_name(x) for x in b.column(name).to_pylist()]
            if keep:
                got = [g or none for g in got]
            else:
                b = b.filter(pa.array([g is not None for g in got]))
            columns = list(zip(*(g for g in got if g is not None))) or [[]] * len(NAME_PARTS)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in columns)], names=[*b.schema.names, *NAME_PARTS])

    rows = df if keep else df.where(F.col(name).isNotNull())
    return rows.mapInArrow(read, f"{fields}, {', '.join(f'{p} string' for p in NAME_PARTS)}")


def _swapped(word: str, k: int) -> list[str]:
    """word, and word with the letters at up to k borders of its k + 1 even segments swapped."""
    base, extra = divmod(len(word), k + 1)
    ends = [base * (i + 1) + max(0, i + 1 - (k + 1 - extra)) for i in range(k)]
    out = {((), word)}
    for e in ends:
        out |= {((*at, e), w[: e - 1] + w[e] + w[e - 1] + w[e + 1 :]) for at, w in out if not at or at[-1] < e - 1}
    return [w for _, w in out]


def _signatures(word: str, k: int, member: bool) -> list[str]:
    """PassJoin: a member's k + 1 even segments; for a query every substring that such a segment can equal.

    A swap of neighbours is one edit but spoils two segments if it lies across their border. So a member has the
    segments of its _swapped() forms too: in one of them all such swaps are done, and each edit left spoils one segment.
    """
    return sorted({x for w in (_swapped(word, k) if member else [word]) for x in _segments(w, k, member)})


def _segments(word: str, k: int, member: bool) -> list[str]:
    n = len(word)
    out = []
    for size in [n] if member else range(max(k + 1, n - k), n + k + 1):
        base, extra = divmod(size, k + 1)
        at = 0
        for i in range(k + 1):
            seg = base + (i >= k + 1 - extra)
            for p in [at] if member else range(max(0, at - k), min(n - seg, at + k) + 1):
                out.append(f"{size}.{i}.{word[p : p + seg]}")
            at += seg
    return out


def near_words(words: DataFrame, k: int = EDITS, task_words: int = TASK_WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(a, b, distance), a < b: pairs of rows of words(id, s, word) of one shard s within k edits, once each.

    With a column role, only pairs of a query (role q) and a member (role m) are found, as (a: query, b: member).

    Whole shards are packed into tasks of about task_words words; a shard beyond hot_words distinct words is cut by
    PassJoin signatures first (words shorter than k + 1 stay together in it), so no task holds an unbounded shard
    unless its words differ by hardly anything. Repeated rows count as words when shards are measured and are merged in
    the tasks, so that words are shuffled once.
    """
    ids = words.schema["id"].dataType.simpleString()
    sided = "role" in words.columns
    if not sided:
        words = words.withColumn("role", F.lit("b"))
    # a word of a hot shard comes once for each signature: of a query (k + 1) (2k + 1) for each length, of a member some four times k + 1
    asks, holds = (k + 1) * (2 * k + 1) ** 2, 4 * (k + 1)
    copies = F.when(F.col("role") == "q", asks).when(F.col("role") == "m", holds).otherwise(asks + holds)
    size = words.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum(copies).alias("copies"))
    total, most = size.agg(F.sum(F.when(F.col("n") > hot_words, F.col("copies")).otherwise(F.col("n"))), F.max("n")).first()
    tasks = max(1, -(-(total or 0) // task_words))
    hot = size.where(F.col("n") > hot_words).select("s")

    def walk(b: pd.DataFrame) -> pd.DataFrame:
        q, m = b[b["role"] != "m"], b[b["role"] != "q"]
        qs, qw = q["s"].to_numpy(), q["word"].tolist()
        ms, mw = (qs, qw) if len(q) == len(m) == len(b) else (m["s"].to_numpy(), m["word"].tolist())
        i, j, d = trie_join(qs, qw, ms, mw, k)
        got = pd.DataFrame({"a": q["id"].to_numpy()[i], "b": m["id"].to_numpy()[j], "distance": d.astype("int32")})
        if sided:
            return got
        return got[got["a"] != got["b"]]

    schema = f"a {ids}, b {ids}, distance int"
    plain = words.select("id", "s", "word", "role")
    if (most or 0) > hot_words:
        plain = plain.join(hot, "s", "left_anti")

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in (b.iloc[i : i + CUT_WORDS] for b in batches for i in range(0, len(b), CUT_WORDS)):
                rows = []
                for i, s, w, r in zip(b["id"], b["s"], b["word"], b["role"]):
                    if len(w) <= 2 * k:
                        rows += [(i, s, "", w, r)]
                    else:
                        if r != "q":
                            rows += [(i, s, x, w, "m") for x in set(_signatures(w, k, True))]
                        if r != "m":
                            rows += [(i, s, x, w, "q") for x in set(_signatures(w, k, False))]
                        if len(w) <= 3 * k + 1:
                            rows += [(i, s, "", w, r)]  # may be near a short word
                yield pd.DataFrame(rows, columns=["id", "s", "sig", "word", "role"])

        sig = words.join(hot, "s", "left_semi").select("id", "s", "word", "role").mapInPandas(cut, f"id {ids}, s long, sig string, word string, role string")
        plain = plain.unionByName(sig.select("id", F.xxhash64("s", "sig").alias("s"), "word", "role"))
    packed = plain.withColumn("task", F.pmod(F.xxhash64("s"), F.lit(tasks))).repartition("task")
    got = packed.distinct().groupBy("task").applyInPandas(walk, schema)
    if sided:
        return got.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("distance"))


ATTRIBUTES = ["kind", "shard", "turned", "fillers", "legal", "initial"]


def _with_form(records: DataFrame) -> DataFrame:
    return records.withColumn("form", F.xxhash64(*[F.coalesce(F.col(p), F.lit("\0")) for p in ("place", "core", *ATTRIBUTES)])).select("record", "place", "core", *ATTRIBUTES, "form")


def name_records(loans: DataFrame, cases: DataFrame, releases: DataFrame) -> DataFrame:
    """(record, place, name parts, form): every usable name record in each town it may belong to.

    Loans have their own town. A case has the towns its release names (with their states, if the text gives them)
    and the town of its loan number; if that leaves nothing, the place is null.
    """
    towns = towns_of(loans)
    l = with_place(loans.select("loan_number", "borrower_name", "borrower_city", "borrower_state", "borrower_zip").where(F.col("loan_number").isNotNull()), towns)
    lrec = l.select(F.concat(F.lit("L"), F.col("loan_number").cast("string")).alias("record"), F.col("borrower_name").alias("name"), "place")
    lrec = stored(_with_form(with_name_parts(lrec, "name")), "loan_names")
    c = cases.where(F.col("case_id").isNotNull()).select("case_id", "loan_number", "defendant_name", "business_name", "source_url").distinct()
    # only releases that a case cites are read
    cited = few(c.where(F.col("source_url").isNotNull()).select(F.xxhash64("source_url").alias("key")).distinct())
    texts = releases.select("url", "body", F.xxhash64("url").alias("key")).join(cited, "key", "left_semi")
    told = release_places(texts, known_places(towns), "url", "body")
    own = c.where(F.col("loan_number").isNotNull()).select("case_id", F.concat(F.lit("L"), F.col("loan_number").cast("string")).alias("record"))
    of_cases = lrec.select("record", "place", F.xxhash64("record").alias("key")).join(few(own.select(F.xxhash64("record").alias("key")).distinct()), "key", "left_semi")
    own = own.join(of_cases.drop("key"), "record").select("case_id", "place")
    by_case = told.join(c.select("case_id", F.col("source_url").alias("id")), "id").select("case_id", "place").unionByName(own).distinct()
    names = c.select("case_id", F.explode(F.array(F.struct(F.lit("B").alias("t"), F.col("business_name").alias("name")), F.struct(F.lit("D").alias("t"), F.col("defendant_name").alias("name")))).alias("r"))
    names = names.select("case_id", F.concat("r.t", F.col("case_id").cast("string")).alias("record"), "r.name").distinct()
    crec = stored(_with_form(with_name_parts(names, "name").join(by_case, "case_id", "left")), "case_names")
    return lrec.unionByName(crec)


def _agree(c: str) -> Column:
    return (F.col(f"a.{c}") == F.col(f"b.{c}")) | (F.col(f"a.{c}") == "") | (F.col(f"b.{c}") == "")


def alternatives(shard: str = "shard") -> Column:
    """The first names, or the one trade, that a shard stands for."""
    return F.split(shard, r"\|")


def same_shard() -> Column:
    """Whether the shards of a and b agree: first names or trades in common, or an initial that begins a first name."""
    a, b = alternatives("a.shard"), alternatives("b.shard")
    begins = F.exists(a, lambda x: F.exists(b, lambda y: F.startswith(x, y) | F.startswith(y, x)))
    both = F.col("a.kind") == F.col("b.kind")
    return F.when(both, F.arrays_overlap(a, b)).otherwise((F.col("a.kind") != "O") & (F.col("b.kind") != "O") & begins)


def shard_keys(*place: str) -> Column:
    """The keys of tries that a form is in: town with trade, or with each first name; people also town with initial."""
    kind = F.when(F.col("kind") == "I", "P").otherwise(F.col("kind"))
    either = [F.substring_index("shard", "|", n) for n in (1, -1)]  # a short form stands for two first names at most
    names = [F.xxhash64(*place, kind, x) for x in either]
    letters = [F.xxhash64(*place, F.lit("P"), F.substring(x, 1, 1)) for x in either]
    one = F.when(F.col("kind") == "P", F.array(names[0], letters[0])).otherwise(F.array(names[0]))
    return F.when(F.col("shard").contains("|"), F.array_distinct(F.array(*names, *letters))).otherwise(one)


PIECES = 2 * EDITS + 1


def _member_pieces() -> Column:
    """Keys of the PIECES even pieces of word in town s, with the length of the word and the number of the piece.

    EDITS edits spoil at most 2 * EDITS pieces, a swap across a border two, so one piece is left whole.
    """
    n = F.length("word")
    base, extra = F.floor(n / PIECES).cast("int"), n % PIECES
    start = lambda i: i * base + F.greatest(F.lit(i - PIECES) + extra, F.lit(0))
    return F.array(*[F.xxhash64("s", n, F.lit(i), F.substring("word", start(i) + 1, start(i + 1) - start(i))) for i in range(PIECES)])


def _query_pieces() -> Column:
    """The keys of every piece that a word within EDITS edits of word can have left whole: lengths and shifts up to EDITS."""
    n = F.length("word")

    def of_size(size: Column) -> Column:
        base, extra = F.floor(size / PIECES).cast("int"), size % PIECES
        start = lambda i: i * base + F.greatest(i - (PIECES - extra), F.lit(0))
        shifts = F.sequence(F.lit(-EDITS), F.lit(EDITS))
        piece = lambda i: F.transform(F.filter(shifts, lambda d: start(i) + d >= 0), lambda d: F.xxhash64("s", size, i, F.substring("word", start(i) + d + 1, start(i + 1) - start(i))))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece))

    return F.array_distinct(F.flatten(F.transform(F.sequence(n - EDITS, n + EDITS), of_size)))


def _whole_links(rec: DataFrame) -> DataFrame:
    """(form_a, form_b) of firms of which one has no trade that a list knows: misspelt, cut or written together.

    Those few names are compared whole, trade included, with all firms of their town that share a piece with them.
    """
    firm = rec.where((F.col("kind") == "O") & F.col("place").isNotNull()).select("form", F.xxhash64("place").alias("s"), "shard", "core", "turned", "fillers", "legal")
    word = lambda d, t: d.select("form", "s", "fillers", "legal", F.explode(F.array_distinct(F.array(F.concat("core", t), F.concat("turned", t)))).alias("word"))
    odd = stored(word(firm.where("shard = ''").distinct(), F.lit("")).withColumn("id", F.xxhash64("s", "word")), "odd_names")
    asked = few(odd.select(F.explode(_query_pieces()).alias("key")).distinct())
    plain = word(firm.where("shard <> ''"), F.col("shard")).withColumn("key", F.explode(_member_pieces())).join(asked, "key", "left_semi")
    plain = stored(plain.drop("key").distinct().withColumn("id", F.xxhash64("s", "word")), "whole_names")
    sides = odd.select("id", "s", "word", F.lit("q").alias("role")).distinct().unionByName(plain.select("id", "s", "word", F.lit("m").alias("role")).distinct())
    near = near_words(sides)
    both = near.join(odd.alias("a"), F.col("a") == F.col("a.id")).join(plain.alias("b"), F.col("b") == F.col("b.id"))
    return both.where(_agree("fillers") & _agree("legal")).select(F.least("a.form", "b.form").alias("form_a"), F.greatest("a.form", "b.form").alias("form_b"))


OWNER_PARTS = ("kind", "shard", "core", "turned", "initial")


def owner_links(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of people(record, OWNER_PARTS), a row for each record, wherever they are.

    A spelling is a form of its own here. Two spellings are linked within one edit, or within two if the commonest
    spelling within one edit of either is the same. links(form_a, form_b) holds each spelling with itself too.
    """
    people = people.withColumn("form", F.xxhash64(*OWNER_PARTS))
    spelt = people.groupBy("form", *OWNER_PARTS).agg(F.count(F.lit(1)).alias("n"))
    letters = F.when(F.col("kind") == "P", F.transform(alternatives(), lambda x: F.substring(x, 1, 1))).otherwise(F.array("shard"))
    keyed = spelt.select("form", "kind", "shard", "turned", "initial", "n", F.explode(F.array_distinct(letters)).alias("l"), F.explode(F.array_distinct(F.array("core", "turned"))).alias("word"))
    keyed = stored(keyed.withColumn("s", F.xxhash64(F.lit("owner"), "l")).withColumn("id", F.xxhash64("s", "word")).drop("l"), "owner_words")
    near = stored(near_words(keyed.select("id", "s", "word").distinct()), "owner_words")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(keyed.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")).distinct())
    both = near.join(keyed.alias("a"), F.col("a") == F.col("a.id")).join(keyed.alias("b"), F.col("b") == F.col("b.id")).where(same_shard() & _agree("initial"))
    both = both.select(F.col("a.form").alias("form_a"), F.col("b.form").alias("form_b"), F.col("b.turned").alias("turned"), F.col("b.n").alias("n"), "distance")
    both = stored(both.groupBy("form_a", "form_b", "turned", "n").agg(F.min("distance").alias("distance")), "owner_pairs")
    common = both.where("distance <= 1").groupBy("form_a", "turned").agg(F.sum("n").alias("n")).groupBy("form_a").agg(F.max(F.struct("n", "turned"))["turned"].alias("common"))
    common = stored(common, "owner_spellings")
    weak = both.where("distance > 1 and form_a < form_b").select("form_a", "form_b").join(common, "form_a")
    weak = weak.join(common.select(F.col("form_a").alias("form_b"), F.col("common").alias("other")), "form_b").where("common = other").select("form_a", "form_b")
    links = both.where("distance <= 1 and (form_a < form_b or form_a = form_b and n > 1)").select("form_a", "form_b").unionByName(weak)
    return people.select("record", "form"), links


def name_links(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, owners) of name_records(): members(record, form, place), links(form_a, form_b) between different forms of one name, and of forms without a town to themselves, and the records that owner_links() is for.

    A form is one set of name parts in one town. People match on first name (short forms count as the full name) or
    initial, firms on trade; the remaining words, in the order typed and in sorted order, go into tries sharded by
    town and that part, and are found within EDITS edits (1 for up to 6 letters). Fillers, legal forms and middle
    initials may be missing on a side but not contradict. Firms without a known trade: see _whole_links(). Defendants
    who aren't the borrower of a loan in their town aren't sole proprietors, so they keep to no town: owner_links().
    """
    same = ["kind", "shard", "turned"]
    loan = F.col("record").startswith("L")
    rec = records.where(~loan | F.col("place").isNotNull())
    keyed = rec.where("place is not null").select("form", *ATTRIBUTES, "core", F.explode(shard_keys("place")).alias("s"))
    keyed = keyed.select("form", *ATTRIBUTES, F.length("core").alias("n"), "s", F.explode(F.array_distinct(F.array("core", "turned"))).alias("word"))
    words = keyed.withColumn("id", F.xxhash64("s", "word"))
    distinct = stored(words.groupBy("id", "s", "word").agg(F.min("form").alias("f0"), F.max("form").alias("f1")), "name_words")
    near = stored(near_words(distinct.select("id", "s", "word")), "near_words")
    # words of several forms, and words near another: only their forms are needed from here on
    several = distinct.where("f0 <> f1").select("id")
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).unionByName(several).distinct()
    some = stored(words.join(few(wanted), "id", "left_semi").select("id", "form", "kind", "shard", "fillers", "legal", "initial", "n").distinct(), "name_forms")
    near = near.unionByName(several.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")))
    a, b = some.alias("a"), some.alias("b")
    both = near.join(a, F.col("a") == F.col("a.id")).join(b, F.col("b") == F.col("b.id")).where("a.form <> b.form")
    fine = same_shard() & (F.col("distance") <= F.when(F.least("a.n", "b.n") >= 7, EDITS).otherwise(1)) & _agree("fillers") & _agree("legal") & _agree("initial")
    links = both.where(fine).select(F.least("a.form", "b.form").alias("form_a"), F.greatest("a.form", "b.form").alias("form_b"))
    links = stored(links.unionByName(_whole_links(rec)).distinct(), "name_links")
    # cases not linked to any loan in their towns: an equal name that stands in one town alone
    cases = stored(rec.where(~loan).select("record", "form", "place", *same), "case_names")
    ends = links.select(F.explode(F.array(F.struct(F.col("form_a").alias("form"), F.col("form_b").alias("other")), F.struct(F.col("form_b").alias("form"), F.col("form_a").alias("other")))).alias("x")).select("x.*").unionByName(cases.select("form", F.col("form").alias("other")).distinct())
    of_loans = rec.where(loan).select(F.col("form").alias("other")).join(few(ends.select("other").distinct()), "other", "left_semi").distinct()
    reached = stored(ends.join(of_loans, "other", "left_semi").select("form").distinct(), "reached")
    lost = stored(cases.join(cases.join(reached, "form", "left_semi").select("record").distinct(), "record", "left_anti"), "case_names")
    key = F.xxhash64(*same).alias("key")
    named = stored(rec.where(F.col("place").isNotNull()).select(key, *same, "form", "place", loan.alias("of_loan")).join(few(lost.select(key).distinct()), "key", "left_semi").drop("key").distinct(), "lost_names")
    ends_of = lambda c, tag: (F.min(F.when(c, F.col("place"))).alias(f"{tag}0"), F.max(F.when(c, F.col("place"))).alias(f"{tag}1"))
    per = named.groupBy(*same).agg(*ends_of(F.col("of_loan"), "l"), *ends_of(~F.col("of_loan"), "c"))
    # the town of the loans of that name or, without loans, of its cases; names that stand in several are left out
    town = lost.select(*same).distinct().join(per, same, "left").where("l0 = l1 or l0 is null and (c0 is null or c0 = c1)").select(*same, F.coalesce("l0", "c0").alias("town"))
    free = lost.select("form", *same, "place").distinct().join(town, same).select(*same, F.col("form").alias("x"), F.col("place").alias("px"), "town")
    to = named.select(*same, F.col("form").alias("y"), F.col("place").alias("py"), "of_loan")
    there = free.join(to, same).where("py = town and (of_loan or px is null or px <> town)")
    # records of no known town also go with each other, those of one form included
    both = free.where("px is null").select(*same, "x").join(free.select(*same, F.col("x").alias("y")), same)
    more = there.select("x", "y").where("x <> y").unionByName(both.select("x", "y")).select(F.least("x", "y").alias("form_a"), F.greatest("x", "y").alias("form_b"))
    proprietors = cases.join(reached, "form", "left_semi").select("record").distinct()
    owners = stored(rec.where(F.col("record").startswith("D") & (F.col("kind") != "O")).join(proprietors, "record", "left_anti").select("record", *OWNER_PARTS).distinct(), "owners")
    return rec.select("record", "form", "place"), links.unionByName(more).distinct(), owners


def same_name_pairs(loans: DataFrame, cases: DataFrame, releases: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: records naming the same person or organisation, each pair once.

    Records are 'L' + loan_number, 'B' + case_id (business) and 'D' + case_id (defendant). Names in different towns
    are different; towns come from the loans' addresses and, for cases, from the text of their release. Null and
    placeholder names, null ids and loans without a known town are in no pair; repeated rows count once; empty
    tables give an empty result.
    """
    members, links, owners = name_links(name_records(loans, cases, releases))
    one = F.xxhash64("record")
    several = members.where("place is not null").groupBy(F.col("form").alias("form_a")).agg(F.min(one).alias("p"), F.max(one).alias("q")).where("p <> q").select("form_a", F.col("form_a").alias("form_b"))
    pairs = stored(links.select("form_a", "form_b").unionByName(several), "name_pairs")
    ends = pairs.select(F.col("form_a").alias("form")).unionByName(pairs.select(F.col("form_b").alias("form"))).distinct()
    some = members.select("form", "record").join(few(ends), "form", "left_semi").distinct()
    some = stored(some.join(owners.select("record", F.lit(True).alias("owner")), "record", "left"), "name_members")
    local = _expanded(pairs, some, some, ~(F.coalesce("a.owner", F.lit(False)) & F.coalesce("b.owner", F.lit(False)))).distinct()
    # pairs of owners come from here alone and once each: a record has one spelling, and a pair of spellings one link
    people, known = owner_links(owners)
    # spellings linked within a town, however they were, are linked here too
    spelt = stored(some.where("owner").join(people.select("record", F.col("form").alias("spelling")), "record").select("form", "spelling").distinct(), "owner_forms")
    a, b = (spelt.select(F.col("form").alias(f"form_{s}"), F.col("spelling").alias(s)) for s in "ab")
    near_by = pairs.join(a, "form_a").join(b, "form_b").where("a <> b").select(F.least("a", "b").alias("form_a"), F.greatest("a", "b").alias("form_b"))
    known = known.unionByName(near_by).distinct()
    return local.unionByName(_expanded(known, people, people, F.lit(True)))


def _expanded(links: DataFrame, left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
    """Pairs of different records of the linked forms; of a form linked to itself, each pair once."""
    a, b = left.withColumnRenamed("form", "form_a").alias("a"), right.withColumnRenamed("form", "form_b").alias("b")
    got = links.join(a, "form_a").join(b, "form_b").where((F.col("a.record") != F.col("b.record")) & ((F.col("form_a") != F.col("form_b")) | (F.col("a.record") < F.col("b.record")))).where(where)
    return got.select(F.least("a.record", "b.record").alias("name_a"), F.greatest("a.record", "b.record").alias("name_b"))
