"""Problem 10: per-document statistics that tell natural prose from lists, tables and junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but if that which who whom whose this these those it its he she they we you i me him her them us my your his their our is are was were be been being am has have had do does did will would shall should can could may might must not no nor so than then there here when where while after before because since until although though as at by for from in into on onto over under about with without within between through during against out up down off again only more most some any each every all both few other such own same too very just even still yet also once what why how to",
    "es": "el la los las un una unos y o pero si que quien cual este esta estos ese esa eso aquel su sus lo le les se nos me te mi yo ella ellos ellas usted es son era eran fue fueron ser ha han haber hay no ni como cuando donde mientras porque desde hasta aunque con sin sobre entre por para al del en muy ya otra otro ustedes muchos muchas cada todo todos más",
    "fr": "le la les un une des et ou mais si que qui dont ce cet cette ces son sa ses leur leurs il elle ils elles nous vous je on lui y est sont était étaient fut être a ont avait ne pas ni comme quand où pour par avec sans sur sous dans entre depuis jusqu au aux du en très déjà autre autres plus d l n s qu c j",
    "de": "der die das den dem des ein eine einen einem einer und oder aber wenn dass wer dieser diese dieses er sie es wir ihr ist sind war waren sein hat haben hatte nicht kein wie als für von mit ohne auf unter über zwischen durch bis zu zum zur im am bei nach aus auch noch nur sehr",
    "pt": "o os as um uma e ou mas se quem este esta isso seu sua ele ela eles nós você é são era foram ser tem não nem como quando onde porque desde até com sem sobre entre por para ao aos à do da dos das no na nos nas em muito já mais",
    "it": "il lo gli un uno una e o ma se che chi questo questa suo sua egli ella loro noi voi è sono era erano essere ha hanno non né come quando dove perché con senza su tra fra per al del della dei nel nella di da molto già più",
}
#: Words that also join the parts of list entries; they count for half.
WEAK = set("of de du di da do a y o e no in la le des los las et and or the for d l".split())
FUNCTION = set(" ".join(FUNCTION_WORDS.values()).split()) | {"of", "de"}
# Language profiles: prose of a language uses the function words of its list, each about as often as another.
LANGUAGES = list(FUNCTION_WORDS)
VOCABULARY = {w: i for i, w in enumerate(sorted(FUNCTION))}
SPOKEN = np.array([[float(w in set(FUNCTION_WORDS[k].split())) for w in VOCABULARY] for k in LANGUAGES])
SPOKEN = (SPOKEN + 1e-3) / (SPOKEN + 1e-3).sum(1, keepdims=True)

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?=$|[\s.,;:!?)\]\"”’'…/-])|[$€£]?\(?\d[\d.,:/%$)-]*(?=$|\s|[.,;:!?|)\t])|[.?!]+(?=\s|$)|,(?=\s|$)|[^\s]+?(?=$|\s|[,;|>\t](?=\s|$))|[^\s]")
WORD = re.compile(r"[^\W\d_]+")
ENDS = re.compile(r"(?<=[.!?])\s+(?=\S)")
MARK = re.compile(r"^\s*(?:[•*·▪◦‣#>+-]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlcIVXLC]{1,5})[.)])\s*(?=\S)")
MOJIBAKE = re.compile(r"[ÃÂâï][\x80-\xbf€™œ“”¿½©±¼¡\xa0]?|�|�")
MARKS = ".,;:!?'\"’“”()"
SEPARATOR = re.compile(r"\s\|\s|^\||\||;|\t|\s>\s|,(?=\S)| {2,}| \.{3,} |:\s")
CLASSES = ("function", "weak", "word", "capital", "number", "garbled", "symbol", "stop", "comma", "repeat", "mark", "field")

# Structural profiles: expected shares of the token classes above, set by hand from a look at lines of each kind.
PROFILES = {
    "prose": (.300, .130, .330, .075, .030, .004, .003, .055, .020, .020, .002, .006),
    "prose/notes": (.240, .080, .400, .110, .040, .006, .010, .030, .050, .015, .002, .005),
    "prose/noisy": (.220, .100, .310, .080, .020, .110, .050, .050, .020, .015, .002, .006),
    "list/marked": (.005, .040, .480, .120, .080, .010, .020, .010, .020, .050, .150, .030),
    "list/names": (.002, .030, .080, .620, .010, .005, .020, .005, .180, .030, .010, .020),
    "list/commas": (.002, .050, .550, .050, .010, .005, .010, .010, .240, .060, .005, .010),
    "list/chain": (.002, .010, .150, .450, .010, .010, .120, .005, .080, .060, .010, .120),
    "list/tags": (.001, .005, .050, .020, .010, .600, .120, .005, .010, .020, .120, .050),
    "table/columns": (.001, .010, .060, .220, .430, .010, .040, .010, .010, .020, .005, .180),
    "table/fields": (.001, .010, .200, .150, .220, .010, .080, .005, .050, .030, .010, .240),
    "table/pairs": (.001, .010, .280, .250, .200, .005, .020, .005, .010, .040, .005, .180),
    "junk/signs": (.002, .005, .030, .020, .050, .350, .480, .030, .020, .010, .005, .010),
    "junk/strings": (.001, .002, .060, .020, .040, .820, .030, .005, .005, .010, .002, .005),
    "junk/mixed": (.050, .040, .180, .060, .040, .430, .140, .020, .020, .010, .005, .010),
    "junk/words": (.003, .005, .400, .030, .002, .010, .010, .005, .005, .520, .002, .010),
    "junk/salad": (.015, .030, .770, .090, .002, .010, .002, .075, .002, .010, .001, .001),
}
#: Expected shares of lower-case letters, capitals, digits, sentence marks, other signs among non-blank characters.
SIGNS = {
    "prose": (.920, .030, .020, .028, .002), "prose/notes": (.895, .030, .035, .036, .004), "prose/noisy": (.875, .030, .030, .035, .030),
    "list/marked": (.850, .050, .040, .030, .030), "list/names": (.820, .130, .002, .045, .003), "list/commas": (.930, .015, .005, .048, .002), "list/chain": (.820, .110, .002, .020, .048), "list/tags": (.820, .002, .080, .003, .095),
    "table/columns": (.350, .060, .440, .060, .090), "table/fields": (.530, .070, .260, .030, .110), "table/pairs": (.480, .060, .250, .190, .020),
    "junk/signs": (.250, .080, .080, .180, .410), "junk/strings": (.600, .180, .200, .005, .015), "junk/mixed": (.640, .060, .070, .060, .170), "junk/words": (.985, .010, .001, .002, .002), "junk/salad": (.940, .025, .001, .033, .001),
}
NAMES = list(PROFILES)
TOKENS = np.array([PROFILES[k] for k in NAMES])
CHARS = np.array([SIGNS[k] for k in NAMES])
TOKENS = TOKENS / TOKENS.sum(1, keepdims=True)
CHARS = CHARS / CHARS.sum(1, keepdims=True)


@lru_cache(100_000)
def token_class(t: str) -> int:
    """Index in CLASSES by the form of one token, seen alone."""
    if t in ".?!" or set(t) <= set(".?!…"):
        return 7 if len(t) < 4 else 6
    if t == ",":
        return 8
    w = t.strip("\"“”‘’'()[]-–:;.,!?…/")
    if not w:
        return 6
    low = w.lower()
    if low in FUNCTION:
        return 1 if low in WEAK else 0
    letters = sum(c.isalpha() for c in w)
    if letters == 0:
        return 4 if any(c.isdigit() for c in w) and len(w) < 20 else 6
    if MOJIBAKE.search(w):
        return 5
    parts = re.split(r"['’/-]", low)
    if len(w) > 28 or not all(p.isalpha() for p in parts if p):
        return 5
    if len(low) >= 4 and not re.search(r"[aeiouyáéíóúàèìòùâêîôûäëïöüãõ]", low):
        return 5
    if re.search(r"[bcdfghjklmnpqrstvwxz]{6}", low) or re.search(r"[a-z][A-Z]{2,}[a-z]|[a-z][A-Z][a-z][A-Z]", w):
        return 5
    return 3 if w[0].isupper() else 2


@lru_cache(50_000)
def chunk_tokens(chunk: str) -> tuple[tuple[str, int], ...]:
    """Tokens with their classes of a stretch without blanks."""
    return tuple((t, token_class(t)) for t in ([chunk] if chunk.isalpha() else TOKEN.findall(chunk)))


def line_counts(line: str, shouted: bool, seen: list[str]) -> list[int]:
    """Tokens of a line by class. seen: the last words before it, for repeats; lines in capitals count as lower case."""
    c = [0] * len(CLASSES)
    if shouted:
        line = line.lower()
    if m := MARK.match(line):
        c[10] = 1
        line = line[m.end() :]
    c[11] = len(SEPARATOR.findall(line.strip()))
    for chunk in line.split():
        for t, k in chunk_tokens(chunk):
            if k == 2 or k == 3:
                if t in seen:
                    k = 9
                seen.append(t)
                if len(seen) > 12:
                    del seen[0]
            c[k] += 1
    return c


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Class of each code point: 0 blank, 1 lower case, 2 capital, 3 digit, 4 sentence mark, 5 other sign or letter."""
    out = np.full(1 << 16, 5, np.int64)
    for i in range(1 << 16):
        x = chr(i)
        out[i] = 0 if x.isspace() else 1 if x.islower() else 2 if x.isupper() else 3 if x.isdigit() else 4 if x in MARKS else 5
    return out


def sign_counts(parts: list[str]) -> np.ndarray:
    """Lower-case letters, capitals, digits, sentence marks and other signs of each part."""
    code = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    part = np.cumsum(code == 10)
    return np.bincount(part * 6 + _kinds()[np.minimum(code, 0xFFFF)], minlength=6 * len(parts)).reshape(-1, 6)[: len(parts), 1:].astype(float)


LOG_Q = {id(q): np.where(q > 0, q * np.log2(np.where(q > 0, q, 1)), 0).sum(1) for q in (TOKENS, CHARS, SPOKEN)}


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p (no zeros) to each row of the profiles q."""
    m = (p[:, None, :] + q[None, :, :]) / 2
    return (np.sum(p * np.log2(p), 1)[:, None] + LOG_Q[id(q)][None, :]) / 2 - np.sum(m * np.log2(m), 2)


def nearest(tokens: np.ndarray, signs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Profile of each line. Lines say little alone: each is compared together with its neighbours' counts.

    A neighbour within two lines adds half of its counts, so that a short line follows the block it stands in, while
    a long line decides for itself.
    """
    n = len(tokens)
    t, s = tokens.copy(), signs.copy()
    for d, w in ((1, 0.5), (2, 0.25)):
        if n > d:
            # weight falls where the line itself is long
            own = np.minimum(1, 60 / np.maximum(sizes, 1))[:, None] * w
            t[d:] += own[d:] * tokens[:-d]
            t[:-d] += own[:-d] * tokens[d:]
            s[d:] += own[d:] * signs[:-d]
            s[:-d] += own[:-d] * signs[d:]
    p = (t + 0.02) / (t + 0.02).sum(1, keepdims=True)
    q = (s + 0.02) / (s + 0.02).sum(1, keepdims=True)
    return (divergence(p, TOKENS) + 0.5 * divergence(q, CHARS)).argmin(1)


def language(words: list[str]) -> tuple[str | None, float | None]:
    """(language, divergence in bits) of the prose profile nearest to the function words among words; nulls if there are none."""
    found = Counter(filter(VOCABULARY.__contains__, words))
    if not found:
        return None, None
    count = np.full(len(VOCABULARY), 1e-6)
    count[[VOCABULARY[w] for w in found]] += list(found.values())
    d = divergence((count / count.sum())[None, :], SPOKEN)[0]
    return LANGUAGES[int(d.argmin())], float(d.min())


def statistics(text: str) -> tuple:
    """The columns of STATISTICS for one text."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return 0, None, None, None, None, 0.0, 0.0, 0.0, 0.0, None, None, None
    # very long lines are cut at sentence ends, so that a page in one line isn't one vote
    parts = [p for x in lines for p in (ENDS.split(x) if len(x) > 600 else [x]) if p.strip()]
    seen: list[str] = []
    parts = [p.replace("\n", " ") for p in parts]
    signs = sign_counts(parts)
    shouted = signs[:, 1] > 0.6 * np.maximum(1, signs[:, 0] + signs[:, 1])
    signs[shouted, 0] += signs[shouted, 1]
    signs[shouted, 1] = 0
    tokens = np.array([line_counts(p, u, seen) for p, u in zip(parts, shouted.tolist())], float)
    sizes = signs.sum(1)
    kind = nearest(tokens, signs, sizes)
    family = np.array([k.split("/")[0] for k in NAMES])[kind]
    share = {f: float(sizes[family == f].sum() / sizes.sum()) for f in ("prose", "list", "table", "junk")}
    words = WORD.findall(text)
    total = tokens.sum(0)
    alpha = total[[0, 1, 2, 3, 5, 9]].sum()
    whole = (tokens.sum(0, keepdims=True) + 0.02) / (tokens.sum() + 0.02 * len(CLASSES))
    ended = sum(x.rstrip()[-1] in ".!?:;\"”’)" for x in lines) / len(lines)
    return (
        len(words), sum(map(len, words)) / len(words) if words else None, float((sizes.sum() - signs[:, :3].sum()) / sizes.sum()), float(ended),
        float(total[:2].sum() / alpha) if alpha else None, share["prose"], share["list"], share["table"], share["junk"], NAMES[int((divergence(whole, TOKENS)).argmin())], *language("\n".join(words).lower().split("\n")),
    )


STATISTICS = "n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, prose double, list double, table double, junk double, profile string, language string, language_divergence double"


def text_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, statistics) of each document: counts, shares and the structural profile.

    Every line's token classes (function words, other words, capitals, numbers, garbled words, signs, repeats, list
    marks, field separators ...) and character classes are compared with profiles of prose, lists, tables and junk by
    Jensen-Shannon divergence; the nearest profile takes the line. prose, list, table and junk are the shares of
    non-blank characters of the lines so assigned; profile is the one nearest to the whole text. language is the prose
    profile nearest to the function words of the text, and language_divergence how far it is from it (0 to 1 bit).

    Null texts give null statistics, blank ones 0 words and shares 0; repeated rows are kept. Texts are read whole.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    names = [x.split()[0] for x in STATISTICS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [statistics(t) if isinstance(t, str) else (None,) * len(names) for t in b["text"]]
            out = pd.DataFrame(got, columns=names)
            out.insert(0, "id", b["id"].to_numpy())
            out["n_words"] = out["n_words"].astype("Int64")
            yield out

    return rows.mapInPandas(read, f"id {rows.schema['id'].dataType.simpleString()}, {STATISTICS}").withColumnRenamed("id", id)


def not_prose(stats: DataFrame) -> DataFrame:
    """Documents more than half of whose non-blank characters are list entries, table rows or junk."""
    return stats.where("list + table + junk > 0.5")
