"""Names of people and firms, as typed, brought to comparable parts."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

# Words of business names, legal forms, fillers, titles, first names with their short forms.
TRADES = (
    "MINING AGGREGATES QUARRIES DRILLING ORCHARDS MECHANICAL PLUMBING DRYWALL NURSERY BREWING RANCH BAKERY FARMS TEXTILES MACHINING GROWERS FOODS ELECTRIC TOOLING FABRICATION MASONRY MANUFACTURING PAVING BUILDERS ROOFING CONTRACTING CONSTRUCTION IMPORTS WHOLESALE MARKET DISTRIBUTORS PHARMACY SUPPLY BOUTIQUE FLORIST OUTFITTERS MOTORS MEDIA FURNITURE LOGISTICS BOOKS FREIGHT SOFTWARE TRANSPORT TRUCKING PUBLISHING CAPITAL STUDIOS ADVISORS FINANCIAL INSURANCE RENTALS REALTY PROPERTIES LEASING JANITORIAL STAFFING SECURITY ARCHITECTS LANDSCAPING LAW DAYCARE LEARNING HOMECARE HOSPICE TUTORING ENGINEERING ACCOUNTING ACADEMY CONSULTING INSTITUTE PEDIATRICS THERAPY MEDICAL DENTAL CHIROPRACTIC GOLF THEATRE FITNESS ATHLETICS HOTEL CATERING INN RESORT LODGING GRILL RESTAURANT CAFE PIZZERIA SALON BARBERSHOP CLEANERS FELLOWSHIP MINISTRIES AUTOBODY CHARITIES INDUSTRIES TRADING ENTERPRISES VENTURES"
).split()
SHORT_TRADES = "LANDSCAPE LANDSCAPING,ELEC ELECTRIC,INS INSURANCE,INST INSTITUTE,FIN FINANCIAL,FINL FINANCIAL,MED MEDICAL,MFG MANUFACTURING,MANUF MANUFACTURING,CONST CONSTRUCTION,CONSTR CONSTRUCTION,CONSTRUCT CONSTRUCTION,CONTR CONTRACTING,CONSLT CONSULTING,CONSULT CONSULTING,TRANSP TRANSPORT,TRNSPT TRANSPORT,DISTR DISTRIBUTORS,DISTRS DISTRIBUTORS,DIST DISTRIBUTORS,ACAD ACADEMY,PROP PROPERTIES,PROPS PROPERTIES,LNDSCPG LANDSCAPING,ACCTG ACCOUNTING,ACCT ACCOUNTING,FAB FABRICATION,FABR FABRICATION,ENGR ENGINEERING,ENGRG ENGINEERING,ENTPRS ENTERPRISES,ENT ENTERPRISES,IND INDUSTRIES"
FILLERS = "ASSOCIATES ASSOC ASSOCS,MANAGEMENT MGT MGMT,SERVICES SVCS SVC SERV SERVICE SERVS,INTERNATIONAL INTL INT INTERN,SOLUTIONS SOLN SOLNS SOLUTION,PARTNERS PTNRS PRTNRS PARTNER PTNR,GROUP GRP GP,HOLDINGS HLDGS HOLDING HLDG"
LEGAL = "LLC,INC INCORPORATED,CORP CORPORATION,CO COMPANY,LTD LIMITED,PLLC,LLP,LP,PC,PA"
NOISE = set("THE AND OF A AN MR MRS MS DR MISS JR SR II III IV CPA ESQ MD INDIVIDUAL SOLE PROPRIETOR PROPRIETORSHIP OWNER BY IN".split())
FIRST_NAMES = (
    "ABIGAIL ABBY,ALEXANDER ALEX SASHA,ANTHONY TONY,BENJAMIN BEN,CHARLES CHARLIE CHUCK,CHRISTOPHER CHRIS KIT,CURTIS CURT,DEBORAH DEB DEBBIE,DMITRI DIMA,EDWARD ED NED TED EDDIE,ELIZABETH LIZ BETH BETTY LIZZIE,FERRIS,FRANCISCO FRANK PACO,GERALD JERRY,GUADALUPE LUPE,HIROSHI HIRO,INGRID INGA,JAMES JIM JIMMY JAMIE,JENNIFER JEN JENNY,JOSEPH JOE JOEY,KATHERINE KATE KATHY KATIE KAT,LAWRENCE LARRY LAURIE,LETICIA LETTY,MARGARET MAGGIE PEGGY MEG,MARTA,MICHAEL MIKE MICK,NATHANIEL NATE NAT,NGUYET,ODESSA DESSA,OLUWASEUN SEUN,PATRICIA PAT TRISH PATTY,PRIYA,QUENTIN QUENT,REBECCA BECKY BECCA,RICHARD RICK DICK RICH,ROBERT BOB ROB BOBBY,ROSALIND ROZ,SAMUEL SAM SAMMY,SUSAN SUE SUSIE,THEODORE THEO TED TEDDY,THOMAS TOM TOMMY,TOBIAS TOBY,VICTORIA VICKY TORI,WANDA,WILLIAM BILL WILL BILLY LIAM,XIOMARA XIO,YOLANDA YOLI,ZACHARY ZACK ZACH"
)
PLACEHOLDERS = {"", "NA", "NONE", "TBD", "UNKNOWN", "SAMEASABOVE", "NULL", "NIL", "NOTAVAILABLE", "NOTAPPLICABLE", "XXX", "TEST", "SEEABOVE", "ASABOVE"}

FILLER_OF = {w: g.split()[0] for g in FILLERS.split(",") for w in g.split()}
LEGAL_OF = {w: g.split()[0] for g in LEGAL.split(",") for w in g.split()}
#: A short form of two first names stands for both, joined by "|".
FIRST_OF = {w: "|".join(g.split()[0] for g in FIRST_NAMES.split(",") if w in g.split()) for g in FIRST_NAMES.split(",") for w in g.split()}
TRADE_OF = {w: w for w in TRADES} | {a: b for a, b in (x.split() for x in SHORT_TRADES.split(","))}
# patterns begin with a letter, not with what must be in front of it, as only then most places are passed over quickly
ALIAS = re.compile(r"(?:D(?<!\wD)(?:\s?/?\s?B\s?/?\s?A|OING BUSINESS AS)|T(?<!\wT)(?:\s?/\s?A|RADING AS)|A(?<!\wA)(?:\s?/\s?K\s?/\s?A|KA))\b.*$")
SOLE_PROP = re.compile(r"\bSOLE PROP\b")
OF_TOWN = re.compile(r"(?<=\w) +OF +[A-Z][A-Z .]+$")
CAMEL = re.compile(r"[A-Z](?<=[a-z][A-Z])")
SINGLES = re.compile(r"\b(?:[A-Z] ){1,4}[A-Z]\b")
LLC_IN_FULL = re.compile(r"\bLIMITED LIABILITY (?:COMPANY|CO)\b")
WORD = re.compile(r"[^\W_]+")
#: Names of at least so many letters may have been cut by the width of a form.
CUT_FROM = 28


class Name(NamedTuple):
    """kind: P person, I person with an initial for a first name, O firm. shard: what must be equal (first name,
    initial or trade; several first names, joined by "|", where a short form leaves that open). core: the rest in the order typed, without blanks; turned: the same with sorted words."""

    kind: str
    shard: str
    core: str
    turned: str
    fillers: str
    legal: str
    initial: str


def _deletes(words: dict[str, str], least: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for w, k in words.items():
        if len(w) >= least:
            for i in range(len(w)):
                out.setdefault(w[:i] + w[i + 1 :], k)
    return out


_NEAR = {"trade": _deletes(TRADE_OF, 6), "filler": _deletes(FILLER_OF, 6), "first": _deletes({g.split()[0]: g.split()[0] for g in FIRST_NAMES.split(",")}, 5), "legal": _deletes({"CORPORATION": "CORP", "INCORPORATED": "INC", "COMPANY": "CO", "LIMITED": "LTD"}, 6)}
_EXACT = {"trade": TRADE_OF, "filler": FILLER_OF, "first": FIRST_OF, "legal": LEGAL_OF}
_ALL_NEAR = frozenset().union(*_NEAR.values(), *_EXACT.values())


@lru_cache(50_000)
def word(w: str) -> tuple[str, str]:
    """(class, standard form) of a word; a long known word may hold one typing error."""
    for k, table in _EXACT.items():
        if w in table:
            return k, table[w]
    if w in NOISE:
        return "noise", w
    if len(w) >= 4:
        cut = [w[:i] + w[i + 1 :] for i in range(len(w))]
        if w not in _ALL_NEAR and _ALL_NEAR.isdisjoint(cut):
            return "core", w
        for k, near in _NEAR.items():
            if w in near:
                return k, near[w]
            for d in cut:
                if d in near and len(d) >= 4:
                    return k, near[d]
                if len(d) >= 5 and d in _EXACT[k]:
                    return k, _EXACT[k][d]
    return "core", w


@lru_cache(50_000)
def loose_trade(w: str) -> str:
    """The trade that a word not otherwise known cuts short, drops letters of or misspells; "" unless one fits best."""
    if not 3 <= len(w) <= 12:
        return ""
    same = [t for t in TRADES if t[0] == w[0]]
    cut = [t for t in same if len(w) >= 4 and t.startswith(w)]
    if not cut:
        cut = [t for t in same if len(w) >= 4 and len(t) > len(w) and _within(w, t)]
    if not cut:
        cut = [t for t in TRADES if len(w) >= 4 and _one_error(w, t)]
    return min(cut, key=len) if cut and (len(cut) == 1 or len(w) >= 5) else ""


def _within(w: str, t: str) -> bool:
    rest = iter(t)
    return all(c in rest for c in w)


def _one_error(a: str, b: str) -> bool:
    """One letter more, less, other, or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


@lru_cache(50_000)
def _split(w: str) -> tuple[str, str]:
    """A word written together with its trade: (rest, trade)."""
    for n in range(min(len(w) - 5, 15), 3, -1):
        if w[-n:] in TRADE_OF and TRADE_OF[w[-n:]] == w[-n:]:
            return w[:-n], w[-n:]
    return w, ""


@lru_cache(50_000)
def cut_word(w: str) -> tuple[str, str]:
    """The filler or legal form that w begins; ("", "") where there is none or several."""
    found = {("filler", FILLER_OF[x]) for x in FILLER_OF if len(x) > 4 and x.startswith(w)} | {("legal", LEGAL_OF[x]) for x in LEGAL_OF if x.startswith(w)}
    return found.pop() if len(w) > 1 and len(found) == 1 else ("", "")


def parse_name(name: str | None) -> Name | None:
    """The parts of a name, or None for blanks and placeholders. An alias after DBA or T/A is left out."""
    if not name:
        return None
    s = name.replace("\xa0", " ")
    s = ALIAS.sub(" ", s if s.isupper() else CAMEL.sub(r" \g<0>", s).upper()).strip()
    if " OF " in s:
        s = OF_TOWN.sub("", s)
    s = s.replace(".", "").replace("'", "")
    if "SOLE PROP" in s:
        s = SOLE_PROP.sub(" ", s)
    words = WORD.findall(s)
    if "".join(words) in PLACEHOLDERS:
        return None
    if sum(len(w) == 1 for w in words) > 1:
        words = SINGLES.sub(lambda m: m[0].replace(" ", "") if m[0].replace(" ", "") in LEGAL_OF else m[0], " ".join(words)).split()
    if "LIABILITY" in words:
        words = LLC_IN_FULL.sub("LLC", " ".join(words)).split()
    core: list[str] = []
    trades: list[str] = []
    fillers: list[str] = []
    legal = ""
    firsts: list[str] = []
    letters: list[str] = []
    for at, w in enumerate(words):
        k, v = word(w)
        if k == "core" and at and at == len(words) - 1 and len(name.strip()) >= CUT_FROM and cut_word(w)[0]:
            k, v = cut_word(w)
        if k == "trade":
            trades.append(v)
        elif k == "filler":
            fillers.append(v)
        elif k == "legal":
            legal = v
        elif k == "noise":
            if len(w) == 1:
                letters.append(w)
        elif k == "first":
            firsts.append(v)
        elif len(w) == 1:
            letters.append(w)
        else:
            core.append(w)
    if not trades and core:
        rest, t = _split(core[-1])
        if t:
            core[-1], trades = rest, [t]
        elif len(core) > 1 and not firsts and (t := loose_trade(core[-1])):
            core.pop()
            trades = [t]
    if not trades and not legal and not fillers:
        if firsts and core:
            c = "".join(core)
            return Name("P", firsts[0], c, "".join(sorted([*core, *firsts[1:]])), "", "", letters[0] if letters else "")
        if len(firsts) > 1:
            a, b = sorted(firsts[:2])
            return Name("P", a, b, b, "", "", letters[0] if letters else "")
        if letters and len(core) == 1 and len(core[0]) >= 5:
            return Name("I", letters[0], core[0], core[0], "", "", "")
    core += firsts if trades or legal or fillers or not core else []
    if not core:
        core, trades = trades[:-1] or trades, trades[-1:]
        if not core:
            return None
    if len(trades) > 1:
        core += sorted(trades[:-1])
    whole, turned = "".join(core), "".join(sorted(core))
    if len(core) == 1 and whole.startswith("THE") and len(whole) > 9:
        turned = whole[3:]  # an article written together with the name
    return Name("O", trades[-1] if trades else "", whole, turned, " ".join(sorted(set(fillers))), legal, "")
