"""Problem 3: postal addresses that name the same place in different ways.

1. Each address is cut into segments; its words are assigned to number, unit, street, kind of street, direction, locality
   and postcode. Of all readings of a segment the one with the highest score is taken (readings()).
2. Addresses written alike are one class; classes are compared, rows are not.
3. Localities: a rare spelling one deletion away from a far more frequent one in no other postcode area is the latter; an
   address without locality has that of its postcode's area, else the only one that has its street and number. Where
   several have it, the address stays without and meets nothing with a locality: a missing locality is no wildcard.
4. A deletion-neighbourhood index over street tokens inside locality blocks: two streets of a locality whose tokens, or
   whose names as a whole, share a string left by deleting at most one character are candidates. The tokens of both are then
   assigned to each other at least cost (assignment()). Two names that both stand at many numbers of the locality are
   streets of their own, however alike.
5. Addresses of one locality and number meet if their streets are equal, neighbours, or, being long, neighbours of one
   street of the locality. Numbers, and if asked units, are hard vetoes, kinds and directions veto what they contradict.
   Inside (postcode, number) blocks equal streets meet whatever the locality says.

Scale: the index holds the distinct street names of each locality, not rows; a block of pairs holds the streets of one name
at one number of one locality. Pairs of rows are made from pairs of classes at the end only.

Defined edge cases: rows without street or number are in no pair; a missing kind or direction contradicts nothing; all
scripts are kept; null columns are skipped; texts of any length are read whole; repeated rows are paired; empty tables give
empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.storage import Scratch

# Kinds of streets with their spellings. What abbreviations leave open (PL, AV, STR) is one kind.
KINDS = {
    "ST": "STREET STRT ST STRASSE STR", "RD": "ROAD RD", "AVE": "AVENUE AVEN AVE AVENIDA AVDA AVD AV", "LN": "LANE LN LA", "DR": "DRIVE DRV DR", "CT": "COURT CRT CT", "TER": "TERRACE TERR TER",
    "SQ": "SQUARE SQR SQ", "BLVD": "BOULEVARD BOUL BVD BLVD", "PL": "PLACE PLC PL PLATZ PLAZA PLZA PZA PRACA PCA PC", "CALLE": "CALLE CL C", "PASEO": "PASEO PSO PO", "RUA": "RUA R",
    "TRAV": "TRAVESSA TRAV TV TR", "WEG": "WEG", "ALLEE": "ALLEE",
}
#: Kinds that German names carry at their end, longest first.
GLUED = {"STRASSE": "ST", "PLATZ": "PL", "ALLEE": "ALLEE", "WEG": "WEG", "STR": "ST", "PL": "PL", "AL": "ALLEE", "W": "WEG"}
UNITS = "APARTMENT APT UNIT FLAT SUITE STE PUERTA PTA PISO APARTAMENTO APTO WOHNUNG WHG APP"
DIRECTIONS = {"N": "NORTH NTH NO N", "S": "SOUTH STH SO S", "E": "EAST E", "W": "WEST W"}
LOCALITY = {"FT": "FORT", "MT": "MOUNT", "PT": "PORT", "ST": "SAINT", "STE": "SAINT"}

KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
WAY_OF = {w: k for k, ws in DIRECTIONS.items() for w in ws.split()}
_UNIT = re.compile(rf"\b(?:{'|'.join(UNITS.split())})\b\s*(?:NO\b\s*)?([0-9]+\s?[A-Z]?\b|[A-Z]\b)")
_NUMBER = re.compile(r"\b(?:NO|NUM|NR|N)\b\s*([0-9]{1,4})([A-Z]?)\b")
_HASH = re.compile(r"#\s*([0-9]{1,4})([A-Z]?)\b")
_ASIDE = re.compile(r"^(?:CARE OF|C O|CO|ATTN|ATT|REAR|BEHIND|OPP)\b")
_ORDINAL = re.compile(r"^[0-9]+(?:ST|ND|RD|TH)$")
_GERMAN = re.compile(r"^(.{5,}?)(STRASSE|PLATZ|ALLEE|WEG|STR|PL|AL|W)$")


_CALLE = re.compile(r"\bC/")
_CALLE_AS_WRITTEN = re.compile(r"\b[Cc]/")
_BREAK = re.compile(r"[,;/]|\s-\s")
_OTHER_ASCII = re.compile(r"[^A-Z0-9#]+")


def plain(text: str) -> str:
    """Upper case words without accents; # is kept."""
    if text.isascii():  # most addresses are
        return " ".join(_OTHER_ASCII.sub(" ", _CALLE.sub(" CALLE ", text.upper()).replace("'", "")).split())
    t = re.sub(r"N\s?[º°]\.?", " NO ", re.sub(r"\bP\.?\s?[º°]", " PASEO ", re.sub(r"\bC/", " CALLE ", text.upper())))
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return " ".join(re.sub(r"(?:[^\w#]|_)+", " ", t.replace("'", "")).split())


@lru_cache(16_384)
def locality(text: str | None) -> str:
    """A locality as one string without spaces, its usual abbreviations written out."""
    ws = plain(text or "").replace("#", " ").split()
    return "".join(LOCALITY.get(w, w) if len(ws) > 1 and i == 0 else w for i, w in enumerate(ws) if not w.isdigit())


_EMPTY_WORDS = set(KIND_OF) | set(WAY_OF) | set(UNITS.split()) | {"NO", "NUM", "NR"}


def _segments(parts: list[str | None]) -> list[str]:
    """Pieces of an address that stand for something; a piece of numbers and kinds alone joins its neighbour."""
    out: list[str] = []
    held = ""
    for part in filter(None, parts):
        for piece in _BREAK.split(_CALLE_AS_WRITTEN.sub("CALLE ", part)):
            t = plain(piece) if piece else ""
            if not t or _ASIDE.match(t):
                continue
            bare = all(w in _EMPTY_WORDS or any(c.isdigit() for c in w) and not _ORDINAL.match(w) for w in t.replace("#", " ").split())
            if bare and out:
                out[-1] += " " + t
            elif bare:
                held = f"{held} {t}".strip()
            else:
                out.append(f"{held} {t}".strip())
                held = ""
    return [*out, held] if held else out


def readings(ws: list[str]) -> Iterator[tuple[float, list[str], str, str]]:
    """(score, street words, kind, direction): every way to read words as a street, its kind and its direction.

    Kind and direction stand at either end, the direction outside or inside; a street keeps one word at least. Explained
    words score, longer spellings of a kind a little more, and a kind behind its street a little more than one before it.
    """
    yield 0.0, ws, "", ""
    n = len(ws)
    if n < 2 or not any(w in m for w in (ws[0], ws[-1]) for m in (KIND_OF, WAY_OF)):
        return
    front = [((), "", "", 0.0)] if n else []
    if n > 1:
        k, w = KIND_OF.get(ws[0], ""), WAY_OF.get(ws[0], "")
        front += [((0,), k, "", 2 + 0.1 * len(ws[0]))] if k else []
        front += [((0,), "", w, 1.0)] if w else []
        if w and n > 2 and ws[1] in KIND_OF:
            front.append(((0, 1), KIND_OF[ws[1]], w, 3 + 0.1 * len(ws[1])))
        back = [((), "", "", 0.0)]
        k, w = KIND_OF.get(ws[-1], ""), WAY_OF.get(ws[-1], "")
        back += [((n - 1,), k, "", 2.05 + 0.1 * len(ws[-1]))] if k else []
        back += [((n - 1,), "", w, 0.9)] if w else []
        if w and n > 2 and ws[-2] in KIND_OF:
            back.append(((n - 2, n - 1), KIND_OF[ws[-2]], w, 3.05 + 0.1 * len(ws[-2])))
        for f, fk, fw, fs in front:
            for b, bk, bw, bs in back:
                taken = len(f) + len(b)
                if 0 < taken < n and not (fk and bk) and not (fw and bw):
                    yield fs + bs, ws[len(f) : n - len(b)], fk or bk, fw or bw


def parse(parts: list[str | None], city: str | None, post: str | None) -> tuple[str, int, str, str, str, str, str, str] | None:
    """(street, number, kind, way, unit, locality, postcode, whole street) of an address, None without street or number."""
    unit = ""
    number: int | None = None
    hint = locality(city)
    streets: list[tuple[int, list[str], str, str]] = []
    for t in _segments(parts):
        if m := _UNIT.search(t):
            unit = unit or m[1].replace(" ", "")
            t = (t[: m.start()] + " " + t[m.end() :]).strip()
        explicit = False
        if m := _NUMBER.search(t):
            if number is None:
                number, explicit = int(m[1]), True
                unit = unit or m[2]
            t = (t[: m.start()] + " " + t[m.end() :]).strip()
        if m := _HASH.search(t):
            t = (t[: m.start()] + " " + t[m.end() :]).strip()
            if number is None and not re.search(r"\b\d{1,4}[A-Z]?\b", t):
                number, explicit = int(m[1]), True
            else:
                unit = unit or m[1] + m[2]
        ws = t.replace("#", " ").split()
        if not ws:
            continue
        rest = [w for w in ws[1:] if not (w.isdigit() and len(w) == 5)]
        ended = len(rest) > 1 and (rest[-1] in KIND_OF or len(rest) > 2 and rest[-1] in WAY_OF and rest[-2] in KIND_OF)
        # five figures in front of a street with its kind, and no other number: a house
        if number is None and re.fullmatch(r"\d{5}", ws[0]) and ws[0] != (post or "").strip() and ended and not any(c.isdigit() for w in rest for c in w):
            number, explicit = int(ws.pop(0)), True
        codes = [w for w in ws if w.isdigit() and len(w) == 5]
        ws = [w for w in ws if not (w.isdigit() and len(w) == 5)]
        post = post or (codes[0] if codes else None)
        figures = [i for i, w in enumerate(ws) if re.fullmatch(r"\d{1,4}[A-Z]?|\d{6,9}", w)]
        if figures and number is None:
            bare = [i for i in figures if ws[i].isdigit()] or figures
            # two numbers in front: the one next to the street is the house, the other a unit
            at = bare[1] if len(bare) > 1 and bare[:2] == [0, 1] and len(ws) > 2 else bare[0]
            number = int(re.sub(r"\D", "", ws[at]))
            explicit = True
            for i in figures:
                if i != at:
                    unit = unit or ws[i]
        elif figures:
            unit = unit or ws[figures[0]]
        ws = [w for i, w in enumerate(ws) if i not in figures]
        if not ws:
            continue
        ws, kind, way = max(readings(ws), key=lambda r: r[0])[1:]
        streets.append((3 * explicit + 2 * bool(kind) - 3 * bool(codes), ws, kind, way))
    if number is None or not streets:
        return None
    best = max(range(len(streets)), key=lambda i: (streets[i][0], -i))
    _, ws, kind, way = streets[best]
    if not hint:
        hint = next((locality(" ".join(s[1])) for i, s in enumerate(streets) if i != best and not s[2] and any(c.isalpha() for c in "".join(s[1]))), "")
    whole = "".join(ws)
    street = " ".join(ws)
    if not kind and (m := _GERMAN.match(whole)):
        street, kind = m[1], GLUED[m[2]]
    # short names are streets, but not a kind, direction or unit that stands alone
    if not any(c.isalpha() for c in street) or not kind and whole in _EMPTY_WORDS:
        return None
    return street, number, kind, way, unit, hint, (post or "").strip(), whole


_NAMES = ["street", "number", "kind", "way", "unit", "city", "post", "whole"]
_TYPES = {"number": "bigint"}


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for b in batches:
        seqs, out = [], []
        for seq, parts, city, post in zip(*(b.column(n).to_pylist() for n in ("seq", "parts", "city", "post"))):
            key = (*parts, city, post)
            if key not in known:
                if len(known) > 50_000:  # a memory of repeated texts only
                    known.clear()
                known[key] = parse(parts, city, post)
            if known[key] is not None:
                seqs.append(seq)
                out.append(known[key])
        columns = [pa.array([o[i] for o in out], pa.int64() if n == "number" else pa.string()) for i, n in enumerate(_NAMES)]
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), *columns], names=["seq", *_NAMES])


def _deletions(c: Column) -> Column:
    """A string and everything that is left of it when one character is deleted; of short ones (under FUZZY) only themselves."""
    less = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.when(F.length(c) >= FUZZY, F.array_distinct(F.concat(F.array(c), less))).otherwise(F.array(c))


#: Names and tokens shorter than FUZZY must be equal, those of LONG may differ twice; a locality gives way to one RATIO times
#: as frequent. Two names, each at MANY numbers of a locality and none at SHARE times as many as the other, are two streets.
FUZZY, LONG, RATIO, PURE, MANY, SHARE = 5, 8, 10.0, 0.95, 5, 5


def _one_off(a: str, b: str) -> Column:
    """Whether two columns are equal, or long enough and a single deletion, insertion, change or exchange apart."""
    x, y = F.col(a), F.col(b)
    return (x == y) | (F.least(F.length(x), F.length(y)) >= FUZZY) & (F.levenshtein(x, y, 2) >= 0) & F.arrays_overlap(_deletions(x), _deletions(y))


def _token_cost(a: str, b: str) -> int:
    """0 for equal tokens, 1 for one error or an initial, 3 for others."""
    if a == b:
        return 0
    if len(a) == 1 and b.startswith(a) or len(b) == 1 and a.startswith(b):
        return 1
    if min(len(a), len(b)) < FUZZY or abs(len(a) - len(b)) > 1:
        return 3
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return 1 if x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:] else 3


def assignment(a: list[str], b: list[str]) -> int:
    """The least total cost of assigning the tokens of two street names to each other.

    A token without partner costs 1 if it may be a kind or direction that one side doesn't write, else 3. Equal tokens are
    paired beforehand, which never costs more; what is left is solved over subsets.
    """
    left = list(a)
    right = []
    for t in b:
        if t in left:
            left.remove(t)
        else:
            right.append(t)
    alone = lambda t: 1 if t in KIND_OF or t in WAY_OF else 3
    if len(left) > len(right):
        left, right = right, left
    if len(right) > 12:  # differ in more tokens than any accepted pair
        return 3 * len(right)
    best = {0: 0}
    for t in left:
        step: dict[int, int] = {}
        for mask, cost in best.items():
            step[mask] = min(step.get(mask, 1 << 30), cost + alone(t))
            for j, u in enumerate(right):
                if not mask >> j & 1:
                    to = mask | 1 << j
                    step[to] = min(step.get(to, 1 << 30), cost + _token_cost(t, u))
        best = step
    return min(cost + sum(alone(u) for j, u in enumerate(right) if not mask >> j & 1) for mask, cost in best.items())


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of streets whose tokens can be assigned at a cost of one error at most."""
    for b in batches:
        keep = [x.replace(" ", "") == y.replace(" ", "") or assignment(x.split(), y.split()) <= 1 for x, y in zip(b.column("street").to_pylist(), b.column("o_street").to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def _joined(c: str) -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit(""))


def locality_fixes(classes: DataFrame) -> DataFrame:
    """(city, right): spellings of localities that are one error (two, if long) away from one RATIO (twice that) times as frequent, unless their postcodes lie apart."""
    names = classes.where("city != ''").groupBy("city").agg(F.sum("n").alias("n"), F.min(F.when(F.col("post") != "", F.left("post", F.lit(2)))).alias("lo"), F.max(F.when(F.col("post") != "", F.left("post", F.lit(2)))).alias("hi"))
    twice = F.when(F.length("city") >= LONG, F.array_distinct(F.flatten(F.transform(_deletions(F.col("city")), _deletions)))).otherwise(_deletions(F.col("city")))
    index = names.where(F.length("city") >= FUZZY).withColumn("v", F.explode(F.transform(twice, lambda v: F.xxhash64(v))))
    better = index.select("v", F.col("city").alias("right"), F.col("n").alias("m"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    near = index.join(better, "v").where((F.col("m") >= F.col("n") * RATIO) & (F.col("city") != F.col("right")))
    near = near.where(_one_off("city", "right") | (F.least(F.length("city"), F.length("right")) >= LONG) & (F.levenshtein("city", "right", 3) >= 0) & (F.col("m") >= F.col("n") * 2 * RATIO))
    apart = (F.col("hi") < F.col("r_lo")) | (F.col("lo") > F.col("r_hi"))
    return near.where(~F.coalesce(apart, F.lit(False))).groupBy("city").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def postcode_areas(classes: DataFrame, longest: int = 10) -> DataFrame:
    """(area, home): beginnings of postcodes of whose addresses PURE or more are in one locality; the longest known one counts."""
    both = classes.where("city != '' and post != ''").select("city", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("post"), F.lit(longest))), lambda i: F.left("post", i))).alias("area"))
    each = both.groupBy("area", "city").agg(F.sum("n").alias("n"))
    top = each.groupBy("area").agg(F.sum("n").alias("every"), F.max("n").alias("most"), F.max_by("city", F.struct("n", "city")).alias("home"))
    return top.where(F.col("most") >= PURE * F.col("every")).select("area", "home")


class Places:
    """Addresses of (seq bigint, parts array<string>, city, post): classes, and what each row's class is."""

    def __init__(self, rows: DataFrame):
        self.scratch = scratch = Scratch(rows.sparkSession, "places")
        parsed = scratch.put(rows.mapInArrow(_parse_rows, "seq bigint, " + ", ".join(f"{n} {_TYPES.get(n, 'string')}" for n in _NAMES)))
        parsed = self._kinds_restored(parsed)
        same = ["street", "number", "kind", "way", "unit", "city", "post"]
        digest = {"d1": F.xxhash64(*same), "d2": F.xxhash64(F.lit(1), *same[::-1])}  # 128 bits are the identity of a class
        parsed = scratch.put(parsed.drop("whole").withColumns(digest))
        classes = parsed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in same])
        classes = scratch.put(classes.withColumn("id", F.monotonically_increasing_id()))
        self.members = scratch.put(parsed.select("seq", "d1", "d2").join(classes.select("id", "d1", "d2"), ["d1", "d2"]).select("seq", "id"))
        self.classes = scratch.put(self._located(classes.drop("d1", "d2")))

    def _kinds_restored(self, parsed: DataFrame) -> DataFrame:
        """A short ending is part of the name after all if the name is written more often without a kind cut from it."""
        counts = parsed.where("whole != ''").groupBy("street", "whole").agg(F.count(F.lit(1)).alias("n"))
        counts = self.scratch.put(counts)
        names = counts.groupBy(F.col("street").alias("name")).agg(F.sum("n").alias("n"))
        cut = counts.where(_joined("street") != F.col("whole"))
        back = cut.join(names.select(F.col("name").alias("whole"), F.col("n").alias("w")), "whole").join(names.select(F.col("name").alias("street"), F.col("n").alias("s")), "street")
        back = self.scratch.put(back.where("w > s").select("street", "whole", F.lit(True).alias("__back")))
        parsed = parsed.join(back, ["street", "whole"], "left")
        return parsed.withColumns({"street": F.when(F.col("__back"), F.col("whole")).otherwise(F.col("street")), "kind": F.when(F.col("__back"), "").otherwise(F.col("kind"))}).drop("__back")

    def _located(self, classes: DataFrame) -> DataFrame:
        """Classes with the corrected or inferred city."""
        put = self.scratch.put
        fixes = put(locality_fixes(classes))
        classes = classes.join(fixes, "city", "left").withColumn("city", F.coalesce("right", "city")).drop("right")
        areas = put(postcode_areas(classes))
        lost = classes.where("city = '' and post != ''").select("id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("post"), F.lit(10))), lambda i: F.left("post", i))).alias("area"))
        homes = put(lost.join(areas, "area").groupBy("id").agg(F.max_by("home", F.length("area")).alias("home")))
        classes = put(classes.join(homes, "id", "left").withColumn("city", F.when(F.col("city") == "", F.coalesce("home", F.lit(""))).otherwise(F.col("city"))).drop("home"))
        # street and number of one locality only
        known = classes.where("city != ''").select("number", _joined("street").alias("name"), "city")
        exact = known.groupBy("number", "name").agg(F.min("city").alias("lo"), F.max("city").alias("hi"))
        open_ = put(classes.where("city = ''").select("number", _joined("street").alias("name")).distinct())
        first = put(open_.join(exact, ["number", "name"], "left"))
        rest = first.where("lo is null").select("number", "name", F.explode(_deletions(F.col("name"))).alias("v"))
        near = known.join(rest.select("number").distinct(), "number", "left_semi").distinct().select("number", F.col("name").alias("o_name"), "city", F.explode(_deletions(F.col("name"))).alias("v"))
        near = rest.join(near, ["number", "v"]).where(_one_off("name", "o_name")).groupBy("number", "name").agg(F.min("city").alias("lo"), F.max("city").alias("hi"))
        only = put(first.where("lo is not null").unionByName(near).where("lo = hi").select("number", "name", F.col("lo").alias("only")))
        named = classes.withColumn("name", _joined("street")).join(only, ["number", "name"], "left")
        return named.withColumn("city", F.when(F.col("city") == "", F.coalesce("only", F.lit(""))).otherwise(F.col("city"))).drop("only", "name")

    def links(self, units: bool = False) -> DataFrame:
        """(a, b): pairs of different classes at one building (units: at one unit), a < b."""
        put = self.scratch.put
        cells = put(self.classes.groupBy("city", "street", "number").agg(F.count(F.lit(1)).alias("n")).select("city", "street", "number"))
        names = put(cells.groupBy("city", "street").agg(F.count(F.lit(1)).alias("n")))
        tokens = F.array_distinct(F.concat(F.array(_joined("street")), F.filter(F.split("street", " "), lambda t: F.length(t) >= FUZZY)))
        variants = F.array_distinct(F.flatten(F.transform(tokens, _deletions)))
        index = names.select("city", "street", "n", F.explode(F.transform(variants, lambda v: F.xxhash64("city", v))).alias("h"))
        other = index.select(F.col("city").alias("o_city"), F.col("street").alias("o_street"), F.col("n").alias("o_n"), F.col("h").alias("o_h"))
        two = (F.least("n", "o_n") >= MANY) & (F.least("n", "o_n") * SHARE >= F.greatest("n", "o_n"))
        met = index.join(other, F.col("h") == F.col("o_h")).where("city = o_city and street < o_street").where(~two).select("city", "street", "o_street").distinct()
        met = put(met.select("*", _joined("street").alias("x"), _joined("o_street").alias("y")).withColumn("quick", _one_off("x", "y")))
        slow = met.where("not quick").select("city", "street", "o_street").mapInArrow(_assigned, "city string, street string, o_street string")
        beside = put(met.where("quick").select("city", "street", "o_street").unionByName(slow))
        both = beside.select("city", F.col("street").alias("street"), F.col("o_street").alias("pivot")).unionByName(beside.select("city", F.col("o_street").alias("street"), F.col("street").alias("pivot")))
        involved = both.select("city", F.col("pivot").alias("street")).distinct()
        pivots = put(both.unionByName(involved.withColumn("pivot", F.col("street"))))
        spots = put(cells.join(pivots, ["city", "street"]))
        twin = spots.select(*[F.col(c).alias(f"o_{c}") for c in spots.columns])
        shared = spots.join(twin, (F.col("city") == F.col("o_city")) & (F.col("number") == F.col("o_number")) & (F.col("pivot") == F.col("o_pivot"))).where("street < o_street")
        x, y = _joined("street"), _joined("o_street")
        direct = (F.col("street") == F.col("pivot")) | (F.col("o_street") == F.col("pivot"))
        twice = (F.least(F.length(x), F.length(y)) >= LONG) & (F.levenshtein(x, y, 4) >= 0)
        near = put(shared.where(direct | twice).select("city", "number", "street", "o_street").distinct())
        rows = self.classes
        theirs = rows.select(*[F.col(c).alias(f"o_{c}") for c in rows.columns])
        agree = lambda c: (F.col(c) == "") | (F.col(f"o_{c}") == "") | (F.col(c) == F.col(f"o_{c}"))
        fits = agree("kind") & agree("way") & (agree("unit") if units else F.lit(True))
        equal = lambda *names: [F.col(n) == F.col(f"o_{n}") for n in names]
        alike = rows.join(theirs, equal("city", "number", "street")).where("id < o_id")
        spelled = rows.join(near, ["city", "number", "street"]).withColumnRenamed("o_street", "n_street").join(theirs, [*equal("city", "number"), F.col("n_street") == F.col("o_street")])
        coded = rows.where("post != ''").join(theirs.where("o_post != ''"), equal("post", "number", "street")).where("id < o_id and city != o_city")
        pair = lambda df: df.where(fits).select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))
        return pair(alike).unionByName(pair(spelled)).unionByName(pair(coded))

    def pairs(self, units: bool = False) -> DataFrame:
        """(a_seq, b_seq): all pairs of rows at one place, smaller first; its size is that of the result asked for."""
        links = self.scratch.put(self.links(units))
        side = lambda p: self.members.select(F.col("id").alias(p), F.col("seq").alias(f"{p}_seq"))
        several = self.members.groupBy("id").count().where("count > 1").select("id")
        crowd = self.members.join(several, "id", "left_semi")
        within = crowd.select("id", F.col("seq").alias("a_seq")).join(crowd.select("id", F.col("seq").alias("b_seq")), "id").where("a_seq < b_seq").select("a_seq", "b_seq")
        across = links.join(side("a"), "a").join(side("b"), "b").select(F.least("a_seq", "b_seq").alias("a_seq"), F.greatest("a_seq", "b_seq").alias("b_seq")).where("a_seq < b_seq")
        return within.unionByName(across)
