"""Problem 5: the best representative of each duplicate group, field by field.

Token-level consensus. The distinct values of a group are aligned progressively, the heaviest first: each is laid against
the profile of those before it, at least edits, and what it has beyond them becomes a new slot. Every slot is voted with the
weights of the values that hold a token there, "no token" with those of the values that have none, and the existing value
closest to the voted tokens survives.

Two votes: "dominance", in which the member of highest rank outweighs all others together (weights 1/2, 1/4, 1/8 ... by
rank, computed as a maximum, which is the same), and "sum", which adds given weights.

Scale: equal values of a group are merged before anything else. A group is a stream of sorted values of which only the
profile is kept in memory. Groups of more than SPLIT values are cut into parts by a hash of the value; the parts' profiles are
aligned with each other in the same way. Neither a group nor its values are collected.

Defined edge cases: null, empty and unusable values neither vote nor survive; a group without any usable value is left out
for that field; equal rank goes to the smaller tie-breaker; repeated members count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.storage import Scratch

SPLIT = 1024
Rank = tuple[int, int, str]


class Profile:
    """Aligned values: per slot each token, None for those that have none, with its weight and best rank."""

    def __init__(self, slots: list[dict[str | None, list]] | None = None, weight: float = 0.0, rank: Rank | None = None):
        self.slots, self.weight, self.rank = slots or [], weight, rank

    def lead(self, slot: dict, dominance: bool) -> str | None:
        """The token a slot votes for."""
        return min(slot, key=lambda t: (slot[t][1], t or "") if dominance else (-slot[t][0], slot[t][1], t or ""))

    def line(self, dominance: bool) -> list[str]:
        return [t for t in (self.lead(s, dominance) for s in self.slots) if t is not None]

    def add(self, tokens: list[str], weight: float, rank: Rank) -> None:
        """Aligns one value."""
        self.merge(Profile([{t: [weight, rank]} for t in tokens], weight, rank))

    def merge(self, other: Profile) -> None:
        """Aligns another profile; slots without a counterpart stay, on either side, with the other side's weight on None."""
        mine, theirs = self.slots, other.slots
        if self.rank is None:
            self.slots, self.weight, self.rank = theirs, other.weight, other.rank
            return
        out = []
        for i, j in _path(mine, theirs):
            slot = mine[i] if i is not None else {None: [self.weight, self.rank]}
            for token, (w, r) in (theirs[j] if j is not None else {None: [other.weight, other.rank]}).items():
                if token in slot:
                    slot[token] = [slot[token][0] + w, min(slot[token][1], r)]
                else:
                    slot[token] = [w, r]
            out.append(slot)
        self.slots, self.weight, self.rank = out, self.weight + other.weight, min(self.rank, other.rank)

    def dump(self) -> str:
        return json.dumps([[[[t, w, r] for t, (w, r) in s.items()] for s in self.slots], self.weight, self.rank])

    @classmethod
    def load(cls, text: str) -> Profile:
        slots, weight, rank = json.loads(text)
        return cls([{t: [w, tuple(r)] for t, w, r in s} for s in slots], weight, tuple(rank))


def _path(a: list[dict], b: list[dict]) -> list[tuple[int | None, int | None]]:
    """Pairs of slots of the alignment with the fewest edits; slots that share a token cost nothing."""
    share = lambda x, y: any(t is not None and t in x for t in y)
    if len(a) == len(b) and all(map(share, a, b)):
        return [(i, i) for i in range(len(a))]
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (not share(a[i - 1], b[j - 1])), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (not share(a[i - 1], b[j - 1])):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def _lines(dominance: bool):
    """Streams of sorted values to one row per part of a group: its line, or its profile if the group has other parts."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, profile = None, None
        for b in batches:
            out: list[tuple] = []
            for *own, tokens, weight, age, trust, tie in zip(*(b.column(c).to_pylist() for c in ("grp", "field", "part", "parts", "tokens", "weight", "age", "trust", "tie"))):
                if own != key:
                    if profile is not None:
                        out.append(_row(key, profile, dominance))
                    key, profile = own, Profile()
                profile.add(tokens, weight, (age, trust, tie))
            yield _batch(out)
        if profile is not None:
            yield _batch([_row(key, profile, dominance)])

    return stream


def _merged(dominance: bool):
    """Streams of the profiles of the parts of a group, sorted by group, to one line per group."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, profile = None, None
        for b in batches:
            out: list[tuple] = []
            for *own, text in zip(*(b.column(c).to_pylist() for c in ("grp", "field", "profile"))):
                if own != key:
                    if profile is not None:
                        out.append(_row([*key, 0, 1], profile, dominance))
                    key, profile = own, Profile()
                profile.merge(Profile.load(text))
            yield _batch(out)
        if profile is not None:
            yield _batch([_row([*key, 0, 1], profile, dominance)])

    return stream


def _row(key: list, profile: Profile, dominance: bool) -> tuple:
    grp, field, part, parts = key
    return (grp, field, part, profile.line(dominance) if parts == 1 else None, None if parts == 1 else profile.dump())


_OUT = pa.schema([("grp", pa.string()), ("field", pa.string()), ("part", pa.int32()), ("line", pa.list_(pa.string())), ("profile", pa.string())])
_OUT_SQL = "grp string, field string, part int, line array<string>, profile string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_OUT.types)], schema=_OUT)


def consensus(values: DataFrame, vote: str, split: int = SPLIT) -> DataFrame:
    """(grp, field, value, member) of the surviving values.

    values: (grp string, field, value, tokens, weight double, rank struct<age, trust, tie>, member), usable values only; the
    smaller rank is better.
    """
    dominance = vote == "dominance"
    scratch = Scratch(values.sparkSession, "consensus")
    held = values.groupBy("grp", "field", "value").agg(F.min(F.struct("rank", "member", "tokens")).alias("best"), F.sum("weight").alias("weight"))
    held = scratch.put(held.select("grp", "field", "value", "weight", "best.rank", "best.member", "best.tokens"))
    large = scratch.put(held.groupBy("grp", "field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("grp", "field", F.ceil(F.col("n") / split).cast("int").alias("parts")))
    rows = held.join(large, ["grp", "field"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("value"), F.col("parts")).cast("int"))
    first = [F.col("rank")] if dominance else [F.desc("weight"), F.col("rank")]
    cols = ["grp", "field", "part", "parts", "tokens", "weight", "rank.age", "rank.trust", "rank.tie"]
    lines = rows.repartition("grp", "field", "part").sortWithinPartitions("grp", "field", "part", *first).select(*cols).mapInArrow(_lines(dominance), _OUT_SQL)
    lines = scratch.put(lines)
    parts = lines.where("profile is not null").repartition("grp", "field").sortWithinPartitions("grp", "field", "part")
    agreed = lines.where("profile is null").unionByName(parts.mapInArrow(_merged(dominance), _OUT_SQL)).select("grp", "field", F.array_join("line", " ").alias("agreed"))
    distance = F.levenshtein(F.array_join("tokens", " "), F.col("agreed"))
    power = F.struct("rank", "weight") if dominance else F.struct((-F.col("weight")).alias("less"), F.col("rank"))
    closest = held.join(agreed, ["grp", "field"]).select("grp", "field", F.struct(distance.alias("far"), power.alias("power"), "value", "member").alias("order"))
    return closest.groupBy("grp", "field").agg(F.min("order").alias("kept")).select("grp", "field", "kept.value", "kept.member")


def usable_phone(c: Column) -> Column:
    """Digits of a phone with at least seven, neither one digit repeated nor counted up or down (9 is followed by 0)."""
    digits = F.regexp_replace(c, r"\D", "")
    # digits counted up are a part of 01234567890123...; `round` is one turn more than the digits can need
    round_ = (F.length(digits) / 10 + 2).cast("int")
    counted = F.contains(F.repeat(F.lit("0123456789"), round_), digits) | F.contains(F.repeat(F.lit("9876543210"), round_), digits)
    return F.when((F.length(digits) >= 7) & ~digits.rlike(r"^(\d)\1*$") & ~counted, digits)
