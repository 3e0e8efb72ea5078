"""Problem 6: the same entities in several sources that share no key.

Each attribute is encoded as a fixed 64-bit vector of its hashed q-grams. Multi-index Hamming hashing finds, without
comparing all pairs, exactly the pairs that are equal in a vector of WHOLE or lie within RADIUS bits in a view of VIEWS. A
view is the vector of one attribute behind that of a second one, which must be equal: the first is cut into RADIUS + 1
pieces, of which a pair within the radius has one in common (a wrong letter changes four bits at most). A bucket's key carries the
vector folded to FOLD bits, which rules out most of what meets by chance; what is left is compared by its whole vectors.

Found pairs get a field-weighted Dice score of the attributes other than the identifier. Score and agreement of identifiers
are two views of one hidden fact; expectation maximisation over the counts of all found pairs (a table of a few hundred
cells) gives the confidence of every cell, made monotone in the score.

Skew: records whose attributes are equal to the letter are one class per source before anything is joined; values that many
people share, stand-in dates among them, are no evidence. What is left of a hot bucket is split by the skew join of adaptive
execution; no pair is dropped.

Defined edge cases: an attribute that is null on either side neither helps nor harms; records that share no WHOLE and no view
are in no pair; repeated rows are paired like others; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.llm import person
from kinmesh.storage import Scratch

#: Attributes, and whether a q-gram's place in the value counts.
ENCODED = {"name": False, "word": False, "nid": True, "dob": True, "mail": False, "phone": True, "addr": False}
WHOLE = [("nid",), ("mail",), ("phone",), ("word", "dob")]
#: (near, equal): the first attribute within RADIUS bits while the second is equal; `word` is the name where it has no long word.
VIEWS = [("name", "dob"), ("nid", "word"), ("mail", "word"), ("addr", "name")]
RADIUS, FOLD = 4, 20
WEIGHTS = {"name": 2.0, "dob": 2.5, "mail": 2.5, "phone": 1.5, "addr": 1.5}
BINS, SHRINK, ROUNDS = 50, 1.0, 20
#: Dice scores from which two identifiers count as the same and as nearly the same.
SAME, NEARLY = 0.999, 0.7


def _vector(values: pa.Array, positional: bool, seed: int) -> np.ndarray:
    """64 bits of the hashed bigrams of each value, 0 for null."""
    texts = [f"\x02{v}\x03" if v else "" for v in values.to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.uint64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if not len(flat):
        return out.view(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = (np.arange(len(flat)) - np.repeat(starts, lengths)).astype(np.uint64)
    grams = flat * np.uint64(0x1000193) + np.concatenate([flat[1:], [np.uint64(0)]]) + np.uint64(seed)
    if positional:
        grams += inside * np.uint64(0x9E3779B1)
    grams = (grams ^ (grams >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(1) << (grams >> np.uint64(58))
    last = np.repeat(starts + lengths - 1, lengths) == np.arange(len(flat))
    bits[last] = 0  # the bigram that would reach into the next value
    some = lengths > 0
    out[some] = np.bitwise_or.reduceat(bits, starts[some])
    return out.view(np.int64)


#: Written attributes that stay beside the vectors, for the check of what was found.
WRITTEN = ["name", "nid", "dob", "mail"]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            vectors = [pa.array(_vector(b.column(n), placed, i)) for i, (n, placed) in enumerate(ENCODED.items())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("src"), *vectors, *(b.column(n) for n in WRITTEN)], names=["id", "src", *ENCODED, *(f"t_{n}" for n in WRITTEN)])


def vectors(profiles: DataFrame) -> DataFrame:
    """(id, src, a 64-bit vector per attribute, t_ and the written attribute) of profiles with id; `word` is the longest word of the name."""
    ws = F.split("name", " ")
    longest = F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    rows = profiles.select("id", "src", "name", F.when(F.length(longest) >= 5, longest).alias("word"), "nid", "dob", "mail", "phone", "addr")
    return rows.mapInArrow(_encode, "id bigint, src string, " + ", ".join([f"{n} bigint" for n in ENCODED] + [f"t_{n} string" for n in WRITTEN]))


def _pieces(c: Column) -> list[Column]:
    """The RADIUS + 1 pieces of a 64-bit vector."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]


def _attribute(n: str, side: str = "") -> Column:
    c = F.col(f"{side}{n}")
    return F.when(c != 0, c).otherwise(F.col(f"{side}name")) if n == "word" else c


def _folded(c: Column) -> Column:
    """The parities of every FOLD-th bit. Folded vectors differ in no more bits than the vectors themselves."""
    out = c
    for by in range(FOLD, 64, FOLD):
        out = out.bitwiseXOR(F.shiftrightunsigned(c, by))
    return out.bitwiseAND(F.lit((1 << FOLD) - 1))


def _keys() -> list[Column]:
    """Every bucket of a record, null where an attribute is missing: 64 - FOLD bits of the bucket, then the folded near vector."""
    out = []
    packed = lambda bucket, fold: F.shiftleft(bucket, FOLD).bitwiseOR(fold)
    for s in WHOLE:
        there = F.least(*[F.when(F.col(n) != 0, 1).otherwise(0) for n in s], F.lit(1)) == 1
        out.append(F.when(there, packed(F.xxhash64(F.lit(len(out)), *[F.col(n) for n in s]), F.lit(0).cast("bigint"))))
    for near, equal in VIEWS:
        there = (F.col(near) != 0) & (_attribute(equal) != 0)
        for piece in _pieces(F.col(near)):
            out.append(F.when(there, packed(F.xxhash64(F.lit(len(out)), _attribute(equal), piece), _folded(F.col(near)))))
    return out


def candidates(encoded: DataFrame) -> DataFrame:
    """(a, b): pairs of different sources, a < b, that share a bucket and whose folded vectors are within the radius."""
    long = encoded.select("id", F.xxhash64("src").alias("src"), F.explode(F.array_compact(F.array(*_keys()))).alias("key"))
    # both sides are written alike, so that one exchange serves both
    side = lambda p: long.select(F.col("id").alias(p), F.col("src").alias(f"{p}_src"), F.col("key").alias(f"{p}_key"))
    met = side("a").join(side("b"), F.shiftrightunsigned("a_key", FOLD) == F.shiftrightunsigned("b_key", FOLD)).where("a_src != b_src and a < b")
    fold = F.col("a_key").bitwiseXOR(F.col("b_key")).bitwiseAND(F.lit((1 << FOLD) - 1))
    return met.where(F.bit_count(fold) <= RADIUS).select("a", "b").distinct()


def _found() -> Column:
    """Whether a pair is equal in one of WHOLE or within RADIUS in one of VIEWS."""
    same = lambda n: (_attribute(n, "a_") == _attribute(n, "b_")) & (_attribute(n, "a_") != 0)
    exact = lambda n: (F.col(f"a_{n}") == F.col(f"b_{n}")) & (F.col(f"a_{n}") != 0)
    within = lambda n: (F.col(f"a_{n}") != 0) & (F.col(f"b_{n}") != 0) & (F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) <= RADIUS)
    out = F.lit(False)
    for s in WHOLE:
        out = out | (exact(s[0]) if len(s) == 1 else exact(s[0]) & exact(s[1]))
    for near, equal in VIEWS:
        out = out | within(near) & same(equal)
    return out


def dice(a: Column, b: Column) -> Column:
    """Dice's coefficient of two bit vectors, null if either is empty."""
    return F.when((a != 0) & (b != 0), 2.0 * F.bit_count(a.bitwiseAND(b)) / (F.bit_count(a) + F.bit_count(b)))


def scored(pairs: DataFrame, encoded: DataFrame) -> DataFrame:
    """(a, b, bin, cat, veto) of the found ones of `pairs`: bin of the score of the attributes other than the identifier, and how the
    identifiers agree (0 one is missing, 1 the same, 2 nearly, 3 different), and whether what is written contradicts."""
    side = lambda p: encoded.select(F.col("id").alias(p), *[F.col(n).alias(f"{p}_{n}") for n in [*ENCODED, *(f"t_{n}" for n in WRITTEN)]])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_found())
    both = both.select("a", "b", person.contradict("a_t_", "b_t_").alias("veto"), *[dice(F.col(f"a_{n}"), F.col(f"b_{n}")).alias(n) for n in ["nid", *WEIGHTS]])
    top = sum(F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in WEIGHTS.items())
    bottom = sum(F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in WEIGHTS.items())
    score = (top + 0.5 * SHRINK) / (bottom + SHRINK)
    cat = F.when(F.col("nid").isNull(), 0).when(F.col("nid") >= SAME, 1).when(F.col("nid") >= NEARLY, 2).otherwise(3)
    return both.select("a", "b", F.least(F.floor(score * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), cat.alias("cat"), "veto")


def _monotone(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing rates (pooled adjacent violators)."""
    blocks: list[list[float]] = []
    for r, w in zip(rate, weight):
        blocks.append([r * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            s, w_, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w_, blocks[-1][2] + c]
    return np.array([s / w for s, w, c in blocks for _ in range(c)])


def calibration(counts: np.ndarray) -> np.ndarray:
    """Chance of one entity for every (bin, cat), from how many found pairs each holds.

    Two classes, in which score and identifier are independent given the class; the first guess is that same and nearly the
    same identifiers mean one entity and different ones don't.
    """
    n = counts.astype(float)
    guess = np.array([0.5, 0.98, 0.9, 0.05])
    seen = n[:, 1:].sum(axis=1)
    by_bin = (n[:, 1:] @ guess[1:] + 0.5 * np.linspace(0, 1, BINS)) / (seen + 0.5)
    chance = np.tile(guess, (BINS, 1))
    chance[:, 0] = _monotone(by_bin, seen + 0.5)
    for _ in range(ROUNDS):
        yes, no = n * chance, n * (1 - chance)
        # identifiers, by class; a missing one says nothing
        ids = [(x[:, 1:].sum(axis=0) + 0.5) / (x[:, 1:].sum() + 1.5) for x in (yes, no)]
        odds_id = np.concatenate([[0.0], np.log(ids[0] / ids[1])])
        rate = (yes.sum(axis=1) + 0.5 * np.linspace(0, 1, BINS)) / (n.sum(axis=1) + 0.5)
        rate = np.clip(_monotone(rate, n.sum(axis=1) + 0.5), 1e-4, 1 - 1e-4)
        chance = 1 / (1 + np.exp(-(np.log(rate / (1 - rate))[:, None] + odds_id[None, :])))
    return chance


def confidences(encoded: DataFrame) -> DataFrame:
    """(a, b, confidence, veto) of all found pairs of vectors(), which are read twice."""
    scratch = Scratch(encoded.sparkSession, "matching")
    pairs = scratch.put(scored(candidates(encoded), encoded))
    counts = np.zeros((BINS, 4))
    for r in pairs.groupBy("bin", "cat").count().collect():  # at most BINS * 4 rows
        counts[r["bin"], r["cat"]] = r["count"]
    table = F.array(*[F.lit(float(c)) for c in calibration(counts).ravel()])
    return pairs.select("a", "b", F.get(table, F.col("bin") * 4 + F.col("cat")).alias("confidence"), "veto")


def matches(profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, confidence): pairs of records at or above `least`, ids as in profiles (id, src, fields).

    An exact check follows the confidence: pairs whose written names or dates contradict are left out.
    """
    scratch = Scratch(profiles.sparkSession, "entities")
    fields = ["name", "nid", "dob", "mail", "phone", "addr"]
    content = [F.struct(F.col(f).isNull(), F.col(f)) for f in fields]
    keyed = profiles.withColumns({"d1": F.xxhash64("src", *content), "d2": F.xxhash64(F.lit(1), *content[::-1], "src")})  # 128 bits are the identity of a class
    classes = scratch.put(keyed.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("src").alias("src"), *[F.first(f).alias(f) for f in fields]))
    # classes of several records are expanded at the end
    several = scratch.put(classes.where("n > 1").select("d1", "d2", F.col("id").alias("class")))
    members = scratch.put(keyed.select("id", "d1", "d2").join(several, ["d1", "d2"]).select("class", "id"))
    encoded = scratch.put(vectors(classes))
    scratch.drop(classes, several)
    found = scratch.put(confidences(encoded).where((F.col("confidence") >= least) & ~F.col("veto")).drop("veto"))
    scratch.drop(encoded)
    for p in "ab":
        more = members.select(F.col("class").alias(p), F.col("id").alias("__id"))
        found = found.join(more, p, "left").withColumn(p, F.coalesce("__id", p)).drop("__id")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence")
