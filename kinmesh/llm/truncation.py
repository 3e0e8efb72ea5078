"""Problem 10: texts that lost their end in a field of limited length or in transfer.

A backward character n-gram model: for each position of every text the last k characters (k in ORDERS) are counted with
whether a text or sentence may stop there. The final context of a text, looked up from short to long, gives the chance p
that a text stops after it; log(rate / p) weighs "cut at any position" against "ended here". To it come the log-odds of a
cut before the end is read, per source and language: at lengths that are far more frequent than their neighbours (field
limits, in characters or bytes) the surplus to begin with, elsewhere a small rate; both are then estimated over all texts. A text counts as
cut where the sum is positive. JSON texts are decided by their syntax.

Scale: counting is one Arrow pass with vectorised hashes, combined per batch before the shuffle; contexts travel as 64-bit
hashes. Nothing is sampled; statistics of lengths are one row per source and length.

Defined edge cases: null, empty and blank texts are no cases; texts of any length count whole; a context never seen falls
back to shorter ones; a text never supports itself (its own end is left out of the counts), nor do the ends of texts at a limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.storage import Scratch

ORDERS = (2, 3, 4, 6, 8, 12, 17)
CHUNK = 1_000_000
SMOOTH = 2.0
FIRST_RATE, LEAST_RATE, MOST_RATE, ROUNDS = 0.03, 0.005, 0.2, 3
OPEN_END = 5.0
#: A length is a limit if at least LIMIT_ROWS texts have it and more than LIMIT_RATIO times the mean of its neighbours.
LIMIT_ROWS, LIMIT_RATIO, LIMIT_SHARE, NEIGHBOURS = 6, 3.0, 0.001, 15

_CLOSE = "\"'»”’)]}“"
_STOPS = ".!?…;。"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter of looked-up contexts: 8 MB however many texts there are. A full filter lets every context pass.
FILTER_BITS = 26
_REACH = 64


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """By code (what lies beyond the basic plane is none of these): word, decimal, white, closing, stopping; what is stripped from ends."""
    chars = [chr(i) for i in range(0x10000)]
    table = lambda f: np.array([f(c) for c in chars], bool)
    white = table(str.isspace)
    stripped = "".join(c for c, w in zip(chars, white) if w) + _CLOSE + _STOPS
    return table(lambda c: c.isalnum() or c == "_"), table(str.isdecimal), white, table(lambda c: c in _CLOSE), table(lambda c: c in _STOPS), stripped


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, clipped, ends): lower case texts on end; clipped codes index the tables of _kinds(), ends are the places behind each text."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).copy()
    ends = np.cumsum([len(t) for t in texts])
    return codes, np.where(codes < 0x10000, codes, 0xE000), ends


def _zeroed(codes: np.ndarray, small: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes with every digit, and every character of a hexadecimal name of six to eight characters, as 0."""
    word, decimal, *_ = _kinds()
    w, border = word[small], np.zeros(len(codes) + 1, bool)
    border[0] = True
    border[ends] = True
    before, after = np.concatenate([[False], w[:-1]]), np.concatenate([w[1:], [False]])
    starts = np.flatnonzero(w & (~before | border[:-1]))
    stops = np.flatnonzero(w & (~after | border[1:])) + 1
    size = stops - starts
    some = (size >= 6) & (size <= 8)
    starts, stops, size = starts[some], stops[some], size[some]
    digit = (codes >= 48) & (codes <= 57)
    held = lambda x: np.concatenate([[0], np.cumsum(x)])
    hexes, digits = held(digit | (codes >= 97) & (codes <= 102)), held(digit)
    named = (hexes[stops] - hexes[starts] == size) & (digits[stops] > digits[starts])
    codes = np.where(decimal[small], 48, codes)
    for k in range(8):
        codes[starts[named & (size > k)] + k] = 48
    return codes


def _stopped(small: np.ndarray, ends: np.ndarray, limited: np.ndarray) -> np.ndarray:
    """Whether a text or sentence may stop behind each place: before a line end, or closing marks and a stop before white space.

    The very ends of limited texts are none.
    """
    _, _, white, closing, stopping, _ = _kinds()
    out, size = np.zeros(len(small), bool), len(small)
    starts = np.concatenate([[0], ends[:-1]])
    last, first = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    last[ends] = first[starts] = True
    free = np.zeros(size + 1, bool)  # ends of texts that are no evidence
    free[ends[limited]] = True
    line = small == 10
    out[np.flatnonzero(line & ~first[:-1]) - 1] = True
    out[ends[~limited & (ends > starts)] - 1] = True
    stop = stopping[small]
    run = stop | closing[small]
    before, after = np.concatenate([[False], run[:-1]]), np.concatenate([run[1:], [False]])
    s = np.flatnonzero(run & (~before | first[:-1]))
    e = np.flatnonzero(run & (~after | last[1:])) + 1
    stops = np.concatenate([[0], np.cumsum(stop)])
    at_end = last[e]
    following = np.append(small, 10)[e]
    good = np.where(at_end, ~free[e], (following == 10) | white[following] & (stops[e] > stops[s]))
    out[s[good & ~first[s]] - 1] = True
    return out


def _hashes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hash of the k characters that end at each position); the first k - 1 positions are meaningless."""
    codes = codes.astype(np.uint64) + np.uint64(1)
    total, power = np.zeros(codes.shape, np.uint64), np.uint64(1)
    for k in range(1, max(ORDERS) + 1):
        if k <= codes.shape[-1]:
            total[..., k - 1 :] += codes[..., : codes.shape[-1] - k + 1] * power
        power *= _MULTIPLIER
        if k in ORDERS:
            mixed = total ^ (total >> np.uint64(29))
            yield k, (mixed * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(k)


def _chunks(texts: list[tuple[str, bool]]) -> Iterator[list[tuple[str, bool]]]:
    """Texts in lists of about CHUNK characters, none of them cut, so that a task's arrays stay small."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t[0])
        if size >= CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def _counter(wanted: bytes):
    """Counts the contexts that pass the filter `wanted`, a bit for each value of the first FILTER_BITS of a hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, h, n, b): contexts of a chunk with how often they occur and how often a stop follows; k = 0 has all positions."""
        bits = np.frombuffer(wanted, np.uint8)
        row = lambda k, h, n, b: pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["k", "h", "n", "b"])
        with np.errstate(over="ignore"):
            for batch in batches:
                for pairs in _chunks(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))):
                    codes, small, ends = _codes([t for t, _ in pairs])
                    stop = _stopped(small, ends, np.array([x for _, x in pairs], bool))
                    sizes = np.diff(np.concatenate([[0], ends]))
                    inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
                    yield row([0], [0], [len(stop)], [int(stop.sum())])
                    for k, h in _hashes(_zeroed(codes, small, ends)):
                        at = h >> np.uint64(64 - FILTER_BITS)
                        hit = (inside >= k - 1) & ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                        which, found = pd.factorize(h[hit].view(np.int64))
                        yield row(np.full(len(found), k, np.int32), found, np.bincount(which, minlength=len(found)), np.bincount(which, stop[hit], minlength=len(found)).astype(np.int64))

    return count


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, own, k, h): the contexts at the end of each text, closing marks and white space left out."""
    stripped, width = _kinds()[-1], max(ORDERS)
    with np.errstate(over="ignore"):
        for batch in batches:
            # a name that is cut by the reach is longer than any hexadecimal one
            tails = [t.rstrip(stripped)[-_REACH:] for t in batch.column(1).to_pylist()]
            codes, small, ends = _codes(tails)
            if not len(codes):
                continue
            zeroed = np.concatenate([np.zeros(width, np.uint32), _zeroed(codes, small, ends)])
            last = zeroed[ends[:, None] + np.arange(width)]
            sizes = np.diff(np.concatenate([[0], ends]))
            keys, own = batch.column(0), batch.column(2)
            for k, h in _hashes(last):
                some = np.flatnonzero(sizes >= k)
                picked = pa.array(some)
                yield pa.RecordBatch.from_arrays([keys.take(picked), own.take(picked), pa.array(np.full(len(some), k, np.int32)), pa.array(h[some, -1].view(np.int64))], names=["key", "own", "k", "h"])


def limits(sized: DataFrame, size: str) -> DataFrame:
    """(source, size, surplus): the share of texts of that length that the length's neighbours don't explain.

    A limit holds at least LIMIT_SHARE of its source's texts, so there are at most 1 / LIMIT_SHARE rows per source.
    """
    seen = sized.groupBy("source", F.col(size).alias("size")).agg(F.sum("n").alias("n"))
    total = seen.groupBy("source").agg(F.sum("n").alias("total"))
    shifts = F.array(*[F.lit(i) for i in range(-NEIGHBOURS, NEIGHBOURS + 1) if i])
    around = seen.select("source", F.explode(F.transform(shifts, lambda i: F.col("size") + i)).alias("size"), "n").groupBy("source", "size").agg((F.sum("n") / (2 * NEIGHBOURS)).alias("mean"))
    both = seen.join(around, ["source", "size"], "left").join(total, "source").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    both = both.where((F.col("n") >= LIMIT_ROWS) & (F.col("n") > LIMIT_RATIO * F.col("mean")) & (F.col("n") >= LIMIT_SHARE * F.col("total")))
    return both.select("source", F.col("size").alias(size), ((F.col("n") - F.col("mean")) / F.col("n")).alias(f"by_{size}"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(0.995))
    return F.log(p / (1 - p))


def evidence(documents: DataFrame) -> DataFrame:
    """(key, source, lang, p, rate, surplus, syntax) of each text that isn't blank, from (key, text, source, lang)."""
    scratch = Scratch(documents.sparkSession, "ends")
    docs = documents.where("trim(text) != ''").withColumns({"chars": F.length("text"), "bytes": F.octet_length("text")})
    lengths = scratch.put(docs.groupBy("source", "chars", "bytes").agg(F.count(F.lit(1)).alias("n")))
    for size in ("chars", "bytes"):
        docs = docs.join(scratch.put(limits(lengths, size)), ["source", size], "left")  # a written table, so joined by its true size
    docs = docs.withColumn("surplus", F.greatest("by_chars", "by_bytes"))
    # ends at a limit are no evidence that texts stop there
    wanted = scratch.put(docs.select("key", "text", F.when(F.col("surplus").isNull(), 1).otherwise(0)).mapInArrow(_ends, "key bigint, own int, k int, h bigint"))
    counted = docs.select("text", F.col("surplus").isNotNull()).mapInArrow(_counter(_filter(wanted)), "k int, h bigint, n bigint, b bigint").groupBy("k", "h").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    table = scratch.put(counted)
    total = table.where("k = 0").agg((F.sum("b") / F.sum("n")).alias("rate"))
    # own end left out; from the shortest context to the longest
    less = {"n": F.col("n") - 1, "b": F.greatest(F.least(F.col("b") - F.col("own"), F.col("n") - 1), F.lit(0))}
    voted = wanted.join(table, ["k", "h"]).groupBy("key").agg(*[F.max(F.when(F.col("k") == k, less[c])).alias(f"{c}{k}") for k in ORDERS for c in "nb"])
    p = F.col("rate")
    steps = voted.crossJoin(F.broadcast(total))  # one row
    for k in ORDERS:
        steps = steps.withColumn("p", p if k == ORDERS[0] else F.col("p"))
        steps = steps.withColumn("p", F.when(F.col(f"n{k}").isNull(), F.col("p")).otherwise((F.col(f"b{k}") + SMOOTH * F.col("p")) / (F.col(f"n{k}") + SMOOTH)))
    sized = docs.select("key", "source", "lang", "chars", "bytes", "by_chars", "by_bytes", "surplus", (F.col("surplus").isNotNull() & F.col("text").rlike(r"[ \t]$")).alias("open"), F.when(F.trim("text").rlike(r"^[{\[]\s*[\"{\[]"), F.expr("try_parse_json(text) is null")).alias("syntax"))
    return sized.join(steps.select("key", "p", "rate"), "key", "left")


def _filter(wanted: DataFrame) -> bytes:
    """A bit for the first FILTER_BITS bits of each looked-up hash; at most 2 ** (FILTER_BITS - 6) words reach the driver."""
    at = wanted.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out.tobytes()


def cut(documents: DataFrame) -> DataFrame:
    """(key, source, lang, log_odds, cut) of each text that isn't blank.

    The share of cut texts is estimated per limit and per source and language by ROUNDS steps of expectation maximisation,
    from the surplus of a limit or FIRST_RATE; a frequent length whose texts end well so loses its suspicion.
    """
    scratch = Scratch(documents.sparkSession, "evidence")
    e = scratch.put(evidence(documents))
    # a text that fills its field and ends in a blank goes on
    weight = F.log(F.coalesce(F.col("rate") / F.greatest("p", F.lit(1e-9)), F.lit(1.0))) + F.when(F.col("open"), OPEN_END).otherwise(0.0)
    limit = F.when(F.coalesce(F.col("by_chars") >= F.col("by_bytes"), F.col("by_chars").isNotNull()), F.concat_ws(":", F.lit("c"), "chars", "source")).otherwise(F.concat_ws(":", F.lit("b"), "bytes", "source"))
    group = F.when(F.col("surplus").isNull(), F.concat_ws(":", F.lit("l"), F.coalesce("lang", F.lit("")), "source")).otherwise(limit)
    rows = e.select("key", "source", "lang", "syntax", F.col("surplus").isNotNull().alias("limited"), weight.alias("weight"), group.alias("group"))
    first = F.coalesce(F.max("surplus"), F.lit(FIRST_RATE))
    share = e.select(group.alias("group"), "surplus").groupBy("group").agg(first.alias("share"))
    for _ in range(ROUNDS):
        chance = F.lit(1) / (1 + F.exp(-(F.col("weight") + _logit(F.col("share")))))
        share = rows.where("syntax is null").join(share, "group").groupBy("group").agg(F.avg(chance).alias("m"), F.max("limited").alias("limited"))
        share = share.select("group", F.when(F.col("limited"), F.col("m")).otherwise(F.least(F.greatest("m", F.lit(LEAST_RATE)), F.lit(MOST_RATE))).alias("share"))
        share = scratch.put(share)
    odds = F.when(F.col("syntax"), 99.0).when(~F.col("syntax"), -99.0).otherwise(F.col("weight") + _logit(F.coalesce("share", F.lit(FIRST_RATE))))
    return rows.join(share, "group", "left").select("key", "source", "lang", odds.alias("log_odds"), (odds > 0).alias("cut"))
