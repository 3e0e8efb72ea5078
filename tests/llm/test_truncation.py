"""The vectorised parts of the lost-end model against their plain statements."""

import random
import re

import numpy as np

from kinmesh.llm import truncation as t

CLOSE = "\"'»”’)\\]}“"
STOP = re.compile(rf"[{CLOSE}.!?…;。]*(?=\n|$)|[{CLOSE}]*[.!?…;。][{CLOSE}.!?…;。]*(?=\s)")
HEX = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{6,8}\b")


def plain(text):
    return re.sub(r"\d", "0", HEX.sub(lambda m: "0" * len(m[0]), text.lower()))


def texts():
    rng = random.Random(3)
    parts = ["abc", "deadbeef", "12ab34cd", "ab12", "1234567", "123456789", "\n", " ", ". ", '." ', "?!\n", ")", "(x) ", "é٣ ", "…", "x_1a2b3c ", "a1b2c3", "\n\n", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", ".", "\n", "a"]


def test_zeroed():
    ts = texts()
    codes, small, ends = t._codes(ts)
    got = t._zeroed(codes, small, ends)
    assert "".join(map(chr, got)) == "".join(plain(x) for x in ts)


def test_stopped():
    ts = texts()
    limited = np.array([i % 3 == 0 for i in range(len(ts))])
    _, small, ends = t._codes(ts)
    got = t._stopped(small, ends, limited)
    want = np.zeros(len(small), bool)
    for x, start, lim in zip(ts, np.concatenate([[0], ends[:-1]]), limited):
        x = x.lower()
        for m in STOP.finditer(x):
            if m.start() and not (lim and m.end() == len(x)):
                want[start + m.start() - 1] = True
    # what is stripped from ends is never looked up
    matters = np.array([chr(c) not in t._kinds()[-1] for c in small])
    assert (got == want)[matters].all()


def test_end_contexts_are_those_counted():
    """The contexts at the ends of texts are found by the counter that goes over whole texts, through a filter that lets all pass."""
    import pyarrow as pa

    ts = [x for x in texts() if x.strip()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ts)), pa.int64()), pa.array(ts), pa.array([1] * len(ts), pa.int32())], names=["key", "text", "own"])
    ends = {(k, h) for b in t._ends(iter([batch])) for k, h in zip(b.column("k").to_pylist(), b.column("h").to_pylist())}
    counted = pa.RecordBatch.from_arrays([pa.array(ts), pa.array([False] * len(ts))], names=["text", "limited"])
    n = {(k, h): c for b in t._counter(b"\xff" * (1 << (t.FILTER_BITS - 3)))(iter([counted])) for k, h, c in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), b.column("n").to_pylist())}
    assert ends and ends <= set(n)
    two = [plain(x).rstrip(t._kinds()[-1])[-2:] for x in ts]
    whole = "\x00".join(plain(x) for x in ts)
    one = next(x for x in two if len(x) == 2)
    h = next(h for k, h in ends if k == 2 and n[k, h] == sum(whole[i : i + 2] == one for i in range(len(whole))))
    assert h is not None
