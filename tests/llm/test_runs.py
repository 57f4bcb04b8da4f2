"""op11: against a quadratic search for runs in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wavepanel.llm import queries, runs

from .conftest import EDGE

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, min_length=6, min_exponent=4):
    """Every maximal stretch of every period; of one stretch the smallest period stays."""
    found, n = {}, len(w)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    got = plain_runs(w)
    dropped = {i for s, n, q in got for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = None
    for r in got:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(got), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in got)),
            sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def words_of(seed, n, letters):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        block = [r.choice(letters) for _ in range(r.randint(1, 9))]
        out += block * r.choice([1, 1, 2, 3, 4, 5, 8]) + block[:r.randint(0, len(block))]
    return out[:n]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


CASES = [words_of(s, 20 + s * 7 % 180, "ab" if s % 3 else "abcdef") for s in range(80)]
CASES += [["a"] * 50, ["a", "b"] * 40, fibonacci(400), [str(bin(i).count("1") % 2) for i in range(2100)],
          (["x"] * 7 + ["y"]) * 9, [], ["one"], ["a"] * 5, ["a"] * 6]


@pytest.mark.parametrize("length,exponent", [(6, 4), (2, 2), (9, 3)])
def test_runs_of_words(length, exponent):
    data = "\n".join(" ".join(c) for c in CASES).encode()
    sizes = [len(" ".join(c)) for c in CASES]
    off, at = [0], 0
    for n in sizes:
        at += n + 1
        off.append(at)
    raw = np.frombuffer(data + b"\n", np.uint8)
    per, start, size, q, out, edge = runs.slice_runs(raw, np.array(off), None, length, exponent)
    upto = np.concatenate([[0], np.cumsum(per)])
    for d, c in enumerate(CASES):
        got = list(zip(start[upto[d]:upto[d + 1]].tolist(), size[upto[d]:upto[d + 1]].tolist(), q[upto[d]:upto[d + 1]].tolist()))
        want = plain_runs(c, length, exponent)
        assert got == want, d
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert out[edge[d]:edge[d + 1]].tobytes().decode() == " ".join(x for i, x in enumerate(c) if i not in gone)


def test_long_runs_stay_fast():
    """A quarter of a million equal words, and as many with a period of 1,000."""
    n = 250_000
    for text, want in ((np.zeros(n, np.int32), (1, n, 1)), ((np.arange(n) % 1000).astype(np.int32), (1, n, 1000))):
        whole = np.concatenate([[5000], text, [5001]]).astype(np.int32)
        assert [tuple(int(x) for x in r) for r in zip(*runs.runs_of(whole))] == [want]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_on_edges(make):
    extra = [(i, " ".join(words_of(i, 150, "abc"))) for i in range(100, 260)]
    full = EDGE + extra + [(100, None), (101, extra[1][1])]
    got = rows(runs.op11_runs(make(full, ("runs", "start", "__text", "__seed", "best", "collapsed"))))
    short = [r for r in full if len(r[1] or "") < 100_000]
    assert [r for r in got if r[0] != 4] == sorted((plain_row(*r) for r in short), key=str)
    # 40,000 x "lorem ipsum": one run unless its id edits the text (it does not)
    assert [r[1:6] for r in got if r[0] == 4] == [(1, 0, 80_000, 2, 40_000_000)]
    assert rows(runs.op11_runs(make([]))) == []


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows(queries.QUERIES["op11_periodic_runs"](spark, SF)) == sorted((plain_row(*r) for r in docs), key=str)
