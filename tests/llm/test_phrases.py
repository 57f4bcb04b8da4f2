"""op12: the parse against a plain-Python one, likenesses against exact sets, the query against a plain loop."""

import hashlib
import random

import numpy as np

from wavepanel.llm import phrases, queries, textvec as tv

from .conftest import EDGE

SF = "/root/testdata/sf0.001"
K = max(phrases.LEVELS) + 1


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def toss(x):
    out = []
    for i, v in enumerate(x):
        low = 0
        if i:
            while not ((v ^ x[i - 1]) >> low) & 1:
                low += 1
        out.append(2 * low + ((v >> low) & 1))
    return out


def plain_cut(symbols, tosses):
    """Phrases of one document's level: the symbols of each, equal neighbours as (symbol, number)."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    y = [s for s, _ in runs]
    for _ in range(tosses):
        y = toss(y)
    assert max(y, default=0) < 6
    for label in (5, 4, 3):
        y = [min({0, 1, 2} - {y[j] for j in (i - 1, i + 1) if 0 <= j < len(y)}) if v == label else v for i, v in enumerate(y)]
    assert all(a != b for a, b in zip(y, y[1:])) and set(y) <= {0, 1, 2}
    starts = [i for i in range(len(y)) if i == 0 or (i + 1 < len(y) and y[i - 1] < y[i] > y[i + 1])]
    return [tuple(map(tuple, runs[a:b])) for a, b in zip(starts, starts[1:] + [len(y)])]


TEXTS = ["", "a", "ab", "aaaaaaa", "abababababab", "the quick brown fox jumps over the lazy dog " * 3, "漢字 wörld 🙂 漢字 wörld",
         *["".join(random.Random(s).choice("ab cdé") for _ in range(s * 9)) for s in range(1, 12)]]


def test_phrases_match_plain_parse():
    """Same cuts on every level, and names that are equal exactly where the phrases are."""
    data, off = flat(TEXTS)
    levels = phrases.phrase_levels(data, off, K)
    symbols = [list(t.encode()) for t in TEXTS]
    for k, (names, at) in enumerate(levels):
        meaning = {}
        after = []
        for d, own in enumerate(symbols):
            cut = plain_cut(own, 3 if k == 0 else 4)
            got = names[at[d]:at[d + 1]].tolist()
            assert len(got) == len(cut)
            for phrase, name in zip(cut, got):
                assert meaning.setdefault(phrase, name) == name
            after.append(got)
        assert len(set(meaning.values())) == len(meaning)
        symbols = after


def test_equal_substrings_share_interior_names():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij ") for _ in range(2000))
    common = word()
    for shift in range(1, 12):
        data, off = flat([word()[:shift * 13] + common + word()[:50], common])
        for names, at in phrases.phrase_levels(data, off, K):
            own = names[at[1]:at[2]].tolist()
            other = set(names[at[0]:at[1]].tolist())
            missing = [i for i, n in enumerate(own) if n not in other]
            assert all(i < 8 or i >= len(own) - 8 for i in missing), missing


def exact(a, b):
    """Dice from the exact sets of names of the sketched levels."""
    data, off = flat([a, b])
    levels = phrases.phrase_levels(data, off, K)
    one, two = ({(k, n) for k in phrases.LEVELS for n in levels[k][0][levels[k][1][d]:levels[k][1][d + 1]].tolist()} for d in (0, 1))
    j = len(one & two) / len(one | two)
    return 2 * j / (1 + j)


def test_sketches_estimate_exact_likeness():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    off_by = []
    for share in (0, 0.2, 0.5, 0.8, 0.95, 1):
        for n in (60, 400, 3000):
            a = [r.choice(words) for _ in range(n)]
            b = a[:int(n * share)] + [r.choice(words) for _ in range(n - int(n * share))]
            a, b = " ".join(a), " ".join(b)
            s = phrases.sketches(*flat([a, b]))
            off_by.append(phrases.likeness(s[0], s[1]) - exact(a, b))
    assert max(map(abs, off_by)) < 0.2 and abs(np.mean(off_by)) < 0.04


def plain_rows(docs):
    """(doc_id, n_chars, edited sha, edited text, next text), in descending order."""
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    return out


def check(rows, docs):
    """Every column, each fingerprint made from a single text."""
    one = lambda t: phrases.sketches(*flat([t]))[0]
    want = sorted(((d, n, sha, one(t).tobytes().hex(), one(e).tobytes().hex(), round(float(phrases.likeness(one(t), one(e))), 12),
                    round(float(phrases.likeness(one(t), one(a))), 12)) for d, n, sha, t, e, a in plain_rows(docs)), key=str)
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 12),
                   round(r["near_next"], 12)) for r in rows), key=str)
    assert got == want


def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op12_document_fingerprints"](spark, SF).collect()
    check(rows, docs)
    long = [r for r in rows if r["n_chars"] >= 300]
    assert np.mean([r["near_edited"] for r in long]) > 0.55 and np.mean([r["near_next"] for r in long]) < 0.1
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.98


def test_query_on_edges(spark, make):
    base = [(i, t) for i, t in enumerate(t for _, t in EDGE if len(t or "") < 100_000)]
    clash = ("part", "role", "__text", "__hash", "__row", "next_text", "fingerprint")
    check(phrases.op12_fingerprints(make(base + [(None, "no id")], clash)).collect(), base + [(None, "no id")])
    check(phrases.op12_fingerprints(make([(3, "alone here")])).collect(), [(3, "alone here")])
    check(phrases.op12_fingerprints(make([(3, "a"), (4, None)])).collect(), [(3, "a"), (4, None)])
    same = [(9, "the same row again " * 20)] * 300 + [(8, "another")]
    check(phrases.op12_fingerprints(make(same).repartition(5)).collect(), same)
    assert phrases.op12_fingerprints(make([])).collect() == []


def test_rows_of_one_id_in_a_fixed_order(make):
    docs = [(5, f"text number {i} " * 9) for i in range(30)] + [(7, "first"), (1, "last")]
    key = lambda rows: sorted(map(str, rows))
    a = phrases.op12_fingerprints(make(docs)).collect()
    b = phrases.op12_fingerprints(make(docs[::-1]).repartition(4)).collect()
    assert len(a) == len(docs) and key(a) == key(b)


def test_fingerprints_alone(spark, make):
    from pyspark.sql import functions as F
    docs = make([*EDGE, (20, "some words here " * 30), (21, "some words here " * 20 + "and others at the end")], ("n_chars_", "__text"))
    got = phrases.fingerprints(docs)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[6]) == 2 and by[6][0] == by[6][1] and by[6][0]["fingerprint"] == by[7][0]["fingerprint"]
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == "00" * phrases.SLOTS and by[1][0]["n_chars"] == 0
    pair = got.where("doc_id = 20").select(F.col("fingerprint").alias("a")).crossJoin(got.where("doc_id = 21").select(F.col("fingerprint").alias("b")))
    sql = pair.select(phrases.likeness_of(F.col("a"), F.col("b"))).first()[0]
    a, b = (np.frombuffer(bytes.fromhex(by[d][0]["fingerprint"]), np.uint8) for d in (20, 21))
    assert abs(sql - phrases.likeness(a, b)) < 1e-12
    assert phrases.fingerprints(make([])).collect() == []
