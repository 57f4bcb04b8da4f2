"""op2, op8, op5: against brute force, held-out accuracy and a unigram model."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from wavepanel.llm import common, masked_lm, minhash, quality, queries

from .conftest import EDGE

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_classes(rows, threshold=0.8, k=5):
    bags = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        if w:
            bags[d] = Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))
    holders = defaultdict(list)
    for d, b in bags.items():
        for g in b:
            holders[g].append(d)
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in {(x, y) for h in holders.values() for x in h for y in h if x < y}:
        both = sum(min(v, bags[b].get(g, 0)) for g, v in bags[a].items())
        if both >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - both) - 1e-9:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {d: root(d) for d, _ in rows}


def variants(n, seed=3):
    """A chain of edits of one text, a hub of near copies, and texts that share a passage only."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(200)]
    rows, cur = [], list(base)
    for i in range(n):
        cur = list(cur)
        cur[rnd.randrange(len(cur))] = f"x{i}"
        rows.append((i, " ".join(cur)))
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(len(copy))] = f"y{i}"
        rows.append((1000 + i, " ".join(copy)))
    passage = " ".join(base[:60])
    rows += [(2000 + i, passage + " " + " ".join(f"z{i}_{j}" for j in range(rnd.choice([10, 30, 60])))) for i in range(n)]
    rows += [(3000 + i, "again " * rnd.randint(5, 40)) for i in range(n)]       # weights decide
    return rows


def spread(n, seed=8):
    """A large group whose similarities run from 0.25 to 0.97 without a gap, around three drifting centres."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(160)]
    rows = []
    for i in range(n):
        copy = list(base)
        for k in range(rnd.choice([1, 2, 3, 5, 8, 12, 20, 30])):
            copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(3) if i % 2 else i}_{rnd.randrange(40)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("which", ["table", "variants", "spread"])
def test_classes_match_brute_force(spark, make, which):
    rows = {"variants": lambda: variants(40), "spread": lambda: spread(260),
            "table": lambda: [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]}[which]()
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == brute_classes(rows)


def test_signature_is_unbiased():
    rnd, errors = random.Random(3), []
    for t in range(150):
        n = rnd.choice([1, 3, 10, 200])
        a = Counter({f"w{rnd.randint(0, n)}": rnd.randint(1, rnd.choice([1, 2, 9, 40])) for _ in range(n)})
        b = a.copy()
        for _ in range(max(1, n // 4)):
            b[f"w{rnd.randint(0, 2 * n)}"] += rnd.randint(1, 5)
        j = sum((a & b).values()) / sum((a | b).values())
        bits = lambda w: np.uint64(zlib.crc32(f"{t}{w}".encode()) << 31 | zlib.crc32(f"{w}{t}".encode()))
        gram = np.array([bits(w) for w in a] + [bits(w) for w in b], np.uint64)
        sig = minhash.signatures(gram, np.array([*a.values(), *b.values()]), np.array([0] * len(a) + [1] * len(b)), 2, 1200)
        if 0 < j < 1:
            errors.append(((sig[0] == sig[1]).mean() - j) / (j * (1 - j) / 1200) ** 0.5)
    assert abs(np.mean(errors)) < 0.4 and np.std(errors) < 1.3


def test_dedup_edges(make):
    rows = EDGE + [(30, "one two"), (31, "one two"), (32, "one three")]
    got = minhash.op2_minhash(make(rows, ("rid", "node", "size", "bands", "class"))).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["class_id"], r["kept"]))
    assert by[1] == {(1, True)} and by[2] == {(2, True)} and by[6] == {(6, True)} and by[7] == {(6, False)}
    assert by[31] == {(30, False)} and by[32] == {(32, True)} and by[None] == {(None, True)}
    assert minhash.op2_minhash(make([])).collect() == []


def test_keep_one(make):
    docs = make(EDGE + [(40, "same same same")], ("rid", "__rid"))
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in out.collect())
    assert ids == sorted(["1", "2", "3", "4", "5", "6", "8", "9", "None", "None"])


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randint(5000, 5300), rnd.randint(5000, 5300)) for _ in range(200)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_quality_classifier"](spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    test = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert np.mean([a == b for a, b in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_edges(spark, make):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (8, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make(EDGE, ("x", "score", "quality", "held_out", "__text"))
    assert len(quality.op8_quality(docs, labels).collect()) == len(EDGE)
    none = quality.op8_quality(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {1}
    assert quality.op8_quality(make([]), labels).collect() == []
    assert quality.reject(make(EDGE), labels.limit(0)).count() == len(EDGE)


def test_statistics_are_finite_and_independent_of_the_batch():
    import pyarrow as pa
    from wavepanel.llm import textvec
    texts = ["", "a", "A B!! c\n\nd", "é漢 🙂", "x " * 500, "one\ntwo\none\n"]
    whole = [quality.statistics(d, o) for _, d, o in textvec.slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t")][0]
    assert np.isfinite(whole).all() and whole.shape == (len(texts), quality.FEATURES)
    for i, t in enumerate(texts):
        for _, d, o in textvec.slices(pa.RecordBatch.from_arrays([pa.array([t])], names=["t"]), "t"):
            assert np.allclose(quality.statistics(d, o)[0], whole[i])


# ---------------------------------------------------------------- masked language model

def test_lm_prefers_the_words_order(make):
    rnd = random.Random(1)
    follow = {w: [f"w{(w * 7 + k) % 40}" for k in range(2)] for w in range(40)}

    def text():
        w, out = rnd.randrange(40), []
        for _ in range(200):
            nxt = rnd.choice(follow[w])
            out.append(nxt)
            w = int(nxt[1:])
        return out
    rows = [(i, " ".join(text())) for i in range(300)]
    shuffled = []
    for i in range(30):
        words = rows[i][1].split()
        rnd.shuffle(words)
        shuffled.append((i, " ".join(words)))
    model = masked_lm.train(make(rows), rate=0.3)
    mean = lambda r: masked_lm.score(make(r), model).agg(F.avg("mean_log_prob")).first()[0]
    assert mean(rows[:30]) > mean(shuffled) + 0.3


def test_lm_sums_and_edges(make):
    rows = EDGE + [(60, "one two three")]
    got = masked_lm.op5_masked_lm(make(rows, ("n_words", "log_prob", "__text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["n_words"]:
            assert r["log_prob"] < 0 and abs(r["mean_log_prob"] - r["log_prob"] / r["n_words"]) < 1e-9
        else:
            assert r["log_prob"] == 0 and r["mean_log_prob"] is None
    assert masked_lm.op5_masked_lm(make([])).collect() == []


@pytest.mark.parametrize("head", [16, masked_lm.HEAD])
def test_lm_counts_words_exactly(make, head):
    """More words than buckets: a word's share of its class is its own, whatever shares its bucket or slot."""
    rows = [(i, " ".join(["often"] * 50 + [f"r{i}x{k}" for k in range(300)] + [f"t{k}" for k in range(i % 3)])) for i in range(40)]
    rows += [rows[0], (None, "often t0 unheard")]
    n = Counter(w for _, t in rows for w in t.split())
    assert len(n) > masked_lm.BUCKETS
    docs = make(rows)
    model, words = trained = masked_lm.train(docs, head=head)
    assert sorted(r["n"] for r in words.collect()) == sorted(n.values())
    for scored in (rows, rows + [(99, "never seen")]):
        got = {r["doc_id"]: r for r in masked_lm.score(make(scored), trained).collect()}
        for d, t in dict(scored).items():
            data, off = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])
            w, around, _ = masked_lm.windows(data, off, masked_lm.BUCKETS, model.heads)
            classes = masked_lm.Model(model.tables, model.out, model.class_of, np.zeros_like(model.log_share)).word_scores(w, around)
            of_class = Counter()
            for word, k in n.items():
                key = masked_lm.keys_of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0]
                of_class[int(model.class_of[masked_lm.symbols(key, model.heads)[0]])] += k
            want = classes.sum() + sum(np.log(n.get(x, 0.5) / max(of_class[int(model.class_of[c])], 1)) for x, c in zip(t.split(), w))
            assert abs(got[d]["log_prob"] - want) < 1e-6 * abs(want)
    assert masked_lm.score(docs, trained).count() == len(rows)


def test_lm_gradient():
    counts = np.ones(50)
    model = masked_lm.start(counts, 8, 4)
    model.tables = model.tables.astype(np.float64)
    model.out = model.out.astype(np.float64)
    rnd = np.random.default_rng(0)
    w, around = rnd.integers(0, 50, 64), rnd.integers(0, 50, (64, 4))
    loss = lambda: -(model.word_scores(w, around) - model.log_share[w]).mean()
    before = loss()
    t = masked_lm.Trainer(model, 1e-3)
    t.g_tables[:], t.g_out[:] = 1.0, 1.0            # nearly plain gradient steps
    t.m.tables, t.m.out = model.tables, model.out
    at = (1, int(around[0, 1]), 2)
    eps = 1e-5
    model.tables[at] += eps
    up = loss()
    model.tables[at] -= 2 * eps
    down = loss()
    model.tables[at] += eps
    old = model.tables[at]
    t.step(w, around)
    g = (up - down) / (2 * eps)
    assert loss() < before
    assert abs((old - model.tables[at]) / 1e-3 - g / np.sqrt(1 + g * g)) < 1e-4
