"""op1, op4, op9, op10: against brute force on small fixtures and the given tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from wavepanel.llm import idfiles, mixing, pieces, queries, substring, textvec
from tools.oracle_check import duck, same_rows

from .conftest import EDGE

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("size", "target", "rid", "block", "found", "ids", "start", "path", "__text", "_order")


def key(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


# ---------------------------------------------------------------- mixing

def test_mixing_matches_sql(spark):
    df = queries.QUERIES["op1_source_mixing"](spark, SF)
    cur = duck(SF).execute(queries.ORACLE["op1_source_mixing"])
    cols = [c[0] for c in cur.description]
    ok, diff = same_rows(df.columns, [tuple(r) for r in df.collect()], cols, cur.fetchall())
    assert ok, diff


def test_mixing_edges(make):
    rows = mixing.op1_mixing(make([(r[0], r[1], None if i % 3 == 0 else f"s{i % 3}") for i, r in enumerate(EDGE)], CLASH)).collect()
    assert len(rows) == len(EDGE)
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert sum(taken) == int(target)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    assert mixing.op1_mixing(make([])).collect() == []
    assert [r["target"] for r in mixing.op1_mixing(make([(1, None), (2, "")])).collect()] == [0.0, 0.0]


def test_water_filling_against_loop(spark):
    sizes = {f"s{i:02d}": n for i, n in enumerate([1000, 1, 40, 7, 300, 0, 55, 2])} | {None: 10}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    assert all(abs(got[s] - target[s]) < 1e-9 for s in order)


def test_demand_time_inverts_the_integral(spark):
    import pyspark.sql.functions as F
    for knots in mixing.SCHEDULES:
        df = spark.range(101).select((F.col("id") / 100).alias("q")).withColumn(
            "t", mixing.demand_time(F.col("q") * 50, F.lit(50.0), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in knots])))
        for r in df.collect():
            grid = np.linspace(0, r["t"], 4001)
            assert abs(np.trapezoid(np.interp(grid, *zip(*knots)), grid) - r["q"]) < 1e-6


def test_training_order(make):
    docs = make([(i, "w " * 20, f"s{i % 2}") for i in range(40)], ("position", "copies", "positions"))
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    assert len(got) == 60 and max(got.count(i) for i in set(got)) <= 2


# ---------------------------------------------------------------- token ids in Arrow files

def test_id_files_match_library(spark, make):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTES)
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (table, EDGE):
        got = key(tuple(r) for r in idfiles.op4_token_files(make(rows, CLASH), BYTES).collect())
        want, start = [], 0
        for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == key(want)
    assert idfiles.op4_token_files(make([]), BYTES).collect() == []


def test_id_files_have_fixed_size_sequences(spark, make, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = idfiles.write_ids(make([(i, "some words here " * (i % 50)) for i in range(200)]), BYTES, folder, length=64, group=4).collect()
    for m in manifest:
        with pa.memory_map(f"{m['path']}.ids.arrow") as src:
            table = pa.ipc.open_file(src).read_all()
            ids, mask = (table[c].combine_chunks() for c in ("ids", "mask"))
            assert ids.type == pa.list_(pa.uint16(), 64) and pa.compute.sum(mask.flatten()).as_py() == m["n_ids"]
    assert sum(m["n_docs"] for m in manifest) == 200


def test_pretokens_match_library():
    import random
    from tokenizers import Tokenizer
    tok, rnd = Tokenizer.from_file(BYTES), random.Random(2)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'", "''", " ", "  ", "\n", "\t", "a", "St", "é", "漢", "🙂", "1", "²", "!", "_", " ", "　", "\x85", "٣"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = []
    for _, data, off in textvec.slices(batch, "t"):
        ids, upto = idfiles.encode(data, off, BYTES)
        got += [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])]
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


# ---------------------------------------------------------------- SentencePiece

def library_rows(rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = []
    for d, t in rows:
        ids = sp.encode(t or "") + [2]
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return key(out)


def test_pieces_match_library(spark, make):
    import random
    rnd = random.Random(4)
    odd = [(100 + i, "".join(rnd.choice(" ab\n\t▁éñ漢🙂'.,-<s>") for _ in range(rnd.randint(0, 40)))) for i in range(1500)]
    odd += [(2000 + i, "".join(rnd.choice("abcdeghinorstt ") for _ in range(rnd.randint(0, 60)))) for i in range(1500)]
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (table, EDGE, odd):
        assert key(tuple(r) for r in pieces.op9_pieces(make(rows, CLASH), PIECES).collect()) == library_rows(rows)
    assert pieces.op9_pieces(make([]), PIECES).collect() == []


# ---------------------------------------------------------------- substring dedup

def brute_windows(rows, window=13):
    big = 1 << 63
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, big), big if d is None else d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (big if d is None else d):
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return key(out)


@pytest.mark.parametrize("block_bytes", [substring.BLOCK_BYTES, 20_000])
def test_substrings_match_brute_force(spark, make, block_bytes):
    import pyspark.sql.functions as F
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    line = " ".join(f"p{i}" for i in range(30))
    edges = EDGE + [(20 + i, f"u{i} v{i} " + line + f" z{i}") for i in range(60)] + [(90, line), (91, " ".join(line.split()[:12])), (92, " ".join(line.split()[5:18]))]
    for rows in (table, edges):
        out = substring.remove_repeats(make(rows, CLASH), block_bytes=block_bytes)
        got = [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()]
        assert key(got) == brute_windows(rows)
        assert all(sum(f["end"] - f["start"] for f in r["factors"]) == r["n_removed"] for r in out.collect())
    assert substring.op10_substrings(make([])).collect() == []


def test_query_over_the_table(spark):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    assert key(tuple(r) for r in queries.QUERIES["op10_substring_dedup"](spark, SF).collect()) == brute_windows(rows)
