"""Near-duplicate documents: BagMinHash signatures, bands, exact verification.

A document is the multiset of its 5-word shingles; two documents are near
duplicates if their weighted Jaccard similarity (sum of minima over sum of
maxima of the counts) is at least 0.8.  Classes are the connected components of
the verified links.

Signature.  Counts are the discretised weights.  Each shingle owns one Poisson
process on every dyadic stretch (0,1], (1,2], (2,4], ... of the weight axis; a
process emits points in ascending time, each with a register and a place on its
stretch, all derived from the shingle's hash.  A point counts if its place lies
within the weight: the stretch that the weight cuts is the next level of the
hierarchy, resolved by the place alone.  A register keeps its smallest time, so
two registers agree with a probability equal to the weighted Jaccard
similarity.  Points of one process come in time order, so a process stops once
its time passes the document's largest register.

Search.  Documents with equal multisets are one node.  Nodes that agree on all
registers of a band meet in a bucket; with 32 bands of 5 registers a pair at
similarity 0.8 is missed with probability 3e-6 (less above).  A bucket of n
nodes gives n - 1 links to its smallest node, not all pairs; links are verified
on the multisets, the best link of each node first, others only while their ends
lie in different components.  The nodes of buckets that still hold several
components are then compared across components by an exact prefix filter: pairs
at the threshold share one of their rarest shingles, so a group of near copies
just below it yields few candidates, and no link between components is lost.  Multisets are read again from the texts of the nodes that have a
candidate, never kept for all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec as tv
from .common import components, fresh, row_key, stored

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 32, 5, 0.8
BITS, HEAD = 1024, 32          # of the bitmap of a node's tokens; of its first tokens that a row carries
SIGN_BYTES = 256 << 10        # text signed at a time: the points fit a core's cache
GOLD = np.uint64(0x9E3779B97F4A7C15)


def multisets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE):
    """(shingle, count, document), sorted by document and shingle; a text of 1 to
    k - 1 words is one shingle, one without words has none."""
    s, e, upto = tv.words(data, off)
    h = tv.span_hash(data, s, e)
    sizes = np.diff(upto)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(upto[1:][doc] - np.arange(len(h)) >= k)
    gram, owner = tv.gram_hash(h, at, k), doc[at]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        gram = np.append(gram, tv.rolling(h, upto[short], upto[short + 1], 0xD1342543DE82EF95 + 14))
        owner = np.append(owner, short)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return gram[first], np.diff(np.append(first, len(gram))), owner[first]


def fingerprints(gram, count, owner, docs: int) -> np.ndarray:
    """128 bits of each document's multiset, independent of order: (docs, 2)."""
    out = np.zeros((docs, 2), np.uint64)
    for k, salt in enumerate((0x51, 0xA7)):
        np.add.at(out[:, k], owner, tv.mix((gram ^ tv.mix(count.astype(np.uint64) + np.uint64(salt))) * GOLD + np.uint64(salt)))
    return out


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(gram, count, owner, docs: int, m: int) -> np.ndarray:
    """(docs, m): of each register, the bits of the point with the smallest time
    (0 for documents without shingles)."""
    sig, held = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    if not len(gram):
        return held.reshape(docs, m)
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    level = tv.spread(levels)
    key = tv.mix(np.repeat(gram, levels) + (level.astype(np.uint64) + np.uint64(1)) * GOLD)
    doc, weight = np.repeat(owner, levels), np.repeat(count, levels).astype(np.float64)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    length = np.where(level > 0, low, 1.0)
    size = np.bincount(doc, minlength=docs)
    time, step = np.zeros(len(key)), np.zeros(len(key), np.int64)
    points = np.ceil((np.log(m) + 2) * m / size[doc]).astype(np.int64)      # enough for most documents at once
    more = np.ceil(m / size[doc]).astype(np.int64)
    while len(key):
        p = np.repeat(np.arange(len(key)), points)
        j = (step[p] + tv.spread(points)).astype(np.uint64)
        bits = tv.mix(key[p] + (np.uint64(3) * j + np.uint64(1)) * GOLD)
        wait = -np.log(_uniform(bits)) / (m * length[p])
        run = np.cumsum(wait)
        first = np.cumsum(points) - points
        x = run - np.repeat(run[first] - wait[first], points) + time[p]
        register = (tv.mix(bits + GOLD) % np.uint64(m)).astype(np.int64)
        ok = np.ones(len(p), bool)
        cut = np.flatnonzero(low[p] > 0)
        ok[cut] = low[p[cut]] + length[p[cut]] * _uniform(tv.mix(bits[cut] ^ GOLD)) <= weight[p[cut]]
        at, x_ok = doc[p[ok]] * m + register[ok], x[ok]
        np.minimum.at(sig, at, x_ok)
        least = x_ok == sig[at]
        held[at[least]] = bits[ok][least]
        time, step = x[first + points - 1], step + points
        go = time < sig.reshape(docs, m).max(axis=1)[doc]
        key, doc, weight, low, length, time, step, more = (v[go] for v in (key, doc, weight, low, length, time, step, more))
        points = more
    return held.reshape(docs, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.reshape(len(sig), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (len(sig), 1))
    for k in range(rows):
        out = tv.mix(out * np.uint64(0xD1342543DE82EF95) + bits[:, :, k])
    return out


def _binary16(pairs: np.ndarray, valid: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(pairs).tobytes()
    return pa.array([raw[16 * k:16 * k + 16] if v else None for k, v in enumerate(valid.tolist())], pa.binary())


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, rid, node (the multiset's fingerprint; null without
    words), size (shingles, counted), bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, data, off in tv.slices(batch, "text", SIGN_BYTES):
                n = len(off) - 1
                gram, count, owner = multisets(data, off, k)
                size = np.bincount(owner, count, minlength=n).astype(np.int64)
                band = band_hashes(signatures(gram, count, owner, n, bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([rows_.column("doc_id"), rows_.column("rid"),
                                                  _binary16(fingerprints(gram, count, owner, n), size > 0), pa.array(size), lists],
                                                 names=["doc_id", "rid", "node", "size", "bands"])

    return docs.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, node binary, size long, bands array<long>")


def bags(docs: DataFrame, nodes: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The multisets of the nodes listed in `nodes` (node, rid): (node, size, grams, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in tv.slices(batch, "text"):
                n = len(off) - 1
                gram, count, owner = multisets(data, off, k)
                upto = np.searchsorted(owner, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [_binary16(fingerprints(gram, count, owner, n), np.diff(upto) > 0),
                     pa.array(np.bincount(owner, count, minlength=n).astype(np.int64)),
                     pa.array(tv.blobs(gram, upto), pa.binary()), pa.array(tv.blobs(count.astype(np.uint32), upto), pa.binary())],
                    names=["node", "size", "grams", "counts"])

    return (docs.select("rid", "text").join(nodes.select("rid").distinct(), "rid", "left_semi").select("text")
            .mapInArrow(run, "node binary, size long, grams binary, counts binary")
            .join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def tokens_of(grams: bytes, counts: bytes) -> np.ndarray:
    """A multiset as a set: a shingle with count c is c tokens."""
    count = np.frombuffer(counts, np.uint32).astype(np.int64)
    return tv.mix(np.repeat(np.frombuffer(grams, np.uint64), count) + tv.spread(count).astype(np.uint64) * GOLD)


def rare_prefixes(bag: DataFrame, threshold: float) -> DataFrame:
    """(node, token, rank, size): of every node the rarest tokens that any partner
    at the threshold must share one of, rarest first.

    A shingle with count c is c tokens.  With tokens in one global order (by the
    number of nodes that have them), two multisets with an overlap of at least o
    have their first common token at a rank of at most size - o + 1 in both; o is
    at least threshold * size.  Tokens of a single node are ranked, then dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, grams, counts in zip(batch["node"].to_pylist(), batch["grams"].to_pylist(), batch["counts"].to_pylist()):
                token = tokens_of(grams, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(token), pa.binary()), pa.array(token),
                                                  pa.array(np.full(len(token), len(token)))], names=["node", "token", "size"])

    tokens = bag.select("node", "grams", "counts").mapInArrow(run, "node binary, token long, size long")
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"))
    order = Window.partitionBy("node").orderBy("nodes", "token")              # the tokens of one text
    return (tokens.join(seen, "token").withColumn("rank", F.row_number().over(order))
            .where((F.col("nodes") > 1) & (F.col("rank") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1))
            .select("node", "token", "rank", "size"))


def token_bits(bag: DataFrame) -> DataFrame:
    """(node, w0, w1, ...): the set of a node's tokens as a bitmap of BITS hashed bits."""
    words = BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, words), np.uint64)
            for i, (grams, counts) in enumerate(zip(batch["grams"].to_pylist(), batch["counts"].to_pylist())):
                bit = tokens_of(grams, counts) % np.uint64(BITS)
                np.bitwise_or.at(out[i], (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64)))
            yield pa.RecordBatch.from_arrays([batch["node"], *[pa.array(np.ascontiguousarray(out[:, j]).view(np.int64)) for j in range(words)]],
                                             names=["node", *[f"w{j}" for j in range(words)]])

    return bag.select("node", "grams", "counts").mapInArrow(run, "node binary, " + ", ".join(f"w{j} long" for j in range(words)))


def prefix_pairs(prefixes: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a > b, of different components that can reach the threshold:
    they share a token within the rank that their sizes allow, and their bitmaps
    leave room for the overlap.

    Of the nodes with one token those of its largest component meet the others
    only, so a large group of near copies is not paired with itself.  Every bit
    in which two bitmaps differ stands for a token of one node alone, so the
    overlap is at most half of (both sizes - differing bits).  A pair is made at
    the first token it shares: each row carries the HEAD first tokens of its node
    that lie before its own, and a token that both carry has made the pair already.
    """
    most = (prefixes.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token")
            .agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    shared = stored(prefixes.join(most.drop("kinds"), "token"), "minhash-shared")
    head = shared.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "token"))), 1, HEAD).alias("head"))   # tokens of one text
    facts = head.join(token_bits(bag.join(head.select("node"), "node", "left_semi")), "node")
    rows = shared.join(facts, "node").withColumn("earlier", F.transform(F.filter("head", lambda h: h["rank"] < F.col("rank")), lambda h: h["token"]))
    words = [f"w{j}" for j in range(BITS // 64)]
    cols = lambda df, n, *more: df.select("token", F.col("node").alias(n), F.col("rank").alias(f"r{n}"), F.col("size").alias(f"s{n}"),
                                          F.col("component").alias(f"c{n}"), F.col("earlier").alias(f"e{n}"), *[F.col(w).alias(f"{n}{w}") for w in words], *more)
    rows = stored(rows.select("token", "node", "rank", "size", "component", "top", "earlier", *words), "minhash-shared-rows")
    need = F.ceil(threshold / (1 + threshold) * (F.col("sa") + F.col("sb")) - 1e-9)
    differ = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in words[1:]), F.bit_count(F.col("aw0").bitwiseXOR(F.col("bw0"))))
    # of two nodes that are both outside the largest component the larger one is on the left
    left = cols(rows.where(F.col("component") != F.col("top")), "a")
    return (left.join(cols(rows, "b", "top"), "token")
            .where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("top")) | (F.col("a") > F.col("b")))
                   & (F.col("ra") <= F.col("sa") - need + 1) & (F.col("rb") <= F.col("sb") - need + 1)
                   & (2 * need <= F.col("sa") + F.col("sb") - differ) & ~F.arrays_overlap("ea", "eb"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def overlap(a_grams: bytes, a_counts: bytes, b_grams: bytes, b_counts: bytes) -> int:
    """Sum of the smaller counts of two multisets (shingles sorted)."""
    a, b = np.frombuffer(a_grams, np.uint64), np.frombuffer(b_grams, np.uint64)
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    hit = a[at] == b
    return int(np.minimum(np.frombuffer(a_counts, np.uint32)[at[hit]], np.frombuffer(b_counts, np.uint32)[hit]).sum())


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, threshold: float, k: int, name: str) -> DataFrame:
    """The pairs (a, b) whose multisets reach the threshold.

    The multiset of a popular `b` is copied once per 256 of its partners, so no
    join key holds more than that many rows.
    """
    fan = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("copies"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    bag = stored(bags(docs, nodes.join(ends, "node", "left_semi"), k), f"{name}-bags")
    left = (pairs.join(fan, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
            .join(bag.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("grams").alias("a_grams"),
                             F.col("counts").alias("a_counts")), "a"))
    right = (bag.join(fan, bag["node"] == fan["b"])
             .select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("size").alias("b_size"),
                     F.col("grams").alias("b_grams"), F.col("counts").alias("b_counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch[c].to_pylist() for c in batch.schema.names}
            keep = []
            for i in range(batch.num_rows):
                both = overlap(cols["a_grams"][i], cols["a_counts"][i], cols["b_grams"][i], cols["b_counts"][i])
                keep.append(both >= threshold * (cols["a_size"][i] + cols["b_size"][i] - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(left.join(right, ["b", "salt"]).select("a", "b", "a_size", "a_grams", "a_counts", "b_size", "b_grams", "b_counts")
                  .mapInArrow(run, "a binary, b binary"), f"{name}-links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE,
                    text: str = "text") -> DataFrame:
    """One row per document: doc_id, rid (key of the row), class_id (smallest
    doc_id of its class), single (no words), kept (whether it is that document).

    Words are compared unchanged.  A document without words (null, empty, only
    spaces) is a class of its own.  A null doc_id is never a class id unless all
    of the class are null.  Equal rows share a class and are both kept if they
    are its smallest.  Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("rid", row_key())
    signed = stored(sign(docs, bands, rows, k), "minhash-signed")
    nodes = stored(signed.where("node is not null").groupBy("node")
                   .agg(F.min("rid").alias("rid"), F.first("size").alias("size"), F.first("bands").alias("bands")), "minhash-nodes")
    member = nodes.select("node", "size", F.explode("bands").alias("band"))
    centre = member.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stored(member.join(centre.drop("n"), "band"), "minhash-buckets")
    fits = lambda x, y: F.least(x, y) >= F.lit(threshold) * F.greatest(x, y) - F.lit(1e-9)  # noqa: E731  sizes rule a link out

    sizes = nodes.select(F.col("node").alias("centre"), F.col("size").alias("centre_size"))
    star = (member.where(F.col("node") != F.col("centre")).groupBy("node", "centre").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
            .join(sizes, "centre").where(fits(F.col("size"), F.col("centre_size")))
            .select(F.col("node").alias("a"), F.col("centre").alias("b"), "n"))
    star = stored(star, "minhash-star")
    best = star.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    links = verify(best, docs, nodes, threshold, k, "minhash-best")

    def labelled(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
        to = labels.select(F.col("node").alias(node), F.col("component").alias(f"_{out}"))
        return df.join(to, node, "left").withColumn(out, F.coalesce(f"_{out}", node)).drop(f"_{out}")

    labels = stored(components(links, name="minhash-cc"), "minhash-labels")
    rest = labelled(labelled(star.join(best, ["a", "b"], "left_anti"), labels, "a", "ca"), labels, "b", "cb").where("ca != cb")
    rest = stored(rest.select("a", "b"), "minhash-rest")
    if not rest.isEmpty():
        more = verify(rest, docs, nodes, threshold, k, "minhash-rest")
        links = links.union(more)
        labels = stored(components(links, name="minhash-cc2"), "minhash-labels2")

    # buckets that hold several components: pairs across them that have not been compared
    placed = labelled(member, labels, "node", "component")
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("band")
    placed = stored(placed.join(mixed, "band").select("node", "component").distinct(), "minhash-mixed")
    if not placed.isEmpty():
        bag = stored(bags(docs, nodes.join(placed.select("node"), "node", "left_semi"), k), "minhash-mixed-bags")
        prefixes = stored(rare_prefixes(bag, threshold).join(placed, "node"), "minhash-prefixes")
        cross = prefix_pairs(prefixes, bag, threshold).join(star.select("a", "b"), ["a", "b"], "left_anti")
        cross = stored(cross, "minhash-cross")
        if not cross.isEmpty():
            links = links.union(verify(cross, docs, nodes, threshold, k, "minhash-cross"))
            labels = stored(components(links, name="minhash-cc3"), "minhash-labels3")

    classes = labelled(signed.select("doc_id", "rid", "node"), labels, "node", "class")
    smallest = classes.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return (classes.join(smallest, "class", "left")
            .select("doc_id", "rid", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.col("node").isNull().alias("single"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))))


def op2_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one row of every class (smallest doc_id, then row key); all columns."""
    cols, rid = [F.col(f"`{c}`") for c in docs.columns], fresh(docs, "rid")
    classes = near_duplicates(docs, **options)
    # rows without words stand alone: their class is their own doc_id, told apart by the row key
    alone = F.when(F.col("class_id").isNull() | F.col("single"), F.col("rid"))
    chosen = classes.where("kept").groupBy("class_id", alone.alias("alone")).agg(F.min("rid").alias(rid)).select(rid)
    return docs.select(*cols, row_key().alias(rid)).join(chosen, rid, "left_semi").dropDuplicates([rid]).select(*cols)
