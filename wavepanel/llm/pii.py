"""Personal data: patterns, and terms that disclose the entities they stand near.

Base spans come from four patterns (email, ip, card, phone).  Then, in the sense
of information-theoretic sanitisation, every value found is a protected entity
e, and the corpus itself tells which terms t give it away:

    p(e)    texts that name e, per term occurrence of the corpus
    p(e|t)  share of t's occurrences that lie within `reach` terms of e
    PMI(e;t) = log2 p(e|t) / p(e),    IC(e) = -log2 p(e)

A term that always stands next to an entity has PMI = IC: it says as much as the
entity.  Terms with PMI/IC at or above `remove` are removed, from `generalise`
on they are replaced by a general mark.  A pair needs `support` different texts.
Terms are runs of letters (ASCII case folded), three bytes or more.  A term that
gives a value away does so wherever it stands: all its occurrences in all texts
are marked, near the value or not, whether or not the text names the value.

One pass over the texts writes a table of base spans, contexts (a few rows per
entity occurrence) and term counts (combined per task); statistics cover all
documents.  Grouped sums and key joins make the table of disclosing terms; a
second pass finds their occurrences, by a bitmap of fixed size (MAP_BITS) first
and then exactly by a key join.  The corpus size and the bitmap reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_batches, fresh, row_key, stored

KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalised", "removed")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
REACH, SUPPORT, GENERALISE, REMOVE = 5, 3, 0.8, 0.9
COUNT_LIMIT = 1_000_000       # distinct terms that a task holds before it passes them on
ROWS = 1 << 16                # rows of a batch of counts
MAP_BITS = 1 << 23            # bits of the map of disclosing terms: 1 MB
MAP_ROW = 1 << 15             # bits in a row of bitmap_construct_agg
SALTS = 16                    # shares of a term's occurrences in the join

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping.  Linear: every match holds one '@', and its
    local part is the whole run of local characters before it (or what an
    earlier match has left of it)."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        else:
            end = max(end, at)                # no local part reaches back over this '@'
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Dotted quads: in a run of numbers joined by single dots, every four in turn."""
    out = []
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = [], run.start()
        for part in run.group().split("."):
            if part:
                parts.append((at, at + len(part)))
            else:
                parts = []
            if len(parts) == 4:
                if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in parts):
                    out.append((parts[0][0], parts[3][1]))
                parts = []
            at += len(part) + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(DIGIT.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", a, b) for a, b in addresses(text)]
        out += [("card", a, b) for a, b in cards(text)]
        out += [("phone", a, b) for a, b in phones(text)] if "+" in text else []
    return out


def entity(kind: str, value: str) -> bytes:
    """The protected value, spelling aside."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(DIGIT.findall(value))}".encode()


class _Counts:
    """Term counts of a task, passed on when they grow large."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, h):
        k, c = np.unique(h, return_counts=True)
        self.waiting.append((k, c))
        self.held += len(k)

    def merge(self):
        if self.waiting:
            k = np.concatenate([self.keys, *(x for x, _ in self.waiting)])
            c = np.concatenate([self.counts, *(x for _, x in self.waiting)])
            self.keys, at = np.unique(k, return_inverse=True)
            self.counts = np.bincount(at, c, minlength=len(self.keys)).astype(np.int64)
            self.waiting, self.held = [], 0

    def take(self):
        self.merge()
        out, self.keys, self.counts = (self.keys, self.counts), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out


SCAN = "kind int, rid long, doc_id long, spans array<struct<kind:string,start:int,end:int>>, entity long, term long, start int, end int, n long"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("spans", _SPAN), ("entity", pa.int64()),
                    ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n", pa.int64())])
DOCUMENT, CONTEXT, COUNT = 0, 1, 2


def _rows(length: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in _ARROW], schema=_ARROW)


def scan(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    counts = _Counts()

    def count_rows():
        keys, n = counts.take()
        for k in range(0, len(keys), ROWS):
            part = keys[k:k + ROWS]
            yield _rows(len(part), kind=np.full(len(part), COUNT, np.int32), term=part.view(np.int64), n=n[k:k + ROWS])

    for batch in batches:
        for rows, data, off in tv.slices(batch, "text"):
            a, z = tv.edges_of(LETTER[data], off)
            long = z - a >= 3
            a, z = a[long], z[long]
            terms = tv.span_hash(FOLD[data], a, z)
            counts.add(terms)
            if counts.held > COUNT_LIMIT:
                counts.merge()
                if len(counts.keys) > COUNT_LIMIT:
                    yield from count_rows()
            texts, rid = rows.column("text").to_pylist(), rows.column("rid").to_pylist()
            spans, ctx = [], []
            for k, text in enumerate(texts):
                found = base_spans(text)
                spans.append([{"kind": x, "start": i, "end": j} for x, i, j in found])
                if not found:
                    continue
                lo, hi = off[k], off[k + 1]
                lead = None if len(text) == hi - lo else np.append(np.flatnonzero((data[lo:hi] & 0xC0) != 0x80), hi - lo)
                byte = np.array([(i, j) for _, i, j in found], np.int64)
                byte = lo + (byte if lead is None else lead[byte])
                t0, t1 = np.searchsorted(a, [lo, hi])
                ta, tz = a[t0:t1], z[t0:t1]
                free = np.ones(len(ta), bool)                     # terms inside personal data are no terms
                for i, j in byte:
                    free[np.searchsorted(tz, i, side="right"):np.searchsorted(ta, j)] = False
                ta, tz, th = ta[free], tz[free], terms[t0:t1][free]
                who = np.frombuffer(b"".join(entity(x, text[i:j]) for x, i, j in found), np.uint8)
                size = np.cumsum([0] + [len(entity(x, text[i:j])) for x, i, j in found])
                ident = tv.span_hash(who, size[:-1], size[1:]).view(np.int64)
                for (i, j), e in zip(byte, ident.tolist()):
                    left, right = np.searchsorted(tz, i, side="right"), np.searchsorted(ta, j)
                    for p in [*range(max(left - reach, 0), left), *range(right, min(right + reach, len(ta)))]:
                        ctx.append((rid[k], e, int(th[p].view(np.int64)), int(ta[p] - lo), int(tz[p] - lo), lead))
            yield _rows(len(texts), kind=np.full(len(texts), DOCUMENT, np.int32), rid=rid, doc_id=rows.column("doc_id"), spans=spans)
            if ctx:
                r, e, t, i, j, lead = zip(*ctx)
                point = lambda x: [v if m is None else int(np.searchsorted(m, v)) for v, m in zip(x, lead)]
                yield _rows(len(r), kind=np.full(len(r), CONTEXT, np.int32), rid=r, entity=e, term=t, start=point(i), end=point(j))
    if counts.held or len(counts.keys):
        yield from count_rows()


def term_map(telling: DataFrame) -> np.ndarray:
    """MAP_BITS bits in bytes, lowest first, set at the low bits of every term in the table."""
    slot = F.expr(f"term & {MAP_BITS - 1}L") + 1                     # Spark's bitmaps count from 1
    rows = telling.groupBy(F.bitmap_bucket_number(slot).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in rows.collect():
        out[(r["row"] - 1) * MAP_ROW // 8:r["row"] * MAP_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


PLACES = "rid long, term long, places array<struct<start:int,end:int>>"


def occurrences(batches: Iterator[pa.RecordBatch], marked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The places of every term that the map holds, outside personal data: a row per document and term."""
    for batch in batches:
        for rows, data, off in tv.slices(batch, "text"):
            a, z = tv.edges_of(LETTER[data], off)
            long = z - a >= 3
            a, z = a[long], z[long]
            terms = tv.span_hash(FOLD[data], a, z)
            slot = (terms & np.uint64(MAP_BITS - 1)).astype(np.int64)
            hit = np.flatnonzero(marked[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            a, z, terms = a[hit], z[hit], terms[hit]
            first = np.searchsorted(a, off)
            free = np.ones(len(a), bool)
            for k in np.flatnonzero(np.diff(first)).tolist():
                lo, hi, t = off[k], off[k + 1], slice(first[k], first[k + 1])
                text = rows.column("text")[k].as_py()
                byte = np.array([x[1:] for x in base_spans(text)], np.int64).reshape(-1, 2)
                lead = None if len(text) == hi - lo else np.append(np.flatnonzero((data[lo:hi] & 0xC0) != 0x80), hi - lo)
                for i, j in lo + (byte if lead is None else lead[byte]):
                    free[t.start + np.searchsorted(z[t], i, side="right"):t.start + np.searchsorted(a[t], j)] = False
                a[t], z[t] = (x[t] - lo if lead is None else np.searchsorted(lead, x[t] - lo) for x in (a, z))
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[free]
            a, z, terms = a[free], z[free], terms[free]
            if not len(doc):
                continue
            order = np.lexsort((terms, doc))                          # stable: places stay in order
            a, z, terms, doc = a[order], z[order], terms[order], doc[order]
            head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1])))
            places = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([rows.column("rid").take(pa.array(doc[head])), pa.array(terms[head].view(np.int64)),
                                              pa.ListArray.from_arrays(pa.array(np.append(head, len(doc)).astype(np.int32)), places)],
                                             names=["rid", "term", "places"])


def find(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE,
         text: str = "text") -> DataFrame:
    """One row per document: doc_id, rid (row key), base and added (arrays of
    kind, start, end; code points, end exclusive).

    A null text is empty and has no spans.  Repeated rows get equal spans and
    count as one text in the support.  Other columns are ignored; an empty table
    gives no rows.
    """
    src = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("rid", row_key())
    found = stored(src.select("doc_id", "rid", "text").mapInArrow(lambda it: scan(it, reach), SCAN), "pii-scan")
    context = found.where(F.col("kind") == CONTEXT).select("rid", "entity", "term", "start", "end")
    counts = found.where(F.col("kind") == COUNT).select("term", "n")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    # several occurrences of an entity may reach the same term: it counts once per place
    place = context.distinct()
    pairs = place.groupBy("entity", "term", "rid").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term") \
                 .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("together")).where(F.col("texts") >= support)
    pairs = stored(pairs, "pii-pairs")
    seen = counts.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    # texts that name the entity
    own = found.where(F.col("kind") == CONTEXT).groupBy("entity").agg(F.countDistinct("rid").alias("n_entity"))
    p_e = F.col("n_entity") / F.lit(float(max(total, 2)))
    p_et = F.least(F.lit(1.0), F.col("together") / F.col("n_term"))
    said = (F.lit(1.0) + F.log2(p_et) / -F.log2(F.least(p_e, F.lit(0.5))))        # PMI / IC
    telling = (pairs.join(seen, "term").join(own, "entity").withColumn("said", said).where(F.col("said") >= generalise)
               .groupBy("term").agg(F.max(F.when(F.col("said") >= remove, ADDED[1]).otherwise(ADDED[0])).alias("kind")))
    telling = stored(telling, "pii-telling")
    marked = term_map(telling)
    salted = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = (src.select("rid", "text").mapInArrow(lambda it: occurrences(it, marked), PLACES)
              .withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]))
    # repeated rows share a key and their places: a set
    kinded = F.transform("places", lambda x: F.struct(F.col("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = places.select("rid", kinded.alias("spans")).groupBy("rid").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("added"))
    return (found.where(F.col("kind") == DOCUMENT).select("doc_id", "rid", F.col("spans").alias("base")).join(added, "rid", "left")
            .select("doc_id", "rid", "base", F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")).alias("added")))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(docs: DataFrame) -> DataFrame:
    out = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                      _joined(F.concat("base", "added")).alias("spans"))


def rewrite(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind's mark; overlapping spans are one, marked as the first."""
    out, end = [], 0
    for start, stop, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= end:
            out += [text[end:start], MARKS[kind]]
        end = max(end, stop)
    out.append(text[end:])
    return "".join(out)


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with their spans rewritten; all columns, n_chars (if there) of the new text.

    Texts are shuffled once by row key to meet their spans; a text without spans is unchanged.
    """
    cols = docs.columns
    bounded_batches(docs.sparkSession)
    rid, extra = fresh(docs, "rid"), fresh(docs, "spans")
    spans = (find(docs, text=text, **options).select(F.col("rid").alias(rid), F.concat("base", "added").alias(extra))
             .where(F.size(extra) > 0).dropDuplicates([rid]))
    keyed = docs.withColumn(rid, row_key(text=text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cols.index(text)
        for batch in batches:
            lists = batch[extra].to_pylist()
            change = [k for k, x in enumerate(lists) if x]
            if change:
                texts = batch.column(at).to_pylist()
                for k in change:
                    texts[k] = rewrite(texts[k], [(s["kind"], s["start"], s["end"]) for s in lists[k]])
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select(list(range(len(cols))))

    out = keyed.join(spans, rid, "left").select(*[F.col(f"`{c}`") for c in cols], extra)
    out = out.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out
