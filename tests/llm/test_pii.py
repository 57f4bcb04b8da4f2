"""op6: base patterns against plain regular expressions; disclosure against a dictionary count."""

import hashlib
import math
import random
import re

from wavepanel.llm import pii

from .conftest import EDGE

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def test_base_patterns():
    rnd = random.Random(5)
    parts = ["a", "b.", "@", "@", "x.y", ".", "..", "-", "_", "1", "25", "256", "0", "+", "+1", " ", "(", ")", "é", "4111 1111 1111 1111"]
    for _ in range(30_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+" * 200_000, "1 " * 100_000, "." * 200_000 + "1.1.1.1"):
        pii.base_spans(text)


CONTACT = [(i, f"filler word{c} around{c} here Zanzibar Quux mail kim.lee@example.org now the end{c} of{c}") for i, c in enumerate("abcdefgh")]


def rows_of(make, rows, **options):
    return {r["doc_id"]: r for r in pii.find(make(rows, ("rid", "kind", "entity", "spans")), **options).collect()}


def test_disclosing_terms(make):
    common = [(100 + i, "the now here mail end of mail now the here " * 30 + str(i)) for i in range(30)]
    got = rows_of(make, CONTACT + common)
    text = CONTACT[0][1]
    terms = {(s["kind"], text[s["start"]:s["end"]]) for s in got[0]["added"]}
    assert terms == {("removed", "Zanzibar"), ("removed", "Quux")}
    assert all(not got[100 + i]["added"] for i in range(30))
    assert not rows_of(make, CONTACT[:2] + common)[0]["added"]          # too few different texts
    # the share of the information, by hand: every 'zanzibar' stands next to the address
    total = sum(len(re.findall(r"[^\W\d_]{3,}", t)) for _, t in CONTACT + common)
    assert 1 + math.log2(1.0) / -math.log2(8 / total) == 1.0


def test_disclosing_terms_everywhere(make):
    """A term that gives a value away is marked far from the value, and in texts without it."""
    far = "filler " * 20
    rows = CONTACT + [(40, f"mail kim.lee@example.org now {far}é zanzibar, {far}zanzibar@example.org"), (41, f"é {far}Quux and Zanzibars"), (41, f"é {far}Quux and Zanzibars")]
    rows += [(100 + i, "the now here mail end of mail now the here " * 30 + str(i)) for i in range(30)]
    got = rows_of(make, rows)
    text = dict(rows)
    marked = lambda d: [(s["kind"], text[d][s["start"]:s["end"]], s["start"]) for s in got[d]["added"]]
    assert [x[1] for x in marked(0)] == ["Zanzibar", "Quux"]
    assert marked(40) == [("removed", "zanzibar", text[40].index("zanzibar"))]      # not the one inside an address
    assert marked(41) == [("removed", "Quux", text[41].index("Quux"))]              # no part of a longer term
    assert all(not got[100 + i]["added"] for i in range(30))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make(rows)).collect()}
    assert "zanzibar" not in clean[40] and "Quux" not in clean[41] and "Zanzibars" in clean[41]


def test_edges_and_digest(make):
    rows = EDGE + [(50, "mail kim.lee@example.org and 10.0.0.1, é +1 555 123 4567 4111 1111 1111 1111"), (51, None)]
    got = pii.op6_pii(make(rows, ("spans", "base"))).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or ""))
        want.setdefault(d, set()).add((hashlib.sha256(joined.encode()).hexdigest(), joined))
    for r in got:
        assert (r["base_sha256"], r["spans"]) in want[r["doc_id"]]
    assert pii.op6_pii(make([])).collect() == []


def test_sanitise(make):
    docs = make(CONTACT + [(200, "nothing to see"), (201, None), (202, "call +1 555 123 4567 or 10.0.0.1")], ("rid", "__x"))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(CONTACT) + 3 and got[200]["text"] == "nothing to see" and got[201]["text"] is None
    assert got[202]["text"] == "call [PHONE] or [IP]" and got[202]["n_chars"] == len("call [PHONE] or [IP]")
    assert "kim.lee" not in got[0]["text"] and "Zanzibar" not in got[0]["text"] and "[EMAIL]" in got[0]["text"]
    assert pii.rewrite("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"
