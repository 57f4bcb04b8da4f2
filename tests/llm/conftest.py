import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, source]) as a documents table; extra clashing columns on request."""
    def made(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) + tuple(range(len(extra))) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", `{c}` int" for c in extra))
    return made


LONG = "lorem ipsum " * 40_000
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "Hello wörld 漢字 🙂 don't  stop"), (6, "same same same"),
    (6, "same same same"), (7, "same same same"), (None, "no id here"), (None, None), (8, "x" * 30_000), (9, "a" + "▁" + " b"),
]
