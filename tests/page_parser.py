"""A real HTML parse of one page, to hold the native extraction against."""

from __future__ import annotations

from html.parser import HTMLParser


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _PageParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title, self.heading, self.lang = [], [], None
        self.links: list[str] = []
        self.paras: list[list[str]] = []
        self._in_link = False
        self._link: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "meta", "img", "hr", "input", "link"):
            return
        if tag == "p" and self.stack and self.stack[-1] == "p":
            self.stack.pop()                      # an open <p> is closed by the next <p>
        self.stack.append(tag)
        if tag == "html":
            self.lang = dict(attrs).get("lang")
        elif tag == "a" and "nav" in self.stack:
            self._in_link, self._link = True, []
        elif tag == "p" and "article" in self.stack:
            self.paras.append([])

    def handle_endtag(self, tag):
        if tag == "a" and self._in_link:
            self.links.append(_squeeze(self._link))
            self._in_link = False
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.stack or self.stack[-1] in ("script", "style"):
            return
        top = self.stack[-1]
        if top == "title":
            self.title.append(data)
        if "h1" in self.stack:
            self.heading.append(data)
        if self._in_link:
            self._link.append(data)
        if self.paras and "article" in self.stack and "p" in self.stack and "h1" not in self.stack:
            self.paras[-1].append(data)


def parse_page(page_id: int, html: str | None) -> dict | None:
    """One page -> one record dict (None when the page has no title)."""
    p = _PageParser()
    try:
        p.feed(html or "")
        p.close()
    except Exception:  # noqa: BLE001 - malformed page: keep what was parsed
        pass
    title = _squeeze(p.title) or _squeeze(p.heading)
    if not title:
        return None
    paras = [_squeeze(x) for x in p.paras]
    paras = [x for x in paras if x]
    return {"page_id": page_id, "title": title, "lang": p.lang, "heading": _squeeze(p.heading),
            "links": "; ".join(p.links), "n_links": len(p.links), "n_paragraphs": len(paras),
            "text": " ".join(paras)}
