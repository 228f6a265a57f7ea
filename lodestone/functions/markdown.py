"""HTML to markdown with the standard parser: one pass over tags, a stack of open elements, no patterns over the whole page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from lodestone.functions.fixed import CODE_CLASS

#: Elements that stand on their own, and those whose text is never shown.
_BLOCKS = {"p", "div", "ul", "ol", "blockquote", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li"}
_HIDDEN = {"script", "style", "noscript", "template"}


class _Reader(HTMLParser):
    """Writes paragraphs to ``out``; ``line`` is the one being written, ``code`` the text of an open code block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line, self.lead = "", ""
        self.code: list[str] | None = None
        self.language, self.hidden, self.ticked = "", 0, False

    def close_line(self) -> None:
        text = re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", self.line)).strip()
        if text:
            self.out.append(self.lead + text)
            self.lead = ""
        self.line = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = " ".join(v or "" for k, v in attrs if k == "class")
        if tag in _HIDDEN:
            self.hidden += 1
        if self.code is not None:
            self.language = self.language or _language(classes)
        elif tag == "pre":
            self.close_line()
            self.code, self.language = [], _language(classes)
        elif tag == "br":
            self.line += "\n"
        elif tag == "code":
            self.line, self.ticked = self.line + "`", True
        elif tag in _BLOCKS:
            self.close_line()
            if tag == "li":
                self.lead = "- "
            elif tag[0] == "h" and tag[1:].isdigit():
                self.lead = "#" * int(tag[1]) + " "

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "pre" and self.code is not None:
            self.out.append(f"```{self.language}\n{''.join(self.code).strip()}\n```")
            self.code = None
        elif self.code is None and tag == "code" and self.ticked:
            self.line, self.ticked = self.line + "`", False
        elif self.code is None and tag in _BLOCKS:
            self.close_line()
            self.lead = ""

    def handle_data(self, data: str) -> None:
        if self.code is not None:
            self.code.append(data)
        elif not self.hidden:
            self.line += data


def _language(classes: str) -> str:
    found = re.search(CODE_CLASS, f'class="{classes}"')
    return found[1].lower() if found else ""


def markdown_of(fragment: str | None) -> str:
    """Markdown of an HTML fragment: headings, list items, paragraphs, code spans and fenced blocks; code stands as it was written."""
    reader = _Reader()
    reader.feed(fragment or "")
    reader.close()
    if reader.code is not None:
        reader.handle_endtag("pre")
    reader.close_line()
    return "\n\n".join(reader.out)


def cleaned(body: str | None, content_type: str | None) -> str:
    """Markdown of a fetched body: HTML is read, other text is taken as it is."""
    kind = (content_type or "").lower()
    looks = "html" in kind or (not kind and bool(re.search(r"<(?:p|div|html|body|h[1-6]|pre|ul|table)\b", body or "", re.I)))
    return markdown_of(body) if looks else (body or "").strip()


def sitemap_urls(body: str) -> tuple[list[str], list[str]]:
    """(pages, child sitemaps) that a sitemap names, in order."""
    places = [re.sub(r"\s+", "", m) for m in re.findall(r"<loc>(.*?)</loc>", body or "", re.S | re.I)]
    index = bool(re.search(r"<sitemapindex\b", body or "", re.I))
    return ([], places) if index else (places, [])
