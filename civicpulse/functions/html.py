"""HTML to visible text, in Arrow batches."""

from __future__ import annotations

from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Text inside these elements is never shown.
HIDDEN = {"script", "style", "template", "rt", "rp"}
# Elements that hold no content and so never stay open.
VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param",
    "source", "spacer", "track", "wbr",
}


class _VisibleText(HTMLParser):
    """Collects stripped text nodes; every tag, comment or declaration ends a node."""

    def __init__(self) -> None:
        # References are left to the two handlers below: text like "&co" is none, and stays.
        super().__init__(convert_charrefs=False)
        self.nodes: list[str] = []
        self.pending: list[str] = []
        self.path: list[str] = []
        self.open: Counter[str] = Counter()
        self.hidden = 0
        self.void_open: Counter[str] = Counter()

    def end_node(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending).strip()
        if text and not self.hidden:
            self.nodes.append(text)
        self.pending.clear()

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_entityref(self, name: str) -> None:
        self.pending.append(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name: str) -> None:
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        self.pending.append(_character(code))

    def handle_starttag(self, tag, attrs) -> None:
        self.end_node()
        if tag in VOID:
            self.void_open[tag] += 1
        else:
            self.path.append(tag)
            self.open[tag] += 1
            self.hidden += tag in HIDDEN

    def handle_endtag(self, tag) -> None:
        if self.void_open[tag]:  # closed at its start, so this ends nothing
            self.void_open[tag] -= 1
            return
        self.end_node()
        # An end tag closes everything opened since its start tag; a stray one closes nothing.
        while self.open[tag]:
            closed = self.path.pop()
            self.open[closed] -= 1
            self.hidden -= closed in HIDDEN
            if closed == tag:
                break

    def handle_comment(self, data) -> None:
        self.end_node()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data) -> None:
        self.end_node()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[len("CDATA["):])
            self.end_node()


def _character(code: int) -> str:
    if 128 <= code < 160:  # meant as Windows-1252, as browsers take it
        return bytes([code]).decode("windows-1252", errors="ignore") or chr(code)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:  # no character, or half of one
        return "\N{REPLACEMENT CHARACTER}"
    return chr(code)


def visible_text(html: str) -> str:
    parser = _VisibleText()
    parser.feed(html)
    parser.close()
    parser.end_node()
    return " ".join(parser.nodes)


def _text_or_error(html: str | None) -> tuple[str | None, str | None]:
    if html is None:
        return None, None
    try:
        return visible_text(html), None
    except Exception as error:  # one unreadable page must not fail the job
        return None, f"{type(error).__name__}: {error}"


@F.pandas_udf(StructType([StructField("content", StringType()), StructField("error", StringType())]))
def html_to_text(html: pd.Series) -> pd.DataFrame:
    """Struct of the visible text and, for a page that cannot be parsed, the error."""
    return pd.DataFrame([_text_or_error(h) for h in html], columns=["content", "error"])


# So declared, a filter on the text is not pushed below it, which would parse every page twice.
html_to_text = html_to_text.asNondeterministic()
