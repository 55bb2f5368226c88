"""Speech XML to rows, one document at a time."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

# One parsed speech: position, attributes, leading text.
Speech = tuple[int, dict[str, str], str | None]


def iter_speeches(document: bytes, tag: str = "speech") -> Iterator[Speech]:
    """Speeches at any depth; an outer speech ends after the ones nested in it.

    A speech carries the attributes of the document root, overlaid with its own, and the text
    that opens its first child element.
    """
    root: ElementTree.Element | None = None
    shared: dict[str, str] = {}
    started: list[int] = []
    count = 0
    for event, element in ElementTree.iterparse(io.BytesIO(document), events=("start", "end")):
        if event == "start":
            if root is None:
                root, shared = element, dict(element.attrib)
            if element.tag == tag:
                started.append(count)
                count += 1
        elif element.tag == tag:
            attributes = {k: v for k, v in (shared | element.attrib).items() if k != "data"}
            yield started.pop(), attributes, element[0].text if len(element) else None
            if not started and element is not root:
                element.clear()
