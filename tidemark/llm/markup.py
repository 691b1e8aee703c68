"""HTML in one pass: tokens of a page, attributes of a tag, character references.

A tag whose end or closing quote never comes takes the rest of the page with it, as in a browser; so nothing is looked for
twice, and the time is in proportion to the page whatever stands in it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TEXT, OPEN, CLOSE, RAW = range(4)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=[^\"'])))*+)>")
_ATTRIBUTE = re.compile(r"([^\s=>/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}+|[xX]0*+[0-9a-fA-F]{7,}+);?")
#: Elements that hold characters alone (fixed values).
CHARACTERS = frozenset("script style title textarea iframe noembed noframes noscript template xmp".split())
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in CHARACTERS}


def tokens(page: str) -> Iterator[tuple[int, str, str]]:
    """(TEXT, "", text), (OPEN or CLOSE, name, attributes) and (RAW, name, characters), in the order of the page; comments are left out."""
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            yield TEXT, "", page[at:begin]
        if begin == n:
            return
        if m := _TAG.match(page, begin):
            at, name = m.end(), m[2].lower()
            yield CLOSE if m[1] else OPEN, name, m[3]
            if not m[1] and name in CHARACTERS:
                end = _ENDS[name].search(page, at)
                stop = end.start() if end else n
                yield RAW, name, page[at:stop]
                at = stop
            continue
        kind = page[begin + 1 : begin + 3]
        if kind[:1] in ("!", "?") or kind[:1] == "/" and len(kind) > 1 and not kind[1].isascii():
            close = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(close, begin + 2)
            at = end + len(close) if end >= 0 else n
        elif re.match("/?[a-zA-Z]", kind):  # without an end
            return
        else:
            yield TEXT, "", "<"
            at = begin + 1


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and values, the first of equal names."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), decoded(next((v for v in values if v), "")))
    return out


def decoded(text: str) -> str:
    """text with its character references as characters; a number beyond all characters gives U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("�", text) if "&#" in text else text)
