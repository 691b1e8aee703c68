"""Text of HTML pages with excluded elements, and the search scope that pages mark: tokens by one pattern, then a fold with a stack."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text is not searched (fixed values).
EXCLUDED = ("script", "style", "textarea", "input", "code", "pre", "a")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements that hold text alone up to their end tag.
RAW = ("script", "style")

# Whatever isn't closed runs to the end of the page, and no quantifier gives back what it took, so a page is read once.
_ATTRIBUTES = r"""(?:[^'">]++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
_RAW = "|".join(rf"<{x}(?=[\s/>]){_ATTRIBUTES}.*?(?:</{x}(?=[\s/>])[^>]*+(?:>|\z)|\z)" for x in RAW)
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|{_RAW}|</?[a-z]{_ATTRIBUTES}|<[!?/][^>]*+(?:>|\z)|(?:[^<]++|<(?![a-z/!?]))++"
#: Characters that count as white space: those that Python's split() takes.
BLANKS = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]+"
#: Tokens whose texts are gathered before they are put behind the others.
BLOCK = 256
_STACK = "array<struct<name: string, off: boolean, on: boolean>>"
_STATE = f"struct<open: {_STACK}, out: array<string>>"


def _marked(tag: Column, name: str | None) -> Column:
    """Whether a start tag has an attribute; values in quotes hold none."""
    if not name:
        return F.lit(False)
    return F.regexp_replace(tag, r"\"[^\"]*\"|'[^']*'", "").rlike(rf"(?i)[\s/]\Q{name}\E(?:[\s=/>]|$)")


def nodes(page: Column, excluded=EXCLUDED, body: str | None = None, ignore: str | None = None) -> Column:
    """The text nodes of a page, character references as they stand: those outside excluded elements and ones with the attribute
    `ignore`; with `body`, only those within elements that have that attribute. Null and empty pages have none.

    An end tag closes the last open element of its name and what is open within it, one without such an element nothing; elements
    that are never closed last to the end. A step costs as much as elements are open, so time grows with tokens times depth."""
    first = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(TOKEN), F.lit(0))

    def read(t):
        tag = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1))
        start = F.regexp_extract(t, rf"(?is)^<[a-z]{_ATTRIBUTES}", 0)
        off, on = tag.isin(*excluded) | _marked(start, ignore), _marked(start, body)
        raw = tag.isin(*RAW) & ~t.startswith("</")
        inside = F.regexp_replace(F.substring(t, F.length(start) + 1, F.length(t)), rf"(?is)</(?:{'|'.join(RAW)})(?=[\s/>])[^>]*+>?\z", "")
        closed = tag.isin(*VOID) | (t.rlike(r"/\s*>$") & ~t.rlike(r"=[^\s\"'>]*/>$"))
        kind = F.when(tag == "", F.when(t.rlike("(?s)^<[!?/]"), "none").otherwise("text")).when(raw, F.when(off, "none").otherwise("text")).when(t.startswith("</"), "end").when(closed, "none").otherwise("start")
        return F.struct(kind.alias("kind"), tag.alias("name"), F.coalesce(off, F.lit(False)).alias("off"), on.alias("on"), F.when(raw, inside).otherwise(t).alias("text"))

    def step(s, t):
        top = F.get(s["open"], F.size(s["open"]) - 1)
        off, on = F.coalesce(top["off"], F.lit(False)), F.coalesce(top["on"], F.lit(body is None))
        here = F.struct(t["name"].alias("name"), (off | t["off"]).alias("off"), (on | t["on"]).alias("on"))
        back = F.array_position(F.transform(F.reverse(s["open"]), lambda x: x["name"]), t["name"]).cast("int")
        still = F.when(back > 0, F.slice(s["open"], F.lit(1), F.size(s["open"]) - back)).otherwise(s["open"])
        shown = ~off & (on | t["on"]) & ~t["text"].rlike(rf"(?s)^{BLANKS[:-1]}*$")
        is_open, is_end, is_text = t["kind"] == "start", t["kind"] == "end", (t["kind"] == "text") & shown
        opened = F.when(is_open, F.concat(s["open"], F.array(here))).when(is_end, still).otherwise(s["open"])
        return F.struct(opened.alias("open"), F.when(is_text, F.concat(s["out"], F.array(t["text"]))).otherwise(s["out"]).alias("out")).cast(_STATE)

    def of(open_, out):
        return F.struct(open_.alias("open"), out.alias("out")).cast(_STATE)

    def walked(tokens):
        def block(s, b):
            part = F.aggregate(F.slice(tokens, b, F.lit(BLOCK)), of(s["open"], F.array()), step)
            return F.get(F.transform(F.array(part), lambda p: of(p["open"], F.concat(s["out"], p["out"]))), F.lit(0))

        starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, of(F.array(), F.array()), block, lambda s: s["out"])

    found = F.filter(F.transform(first, read), lambda t: t["kind"] != "none")
    return F.get(F.transform(F.array(found), walked), F.lit(0))


def decoded(value: Column) -> Column:
    """Character references as characters; Spark has no table of them."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(entities.unescape)

    return read(value)


def with_text(pages: DataFrame, html: str = "html", excluded=EXCLUDED, body: str | None = None, ignore: str | None = None) -> DataFrame:
    """pages with text: its text nodes, joined by blanks, each run of white space as one."""
    shown = F.array_join(nodes(F.col(html), excluded, body, ignore), " ")
    # a row of its own for the walk: Spark can't evaluate nested lambdas within the argument of a Python function
    rows = pages.select("*", F.explode(F.array(shown)).alias("_shown"))
    return rows.withColumn("text", F.trim(F.regexp_replace(decoded(F.col("_shown")), BLANKS, " "))).drop("_shown")
