"""References such as "1 Nephi 3:7-9" in texts: extraction, dictionary look-up and links.

Three dialects differ in the space before the chapter, the dashes of a range, a list of verses after it and the
anchor of a range. The patterns use plain classes only, so Java and RE2 read them alike."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bound


@dataclass(frozen=True)
class Dialect:
    space: str
    dashes: str
    verse_list: bool
    range_anchor: bool  # whether the anchor holds both ends of a range


#: Spacing, dashes and anchors of the three dialects.
DIALECTS = {
    "loose": Dialect(r"[ \t\n]*", "-–—", True, False),
    "strict": Dialect(r"[ \t\n]+", "-–", False, True),
    "inline": Dialect(r"[ \t\n]+", "-–", False, True),
}


def pattern(names: list[str], dialect: str = "loose") -> str:
    """One pattern for all names, the longest first; groups: name, chapter, first verse, last verse."""
    d = DIALECTS[dialect]
    book = "|".join(re.escape(n).replace("\\ ", " ") for n in sorted(names, key=lambda n: (-len(n), n)))
    tail = r"(?:,[ ]*[0-9]+)*" if d.verse_list else ""
    return rf"\b({book}){d.space}([0-9]+):([0-9]+)(?:[ ]*[{d.dashes}][ ]*([0-9]+))?{tail}"


def extracted(df: DataFrame, text: str, names: list[str], dialect: str = "loose") -> DataFrame:
    """A row for each reference in the text, in order: ref_no, name, chapter, verse, last_verse and the matched words."""
    p = "(?i)" + pattern(names, dialect)
    found = F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
    part = lambda i: F.regexp_extract("matched", p, i)
    rows = df.filter(F.col(text).rlike(p)).select("*", F.posexplode(found).alias("ref_no", "matched"))
    return rows.select("*", part(1).alias("name"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"), part(4).try_cast("int").alias("last_verse"))


def url(path: Column, root: str, dialect: str = "loose", chapter: Column | None = None, verse: Column | None = None, last: Column | None = None) -> Column:
    """Link of a resolved reference below root; null where its name is unknown. Its parts, or the columns of that name."""
    chapter, verse, last = ((F.col(n) if c is None else c).cast("string") for c, n in ((chapter, "chapter"), (verse, "verse"), (last, "last_verse")))
    ranged = last.isNotNull() & (last != verse)
    ids = F.concat(F.lit("p"), verse, F.when(ranged, F.concat(F.lit("-p"), last)).otherwise(""))
    anchor = F.concat(F.lit("#p"), verse, F.when(ranged, F.concat(F.lit("-p"), last)).otherwise("")) if DIALECTS[dialect].range_anchor else F.concat(F.lit("#p"), verse)
    return F.when(path.isNotNull(), F.concat(F.lit(root), path, F.lit("/"), chapter, F.lit("?id="), ids, anchor))


def linked(df: DataFrame, text: str, books: DataFrame, names: list[str], root: str, dialect: str = "loose") -> DataFrame:
    """References of the text with path and url; books: name and path, one row per name."""
    keys = books.select(F.lower("name").alias("_key"), "path")
    found = extracted(df, text, names, dialect)
    return found.join(keys, F.lower(F.col("name")) == F.col("_key"), "left").drop("_key").withColumn("url", url(F.col("path"), root, dialect))


def url_of(matched: Column, books: dict[str, str], root: str, dialect: str = "loose") -> Column:
    """Link of one reference, given as the words that matched; books: path by name, None where it has none."""
    # one match gives all groups
    groups = F.split(F.regexp_replace(matched, "(?i)" + pattern(list(books), dialect), "$1\u0001$2\u0001$3\u0001$4"), "\u0001", -1)
    paths = F.create_map(*[F.lit(x) for name, path in books.items() if path is not None for x in (name.lower(), path)])
    number = lambda g, i: F.get(g, i).try_cast("int")
    return bound(groups, lambda g: url(F.try_element_at(paths, F.lower(F.get(g, 0))), root, dialect, number(g, 1), number(g, 2), number(g, 3)))


def ref_url(text: Column, books: dict[str, str], root: str, dialect: str = "loose") -> Column:
    """Link of the first reference in a text, or null."""
    found = F.regexp_extract(text, "(?i)" + pattern(list(books), dialect), 0)
    return F.when(found != "", url_of(found, books, root, dialect))


def segments(text: Column, books: dict[str, str], root: str, dialect: str = "loose") -> Column:
    """The text in parts (value, url) that put together are the text; url is null for what is no link.

    Links that the text has already (a elements) are one part, and nothing in them is linked again."""
    p = "(?is)<a\\b[^>]*>.*?</a>|" + pattern(list(books), dialect)
    parts = F.struct(F.split(text, p).alias("between"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found"))
    plain = lambda x: F.struct(x.alias("value"), F.lit(None).cast("string").alias("url"))
    link = lambda x: F.struct(x.alias("value"), F.when(~x.rlike("(?i)^<a"), url_of(x, books, root, dialect)).alias("url"))
    # the text is matched once, and not again for each of its parts
    both = bound(parts, lambda t: F.flatten(F.transform(t["between"], lambda x, i: F.array(plain(x), link(F.get(t["found"], i))))))
    return F.filter(both, lambda s: F.coalesce(s["value"] != "", F.lit(False)))


def spliced(text: Column, books: dict[str, str], root: str, dialect: str = "loose") -> Column:
    """The text with its references as a elements; what is linked already stays."""
    one = lambda s: F.when(s["url"].isNotNull(), F.concat(F.lit('<a href="'), s["url"], F.lit('">'), s["value"], F.lit("</a>"))).otherwise(s["value"])
    return F.array_join(F.transform(segments(text, books, root, dialect), one), "")
