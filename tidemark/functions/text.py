"""Text functions. A Column in, a Column out; null stays null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the page text escapes, the ampersand first (fixed values).
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def normalise_words(text: Column) -> Column:
    """normalise() without punctuation; letters of all scripts stay."""
    return normalise(F.regexp_replace(text, r"(?U)[^\w\s]", ""))


def tokens(text: Column) -> Column:
    """The words of a normalised text; no empty ones."""
    return F.filter(F.split(normalise(text), " "), lambda w: w != "")


def present(value: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(value, F.lit(""))


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[present(v) for v in values], F.lit(""))


def title_of(slug: Column) -> Column:
    """chapter-03-on-the-road as On The Road: prefix and number go, words get a capital, their rest stays."""
    bare = F.regexp_replace(slug, r"^(?:chapter-)?(?:[0-9]+-)?", "")
    return F.array_join(F.transform(F.split(bare, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30))), " ")


def initials(name: Column) -> Column:
    """First letters of the first two words, in capitals; ? without a word."""
    words = F.filter(F.split(F.trim(name), " +"), lambda w: w != "")
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))).otherwise("?")


def label(text: Column, limit: int = 80) -> Column:
    """The text, or its first limit - 3 characters and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("…"))).otherwise(text)


def padded(number: Column, width: int = 2) -> Column:
    """Zeros in front up to the width; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def escaped(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def uri_component(text: Column) -> Column:
    """url_encode with %20 for a space, and ! ' ( ) ~ left as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def find_from(part: Column, text: Column, start: Column) -> Column:
    """0-based place of part in text from start on, or -1."""
    return F.call_function("locate", part, text, start + 1) - 1


def leading_int(text: Column) -> Column:
    """The whole number at the front of a text, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def last_items(items: Column, n: int) -> Column:
    """The last n items, or all of fewer."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def capitalised(text: Column) -> Column:
    """The first letter a capital, all others small."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**30)))


def occurrences(text: Column, part: str) -> Column:
    """How often part is in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def with_prefix(text: Column, prefix: str) -> Column:
    """The text with that in front, unless it is there."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def without_suffix(text: Column, suffix: str) -> Column:
    """The text without that at its end."""
    return F.when(F.endswith(text, F.lit(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def first_case(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The word of the first case that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for holds, word in cases:
        out = out.when(holds, F.lit(word))
    return out.otherwise(F.lit(otherwise))


def inner_json(text: Column, kind: str) -> Column:
    """JSON that stands in a string of JSON, parsed; text that is JSON itself is taken as it is."""
    return F.from_json(F.coalesce(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"], text), kind)


def inverted(values: Column) -> Column:
    """A map's entries with key and value exchanged, in the order of the values."""
    return F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def reading_minutes(text: Column, words_a_minute: int = 200) -> Column:
    """Whole minutes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.size(tokens(text)) / words_a_minute)).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value that is evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]
