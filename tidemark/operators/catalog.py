"""Collections of chapters, cards and tracks: nested columns filtered, flattened and numbered; navigation states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import bound
from tidemark.operators import scans


def has(path: str) -> Column:
    """Whether every step of a nested path is there and its end is not empty."""
    return F.coalesce(F.col(path) != "", F.lit(False))


def tracks(chapters: DataFrame) -> DataFrame:
    """One row per recording: the chapters' own ones in order, then the alternates, numbered on from 1.

    chapters: chapter, title, url and audio.testimony{file, title, alternates[]{file, label}}."""
    main = chapters.filter(has("audio.testimony.file")).select("chapter", "title", "url", F.lit(0).alias("_part"), F.lit(-1).alias("_alt"), F.col("audio.testimony.file").alias("file"), F.coalesce("audio.testimony.title", "title").alias("label"))
    more = chapters.filter("size(audio.testimony.alternates) > 0").select("chapter", "title", "url", F.lit(1).alias("_part"), F.posexplode("audio.testimony.alternates").alias("_alt", "_a"))
    more = more.select("chapter", "title", "url", "_part", "_alt", F.col("_a.file").alias("file"), F.coalesce(F.col("_a.label"), F.lit("")).alias("label"))
    number = F.row_number().over(Window.orderBy("_part", "chapter", "_alt"))  # a catalogue: as many rows as recordings
    return main.unionByName(more).withColumn("number", number).drop("_part", "_alt")


def card_items(cards: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each scripture and commitment of each card, with 1-based numbers of card and item.

    cards: keys and cards[]{title, scriptures[]{display, url}, commitments[]{text, tier}}."""
    one = cards.select(*keys, F.posexplode("cards").alias("_c", "_card")).withColumn("card", F.col("_c") + 1)
    a = one.select(*keys, "card", F.lit("scripture").alias("kind"), F.posexplode("_card.scriptures").alias("_i", "_x")).select(*keys, "card", "kind", (F.col("_i") + 1).alias("item"), F.col("_x.display").alias("text"), F.col("_x.url").alias("detail"))
    b = one.select(*keys, "card", F.lit("commitment").alias("kind"), F.posexplode("_card.commitments").alias("_i", "_x")).select(*keys, "card", "kind", (F.col("_i") + 1).alias("item"), F.col("_x.text").alias("text"), F.col("_x.tier").alias("detail"))
    return a.unionByName(b)


def active_links(pages: DataFrame, links: list[str], mode: str = "contains") -> DataFrame:
    """Pages with the navigation links (a menu) that are active on them: an equal address, or one the page's address
    contains; the root only by equality."""
    menu = F.array(*[F.lit(x) for x in links]).cast("array<string>")
    on = lambda x: (F.col("page_url") == x) | ((x != "/") & F.contains(F.col("page_url"), x)) if mode == "contains" else F.col("page_url") == x
    return pages.withColumn("link_url", F.explode(F.filter(menu, on)))


def broken_links(chapters: DataFrame) -> DataFrame:
    """Chapters whose next one doesn't name them as its previous one. chapters: url, prev_url, next_url."""
    after = chapters.select(F.col("url").alias("next_url"), F.col("prev_url").alias("_back"))
    hit = chapters.filter("next_url is not null").join(after, "next_url", "left")
    return hit.filter(~F.col("_back").eqNullSafe(F.col("url"))).select("url", "next_url", "_back")


def replayed(events: DataFrame, keys: list[str], order: list[str], last: int = 5, block: int = scans.BLOCK) -> DataFrame:
    """Where readers stand after each step: events next, back and go (with target) move between 1 and last; they begin at 1.

    Each step is a clamp, so a reader's walk is a scan."""
    jump = (F.col("action") == "go") & F.col("target").isNotNull()
    to = F.greatest(F.lit(1), F.least(F.lit(last), F.col("target")))
    step = F.when(F.col("action") == "next", 1).when(F.col("action") == "back", -1).otherwise(0)
    maps = {"low": F.when(jump, to).otherwise(1), "high": F.when(jump, to).otherwise(last), "step": step}
    return scans.scanned(events, keys, order, scans.Clamps, maps, F.lit(1), "place", block)


#: What happens at the end of the tracks, in the order in which the button goes through them (fixed values).
REPEATS = ("none", "all", "one")


def played(events: DataFrame, keys: list[str], order: list[str], tracks: int, block: int = scans.BLOCK) -> DataFrame:
    """What a player of that many tracks plays after each event, and how it repeats: -1 is nothing, as in the beginning.

    Events: play (with target), next, back, repeat (the button), ended (the track came to its end). next and back go round if all tracks
    repeat, and else stay at the ends; at an end, one repeats itself, the next one follows, or after the last the first one or nothing. A
    state is a track and a way to repeat; each event is a table from state to state, so a listener's events are a scan."""
    n = len(REPEATS)

    def table(change) -> Column:
        """to[state] for each state, where a state is (track + 1) * n + repeat."""
        to = [(t + 1, r) for t in range(-1, tracks) for r in range(n)]
        return F.array(*[F.lit((a + 1) * n + b) for a, b in (change(t - 1, r) for t, r in to)])

    turn = lambda by: lambda t, r: (t, r) if t < 0 else (t + by if 0 <= t + by < tracks else (t + by) % tracks if REPEATS[r] == "all" else t, r)
    end = lambda t, r: (t, r) if t < 0 or REPEATS[r] == "one" else (t + 1 if t + 1 < tracks else 0 if REPEATS[r] == "all" else -1, r)
    action = F.col("action")
    to = F.when(action == "next", table(turn(1))).when(action == "back", table(turn(-1))).when(action == "ended", table(end)).when(action == "repeat", table(lambda t, r: (t, (r + 1) % n)))
    for i in range(tracks):
        to = to.when((action == "play") & (F.col("target") == i), table(lambda t, r, i=i: (i, r)))
    out = scans.scanned(events, keys, order, scans.Tables, {"to": to.otherwise(table(lambda t, r: (t, r)))}, F.lit(0), "_state", block)
    return out.withColumns({"track": F.floor(F.col("_state") / n).cast("int") - 1, "repeat": F.element_at(F.array(*map(F.lit, REPEATS)), F.pmod("_state", F.lit(n)) + 1)}).drop("_state")


def titles(chapters: DataFrame) -> DataFrame:
    """chapters with the title that search shows: Chapter N: T, or T alone without a number."""
    return chapters.withColumn("shown_title", F.when(F.col("chapter").isNotNull(), F.concat(F.lit("Chapter "), F.col("chapter").cast("string"), F.lit(": "), F.col("title"))).otherwise(F.col("title")))


def shortcodes(df: DataFrame, text: str, name: str) -> DataFrame:
    """A row for each paired code of that name in the text: its argument, and what it wraps."""
    p = rf"(?s)\{{%-?\s*{name}\s+([^%]*?)\s*-?%\}}(.*?)\{{%-?\s*end{name}\s*-?%\}}"
    found = df.select("*", F.posexplode(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("code_no", "_code"))
    return found.withColumns({"argument": F.regexp_extract("_code", p, 1), "content": F.regexp_extract("_code", p, 2)}).drop("_code")


CODE = r"(?s)\{%-?\s*(end)?([A-Za-z_]\w*)\s*(.*?)\s*-?%\}"
_OPEN = "struct<code_no: int, name: string, argument: string, content: string>"
_FOUND = "struct<code_no: int, depth: int, name: string, argument: string, content: string, state: string>"


def nested_codes(df: DataFrame, text: str, inline: list[str]) -> DataFrame:
    """A row for each code of the text: its number in the order in which codes begin, depth (0 outside of others), name, argument, content and state.

    A code is paired, and ends with the end of its name, or inline, if its name is one of those, without content. content is what a
    paired one wraps, without the codes in it but with what they wrap. States: closed, inline, unclosed (another's end or the text's end came
    first), stray (an end of nothing that is open). A fold over the text's pieces with a stack; each text is one row."""
    arrays = F.struct(F.split(F.col(text), CODE).alias("between"), F.regexp_extract_all(F.col(text), F.lit(CODE), F.lit(0)).alias("codes"))
    start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("open"), F.array().cast(f"array<{_FOUND}>").alias("out"), F.lit(0).alias("n"))
    top = lambda stack: F.get(stack, F.size(stack) - 1)
    below = lambda stack: F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))

    def added(stack: Column, more: Column) -> Column:
        """The stack with more text in what its top wraps."""
        t = top(stack)
        new = F.struct(t["code_no"].alias("code_no"), t["name"].alias("name"), t["argument"].alias("argument"), F.concat(t["content"], more).alias("content")).cast(_OPEN)
        return F.when(F.size(stack) > 0, F.concat(below(stack), F.array(new))).otherwise(stack)

    def given(no: Column, depth: Column, name: Column, argument: Column, content: Column, state: Column) -> Column:
        return F.array(F.struct(no.alias("code_no"), depth.alias("depth"), name.alias("name"), argument.alias("argument"), content.alias("content"), state.alias("state")).cast(_FOUND))

    def shut(acc: Column, state: Column) -> Column:
        """The top comes to its end, and what it wraps belongs to the one below."""
        t = top(acc["open"])
        out = given(t["code_no"], F.size(acc["open"]) - 1, t["name"], t["argument"], t["content"], state)
        return F.struct(added(below(acc["open"]), t["content"]).alias("open"), F.concat(acc["out"], out).alias("out"), acc["n"].alias("n"))

    def ended(acc: Column, name: Column) -> Column:
        """Everything down to the last open one of that name; all of the stack without a name."""
        places = F.transform(acc["open"], lambda o: o["name"])
        last = F.array_position(F.reverse(places), name)  # 1 is the top
        number = F.when(name.isNull(), F.size(acc["open"])).otherwise(last.cast("int"))
        stray = F.struct(acc["open"].alias("open"), F.concat(acc["out"], given(acc["n"], F.size(acc["open"]), name, F.lit(None), F.lit(None), F.lit("stray"))).alias("out"), (acc["n"] + 1).alias("n"))
        each = F.filter(F.sequence(F.lit(1), F.greatest(number, F.lit(1))), lambda i: i <= number)
        closed = F.aggregate(each, acc, lambda a, i: shut(a, F.when((i == number) & name.isNotNull(), "closed").otherwise("unclosed")))
        return F.when(name.isNotNull() & (last == 0), stray).otherwise(closed)

    def step(acc: Column, piece: Column) -> Column:
        acc = F.struct(added(acc["open"], piece["between"]).alias("open"), acc["out"].alias("out"), acc["n"].alias("n"))
        part = lambda i: F.regexp_extract(piece["code"], CODE, i)

        def coded(a: Column) -> Column:
            name, argument = part(2), part(3)
            row = given(a["n"], F.size(a["open"]), name, argument, F.lit(None), F.lit("inline"))
            pushed = F.concat(a["open"], F.array(F.struct(a["n"].alias("code_no"), name.alias("name"), argument.alias("argument"), F.lit("").alias("content")).cast(_OPEN)))
            one = name.isin(inline)
            begun = F.struct(F.when(one, a["open"]).otherwise(pushed).alias("open"), F.when(one, F.concat(a["out"], row)).otherwise(a["out"]).alias("out"), (a["n"] + 1).alias("n"))
            return F.when(piece["code"].isNull(), a).when(part(1) != "", ended(a, name)).otherwise(begun)

        return bound(acc, coded)

    pieces = bound(arrays, lambda x: F.transform(x["between"], lambda b, i: F.struct(b.alias("between"), F.get(x["codes"], i).alias("code"))))
    whole = F.aggregate(pieces, start, step, lambda acc: ended(acc, F.lit(None).cast("string"))["out"])
    return df.filter(F.col(text).contains("{%")).select("*", F.inline(whole))


def error_text(body: Column) -> Column:
    """What an error body says: its detail, else its general errors, else "field: message" for each field."""
    detail, general = F.get_json_object(body, "$.detail"), F.from_json(F.get_json_object(body, "$.non_field_errors"), "array<string>")
    fields = F.from_json(body, "map<string, string>")
    first = lambda v: F.coalesce(F.from_json(v, "array<string>")[0], v)
    each = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(": "), first(e["value"]))), "; ")
    return F.coalesce(F.nullif(detail, F.lit("")), F.array_join(general, " "), F.nullif(each, F.lit("")), F.lit("Something went wrong"))
