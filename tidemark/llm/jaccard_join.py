"""N-gram Jaccard join with signature trees.

A set's keys go where its partners are. Partners of Jaccard similarity t share at least g(n) of each one's first p(n)
shingles in the order of their hashes, with p(n) = n - ceil(t * n) + l(n), l(n) = ceil((1 - t) * n) and
g(n) = l(ceil(t * n)). Those keys are counted over all sets; a set with fewer than g keys that others have, too, has no
partner, and of the others' shared keys the rarest, all but g - 1, must hit one of the partner's. Sets that share such a
key are chained to the key's smallest set, and the connected groups of that are where links can be. Equal sets are one
set from the start.

Within a group, sets stand in a tree whose nodes hold the OR of their sets' bitmaps and their range of sizes. A dual
traversal visits each leaf against itself, then the pairs of siblings, level by level upwards, each from the top down; a
pair of nodes goes no further if its sizes or the bits it shares can't give the overlap, or if all its sets are joined
already. What is left at the leaves is counted exactly. A group of more than TILE shingles is dealt out over tiles,
which are linked within and then by probes; see large_group_links().

Defined cases: a null or empty text, or one without words, has the empty set and is linked with nothing; a text of
fewer words than a shingle has its whole sequence as one shingle; rows are told apart by themselves, not by doc_id, so
rows of one doc_id can be in different components; a row with a null doc_id is linked like others, and gives a
component its id only if all its ids are null (then null); an empty table gives an empty result; other columns of the
input are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bounded, chunks, mix, shingle_sets, spread_join, table, texts, written
from .components import components

#: Shingles of a tile, sets of a leaf, children of a node, bits of a bitmap, pairs of nodes that are followed at once.
TILE, LEAF, FAN, BITS, PAIRS = 1 << 19, 8, 8, 1 << 13, 64
#: Stands for a null doc_id where texts are found again; the text's hash stands beside it.
NO_ID = -(1 << 63)


def shares(n: int, t: tuple[int, int]) -> tuple[int, int]:
    """p(n), the number of keys of a set of n shingles, and g(n), how many of them any partner has among its own."""
    part = lambda m: max(1, -(-(t[1] - t[0]) * m // t[1]))
    least = -(-t[0] * n // t[1])
    return n - least + part(n), part(least)


def outlined(k: int, t: tuple[int, int]):
    """The columns in front of text, the number of shingles, a digest of the set, its keys (48 bits of a hash) and g."""

    def run(batches):
        for batch, data, offsets in chunks(batches):
            sets, ends = shingle_sets(data, offsets, k)
            sizes = np.diff(ends)
            digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:])]
            share = [shares(n, t) if n else (0, 0) for n in sizes.tolist()]
            take = np.array([p for p, _ in share], np.int64)
            at, bounds = np.arange(take.sum()), np.concatenate([[0], take.cumsum()])
            keys = (sets[at + np.repeat(ends[:-1] - bounds[:-1], take)] >> np.uint64(16)).view(np.int64)
            keep = [c for c in batch.schema.names if c != "text"]
            columns = [pa.array(sizes), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys)), pa.array([g for _, g in share], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "n_shingles", "digest", "keys", "g"])

    return run


def listed(k: int):
    """The sets themselves, sorted, as bytes, with the columns that came."""

    def run(batches):
        for batch, data, offsets in chunks(batches):
            sets, ends = shingle_sets(data, offsets, k)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=[*keep, "shingles"])

    return run


class Forest:
    """Sets joined so far: the label of each, numbered 0 to n - 1."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved
        return True


class Tree:
    """A signature tree over sets in a clustered order; levels[0] are the leaves."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.sizes = np.array([len(s) for s in sets])
        maps = np.zeros((n, BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            bits = (mix(s) % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(maps[i], bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
        self.maps = maps
        self.spare = self.sizes - np.bitwise_count(maps).sum(1)  # shingles that share a bit with another of the set
        self.levels, size = [], LEAF
        nodes = (np.arange(0, n, LEAF), maps, self.sizes, self.sizes, self.spare)
        while True:
            starts, m, small, large, spare = nodes
            at = np.arange(0, len(m), LEAF if not self.levels else FAN)
            nodes = (at, np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at), np.maximum.reduceat(spare, at))
            self.levels.append(nodes)
            if len(at) == 1:
                break
            size *= FAN

    def spans(self, level: int) -> np.ndarray:
        """Sets per node of the level."""
        return LEAF * FAN**level


def possible(x, y, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Whether nodes i of x and j of y can hold a linked pair; nodes are bitmaps, least and greatest size, spare shingles."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        fits = (x[2][a] >= t * y[1][b] - 1e-6) & (y[2][b] >= t * x[1][a] - 1e-6)
        most = np.bitwise_count(x[0][a] & y[0][b]).sum(1) + np.minimum(x[3][a], y[3][b])
        most = np.minimum(most, np.minimum(x[2][a], y[2][b]))
        least = np.maximum((x[1][a] + y[1][b]) * t / (1 + t), np.maximum(x[1][a], y[1][b]) * t)
        out[at : at + 4096] = fits & (most >= least - 1e-6)
    return out


def linked(a: np.ndarray, b: np.ndarray, t: tuple[int, int]) -> bool:
    """Whether two sorted sets have that Jaccard similarity, exactly."""
    if min(len(a), len(b)) * t[1] < max(len(a), len(b)) * t[0]:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return t[1] * shared >= t[0] * (len(a) + len(b) - shared)


def tree_links(sets: list[np.ndarray], t: tuple[int, int], first: int | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets as all links together do; with first, only pairs of one of the first so many sets and one
    of the others are looked at."""
    n, share, forest, out = len(sets), t[0] / t[1], Forest(len(sets)), []
    # a clustered order: by least shingles, in which near copies mostly agree
    order = np.array(sorted(range(n), key=lambda i: (int(sets[i][0]), len(sets[i]), i)))
    tree = Tree([sets[i] for i in order.tolist()])
    nodes = [level[1:] for level in tree.levels]
    alone = (tree.maps, tree.sizes, tree.sizes, tree.spare)

    def open_pairs(i, j, width: int):
        """Without pairs of nodes whose sets are all joined."""
        starts = np.arange(0, n, width)
        label = forest.label[order]
        low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        done = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
        return i[~done], j[~done]

    def children(i, j, count: int, fan: int):
        a = (i[:, None] * fan + np.arange(fan)).repeat(fan, 1).ravel()
        b = np.tile(j[:, None] * fan + np.arange(fan), (1, fan)).ravel()
        ok = (a < count) & (b < count) & (a <= b)
        return a[ok], b[ok]

    def count_exactly(i, j) -> None:
        """The sets of pairs of leaves."""
        a, b = children(i, j, n, LEAF)
        ok = (a != b) & (forest.label[order[a]] != forest.label[order[b]])
        if first is not None:
            ok &= (order[a] < first) != (order[b] < first)
        a, b = a[ok], b[ok]
        ok = possible(alone, alone, a, b, share)
        for p, q in zip(order[a[ok]].tolist(), order[b[ok]].tolist()):
            if forest.label[p] != forest.label[q] and linked(sets[p], sets[q], t):
                forest.join(p, q)
                out.append((p, q))

    def follow(level: int, i, j) -> None:
        """Pairs of nodes of a level, down to their sets; what earlier pairs join closes later ones."""
        for at in range(0, len(i), PAIRS):
            a, b = open_pairs(i[at : at + PAIRS], j[at : at + PAIRS], tree.spans(level))
            ok = possible(nodes[level], nodes[level], a, b, share)
            a, b = a[ok], b[ok]
            if len(a) and level:
                follow(level - 1, *children(a, b, len(nodes[level - 1][1]), FAN))
            elif len(a):
                count_exactly(a, b)

    each = np.arange(len(nodes[0][1]))
    follow(0, each, each)
    for level in range(1, len(nodes)):
        each = np.arange(len(nodes[level][1]))
        a, b = children(each, each, len(nodes[level - 1][1]), FAN)
        follow(level - 1, a[a < b], b[a < b])
    return out


def grouped_links(t: tuple[int, int]):
    """Links within one task's sets, those of a tile with each other or, if there are probes, with these alone; each part
    that they connect comes out as a star around its smallest set."""

    def run(group: pa.Table) -> pa.Table:
        home = group["home"].to_numpy() == group["tile"].to_numpy()
        group = group.take(pa.array(np.argsort(~home, kind="stable"))).combine_chunks()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["shingles"]]
        forest = Forest(len(sets))
        for a, b in tree_links(sets, t, None if home.all() else int(home.sum())) if len(sets) > 1 else []:
            forest.join(a, b)
        ids, least = group["cid"].to_numpy(), np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, forest.label, ids)
        hub = least[forest.label]
        rest = ids != hub
        return pa.table({"a": pa.array(ids[rest], pa.int64()), "b": pa.array(hub[rest], pa.int64())})

    return run


def task_links(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Links from one task per component and tile: rows of the tile itself (home is the tile) and probes from others."""
    return rows.select("component", "tile", "chunk", "home", "cid", "shingles").groupBy("component", "tile", "chunk").applyInArrow(grouped_links(t), "a long, b long")


def large_group_links(sets: DataFrame, tiles: DataFrame, n: int, t: tuple[int, int], tile: int) -> DataFrame:
    """Links of the n groups that are dealt out over tiles.

    Each tile is linked within itself; then the first set of each part that came out probes all tiles, which joins the
    parts of near copies. What still isn't in the group's largest part after that probes all tiles in full. A link has
    such a set at one end or joins two sets of the largest part, so none that matters is missed."""
    own = sets.join(bounded(tiles, n), "component").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    own = own.withColumn("home", F.col("tile"))

    def probed(chosen: DataFrame) -> DataFrame:
        """Links between the chosen sets, in chunks of a tile's size, and all tiles."""
        size = F.ceil(F.sum(F.octet_length("shingles")) / 8 / tile).cast("int")
        chunks_ = bounded(chosen.groupBy("component").agg(size.alias("chunks")), n)
        base = own.join(chunks_, "component").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        spread = chosen.join(chunks_, "component").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("tile <> home")
        spread = spread.withColumns({"home": F.lit(-1), "chunk": F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int")})
        return written(task_links(base.unionByName(spread), t))

    def labelled(links: DataFrame) -> DataFrame:
        parts = components(links).withColumnRenamed("component", "part")
        return written(own.join(parts, own["cid"] == parts["id"], "left").drop("id").withColumn("part", F.coalesce("part", "cid")).drop("shingles"))

    within = written(task_links(own.withColumn("chunk", F.lit(0)), t))
    parts = labelled(within)
    heads = parts.groupBy("component", "tile", "part").agg(F.min("cid").alias("cid"), F.count("*").alias("n")).filter("n > 1").select("cid")
    links = within.unionByName(probed(own.join(heads, "cid", "left_semi")))
    parts = labelled(links)
    largest = parts.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("part"))
    left = parts.join(bounded(largest, n), ["component", "part"], "left_anti").select("cid")
    return links.unionByName(probed(own.join(left, "cid", "left_semi")))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _id and _key, by which the text of a row is found again; rows that agree in both have one text."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": F.xxhash64(texts(docs))})


def linked_rows(docs: DataFrame, k: int, t: tuple[int, int], tile: int) -> DataFrame:
    """A row for each row of keyed docs: rid (its number), doc_id, _id, _key, n_shingles, root (the number that stands for
    its component; null for the empty set) and component_id (the component's smallest doc_id)."""
    docs = docs.select("doc_id", "_id", "_key", "text")
    columns = f"doc_id {dict(docs.dtypes)['doc_id']}, _id long, _key long, n_shingles long, digest binary, keys array<long>, g int"
    outline = written(docs.mapInArrow(outlined(k, t), columns).withColumn("rid", F.monotonically_increasing_id()))
    n = outline.count()
    # equal sets are one: the row with the smallest number stands for them
    classes = written(outline.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least"), F.count("*").alias("n")))
    members = outline.filter("digest is not null")
    later = written(spread_join(members.select("rid", "digest"), classes.filter("n > 1").select("digest", "cid", "n"), "digest", "n", n).filter("rid <> cid").select("rid"))
    known = members.join(bounded(later, later.count()), "rid", "left_anti")
    total = known.agg(F.sum(F.size("keys"))).first()[0] or 0
    keys = known.select(F.col("rid").alias("cid"), "g", F.explode("keys").alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    own = spread_join(keys, counts, "key", "df", total).groupBy("cid").agg(F.min("g").alias("g"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys")).filter("size(keys) >= g")
    rare = written(own.select("cid", F.explode(F.slice("keys", F.lit(1), F.size("keys") - F.col("g") + 1)).alias("_k")).select("cid", "_k.key"))
    shared = rare.groupBy("key").agg(F.min("cid").alias("m"), F.max("cid").alias("_last"), F.count("*").alias("_n")).filter("m < _last")
    star = spread_join(rare, shared, "key", "_n", rare.count()).filter("cid <> m").select(F.col("cid").alias("a"), F.col("m").alias("b")).distinct()
    near = written(components(star).select(F.col("id").alias("cid"), "component"))  # where links can be
    n_near = near.count()
    wanted = outline.select(F.col("rid").alias("cid"), "_id", "_key").join(bounded(near, n_near), "cid")
    sets = written(docs.join(bounded(wanted, n_near), ["_id", "_key"]).select("cid", "component", "text").mapInArrow(listed(k), "cid long, component long, shingles binary"))
    if sets.count() > n_near:  # rows alike in id and text
        sets = written(sets.dropDuplicates(["cid"]))
    sizes = sets.groupBy("component").agg((F.sum(F.octet_length("shingles")) / 8).alias("s"))
    tiles = written(sizes.filter(F.col("s") > tile).select("component", F.ceil(F.col("s") / tile).cast("int").alias("tiles")))
    n_large = tiles.count()
    small = sets.join(bounded(tiles.select("component"), n_large), "component", "left_anti") if n_large else sets
    links = task_links(small.withColumns({"tile": F.lit(0), "chunk": F.lit(0), "home": F.lit(0)}), t)
    if n_large:
        links = links.unionByName(large_group_links(sets, tiles, n_large, t, tile))
    reached = components(links).join(classes.select(F.col("cid").alias("id"), "least"), "id")
    best = reached.groupBy("component").agg(F.min("least").alias("best"), F.count("*").alias("_n"))
    named = spread_join(reached, best, "component", "_n", n_near).select(F.col("id").alias("cid"), F.col("component").alias("root"), "best")
    of_class = classes.join(named, "cid", "left").select("digest", "n", F.coalesce("root", "cid").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("best")).alias("component_id"))
    front = ["rid", "doc_id", "_id", "_key", "n_shingles"]
    rows = spread_join(members.select(*front, "digest"), of_class, "digest", "n", n).select(*front, "root", "component_id")
    empty = outline.filter("digest is null").select(*front, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(empty)


def jaccard_components(docs: DataFrame, k: int = 4, t: tuple[int, int] = (85, 100), tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for each row of docs (doc_id and text)."""
    return linked_rows(keyed(docs.select("doc_id", "text")), k, t, tile).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, k: int = 5, t: tuple[int, int] = (80, 100), tile: int = TILE) -> DataFrame:
    """One row of each component of docs: that of the smallest doc_id, whole rows and columns as they are."""
    inner, back = apart(docs, "doc_id", "text")
    inner = keyed(inner)
    rows = written(linked_rows(inner, k, t, tile).filter("root is not null").select("rid", "_id", "_key", "root", "doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("rid").alias("c")))
    stays = written(rows.groupBy("root").agg(first.getField("c").alias("rid"), F.count("*").alias("n")).filter("n > 1").select("rid", "root"))
    gone = rows.join(stays.select("root", F.col("rid").alias("_stays")), "root").filter("rid <> _stays")
    gone = written(gone.select("_id", "_key").distinct())
    # a row that stays can be alike in id and text to rows that go: of these one is left
    twins = written(gone.join(rows.join(stays.select("rid"), "rid", "left_semi").select("_id", "_key"), ["_id", "_key"], "left_semi"))
    n_gone, n_twins = gone.count(), twins.count()
    out = inner.join(bounded(gone, n_gone), ["_id", "_key"], "left_anti")
    if n_twins:
        out = out.unionByName(inner.join(bounded(twins, n_twins), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]))
    return out.select(*back)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT DISTINCT x AS r, x AS t FROM e UNION SELECT c.r, e.y FROM c JOIN e ON c.t = e.x),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.t GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
