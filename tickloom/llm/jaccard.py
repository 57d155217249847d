"""N-gram Jaccard join: count-vector R-trees find candidate pairs, exact set comparison decides.

A document's set of shingles is a point whose coordinates are the counts of its shingles in GROUPS hashed groups; the
overlap of two sets is at most the sum of the coordinates' minima, and for two boxes of an R-tree at most that of
their highest corners. In one tree over all points that bound alone can't keep unrelated documents apart (their counts
look alike), so the points are first dealt out by the shingles that linked sets must share: in any fixed order, two
sets of similarity t have one of their first n - ceil(t n) + 1 shingles in common. Those who share such a shingle form
a group, and groups led by the same member (the one that shares most) one forest of R-trees.

All pairs of a group are searched in its R-trees. The pairs that the bounds leave join members to clusters of possible
links; then each cluster's sets are brought together, once each, and the pairs that an R-tree leaves are compared by
their whole sets. Pairs that are joined already are passed over, and only links that join two parts are returned,
fewer than there are members. So output and shuffle follow the members, not their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import (
    SHINGLE, SIMILARITY_PERCENT, components, documents_of, each_text, frequent_shingles, giving_back, identity, in_map, is_in, key_map,
    map_bits, records, runs, shingles, signed, stored,
)

#: Coordinates of the R-tree's boxes, and least and most of the points in its leaves: one for two shingles, as a power
#: of two. Neighbouring coordinates add up to those of fewer groups.
GROUPS, FINE = 64, (256, 16384)
#: Rows of a leaf; members and shingles of a page: what one task holds at a time.
LEAF, PAGE, PAGE_SHINGLES = 32, 4096, 8_000_000

_SPREAD = np.uint64(0xD1342543DE82EF95)


def shingle_set(h: np.ndarray) -> np.ndarray:
    return np.unique(shingles(h, SHINGLE))


def width(n: int) -> int:
    """Coordinates of the point of a set of n shingles."""
    return min(max(1 << (max(n, 1) // 2).bit_length(), FINE[0]), FINE[1])


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles in width(n) groups."""
    groups = width(len(s))
    counts = np.bincount((s * _SPREAD >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if len(s) < 256 or counts.max() < 256 else np.uint32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point if len(point) == groups else point.reshape(groups, -1).sum(axis=1, dtype=np.uint32)


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which linked sets share one: the first in the order (frequent last, then by hash)."""
    n = len(s)
    length = n - (percent * n + 99) // 100 + 1
    often = is_in(s, frequent)
    return np.concatenate((s[~often], s[often]))[:length]


class Box:
    """A node of an R-tree over count vectors: halves along the widest coordinate down to leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, members: np.ndarray):
        p = points[members]
        self.high, self.members, self.parts = p.max(axis=0).astype(np.int64), members, ()
        self.smallest, self.largest = int(sizes[members].min()), int(sizes[members].max())
        if len(members) > LEAF:
            order = members[np.argsort(p[:, int((self.high - p.min(axis=0)).argmax())], kind="stable")]
            half = len(order) // 2
            self.parts = Box(points, sizes, order[:half]), Box(points, sizes, order[half:])


class Group:
    """Points, and the part (a number) that each belongs to so far. Pairs whose bounds allow a link join their parts;
    with the sets themselves, only true links do, and links has those that joined two parts."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, parts: np.ndarray, percent: int, sets: list[np.ndarray] | None = None):
        self.sizes, self.part, self.percent, self.sets = sizes, parts.copy(), percent, sets
        self.points = np.array([folded(p, GROUPS) for p in points]).astype(np.int64)
        self.width = np.array([len(p) for p in points])
        # for each width the points that have as many coordinates or more, with so many
        self.fine = {w: np.array([folded(p, w) if len(p) >= w else np.zeros(w, p.dtype) for p in points]) for w in np.unique(self.width)}
        self.links: list[tuple[int, int]] = []

    def fit(self, overlap: np.ndarray, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        """Whether so large an overlap is enough for a link."""
        return (100 + self.percent) * overlap >= self.percent * (self.sizes[i] + self.sizes[j])

    def bounded(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Whether the sums of the coordinates' minima are enough for a link."""
        i, j = np.broadcast_arrays(i, j)
        most, at = np.zeros(len(j), np.int64), np.minimum(self.width[i], self.width[j])
        near = 100 * np.minimum(self.sizes[i], self.sizes[j]) >= self.percent * np.maximum(self.sizes[i], self.sizes[j])
        for w in np.unique(at[near]):
            some = np.flatnonzero(near & (at == w))
            for k in range(0, len(some), 2048):
                x = some[k : k + 2048]
                most[x] = np.minimum(self.fine[w][i[x]], self.fine[w][j[x]]).sum(axis=1, dtype=np.int64)
        return near & self.fit(most, i, j)

    def join(self, i: int, others: np.ndarray) -> None:
        """Joins the parts of i and of those of the others, all within the bounds, that it is linked with."""
        others = others[self.part[others] != self.part[i]]
        if not len(others):
            return
        if self.sets is not None:
            hit = is_in(np.concatenate([self.sets[j] for j in others]), self.sets[i])
            shared = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(self.sizes[others])[:-1])))
            others = others[self.fit(shared, i, others)]
        joined, first = np.unique(self.part[others], return_index=True)
        self.links += [(i, int(j)) for j in others[first]]
        self.part[np.isin(self.part, joined)] = self.part[i]

    def search(self, first: int, one: np.ndarray, other: np.ndarray | None = None) -> None:
        """All pairs within one (those with the member first at first), or of one and other, by their R-trees."""
        if other is None:
            self.join(first, one[self.bounded(first, one)])
        if (self.part == self.part[0]).all():
            return
        points = self.points
        root = Box(points, self.sizes, one)
        stack = [(root, root if other is None else Box(points, self.sizes, other))]
        while stack:
            a, b = stack.pop()
            part = self.part[a.members[0]]
            if 100 * a.largest < self.percent * b.smallest or 100 * b.largest < self.percent * a.smallest:
                continue
            if (100 + self.percent) * int(np.minimum(a.high, b.high).sum()) < self.percent * (a.smallest + b.smallest):
                continue
            if (self.part[a.members] == part).all() and (self.part[b.members] == part).all():
                continue
            if a is b and a.parts:
                x, y = a.parts
                stack += [(x, y), (y, y), (x, x)]
            elif a.parts and (not b.parts or len(a.members) >= len(b.members)):
                stack += [(x, b) for x in a.parts]
            elif b.parts:
                stack += [(a, y) for y in b.parts]
            else:
                self._leaves(points, a.members, b.members, a is b)

    def _leaves(self, points: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        most = np.minimum(points[a][:, None, :], points[b][None, :, :]).sum(axis=2)
        both = (100 + self.percent) * most >= self.percent * (self.sizes[a][:, None] + self.sizes[b][None, :])
        both &= self.part[a][:, None] != self.part[b][None, :]
        i, j = np.nonzero(np.triu(both, 1) if same else both)
        i, j = a[i], b[j]
        left = self.bounded(i, j)
        i, j = i[left], j[left]
        for x in np.unique(i):
            self.join(int(x), j[i == x])


def _rows(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """doc_id, text_hash, node (identity of the set; null: empty), n, prefix, and fine, the counts that are the set's point."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("fine", pa.binary())])

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in schema.names}
            doc_ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for i, _, _, _, h in each_text(batch.column("text").to_pylist(), lower=True):
                s = shingle_set(h)
                row = (doc_ids[i], hashes[i], identity(s) if len(s) else None, len(s), signed(prefix(s, frequent, percent)), count_vector(s).tobytes())
                for name, value in zip(schema.names, row):
                    out[name].append(value)
            yield records(schema, out)

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(giving_back(run), "doc_id long, text_hash long, node binary, n long, prefix array<long>, fine binary")


def _members(rows: DataFrame, bitmap: bytes) -> DataFrame:
    """(token, node, share) of the prefix shingles that may be in the bitmap; share: parts of a thousand of the prefix."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.binary()), ("share", pa.int64())])

    def run(batches):
        for batch in batches:
            lists = batch.column("prefix")
            token, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            hit = in_map(token, bitmap)
            share = 1000 * np.bincount(row[hit], minlength=batch.num_rows) // np.maximum(np.diff(ends), 1)
            token, row = token[hit], row[hit]
            for at in range(0, len(row), 200_000):
                r = row[at : at + 200_000]
                yield records(schema, {"token": token[at : at + 200_000], "node": batch.column("node").take(pa.array(r)), "share": share[r]})

    return rows.where("node is not null").select("node", "prefix").mapInArrow(giving_back(run), "token long, node binary, share long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its set x (binary) for the wanted (doc_id, node), made again from these documents' texts."""
    wanted = stored(wanted)
    bitmap = key_map(wanted.withColumn("k", F.xxhash64("doc_id")), "k", map_bits(wanted.count()))
    schema = pa.schema([("node", pa.binary()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").filter(pa.array(in_map(batch.column("k").to_numpy(), bitmap))).to_pylist()
            found = [s for *_, h in each_text(texts, lower=True) if len(s := shingle_set(h))]
            yield records(schema, {"node": [identity(s) for s in found], "x": [s.tobytes() for s in found]})

    # a node's set comes from any of its documents that passes the map; the wanted one always does
    made = docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(giving_back(run), "node binary, x binary")
    return made.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("x").alias("x"))


def _points(column: pa.ChunkedArray, sizes: np.ndarray) -> list[np.ndarray]:
    """Points of sets of these sizes; counts above 255 are stored in more bytes."""
    return [np.frombuffer(x.as_buffer(), np.uint8 if len(x.as_buffer()) == width(int(n)) else np.uint32) for x, n in zip(column, sizes)]


def _edges(tasks: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) that join parts, from tasks of the rows (g, p, q, page, lead, node, part, n, x); possible links,
    where x is a point, and true ones (exact), where it is a set.

    The members of page p of group g are searched among themselves where p = q, and with those of page q otherwise.
    part: a number for each part that the nodes are in already.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for t in runs(batches, "g", "p", "q"):
            part, page, lead = (t[c].to_numpy() for c in ("part", "page", "lead"))
            p, q = (t[c][0].as_py() for c in "pq")
            if (part == part[0]).all() or p != q and (page == page[0]).all():
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["x"]] if exact else None
            n = t["n"].to_numpy()
            group = Group([count_vector(x) for x in sets] if exact else _points(t["x"], n), n, part, percent, sets)
            rows = np.arange(len(part))
            group.search(int(lead.argmax()), *((rows,) if p == q else (np.flatnonzero(page == p), np.flatnonzero(page != p))))
            if group.links:
                node = t["node"]
                yield records(schema, {k: [node[x[i]].as_py() for x in group.links] for i, k in enumerate("ab")})

    count = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.repartition(count, "g", "p", "q").sortWithinPartitions("g", "p", "q").select("g", "p", "q", "page", "lead", "node", "part", "n", "x")
    return stored(dealt.mapInArrow(giving_back(run), "a binary, b binary").distinct())


def _searched(members: DataFrame, payload: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b), as of _edges(), within the groups of the stored members (g, node, n, lead); payload: (node, x).

    A group of more than a page is cut into pages within bands of like sizes (sizes that differ by more than a fourth
    allow no link), each searched with the group's leaders. Pages are searched with each other where their sizes allow
    links and the group is still in several parts.
    """
    if not exact:
        payload = stored(payload)
    sizes = members.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where(f"c > {PAGE} or w > {PAGE_SHINGLES}")
    sizes = stored(sizes.select("g"))
    whole = members if (none := sizes.isEmpty()) else members.join(sizes, "g", "left_anti")
    first = whole.select("g", F.lit(0).alias("page"), "lead", "node", "n")
    if not none:
        band = F.expr(f"CAST(floor(ln(n) / ln({100 / percent})) AS int)")
        large = stored(members.join(sizes, "g", "left_semi").withColumn("band", band))
        bands = large.groupBy("g", "band").agg(F.expr(f"CAST(ceil(greatest(count(*) / {PAGE}, sum(n) / {PAGE_SHINGLES})) AS int)").alias("pages"))
        number = F.expr("band * 100000 + sub")
        pages = stored(bands.select("g", "band", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("sub")).select("g", "band", number.alias("page")))
        paged = large.join(bands, ["g", "band"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("pages")).cast("int"))
        paged = stored(paged.select("g", "lead", "node", "n", "band", number.alias("page")))
        everywhere = paged.where("lead").select("g", "lead", "node", "n").join(pages, "g").select("g", "page", "lead", "node", "n")
        first = first.union(paged.where("not lead").select("g", "page", "lead", "node", "n")).union(everywhere)
    first = first.withColumns({"p": F.col("page"), "q": F.col("page"), "part": F.xxhash64("node")})
    edges = _edges(first.join(payload, "node"), percent, exact)
    if not none:
        at = paged.join(components(edges), "node", "left").withColumn("part", F.xxhash64(F.coalesce("root", "node"))).drop("root")
        split = at.groupBy("g").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a <> _b").select("g")
        other = pages.select("g", F.col("band").alias("_band"), F.col("page").alias("_other"))
        at = stored(at.join(split, "g", "left_semi")).join(other, "g").where("_other <> page and abs(_band - band) <= 1")
        at = at.select("g", F.least("page", "_other").alias("p"), F.greatest("page", "_other").alias("q"), "page", "lead", "node", "part", "n")
        edges = edges.union(_edges(at.join(payload, "node"), percent, exact))
    return edges


def jaccard_components(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each row of docs; and, to tell apart
    rows that share a doc_id, text_hash (Spark's xxhash64 of the text) and component (a name; null without shingles).

    Words are lower-cased in A-Z; a set holds the distinct five-word shingles, or the whole sequence of fewer words.
    Documents are linked where 100 * intersection >= percent * union. Null or empty text: no shingles, no links.
    Repeated rows are rows of one component. Other columns are dropped; empty table: no rows. Null doc_id: a row, with
    the component of its links, or null.
    """
    d = documents_of(docs)
    rows = stored(_rows(d, frequent_shingles(d), percent))
    some = rows.where("node is not null")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    shared = some.select(F.explode("prefix").alias("token"), F.xxhash64("node").alias("half"))
    shared = shared.groupBy("token").agg(F.min("half").alias("_first"), F.max("half").alias("_last")).where("_first <> _last").select("token")
    shared = stored(shared)
    members = _members(rows, key_map(shared, "token", map_bits(shared.count()))).join(shared, "token")
    # the leader of a group is known by a number that holds its share and a part of its hash
    rank = F.expr("shiftleft(share, 50) | (xxhash64(node) & 1125899906842623L)")
    members = stored(members.groupBy("token", "node").agg(F.max("share").alias("share")).select("token", "node", rank.alias("rank")))
    led = members.groupBy("token").agg(F.max("rank").alias("g"))
    members = members.join(led, "token").select("g", "node", (F.col("rank") == F.col("g")).alias("lead")).distinct().join(nodes, "node")
    members = stored(members.select("g", "node", "n", "lead", "doc_id"))
    wanted = members.groupBy("node", "doc_id").agg(F.max("lead").alias("lead"), F.max("n").alias("n"))
    wanted = stored(wanted)
    # of rows with the same set, that of the node's document has its point
    points = rows.select("node", "doc_id", F.col("fine").alias("x")).withColumnRenamed("doc_id", "_id").join(wanted.select("node", "doc_id"), "node", "inner")
    points = points.where(F.col("_id").eqNullSafe(F.col("doc_id"))).groupBy("node").agg(F.first("x").alias("x"))
    clusters = components(_searched(members, points, percent, exact=False))
    clusters = stored(clusters.join(wanted, "node").select(F.xxhash64("root").alias("g"), "node", "n", "lead", "doc_id"))
    edges = _searched(clusters, _sets(d, clusters.select("doc_id", "node")), percent, exact=True)
    roots = components(edges)
    placed = rows.select("doc_id", "text_hash", "node", "n").join(roots, "node", "left").select("doc_id", "text_hash", "n", F.coalesce("root", "node").alias("root"))
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", F.hex("root").alias("component"))
