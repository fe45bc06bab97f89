"""SimHash near-duplicate groups, searched with BK-trees over pigeonhole shards.

A fingerprint has 64 bits. Cut into ``radius + 1`` blocks, two fingerprints at most ``radius`` bits apart
agree in at least one whole block, so every link lies inside a shard keyed by (block, value of the block). Each shard
becomes a BK-tree (children keyed by their integer Hamming distance to the parent); a search follows only edges within
the radius of the distance to the parent. Only distinct fingerprints enter, so a group of exact copies is one node.

Trees are dealt to tasks by a shuffle on the shard instead of a broadcast of all trees: all trees together grow
with the corpus, and a broadcast must have a bound. A shard above ``tree_rows`` fingerprints is cut into sub-shards; each
sub-shard's bounded tree is sent to the queries of all sub-shards of that shard, in blocks, so memory stays bounded.

Each shard returns a spanning forest of its links, never all pairs: a subtree whose nodes already share the
query's component is skipped. Components over the forests are those over all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import map_docs, raw
from lattice.operators.components import connected_components
from lattice.plans.materialize import bounded_broadcast, discard, heavy_keys, lookup_join, materialize

RADIUS = 3
#: Most fingerprints in one tree; some 20 MB of Python objects.
TREE_ROWS = 1 << 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a text: bit set where over half of the shingle hashes have it set."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    counts, total = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        digests = b"".join([xxhash.xxh64_digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(k)), strict=False)])
        counts += bit_counts(np.frombuffer(digests, np.uint64)[:, None])
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words have each bit, in order of bytes, highest bit first."""
    width = hashes.shape[1] * 8
    index = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, width) + np.arange(width, dtype=np.int64) * 256
    return (np.bincount(index.ravel(), minlength=width * 256).reshape(width, 256) @ _BITS).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a row for each row of ``docs``; a null or blank text has fingerprint 0."""
    return map_docs(docs, [F.col(id_col).cast("long"), raw(text_col)], "doc_id long, fp long", lambda i, t: (i, fingerprint(t)))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class BKTree:
    """A BK-tree of distinct integers under Hamming distance."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for at in range(1, len(values)):
            x, node = values[at], 0
            while (nxt := self.children[node].get(d := (values[node] ^ x).bit_count())) is not None:
                node = nxt
            self.children[node][d] = at

    def whole(self, roots: list[int]) -> list[int]:
        """For each node the root of its whole subtree, or -1 where it has several; ``roots`` has each node's own root, or -1."""
        out = list(roots)
        for at in range(len(out) - 1, -1, -1):  # children come after their parents
            for child in self.children[at].values():
                if out[child] != out[at]:
                    out[at] = -1
                    break
        return out

    def search(self, x: int, radius: int, known: Callable[[int], bool]) -> Iterator[int]:
        """Nodes within the radius of ``x``; a node that is ``known`` is left out with its subtree."""
        stack = [0]
        while stack:
            node = stack.pop()
            if known(node):
                continue
            d = (self.values[node] ^ x).bit_count()
            if d <= radius:
                yield node
            stack += [c for e, c in self.children[node].items() if d - radius <= e <= d + radius]


def shard_links(tree: list[int], queries: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``tree`` and ``queries``, both distinct; equal lists are one shard."""
    same = queries is tree
    values = tree if same else [*tree, *queries]
    forest, n, again = Forest(len(values)), len(tree), 32
    bk, find = BKTree(tree), forest.find
    single = bk.whole(list(range(n)))
    for k, x in enumerate(queries):
        if k == again:
            single, again = bk.whole([find(i) for i in range(n)]), 2 * again
        me = k if same else n + k
        for node in bk.search(x, radius, lambda node: single[node] >= 0 and find(single[node]) == find(me)):  # noqa: B023
            forest.link(me, node)
    return [(values[i], values[r]) for i in range(len(values)) if (r := find(i)) != i]


class _Shards:
    """Rows (shard, part, side, fp), sorted; part -1 is a whole shard, side 0 the tree and 1 its queries."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            if not columns.shape[1]:
                continue
            key = columns[:2]
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and (held[0][:2, 0] != key[:, 0]).any():
                yield self.links([np.concatenate(held, axis=1)])
                held = []
            parts = np.split(columns, edges, axis=1) if len(edges) else [columns]
            if len(parts) > 1:
                first = np.concatenate([*held, parts[0]], axis=1)
                yield self.links([first, *parts[1:-1]])
                held = [parts[-1]]
            else:
                held.append(columns)
        if held:
            yield self.links([np.concatenate(held, axis=1)])

    def links(self, groups: list[np.ndarray]) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        for g in groups:
            if g.shape[1] > 1:
                fps, side = g[3].view(np.uint64), g[2]
                tree, queries = fps[side == 0].tolist(), fps[side == 1].tolist()
                out += shard_links(tree, queries or tree, self.radius) if tree else []
        ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])


def deal(rows: DataFrame, by: str, most: int = TREE_ROWS, weight: str | None = None, more: DataFrame | None = None) -> DataFrame:
    """Rows (shard, ...) grouped and sorted by shard and part, with part and side after the shard; ``by`` tells the rows of a shard apart.

    Part -1 is a whole shard. A shard of over ``most`` rows, or of more than that in the sum of ``weight``, is cut: sub-shard i is the
    tree (side 0) of parts (i, i..cuts-1) and the queries (side 1) of parts (0..i-1, i), so that every two sub-shards meet once and
    no task holds more than two of them. Columns of ``more`` are joined by ``by`` at the end.
    """
    others, size = [c for c in rows.columns if c != "shard"], F.sum(weight) if weight else F.count("*")
    large = rows.groupBy("shard").agg(size.alias("size")).filter(F.col("size") > most).select("shard", F.ceil(F.col("size") / most).cast("long").alias("cuts"))
    large = materialize(large)
    out = rows.select("shard", F.lit(-1).cast("long").alias("part"), F.lit(0).alias("side"), *others)
    if not large.isEmpty():
        large = bounded_broadcast(large)
        out = out.join(large, "shard", "left_anti")
        cut = rows.join(large, "shard").withColumn("own", F.pmod(F.xxhash64(by), "cuts"))
        tree = cut.select("shard", F.explode(F.expr("transform(sequence(own, cuts - 1), j -> own * cuts + j)")).alias("part"), F.lit(0).alias("side"), *others)
        query = cut.filter("own > 0").select("shard", F.explode(F.expr("transform(sequence(0L, own - 1), i -> i * cuts + own)")).alias("part"), F.lit(1).alias("side"), *others)
        out = out.unionByName(tree).unionByName(query)
    if more is not None:
        out = out.join(more, by).select("shard", "part", "side", *others, *(c for c in more.columns if c != by))
    return out.repartition("shard", "part").sortWithinPartitions("shard", "part")


def dealt_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard and part of a dealt table."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(2)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if held and now != tuple(key[:, a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            now = tuple(key[:, a])
    if held:
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp), spanning the components of all links."""
    edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
    keys = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1) * (radius + 1) + i for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp")
    return deal(rows, "fp", tree_rows).mapInArrow(_Shards(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, itself included. Null, empty and
    blank texts have fingerprint zero and link like any other. A null doc_id keeps its row and never names a group unless
    all its members are null. Repeated rows are rows of their own; very long texts are taken whole. Other columns are ignored; an empty
    table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col))
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = materialize(links(least.select("fp"), radius, tree_rows))
    component = materialize(connected_components(edges))
    discard(edges)
    member = component.withColumnRenamed("node", "fp").join(least.select("fp", "least"), "fp")
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = component.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    table = materialize(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = lookup_join(fps, table, "fp", heavy_keys(least, "fp", "n"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    Groups are those of ``similar_groups``: five-word shingles with a Jaccard similarity of at least 0.8, found by wider fingerprints, as
    the 3 of 64 bits of :func:`near_duplicates` miss most of these.
    The row with the smallest id of its group stays; of rows of a group that repeat that id, the one with the least text.
    Rows of different groups under one id are decided apart. Rows with a null id can't be named by a decision and stay.
    """
    from lattice.llm.similar import similar_groups, text_key

    found = materialize(similar_groups(docs, id_col, text_col))
    named = [F.col("doc_id").alias(id_col), F.col("key").alias("_lattice_key")]
    on = [id_col, "_lattice_key"]
    dropped = found.filter("doc_id != component_id").select(*named).distinct()
    out = docs.withColumn("_lattice_key", text_key(text_col)).join(bounded_broadcast(dropped), on, "left_anti")
    first = found.filter("doc_id = component_id")
    again = materialize(first.groupBy("doc_id", "root").count().filter("count > 1").select("doc_id", "root"))
    if again.isEmpty():
        return out.select(*docs.columns)
    again = materialize(first.join(bounded_broadcast(again), ["doc_id", "root"], "left_semi").select(*named, F.col("root").alias("_lattice_root")).distinct())
    again = bounded_broadcast(again)
    tagged = out.join(again, on).withColumn("_lattice_row", F.struct(F.col(text_col), F.xxhash64(*docs.columns)))
    least = tagged.groupBy(id_col, "_lattice_root").agg(F.min("_lattice_row").alias("_lattice_least"))
    one = tagged.join(bounded_broadcast(materialize(least)), [id_col, "_lattice_root"]).filter(F.col("_lattice_row").eqNullSafe(F.col("_lattice_least")))
    return out.join(again, on, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns).dropDuplicates())
