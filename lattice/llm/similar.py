"""SimHash groups of texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

A text's SimHash over its distinct five-word shingles has ``BITS`` bits here. At a Jaccard similarity of 0.8 two of them differ in some 39
bits and at most in ``WIDE`` with a chance above 0.9999; unrelated ones differ in some 128. Every shard of fingerprints has a
BK-tree that is searched within ``WIDE``, and each hit is checked by its whole sets of shingles.

Blocks of bits can't make the shards: a radius of 73 in 256 bits leaves pigeonhole blocks of under 4 bits, which is a comparison of
all pairs. So a shard holds the texts that agree in one of ``BANDS`` bands of ``ROWS`` minima of the same shingle hashes; a pair
at the threshold shares no shard with a chance of (1 - 0.8 ** ROWS) ** BANDS = 5e-6.

A shard may hold a third of all rows, so the search goes from cheap to full, and texts that are already in one group aren't
compared again. First the least text of a shard, its tree's root, is compared with the whole shard in a join. Then the
trees of the shards that still hold several groups are searched; a task has the sets of its texts, checks the hits at
once and returns only the links that join groups, never the pairs. A large shard is cut by the size of its sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm.simhash import BKTree, Forest, bit_counts, deal, dealt_groups
from lattice.llm.words import map_docs, raw
from lattice.operators.components import connected_components
from lattice.plans.materialize import bounded_broadcast, discard, heavy_keys, lookup_join, materialize

#: Words in a shingle, least similarity as a fraction, bands and minima per band.
SHINGLE, SIMILAR, BANDS, ROWS = 5, (4, 5), 40, 6
#: Bits of a fingerprint, radius of the search of the trees.
BITS, WIDE = 256, 73
#: Shingles whose minima and bits are taken at once, also hits that are checked at once; links in one batch.
CHUNK, HELD = 1 << 11, 1 << 16
#: Most shingles in one tree, 32 MB; what a row costs beyond its shingles.
SETS, ROW = 1 << 22, 100
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32, False) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32, False)
_SALT = _RANDOM.integers(0, 1 << 64, (1, BITS // 64), np.uint64, False)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles; a shorter text is one shingle, also an empty one."""
    words = text.lower().split()
    k = max(1, min(size, len(words)))
    digests = b"".join([xxhash.xxh64_digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(k)), strict=False)]) or xxhash.xxh64_digest(b"", 42)
    return np.unique(np.frombuffer(digests, np.int64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band: the shards of a text."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max)
    high = (hashes.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), CHUNK):
        least = np.minimum(least, (high[at : at + CHUNK] * _TIMES + _PLUS).min(axis=1))
    flat, width = least.astype(np.uint32).tobytes(), 4 * ROWS
    return [int.from_bytes(xxhash.xxh64_digest(flat[i * width : (i + 1) * width], i), "big", signed=True) for i in range(BANDS)]


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes as signed 64-bit words; each hash is mixed once for every word."""
    counts = 0
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at : at + CHUNK].view(np.uint64)[:, None] ^ _SALT
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        counts = counts + bit_counts(mixed ^ (mixed >> np.uint64(31)))
    return np.packbits(counts * 2 > len(hashes)).view(np.int64).tolist()


def _signature(doc_id: int | None, key: int, text: bytes) -> tuple:
    own = shingles(text)
    return doc_id, key, len(own), wide_fingerprint(own), bands(own)


class _Trees:
    """Rows (shard, part, side, key, grp, size, fp, shingles), sorted by shard and part: links (u, v) that join groups."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in dealt_groups(batches):
            found += self.links(group)
            if len(found) >= HELD:
                yield self.rows(found)
                found = []
        yield self.rows(found)

    def rows(self, found: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    def links(self, rows: pa.Table) -> Iterator[tuple[int, int]]:
        side, keys, group = (rows[c].to_numpy() for c in ("side", "key", "grp"))
        tree = np.flatnonzero(side == 0).tolist()
        queries = np.flatnonzero(side == 1).tolist() or tree
        if not tree or group.min() == group.max():
            return
        words = _flat(rows["fp"])[1].tobytes()
        width = BITS // 8
        values = [int.from_bytes(words[i : i + width], "little") for i in range(0, len(words), width)]
        edges, shingled = _flat(rows["shingles"])
        size = np.diff(edges)
        place = {g: i for i, g in enumerate(np.unique(group).tolist())}
        forest, of = Forest(len(place)), [place[g] for g in group.tolist()]
        members: dict[int, list[int]] = {}
        for t in tree:
            members.setdefault(values[t], []).append(t)
        bk, again, nodes = BKTree(list(members)), 32, list(members.values())
        single = bk.whole(_roots(nodes, of, forest))
        over, under = SIMILAR
        for n, q in enumerate(queries):
            if n == again:
                single, again = bk.whole(_roots(nodes, of, forest)), 2 * again
            own = forest.find(of[q])
            near = (t for node in bk.search(values[q], WIDE, lambda x: single[x] >= 0 and forest.find(single[x]) == own) for t in nodes[node])  # noqa: B023
            hits = [t for t in near if forest.find(of[t]) != own and under * min(size[t], size[q]) >= over * max(size[t], size[q])]
            mine = shingled[edges[q] : edges[q + 1]]
            for part in (hits[i : i + CHUNK] for i in range(0, len(hits), CHUNK)):
                theirs = np.concatenate([shingled[edges[t] : edges[t + 1]] for t in part])
                same = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                common = np.add.reduceat(same, np.concatenate(([0], np.cumsum(size[part])[:-1])))
                for i in np.flatnonzero(under * common >= over * (size[part] + size[q] - common)).tolist():
                    t = part[i]
                    if forest.find(of[t]) != forest.find(of[q]):
                        forest.link(of[t], of[q])
                        yield max(int(keys[t]), int(keys[q])), min(int(keys[t]), int(keys[q]))


def _roots(nodes: list[list[int]], of: list[int], forest: Forest) -> list[int]:
    """The root of each node's texts, or -1 where they have several."""
    roots = ({forest.find(of[t]) for t in texts} for texts in nodes)
    return [r.pop() if len(r) == 1 else -1 for r in roots]


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The edges and the values of a column of lists of longs."""
    size = np.concatenate([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists.chunks])
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks])
    return np.concatenate(([0], np.cumsum(size))), values


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets reach the similarity."""
    heavy = heavy_keys(pairs.groupBy("v").agg(F.count("*").alias("n")), "v", "n")
    left = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u")
    both = lookup_join(left, sets.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v", heavy)
    common, (over, under) = F.size(F.array_intersect("a", "b")), SIMILAR
    return materialize(both.filter(under * common >= over * (F.size("a") + F.size("b") - common)).select("u", "v"))


def _distance(a: str, b: str) -> Column:
    return reduce(Column.__add__, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)))


def components(signed: DataFrame, texts: DataFrame, held: int = SETS) -> DataFrame:
    """(node, component) of the texts with a similar one; ``signed`` has (key, n, fp, bands), ``texts`` (key, text) with repeats."""
    rows = signed.select("key", F.explode("bands").alias("shard"))
    shards = materialize(rows.groupBy("shard").agg(F.min("key").alias("hub"), F.max("key").alias("top")).filter("hub < top").select("shard", "hub"))
    shared = materialize(rows.join(bounded_broadcast(shards), "shard").distinct())
    named = materialize(shared.select("key").distinct())
    ends = bounded_broadcast(named)
    some = texts.join(ends, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = materialize(map_docs(some, [F.col("key"), F.col("text")], "key long, shingles array<long>", lambda k, t: (k, shingles(t))))
    prints = materialize(signed.join(ends, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("fp").alias("fp")))
    of = lambda end: prints.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("fp").alias(f"fp_{end}"))
    over, under = SIMILAR
    could = under * F.least("n_u", "n_v") >= over * F.greatest("n_u", "n_v")
    star = shared.filter("key != hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()  # a hub is the least: u > v
    star = materialize(star.join(of("u"), "u").join(of("v"), "v").filter(could & (_distance("fp_u", "fp_v") <= WIDE)).select("u", "v"))
    near = similar(star, sets)
    group = materialize(connected_components(near))
    placed = shared.join(bounded_broadcast(group.withColumnRenamed("node", "key")), "key", "left").select("shard", "key", F.coalesce("component", "key").alias("grp"))
    mixed = materialize(placed.groupBy("shard").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).filter("a < b").select("shard"))
    placed = placed.join(bounded_broadcast(mixed), "shard", "left_semi").join(prints, "key")
    whole = deal(placed.select("shard", "key", "grp", (F.col("n") + ROW).alias("size"), "fp"), "key", held, "size", sets)
    more = materialize(whole.mapInArrow(_Trees(), "u long, v long").distinct())
    if not more.isEmpty():
        first, group = group, materialize(connected_components(near.unionByName(more)))
        discard(first)
    for table in (shards, shared, named, sets, prints, star, near, mixed, more):
        discard(table)
    return group


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = SETS) -> DataFrame:
    """(doc_id, key, root, component_id): a row for each row of ``docs``.

    key is the hash of the text, root names its group and component_id is the smallest doc_id of the group. Null, empty and blank
    texts are one group. A null doc_id keeps its row and never names a group unless all its members are null. Repeated rows are rows
    of their own; very long texts are taken whole. Other columns are ignored; an empty table gives no rows.
    """
    columns = [F.col(id_col).cast("long"), text_key(text_col), raw(text_col)]
    signed = materialize(map_docs(docs, columns, "doc_id long, key long, n long, fp array<long>, bands array<long>", _signature))
    least = materialize(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(signed.select("key", "n", "fp", "bands"), docs.select(columns[1].alias("key"), columns[2].alias("text")), held)
    component = found.select(F.col("node").alias("key"), F.col("component").alias("root"))
    placed = least.join(component, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    table = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "root", "component_id")
    return lookup_join(signed.select("doc_id", "key"), materialize(table), "key", heavy_keys(least, "key", "n"))


def text_key(text_col: str) -> Column:
    """The hash that names a text."""
    return F.xxhash64(raw(text_col))
