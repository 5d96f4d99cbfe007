"""SimHash near-duplicates by BK-trees over shards of fingerprints.

Fingerprints within ``radius`` bits agree on all but ``radius`` of any number of blocks of bits
(there cannot be more differing blocks than differing bits), so the distinct fingerprints
are dealt into one shard for each choice of that many blocks and their value.  Up to some 100
million fingerprints there are ``radius + 1`` blocks, beyond that more, so that shards stay small.  A shard's tree is a BK-tree:
children are keyed by their integer Hamming distance to the parent, and a search follows
only edges whose key is within the radius of the query's distance.  A shard with more than
``tree_size`` fingerprints is cut into several trees; its fingerprints go to each of them as
queries, in blocks, so that no tree or task grows with a hot block value.  The trees go to
the tasks that hold their queries by key instead of to all tasks: together they hold every
fingerprint, so a broadcast of all of them would grow with the table.

Within a task, links are reduced to a spanning forest at once, so dense groups of copies
never emit all pairs.  Identical fingerprints are one node from the start.

Nulls and texts without words have fingerprint zero and link like any other.  Null ids
take part, but a component is named by its least non-null id (null if it has none).
Repeated rows give repeated results; very long texts are hashed as a whole.  An empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from waymark.llm.arrow import derive
from waymark.llm.components import components
from waymark.llm.scratch import materialize

#: Fixed values of the contract: seed of the shingle hash; A-Z to a-z, nothing else.
SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the unsigned XXH64 of every shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    n = len(words) - shingle + 1
    hashes = np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64, n)  # noqa: B905
    counts = np.zeros(64, np.int64)
    for part in range(0, n, 4096):
        counts += np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist())


class Forest:
    """BK-trees of many shards, built and searched together, one level at a time.

    ``shard`` numbers the tree of each value; values are inserted in the order given, as if
    one by one: the first of a tree is its root, and the first value to arrive at a free
    edge (parent, distance) becomes that child.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        n = len(values)
        roots, first = np.unique(shard, return_index=True)
        self.shards, self.roots = roots, first
        edge_keys, edge_nodes = [], []
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        parent = first[np.searchsorted(roots, shard[waiting])]
        while len(waiting):
            d = np.bitwise_count(values[waiting] ^ values[parent]).astype(np.int64)
            keys, at = np.unique(parent * 128 + d, return_index=True)  # the first of equal keys comes first in the input
            edge_keys.append(keys)
            edge_nodes.append(waiting[at])
            child = waiting[at][np.searchsorted(keys, parent * 128 + d)]
            stays = child != waiting
            waiting, parent = waiting[stays], child[stays]
        keys = np.concatenate(edge_keys) if edge_keys else np.empty(0, np.int64)
        nodes = np.concatenate(edge_nodes) if edge_nodes else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_nodes = keys[order], nodes[order]

    def near(self, queries: np.ndarray, shard: np.ndarray, radius: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, value index) within the radius, in blocks."""
        at = np.searchsorted(self.shards, shard)
        known = (at < len(self.shards)) & (self.shards[np.minimum(at, len(self.shards) - 1)] == shard)
        stack = [(part, self.roots[at[part]]) for part in np.array_split(np.flatnonzero(known), known.sum() // block + 1)]
        while stack:
            query, node = stack.pop()
            if not len(query):
                continue
            d = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edge_keys, node * 128 + np.maximum(d - radius, 0), side="left")
            high = np.searchsorted(self.edge_keys, node * 128 + d + radius, side="right")
            counts = high - low
            edges = np.cumsum(counts)
            for begin in range(0, int(edges[-1]) if len(edges) else 0, block):
                end = min(begin + block, int(edges[-1]))
                i = np.searchsorted(edges, np.arange(begin, end), side="right")
                stack.append((query[i], self.edge_nodes[low[i] + np.arange(begin, end) - (edges[i] - counts[i])]))


def spanning(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Least index reachable for each of ``n`` nodes over links a-b (and earlier roots)."""
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by task; each task holds the tree values (role 0) and query values (role 1) of one or two sub-shards."""

    def run(task: np.ndarray, fp: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
        _, task = np.unique(task, return_inverse=True)
        tree, query = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        root = np.arange(len(fp))
        values = fp.view(np.uint64)
        forest = Forest(values[tree], task[tree])
        for q, v in forest.near(values[query], task[query], radius):
            root = spanning(len(fp), query[q], tree[v], root)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["a", "b"])

    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < 200_000:
            continue
        table = pa.concat_tables(held)
        task = table["task"].to_numpy()
        whole = int(np.searchsorted(-(task == task[-1]).astype(int)[::-1], 0)) if task[0] != task[-1] else len(task)
        keep = len(task) - whole
        if keep:
            yield run(task[:keep], table["fp"].to_numpy()[:keep], table["role"].to_numpy()[:keep])
        held, rows = [table.slice(keep)], whole
    if rows:
        table = pa.concat_tables(held)
        yield run(table["task"].to_numpy(), table["fp"].to_numpy(), table["role"].to_numpy())


def _masks(radius: int, blocks: int) -> list[int]:
    """Bits of every choice of ``blocks - radius`` of the blocks: within the radius, two fingerprints agree on one choice."""
    width, spare = divmod(64, blocks)
    cuts = [(k * width + min(k, spare), width + (k < spare)) for k in range(blocks)]
    block = [((1 << w) - 1) << s for s, w in cuts]
    return [sum(chosen) for chosen in combinations(block, blocks - radius)]


def blocks_for(n: int, radius: int, tree_size: int) -> int:
    """Number of blocks whose choices keep the expected shard of ``n`` fingerprints below a tree."""
    for extra in range(1, 4):
        bits = 64 * extra // (radius + extra)
        if n <= tree_size << bits:
            return radius + extra
    return radius + 4


def link_fingerprints(fps: DataFrame, *, radius: int = 3, tree_size: int = 2048, blocks: int | None = None) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in column fp (long) that lie within ``radius`` bits.

    ``blocks`` is chosen by the number of fingerprints if it is not given: links are the same, shards smaller.
    """
    if blocks is None:
        blocks = blocks_for(fps.count(), radius, tree_size)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in _masks(radius, blocks)])
    placed = fps.select("fp", F.posexplode(keys).alias("block", "key"))
    sizes = placed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / tree_size).cast("int"))
    sized = placed.join(sizes, ["block", "key"])
    part = F.pmod(F.xxhash64("fp", "block"), F.col("parts")).cast("int")
    # Sub-shard i meets every sub-shard j >= i once: as the tree there, or as queries.
    tasks = sized.withColumn("i", part).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.xxhash64("block", "key", F.least("i", "j"), F.greatest("i", "j"))
    role = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    dealt = tasks.select(name.alias("task"), "fp", role.alias("role")).repartition("task").sortWithinPartitions("task", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, tree_size: int = 2048) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, first_id (least id of the same fingerprint)."""

    def hash_texts(texts: list[str | None]) -> list:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = materialize(derive(picked, "text", hash_texts, "fp long"), "simhash")
    firsts = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(link_fingerprints(firsts.select("fp"), radius=radius, tree_size=tree_size))
    # A root is a fingerprint; the component's name is the least id over its fingerprints.
    named = firsts.join(roots.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "first_id", "component_id")
    return table.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "first_id")
