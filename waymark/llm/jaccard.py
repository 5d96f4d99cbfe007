"""Documents whose sets of word shingles have a Jaccard similarity of some percent or more: a size-aware heavy-light join.

Documents with one and the same set are a class, and classes are joined.  Shingles have one global order,
the rare ones first; what order that is decides costs and never results, so it follows a count-min sketch
over all documents (merged from the partitions, of a fixed size) and then the hash.  A set of n shingles shares at least
t = ceil(percent * n / 100) of them with any partner, so any two partners share l shingles within the first n - t + l of each.

* Small sets are indexed under every pair (l = 2) of their first n - t + 2 shingles: a partner has one of these pairs, too.
* Large sets, and small ones near enough in size to have a large partner, are in the inverted lists of
  their first n - t + 1 shingles, and lists are scanned for pairs with a large member.

The boundary between small and large is the one of least cost: keys to write against entries of
lists to scan, summed up over all sets for a few boundaries.  Pairs under a common key are candidates if their sizes
and parities allow it: a set's 512 parity bits, one flip for every shingle, differ from another's in no more bits than the
sets differ in shingles.  What is left is verified by the exact overlap of the two texts' sets.

``components`` needs no more links than keep what is connected together, so candidates come in two rounds.
First each member of a list against some hubs of the list and size class, a number that is linear
in the lists; then, for lists whose members are not in one component by then, all pairs across
components that were not tried.  ``links`` (for those who want every pair) takes all pairs under all keys.

Null texts and texts without words have no shingles and no links; with fewer words than a shingle has, the whole
sequence is one.  A-Z are lower-cased, nothing else.  Null ids take part; a component is named by its least non-null id, and a null id alone gets none.
Repeated rows and ids are rows of their own with equal results where texts are equal.  Texts are read whole, of any length.  An empty table
gives an empty result; other columns are ignored.  Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from waymark.llm.arrow import derive, slices, small_batches
from waymark.llm.components import components as connected
from waymark.llm.scratch import drop, materialize, parallelism
from waymark.llm.textstats import window_hashes

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The sketch: cells in one row of counters (a power of two), and in how many shards they travel.
CELLS, SHARDS = 1 << 20, 64
#: Boundaries that are weighed; writing a key costs as much as scanning so many entries of a list.
BOUNDARIES = (0, 4, 8, 16, 24, 32, 48, 64, 96, 128)
KEY_COST = 8.0
#: Members of a list that all its members are compared with first.
HUBS = 2
#: Keys that tell under which one a pair is named.
LEAST = 16
#: Parity bits of a set, in longs.
WORDS = 8
#: Class ids up to this many (8 bytes each and a hash) are broadcast to fetch their texts; more are joined by key.
BROADCAST_IDS = 1_000_000
_LAST = 2**63 - 1


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    return np.unique(window_hashes(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), shingle))


def cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` longs, each bit flipped by the shingles that fall on it."""
    odd = np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Counters with equal keys added up, one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in at], pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=[*keys, "counts"])
        for b in batches:
            for *key, counts in zip(*[b.column(k).to_pylist() for k in keys], b.column("counts"), strict=True):
                more = np.frombuffer(counts.as_buffer(), np.int32)
                if key != at:
                    if at is not None:
                        yield row()
                    at, total = key, np.zeros(len(more), np.int64)
                total += more
        if at is not None:
            yield row()

    dealt = rows.repartition(SHARDS, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join([*[f"{k} int" for k in keys], "counts binary"]))


def sketch(texts: DataFrame, shingle: int, cells: int = CELLS) -> np.ndarray:
    """How many sets hold a shingle of each cell, at most 2 ** 31 - 1: never less than any one shingle's own count."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for b in slices(batches):
            sets = [cell(shingle_set(t, shingle), cells) for t in b.column("text").to_pylist()]
            counts += np.bincount(np.concatenate(sets), minlength=cells)
        shards = np.minimum(counts, 2**31 - 1).astype(np.int32).reshape(SHARDS, -1)
        used = np.flatnonzero(shards.any(axis=1))
        group = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([group] * len(used), pa.int32()), pa.array([shards[k].tobytes() for k in used], pa.binary())], names=["shard", "part", "counts"])

    rows = texts.select("text").mapInArrow(run, "shard int, part int, counts binary")
    out = np.zeros((SHARDS, cells // SHARDS), np.int32)
    # 64 rows of 64 KB, whatever the input.
    for r in _merged(_merged(rows, "shard", "part").drop("part"), "shard").collect():
        out[r["shard"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(-1)


def least_shared(n, percent: int):
    """Shingles that a set of n shares with any partner, at least."""
    return (n * percent + 99) // 100


def _prefixes(docs: DataFrame, counts, mean: float, shingle: int, percent: int) -> DataFrame:
    """Of every document its set's size and digest, the first n - t + 2 shingles in the global order, and the expected length of the lists of all but the last."""

    def make(texts: list[str | None]) -> list[list]:
        digests, sizes, prefixes, scans, bits = [], [], [], [], []
        for t in texts:
            s = shingle_set(t, shingle)
            n = len(s)
            c = counts.value[cell(s, len(counts.value))]
            first = np.lexsort((s, c))[: min(n, n - least_shared(n, percent) + 2)]
            digests.append(xxh3_128_digest(s.tobytes()))
            sizes.append(n)
            prefixes.append(s[first].view(np.int64))
            scans.append(float(np.maximum(c[first[:-1]] - mean, 1.0).sum()))
            bits.append(parity(s))
        return [digests, sizes, prefixes, scans, bits]

    return derive(docs.withColumn("hash", F.xxhash64("text")), "text", make, "digest binary, n int, prefix array<long>, scan double, bits array<long>")


def boundary(classes: DataFrame, percent: int) -> int:
    """The largest size of small sets that makes keys and scans cheapest, from one row of sums."""
    keys = F.size("prefix")
    pairs = keys * (keys - 1) / 2 * KEY_COST
    lists = (keys - 1) * KEY_COST + F.col("scan")
    total = lambda x: F.sum(F.when(F.col("n").between(2, x), pairs).otherwise(0.0) + F.when(F.col("n") * 100 >= percent * (x + 1), lists).otherwise(0.0)).alias(str(x))
    costs = classes.where("n > 1").agg(*[total(x) for x in BOUNDARIES]).first().asDict()
    return min(BOUNDARIES, key=lambda x: (costs[str(x)] or 0.0, x))


def _postings(classes: DataFrame, small: int, percent: int) -> DataFrame:
    """Keys of all classes that could have a partner: key, light (a pair of shingles), cid, n."""
    s = F.size("prefix")
    light = classes.where(F.col("n").between(2, small)).select("cid", "n", "prefix", F.posexplode(F.slice("prefix", F.lit(1), s - 1)).alias("i", "h"))
    light = light.select("cid", "n", "h", F.explode(F.slice("prefix", F.col("i") + 2, s)).alias("g")).select(F.xxhash64("h", "g").alias("key"), F.lit(True).alias("light"), "cid", "n")
    heavy = classes.where((F.col("n") > 1) & (F.col("n") * 100 >= percent * (small + 1))).select(F.explode(F.slice("prefix", F.lit(1), s - 1)).alias("key"), F.lit(False).alias("light"), "cid", "n")
    return light.unionByName(heavy)


def _near(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _alike(n: Column, m: Column, bits: Column, other: Column, percent: int) -> Column:
    """Whether the parities differ in no more bits than the sets may differ in shingles."""
    apart = sum((F.bit_count(F.get(bits, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(WORDS)), F.lit(0))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs of classes (a, b) with ``linked``: whether the sets of their texts overlap enough."""
    ids = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "jaccard-candidates")
    few = ids.count() <= BROADCAST_IDS
    wanted = classes.join(F.broadcast(ids) if few else ids, "cid", "left_semi").select("cid", "first.doc", "first.hash")
    texts = docs.withColumn("hash", F.xxhash64("text")).join(F.broadcast(wanted) if few else wanted, ["doc", "hash"]).select("cid", "text")
    texts = materialize(texts, "jaccard-texts")
    drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in slices(batches):
            linked = []
            for key, t, u in zip(b.column("b").to_pylist(), b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                if key != last:
                    last, held = key, shingle_set(u, shingle)
                own = shingle_set(t, shingle)
                both = len(np.intersect1d(own, held, assume_unique=True))
                linked.append(both * 100 >= percent * (len(own) + len(held) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    out = materialize(both.mapInArrow(run, "a long, b long, linked boolean").distinct(), "jaccard-verified")
    drop(texts)
    return out


class Join:
    """The steps of one join, each in a written table."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, small: int | None = None, cells: int = CELLS):
        if not 50 <= percent <= 100:
            raise ValueError("percent from 50 to 100")
        self.shingle, self.percent, self.spark = shingle, percent, docs.sparkSession
        self.docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        table = sketch(self.docs, shingle, cells)
        counts = self.spark.sparkContext.broadcast(table)
        self.members = materialize(_prefixes(self.docs, counts, float(table.mean()), shingle, percent), "jaccard-prefixes")
        counts.destroy()
        kinds = self.members.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc", "hash")).alias("first"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("scan").alias("scan"), F.first("bits").alias("bits"))
        self.classes = materialize(kinds.select(F.monotonically_increasing_id().alias("cid"), "*"), "jaccard-classes")
        self.small = boundary(self.classes, percent) if small is None else small
        self.met = self._met()

    def _met(self) -> DataFrame:
        """Entries under keys that more than one class has, a large one among them where the key is of a list.

        Lists with the same members name the same pairs, as those of a passage that some documents share do, and one of them stays: they have equal counts and 128 bits of hashes of their members.
        """
        postings = _postings(self.classes, self.small, self.percent)
        members = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
        shared = postings.groupBy("key", "light").agg(F.count("*").alias("k"), F.max("n").alias("most"), *members).where((F.col("k") > 1) & (F.col("light") | (F.col("most") > self.small)))
        lists = shared.groupBy("light", "k", "x0", "x1").agg(F.min("key").alias("key")).select("key", "light")
        return materialize(postings.join(lists, ["key", "light"], "left_semi"), "jaccard-met")

    def _fits(self, n: Column, m: Column) -> Column:
        return _near(n, m, self.percent) & (F.col("light") | (F.greatest(n, m) > self.small))

    def all_pairs(self, entries: DataFrame | None = None, apart: bool = False) -> DataFrame:
        """Pairs of classes under a common key that could be linked; ``apart``: of different components only.

        A pair is named under its least common key and no other, as far as the ``LEAST`` least keys of both tell: a common key in both
        of these lists is there with every lesser one, so the least in both is the least of all.
        """
        entries = self.met if entries is None else entries
        low = entries.groupBy("cid", "light").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST).alias("low"))
        entries = entries.join(low, ["cid", "light"]).join(self.classes.select("cid", "bits"), "cid")
        side = lambda x: entries.select("key", "light", *[F.col(c).alias(f"{c}_{x}") for c in entries.columns if c not in ("key", "light")])
        joined = side("a").join(side("b"), ["key", "light"]).where(F.col("cid_a") < F.col("cid_b"))
        if apart:
            joined = joined.where("comp_a <> comp_b")
        joined = joined.where(self._fits(F.col("n_a"), F.col("n_b"))).where(_alike(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), self.percent))
        least = F.array_min(F.array_intersect("low_a", "low_b"))
        joined = joined.where(least.isNull() | (F.col("key") == least))
        return joined.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()

    def hub_pairs(self) -> DataFrame:
        """Every entry with the hubs of its list and size class, ``HUBS`` draws among the members: linear in the entries, and a large group is connected by some of them."""
        # Size classes in two layers, one moved by half a class: members of nearly one size are together in at least one of them.
        size = F.log(F.col("n").cast("double")) / math.log(100 / self.percent if self.percent < 100 else 2)
        entries = self.met.select("*", F.explode(F.array(F.floor(size) * 2, F.floor(size + 0.5) * 2 + 1)).alias("band"))
        drawn = [F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("d"), "cid", "n")).alias(f"hub_{k}") for k in range(HUBS)]
        hubs = entries.groupBy("key", "light", "band").agg(*drawn)
        joined = entries.join(hubs, ["key", "light", "band"]).select("cid", "n", "light", F.explode(F.array_distinct(F.array(*[F.struct(f"hub_{k}.cid", f"hub_{k}.n") for k in range(HUBS)]))).alias("hub"))
        joined = joined.where(F.col("cid") != F.col("hub.cid")).where(self._fits(F.col("n"), F.col("hub.n")))
        pairs = joined.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct()
        side = lambda x: self.classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(_alike(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), self.percent)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "jaccard-pairs")
        out = verify(pairs, self.classes, self.docs, self.shingle, self.percent)
        drop(pairs)
        return out

    def roots(self) -> DataFrame:
        """cid, root of every class that has a link."""
        tried = self.verified(self.hub_pairs())
        near = connected(tried.where("linked").select("a", "b"))
        first = materialize(near.select(F.col("node").alias("cid"), F.col("component").alias("root")), "jaccard-roots")
        entries = self.met.join(first, "cid", "left").select("key", "light", "cid", "n", F.coalesce("root", "cid").alias("comp"))
        split = entries.groupBy("key", "light").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", "light")
        left = materialize(entries.join(split, ["key", "light"], "left_semi"), "jaccard-met")
        more = self.verified(self.all_pairs(left, apart=True).join(tried, ["a", "b"], "left_anti")).where("linked")
        for done in (tried, left):
            drop(done)
        if more.isEmpty():
            return first
        joined = connected(more.select("a", "b").union(first.select("cid", "root")))
        return joined.select(F.col("node").alias("cid"), F.col("component").alias("root"))


def links(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): every document's class (doc_id, n_shingles, class_id, null without shingles), and every linked pair of classes (a, b).

    Documents of one class are linked with each other; n classes that are all linked give n * (n - 1) / 2 pairs.
    """
    join = Join(docs, **options)
    pairs = join.verified(join.all_pairs()).where("linked").select("a", "b")
    members = join.members.join(join.classes.select("digest", "cid"), "digest", "left")
    return members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("cid").alias("class_id")), pairs


def components(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    join = Join(docs, **options)
    named = join.classes.select("digest", "cid", "first_id").join(join.roots(), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_set = materialize(named.join(least, "root").select("digest", "component_id"), "jaccard-named")
    for done in (join.classes, join.met):
        drop(done)
    out = join.members.join(by_set, "digest", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
