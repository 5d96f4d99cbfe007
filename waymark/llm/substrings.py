"""Exact substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document.  Every word covered by a window
that also starts earlier (smaller id, or same document and earlier start) is removed.

Documents are dealt into groups of about ``group_bytes`` by a hash of their id, and three
passes run over them:

1. Every group makes a count-min sketch of its windows: for each of ``depth`` hash rows, the
   sorted cells it hits with counts that stop at two, coded as differences and cut by cell
   range into shards.  The groups' sketches are merged shard by shard, and a group gets back
   one bit for each of its cells: whether the merged count is two or more.  Sketches count at
   least what occurred, so no repeated window is lost, and the merged sketch is never in one
   place: its size follows the input and its memory is that of a shard.
2. Windows whose cells all say "two or more" are grouped exactly, by 128 bits of hash, in shards
   again.  A group sends each window once, with the least id that has it, so that a window in
   a third of all documents costs one entry a group; it gets back one bit for each: whether
   another group has the window in an earlier document.
3. Every group marks the words covered by windows that are not first, and keeps the rest.

Nulls: a null text has no words and keeps none; null ids come after all others.  Rows that
share an id, or have none, are ordered by group and then by text.  Very long texts are read as a whole.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from waymark.llm.scratch import drop, materialize, parallelism
from waymark.llm.textstats import covered_by, window_hashes

#: Slices in which equal rows are looked for, and bytes of text for a task at most.
_SLICES, _TASK_BYTES = 65_536, 64_000_000
_LAST = np.iinfo(np.int64).max
#: Multipliers of the sketch's rows; even rows use the first hash of a window, odd rows the second, each first as it is.
_ROWS = (1, 1, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25)


def _runs(windows: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): a stable order by both hashes, and where in it each distinct pair begins."""
    if not len(windows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(windows, kind="stable")
    a, b = windows[order], other[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # different windows that share the first hash
        order = np.lexsort((other, windows))
        a, b = windows[order], other[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


class Group:
    """The windows of one group of documents, in the order of documents."""

    def __init__(self, table: pa.Table, window: int):
        rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        self.ids = [r[0] for r in rows]
        self.words = [(r[1] or "").encode("utf-8", "surrogatepass").split() for r in rows]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(rows))
        self.begins = np.cumsum(self.counts) - self.counts
        total = int(self.counts.sum())
        hashed = np.frombuffer(b"".join(map(xxh3_128_digest, chain.from_iterable(self.words))), np.uint64).reshape(total, 2)
        # Two independent hashes: rows of the sketch use one each, exact grouping both.
        windows, other = window_hashes(hashed[:, 0], window), window_hashes(hashed[:, 1], window)
        doc = np.repeat(np.arange(len(rows)), self.counts)
        inside = doc[: len(windows)] == doc[window - 1 :] if len(windows) else np.empty(0, bool)
        self.starts = np.flatnonzero(inside)
        self.doc = doc[self.starts]
        # unique, other: the two hashes of the distinct windows, in order; first: the earliest window of each.
        windows, other = windows[self.starts], other[self.starts]
        order, begins = _runs(windows, other)
        self.unique, self.other, self.first = windows[order[begins]], other[order[begins]], order[begins]
        times = np.diff(begins, append=len(order))
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.repeat(np.arange(len(begins)), times)
        self.twice = times > 1
        self.window = window

    def row(self, r: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, cells): distinct windows in the order of their cells in row ``r``."""
        mixed = (self.other if r % 2 else self.unique) * np.uint64(_ROWS[r])
        order = np.argsort(mixed, kind="stable") if r else np.arange(len(mixed))
        return order, mixed[order] >> np.uint64(64 - bits)


def _differences(cells: np.ndarray, base: int, kind: type) -> bytes:
    """Sorted cells as differences; the greatest number of the type means "skip so many, no cell"."""
    top = np.iinfo(kind).max
    gaps = np.diff(cells.astype(np.int64), prepend=base)
    skips = gaps // top
    if not skips.any():
        return gaps.astype(kind).tobytes()
    out = np.full(len(gaps) + int(skips.sum()), top, kind)
    out[np.cumsum(skips + 1) - 1] = gaps % top
    return out.tobytes()


def _cells(blob: bytes, kind: type) -> np.ndarray:
    gaps = np.frombuffer(blob, kind)
    places = np.cumsum(gaps, dtype=np.int64)
    return places[gaps != np.iinfo(kind).max]


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _cuts(top_bits: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(top_bits, np.arange(shards + 1))


class Plan:
    """Sizes that follow from the input: cells of a sketch row, shards, groups."""

    def __init__(self, total_bytes: int, window: int, depth: int, group_bytes: int, shard_windows: int):
        windows = max(total_bytes // 5, 1)
        # A group has a row for each shard: both grow, up to eight times, with very large tables, lest these rows hold next to nothing.
        grown = min(8.0, max(1.0, math.sqrt(total_bytes / 30e9)))
        group_bytes, shard_windows = int(group_bytes * grown), int(shard_windows * grown)
        self.window, self.depth = window, depth
        self.groups = max(1, math.ceil(total_bytes / group_bytes))
        self.shard_bits = max(0, math.ceil(math.log2(windows / shard_windows))) if windows > shard_windows else 0
        self.cell_bits = max(self.shard_bits + 8, math.ceil(math.log2(4 * windows)))
        self.shards = 1 << self.shard_bits
        self.kind = np.uint16 if 4 * self.groups < 16_000 else np.uint32


def _sketch(table: pa.Table, plan: Plan) -> pa.Table:
    """Pass 1 of a group: for each row and shard of the sketch, its cells and which of them it hit twice."""
    gid = table["gid"][0].as_py()
    g = Group(table, plan.window)
    out = {"place": [], "gid": [], "cells": [], "twice": []}
    for r in range(plan.depth):
        order, cells = g.row(r, plan.cell_bits)
        cuts = _cuts(cells >> np.uint64(plan.cell_bits - plan.shard_bits), plan.shards)
        for s in range(plan.shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out["place"].append(r * plan.shards + s)
                out["gid"].append(gid)
                out["cells"].append(_differences(cells[a:b], s << (plan.cell_bits - plan.shard_bits), plan.kind))
                out["twice"].append(_bits(g.twice[order[a:b]]))
    return pa.table(out, schema=_SKETCH)


_SKETCH = pa.schema([("place", pa.int32()), ("gid", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])
_REPLY = pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("gid", pa.int64()), ("bits", pa.binary())])


def _merge_sketches(table: pa.Table, plan: Plan) -> pa.Table:
    """Merged counts of one shard of one row; for each group, the cells with two or more."""
    size = 1 << (plan.cell_bits - plan.shard_bits)
    seen, hot = np.zeros(size, bool), np.zeros(size, bool)
    blobs = table["cells"].to_pylist()
    for blob, twice in zip(blobs, table["twice"].to_pylist(), strict=True):
        cells = _cells(blob, plan.kind)
        again = seen[cells] | _mask(twice, len(cells))
        again[1:] |= cells[1:] == cells[:-1]
        hot[cells[again]] = True
        seen[cells] = True
    n = len(blobs)
    replies = [_bits(hot[_cells(b, plan.kind)]) for b in blobs]
    return pa.table({"kind": np.zeros(n, np.int32), "place": table["place"], "gid": table["gid"], "bits": replies}, schema=_REPLY)


def _repeated(g: Group, replies: pa.Table, plan: Plan) -> np.ndarray:
    """Indexes of the group's distinct windows that all rows of the sketch estimate as repeated."""
    bits = {p: b for k, p, b in zip(replies["kind"].to_pylist(), replies["place"].to_pylist(), replies["bits"].to_pylist(), strict=True) if k == 0}
    hot = np.ones(len(g.unique), bool)
    for r in range(plan.depth):
        order, cells = g.row(r, plan.cell_bits)
        cuts = _cuts(cells >> np.uint64(plan.cell_bits - plan.shard_bits), plan.shards)
        for s in range(plan.shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                hot[order[a:b]] &= _mask(bits[r * plan.shards + s], b - a)
    return np.flatnonzero(hot)


_ENTRIES = pa.schema([("place", pa.int32()), ("gid", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())])


def _exact_cuts(g: Group, repeated: np.ndarray, plan: Plan) -> np.ndarray:
    return _cuts(g.unique[repeated] >> np.uint64(64 - plan.shard_bits) if plan.shard_bits else np.zeros(len(repeated), np.uint64), plan.shards)


def _entries(table: pa.Table, replies: pa.Table, plan: Plan) -> pa.Table:
    """Pass 2 of a group: each window estimated repeated, with the least id that has it."""
    out: dict[str, list] = {f.name: [] for f in _ENTRIES}
    if table.num_rows:
        gid = table["gid"][0].as_py()
        g = Group(table, plan.window)
        repeated = _repeated(g, replies, plan)
        cuts = _exact_cuts(g, repeated, plan)
        ids = np.array([_LAST if i is None else i for i in g.ids], np.int64)
        for s in range(plan.shards):
            part = repeated[cuts[s] : cuts[s + 1]]
            if len(part):
                used, at = np.unique(g.doc[g.first[part]], return_inverse=True)
                out["place"].append(s)
                out["gid"].append(gid)
                out["hashes"].append(g.unique[part].tobytes() + g.other[part].tobytes())
                out["docs"].append(at.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes())
                out["ids"].append(ids[used].tobytes())
    return pa.table(out, schema=_ENTRIES)


def _merge_entries(table: pa.Table) -> pa.Table:
    """Exact grouping of one shard; for each group, the windows that an earlier document of another group has."""
    table = table.sort_by("gid")
    hashes, docs = [], []
    for h, d, i in zip(table["hashes"].to_pylist(), table["docs"].to_pylist(), table["ids"].to_pylist(), strict=True):
        hashes.append(np.frombuffer(h, np.uint64).reshape(2, -1))
        docs.append(np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint16 if len(d) == 2 * hashes[-1].shape[1] else np.uint32)])
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    h, d = np.concatenate(hashes, axis=1), np.concatenate(docs)
    order, starts = _runs(h[0], h[1])
    d = d[order]
    run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(d)))
    least = np.flatnonzero(d == np.minimum.reduceat(d, starts)[run])
    # Of null ids that tie, the first group's.
    _, at = np.unique(run[least], return_index=True)
    later = np.ones(len(d), bool)
    later[order[least[at]]] = False
    replies = [_bits(x) for x in np.split(later, np.cumsum(counts)[:-1])]
    return pa.table({"kind": np.ones(len(counts), np.int32), "place": table["place"], "gid": table["gid"], "bits": replies}, schema=_REPLY)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _keep(table: pa.Table, replies: pa.Table, plan: Plan, with_text: bool) -> pa.Table:
    """Pass 3 of a group."""
    out: dict[str, list] = {f.name: [] for f in _RESULT}
    if table.num_rows:
        g = Group(table, plan.window)
        repeated = _repeated(g, replies, plan)
        cuts = _exact_cuts(g, repeated, plan)
        later = np.zeros(len(g.unique), bool)
        for k, s, b in zip(replies["kind"].to_pylist(), replies["place"].to_pylist(), replies["bits"].to_pylist(), strict=True):
            if k == 1:
                part = repeated[cuts[s] : cuts[s + 1]]
                later[part] = _mask(b, len(part))
        # Not first: another group has it earlier, or this group does.
        again = later[g.which] | (g.first[g.which] != np.arange(len(g.which)))
        gone = covered_by(g.starts[again], int(g.counts.sum()), g.window)
        for i, words, begin, n in zip(g.ids, g.words, g.begins.tolist(), g.counts.tolist(), strict=True):
            removed = gone[begin : begin + n]
            k = int(removed.sum())
            kept = b" ".join(words if not k else [w for w, x in zip(words, removed.tolist(), strict=True) if not x])
            out["doc_id"].append(i)
            out["n_words"].append(n)
            out["n_removed"].append(k)
            out["kept_text"].append(kept.decode("utf-8", "surrogatepass") if with_text else None)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
    return pa.table(out, schema=_RESULT)


def dedupe_substrings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, depth: int = 2, group_bytes: int = 4_000_000, shard_windows: int = 4_000_000, with_text: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (null unless ``with_text``), kept_sha256."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows that share an id are spread by their texts.
    key = F.xxhash64("doc_id", "text")
    slices = picked.groupBy(F.pmod(key, F.lit(_SLICES)).alias("slice")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    total = slices["total"] or 0
    plan = Plan(int(total), window, depth, group_bytes, shard_windows)
    kept = picked
    if (slices["most"] or 0) > 4 * total / _SLICES + 16 * group_bytes:
        # Equal rows by the thousand: they are spread by their place, which is written down once.
        kept = materialize(picked.withColumn("place", F.monotonically_increasing_id()), "substrings-rows")
        key = F.xxhash64("doc_id", "text", "place")
    # Partitions follow the input, not the session's number alone.
    wide = max(parallelism(spark), math.ceil(total / _TASK_BYTES))
    width, places = min(plan.groups, wide), min(plan.depth * plan.shards, wide)
    grouped = kept.select("doc_id", "text", F.pmod(key, F.lit(plan.groups)).cast("long").alias("gid")).repartition(width, "gid").groupBy("gid")

    sketches = grouped.applyInArrow(lambda t: _sketch(t, plan), "place int, gid long, cells binary, twice binary")
    hot = materialize(sketches.repartition(places, "place").groupBy("place").applyInArrow(lambda t: _merge_sketches(t, plan), "kind int, place int, gid long, bits binary"), "substrings-hot")
    entries = grouped.cogroup(hot.repartition(width, "gid").groupBy("gid")).applyInArrow(lambda t, r: _entries(t, r, plan), "place int, gid long, hashes binary, docs binary, ids binary")
    later = materialize(entries.repartition(min(plan.shards, wide), "place").groupBy("place").applyInArrow(_merge_entries, "kind int, place int, gid long, bits binary"), "substrings-later")
    replies = materialize(hot.union(later), "substrings-replies")
    drop(hot)
    drop(later)
    return grouped.cogroup(replies.repartition(width, "gid").groupBy("gid")).applyInArrow(lambda t, r: _keep(t, r, plan, with_text), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
