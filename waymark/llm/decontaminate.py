"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A CGK random walk reads a string under a shared random function and writes one symbol a
step, moving on when the function says so; strings at a small edit distance give outputs at
a small Hamming distance, because walks that an edit parted soon meet again.  Windows of an
item's length are embedded with several walks, and every walk is sampled at several sets of
positions; a window and an item that agree on a whole set are candidates.  More walks and
sets raise the recall; the defaults find about 0.96 of the passages at the greatest distance
allowed, and all exact ones.  Every candidate is verified by its exact edit distance.

Windows start at the words of every document, and wherever an item would start of which one of
the ``q``-grams side by side stands in the text: ``d`` edits leave one of them at least, so
passages that are glued to other characters, or in scripts without blanks, get their window
too.  A window is embedded only if it can match at
all: ``d`` edits destroy at most ``q * d`` of an item's ``q``-grams, so a match must contain
the rest of them, and windows with fewer item q-grams are skipped without loss.

Text is compared lower-cased, with every run of white space as one space.  An item of length
L matches where some passage of a document is within ``min(rate * L, (L - q) // q)`` edits,
or exactly if it is shorter than ``2 * q``.

Null and empty texts and items match nothing; null ids are kept.  Repeated documents and
repeated items each give their rows.  Of passages at equal distances the first that is found counts.  Very long
texts are searched whole, in stretches of a million characters and more.  Empty tables give an empty result.  Other columns are
ignored.  The benchmark reaches every task in blocks of at most ``block_items`` items and
``block_chars`` characters, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrow import derive

_B = 0x9E3779B1
_TABLE_BITS = 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """32-bit polynomial hash of every q-gram, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint32)
    have, width, out, done = codes, 1, None, 0
    left = q
    while True:
        if left & 1:
            out = have[: len(codes) - width + 1] if out is None else out[: len(codes) - done - width + 1] * np.uint32(pow(_B, width, 1 << 32)) + have[done:]
            done += width
        left >>= 1
        if not left:
            return out
        have = have[:-width] * np.uint32(pow(_B, width, 1 << 32)) + have[width:]
        width *= 2


def allowed_edits(length: int, rate: float, q: int) -> int:
    return 0 if length < 2 * q else max(0, min(int(rate * length), (length - q) // q))


def best_alignment(item: str, region: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of ``region`` nearest to ``item``, if within ``most`` edits: bit-parallel, the first end of equals."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = None
    for j, c in enumerate(region):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hn = up & d0
        hp = (down | ~(up | d0)) & full
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        down = hp & d0
        up = (hn | ~(hp | d0)) & full
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Index:
    """Signatures of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, q: int, walks: int, sets: int, sample: int, seed: int = 4):
        self.q = q
        self.short = [(i, t) for i, t in items if t and len(t) < q]
        self.items = [(i, t, allowed_edits(len(t), rate, q)) for i, t in items if len(t) >= q]
        self.grams = np.zeros(1 << _TABLE_BITS, np.uint8)
        for _, t, _ in self.items:
            self.grams[gram_hashes(codes_of(t), q) >> np.uint32(32 - _TABLE_BITS)] = 1
        seeds: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        order = sorted(range(len(self.items)), key=lambda k: len(self.items[k][1]))
        self.classes = []
        at = 0
        while at < len(order):
            low = len(self.items[order[at]][1])
            end = at
            while end < len(order) and len(self.items[order[end]][1]) <= 1.25 * low:
                end += 1
            members = order[at:end]
            high = len(self.items[members[-1]][1])
            edits = max(self.items[k][2] for k in members)
            steps = 2 * low
            moves = rng.integers(0, 2, (steps, walks, 256), dtype=np.int8)
            positions = np.sort(rng.integers(0, steps, (walks, sets, sample)), axis=2)
            c = {"need": max(1, min(len(self.items[k][1]) - q + 1 - q * self.items[k][2] for k in members)), "span": high + edits + 16 - q + 1, "width": high + 1, "moves": moves, "positions": positions, "edits": edits}
            keys = self._keys(np.stack([self._padded(codes_of(self.items[k][1]), 0, c["width"]) for k in members]), c)
            table = keys.ravel()
            who = np.repeat(np.array(members), keys.shape[1])
            ranked = np.argsort(table, kind="stable")
            c["table"], c["who"] = table[ranked], who[ranked]
            for k in members:
                hashes = gram_hashes(codes_of(self.items[k][1]), q)[::q]
                seeds.append(np.stack([hashes, np.full(len(hashes), len(self.classes)), np.arange(len(hashes)) * q]).astype(np.int64))
            self.classes.append(c)
            at = end
        # Places of the items' q-grams side by side, each once for a class: hash, class, offset.
        self.seeds = np.unique(np.concatenate(seeds, axis=1), axis=1) if seeds else np.empty((3, 0), np.int64)
        self.grams[self.seeds[0] >> (32 - _TABLE_BITS)] = 2

    @staticmethod
    def _padded(codes: np.ndarray, at: int, width: int) -> np.ndarray:
        out = np.zeros(width, np.uint8)
        part = codes[at : at + width]
        out[: len(part)] = (part * np.uint32(_B)) >> np.uint32(24)
        return out

    @staticmethod
    def _keys(x: np.ndarray, c: dict) -> np.ndarray:
        """Sampled symbols of every walk, mixed with the set's number: (rows, walks * sets)."""
        n, width = x.shape
        moves, positions = c["moves"], c["positions"]
        steps, walks, _ = moves.shape
        flat = x.ravel()
        place = np.repeat(np.arange(n, dtype=np.int32)[:, None] * width, walks, axis=1)
        last = place + (width - 1)
        column = np.arange(walks, dtype=np.int32)[None] * 256
        keys = np.arange(1, walks * positions.shape[1] + 1, dtype=np.uint64).reshape(walks, -1)[None].repeat(n, axis=0)
        wanted: dict[int, list[tuple[int, int]]] = {}
        for w, s, k in np.ndindex(*positions.shape):
            wanted.setdefault(int(positions[w, s, k]), []).append((w, s))
        for j in range(max(wanted) + 1):
            symbol = flat[place]
            for w, s in wanted.get(j, ()):
                keys[:, w, s] = (keys[:, w, s] * np.uint64(0x9E3779B97F4A7C15)) ^ symbol[:, w]
            place += moves[j].ravel()[column + symbol]
            np.minimum(place, last, out=place)
        return (keys * np.uint64(0xD6E8FEB86659FD93)).reshape(n, -1)

    def _seeded(self, grams: np.ndarray, at: np.ndarray, hits: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """For each class, where an item would start of which a q-gram stands at one of the places ``at``."""
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in self.classes]
        span, need, edits = (np.array([c[k] for c in self.classes], np.int64) for k in ("span", "need", "edits"))
        hashes, number, offset = self.seeds
        for part in np.array_split(at, len(at) // 65536 + 1):
            low = np.searchsorted(hashes, grams[part], side="left")
            count = np.searchsorted(hashes, grams[part], side="right") - low
            which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            place = np.repeat(part, count)
            first = begins[np.searchsorted(ends, place, side="right")]
            of = number[which]
            start = np.maximum(place - offset[which], first)
            last = np.minimum(start + span[of] + edits[of], len(hits) - 1)
            fits = hits[last] - hits[np.maximum(start - edits[of], first)] >= need[of]
            both = np.unique(start[fits] * len(self.classes) + of[fits])
            for k in range(len(self.classes)):
                out[k].append(both[both % len(self.classes) == k] // len(self.classes))
        return [np.unique(np.concatenate(x)) for x in out]

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each normal text: (item number, distance, end), each item once, at its first best verified place."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1)
        begins = ends - lengths - 1
        codes = codes_of("\0".join(texts) + "\0")
        hits = np.zeros(len(codes) + 1, np.int32)
        grams = gram_hashes(codes, self.q)
        marks = self.grams[grams >> np.uint32(32 - _TABLE_BITS)]
        np.cumsum(marks > 0, out=hits[1 : len(grams) + 1])
        hits[len(grams) + 1 :] = hits[len(grams)]
        starts = np.flatnonzero((codes[:-1] == 32) | (codes[:-1] == 0)) + 1
        starts = np.concatenate([[0], starts])
        starts = starts[starts < len(codes)]
        seeded = self._seeded(grams, np.flatnonzero(marks > 1), hits, begins, ends)
        for c, more in zip(self.classes, seeded, strict=True):
            near = starts[hits[np.minimum(starts + c["span"], len(codes))] - hits[starts] >= c["need"]]
            near = np.union1d(near, more)
            width = c["width"]
            for part in np.array_split(near, len(near) // 2048 + 1):
                if not len(part):
                    continue
                doc = np.searchsorted(ends, part, side="right")
                stop = ends[doc] - 1
                where = part[:, None] + np.arange(width)
                x = (codes[np.minimum(where, len(codes) - 1)] * np.uint32(_B) >> np.uint32(24)).astype(np.uint8)
                x[where >= stop[:, None]] = 0
                keys = self._keys(x, c)
                low = np.searchsorted(c["table"], keys.ravel(), side="left")
                high = np.searchsorted(c["table"], keys.ravel(), side="right")
                pairs = set()
                for k in np.flatnonzero(high > low):
                    row = k // keys.shape[1]
                    pairs.update((row, int(i)) for i in c["who"][low[k] : high[k]])
                for row, i in sorted(pairs):
                    d = int(doc[row])
                    if found[d].get(i, (1,))[0] == 0:
                        continue
                    _, item, most = self.items[i]
                    exact = texts[d].find(item)
                    if exact >= 0:
                        found[d][i] = (0, exact + len(item))
                        continue
                    begin = max(0, int(part[row] - begins[d]) - most - 24)
                    got = best_alignment(item, texts[d][begin : begin + len(item) + 2 * most + 48], most)
                    if got and (i not in found[d] or got[0] < found[d][i][0]):
                        found[d][i] = (got[0], begin + got[1])
        out = [[(i, *v) for i, v in sorted(f.items())] for f in found]
        for n, t in enumerate(texts):
            out[n] += [(-1 - k, 0, t.index(s) + len(s)) for k, (_, s) in enumerate(self.short) if s in t]
        return out

    def item_id(self, number: int):
        return self.short[-1 - number][0] if number < 0 else self.items[number][0]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.05,
    q: int = 9,
    walks: int = 3,
    sets: int = 20,
    sample: int = 6,
    block_items: int = 5_000,
    block_chars: int = 5_000_000,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, distance, end (in the normal text)."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    def scan(items: list[tuple[int | None, str]]) -> DataFrame:
        # Executors hold the index of a block, the driver none.
        shared = picked.sparkSession.sparkContext.broadcast(Index(items, rate, q, walks, sets, sample))

        def run(raw: list[str]) -> list[list]:
            index = shared.value
            texts, out, at = [normal(t) for t in raw], [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars < 1_000_000 or end == at):
                    chars += len(texts[end])
                    end += 1
                out += [[{"item_id": index.item_id(i), "distance": distance, "end": stop} for i, distance, stop in found] for found in index.search(texts[at:end])]
                at = end
            return [out]

        made = derive(picked, "text", run, "found array<struct<item_id: bigint, distance: int, end: bigint>>")
        return made.select("doc_id", F.inline("found"))

    def blocks() -> Iterator[list[tuple[int | None, str]]]:
        held, chars = [], 0
        for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null").toLocalIterator():
            held.append((r["i"], normal(r["t"])))
            chars += len(r["t"])
            if len(held) >= block_items or chars >= block_chars:
                yield held
                held, chars = [], 0
        if held:
            yield held

    parts = [scan(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))) for items in blocks()]
    return reduce(DataFrame.union, parts) if parts else picked.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, end long")
