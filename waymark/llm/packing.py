"""Best-two-fit packing of tokenized documents into sequences of fixed length.

A document is its byte-level BPE ids and an end id.  A document longer than a sequence is
cut so that the first piece takes the odd length and every later piece fills a sequence.
Pieces are spread over buckets of about ``bucket_pieces`` by a hash of their place in the table, and each bucket is
packed on its own: a bin is filled greedily with the longest pieces that fit; if a gap is
left, its shortest piece is replaced by the two unpacked pieces that together fill the
widened gap best, when they fill more of it.  A bucket wastes at most a bin or so, and its
size is bounded however large the table.

Nulls: a null text is empty, and an empty text is one piece that holds the end id; null ids
are kept.  Repeated rows are packed as often as they occur; pieces of one length are interchangeable.  An empty table gives an empty
result.  Other columns are ignored.

``tiktoken`` encodes with the vocabulary that the ``tokenizers`` file has, four times as
fast; the ids are the same, the string of the special token included (a test compares all texts of a table).  Very long texts
are encoded in parts that are cut where the vocabulary cuts anyway.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrow import derive
from waymark.llm.scratch import materialize

#: Fixed values of the vocabulary: the special token's string and id.
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

#: Between a letter and a space before a letter no token crosses, for the vocabulary splits texts there itself.
_SEAM = re.compile(r"[A-Za-z](?= [A-Za-z])")
_ENCODERS: dict = {}


def parts(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in parts that are encoded apart with the same ids, so that memory does not follow its length; a stretch without a seam stays whole."""
    at = 0
    while len(text) - at > size and (seam := _SEAM.search(text, at + size)):
        yield text[at : seam.end()]
        at = seam.end()
    yield text[at:]


def encoder(ranks_path: str | None = None):
    """Function from a text to the array of its ids; cached in the worker."""
    if ranks_path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        coding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

        def encode(text: str) -> np.ndarray:
            return np.concatenate([np.array(coding.encode(p, allowed_special={SPECIAL}) if SPECIAL in p else coding.encode_ordinary(p), "<u4") for p in parts(text)])

        _ENCODERS[ranks_path] = encode
    return _ENCODERS[ranks_path]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, end_id: int, ranks_path: str | None) -> DataFrame:
    def tokenize(texts: list[str | None]) -> list[list]:
        encode = encoder(ranks_path)
        out = []
        for text in texts:
            ids = np.append(encode(text or ""), np.uint32(end_id))
            out.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n].tobytes())} for k, (s, n) in enumerate(cut(len(ids), size))])
        return [out]

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = derive(picked, "text", tokenize, "pieces array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>")
    return made.select("doc_id", F.inline("pieces"))


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item; items of one length are interchangeable."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(size + 2), side="left")
    left = np.diff(ends)  # left[v]: unpacked items of length v
    fits = np.arange(size + 1)  # fits[v]: longest unpacked length up to v; 0: none
    for v in range(size + 1):
        fits[v] = v if v and left[v] else (fits[v - 1] if v else 0)

    def take(v: int) -> None:
        left[v] -= 1
        if not left[v]:
            above = np.searchsorted(fits[v:], v, side="right") + v
            fits[v:above] = fits[v - 1]

    bins = []
    while (longest := int(fits[size])) > 0:
        held, gap = [longest], size - longest
        take(longest)
        while gap and (v := int(fits[gap])):
            held.append(v)
            take(v)
            gap -= v
        if gap and len(held) > 1:
            room = gap + held[-1]
            left_a = np.flatnonzero(left[: room + 1])
            left_b = fits[room - left_a]
            once = (left_b == left_a) & (left[left_a] < 2)
            left_b = np.where(once, fits[np.maximum(left_a - 1, 0)], left_b)
            both = np.where(left_b > 0, left_a + left_b, 0)
            if len(both) and (best := int(both.argmax())) >= 0 and both[best] > held[-1]:
                a, b = int(left_a[best]), int(left_b[best])
                back = held.pop()
                held += [a, b]
                take(a)
                take(b)
                left[back] += 1
                if left[back] == 1:
                    above = np.searchsorted(fits[back:], back, side="left") + back
                    fits[back:above] = back
        bins.append(held)

    at = ends[:-1].copy()
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, held in enumerate(bins):
        place = 0
        for v in held:
            item = order[at[v]]
            at[v] += 1
            bin_of[item], offset[item] = k, place
            place += v
    return bin_of, offset


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, ranks_path: str | None = None, bucket_pieces: int = 50_000
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = materialize(pieces(docs, id_col, text_col, size, end_id, ranks_path), "packing-pieces")
    buckets = max(1, math.ceil(table.count() / bucket_pieces))
    # Pieces are spread by where they lie in the table: rows with equal ids, or none, would meet in one bucket.
    spread = table.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        bin_of, offset = best_two_fit(t["length"].to_numpy(), size)
        sequence = (t["bucket"][0].as_py() << 32) + bin_of
        return t.drop_columns("bucket").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return spread.groupBy("bucket").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
