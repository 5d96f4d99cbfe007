"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a linear classifier over hashed
character n-grams learns whether the language's codeword has it; a text's margins are
decoded by the sum of hinge losses, weighted by how well each bit's classifier did in
training, and the nearest codeword wins.  The score is the winner's share of the
exponentiated negative losses; a text is ambiguous when the runner-up is close.

The classifiers are fitted on a bounded sample of the training rows (``max_train``
documents, those with the smallest hash of their id); prediction covers every text as a whole.

Nulls, empty texts and texts with no letter are ``und`` with score 0.  Rows with a null
language do not train.  Ties between codewords go to the first language in sorted order.
With no training rows everything is ``und``; with one language every text with a letter
gets it.  Repeated rows are predicted alike, very long texts like any other, in one vector of
fixed length.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.arrow import derive
from waymark.llm.scratch import drop, materialize

DIM = 2048


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _letters() -> np.ndarray:
    """Code points folded to what the n-grams see: letters as they are, all else a space."""
    table = np.arange(0x10000, dtype=np.uint32)
    table[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
    return table


_TABLE = _letters()


def ngram_vector(text: str | None) -> np.ndarray:
    """Square roots of relative counts of hashed 1-, 2- and 3-grams of the lower-cased text, unit length."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _TABLE[np.minimum(codes, 0xFFFF)]
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    total = np.zeros(DIM)
    for grams in (one, two, three):
        total += np.bincount(grams >> shift, minlength=DIM)
    v = np.sqrt(total)
    return (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code up to six languages, a random code with distinct rows and columns beyond."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = range(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 or not (c >> (k - 1)) & 1 else -1 for c in columns] for k in range(n)], float)
    rng, width = np.random.default_rng(8), 8 * int(np.ceil(np.log2(n)))
    best, most = None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, width))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, apart
    return best


class OutputCode:
    """One ridge classifier per bit and the loss-weighted decoder."""

    def __init__(self, languages: list[str], w: np.ndarray, bit_weight: np.ndarray):
        self.languages, self.w, self.bit_weight = languages, w, bit_weight
        self.code = codewords(len(languages))

    @classmethod
    def fitted(cls, x: np.ndarray, y: list[str], ridge: float = 0.05) -> OutputCode:
        languages = sorted(set(y))
        code = codewords(len(languages))
        index = {language: k for k, language in enumerate(languages)}
        rows = np.array([index[v] for v in y])
        # Each language weighs as much as any other.
        weight = 1 / np.bincount(rows)[rows]
        bits = code[rows]
        xb = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
        xw = xb * weight[:, None]
        w = np.linalg.solve(xb.T @ xw + ridge * weight.sum() / len(x) * np.eye(xb.shape[1]), xw.T @ bits)
        losses = (np.maximum(0, 1 - bits * (xb @ w)) * weight[:, None]).sum(axis=0) / weight.sum()
        bit_weight = np.maximum(1 - losses, 0.05)
        return cls(languages, w, bit_weight / bit_weight.sum())

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share, and the gap to the runner-up's loss."""
        margins = x @ self.w[:-1] + self.w[-1]
        losses = (np.maximum(0, 1 - margins[:, None, :] * self.code[None]) * self.bit_weight).sum(axis=2)
        share = np.exp(-6 * losses)
        share /= share.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        ordered = np.sort(losses, axis=1)
        gap = ordered[:, 1] - ordered[:, 0] if losses.shape[1] > 1 else np.ones(len(x))
        return best, share[np.arange(len(x)), best], gap


def fit(training: DataFrame, max_train: int) -> OutputCode | None:
    """``training``: doc_id, text and lang.  At most ``max_train`` vectors reach one task, which solves the classifiers; the driver gets their weights, a row for each bit.

    Every language gets an equal part of them, and has all its rows in if it has no more, however rare it is.  Rows
    are drawn by a hash of their id; a first cut keeps about twice as many of each language as needed, so
    that the exact choice gathers no more vectors however large the table.  Texts are vectors before they move.
    """

    def vectors(texts: list[str | None]) -> list[list]:
        known = [has_letter(t) for t in texts]
        return [known, [ngram_vector(t).tobytes() if k else None for t, k in zip(texts, known, strict=True)]]

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("v", "ascending")])
        x = np.frombuffer(table["v"].combine_chunks().buffers()[2], np.float32, table.num_rows * DIM).reshape(-1, DIM)
        code = OutputCode.fitted(x, table["lang"].to_pylist())
        return pa.table({"bit": np.arange(code.code.shape[1], dtype=np.int32), "w": [w.tobytes() for w in code.w.T], "bit_weight": code.bit_weight, "languages": [code.languages] * code.code.shape[1]}, schema=_WEIGHTS)

    rows = training.where("text is not null and lang is not null")
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("rows")), "language-counts")
    languages = counts.count()
    part = max(max_train // max(languages, 1), 1)
    drawn = rows.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)))
    drawn = drawn.where(F.col("draw") < F.least(F.lit(2.0 * part) / F.col("rows"), F.lit(1.0)) * (1 << 30)).drop("rows")
    order = ["draw", "doc_id", "v"]
    ranked = derive(drawn, "text", vectors, "known boolean, v binary").where("known").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    sample = ranked.where(F.col("rank") <= part).orderBy("rank", *order, "lang").limit(max_train)
    got = sample.select("lang", "v", F.lit(0).alias("one")).groupBy("one").applyInArrow(solve, "bit int, w binary, bit_weight double, languages array<string>").collect()
    drop(counts)
    if not got:
        return None
    got.sort(key=lambda r: r["bit"])
    return OutputCode(got[0]["languages"], np.stack([np.frombuffer(r["w"], np.float64) for r in got], axis=1), np.array([r["bit_weight"] for r in got]))


#: Counts of languages up to this many are broadcast.
BROADCAST_LANGUAGES = 100_000
_WEIGHTS = pa.schema([("bit", pa.int32()), ("w", pa.binary()), ("bit_weight", pa.float64()), ("languages", pa.list_(pa.field("element", pa.string())))])


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
    max_train: int = 3000,
    ambiguous_gap: float = 0.02,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, held_out, the columns named by ``carry`` (the text may be one), lang_pred, score, ambiguous.

    A carried column may not have the name of another column of the result.
    """
    if clash := {"doc_id", "held_out", "lang_pred", "score", "ambiguous"}.intersection(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    doc_id = F.col(id_col).cast("long")
    held = F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    training = docs.where(~held & doc_id.isNotNull()).select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(training, max_train)

    def predict(texts: list[str | None]) -> list:
        known = np.array([has_letter(t) for t in texts], bool)
        lang, score, gap = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
        at = np.flatnonzero(known) if model is not None else np.empty(0, int)
        for part in np.array_split(at, len(at) // 512 + 1):
            if len(part):
                best, share, apart = model.decode(np.stack([ngram_vector(texts[i]) for i in part]))
                lang[part], score[part], gap[part] = np.array(model.languages, object)[best], share, apart
        return [lang.tolist(), score, gap < ambiguous_gap]

    # Any name that no carried column has.
    text = max(["text", *carry], key=len) + "_"
    picked = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), *carry, F.col(text_col).alias(text))
    return derive(picked, text, predict, "lang_pred string, score double, ambiguous boolean")
