"""Whole-text statistics of one document, shared by the quality operators."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values of the contract: separators of words, and the symbols that are counted.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, np.ndarray] = {}


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters outside ``[\\x20\\x09-\\x0D]``, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit polynomial hash of every ``size`` consecutive words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = _POWERS.get(size)
    if powers is None:
        powers = _POWERS[size] = np.array([pow(int(_ODD), k, 1 << 64) for k in range(size)], np.uint64)
    out = word_hashes[:n] * powers[0]
    for k in range(1, size):
        out += word_hashes[k : k + n] * powers[k]
    return out


def covered_by(starts: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a window of ``size`` words at one of ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def repeat_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    if len(words) <= size:
        return 0
    hashed = window_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), size)
    order = np.argsort(hashed, kind="stable")
    ordered = hashed[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(hashed), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(covered_by(np.flatnonzero(twice), len(words), size).sum())


def base_statistics(text: str | None) -> dict[str, int]:
    """Counts of words, lines and kinds of characters; n_bytes and n_bytes2 are the sums of the words' lengths in bytes and of their squares."""
    text = text or ""
    words = words_of(text)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.bincount(np.minimum(codes, 256), minlength=257)
    upper = int(small[65:91].sum()) + int(small[0xC0:0xDF].sum())
    letters = upper + int(small[97:123].sum()) + int(small[0xDF:257].sum())
    marks = int(small[33:48].sum() + small[58:65].sum() + small[91:97].sum() + small[123:127].sum())
    return {
        "n_words": len(words),
        "word_chars": len(text) - int(sum(small[ord(c)] for c in SEPARATORS)),
        "n_symbols": int(sum(small[ord(c)] for c in SYMBOLS)),
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(words),
        "n_upper": upper,
        "n_letters": letters,
        "n_marks": marks,
        "n_distinct": len(set(words)),
        "n_short": int((sizes <= 2).sum()),
        "n_bytes": int(sizes.sum()),
        "n_bytes2": int((sizes * sizes).sum()),
        "n_digits": int(small[48:58].sum()),
        "n_stops": int(small[46]),
    }


#: Transformed statistics: rates on a log or square-root scale, so that none depends on length.
TRANSFORMED = ("mean_word", "symbol_rate", "dup_share", "repeat_share", "upper_share", "mark_rate")


def transformed(s: dict[str, int]) -> list[float]:
    w, lines = max(s["n_words"], 1), max(s["n_lines"], 1)
    return [
        math.log1p(s["word_chars"] / w),
        math.log1p(100 * s["n_symbols"] / w),
        math.sqrt(s["n_dup_lines"] / lines),
        math.sqrt(s["n_repeat_words"] / w),
        math.sqrt(s["n_upper"] / max(s["n_letters"], 1)),
        math.log1p(20 * s["n_marks"] / w),
    ]
