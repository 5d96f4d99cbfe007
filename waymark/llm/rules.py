"""Quality rules: base counts, then robust multivariate outliers.

For every language and source the minimum covariance determinant (MCD) is sought among the
transformed statistic vectors: the share ``support`` of them whose covariance has the
smallest determinant.  Concentration steps run from four deterministic starts (plain
moments; median and MAD; tanh scores; spatial signs, as in deterministic MCD); after two steps the start with
the smallest determinant goes on until its determinant no longer falls.  A step is
one aggregation: vectors are counted and summed by group, start and bin of their distance
(1/32 octave), and the bins from the nearest on make up the support, the last one in part.
So a hot source costs no more than its share, and nothing is ever ranked row by row.  The
raw estimate, made consistent for normal data, is reweighted once as usual, and a document
is rejected when its squared robust distance exceeds the cut.

Rates of a short text scatter more than those of a long one: a text of n words is taken to have
1 + ``typical_words`` / n times the covariance of a very long one, so squared deviations
weigh n / (n + ``typical_words``) throughout, in means, covariances and distances.  With texts
of one length this is the plain MCD.

Copies count once in the estimates: a vector that occurs often in a group says no more about
it than one that occurs once, and a third of all rows may be copies.  Documents that fail
the base rules are not used.  The MCD needs some five distinct vectors for each statistic: groups
with fewer than ``min_group`` use the estimate of their language, and languages
with as few that of all documents (groups of any size are kept whole if even those are too few).

Nulls: a null text counts as empty; null languages and sources form groups of their own, null ids
are kept.  Ties in distance share a bin; ties between starts go to the first.  Repeated rows
are judged alike, very long texts as a whole.  An empty table gives an empty result.
Columns other than id, text, language and source are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.arrow import derive
from waymark.llm.scratch import drop, materialize
from waymark.llm.textstats import base_statistics

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics vary from one text to the next even in clean prose: one that is constant in most texts has no covariance.
STATISTICS = ("mean_word", "word_spread", "upper_share", "mark_rate", "distinct_rate", "short_share")
P = len(STATISTICS)
#: Least standard deviation of a statistic, a tenth or less of those of prose: it guards against singular matrices.
FLOOR = 0.004
#: The 0.9999 quantile of chi-square with six degrees of freedom, times 1.5: statistics have heavier tails than normal data.
CUT = 1.5 * 27.86
#: Groups up to this many are broadcast (about 1.5 kB each); more are joined by key.
BROADCAST_GROUPS = 20_000
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_BINS = 32
_SPREAD = 512


def vector(s: dict[str, int]) -> list[float]:
    """The statistics, on scales where none depends much on length."""
    w = max(s["n_words"], 1)
    mean = s["n_bytes"] / w
    return [
        math.log1p(s["word_chars"] / w),
        math.log1p(math.sqrt(max(s["n_bytes2"] / w - mean * mean, 0.0))),
        math.sqrt(s["n_upper"] / max(s["n_letters"], 1)),
        math.log1p(20 * s["n_marks"] / w),
        math.log1p(s["n_distinct"]) / math.log1p(w),
        math.asin(math.sqrt(min(s["n_short"] / w, 1.0))),
    ]


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One row per document: id, language, source, counts and the vector ``x``."""

    def measure(texts: list[str | None]) -> list[list]:
        rows = [base_statistics(t) for t in texts]
        return [*([r[c] for r in rows] for c in COUNTS), [vector(r) for r in rows]]

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")
    )
    return derive(picked, "text", measure, ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>")


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return low


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal data that of all."""
    return share / chi_square(quantile(share, P), P + 2)


def _group(lang: Column, source: Column) -> Column:
    return F.concat_ws("\u0001", F.coalesce(lang, F.lit("\u0002")), F.coalesce(source, F.lit("\u0002")))


def _moments(values: list[Column], name: str, w: Column) -> list[Column]:
    return [F.array(*[F.sum(w * v) for v in values]).alias(name), F.array(*[F.sum(w * values[i] * values[j]) for i, j in _PAIRS]).alias(name * 2)]


def _x(name: str = "x") -> list[Column]:
    return [F.col(name)[i] for i in range(P)]


def _distance(m: Column, q: Column) -> Column:
    d = [F.col("x")[i] - m[i] for i in range(P)]
    return F.col("w") * sum((d[i] * d[j] * q[i * P + j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _square(sums: list[float], n: float) -> np.ndarray:
    c = np.zeros((P, P))
    for v, (i, j) in zip(sums, _PAIRS, strict=True):
        c[i, j] = c[j, i] = v / n
    return c


def _centred(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a row of weighted sums: ``n`` vectors of total weight ``w``."""
    mean = np.array(r["s"]) / r["w"]
    return mean, _square(r["ss"], r["n"]) - np.outer(mean, mean) * (r["w"] / r["n"])


def _shape(centre: np.ndarray, covariance: np.ndarray) -> dict:
    covariance = covariance + FLOOR**2 * np.eye(P)
    return {"m": centre.tolist(), "q": np.linalg.inv(covariance).ravel().tolist(), "logdet": float(np.linalg.slogdet(covariance)[1])}


_EST = "start int, m array<double>, q array<double>, logdet double"


def _solved(sums: DataFrame, solve, fields: str) -> DataFrame:
    """Rows that ``solve`` makes of every row of a small table; ``g`` stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"g": r["g"], **e} for r in b.to_pylist() for e in solve(r)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return sums.mapInArrow(run, "g string, " + fields)


_ARROW = pa.schema([("g", pa.string()), ("start", pa.int32()), *((k, pa.list_(pa.field("element", pa.float64()))) for k in "mq"), ("logdet", pa.float64())])


def _middles(good: DataFrame) -> DataFrame:
    """Median and scaled MAD of every statistic of each group, to 1/512, from one histogram."""
    cells = good.select("g", F.posexplode("x").alias("i", "v")).groupBy("g", "i", F.round(F.col("v") * _SPREAD).cast("int").alias("b")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("g", "i")
    for by, value, name in (("b", F.col("b"), "med"), ("off", F.col("off"), "mad")):
        if by == "off":
            cells = cells.withColumn("off", F.abs(F.col("b") - F.col("med")))
        upto = F.sum("n").over(of.orderBy(by).rangeBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("reached", 2 * upto >= F.sum("n").over(of))
        cells = cells.withColumn(name, F.min(F.when(F.col("reached"), value)).over(of))
    one = cells.groupBy("g", "i").agg((F.first("med") / _SPREAD).alias("med"), (F.first("mad") * (1.4826 / _SPREAD)).alias("mad"))
    return one.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "med"))), lambda s: s["med"]).alias("med"), F.transform(F.sort_array(F.collect_list(F.struct("i", "mad"))), lambda s: s["mad"]).alias("mad"))


def _starts(good: DataFrame, small) -> DataFrame:
    """Four estimates for each group."""
    middles = materialize(_middles(good), "rules-middles")
    off = F.transform(F.zip_with("x", "med", lambda a, b: a - b), lambda d, i: F.sqrt("w") * d / F.greatest(F.element_at("mad", i + 1), F.lit(FLOOR)))
    scaled = good.join(small(middles), "g").select("g", "x", "w", off.alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v))
    parts = scaled.withColumn("t", F.transform("z", lambda v: F.tanh(v))).withColumn("u", F.transform("z", lambda v: v / F.greatest(norm, F.lit(1e-9))))
    one = F.lit(1.0)
    sums = parts.groupBy("g").agg(F.count("*").alias("n"), F.sum("w").alias("w"), *_moments(_x(), "s", F.col("w")), *_moments(_x("t"), "t", one), *_moments(_x("u"), "u", one))

    def solve(r: dict) -> list[dict]:
        n, med, mad = r["n"], np.array(r["med"]), np.maximum(r["mad"], FLOOR)
        t = _square(r["tt"], n) - np.outer(r["t"], r["t"]) / n**2
        scale = np.sqrt(np.maximum(np.diag(t), 1e-9))
        signs = _square(r["uu"], n) * P
        shapes = [_centred(r), (med, np.diag(mad**2)), (med, t / np.outer(scale, scale) * np.outer(mad, mad)), (med, signs * np.outer(mad, mad))]
        return [{"start": k, **_shape(*s)} for k, s in enumerate(shapes)]

    return _solved(sums.join(middles, "g"), solve, _EST)


def _step(good: DataFrame, estimates: DataFrame, support: float, small) -> DataFrame:
    """One concentration step of every group and start: the estimate of the nearest ``support`` of the vectors."""
    by = estimates.groupBy("g").agg(F.collect_list(F.struct("start", "m", "q")).alias("e"))
    placed = good.join(small(by), "g").select("g", "x", "w", F.explode("e").alias("e"))
    placed = placed.select("g", "x", "w", F.col("e.start").alias("start"), F.floor(F.log2(_distance(F.col("e.m"), F.col("e.q")) + 1e-3) * _BINS).cast("int").alias("bin"))
    bins = placed.groupBy("g", "start", "bin").agg(F.count("*").alias("n"), F.sum("w").alias("w"), *_moments(_x(), "s", F.col("w")))
    of = Window.partitionBy("g", "start")
    below = F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(of)
    bins = bins.withColumn("part", F.greatest(F.least((total * support - F.coalesce(below, F.lit(0))) / F.col("n"), F.lit(1.0)), F.lit(0.0))).where("part > 0")
    part = F.col("part")
    sums = bins.groupBy("g", "start").agg(
        F.sum(part * F.col("n")).alias("n"), F.sum(part * F.col("w")).alias("w"), F.array(*[F.sum(part * F.col("s")[i]) for i in range(P)]).alias("s"), F.array(*[F.sum(part * F.col("ss")[k]) for k in range(len(_PAIRS))]).alias("ss")
    )
    return _solved(sums, lambda r: [{"start": r["start"], **_estimate(r, 1.0)}], _EST)


def _estimate(r: dict, factor: float) -> dict:
    mean, covariance = _centred(r)
    return _shape(mean, factor * covariance)


def minimum_covariance(good: DataFrame, support: float, most_steps: int, small) -> DataFrame:
    """``good``: g and x.  One row a group: centre m and precision q, reweighted and consistent, and logdet of the raw support."""
    now = materialize(_starts(good, small), "rules-estimate")
    for _ in range(2):
        after = materialize(_step(good, now, support, small), "rules-estimate")
        drop(now)
        now = after
    best = materialize(now.groupBy("g").agg(F.min_by(F.struct("start", "m", "q", "logdet"), F.struct("logdet", "start")).alias("e")).select("g", "e.*"), "rules-estimate")
    drop(now)
    for _ in range(most_steps):
        after = materialize(_step(good, best, support, small), "rules-estimate")
        falls = after.join(best.select("g", F.col("logdet").alias("was")), "g").agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        drop(best)
        best = after
        if falls is None or falls < 1e-4:
            break
    # Reweighting: moments of all vectors within the 0.975 quantile of the raw estimate.
    near = quantile(0.975, P)
    raw = best.select("g", "m", "q", "logdet")
    rows = good.join(small(raw), "g").where(_distance(F.col("m"), F.col("q")) <= near * consistency(support))
    sums = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("w").alias("w"), *_moments(_x(), "s", F.col("w")))
    factor = consistency(0.975)
    weighted = _solved(sums, lambda r: [{"start": 0, **_estimate(r, factor)}], _EST)
    out = materialize(weighted.select("g", "m", "q").join(raw.select("g", "logdet"), "g"), "rules-mcd")
    drop(best)
    return out


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    support: float = 0.75,
    most_steps: int = 20,
    min_group: int = 5 * P,
    typical_words: int = 400,
    cut: float = CUT,
) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance2 (squared robust distance; null if base_failed or with no estimate), level (group, language, all or none: whose estimate)."""
    table = materialize(statistics(docs, id_col, text_col, lang_col, source_col), "rules-stats")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    weight = F.col("n_words") / (F.col("n_words") + typical_words)
    table = table.withColumn("w", weight).withColumn("base_failed", failed).withColumn("g0", _group(F.col("lang"), F.col("source")))
    good = materialize(table.where(~F.col("base_failed")).select("lang", "g0", "x", "w").distinct(), "rules-vectors")

    counts = good.groupBy("lang", "g0").count().withColumn("in_lang", F.sum("count").over(Window.partitionBy("lang")))
    of_lang = _group(F.col("lang"), F.lit("\u0003"))
    level = F.when(F.col("count") >= min_group, "group").when(F.col("in_lang") >= min_group, "language").when(F.lit(good.count() >= min_group), "all").otherwise("none")
    groups = counts.select("g0", level.alias("level"), F.when(level == "group", F.col("g0")).when(level == "language", of_lang).when(level == "all", F.lit("\u0003")).alias("g"))
    groups = materialize(groups, "rules-groups")
    # A hot group must not gather in one task: tables with a row for each group are broadcast up to a bound.
    small = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda df: df)
    # An estimate of a language is over all of its documents, those of its large groups too.
    own = good.join(small(groups.where("level = 'group'")), "g0").select("g", "x", "w")
    wanted = groups.where("level <> 'group'").select("g").distinct()
    lang = good.select(of_lang.alias("g"), "x", "w").join(small(wanted), "g", "left_semi")
    every = good.select(F.lit("\u0003").alias("g"), "x", "w").join(small(wanted), "g", "left_semi")
    vectors = materialize(own.unionByName(lang).unionByName(every).distinct(), "rules-grouped")
    drop(good)
    estimate = minimum_covariance(vectors, support, most_steps, small)
    drop(vectors)

    # Groups all of whose documents fail the base rules have no estimate and need none.
    judged = table.join(small(groups), "g0", "left").join(small(estimate), "g", "left")
    distance = F.when(~F.col("base_failed"), _distance(F.col("m"), F.col("q")))
    return judged.withColumn("distance2", distance).select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True))).alias("kept"), F.round("distance2", 6).alias("distance2"), "level"
    )
