"""What filters remove in every order they could be applied in: a long-form evaluation by windows.

Every document has a mask, one bit for each filter it fails.  Documents are summed up by part
and mask first, so that what follows has at most 2 ** filters cells a part, however many documents there are.
The cells are unpivoted against the steps of all orders of the filters; a running bit-or over the steps
before says what a cell failed earlier, conditional sums give the counts of each step, and a
window over all orders and steps of a filter its total.

Null texts are empty and have no words (they fail the filter of few words and none other but that of copies).
Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, compared as they are; texts of any length are read whole.  A text is a copy if an
equal one has a smaller id in the whole table; rows that share the least id of a text are
none, and null ids come last: they are copies of any text that has an id, and not of each other.  Repeated rows count as often as they are there.  Null parts are the empty
string, one part with those that are empty.  A label counts if any of its rows is 1; documents without one have neither.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.arrow import derive

_UPPER = bytes(range(65, 91))
#: Fixed values of the contract: the symbols of filter D.
SYMBOLS = b"#$%&*|"

Counts = tuple[int, int, int, int, int]
#: What a text fails, by (words, distinct words, A-Z, code points, symbols): the filters A to D of the contract.
RULES: dict[str, Callable[[Counts], bool]] = {
    "A": lambda c: c[0] < 100,
    "B": lambda c: 100 * c[1] < 80 * c[0],
    "C": lambda c: 100 * c[2] > 10 * c[3],
    "D": lambda c: c[4] > 0,
}
#: The filter of copies, which needs the table and not the text alone.
COPY = "E"


def counts(text: str | None) -> Counts:
    """Words, distinct words, A-Z, code points, symbols."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    return len(words), len(set(words)), len(raw) - len(raw.translate(None, _UPPER)), len(text or ""), len(raw) - len(raw.translate(None, SYMBOLS))


def cells(docs: DataFrame, labels: DataFrame, *, rules: dict[str, Callable[[Counts], bool]] | None = None, copy: str | None = COPY, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part and mask: part, mask, n, good, toxic.  Bit k of a mask stands for the k-th rule, the bit after them for ``copy``."""
    rules = RULES if rules is None else rules

    def judge(texts: list[str | None]) -> list[list]:
        every = [counts(t) for t in texts]
        return [[sum(fails(c) << k for k, fails in enumerate(rules.values())) for c in every], [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]]

    picked = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    judged = derive(picked, "text", judge, "mask int, digest binary")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = judged.join(marked, "doc", "left").fillna(0, ["good", "toxic"]).withColumn("doc", F.coalesce("doc", F.lit(2**63 - 1)))
    kinds = ["part", "mask", "good", "toxic"]
    # Rows of one id first, then those of one text and kind: copies by the million leave one row a task.
    rows = joined.groupBy("doc", "digest", *kinds).agg(F.count("*").alias("n"))
    texts = rows.groupBy("digest", *kinds).agg(F.sum("n").alias("n"), F.min(F.struct("doc", "n")).alias("first"))
    least = F.min("first.doc").over(Window.partitionBy("digest"))
    own = F.when(F.col("first.doc") == least, F.col("first.n")).otherwise(F.lit(0)).alias("own")
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("own").alias("k")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(rules) if copy else 0)).alias("m"), (F.col("n") - F.col("own")).alias("k")))).alias("s")
    both = texts.select(*kinds, "n", own).select("part", "good", "toxic", split).where("s.k > 0")
    return both.groupBy("part", F.col("s.m").alias("mask")).agg(F.sum("s.k").alias("n"), F.sum(F.col("s.k") * F.col("good")).alias("good"), F.sum(F.col("s.k") * F.col("toxic")).alias("toxic"))


def interactions(cell_table: DataFrame, filters: str) -> DataFrame:
    """Counts for every part, order of ``filters`` and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  Bit k of a mask stands for the k-th letter."""
    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)])).alias("filter_order")
    steps = cell_table.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    long = steps.withColumn("filter", letter).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("filter")) - 1))
    long = long.withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda of, condition: F.sum(F.when(condition, F.col(of)).otherwise(0))
    by_step = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    return by_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """:func:`interactions` of the five filters of the contract."""
    return interactions(cells(docs, labels, **columns), "".join(RULES) + COPY)
