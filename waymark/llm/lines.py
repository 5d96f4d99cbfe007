"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines within ``tau`` edits share one of ``tau + 1`` segments of the shorter or equal
partner at nearly the same place: edits cannot touch all segments.  All segments of a line have
the size ``n // (tau + 1)``; the last ends with the line, the others follow each other from its start.  Every distinct
line is indexed by its segments under their number, and probes the indexes of the
lengths it could match with the substrings that the multi-match-aware rule allows (the shift
of a segment is bounded by the edits to its left and to its right); partners of several lengths are
met by one substring where their segments have one size.  Lines that share a
substring are candidates if the counts of frequent letters can be that near, then of others too, and are verified by a
banded bit-parallel edit distance over a band of ``2 tau + 1`` diagonals, folded over the characters with bit operations.

A line is every part of a text between line feeds that is not blank; blank lines are kept as
they are.  A line is removed when an equal line, or one within ``tau`` edits, occurs earlier
(smaller id, or same id and earlier line), whether or not that one stays.  Lines shorter than
``min_chars`` match only equal lines.

Null texts have no lines and stay null; null ids come last.  Rows that share an id are ranked
by a hash of their text, equal rows are the same text twice and get the same result.  Very long texts and lines are
compared whole.  An empty table gives an empty result.
Other columns are ignored; a carried column may not have the name of another column of the result.  Distinct lines are found with partial sums before the shuffle, so
that a line in a third of all documents costs one row per task; their table is written once and read by all later steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import drop, materialize, parallelism

#: Candidate lines up to this many are broadcast to the second scan (24 bytes each); more are joined by key.
BROADCAST_LINES = 1_000_000


def _documents(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, text and the id of the row: its document id and a hash of its text for rows that share one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry]).withColumn("row", F.xxhash64("text"))


def _occurrences(documents: DataFrame) -> DataFrame:
    """Every non-blank line: doc (null ids last), row, line number and text."""
    lines = documents.where("text is not null").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(~_blank(F.col("line")))


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\x0b\x0c\r")) == ""


def _rules(tau: int) -> list[list[tuple[int, int, int]]]:
    """By the remainder of a line's length: (segment, how much smaller, shift) of its substrings, each named once; first those that are its own segments.

    The multi-match-aware selection of a partner ``less`` characters shorter: at most i edits left of segment i, and tau - i right of it.
    The last segment ends with the line and needs no shift.  Two lines of one length meet both ways: with tau = 2 they share the
    first or the last segment, or have an edit on either side of the middle one, which is shifted to the right as seen from one of them.
    """
    own = [(i, 0, 0) for i in range(tau + 1)]
    shifts = lambda less, i: [0] if i == tau else range(0 if less == 0 and tau <= 2 else max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)
    return [list(dict.fromkeys([*own, *((i, int(less > rest), shift) for less in range(tau + 1) for i in range(tau + 1) for shift in shifts(less, i))])) for rest in range(tau + 1)]


def _keyed(lines: DataFrame, tau: int, rules: list[list[tuple[int, int, int]]], name: str) -> DataFrame:
    """One row for each substring: its key, the line and its letters, marked unless the substring is one of the line's own segments."""
    parts = tau + 1
    rule = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("smaller"), F.lit(s).alias("shift")) for i, d, s in of]) for of in rules])
    part = F.call_function("div", F.col("n"), F.lit(parts)).cast("int").alias("part")
    dealt = lines.select("line", "n", part, "lid", "letters", F.explode(F.get(rule, F.col("n") % parts)).alias("r"))
    i, shift = F.col("r.i"), F.col("r.shift")
    size = F.col("part") - F.col("r.smaller")
    at = F.when(i == tau, F.col("n") - size).otherwise(i * size + shift) + 1
    own = (F.col("r.smaller") == 0) & (shift == 0)
    letters = F.when(own, F.col("letters")).otherwise(F.col("letters").bitwiseOR(F.lit(_PROBE)))
    return dealt.where((at >= 1) & (at + size - 1 <= F.col("n"))).select(F.xxhash64(i, F.substring("line", at, size)).alias("key"), F.col("lid").alias(name), letters.alias(f"letters_{name}"))


#: Frequent letters of European languages; any letters would do.
LETTERS = "eanitorshdlu"
#: Further characters that tell apart lines that became pairs.
MORE_LETTERS = "cmpgbfvwyk ."


#: Set beside the letters where the substring is not a segment of its own line; own segments meet both ways, and one is enough.
_PROBE = 1 << (4 * len(LETTERS))


def _letters(line: Column, letters: str = LETTERS) -> Column:
    """How often each of the letters occurs, modulo 16, in four bits each; every letter is counted in what those before it left."""
    rest, had, total = line, F.octet_length(line), F.lit(0).cast("long")
    for k, c in enumerate(letters):
        rest = F.replace(rest, F.lit(c), F.lit(""))
        has = F.octet_length(rest)
        total = total + F.shiftleft((had - has).bitwiseAND(F.lit(15)).cast("long"), 4 * k)
        had = has
    return total


def _letters_apart(a: Column, b: Column) -> Column:
    """Sum of the (circular) differences: an edit changes it by two at most."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        d = (F.shiftright(a, 4 * k) - F.shiftright(b, 4 * k)).bitwiseAND(F.lit(15))
        total = total + F.least(d, 16 - d)
    return total


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of ``a`` and ``b``, exact up to ``tau``; their lengths differ by ``tau`` at most, and ``a`` has ``tau`` characters at least.

    The diagonals -tau..tau of the matrix are the bits of one word, which moves down one row
    with every character of ``b``: ``vp`` and ``vn`` are its vertical differences.  The score
    follows the lowest diagonal until that leaves ``a``, and then the last row.
    """
    m, n = F.length(a), F.length(b)
    width = 2 * tau + 1
    mask, top = F.lit((1 << width) - 1).cast("long"), F.lit(1 << (2 * tau)).cast("long")
    none = F.array(F.lit("")).cast("array<string>")
    # Rows before the first and after the last character of a match nothing.
    rows = F.concat(F.array_repeat(F.lit(""), tau), F.slice(F.split(a, ""), F.lit(1), m), F.array_repeat(F.lit(""), 2 * width), none)

    def step(rows: Column, s: Column, c: Column) -> Column:
        j, vp, vn = s["j"], s["vp"], s["vn"]
        # Bit k stands for row j - tau + k, counted from 0.
        x = vn
        for k in range(width):
            x = x.bitwiseOR(F.when(F.element_at(rows, j + (k + 1)) == c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseAND(mask)
        return F.struct(j.alias("j"), vp.alias("vp"), vn.alias("vn"), d0.alias("d0"), s["score"].alias("score"))

    def move(m: Column, s: Column) -> Column:
        j, vp, vn, d0 = s["j"], s["vp"], s["vn"], s["d0"]
        hp = vn.bitwiseOR(F.bitwise_not(vp.bitwiseOR(d0)).bitwiseAND(mask))
        hn = d0.bitwiseAND(vp)
        last = F.greatest(m - 1 - j + tau, F.lit(0))
        along = F.call_function("shiftright", hp, last).bitwiseAND(F.lit(1)) - F.call_function("shiftright", hn, last).bitwiseAND(F.lit(1))
        down = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0).cast("long")
        below = F.shiftright(d0, 1)
        return F.struct(
            (j + 1).alias("j"),
            hn.bitwiseOR(F.bitwise_not(below.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
            below.bitwiseAND(hp).alias("vn"),
            F.lit(0).cast("long").alias("d0"),
            (s["score"] + F.when(j < m - tau, down).otherwise(along)).alias("score"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("j"), F.lit(((1 << width) - 1) & ~((1 << tau) - 1)).cast("long").alias("vp"), zero.alias("vn"), zero.alias("d0"), F.lit(tau).cast("long").alias("score"))
    # transform over a single element binds a value once: the rows for the whole fold, the state between the halves of a step.
    def fold(side: Column) -> Column:
        chars = F.slice(F.split(b, ""), F.lit(1), n)
        return F.aggregate(chars, start, lambda s, c: F.transform(F.array(step(side["rows"], s, c)), lambda t: move(side["m"], t))[0])["score"]

    return F.transform(F.array(F.struct(rows.alias("rows"), m.alias("m"))), fold)[0]


def near_links(docs: DataFrame, tau: int, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(first occurrence of every distinct line, verified links between distinct lines).

    Firsts: lid, doc, row, line_no.  Links: a, b (line ids) and whether a comes first.
    A line's id is its number in the table of distinct lines, so no two lines share one.
    """
    spark = docs.sparkSession
    least = max(min_chars, 2 * tau + 1)
    first = _occurrences(_documents(docs, id_col, text_col)).groupBy("line").agg(F.min(F.struct("doc", "row", "line_no")).alias("first"))
    lines = materialize(first.select(F.monotonically_increasing_id().alias("lid"), "line", F.length("line").alias("n"), _letters(F.col("line")).alias("letters"), "first"), "lines")

    long = lines.where(F.col("n") >= least)
    rules = _rules(tau)
    indexed = _keyed(long, tau, [of[: tau + 1] for of in rules], "a")
    probing = _keyed(long, tau, rules, "b")
    # Lines that share a segment but differ by whole words are told apart before they become pairs.
    met = indexed.join(probing, (indexed["key"] == probing["key"]) & ((F.col("a") < F.col("b")) | (F.col("a") != F.col("b")) & (F.col("letters_b") >= _PROBE)) & (_letters_apart(F.col("letters_a"), F.col("letters_b")) <= 2 * tau))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "lines-pairs")

    ids = materialize(pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).distinct(), "lines-candidates")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids
    texts = materialize(lines.select("lid", "line", "letters", "first").join(wanted, "lid", "left_semi").withColumn("more", _letters(F.col("line"), MORE_LETTERS)), "lines-texts")
    side = lambda x: texts.select(F.col("lid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("line", "letters", "more", "first")])
    apart = _letters_apart(F.col("letters_a"), F.col("letters_b")) + _letters_apart(F.col("more_a"), F.col("more_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.abs(F.length("line_a") - F.length("line_b")) <= tau) & (apart <= 2 * tau))
    # Verification is long work on few bytes: spread it over all tasks.
    both = both.repartition(parallelism(spark), "a", "b")
    close = both.where(banded_distance(F.col("line_a"), F.col("line_b"), tau) <= tau)
    links = materialize(close.select("a", "b", (F.col("first_a") < F.col("first_b")).alias("a_first")), "lines-links")
    for done in (texts, pairs, ids):
        drop(done)
    return lines.select("lid", "first.doc", "first.row", "first.line_no"), links


def dedupe_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, min_chars: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text (without removed lines), n_lines, n_removed, n_links (links of the lines first seen there), and the columns named by ``carry``."""
    if clash := {"doc_id", "text", "n_lines", "n_removed", "n_links"}.intersection(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    firsts, links = near_links(docs, tau, min_chars, id_col, text_col)
    ends = links.select(F.col("a").alias("lid"), (~F.col("a_first")).alias("later")).union(links.select("b", "a_first"))
    linked = ends.groupBy("lid").agg(F.count("*").alias("links"), F.max("later").alias("later"))
    held = firsts.join(linked, "lid", "left").groupBy("doc", "row").agg(
        F.sort_array(F.collect_list(F.when(F.coalesce("later", F.lit(False)), None).otherwise(F.col("line_no")))).alias("keep"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links")
    )
    documents = _documents(docs, id_col, text_col, carry).withColumn("doc", F.coalesce("doc_id", F.lit(2**63 - 1)))
    joined = documents.join(held, ["doc", "row"], "left")
    lines = F.split("text", "\n", -1)
    keep = F.coalesce("keep", F.array().cast("array<int>"))
    # 0/1 for every line: zeros up to each kept line, a one for it, zeros to the end.
    before = F.concat(F.array(F.lit(-1)), F.slice(keep, 1, F.greatest(F.size(keep) - 1, F.lit(0))))
    ones = F.flatten(F.zip_with(keep, before, lambda x, p: F.when(x.isNotNull(), F.concat(F.array_repeat(F.lit(0), x - p - 1), F.array(F.lit(1)))).otherwise(F.array().cast("array<int>"))))
    flags = F.concat(ones, F.array_repeat(F.lit(0), F.size("all_lines") - F.size(ones)))
    marked = joined.withColumn("all_lines", lines).withColumn("flags", flags)
    stays = F.zip_with("all_lines", "flags", lambda x, f: F.when((f == 1) | _blank(x), x))
    out = marked.withColumn("stays", F.filter(stays, lambda x: x.isNotNull())).withColumn("n_lines", F.coalesce(F.size(F.filter("all_lines", lambda x: ~_blank(x))), F.lit(0)))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNotNull(), F.array_join("stays", "\n")).alias("text"),
        F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("all_lines") - F.size("stays")).cast("long").alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )
