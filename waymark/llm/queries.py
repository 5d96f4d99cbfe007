"""The thin queries over the driver's tables: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import audit, centroids, decontaminate, html_text, jaccard, language, licenses, lines, packing, quality, rules, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe_substrings(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: a document lies in <source>/<id div 1000>/<id div 50>, and the first of each fifty ids is that folder's licence file."""
    docs = _table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 50).cast("string"))
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return licenses.scan(docs.withColumn("path", F.concat_ws("/", folder, name)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", *rules.COUNTS, "base_failed", "kept", "distance2", "level")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op5's base rules use."""
    counts = rules.statistics(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return counts.select("doc_id", *rules.COUNTS)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedupe_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_license_scan,
        op3_simhash_near_dedup,
        op4_benchmark_decontamination,
        op5_quality_rules,
        quality_counts,
        op6_html_extraction,
        op7_best_fit_packing,
        op8_language_id,
        op9_quality_classifier,
        op10_line_dedup,
        op11_filter_audit,
        op12_jaccard_join,
        op13_centroid_clusters,
    )
}

#: Letters beyond ASCII in the documents, for SQL whose edit distance counts bytes: each becomes one byte that no text holds.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßáâäçèéêíîñóöúü"
_BYTES = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)][: len(_LETTERS)])



def _clusters(k: int = 40, rounds: int = 5) -> str:
    """SQL of op13: as many assignments and means as there are rounds, and one assignment more."""
    nearest = "(SELECT vec_id, v, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT x.vec_id, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{n} m ON true) GROUP BY vec_id, v)"
    steps = [f"""x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM x QUALIFY c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED {nearest.format(n=n)}")
        if n < rounds:
            steps.append(
                f"s{n} AS (SELECT c, i, sum(e)::BIGINT AS s, count(*) AS k FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS i FROM a{n}) GROUP BY c, i), "
                f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(w.m, c{n}.m) AS m FROM c{n} LEFT JOIN (SELECT c, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS m FROM s{n} GROUP BY c) w ON w.c = c{n}.c)"
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a{rounds}.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} m ON m.c = a{rounds}.c"""


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Where SQL can state the result: windows over positions of words, and pairs of lines.
ORACLES = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT d.doc_id, part, len(ws) < 100 AS A, 100 * len(list_distinct(ws)) < 80 * len(ws) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, d.doc_id > min(d.doc_id) OVER (PARTITION BY t) AS E, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS ord FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT ord, unnest(range(1, 6)) AS step FROM o), p AS (SELECT DISTINCT part FROM f),
m AS (SELECT part, {'A': A, 'B': B, 'C': C, 'D': D, 'E': E} AS m, (A::INT + B::INT + C::INT + D::INT + E::INT) AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT m.part, ord, step, m.n, m.good, m.toxic, m.fails, list_transform(string_split(ord, ''), lambda c: CASE c WHEN 'A' THEN m.m.A WHEN 'B' THEN m.m.B WHEN 'C' THEN m.m.C WHEN 'D' THEN m.m.D ELSE m.m.E END) AS b FROM m, s),
y AS (SELECT *, b[step] AS now, len(list_filter(b[1 : step - 1], lambda v: v)) > 0 AS gone FROM x),
z AS (SELECT part, ord, step, coalesce(sum(n) FILTER (WHERE NOT now AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE now AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE now AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE now AND fails = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE now AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE now AND NOT gone), 0) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, ord AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, ord[step]))::BIGINT AS shapley FROM z""",
    "op12_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ABC}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.b)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op13_centroid_clusters": _clusters(),
    "quality_counts": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i AS s, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
twice AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS i FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id""",
    "op10_line_dedup": rf"""
WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, regexp_matches(line, '[^ 	-
]') AS full_ FROM o),
f AS (SELECT line, min({{'d': doc_id, 'k': k}}) AS first, length(line) AS n, translate(line, '{_LETTERS}', {_BYTES}) AS s FROM x WHERE full_ GROUP BY line),
p AS (SELECT a.line AS a, b.line AS b FROM f a JOIN f b ON a.first < b.first AND b.n BETWEEN a.n - 2 AND a.n + 2 AND a.n >= 5 AND b.n >= 5 AND levenshtein(a.s, b.s) <= 2),
links AS (SELECT line, count(*) AS n, bool_or(later) AS later FROM (SELECT a AS line, false AS later FROM p UNION ALL SELECT b, true FROM p) GROUP BY line),
y AS (SELECT x.*, x.full_ AND NOT (f.first = {{'d': x.doc_id, 'k': x.k}} AND NOT coalesce(links.later, false)) AS gone, CASE WHEN f.first = {{'d': x.doc_id, 'k': x.k}} THEN coalesce(links.n, 0) ELSE 0 END AS links FROM x LEFT JOIN f ON x.full_ AND f.line = x.line LEFT JOIN links ON links.line = f.line),
z AS (SELECT doc_id, count(*) FILTER (WHERE full_) AS n, count(*) FILTER (WHERE gone) AS r, sum(links) AS l, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS t FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, coalesce(l, 0)::BIGINT AS n_links, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id""",
    "op1_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i AS s, array_to_string(ws[i : i + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w)),
dup AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM dup),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
  SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY p.i), '') AS t
  FROM pos p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
}
