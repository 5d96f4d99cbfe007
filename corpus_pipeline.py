"""A corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of documents.  Stages are written and read again in between, and what a stage wrote on
its way is deleted then.  Documents with a null id pass the stages that decide by id, equal rows
of one id share its fate, other columns are dropped.  Null and empty texts go with language
ID; a document whose lines all go stays, with what is left, and as many such documents as there are
are one group of near copies.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, language, lines, packing, simhash
from waymark.llm.scratch import materialize, own_tables, sweep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids up to this many (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not in ``ids`` (column doc_id)."""
    ids = materialize(ids.where("doc_id is not null").distinct(), "pipeline-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is ambiguous, go."""
    out = language.identify(docs, carry=COLUMNS[1:])
    return out.where("lang_pred <> 'und' and not ambiguous").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, or nearly so, go; every document stays."""
    out = lines.dedupe_lines(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    groups = simhash.near_duplicates(docs)
    return _without(docs, groups.where("doc_id <> component_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: SQL cannot express the classifier, the fingerprints or the packing; a test compares all stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_tables() as made:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = materialize(docs, "pipeline-" + name.lower().replace(" ", "-"))
                sweep(spark, made, keep=docs)
    return docs
