"""From the documents table to packed training windows.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
a DataFrame; all but the last return the columns of documents.  ``run`` writes each stage's
result as Parquet in the shared folder and reads it again for the next one, so that a lost
executor costs no more than the stage at work; what a stage has read is deleted when the next
one's result stands.

Defined cases: rows of null ids pass all stages but those that look at their text alone
(toxicity) and are packed first; null, empty and blank texts that were so before stay, and
are packed with length 1; repeated rows share their fate, but of a group of similar documents
all rows of the least id stay; an empty table gives an empty result; without labels nothing
is toxic, without benchmark items nothing is contaminated; columns of any further name are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import common, jaccard, linededup, packing, templates, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out; documents of which no line is left go.  Others keep their columns; n_chars follows the text."""
    removed = common.fresh(docs, "__removed")
    cut = linededup.dedup(docs, removed=removed)
    left = cut.where(f"{removed} = 0 or trim(BOTH ' \\t\\r\\n' FROM text) <> ''")
    chars = [F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.select(*chars)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id stays."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers and names, go."""
    return templates.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stage is a trained classifier and the last is sequential: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
