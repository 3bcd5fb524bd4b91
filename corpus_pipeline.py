"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last returns the packed
pieces. No stage holds state outside its tables, so a stage can be run again on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm.langid import fit_languages, predict_languages
from loomfold.llm.linededup import dedup_lines
from loomfold.llm.mixing import mix_documents
from loomfold.llm.ngramjoin import jaccard_components
from loomfold.llm.packing import pack_documents
from loomfold.llm.shared import Scratch, broadcast_if_small, until_written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose n-grams speak against all learned languages (``lang_known``).

    So null and empty texts go; if no row teaches a language all go. Rows that repeat and null ids are judged by their text
    like others, and of languages that fit alike the first by name is taken; texts of any length are read whole; columns besides
    those of documents are not read; an empty table gives none.
    """
    judged = predict_languages(docs, fit_languages(docs), carry=COLUMNS)
    kept = judged.where((F.col("lang_pred") != "und") & F.col("lang_known"))
    return kept.select(*[F.col(f"rest.{c}").alias(c) for c in COLUMNS])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go; documents that lose all their lines go with them.

    ``n_chars`` is that of what is left; of columns besides those of documents none is read, whatever its name. Null texts stay null, with null ``n_chars``; rows that repeat an id are one
    document, as are all without an id, which comes last; lines of any length are compared whole; an empty table gives none.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    left = out.where((F.col("n_dropped") == 0) | (F.length(F.trim(F.coalesce("kept_text", F.lit("")))) > 0))
    rest = [F.col(f"rest.{c}").alias(c) for c in ("lang", "source")]
    return left.select(F.col("rest.doc_id").alias("doc_id"), F.col("kept_text").alias("text"), *rest, F.length("kept_text").cast("long").alias("n_chars"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the smallest document stays.

    Documents without an id stay, as do those without words, which link with nothing. Rows that repeat an id are one
    document and stay or go together; equal texts are a group like others. Columns besides those of documents are not read. An
    empty table gives none.
    """
    found = jaccard_components(docs, words=5, percent=80)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(broadcast_if_small(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: good ones about once, poor and toxic ones seldom.

    Null and empty texts have no tokens and stay once. Rows that repeat an id have their rates each and share their luck; rows
    without an id share it too. Columns besides those of documents are not read. Labels of other documents, null labels and contradicting ones do no harm; without labels
    all have the same posterior. An empty table gives none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mix_documents(docs.select(*COLUMNS), labels, carry=COLUMNS)
    several = mixed.where("copies > 0").select("rest", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return several.select(*[F.col(f"rest.{c}").alias(c) for c in COLUMNS])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096, with their ids.

    Null and empty texts are the end id alone; rows that repeat are packed each; pieces of equal length go in the order of
    partitions; long texts become several pieces; columns besides id and text are not read; an empty table gives none.
    """
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_to_targets),
    ("packing", pack),
]

#: Learned models decide in two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has read is deleted when its own result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        before = None
        for name, stage in STAGES[:-1]:
            with until_written(spark):  # what the stage's operator keeps goes as well
                docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
            if before:
                scratch.free(before)
            before = f"stage-{name}"
        return STAGES[-1][1](spark, docs, sf_dir)  # packing stores its pieces before it returns
