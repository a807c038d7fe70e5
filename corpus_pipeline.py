"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import read, stored
from pagequarry.llm.cotrain import classify
from pagequarry.llm.mixing import mix
from pagequarry.llm.neardup import near_duplicates
from pagequarry.llm.packing import pack
from pagequarry.llm.repetition import judged, repetition


def _whole(docs: DataFrame) -> DataFrame:
    """Each row also as one column, so that no column of a result meets one of its names."""
    return docs.select("doc_id", "text", "lang", "source", "n_chars", F.struct(*docs.columns).alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the suffix-array repetition rule keep.

    Null, empty and white texts have no words and go. Repeated rows are judged
    alike, long texts whole. An empty table stays empty. All columns pass
    through under their names, whatever these are.
    """
    return judged(repetition(_whole(docs), keep=["row"])).where("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers take for neither low nor toxic.

    Nulls in any column are values like others, null and empty texts are judged
    as empty, long texts whole, repeated rows alike. Without usable labels
    nothing is rejected; an empty table stays empty. All columns pass through
    under their names, whatever these are.
    """
    return classify(_whole(docs), read(spark, sf_dir, "labels"), keep=["row"]).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked at 0.8 of five-word
    shingles.

    Of rows with one doc_id and one text, the least by its other columns stays;
    rows with one doc_id and different texts stay all if their id does. Rows
    without doc_id stay all, and so do null, empty and white texts, which are
    linked to nothing. Long texts are compared whole; an empty table stays
    empty. All columns pass through under their names.
    """
    dropped = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).where("not kept").select("doc_id").distinct()
    out = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    repeated = stored(repeated, "repeated")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_first"), *others)).alias("_row"))
    once = once.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return out.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight 1, 2, 3; a document appears once for each pass
    that takes at least half of it.

    Texts without words are never taken. A null source is a source of its own;
    rows without doc_id and repeated rows are documents of their own. Long texts
    pass whole; an empty table stays empty. All columns pass through under
    their names.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences.

    Null and empty texts are the end id alone; repeated rows and rows without
    doc_id are packed like any other; a long text runs over several sequences.
    An empty table gives no piece. Other columns are ignored.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier and keyed draws have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
