"""A training corpus from documents: filtered, without copies and repeats, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.llm import ngram_join, packing, quality_rules, source_mixing, substring_dedup
from namelens.llm.common import numbered, saved, table
from namelens.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep.

    Null and blank texts fail the base rule and go; rows are judged by their text
    alone, so null, shared and repeated ids and repeated rows change nothing; an
    empty table stays empty; other columns are kept, whatever their names.
    """
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 and more), the one with the least doc_id.

    A null doc_id is the least; ties are broken by a hash of id and text. Rows are
    told apart by id and text, so null and reused ids lose no other text; of rows
    that repeat both, one stays. Null and blank texts link with nothing and stay.
    An empty table stays empty; other columns are kept, whatever their names.
    """
    flat, at = numbered(docs)
    ids = {"id_col": at["doc_id"], "text_col": at["text"]}
    groups = ngram_join.near_duplicates(flat, k=5, percent=80, counts=False, keep_keys=True, **ids)
    groups = saved(groups.select("doc_id", "row_key", "component_key"), "near-groups")
    first = groups.filter("component_key is not null").groupBy("component_key").agg(F.min(F.struct("doc_id", "row_key")).alias("least")).select("least.row_key")
    key = F.xxhash64(F.col(at["doc_id"]).cast("long"), F.col(at["text"]).cast("string"))
    keyed = flat.withColumn("key", key)
    stay = keyed.join(first, keyed["key"] == first["row_key"], "left_semi").dropDuplicates(["key"])
    alone = keyed.join(groups.filter("component_key is null").select("row_key").distinct(), F.col("key") == F.col("row_key"), "left_semi")
    return stay.unionByName(alone).drop("key").toDF(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that an earlier one holds; others stay as they are.

    Rows without words stay as they are; a null doc_id comes before all others;
    rows that share an id do not cover each other; a text of repeats alone becomes
    empty. An empty table stays empty; other columns are kept, whatever their names.
    """
    flat, at = numbered(docs)
    out = substring_dedup.remove_repeats(flat, id_col=at["doc_id"], text_col=at["text"])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(at["text"]))
    changed = {at["text"]: text}
    if "n_chars" in at:
        changed[at["n_chars"]] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*at.values()).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: what each pass over a source takes of a document, as a row.

    Rows without words are not taken; a null source is one of its own; rows that
    share an id are taken each on its own; an empty table stays empty; other
    columns are kept, whatever their names.
    """
    return source_mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of the documents stand in sequences of 2048 tokens.

    Null and blank texts give the end token and what white space encodes to; rows
    that share an id are packed each on its own; an empty table gives no rows;
    other columns are left out.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", rules),
    ("n-gram join", near_duplicates),
    ("substring dedup", repeats),
    ("source mixing", mixing),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
