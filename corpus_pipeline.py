"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontaminate as leaks
from runlens.llm import jaccard, packing, quality_rules, secret_scan
from runlens.llm.common import checkpoint_folder, durable, table
from runlens.llm.queries import TOKENIZER


def document(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality_rules.quality_rules(docs.select(document(docs), "text"))
    return judged.where("quality.kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, and of one id the smallest hash of the text.

    Near copies have a Jaccard similarity of 0.8 or more over shingles of five words. Rows are told apart by hashes of the
    text and of all columns; wholly equal rows count as one. Documents without an id cannot be named as copies and stay.
    """
    row = F.struct("doc_id", F.xxhash64("text").alias("text"), F.xxhash64(F.to_json(document(docs))).alias("rest"))
    marked = docs.select(document(docs), "text", F.when(F.col("doc_id").isNotNull(), row).alias("row"))
    found = jaccard.near_copies(marked, id_col="row")
    gone = found.where("row is not null and row <> component_id").select("row").distinct()
    kept = marked.where("row is not null").join(gone, "row", "left_anti").dropDuplicates(["row"])
    return kept.unionByName(marked.where("row is null").select("row", "document", "text")).select("document.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = leaks.decontaminate(docs.select(document(docs), "text"), table(spark, sf_dir, "benchmark"), id_col="document")
    return found.where(F.size("spans") == 0).select("document.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    marked = docs.select(document(docs), "text")
    scan = durable(secret_scan.found(marked, id_col="document"))
    model = secret_scan.fit(secret_scan.labelled_tokens(scan))
    spans = secret_scan.all_spans(F.col("base"), F.col("tokens"), model)
    clean = scan.select(F.col("id").alias("document"), secret_scan.redacted(F.col("id.text"), spans).alias("clean"))
    length = F.when(F.col("document.text").isNull(), F.col("document.n_chars")).otherwise(F.char_length("clean"))
    changed = {"text": F.col("clean"), "n_chars": length}
    return clean.select(*[
        changed[c].cast(t).alias(c) if c in changed else F.col(f"document.`{c}`") for c, t in docs.dtypes])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of one length."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("packing", pack),
]

#: MinHash, byte-pair tokens and a fitted model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns lies in the session's checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(docs)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
