"""Task registry and prompt files on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import prompt_problem, prompt_text

_METADATA = (
    "adapter VARIANT, person VARIANT, absolute_id VARIANT, task VARIANT, mock_target VARIANT, mock_week VARIANT"
)
_FIELDS = ("adapter", "person", "absolute_id", "task", "mock_target", "mock_week")


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """One row per `<person>/<id>/metadata.json`, with the JSON type of the fields that matter.

    `problem` is `invalid-json` where the file is not one JSON object; its fields are null then.
    Files of length zero are left out, as by all file sources of Spark.
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/*/metadata.json", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    parsed = files.select(
        F.col("_metadata.file_path").alias("path"),
        F.url_decode(F.element_at(parts, -3)).alias("dir_person"),
        F.url_decode(F.element_at(parts, -2)).alias("dir_id"),
        F.from_json("value", _METADATA, {"allowSingleQuotes": "false"}).alias("m"),
        F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)).alias("sound"),
    )
    # a JSON null is absent; other values keep their text form
    as_text = [F.try_variant_get(F.col(f"m.{f}"), "$", "string").alias(f) for f in _FIELDS]
    return parsed.select(
        "path", "dir_person", "dir_id", F.when(~F.col("sound"), "invalid-json").alias("problem"), *as_text,
        F.schema_of_variant("m.absolute_id").alias("absolute_id_type"),
        F.schema_of_variant("m.task").alias("task_type"),
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of prompt files; `problem` is null for usable prompts."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path", prompt_text(F.col("content")).alias("text"), prompt_problem(F.col("content")).alias("problem")
    )
