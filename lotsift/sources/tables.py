"""Tables of the ledger and of services, with their schemas, and checks of what was uploaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ledger's tables and their columns.
LEDGER = {
    "pipeline_tasks": (
        "id int, external_id string, cadastral_data_path string, pzz_zones_data_path string, pzz_zone_vri_labels_path string, vri_classifier_path string, "
        "include_pzz_check boolean, cadastral_vri_col string, pzz_zone_code_col string, pzz_zone_name_col string, priority int, status string, "
        "celery_task_id string, result_path string, error_text string, created_at timestamp, started_at timestamp, finished_at timestamp"
    ),
    "pipeline_task_events": "id int, task_id int, stage string, status string, details string, created_at timestamp",
    "config": "id int, name string, value string, py_type string",
    "config_override": "key string, value string, updated_at timestamp, updated_by string",
    "task_idempotency_keys": "id int, key string, task_external_id string",
}
# What a task has where its row doesn't say.
TASK_DEFAULTS = {"include_pzz_check": True, "pzz_zone_code_col": "Индекс_зоны", "pzz_zone_name_col": "Код_объекта", "priority": 1, "status": "queued"}


def read_ledger(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the ledger as Parquet; a task's missing values are its defaults, a setting's type is str."""
    rows = spark.read.schema(LEDGER[table]).parquet(f"{folder}/{table}.parquet")
    if table == "pipeline_tasks":
        rows = rows.fillna(TASK_DEFAULTS)
    return rows.fillna({"py_type": "str"}) if table == "config" else rows


def task_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks that users see, newest first, with the key they were asked for by; those of scenarios (keys that start with sc:) aren't listed."""
    from ..operators.ledger import public_tasks

    tasks = read_ledger(spark, folder, "pipeline_tasks").withColumn("task_id", F.col("external_id"))
    keys = read_ledger(spark, folder, "task_idempotency_keys").select(F.col("task_external_id").alias("task_id"), "key")
    return public_tasks(tasks, keys).orderBy(F.col("created_at").desc(), F.col("id").desc()).drop("task_id")


def functional_zones(spark: SparkSession, path: str, year: int, source: str, kind: int | None = None) -> DataFrame:
    """Zones of a year and source, and of one type if asked; the conditions reach the scan, or its partitions."""
    rows = spark.read.parquet(path).where((F.col("year") == year) & (F.col("source") == source))
    return rows if kind is None else rows.where(F.col("functional_zone_type_id") == kind)


def available_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("year", "source").distinct()


def too_large(files: DataFrame, most: int = 200 << 20) -> DataFrame:
    """Uploaded files (path, length, ..) above the size limit."""
    return files.where(F.col("length") > most).select("path", "length")


def invalid_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, reason) of documents that aren't JSON or not of the kind (object or array) that is asked for."""
    docs = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("v"))
    shape = F.schema_of_variant("v")
    good = shape.startswith("OBJECT") if kind == "object" else shape.startswith("ARRAY")
    reason = F.when(F.col("v").isNull(), "not JSON").when(~good, F.concat(F.lit("not an "), F.lit(kind)))
    return docs.select("path", reason.alias("reason")).where("reason is not null")
