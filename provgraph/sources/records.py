"""Analyzer records (JSON lines): verb gate, validation, normalisation, system-entity filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.paths import normal_path, relative_path
from ..schema import CERTAINTY, DEFAULT_CERTAINTY, RECORD, VERBS

#: Catalogs of database systems.
SYSTEM_NAMES = (
    "set dual sqlite_master sqlite_sequence sqlite_stat1 sqlite_temp_master information_schema schemata pg_namespace pg_class pg_attribute pg_type pg_index "
    "performance_schema sys user_tables user_tab_columns user_tab_cols user_views user_objects user_constraints all_tables all_tab_columns"
).split()
SYSTEM_PREFIXES = ["sqlite_", "pg_", "dba_", "v$", "gv$", "user_tab", "all_tab"]
LONGEST_ID, LONGEST_SOURCE = 4096, 256


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records as they are; lines that are no JSON have null fields and the line in `_corrupt_record`."""
    schema = StructType([*RECORD.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def is_system(name: Column) -> Column:
    n = F.lower(F.trim(name))
    out = n.isin(SYSTEM_NAMES)
    for p in SYSTEM_PREFIXES:
        out = out | n.startswith(p)
    return out


def validated(records: DataFrame, verb: str, root: str | None = None) -> DataFrame:
    """records with id, source_id, target_id, kind, name, certainty, file and reason (null: accepted) and stored.

    root: the folder that was analysed; absolute paths below it become relative to it, others are refused, as are those that climb out of it. System entities, and edges into them, are accepted but not stored.
    """
    get = lambda p: F.get_json_object("data", f"$.{p}")
    r = records.select(
        "*", get("id").alias("id"), get("source_id").alias("source_id"), get("target_id").alias("target_id"), get("kind").alias("kind"), get("name").alias("name"),
        F.coalesce(get("certainty"), F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_CERTAINTY.items() for x in kv]), F.col("record_type"))).alias("certainty"),
        F.replace(get("location.file"), F.lit("\\"), F.lit("/")).alias("file"),
    )
    if root:
        r = r.withColumn("file", relative_path(F.col("file"), root.replace("\\", "/")))
    edge = F.col("record_type") == "edge"
    bad_id = lambda c: F.col(c).isNull() | ~F.length(c).between(1, LONGEST_ID) | F.contains(F.col(c), F.lit("\x00"))
    absolute = F.col("file").startswith("/") | F.col("file").rlike(r"^[A-Za-z]:|(^|/)\.\.(/|$)")
    reason = (
        F.when(F.col("record_type").isNull() | F.col("data").isNull() | ~F.col("data").startswith("{"), "malformed")
        .when(~F.col("record_type").isin(VERBS[verb]), "record type")
        .when(F.col("source_name").isNull() | ~F.length("source_name").between(1, LONGEST_SOURCE), "source name")
        .when(edge & (bad_id("source_id") | bad_id("target_id") | F.col("kind").isNull()), "edge ends")
        .when(~edge & bad_id("id"), "id")
        .when(~F.col("certainty").isin(list(CERTAINTY)), "certainty")
        .when(F.coalesce(absolute, F.lit(False)), "path outside root")
    )
    http = lambda c: F.when(F.col(c).rlike(r"^http\.[A-Z]+\./"), F.concat(F.regexp_extract(c, r"^(http\.[A-Z]+\.)", 1), normal_path(F.regexp_extract(c, r"^http\.[A-Z]+\.(.*)$", 1)))).otherwise(F.col(c))
    system = F.when(edge & F.col("kind").isin("READS", "WRITES"), is_system(F.regexp_replace("target_id", r"^data\.", ""))).when(F.col("record_type") == "data_entity", is_system(F.coalesce("name", "id"))).otherwise(False)
    return r.withColumn("reason", reason).withColumn("id", http("id")).withColumn("target_id", http("target_id")).withColumn("stored", F.col("reason").isNull() & ~F.coalesce(system, F.lit(False)))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """producer, state: changed (new, other fingerprint, or not cacheable), removed or unchanged."""
    j = before.select("producer", F.col("fingerprint").alias("b")).join(after.select("producer", F.col("fingerprint").alias("a"), "cacheable"), "producer", "full")
    state = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull() | (F.col("a") != F.col("b")) | ~F.coalesce("cacheable", F.lit(False)), "changed").otherwise("unchanged")
    return j.select("producer", state.alias("state"))
