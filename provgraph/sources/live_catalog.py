"""Columns of a live database's tables, read over JDBC in partitions; `publication.catalog_tables` makes tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: How each kind of database names its catalog's columns; ordinal is what the read is partitioned by.
QUERIES = {
    "oracle": 'SELECT owner AS "owner", table_name AS "table", column_name AS "column", data_type AS "type", column_id AS "ordinal" FROM all_tab_columns',
    "mssql": 'SELECT table_schema AS "owner", table_name AS "table", column_name AS "column", data_type AS "type", ordinal_position AS "ordinal" FROM information_schema.columns',
    "derby": 'SELECT s.schemaname AS "owner", t.tablename AS "table", c.columnname AS "column", CAST(c.columndatatype AS VARCHAR(128)) AS "type", c.columnnumber AS "ordinal" '
    "FROM sys.syscolumns c JOIN sys.systables t ON t.tableid = c.referenceid JOIN sys.sysschemas s ON s.schemaid = t.schemaid",
}
SYSTEM_OWNERS = {"oracle": ("SYS", "SYSTEM", "XDB", "OUTLN"), "mssql": ("sys", "INFORMATION_SCHEMA"), "derby": ("SYS", "SYSIBM")}


def columns(spark: SparkSession, url: str, kind: str, partitions: int = 8, widest: int = 64, **properties: str) -> DataFrame:
    """owner, table, column, type, ordinal of every table of the database, in as many reads at once as there are partitions.

    widest: places of columns up to which the reads share evenly; columns beyond belong to the last read.
    """
    options = {"url": url, "dbtable": f"({QUERIES[kind]}) catalog_columns", "partitionColumn": "ordinal", "lowerBound": "1", "upperBound": str(widest), "numPartitions": str(partitions), "fetchsize": "10000"}
    return spark.read.format("jdbc").options(**options, **properties).load()
