"""Table identity from catalog metadata, and name mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer types that can be cut into ranges, and types that make a row wide.
INT_TYPES = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint")
WIDE_TYPES = ("json", "text", "mediumtext", "longtext", "blob", "tinyblob", "mediumblob", "longblob")
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "sys")


def unique_keys(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """Unique indexes all of whose parts are plain columns that cannot be null: table_name, index_name, cols in order."""
    parts = indexes.where("non_unique = 0 and index_name <> 'PRIMARY'").join(columns.select("table_name", "column_name", "is_nullable"), ["table_name", "column_name"], "left")
    bad = F.col("column_name").isNull() | F.coalesce(F.col("is_nullable") == "YES", F.lit(True))
    grouped = parts.groupBy("table_name", "index_name").agg(F.bool_or(bad).alias("bad"), F.array_sort(F.collect_list(F.struct("seq", "column_name"))).alias("parts"))
    return grouped.where("not bad").select("table_name", "index_name", F.transform("parts", lambda p: p["column_name"]).alias("cols"))


def identities(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """table_name, strategy, identify_cols, cursor_cols: primary key, else the first unique key by name, else all columns."""
    ordered = lambda names: F.transform(F.array_sort(names), lambda p: p["column_name"])
    every = columns.groupBy("table_name").agg(ordered(F.collect_list(F.struct("ordinal", "column_name"))).alias("all_cols"), F.max(F.when(F.col("auto_increment"), F.col("column_name"))).alias("auto_col"))
    primary = indexes.where("index_name = 'PRIMARY'").groupBy("table_name").agg(ordered(F.collect_list(F.struct("seq", "column_name"))).alias("pk"))
    unique = unique_keys(indexes, columns).groupBy("table_name").agg(F.min_by("cols", "index_name").alias("uk"))
    out = every.join(primary, "table_name", "left").join(unique, "table_name", "left")
    cols = F.coalesce("pk", "uk", "all_cols")
    name = F.when(F.col("pk").isNotNull(), "PK_STRATEGY").when(F.col("uk").isNotNull(), "UK_STRATEGY").otherwise("FULL_COLUMNS_STRATEGY")
    cursor = F.when((F.size(cols) > 1) & F.coalesce(F.array_contains(cols, F.col("auto_col")), F.lit(False)) & (name != "FULL_COLUMNS_STRATEGY"), F.array("auto_col")).otherwise(cols)
    return out.select("table_name", name.alias("strategy"), F.array_join(cols, ",").alias("identify_cols"), F.array_join(cursor, ",").alias("cursor_cols"))


def generated_kind(extra: Column) -> Column:
    low = F.lower(extra)
    return F.when(low.contains("virtual generated"), "VIRTUAL").when(low.contains("stored generated"), "STORED").otherwise("")


def is_int_type(data_type: Column) -> Column:
    """Display width and zerofill do not matter; unsigned types are no integer ranges."""
    low = F.lower(F.trim(data_type))
    bare = F.trim(F.regexp_replace(F.regexp_replace(low, " zerofill", ""), r"\([0-9]+\)", ""))
    return ~low.contains("unsigned") & bare.isin(*INT_TYPES)


def is_wide_type(data_type: Column) -> Column:
    """Parameters in brackets and the suffixes unsigned and zerofill do not matter."""
    bare = F.substring_index(F.lower(F.trim(data_type)), "(", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, " unsigned$", ""), " zerofill$", "")).isin(*WIDE_TYPES)


def database_pairs(df: DataFrame) -> DataFrame:
    """Source and target databases by index: a blank target is target_schema for a single source, else the source's name."""
    pairs = df.select("task_id", F.size("sources").alias("n"), "target_schema", F.posexplode("sources").alias("i", "source"), "targets")
    given = F.nullif(F.trim(F.get("targets", F.col("i"))), F.lit(""))
    fallback = F.when(F.col("n") == 1, F.nullif(F.trim("target_schema"), F.lit("")))
    return pairs.select("task_id", F.col("i").cast("long").alias("i"), "source", F.coalesce(given, fallback, F.col("source")).alias("target"))


def split_name(name: Column, default: Column) -> tuple[Column, Column]:
    """Schema and table of schema.table, split at the first dot; the default schema where there is none."""
    dot = F.instr(name, ".")
    return F.when(dot > 0, F.substring_index(name, ".", 1)).otherwise(default), F.when(dot > 0, F.expr("substring(name, instr(name, '.') + 1)")).otherwise(name)


def matches_tables(schema: Column, table_name: Column, wanted: list[tuple[str, str]]) -> Column:
    """Whether schema.table is wanted; a table of "" stands for every table of its schema."""
    test = F.lit(False)
    for s, t in wanted:
        test = test | ((schema == s) & (F.lit(True) if t == "" else table_name == t))
    return test
