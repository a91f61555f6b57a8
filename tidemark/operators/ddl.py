"""Text of table definitions: secondary indexes taken out, and the statements that prepare a target table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import quoted

INDEX_LINE = r"(?i)^(?:(?:UNIQUE|FULLTEXT|SPATIAL) )?(?:KEY|INDEX)\s+"
#: What a new database is made with.
DATABASE_OPTIONS = "CHARACTER SET utf8mb4 COLLATE utf8mb4_unicode_ci"


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def auto_increment_columns(lines: Column) -> Column:
    """Names of the columns that count themselves up, out of the lines of a definition."""
    own = F.filter(lines, lambda x: _bare(x).rlike("^`[^`]*`") & F.upper(x).contains("AUTO_INCREMENT"))
    return F.transform(own, lambda x: F.regexp_extract(x, "`([^`]*)`", 1))


def without_indexes(definition: Column, names: Column | None = None) -> Column:
    """The definition without its secondary indexes (only those named, if names are given; no names: nothing goes). An index
    over a self-counting column stays, for the column needs it. The last line before the bracket ends without a comma."""
    lines = F.split(definition, "\n")
    auto = auto_increment_columns(lines)

    def goes(line: Column, i: Column) -> Column:
        named = F.lit(True) if names is None else F.array_contains(names, F.nullif(F.regexp_extract(_bare(line), INDEX_LINE + "`([^`]*)`", 1), F.lit("")))
        needed = F.exists(auto, lambda a: line.contains(F.concat(F.lit("`"), a, F.lit("`"))))
        inside = (i > 0) & (i < F.size(lines) - 1)
        return inside & _bare(line).rlike(INDEX_LINE) & ~needed & F.coalesce(named, F.lit(False))

    left = F.filter(lines, lambda line, i: ~goes(line, i))
    tidy = lambda line: F.regexp_replace(F.regexp_replace(line, r"[ \t]+$", ""), ",$", "")
    ends = lambda i: F.coalesce(_bare(F.get(left, i + 1)).startswith(")"), F.lit(False))
    out = F.array_join(F.transform(left, lambda line, i: F.when(ends(i), tidy(line)).otherwise(line)), "\n")
    return out if names is None else F.when(F.size(names) > 0, out).otherwise(definition)


def renamed(definition: Column, schema: Column, table: Column) -> Column:
    """The definition under another name: what stands from the first bracket on is kept."""
    body = F.when(definition.contains("(") & definition.contains(")"), F.substr(definition, F.instr(definition, "("))).otherwise(definition)
    return F.concat(F.lit("CREATE TABLE "), quoted(schema), F.lit("."), quoted(table), F.lit(" "), body)


def target_statements(mode: str = "mode", optimize: str = "optimize", drop: str = "drop_first") -> Column:
    """Statements, in order, for rows with source_schema, source_table, schema_name, table_name, database_there, table_there,
    definition and deferred (names of indexes built later): a database that lacks, nothing more for a table that is there and is
    to stay, else a drop if asked for, and the table like its source, or from its definition where indexes may be deferred."""
    name = F.concat(quoted(F.col("schema_name")), F.lit("."), quoted(F.col("table_name")))
    like = F.concat(F.lit("CREATE TABLE "), name, F.lit(" LIKE "), quoted(F.col("source_schema")), F.lit("."), quoted(F.col("source_table")))
    later = F.col(optimize) | (F.col(mode) == "ALL")
    make = F.when(later, renamed(without_indexes(F.col("definition"), F.col("deferred")), F.col("schema_name"), F.col("table_name"))).otherwise(like)
    database = F.when(~F.col("database_there"), F.concat(F.lit("CREATE DATABASE IF NOT EXISTS "), quoted(F.col("schema_name")), F.lit(f" {DATABASE_OPTIONS}")))
    stays = F.col("table_there") & ~F.col(drop)
    return F.array_compact(F.array(database, F.when(~stays & F.col(drop), F.concat(F.lit("DROP TABLE IF EXISTS "), name)), F.when(~stays, make)))
