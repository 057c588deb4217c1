"""Registry of the queries: each a function of (spark, folder), with the SQL that says the same for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: White space of any script, for SQL patterns.
SP = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def sql_strip(x: str) -> str:
    """SQL: white space taken off both ends."""
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def sql_comparable(x: str) -> str:
    """SQL: letters and digits in lower case."""
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"


def sql_ratio(x: str) -> str:
    """SQL: ASCII letters over visible characters."""
    return f"(CASE WHEN length(regexp_replace({x}, '{SP}', '', 'g')) > 0 THEN length(regexp_replace({x}, '[^A-Za-z]', '', 'g')) / length(regexp_replace({x}, '{SP}', '', 'g'))::DOUBLE ELSE 0 END)"


#: SQL: current rows of segments.
SQL_CURRENT = "SELECT doc_id, seq, arg_max(coalesce(context, ''), updated_at) context, arg_max(coalesce(original, ''), updated_at) original, arg_max(coalesce(translation, ''), updated_at) translation FROM segments GROUP BY doc_id, seq"
#: SQL: lines of documents in order, from 1.
SQL_LINES = "SELECT doc_id, i AS pos, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)"
#: SQL: blocks without repeats.
SQL_BLOCKS = "SELECT DISTINCT doc_id, page, idx, coalesce(text, '') AS text, rect.left_x AS l, rect.right_x AS r, rect.top_y AS t, rect.bottom_y AS b, line_height AS lh, alignment, coalesce(block_type, 'Normal') AS block_type, coalesce(region, 'Body') AS region, coalesce(source, 'Native') AS source, style.font AS font, style.size AS size, style.bold AS bold FROM blocks"
