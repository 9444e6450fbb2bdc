"""The reading platform's tables, as projections of the star-schema tables that queries run on.

Each is a list of expressions which Spark and DuckDB read alike, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, expressions, filter)
TABLES: dict[str, tuple[str, list[str], str]] = {
    "reading_logs": ("events", [
        "event_id AS log_id", "user_id", "event_id % 60 AS book_id", "CAST(event_id % 5 AS INT) + 1 AS chapter_number", "CAST(event_id % 12 AS INT) AS chunk_index", "ts",
    ], ""),
    "books": ("part", [
        "p_partkey AS book_id", "p_name AS title", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS author", "p_type AS description", "p_size AS total_chapters",
        "p_partkey % 3 <> 0 AS is_public", "p_partkey % 20 AS uploaded_by", "p_retailprice AS price", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 3 END AS chapter_start_number",
    ], "p_partkey % 13 <> 7"),
    "chunk_rows": ("lineitem", [
        "l_partkey AS book_id", "l_linenumber AS chapter_number", "l_orderkey AS line", "l_suppkey AS side", "CAST(round(l_quantity) AS INT) AS word_count", "l_extendedprice AS size_points",
        "CASE l_returnflag WHEN 'A' THEN 'header' WHEN 'N' THEN 'text' ELSE 'image' END AS type", "l_linestatus AS status",
    ], ""),
    "progress": ("orders", [
        "o_orderkey AS progress_id", "o_custkey AS user_id", "o_orderkey % 2000 AS book_id", "CAST(o_orderkey % 7 AS INT) + 1 AS current_chapter", "CAST(o_orderkey % 4 AS INT) AS current_chunk",
        "CAST(floor(o_totalprice / 1000) AS BIGINT) AS minutes", "o_orderdate AS last_read_at", "o_orderpriority AS priority",
    ], ""),
    "tts_usage": ("lineitem", [
        "l_orderkey AS usage_id", "l_linenumber AS usage_line", "CASE l_suppkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'polly' ELSE 'elevenlabs' END AS provider",
        "CASE l_linenumber % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'neural' WHEN 2 THEN 'long-form' ELSE 'generative' END AS voice_type", "CAST(round(l_quantity * 40) AS BIGINT) AS text_length",
        "CAST(round(l_quantity * 15) AS BIGINT) AS audio_tenths", "CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_units", "l_shipdate AS ts", "l_partkey AS user_id",
    ], ""),
    "tts_errors": ("events", [
        "event_id AS error_id", "ts", "CASE user_id % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'polly' ELSE 'elevenlabs' END AS provider", "event_id % 6 AS rule", "user_id",
        "CASE event_id % 6 WHEN 0 THEN 'Invalid API key' WHEN 1 THEN 'Rate limit hit' WHEN 2 THEN 'ETIMEDOUT connection' WHEN 3 THEN 'voice not found' WHEN 4 THEN 'maximum length' ELSE 'boom' END AS original_error",
    ], "event_type = 'error'"),
    "ai_usage": ("orders", [
        "o_orderkey AS usage_id", "CASE o_orderkey % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gemini-1.5-pro' ELSE 'gemini-1.5-flash-8b' END AS model_id",
        "CAST(o_custkey * 150 AS BIGINT) AS prompt_tokens", "CAST(floor(o_totalprice / 4) AS BIGINT) AS completion_tokens", "o_orderdate AS ts",
    ], ""),
    "bookmarks": ("events", [
        "event_id AS bookmark_id", "user_id", "event_id % 60 AS book_id", "CAST(event_id % 5 AS INT) + 1 AS chapter_number", "CAST(event_id % 12 AS INT) AS chunk_index", "ts AS created_at",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS custom_name",
    ], "event_type = 'click'"),
    "users": ("customer", ["c_custkey AS user_id", "lower(c_name) AS username", "c_mktsegment AS segment", "c_nationkey AS nation_id", "c_acctbal AS balance"], ""),
    "settings": ("customer", [
        "c_custkey AS user_id", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INT) * 0.5 END AS playback_speed", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS voice_id",
        "CASE WHEN c_custkey % 2 = 0 THEN 'dark' ELSE NULL END AS theme",
    ], "c_custkey % 10 < 7"),
    "images": ("supplier", ["s_suppkey AS image_id", "s_name AS file_name", "CAST(s_nationkey AS BIGINT) AS page_number", "s_acctbal AS size_points"], ""),
}


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table, expressions, where = TABLES[name]
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return (df.where(where) if where else df).selectExpr(*expressions)


def cte(*names: str) -> str:
    """WITH and the tables of these names; a query follows."""
    parts = []
    for name in names:
        table, expressions, where = TABLES[name]
        parts.append(f"{name} AS (SELECT {', '.join(expressions)} FROM {table}{' WHERE ' + where if where else ''})")
    return "WITH " + ", ".join(parts) + " "
