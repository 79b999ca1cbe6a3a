"""Line files, URL lists, recorded state and its changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ship

#: Schemas of the tables at rest.
SCHEMAS = {
    "scan_results": "url string, domain string, path string, source_url string, scan_depth int, created_at timestamp",
    "ai_vulns": "id bigint, js_url string, api_endpoint string, http_method string, risk_level string, path string, params map<string,string>, request_status string, response_code int, response_length int, response_body_preview string, created_at timestamp",
    "sensitive_info": "id bigint, js_url string, sensitive_value string, context_code string, caller_codes array<string>, risk_level string, secret_type string, test_suggestion string, ai_raw_analysis string, created_at timestamp",
    "visited_urls": "url string, created_at timestamp",
    "processed_api_paths": "api_path string, js_url string, created_at timestamp",
    "js_source_maps": "id bigint, js_url string, is_source_map string, created_at timestamp",
    "scan_info": "domain string, url string, path string, port int, status int, title string, length int, source_code string, is_valid int, redirect_count int, redirect_locations array<string>, original_url string",
    "responses": "url string, method string, status_code int, length int, response_content string, redirect_location string, redirect_count int, error string, seq bigint",
}


def _decoded(data: bytes, encoding: str | None) -> str:
    """Text of a file; without an encoding UTF-8 if its first 1000 bytes are that, else GB18030."""
    if encoding is None:
        try:
            data[:1000].decode("utf-8")
        except UnicodeDecodeError as e:
            encoding = "utf-8" if e.start >= len(data[:1000]) - 3 else "gb18030"
    return data.decode(encoding or "utf-8", "replace")


def lines(spark: SparkSession, path: str, encoding: str | None = "utf-8") -> DataFrame:
    """The lines of text files with single spaces; blank ones stay, as empty.

    UTF-8 files are split and streamed. Of other encodings, or with None to tell by the first bytes, each file is
    decoded whole: such lists are short.
    """
    if encoding and encoding.lower() in ("utf-8", "utf8"):
        raw = spark.read.text(path)
    else:

        @F.pandas_udf("string")
        def decode(content: pd.Series) -> pd.Series:
            return content.map(lambda x: _decoded(x, encoding))

        ship(spark)
        whole = spark.read.format("binaryFile").load(path).select(decode("content").alias("text"))
        raw = whole.select(F.explode(F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")).alias("value"))
    return raw.select(F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " ")).alias("line"))


def url_list(rows: DataFrame, column: str = "line") -> DataFrame:
    """The distinct URLs of a list, without comments and blanks, in order."""
    line = F.trim(F.regexp_replace(column, r"\s+", " "))
    return rows.select(line.alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#"))).distinct().orderBy("url")


def scope(allowed: DataFrame, seed_root: str) -> DataFrame:
    """The distinct roots: the allowed ones and the seed's."""
    spark = allowed.sparkSession
    return allowed.select(F.trim("root").alias("root")).unionByName(spark.createDataFrame([(seed_root,)], "root string")).where("root <> ''").distinct()


def queue(spark: SparkSession, path: str) -> DataFrame:
    """url and remaining depth of the files overflow_depth_N_*.txt in a folder; depth is null for other names."""
    raw = spark.read.text(path).select(F.trim("value").alias("url"), F.input_file_name().alias("file")).where("url <> ''")
    return raw.select("url", F.regexp_extract("file", r"overflow_depth_([0-9]+)_[^/]*$", 1).try_cast("int").alias("depth"))


def config(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON configuration: an object or an array of objects a file. Read again for each run, so a change takes effect with the next."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The keys in a state table; only that column is read."""
    return spark.read.parquet(path).select(key)


def append_new(keys: DataFrame, path: str) -> None:
    """Add keys (from dedup.new_keys) to a state table, with the time."""
    keys.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def truncate(spark: SparkSession, path: str, table: str) -> None:
    """Leave an empty state table in place of the one there."""
    spark.createDataFrame([], SCHEMAS[table]).write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)
