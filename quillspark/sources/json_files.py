"""JSON documents and JSON-lines event streams, batch and streaming; JSON and Markdown artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .event_files import growing_lines
from .text_files import write_text_files

RUN = "label string, repo string, sha string, model string, contextMode string, durationMs bigint, totals struct<promptTokens:bigint,completionTokens:bigint,costUsd:double>, pageStats struct<total:int,completed:int,failed:int>"
PAGES = "pageId string, title string, section string, status string, content string"
OUTLINE = "title string, description string, sections array<struct<id:string,title:string,description:string,pages:array<struct<id:string,title:string,description:string,filePaths:array<string>,diagrams:array<string>>>>>"
_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,cached_input_tokens:bigint>"
#: Events of both shapes: whole messages with their own usage, and items with the usage of a turn.
EVENT = f"type string, subtype string, message string, result string, structured_output string, total_cost_usd double, duration_api_ms bigint, is_error boolean, usage {_USAGE}, item struct<type:string,text:string>, error struct<message:string>"
MESSAGE = f"content array<struct<type:string,text:string>>, usage {_USAGE}"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Parsed lines as column e; blank and broken lines are left out. Works on streams too."""
    parsed = lines.where(F.trim(F.col(line)) != "").withColumn("e", F.from_json(line, EVENT))
    return parsed.where(F.col("e.type").isNotNull())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return events(spark.read.text(path))


def stream_events(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """Events of files that grow while they are read: each whole line once, with its file and first byte."""
    return events(growing_lines(spark, folder, suffix))


def message_text(e: Column) -> Column:
    """Text of an event of the message shape."""
    parts = F.filter(F.from_json(e["message"], MESSAGE)["content"], lambda x: x["type"] == "text")
    return F.array_join(F.transform(parts, lambda x: x["text"]), "")


def write_json(df: DataFrame, folder: str) -> None:
    """One artifact: rows as JSON lines in one file. For results of a bounded size."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def page_files(pages: DataFrame) -> DataFrame:
    """name, text: a Markdown file for each page, numbered by its place."""
    name = F.format_string("%02d-%s.md", F.col("sort_order") + 1, F.col("page_id"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n> Section: "), F.coalesce("section", F.lit("(none)")), F.lit(" \u00b7 Status: "), "status", F.lit("\n\n"))
    return pages.select(name.alias("name"), F.concat(head, F.coalesce("content", F.lit("_(no content)_"))).alias("text"))


def write_page_files(pages: DataFrame, folder: str) -> None:
    """The files of page_files() in the folder, written by the tasks and put in place together."""
    write_text_files(page_files(pages), folder)
