"""Scalar functions on raw lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: date, time, pid, level, component, content
LINE = r"^\s*(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+(\S+):\s+(.+?)\s*$"
ENVELOPE = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("ingested_at", T.StringType()), T.StructField("raw", T.StringType())])
FIELDS = ("log_date", "log_time", "pid", "level", "component", "content")


def _split_line(raw: Column) -> Column:
    """Array of the one line's six fields as an array, empty where the line does not match. One match of the expression.

    Matching lines are rewritten with one blank between fields; the first five hold none, and the colon behind the
    component goes, so that only lines which do not match stay as they are.
    """
    rewritten = F.filter(F.array(F.regexp_replace(raw, LINE, "$1 $2 $3 $4 $5 $6")), lambda x: x != raw)
    return F.transform(rewritten, lambda x: F.split(x, " ", len(FIELDS)))


def _named(parts: Column) -> Column:
    return F.struct(*[parts[i].alias(n) for i, n in enumerate(FIELDS)])


def parse_line(raw: Column) -> Column:
    """Struct of the six fields; null where the line does not match."""
    return F.get(F.transform(_split_line(raw), _named), F.lit(0))


def parsed_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows of ``df`` whose line matches, with the six fields: an explosion of at most one, through which no filter sends the match down again."""
    return df.select("*", F.explode(_split_line(F.col(raw))).alias("__p")).select(*df.columns, *[F.col("__p")[i].alias(n) for i, n in enumerate(FIELDS)])


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` behind the same barrier."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def block_id(content: Column) -> Column:
    """The first block id, null for none."""
    return F.nullif(F.regexp_extract(content, r"(blk_-?\d+)", 1), F.lit(""))


def seconds_of_day(hhmmss: Column) -> Column:
    """Seconds since midnight; 0 for null, short or non-numeric input."""
    part = lambda i: F.expr("try_cast('0' as int)") if i is None else F.substring(hhmmss, i, 2).try_cast("int")
    total = part(1) * 3600 + part(3) * 60 + part(5)
    return F.coalesce(F.when(F.length(hhmmss) >= 6, total), F.lit(0))


def event_time(log_date: Column, log_time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", log_date, log_time), F.lit("yyMMdd HHmmss"))


def mask_message(content: Column) -> Column:
    """Block ids, addresses and numbers become marks."""
    out = F.regexp_replace(content, r"blk_-?\d+", "<BLOCK>")
    out = F.regexp_replace(out, r"/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?", "<IP>")
    return F.regexp_replace(out, r"\b\d+\b", "<NUM>")


def make_envelopes(lines: DataFrame, number: str = "line_no", text: str = "value") -> DataFrame:
    """JSON envelopes of lines that are not blank; blank lines keep their numbers."""
    kept = lines.where(F.trim(F.col(text)) != "")
    body = F.struct(F.col(number).alias("line_no"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"), F.trim(F.col(text)).alias("raw"))
    return kept.select(F.col(number).cast("string").alias("key"), F.to_json(body).alias("value"))


def open_envelopes(messages: DataFrame) -> DataFrame:
    """Decode and flatten envelopes; other columns, such as offsets, stay."""
    parsed = messages.withColumn("__e", F.from_json(F.col("value").cast("string"), ENVELOPE))
    return parsed.select("__e.*", *[c for c in messages.columns if c != "value"])


def parse_logs(envelopes: DataFrame, event: Column, high_risk: tuple[str, ...]) -> DataFrame:
    """Parsed log records; lines that do not parse and lines without a block go. ``event`` reads column content."""
    found = computed_once(parsed_lines(envelopes), "block_id", block_id(F.col("content"))).where("block_id is not null")
    rows = computed_once(found, "event_id", event)
    return rows.select(
        "line_no", *FIELDS, "block_id", "event_id", F.col("event_id").isin(*high_risk).alias("is_high_risk"), "ingested_at",
        F.current_timestamp().alias("processed_at"), event_time(F.col("log_date"), F.col("log_time")).alias("event_ts"),
    )
