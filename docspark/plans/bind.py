"""The domain's relations over the driver's tables, each in Spark and as a DuckDB common table expression.

This is the only module that knows those tables' columns. Groups are bounded by construction (a parse has ten pages), so
windows over a parse never meet a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.session import prepare, table

#: DuckDB's expressions that equal those of docspark.functions.text on the driver's texts.
SQL_BLANKS = r"'[\s\x{0B}\x{85}\p{Z}]+'"


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, {SQL_BLANKS}, ' ', 'g'), ' ')"


def sql_fold(x: str) -> str:
    return sql_squeeze(f"lower({x})")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per settled attempt of a task."""
    prepare(spark)
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("hour"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("user_id").cast("string").alias("owner"),
        F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string")).alias("group_id"),
        F.col("event_type").alias("reader"),
        F.lit("page").alias("kind"),
        (F.col("event_type") != "error").cast("long").alias("pages"),
        F.lit(1).cast("long").alias("calls"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
        F.floor("value").alias("output_tokens"),
    )


SQL_ATTEMPTS = """attempts AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:00:00') AS hour, strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS owner,
    'g' || (user_id % 10) AS group_id, event_type AS reader, 'page' AS kind, CAST(event_type <> 'error' AS BIGINT) AS pages,
    CAST(1 AS BIGINT) AS calls, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens
  FROM events)"""


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per parse: who asked, how urgent, what became of it. Days count from 1970-01-01."""
    prepare(spark)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("succeeded")
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("parse_id"),
        F.col("o_custkey").alias("owner"),
        F.col("c_nationkey").cast("long").alias("group_id"),
        (F.col("o_custkey") % 5).alias("project_id"),
        F.when(priority <= 2, 0).otherwise(1).alias("class"),
        priority.alias("priority"),
        state.alias("state"),
        day.alias("created_day"),
        F.when(F.col("o_orderstatus") == "F", day + F.col("o_orderkey") % 30).alias("finished_day"),
        (F.col("o_orderkey") % 40).alias("file_id"),
        F.col("c_mktsegment").alias("label"),
        F.floor("o_totalprice").alias("tokens"),
    )


SQL_PARSES = """parses AS (
  SELECT o_orderkey AS parse_id, o_custkey AS owner, CAST(c_nationkey AS BIGINT) AS group_id, o_custkey % 5 AS project_id,
    CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 2 THEN 0 ELSE 1 END AS class, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
    CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'succeeded' END END AS state,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS created_day,
    CASE WHEN o_orderstatus = 'F' THEN CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + o_orderkey % 30 END AS finished_day,
    o_orderkey % 40 AS file_id, c_mktsegment AS label, CAST(floor(o_totalprice) AS BIGINT) AS tokens
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page task. Rows of lineitem that are equal in all columns are interchangeable."""
    prepare(spark)
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("parse_id"),
        F.col("l_linenumber").cast("long").alias("page"),
        F.col("l_partkey").alias("task_key"),
        F.col("l_suppkey").alias("reader_id"),
        F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "queued").when(F.col("l_partkey") % 5 == 0, "leased").otherwise("succeeded").alias("state"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_suppkey") % 3 == 0, "budget_exhausted").otherwise("page_unreadable")).alias("code"),
        (F.lit(1) + F.when(F.col("l_returnflag") == "R", 4).otherwise(0)).cast("long").alias("cost"),
        F.col("l_quantity").cast("long").alias("input_tokens"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
    )


SQL_TASKS = """tasks AS (
  SELECT l_orderkey AS parse_id, CAST(l_linenumber AS BIGINT) AS page, l_partkey AS task_key, l_suppkey AS reader_id,
    CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'queued' WHEN l_partkey % 5 = 0 THEN 'leased' ELSE 'succeeded' END AS state,
    CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_suppkey % 3 = 0 THEN 'budget_exhausted' ELSE 'page_unreadable' END END AS code,
    CAST(1 + CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END AS BIGINT) AS cost, CAST(l_quantity AS BIGINT) AS input_tokens,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day
  FROM lineitem)"""

PAGES_PER_PARSE = 10


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of parsed documents: ten documents are the pages of a parse, their lines the blocks."""
    prepare(spark)
    d = table(spark, sf_dir, "documents")
    parse, page = F.floor(F.col("doc_id") / PAGES_PER_PARSE), (F.col("doc_id") % PAGES_PER_PARSE + 1).cast("int")
    none = F.array().cast("array<string>")
    head = F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.lit("Report of parse "), parse.cast("string")))).otherwise(none)
    foot = F.when(parse % 2 == 0, F.array(F.concat(F.lit("Page "), page.cast("string"), F.lit(" of 10")))).otherwise(none)
    lines = F.concat(head, F.split("text", "\n"), foot)
    rows = d.select(
        parse.alias("parse_id"),
        page.alias("page"),
        F.when(F.col("doc_id") % 13 == 7, "failed").otherwise("succeeded").alias("state"),
        F.when(parse % 7 == 3, "native").otherwise("reader").alias("source"),
        F.size(lines).alias("n"),
        F.posexplode(lines).alias("pos", "text"),
    )
    o, size = F.col("pos") + 1, F.length("text")
    kind = F.when((o == 2) & (F.col("page") % 4 == 1), "title").when(size <= 24, "heading").when(size % 5 == 0, "list_item").when(size % 11 == 0, "caption").otherwise("text")
    place = G.box(F.lit(0.1), (o - 1) / F.col("n"), F.lit(0.9), o / F.col("n"))
    return rows.select(
        "parse_id", "page", "state", "source", o.cast("int").alias("ord"), F.concat_ws(".", "page", o).alias("ref"), kind.alias("kind"), "text",
        F.when(kind.isin("title", "heading"), size % 4).otherwise(0).cast("int").alias("level"), F.when(F.col("parse_id") % 3 != 0, place).alias("box"),
    )


SQL_BLOCKS = """paged AS (
  SELECT doc_id // 10 AS parse_id, CAST(doc_id % 10 + 1 AS INT) AS page, CASE WHEN doc_id % 13 = 7 THEN 'failed' ELSE 'succeeded' END AS state,
    CASE WHEN (doc_id // 10) % 7 = 3 THEN 'native' ELSE 'reader' END AS source,
    list_concat(list_concat(CASE WHEN doc_id % 3 <> 0 THEN ['Report of parse ' || (doc_id // 10)] ELSE CAST([] AS VARCHAR[]) END, string_split(text, chr(10))),
      CASE WHEN (doc_id // 10) % 2 = 0 THEN ['Page ' || (doc_id % 10 + 1) || ' of 10'] ELSE CAST([] AS VARCHAR[]) END) AS lines
  FROM documents), listed AS (
  SELECT parse_id, page, state, source, len(lines) AS n, unnest(lines) AS text, CAST(generate_subscripts(lines, 1) AS INT) AS ord FROM paged), kinds AS (
  SELECT *, CASE WHEN ord = 2 AND page % 4 = 1 THEN 'title' WHEN length(text) <= 24 THEN 'heading' WHEN length(text) % 5 = 0 THEN 'list_item'
    WHEN length(text) % 11 = 0 THEN 'caption' ELSE 'text' END AS kind FROM listed), blocks AS (
  SELECT parse_id, page, state, source, ord, page || '.' || ord AS ref, kind, text, CAST(CASE WHEN kind IN ('title', 'heading') THEN length(text) % 4 ELSE 0 END AS INT) AS level,
    CASE WHEN parse_id % 3 <> 0 THEN (ord - 1) / CAST(n AS DOUBLE) END AS y0, CASE WHEN parse_id % 3 <> 0 THEN ord / CAST(n AS DOUBLE) END AS y1 FROM kinds)"""


def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parse of the documents table once, also one without a block."""
    prepare(spark)
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / PAGES_PER_PARSE).alias("parse_id")).where("parse_id is not null").distinct()


SQL_PARSE_IDS = "parse_ids AS (SELECT DISTINCT doc_id // 10 AS parse_id FROM documents WHERE doc_id IS NOT NULL)"


def raw_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine might return: a label, a text, and a box of four numbers on a grid."""
    prepare(spark)
    d = table(spark, sf_dir, "embeddings")
    e = F.col("embedding")
    labels = F.array(*[F.lit(x) for x in ("Section-header", "LAYOUT_FIGURE", "QR code", "watermark", "list item", "Formula", "text", "page header")])
    texts = F.array(*[F.lit(x) for x in ("## Results", "a figure", "", "draft", "• first", "$$x+y$$", "  plain  ", "Report")])
    which = (F.col("vec_id") % 8).cast("int")
    return d.select(
        F.floor(F.col("vec_id") / 20).alias("page"), (F.col("vec_id") % 20).alias("pos"), F.element_at(labels, which + 1).alias("label"), F.element_at(texts, which + 1).alias("text"),
        F.transform(F.slice(e, 1, 4), lambda v: v.cast("double") * 1000).alias("raw_box"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), (F.col("vec_id") * 7 % 20).cast("int").alias("order"),
    )


SQL_REGIONS = """regions AS (
  SELECT vec_id // 20 AS page, vec_id % 20 AS pos, ['Section-header', 'LAYOUT_FIGURE', 'QR code', 'watermark', 'list item', 'Formula', 'text', 'page header'][vec_id % 8 + 1] AS label,
    ['## Results', 'a figure', '', 'draft', '• first', '$$x+y$$', '  plain  ', 'Report'][vec_id % 8 + 1] AS text,
    CAST(embedding[1] AS DOUBLE) * 1000 AS a, CAST(embedding[2] AS DOUBLE) * 1000 AS b, CAST(embedding[3] AS DOUBLE) * 1000 AS c, CAST(embedding[4] AS DOUBLE) * 1000 AS d,
    CAST(vec_id * 7 % 20 AS INT) AS "order" FROM embeddings)"""
