"""Queries over blocks: assembly, views, chunks, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import assemble as A
from docspark.operators import chunks as D
from docspark.operators import views as V
from docspark.plans.bind import SQL_ATTEMPTS, SQL_BLOCKS, SQL_PARSE_IDS, attempts, blocks, parse_ids, sql_fold, sql_squeeze
from docspark.plans.entry import Entries
from docspark.session import prepare, table

ENTRIES = Entries()

#: The page-number pattern in RE2's dialect.
_NUMBER = r"(?i)^[\s\x{0B}\x{85}\p{Z}\-–—\[(]*(?:(?:page|seite|pagina|página|p\.?)[\s\x{0B}\x{85}\p{Z}]*)?[0-9]{1,4}(?:[\s\x{0B}\x{85}\p{Z}]*(?:/|of|von|de|di)[\s\x{0B}\x{85}\p{Z}]*[0-9]{1,4})?[\s\x{0B}\x{85}\p{Z}\-–—\])\.]*$"
_SECTION = r"^(?:([0-9]{1,3}(?:\.[0-9]{1,3})*)\.?|([A-Z](?:\.[0-9]{1,3})+)\.?|(?:[A-Z]|[IVXLC]{1,7})\.)\s+\S"

_NUMBERED = f"""numbered AS (SELECT parse_id, page, state, source, ord, ref, text, y0, y1, hit, CASE WHEN hit THEN 'page_number' ELSE kind END AS kind, CASE WHEN hit THEN 0 ELSE level END AS level FROM (
  SELECT *, coalesce(state = 'succeeded' AND kind IN ('text', 'caption', 'footnote') AND (ord = 1 OR ord = n) AND (y0 IS NULL OR (ord = 1 AND y1 <= 0.12) OR (ord = n AND y0 >= 1 - 0.12)) AND regexp_matches(text, '{_NUMBER}'), false) AS hit
  FROM (SELECT *, max(ord) OVER (PARTITION BY parse_id, page) AS n FROM blocks)))"""
_DEPTH = f"(CASE WHEN regexp_matches(text, '{_SECTION}') THEN length(regexp_extract(text, '{_SECTION}', 1) || regexp_extract(text, '{_SECTION}', 2)) - length(replace(regexp_extract(text, '{_SECTION}', 1) || regexp_extract(text, '{_SECTION}', 2), '.', '')) + 1 ELSE 0 END)"
_TEXTUAL = "('title', 'heading', 'text', 'list_item', 'caption', 'footnote', 'page_header', 'page_footer', 'page_number')"
_FURNITURE = "('page_header', 'page_footer', 'page_number')"
_RUNNING = f"""ends AS (SELECT *, min(ord) FILTER (kind <> 'page_number' AND state = 'succeeded') OVER (PARTITION BY parse_id, page) AS a, max(ord) FILTER (kind <> 'page_number' AND state = 'succeeded') OVER (PARTITION BY parse_id, page) AS z FROM numbered),
  keyed AS (SELECT *, CASE WHEN (ord = a OR (ord = z AND z > a)) AND kind IN {_TEXTUAL} AND text <> '' AND length(text) <= 200 AND (kind IN {_FURNITURE} OR y0 IS NULL OR (ord = a AND y1 <= 0.12) OR (ord = z AND z > a AND y0 >= 1 - 0.12)) THEN {sql_fold('text')} END AS key FROM ends),
  counted AS (SELECT *, sum((ord = 1 AND state = 'succeeded')::INT) OVER (PARTITION BY parse_id) AS pages, sum((key IS NOT NULL AND ord = a)::INT) OVER (PARTITION BY parse_id, key) AS tops, sum((key IS NOT NULL AND ord = z AND z > a)::INT) OVER (PARTITION BY parse_id, key) AS bottoms FROM keyed),
  ran AS (SELECT parse_id, page, state, source, ord, ref, text, y0, y1, CASE WHEN kind IN {_FURNITURE} THEN kind WHEN key IS NOT NULL AND ord = a AND tops >= greatest(2, (pages + 1) // 2) THEN 'page_header'
    WHEN key IS NOT NULL AND ord = z AND z > a AND bottoms >= greatest(2, (pages + 1) // 2) THEN 'page_footer' ELSE kind END AS kind, level AS old_level FROM counted),
  running AS (SELECT *, CASE WHEN kind IN ('page_header', 'page_footer') THEN 0 ELSE old_level END AS level FROM ran)"""
_REPEATED = f"""marked AS (SELECT *, CASE WHEN kind IN ('page_header', 'page_footer') AND state = 'succeeded' THEN regexp_replace({sql_fold('text')}, '\\p{{Nd}}+', '#', 'g') END AS rkey FROM running),
  repeats AS (SELECT *, rkey IS NOT NULL AND row_number() OVER (PARTITION BY parse_id, kind, rkey ORDER BY page, ord) > 1 AS repeated FROM marked)"""
_TITLED = "titled AS (SELECT * REPLACE (CASE WHEN kind = 'title' AND source <> 'native' AND page > first THEN 'heading' ELSE kind END AS kind) FROM (SELECT *, min(page) FILTER (kind = 'title' AND source <> 'native') OVER (PARTITION BY parse_id) AS first FROM repeats))"
_ALL = f"WITH {SQL_BLOCKS}, {_NUMBERED}, {_RUNNING}, {_REPEATED}, {_TITLED}"
_LEVEL = f"CASE WHEN kind = 'title' THEN 1 WHEN {_DEPTH} > 0 THEN least({_DEPTH} + 1, 6) ELSE least(greatest(level, 2), 6) END"
_OUTLINE = f"outline AS (SELECT parse_id, page, ord, ref, CAST(dense_rank() OVER (PARTITION BY parse_id ORDER BY l) AS INT) AS level, text FROM (SELECT *, {_LEVEL} AS l FROM titled WHERE kind IN ('title', 'heading')))"


@ENTRIES.add(f"WITH {SQL_BLOCKS} SELECT parse_id, page, ord, ref, kind, text FROM blocks")
def blocks_plain(spark, sf_dir):
    return blocks(spark, sf_dir).select("parse_id", "page", "ord", "ref", "kind", "text")


@ENTRIES.add(f"WITH {SQL_BLOCKS}, {_NUMBERED} SELECT parse_id, ref, kind, level FROM numbered")
def page_numbers(spark, sf_dir):
    return A.page_numbers(blocks(spark, sf_dir)).select("parse_id", "ref", "kind", "level")


@ENTRIES.add(f"WITH {SQL_BLOCKS}, {_NUMBERED}, {_RUNNING} SELECT parse_id, ref, kind, level FROM running")
def running_headers(spark, sf_dir):
    return A.running_lines(A.page_numbers(blocks(spark, sf_dir))).select("parse_id", "ref", "kind", "level")


@ENTRIES.add(f"WITH {SQL_BLOCKS}, {_NUMBERED}, {_RUNNING}, {_REPEATED} SELECT parse_id, ref, kind, repeated FROM repeats")
def repeated_mark(spark, sf_dir):
    return A.repeated(A.running_lines(A.page_numbers(blocks(spark, sf_dir)))).select("parse_id", "ref", "kind", "repeated")


@ENTRIES.add(_ALL + " SELECT parse_id, ref, kind, level, repeated FROM titled")
def assembled_document(spark, sf_dir):
    return A.assembled(blocks(spark, sf_dir)).select("parse_id", "ref", "kind", "level", "repeated")


@ENTRIES.add(f"WITH {SQL_BLOCKS}, repeats AS (SELECT * FROM blocks), {_TITLED} SELECT parse_id, ref, kind FROM titled WHERE kind IN ('title', 'heading')")
def one_title(spark, sf_dir):
    return A.one_title(blocks(spark, sf_dir)).select("parse_id", "ref", "kind").where("kind in ('title', 'heading')")


@ENTRIES.add(_ALL + f", {_OUTLINE} SELECT parse_id, page, ord, ref, level, text FROM outline")
def outline_levels(spark, sf_dir):
    return A.outline(A.assembled(blocks(spark, sf_dir))).withColumn("level", F.col("level").cast("int"))


@ENTRIES.add(f"WITH {SQL_ATTEMPTS} SELECT owner AS parse_id, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM attempts GROUP BY 1")
def document_usage(spark, sf_dir):
    return A.usage_sum(attempts(spark, sf_dir).withColumn("parse_id", F.col("owner")))


@ENTRIES.add(f"WITH {SQL_BLOCKS}, sel AS (SELECT p.range AS parse_id, CAST(g.range AS INT) AS page FROM range(20) p, range(1, 15) g), r AS (SELECT DISTINCT parse_id, page, state FROM blocks) SELECT parse_id, page, coalesce(state, 'skipped') AS state FROM sel LEFT JOIN r USING (parse_id, page)")
def skipped_pages(spark, sf_dir):
    b = blocks(spark, sf_dir)
    selected = spark.range(20).select(F.col("id").alias("parse_id"), F.explode(F.sequence(F.lit(1), F.lit(14))).alias("page"))
    return A.filled_pages(selected, b.select("parse_id", "page", "state").distinct())


@ENTRIES.add(f"WITH {SQL_BLOCKS}, {SQL_PARSE_IDS}, sel AS (SELECT parse_id, CAST(g.range AS INT) AS page FROM parse_ids, range(1, 15) g), r AS (SELECT DISTINCT parse_id, page, state FROM blocks) SELECT parse_id, page, coalesce(state, 'skipped') AS state FROM sel LEFT JOIN r USING (parse_id, page)")
def skipped_pages_whole(spark, sf_dir):
    """skipped_pages for every parse of the table."""
    selected = parse_ids(spark, sf_dir).select("parse_id", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("page"))
    return A.filled_pages(selected, blocks(spark, sf_dir).select("parse_id", "page", "state").distinct())


@ENTRIES.add(f"WITH {SQL_BLOCKS} SELECT parse_id, CASE WHEN parse_id % 9 = 8 THEN 'canceled' WHEN parse_id % 9 = 7 THEN 'failed' WHEN count(DISTINCT page) FILTER (state = 'failed') > parse_id % 2 THEN 'failed' ELSE 'succeeded' END AS outcome FROM blocks GROUP BY 1")
def parse_finish(spark, sf_dir):
    from docspark.operators.lifecycle import finish_state

    failed = blocks(spark, sf_dir).groupBy("parse_id").agg(F.countDistinct(F.when(F.col("state") == "failed", F.col("page"))).alias("failed"))
    p = F.col("parse_id")
    return failed.select("parse_id", finish_state(F.lit(None).cast("string"), p % 9 == 7, p % 9 == 8, F.col("failed"), p % 2).alias("outcome"))


# --- views -------------------------------------------------------------------------------------------------------


@ENTRIES.add(_ALL + " SELECT parse_id, ref, kind FROM titled WHERE state = 'succeeded' AND NOT repeated AND kind <> 'page_number' AND page IN (1, 2, 5)")
def view_filter(spark, sf_dir):
    return V.viewed(A.assembled(blocks(spark, sf_dir)), pages=[1, 2, 5]).select("parse_id", "ref", "kind")


@ENTRIES.add(_ALL + " SELECT parse_id, string_agg(text, chr(10) || chr(10) ORDER BY page, ord) || chr(10) AS body FROM titled WHERE state = 'succeeded' AND kind NOT IN ('page_header', 'page_footer', 'page_number') AND text <> '' GROUP BY 1")
def text_render(spark, sf_dir):
    return V.plain_text(A.assembled(blocks(spark, sf_dir)), repeated="drop")


_MD = f"CASE WHEN t.kind IN ('title', 'heading') THEN repeat('#', o.level) || ' ' || {sql_squeeze('t.text')} WHEN t.kind = 'list_item' THEN '- ' || {sql_squeeze('t.text')} WHEN t.kind = 'caption' THEN '*' || {sql_squeeze('t.text')} || '*' ELSE t.text END"


@ENTRIES.add(_ALL + f", {_OUTLINE}, md AS (SELECT t.parse_id, t.page, t.ord, {_MD} AS s FROM titled t LEFT JOIN (SELECT parse_id, ref, least(greatest(level, 1), 6) AS level FROM outline) o USING (parse_id, ref) WHERE state = 'succeeded' AND NOT repeated AND kind <> 'page_number') SELECT parse_id, string_agg(s, chr(10) || chr(10) ORDER BY page, ord) || chr(10) AS body FROM md WHERE s <> '' GROUP BY 1")
def markdown_render(spark, sf_dir):
    return V.markdown(A.with_outline(A.assembled(blocks(spark, sf_dir))))


@ENTRIES.add()
def markdown_render_breaks(spark, sf_dir):
    doc = A.assembled(blocks(spark, sf_dir))
    return V.markdown(doc, A.outline(doc), repeated="keep", page_breaks=True)


@ENTRIES.add(_ALL + r" SELECT parse_id, page, ord, ref, kind, regexp_replace(regexp_replace(text, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g'), '(?i)<(/?(?:document|schema))>', '&lt;\1>', 'g') AS text FROM titled WHERE state = 'succeeded' AND kind NOT IN ('page_header', 'page_footer', 'page_number') AND trim(text) <> ''")
def extraction_pieces(spark, sf_dir):
    return V.pieces(A.assembled(blocks(spark, sf_dir)))


@ENTRIES.add(f"WITH {SQL_BLOCKS}, w AS (SELECT p.range AS parse_id, g.range || '.' || (1 + p.range % 40) AS ref FROM range(60) p, range(1, 13) g) SELECT parse_id, ref, CASE WHEN state IS NULL THEN 'not_found' WHEN state <> 'succeeded' THEN 'not_ready' ELSE 'found' END AS answer, CASE WHEN state = 'succeeded' THEN kind END AS kind FROM w LEFT JOIN blocks USING (parse_id, ref)")
def block_lookup(spark, sf_dir):
    wanted = spark.range(60).select(F.col("id").alias("parse_id"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("p")).select("parse_id", F.concat_ws(".", "p", 1 + F.col("parse_id") % 40).alias("ref"))
    return V.lookup(blocks(spark, sf_dir), wanted)


@ENTRIES.add(f"WITH {SQL_BLOCKS}, {SQL_PARSE_IDS}, w AS (SELECT parse_id, g.range || '.' || (1 + parse_id % 40) AS ref FROM parse_ids, range(1, 13) g) SELECT parse_id, ref, CASE WHEN state IS NULL THEN 'not_found' WHEN state <> 'succeeded' THEN 'not_ready' ELSE 'found' END AS answer, CASE WHEN state = 'succeeded' THEN kind END AS kind FROM w LEFT JOIN blocks USING (parse_id, ref)")
def block_lookup_whole(spark, sf_dir):
    """block_lookup for every parse of the table."""
    wanted = parse_ids(spark, sf_dir).select("parse_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("p")).select("parse_id", F.concat_ws(".", "p", 1 + F.col("parse_id") % 40).alias("ref"))
    return V.lookup(blocks(spark, sf_dir), wanted)


_FIGURES = f"WITH {SQL_BLOCKS}, f AS (SELECT * REPLACE (CASE WHEN kind = 'list_item' THEN 'figure' ELSE kind END AS kind) FROM blocks), c AS (SELECT *, CASE WHEN lead(kind) OVER w = 'caption' THEN lead(text) OVER w END AS nx, CASE WHEN lag(kind) OVER w = 'caption' THEN lag(text) OVER w END AS pv FROM f WINDOW w AS (PARTITION BY parse_id, page ORDER BY ord)), g AS (SELECT *, coalesce(nx, pv, '') AS caption FROM c WHERE kind = 'figure' AND y0 IS NOT NULL AND state = 'succeeded')"


def _figures(spark, sf_dir):
    return V.figures(blocks(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "list_item", "figure").otherwise(F.col("kind"))))


@ENTRIES.add(_FIGURES + " SELECT parse_id, page, ord, ref, caption FROM g")
def figure_caption(spark, sf_dir):
    return _figures(spark, sf_dir).select("parse_id", "page", "ord", "ref", "caption")


@ENTRIES.add(_FIGURES + " SELECT parse_id, ref, sha256('c' || parse_id || chr(0) || page || chr(0) || printf('%.5f,%.5f,%.5f,%.5f', 0.1::DOUBLE, y0, 0.9::DOUBLE, y1) || chr(0) || caption || chr(0) || 'en,fr' || chr(0) || 'layout=3') AS figure_key FROM g")
def read_key(spark, sf_dir):
    key = V.figure_key(F.concat(F.lit("c"), F.col("parse_id")), F.col("page"), F.col("box"), F.col("caption"), F.lit("en,fr"), F.array(F.lit("layout=3")))
    return _figures(spark, sf_dir).select("parse_id", "ref", key.alias("figure_key"))


@ENTRIES.add(f"WITH {SQL_BLOCKS} SELECT parse_id, ref, CASE WHEN ord % 3 = 0 THEN CASE WHEN ord % 2 = 0 THEN 'labels of ' || ref ELSE '' END ELSE text END AS text, CASE WHEN ord % 2 = 0 THEN 'shows ' || ref END AS description FROM blocks")
def figure_descriptions(spark, sf_dir):
    b = blocks(spark, sf_dir).select("parse_id", "ref", "ord", F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("text")).alias("text"))
    said = b.where("ord % 2 = 0").select("parse_id", "ref", F.concat(F.lit("shows "), F.col("ref")).alias("description"), F.concat(F.lit("labels of "), F.col("ref")).alias("labels"))
    return V.described(b, said).select("parse_id", "ref", "text", "description")


@ENTRIES.add(_ALL + """ SELECT '{"parse_id":' || parse_id || ',"page":' || page || ',"ord":' || ord || ',"ref":"' || ref || '","kind":"' || kind || '"}' AS value FROM titled""")
def blocks_ndjson(spark, sf_dir):
    return V.as_ndjson(A.assembled(blocks(spark, sf_dir)).select("parse_id", "page", "ord", "ref", "kind"))


# --- chunks, windows, spans ----------------------------------------------------------------------------------------


@ENTRIES.add()
def chunks_by_section(spark, sf_dir):
    return D.chunks(A.assembled(blocks(spark, sf_dir)), "section", 1200)


@ENTRIES.add()
def chunks_by_page(spark, sf_dir):
    return D.chunks(A.assembled(blocks(spark, sf_dir)), "page", 6000)


@ENTRIES.add()
def windows_pack(spark, sf_dir):
    return D.windows(V.pieces(A.assembled(blocks(spark, sf_dir))), 8000)


def table_blocks(spark, sf_dir):
    """Pages whose first and last blocks are tables of three columns under a header that some pages share."""
    prepare(spark)
    n = table(spark, sf_dir, "documents").select("doc_id")
    page = (F.col("doc_id") % 10 + 1).cast("int")
    head = F.concat(F.lit("Item "), (F.floor(F.col("doc_id") / 3) % 2).cast("string"))

    def cell(r, c, t):
        return F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(r == 0).alias("header"), t.alias("text")).cast("struct<row:int,col:int,row_span:int,col_span:int,header:boolean,text:string>")

    cells = F.array(cell(0, 0, head), cell(0, 1, F.lit("Price")), cell(1, 0, F.col("doc_id").cast("string")), cell(1, 1, F.lit("1")))
    whole = F.struct(F.lit(2).alias("rows"), (2 + F.col("doc_id") % 29 % 2).cast("int").alias("cols"), cells.alias("cells")).cast("struct<rows:int,cols:int,cells:array<struct<row:int,col:int,row_span:int,col_span:int,header:boolean,text:string>>>")
    rows = n.select(
        F.floor(F.col("doc_id") / 10).alias("parse_id"), page.alias("page"), F.when(F.col("doc_id") % 17 == 3, "failed").otherwise("succeeded").alias("state"), whole.alias("table"), (F.col("doc_id") % 7 == 0).alias("noted"),
        F.explode(F.array(F.lit("page_header"), F.lit("caption"), F.lit("table"))).alias("kind"),
    )
    ordered = F.when(F.col("kind") == "page_header", 1).when(F.col("kind") == "caption", 2).otherwise(3)
    return rows.select(
        "parse_id", "page", "state", ordered.alias("ord"), F.concat_ws(".", "page", ordered).alias("ref"), "kind", F.when(F.col("kind") == "caption", F.when(F.col("noted"), "Table 1").otherwise("Table 1 (continued)")).otherwise("x").alias("text"),
        F.when(F.col("kind") == "table", F.col("table")).alias("table"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("box"),
    )


@ENTRIES.add()
def table_spans(spark, sf_dir):
    return A.spans(table_blocks(spark, sf_dir))


@ENTRIES.add("""WITH p AS (SELECT doc_id // 10 AS parse_id, CAST(doc_id % 10 + 1 AS INT) AS page, doc_id % 17 = 3 AS failed, doc_id % 7 = 0 AS noted, 'item ' || (doc_id // 3 % 2) || chr(31) || 'price' AS header FROM documents)
  SELECT parse_id, page, page || '.' || CASE WHEN noted THEN 2 ELSE 3 END AS first_ref, page || '.3' AS last_ref, header FROM p WHERE NOT failed""")
def table_edges(spark, sf_dir):
    e = A.table_edges(table_blocks(spark, sf_dir))
    return e.select("parse_id", "page", F.col("first.ref").alias("first_ref"), F.col("last.ref").alias("last_ref"), F.col("last.t.header").alias("header"))


@ENTRIES.add("SELECT doc_id, chr(60) || 'table><tr><th>Item ' || (doc_id // 3 % 2) || '</th><th>Price</th></tr><tr><td>' || doc_id || '</td><td>1</td></tr></table>' AS html, 'Item ' || (doc_id // 3 % 2) || ' | Price' || chr(10) || doc_id || ' | 1' AS text FROM documents")
def table_markup(spark, sf_dir):
    t = table_blocks(spark, sf_dir).where("kind = 'table'")
    cells = F.col("table.cells")
    return t.select((F.col("parse_id") * 10 + F.col("page") - 1).alias("doc_id"), V.table_html(cells).alias("html"), V.table_text(cells).alias("text"))


@ENTRIES.add("SELECT doc_id, '| Item ' || (doc_id // 3 % 2) || ' | Price |' || CASE WHEN doc_id % 29 % 2 = 1 THEN '  |' ELSE '' END || chr(10) || '|' || repeat(' --- |', CAST(2 + doc_id % 29 % 2 AS INT)) || chr(10) || '| ' || doc_id || ' | 1 |' || CASE WHEN doc_id % 29 % 2 = 1 THEN '  |' ELSE '' END AS markdown FROM documents")
def table_as_markdown(spark, sf_dir):
    t = table_blocks(spark, sf_dir).where("kind = 'table'")
    return t.select((F.col("parse_id") * 10 + F.col("page") - 1).alias("doc_id"), V.table_markdown(F.col("table")).alias("markdown"))
