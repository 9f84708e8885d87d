"""Queries over scores, and over extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import extract as T
from docspark.operators import quality as Q
from docspark.plans.bind import SQL_BLOCKS, SQL_PARSES, blocks, parses, sql_squeeze
from docspark.plans.entry import Entries
from docspark.session import prepare, table

ENTRIES = Entries()


def truth_and_found(spark, sf_dir, ascii_only=False):
    """Benchmark passages as the truth, and a reading of each: words dropped, doubled or changed; ten items a document.

    ascii_only leaves out all other characters, as the SQL of the queries without _whole does.
    """
    prepare(spark)
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    if ascii_only:
        b = b.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    by, page = F.floor(F.col("item_id") / 10).alias("doc"), (F.col("item_id") % 10 + 1).cast("int").alias("page")
    lines = b.select(by, page, "item_id", F.posexplode(F.split("text", r"\.")).alias("pos", "text")).where("text <> ''")
    truth = lines.select("doc", "page", (F.col("pos") + 1).alias("ord"), F.when(F.length("text") % 4 == 0, "heading").otherwise("text").alias("kind"), "text")
    read = F.when(F.col("ord") % 3 == 0, F.regexp_replace("text", "e", "")).when(F.col("ord") % 3 == 1, F.concat(F.col("text"), F.lit(" x"))).otherwise(F.col("text"))
    found = truth.where("page <> 4").select("doc", "page", "ord", F.when(F.col("ord") % 5 == 0, "caption").otherwise(F.col("kind")).alias("kind"), read.alias("text"))
    return truth, found


_TRUTH = r"""lines AS (SELECT item_id // 10 AS doc, CAST(item_id % 10 + 1 AS INT) AS page, unnest(string_split(t, '.')) AS text, generate_subscripts(string_split(t, '.'), 1) AS ord FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM benchmark)),
  truth AS (SELECT doc, page, CAST(ord AS INT) AS ord, CASE WHEN length(text) % 4 = 0 THEN 'heading' ELSE 'text' END AS kind, text FROM lines WHERE text <> ''),
  found AS (SELECT doc, page, ord, CASE WHEN ord % 5 = 0 THEN 'caption' ELSE kind END AS kind, CASE ord % 3 WHEN 0 THEN replace(text, 'e', '') WHEN 1 THEN text || ' x' ELSE text END AS text FROM truth WHERE page <> 4)"""


@ENTRIES.add(f"WITH {_TRUTH}, t AS (SELECT doc, page, string_agg({sql_squeeze('text')}, ' ' ORDER BY ord) FILTER ({sql_squeeze('text')} <> '') AS words FROM truth GROUP BY 1, 2) SELECT doc, page, coalesce(words, '') AS words FROM t")
def transcriptions(spark, sf_dir):
    truth, _ = truth_and_found(spark, sf_dir, ascii_only=True)
    return Q.transcription(truth, ["doc", "page"])


_EDITS = f"""{_TRUTH}, t AS (SELECT doc, page, string_agg({sql_squeeze('text')}, ' ' ORDER BY ord) FILTER ({sql_squeeze('text')} <> '') AS want FROM truth GROUP BY 1, 2), f AS (SELECT doc, page, string_agg({sql_squeeze('text')}, ' ' ORDER BY ord) FILTER ({sql_squeeze('text')} <> '') AS got FROM found GROUP BY 1, 2),
  e AS (SELECT doc, page, length(coalesce(want, '')) AS characters, levenshtein(coalesce(want, ''), coalesce(got, '')) AS edits FROM t FULL JOIN f USING (doc, page))"""


@ENTRIES.add(f"WITH {_EDITS} SELECT doc, page, CAST(characters AS BIGINT) AS characters, CAST(edits AS BIGINT) AS edits FROM e")
def cer_by_page(spark, sf_dir):
    truth, found = truth_and_found(spark, sf_dir, ascii_only=True)
    return Q.edits(truth, found, ["doc", "page"])


@ENTRIES.add(f"WITH {_EDITS} SELECT doc, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(characters) AS BIGINT) AS characters, sum(edits) / CAST(greatest(sum(characters), 1) AS DOUBLE) AS cer FROM e GROUP BY 1")
def cer_by_document(spark, sf_dir):
    truth, found = truth_and_found(spark, sf_dir, ascii_only=True)
    return Q.cer(Q.edits(truth, found, ["doc", "page"]), ["doc"])


@ENTRIES.add()
def greedy_match(spark, sf_dir):
    truth, found = truth_and_found(spark, sf_dir)
    return Q.matches(truth, found, ["doc", "page"])


def _pairs(spark, sf_dir, ascii_only=False):
    truth, found = truth_and_found(spark, sf_dir, ascii_only)
    other = found.select("doc", "page", F.col("ord"), F.col("ord").alias("found_ord"), F.col("kind").alias("found_kind"))
    swapped = other.withColumn("found_ord", F.when(F.col("ord") % 4 == 2, F.col("ord") + 9).otherwise(F.col("ord")))
    return truth.join(swapped, ["doc", "page", "ord"], "left").withColumn("ref", X.ref(F.col("page"), F.col("ord")))


_PAIRS = f"{_TRUTH}, pairs AS (SELECT t.doc, t.page, t.ord, t.kind, t.text, t.page || '.' || t.ord AS ref, f.kind AS found_kind, CASE WHEN f.ord % 4 = 2 THEN f.ord + 9 ELSE f.ord END AS found_ord FROM truth t LEFT JOIN found f USING (doc, page, ord))"


@ENTRIES.add(f"WITH {_PAIRS} SELECT doc, count(*) FILTER (kind = found_kind) AS kinds_right, count(*) AS blocks, count(*) FILTER (kind = found_kind) / CAST(count(*) AS DOUBLE) AS kinds FROM pairs GROUP BY 1")
def kinds_share(spark, sf_dir):
    return Q.kinds_share(_pairs(spark, sf_dir, ascii_only=True), ["doc"])


@ENTRIES.add(f"WITH {_PAIRS}, l AS (SELECT *, lag(found_ord) OVER (PARTITION BY doc, page ORDER BY ord) AS b FROM pairs), s AS (SELECT doc, count(*) FILTER (b < found_ord) AS order_right, count(*) FILTER (b IS NOT NULL AND found_ord IS NOT NULL) AS order_pairs FROM l GROUP BY 1) SELECT *, CASE WHEN order_pairs = 0 THEN 1.0::DOUBLE ELSE order_right / CAST(order_pairs AS DOUBLE) END AS \"order\" FROM s")
def order_share(spark, sf_dir):
    return Q.order_share(_pairs(spark, sf_dir, ascii_only=True), ["doc", "page"], ["doc"])


@ENTRIES.add(f"""WITH {_PAIRS}, n AS (SELECT doc, page, ord, CASE WHEN found_kind IS NULL THEN ref || ' ' || kind || ' is not found: "' || CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END || '"' WHEN found_kind <> kind THEN ref || ' ' || kind || ' is found as ' || found_kind || ': "' || CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END || '"' END AS note FROM pairs),
  r AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, ord) AS INT) AS n, note FROM n WHERE note IS NOT NULL) SELECT * FROM r WHERE n <= 40""")
def score_notes(spark, sf_dir):
    return Q.notes(_pairs(spark, sf_dir, ascii_only=True), ["doc"])


# --- scores of whole texts -------------------------------------------------------------------------------------------

_TRUTH_WHOLE = _TRUTH.replace(r"regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t", "text AS t")


def _whole(name: str) -> str:
    """The SQL of a query above, over whole texts. DuckDB's levenshtein counts bytes, so those with an edit distance have none."""
    return ENTRIES.oracles[name].replace(_TRUTH, _TRUTH_WHOLE)


@ENTRIES.add(_whole("transcriptions"))
def transcriptions_whole(spark, sf_dir):
    truth, _ = truth_and_found(spark, sf_dir)
    return Q.transcription(truth, ["doc", "page"])


@ENTRIES.add()
def cer_by_page_whole(spark, sf_dir):
    truth, found = truth_and_found(spark, sf_dir)
    return Q.edits(truth, found, ["doc", "page"])


@ENTRIES.add()
def cer_by_document_whole(spark, sf_dir):
    return Q.cer(cer_by_page_whole(spark, sf_dir), ["doc"])


@ENTRIES.add(_whole("kinds_share"))
def kinds_share_whole(spark, sf_dir):
    return Q.kinds_share(_pairs(spark, sf_dir), ["doc"])


@ENTRIES.add(_whole("order_share"))
def order_share_whole(spark, sf_dir):
    return Q.order_share(_pairs(spark, sf_dir), ["doc", "page"], ["doc"])


@ENTRIES.add(_whole("score_notes"))
def score_notes_whole(spark, sf_dir):
    return Q.notes(_pairs(spark, sf_dir), ["doc"])


_CELLS = "cells AS (SELECT l_orderkey AS tab, CAST(l_linenumber AS INT) AS row, 0 AS col, CAST(l_suppkey % 3 AS INT) AS rs, min(l_partkey) AS v FROM lineitem GROUP BY ALL), one AS (SELECT tab, row, col, min(rs) AS rs, min(v) AS v FROM cells GROUP BY 1, 2, 3)"


@ENTRIES.add(f"WITH {_CELLS}, f AS (SELECT tab, row, CASE WHEN rs = 2 THEN 1 ELSE rs END AS rs, ' ' || v || CASE WHEN v % 7 = 0 THEN 'x' ELSE '  ' END AS text FROM one WHERE v % 11 > 0) SELECT tab % 10 AS grp, count(*) FILTER (greatest(o.rs, 1) = greatest(f.rs, 1) AND CAST(o.v AS VARCHAR) = trim(f.text)) AS cells_right, count(*) AS cells_total, count(*) FILTER (greatest(o.rs, 1) = greatest(f.rs, 1) AND CAST(o.v AS VARCHAR) = trim(f.text)) / CAST(count(*) AS DOUBLE) AS cells FROM one o LEFT JOIN f USING (tab, row) GROUP BY 1")
def cells_share(spark, sf_dir):
    prepare(spark)
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.col("l_orderkey").alias("tab"), F.col("l_linenumber").cast("int").alias("row"), F.lit(0).alias("col"), (F.col("l_suppkey") % 3).cast("int").alias("rs")).agg(F.min("l_partkey").alias("v"))
    one = cells.groupBy("tab", "row", "col").agg(F.min("rs").alias("rs"), F.min("v").alias("v"))
    truth = one.select("tab", "row", "col", F.col("rs").alias("row_span"), F.lit(1).alias("col_span"), F.col("v").cast("string").alias("text"), (F.col("tab") % 10).alias("grp"))
    read = F.concat(F.lit(" "), F.col("v").cast("string"), F.when(F.col("v") % 7 == 0, "x").otherwise("  "))
    found = one.where("v % 11 > 0").select("tab", "row", "col", F.when(F.col("rs") == 2, 1).otherwise(F.col("rs")).alias("row_span"), F.lit(1).alias("col_span"), read.alias("text"))
    return Q.cells_share(truth, found, ["tab"], ["grp"])


@ENTRIES.add(f"WITH {SQL_BLOCKS}, b AS (SELECT parse_id, y0, y1, CASE WHEN ord % 3 = 0 THEN y0 + 0.7 * (y1 - y0) ELSE y0 END AS v0, CASE WHEN ord % 3 = 0 THEN y1 + 0.7 * (y1 - y0) ELSE y1 END AS v1, ord FROM blocks), o AS (SELECT *, least(y1, v1) - greatest(y0, v0) AS h FROM b), s AS (SELECT parse_id, count(*) FILTER (y0 IS NOT NULL AND ord % 3 <> 0) AS boxes_right, count(y0) AS boxes_total FROM o GROUP BY 1) SELECT *, CASE WHEN boxes_total > 0 THEN boxes_right / CAST(boxes_total AS DOUBLE) END AS boxes FROM s")
def boxes_share(spark, sf_dir):
    from docspark.functions.geometry import box

    b = blocks(spark, sf_dir)
    p, h = F.col("box"), F.col("box.y1") - F.col("box.y0")
    moved = F.when(p.isNotNull(), F.when(F.col("ord") % 3 == 0, box(p["x0"], p["y0"] + 0.7 * h, p["x1"], p["y1"] + 0.7 * h)).otherwise(p))
    return Q.boxes_share(b.withColumn("found_box", moved), ["parse_id"])


_SCORES = "scores AS (SELECT s_suppkey AS file, ['exact', 'typeset', 'scan', 'converted'][s_suppkey % 4 + 1] AS class, s_suppkey % 7 / 100.0::DOUBLE AS cer, 1 - s_suppkey % 13 / 100.0::DOUBLE AS kinds, CASE WHEN s_suppkey % 5 > 0 THEN 1 - s_suppkey % 11 / 100.0::DOUBLE END AS cells, 1 - s_suppkey % 9 / 100.0::DOUBLE AS ord_, CASE WHEN s_suppkey % 3 > 0 THEN 1 - s_suppkey % 17 / 100.0::DOUBLE END AS boxes FROM supplier)"
_BARS = "bars AS (SELECT * FROM (VALUES ('exact', 0.0, 1.0, 1.0, 1.0, 1.0), ('typeset', 0.02, 0.90, 0.95, 0.95, 0.90), ('scan', 0.05, 0.90, 0.95, 0.95, 0.85), ('converted', 0.02, 0.90, 0.95, 0.95, 0.90)) t(class, b1, b2, b3, b4, b5))"


def _scores(spark, sf_dir):
    prepare(spark)
    k = F.col("s_suppkey")
    names = F.array(*[F.lit(x) for x in Q.BARS])
    return table(spark, sf_dir, "supplier").select(
        k.alias("file"), F.element_at(names, (k % 4).cast("int") + 1).alias("class"), (k % 7 / 100.0).alias("cer"), (1 - k % 13 / 100.0).alias("kinds"), F.when(k % 5 > 0, 1 - k % 11 / 100.0).alias("cells"), (1 - k % 9 / 100.0).alias("order"),
        F.when(k % 3 > 0, 1 - k % 17 / 100.0).alias("boxes"), (k % 20).alias("pages"), (k % 6).alias("read_pages"), (k * 1.5).alias("seconds"),
    )


@ENTRIES.add(f"""WITH {_SCORES}, {_BARS}, m AS (SELECT file, 'cer' AS measure, cer AS value, CAST(b1 AS DOUBLE) AS bar FROM scores JOIN bars USING (class) WHERE cer > CAST(b1 AS DOUBLE) UNION ALL SELECT file, 'kinds', kinds, CAST(b2 AS DOUBLE) FROM scores JOIN bars USING (class) WHERE kinds < CAST(b2 AS DOUBLE)
  UNION ALL SELECT file, 'cells', cells, CAST(b3 AS DOUBLE) FROM scores JOIN bars USING (class) WHERE cells < CAST(b3 AS DOUBLE) UNION ALL SELECT file, 'order', ord_, CAST(b4 AS DOUBLE) FROM scores JOIN bars USING (class) WHERE ord_ < CAST(b4 AS DOUBLE) UNION ALL SELECT file, 'boxes', boxes, CAST(b5 AS DOUBLE) FROM scores JOIN bars USING (class) WHERE boxes < CAST(b5 AS DOUBLE)) SELECT * FROM m""")
def bars_misses(spark, sf_dir):
    return Q.misses(_scores(spark, sf_dir), ["file"])


@ENTRIES.add("SELECT s_suppkey AS file, s_suppkey * 1.5::DOUBLE / greatest(CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 6 ELSE s_suppkey % 20 END, 1) AS seconds_per_page FROM supplier")
def quality_report(spark, sf_dir):
    return Q.report(_scores(spark, sf_dir)).select("file", "seconds_per_page")


@ENTRIES.add(f"WITH {SQL_BLOCKS}, c AS (SELECT parse_id, page, ord, kind, level, CAST(dense_rank() OVER (PARTITION BY parse_id ORDER BY page) AS INT) AS p2, CAST(dense_rank() OVER (PARTITION BY parse_id, kind IN ('title', 'heading') ORDER BY level) AS INT) AS l2 FROM blocks WHERE page IN (2, 3, 7)) SELECT parse_id, p2 || '.' || ord AS ref, p2 AS page, CASE WHEN kind IN ('title', 'heading') THEN l2 ELSE level END AS level FROM c")
def truth_selection(spark, sf_dir):
    return Q.selected_truth(blocks(spark, sf_dir), [2, 3, 7]).select("parse_id", "ref", "page", "level")


# --- extractions ---------------------------------------------------------------------------------------------------

SCHEMA = {
    "type": "object", "properties": {"total": {"type": "integer", "minimum": 1000}, "label": {"type": "string", "enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 8}, "maxItems": 2}},
    "required": ["total", "label"], "additionalProperties": False,
}


def parts(spark, sf_dir):
    """Three parts of each parse's extraction, as an extractor might answer window by window."""
    p = parses(spark, sf_dir)
    label = F.concat(F.lit('"'), F.col("label"), F.lit('"'))
    one = F.concat(F.lit('{"total": null, "tags": ["a'), F.col("file_id"), F.lit('"]}'))
    two = F.concat(F.lit('{"total": '), F.col("tokens"), F.lit(', "tags": ["b", "a'), F.col("file_id"), F.lit('"]}'))
    three = F.concat(F.lit('{"total": 5, "label": '), label, F.lit("}"))
    rows = p.select("parse_id", F.posexplode(F.array(one, two, three)).alias("window", "data"))
    cite = F.to_json(F.create_map(F.lit("/total"), F.array(F.concat(F.col("window") + 1, F.lit(".1")))))
    return rows.select("parse_id", "window", "data", cite.alias("citations"))


@ENTRIES.add()
def merge_fields(spark, sf_dir):
    return T.merge(parts(spark, sf_dir), ["parse_id"])


@ENTRIES.add(f"WITH {SQL_PARSES} SELECT parse_id, tokens AS total, label FROM parses")
def merge_scalars(spark, sf_dir):
    return T.merge_flat(parts(spark, sf_dir), ["parse_id"], {"total": "long", "label": "string"})


@ENTRIES.add(f"""WITH {SQL_PARSES}, f AS (SELECT parse_id, unnest(list_filter([CASE WHEN tokens < 1000 THEN '/total minimum' END, CASE WHEN label NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN '/label enum' END], lambda x: x IS NOT NULL)) AS finding FROM parses) SELECT parse_id, split_part(finding, ' ', 1) AS pointer, split_part(finding, ' ', 2) AS rule FROM f""")
def validate_findings(spark, sf_dir):
    merged = T.merge(parts(spark, sf_dir), ["parse_id"])
    found = merged.select("parse_id", T.findings(F.col("data"), SCHEMA).alias("f"))
    return found.select("parse_id", F.inline("f")).select("parse_id", "pointer", "rule")


@ENTRIES.add("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'filled' WHEN 1 THEN 'repair' WHEN 2 THEN 'next' WHEN 3 THEN 'unsatisfied' WHEN 4 THEN 'filled' ELSE 'next' END AS step FROM documents")
def extraction_steps(spark, sf_dir):
    prepare(spark)
    k = F.col("doc_id") % 6
    facts = table(spark, sf_dir, "documents").select("doc_id", (k.isin(1, 3)).cast("int").alias("findings"), F.when(k == 3, 2).otherwise(0).alias("repairs"), F.when(k.isin(0, 4), 3).otherwise(1).alias("window"), F.lit(3).alias("windows"))
    return facts.select("doc_id", T.next_step().alias("step"))
