"""Queries over what readers return: labels, markers, boxes, replies, and the scalar functions they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.functions import text as X
from docspark.operators import layout as E
from docspark.operators import normalize as N
from docspark.plans.assembly_queries import _DEPTH, _NUMBER
from docspark.plans.bind import SQL_BLOCKS, SQL_REGIONS, blocks, raw_regions, sql_fold, sql_squeeze
from docspark.plans.entry import Entries
from docspark.session import prepare, table

ENTRIES = Entries()

_LABELS = "CASE label WHEN 'Section-header' THEN 'heading' WHEN 'LAYOUT_FIGURE' THEN 'figure' WHEN 'QR code' THEN 'barcode' WHEN 'list item' THEN 'list_item' WHEN 'Formula' THEN 'formula' WHEN 'text' THEN 'text' WHEN 'page header' THEN 'page_header' END"


@ENTRIES.add(f"WITH {SQL_REGIONS} SELECT page, pos, coalesce({_LABELS}, 'text') AS kind, ({_LABELS}) IS NULL AS coerced FROM regions")
def label_coerce(spark, sf_dir):
    known = X.label_kind(F.col("label"))
    return raw_regions(spark, sf_dir).select("page", "pos", F.coalesce(known, F.lit("text")).alias("kind"), known.isNull().alias("coerced"))


_FIXED = """lower AS (SELECT *, least(a, c) / 100 AS lx, greatest(a, c) / 100 AS hx, least(b, d) / 100 AS ly, greatest(b, d) / 100 AS hy FROM regions),
  fixed AS (SELECT *, least(greatest(lx, 0), 1) AS x0, least(greatest(hx, 0), 1) AS x1, least(greatest(ly, 0), 1) AS y0, least(greatest(hy, 0), 1) AS y1 FROM lower),
  boxed AS (SELECT *, x0 < x1 AND y0 < y1 AS ok, NOT (x0 = a / 100 AND y0 = b / 100 AND x1 = c / 100 AND y1 = d / 100) AS repaired FROM fixed)"""


@ENTRIES.add(f"WITH {SQL_REGIONS}, {_FIXED} SELECT page, pos, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, repaired FROM boxed")
def box_normalize(spark, sf_dir):
    r = raw_regions(spark, sf_dir)
    fixed = G.normalized(G.scaled(F.col("raw_box"), F.col("width"), F.col("height")))
    return r.select("page", "pos", fixed.alias("f")).select("page", "pos", "f.box.x0", "f.box.y0", "f.box.x1", "f.box.y1", "f.repaired")


@ENTRIES.add(f"""WITH {SQL_REGIONS}, {_FIXED}, k AS (SELECT *, coalesce({_LABELS}, 'text') AS kind, ({_LABELS}) IS NULL AS coerced, CASE WHEN "order" > 0 THEN "order" ELSE pos + 1 END AS o,
    CASE label WHEN 'Section-header' THEN 'Results' WHEN 'list item' THEN 'first' WHEN 'Formula' THEN 'x+y' ELSE trim(text) END AS body FROM boxed)
  SELECT page, kind, body AS text, CASE WHEN kind = 'heading' THEN 2 ELSE 0 END AS level, array_to_string(list_filter([CASE WHEN coerced THEN 'kind_coerced' END, CASE WHEN NOT ok OR repaired THEN 'box_clamped' END], lambda x: x IS NOT NULL), ',') AS flags,
    CAST(row_number() OVER (PARTITION BY page ORDER BY o, pos) AS INT) AS ord FROM k WHERE body <> '' OR kind IN ('figure', 'signature', 'barcode')""")
def normalized_blocks(spark, sf_dir):
    out = N.regions(raw_regions(spark, sf_dir))
    return out.select("page", "kind", "text", "level", F.array_join("flags", ",").alias("flags"), "ord")


@ENTRIES.add(f"""WITH {SQL_REGIONS}, {_FIXED}, p AS (SELECT *, lead(ok) OVER w AS ok2, lead(x0) OVER w AS u0, lead(y0) OVER w AS v0, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1 FROM boxed WINDOW w AS (PARTITION BY page ORDER BY pos)),
  o AS (SELECT *, least(x1, u1) - greatest(x0, u0) AS w, least(y1, v1) - greatest(y0, v0) AS h FROM p)
  SELECT page, pos, CASE WHEN ok AND coalesce(ok2, false) AND w > 0 AND h > 0 THEN w * h / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - w * h) ELSE 0.0::DOUBLE END AS iou FROM o""")
def iou_pairs(spark, sf_dir):
    from pyspark.sql import Window

    fixed = G.normalized(G.scaled(F.col("raw_box"), F.col("width"), F.col("height")))
    r = raw_regions(spark, sf_dir).select("page", "pos", fixed["box"].alias("box"))
    r = r.withColumn("next", F.lead("box").over(Window.partitionBy("page").orderBy("pos")))
    return r.select("page", "pos", G.overlap(F.col("box"), F.col("next")).alias("iou"))


@ENTRIES.add(f"WITH {SQL_REGIONS}, {_FIXED} SELECT page, pos, CAST(greatest(floor(x0 * 640), 0) AS INT) AS \"left\", CAST(greatest(floor(y0 * 480), 0) AS INT) AS top, CAST(least(ceil(x1 * 640), 640) AS INT) AS \"right\", CAST(least(ceil(y1 * 480), 480) AS INT) AS bottom FROM boxed WHERE ok")
def crop_rectangles(spark, sf_dir):
    fixed = G.normalized(G.scaled(F.col("raw_box"), F.col("width"), F.col("height")))
    r = raw_regions(spark, sf_dir).select("page", "pos", fixed["box"].alias("box")).where("box is not null")
    return r.select("page", "pos", G.crop(F.col("box"), F.lit(640), F.lit(480)).alias("c")).select("page", "pos", "c.*")


_MARKED = "['- a', '* b', '12) c', '(3) d', '• e', '1234. f', '-', '– g', '3. ', 'h']"


@ENTRIES.add(rf"WITH m AS (SELECT event_id, {_MARKED}[event_id % 10 + 1] || CASE WHEN event_id % 10 IN (6, 8) THEN '' ELSE ' ' || event_type END AS t FROM events) SELECT event_id, CASE WHEN regexp_replace(t, '^(?:[-*+•·◦▪‣–]|\(?[0-9]{{1,3}}[.)])[ \t]+', '') <> '' THEN regexp_replace(t, '^(?:[-*+•·◦▪‣–]|\(?[0-9]{{1,3}}[.)])[ \t]+', '') ELSE t END AS body FROM m")
def list_marker_strip(spark, sf_dir):
    prepare(spark)
    marks = F.array(*[F.lit(x) for x in ("- a", "* b", "12) c", "(3) d", "• e", "1234. f", "-", "– g", "3. ", "h")])
    which = F.col("event_id") % 10
    text = F.concat(F.element_at(marks, which.cast("int") + 1), F.when(which.isin(6, 8), "").otherwise(F.concat(F.lit(" "), F.col("event_type"))))
    return table(spark, sf_dir, "events").select("event_id", X.list_body(text).alias("body"))


@ENTRIES.add("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN event_type WHEN 4 THEN '$$' ELSE '$' || event_type END AS body FROM events""")
def math_delimiters(spark, sf_dir):
    prepare(spark)
    t, k = F.col("event_type"), F.col("event_id") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("$$ "), t, F.lit(" $$"))).when(k == 1, F.concat(F.lit("\\["), t, F.lit("\\]"))).when(k == 2, F.concat(F.lit("\\( "), t, F.lit("\\)"))).when(k == 3, F.concat(F.lit("$"), t, F.lit("$")))
        .when(k == 4, F.lit("$$$$$$")).otherwise(F.concat(F.lit("$"), t))
    )
    return table(spark, sf_dir, "events").select("event_id", X.math_body(text).alias("body"))


_HEADS = "['3 ', '2.3. ', '3.2.1 ', 'A.1 ', 'A. ', 'IV. ', 'A ', '2024 ', '3rd ', 'IBM. ', '# ', '### ', '1']"


@ENTRIES.add(f"WITH h AS (SELECT doc_id, {_HEADS}[doc_id % 13 + 1] || split_part(text, ' ', 1) AS text FROM documents) SELECT doc_id, CAST({_DEPTH} AS INT) AS depth, CAST(length(regexp_extract(text, '^(#{{1,6}}) ', 1)) AS INT) AS marks FROM h")
def section_depth(spark, sf_dir):
    prepare(spark)
    heads = F.array(*[F.lit(x) for x in ("3 ", "2.3. ", "3.2.1 ", "A.1 ", "A. ", "IV. ", "A ", "2024 ", "3rd ", "IBM. ", "# ", "### ", "1")])
    text = F.concat(F.element_at(heads, (F.col("doc_id") % 13).cast("int") + 1), F.split_part("text", F.lit(" "), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", X.section_depth(text).alias("depth"), X.heading_marks(text)["marks"].alias("marks"))


@ENTRIES.add(rf"WITH n AS (SELECT event_id, replace(['3', 'Page 3', 'page # of 40', '# / 40', '- # -', '[#]', '(#)', 'p. #', 'Seite # von 40', 'Página # de 40', '#.', '1,#', 'Total #', '# apples', 'Chapter #'][event_id % 15 + 1], '#', CAST(event_id AS VARCHAR)) AS t FROM events) SELECT event_id, regexp_matches(t, '{_NUMBER}') AS is_number FROM n")
def page_number_texts(spark, sf_dir):
    prepare(spark)
    forms = F.array(*[F.lit(x) for x in ("3", "Page 3", "page # of 40", "# / 40", "- # -", "[#]", "(#)", "p. #", "Seite # von 40", "Página # de 40", "#.", "1,#", "Total #", "# apples", "Chapter #")])
    text = F.replace(F.element_at(forms, (F.col("event_id") % 15).cast("int") + 1), F.lit("#"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.is_page_number(text).alias("is_number"))


@ENTRIES.add(f"WITH {SQL_BLOCKS} SELECT parse_id, ref, {sql_fold('text')} AS folded, regexp_replace({sql_fold('text')}, '\\p{{Nd}}+', '#', 'g') AS keyed, {sql_squeeze('text')} AS one_line FROM blocks")
def text_folds(spark, sf_dir):
    t = F.col("text")
    return blocks(spark, sf_dir).select("parse_id", "ref", X.fold(t).alias("folded"), X.fold_digits(X.fold(t)).alias("keyed"), X.squeeze(t).alias("one_line"))


@ENTRIES.add("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') AS escaped, sha256(concat_ws(chr(0), url, html)) AS digest FROM pages")
def html_escapes(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"), X.sha256_of(F.col("url"), F.col("html")).alias("digest"))


@ENTRIES.add("WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id || '.' || event_id WHEN 1 THEN '0' || user_id || '.1' WHEN 2 THEN user_id || '.' WHEN 3 THEN user_id || '.' || event_id || '.1' ELSE '7.' || (event_id + 1) END AS ref FROM events), p AS (SELECT *, regexp_matches(ref, '^[1-9][0-9]{0,8}\\.[1-9][0-9]{0,8}$') AS ok FROM r) SELECT event_id, CASE WHEN ok THEN CAST(split_part(ref, '.', 1) AS INT) END AS page, CASE WHEN ok THEN CAST(split_part(ref, '.', 2) AS INT) END AS ord FROM p")
def reference_parts(spark, sf_dir):
    prepare(spark)
    k, u, i = F.col("event_id") % 5, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    dot = F.lit(".")
    ref = F.when(k == 0, F.concat(u, dot, i)).when(k == 1, F.concat(F.lit("0"), u, F.lit(".1"))).when(k == 2, F.concat(u, dot)).when(k == 3, F.concat(u, dot, i, F.lit(".1"))).otherwise(F.concat(F.lit("7."), (F.col("event_id") + 1).cast("string")))
    parts = X.ref_parts(ref)
    return table(spark, sf_dir, "events").select("event_id", parts["page"].alias("page"), parts["ord"].alias("ord"))


_REPLIES = f"WITH {SQL_BLOCKS}, lines AS (SELECT parse_id AS reply_id, trim(unnest(string_split(text, chr(10)))) AS line FROM blocks), c AS (SELECT reply_id, line, count(*) AS n FROM lines WHERE strlen(line) >= 8 GROUP BY 1, 2), s AS (SELECT reply_id, CAST(sum(n) AS BIGINT) AS lines, max(n) AS top FROM c GROUP BY 1), r AS (SELECT DISTINCT parse_id + 2 AS reply_id FROM blocks)"


@ENTRIES.add(_REPLIES + ", b AS (SELECT DISTINCT parse_id AS reply_id, true AS held FROM blocks) SELECT reply_id, coalesce(lines, 0) AS lines, coalesce(top, 0) AS top, CASE WHEN held IS NULL THEN CASE WHEN reply_id % 2 = 0 THEN 'fine' ELSE 'invalid' END WHEN reply_id % 3 > 0 AND coalesce(lines, 0) >= 20 AND coalesce(top, 0) > 0.5 * coalesce(lines, 0) THEN 'invalid' ELSE 'fine' END AS answer FROM r LEFT JOIN b USING (reply_id) LEFT JOIN s USING (reply_id)")
def reply_loop_check(spark, sf_dir):
    b = blocks(spark, sf_dir).select(F.col("parse_id").alias("reply_id"), "text")
    replies = b.select((F.col("reply_id") + 2).alias("reply_id")).distinct().select("reply_id", (F.col("reply_id") % 3 > 0).alias("truncated"), (F.col("reply_id") % 2 == 0).alias("blank"))
    return N.reply_check(b, replies)


@ENTRIES.add(f"""WITH {SQL_BLOCKS}, x AS (SELECT parse_id, page, state, CASE WHEN ord % 9 = 0 THEN ord + 100 ELSE ord END AS ord, page || '.' || ord AS ref, kind, CASE WHEN ord % 7 = 0 THEN 9 ELSE level END AS level FROM blocks),
  d AS (SELECT *, row_number() OVER (PARTITION BY parse_id, page ORDER BY ord) AS rn FROM x)
  SELECT parse_id, page, ord, fault FROM (SELECT *, CASE WHEN state <> 'succeeded' THEN 'blocks_without_success' WHEN rn <> ord THEN 'order' WHEN ref <> page || '.' || ord THEN 'ref' WHEN level NOT BETWEEN 0 AND 6 THEN 'level' END AS fault FROM d) WHERE fault IS NOT NULL""")
def page_validation(spark, sf_dir):
    b = blocks(spark, sf_dir)
    o = F.col("ord")
    return N.page_faults(b.withColumn("level", F.when(o % 7 == 0, 9).otherwise(F.col("level"))).withColumn("ord", F.when(o % 9 == 0, o + 100).otherwise(o)))


@ENTRIES.add(r"""WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS w FROM documents), v AS (SELECT doc_id, w, length(w) AS n, length(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) AS letters, regexp_replace(w, '^\P{L}+|\P{L}+$', '', 'g') AS bare FROM w WHERE w <> ''),
  s AS (SELECT doc_id, count(*) AS words, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(letters) AS BIGINT) AS letters, count(*) FILTER (regexp_matches(bare, '^[A-Za-z]{4,}$') AND regexp_matches(bare, '[a-z]')) AS plain, count(*) FILTER (regexp_matches(bare, '^[A-Za-z]{4,}$') AND regexp_matches(bare, '[a-z]') AND NOT regexp_matches(bare, '[aeiouyAEIOUY]')) AS vowelless FROM v GROUP BY 1)
  SELECT doc_id, words, chars, letters, plain, vowelless, CASE WHEN letters < 0.5 * chars THEN 'not_letters' WHEN plain >= 20 AND vowelless > 0.15 * plain THEN 'not_words' ELSE 'usable' END AS answer FROM s""")
def text_usable_gate(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents")
    return E.usable_texts(d, "doc_id", "text").select("doc_id", "words", "chars", "letters", "plain", "vowelless", "answer")


@ENTRIES.add()
def layout_blocks(spark, sf_dir):
    return E.page_blocks(E.words_of_documents(table(prepare(spark), sf_dir, "documents")))


@ENTRIES.add("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'budget' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'retryable' WHEN 3 THEN 'permanent' WHEN 4 THEN 'misconfigured' WHEN 5 THEN 'retryable' WHEN 6 THEN 'budget' ELSE 'misconfigured' END AS class FROM events""")
def error_classes(spark, sf_dir):
    from docspark.operators.capacity import error_class

    prepare(spark)
    status = F.element_at(F.array(*[F.lit(x) for x in (402, 429, 503, 413, 400, 408, 429, 404)]), (F.col("event_id") % 8).cast("int") + 1)
    body = F.when(F.col("event_id") % 8 == 6, "Insufficient_Quota").otherwise("error")
    return table(spark, sf_dir, "events").select("event_id", error_class(status, body).alias("class"))


_STRETCHES = "s AS (SELECT user_id, event_id AS lo, event_id + 20 + user_id % 60 AS hi FROM events), b AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), i AS (SELECT *, sum((m IS NULL OR lo > m)::INT) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM b), j AS (SELECT user_id, k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY 1, 2)"


def _stretches(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 20 + F.col("user_id") % 60).alias("hi"))


@ENTRIES.add(f"WITH {_STRETCHES} SELECT user_id, lo, hi FROM j")
def interval_join(spark, sf_dir):
    return G.joined_intervals(_stretches(spark, sf_dir), ["user_id"])


@ENTRIES.add(f"WITH {_STRETCHES}, g AS (SELECT user_id, hi AS lo, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) AS hi FROM j) SELECT * FROM g WHERE hi IS NOT NULL")
def interval_gaps(spark, sf_dir):
    return G.gaps(_stretches(spark, sf_dir), ["user_id"])


@ENTRIES.add(f"WITH {_STRETCHES} SELECT user_id, CAST(sum(hi - lo) AS BIGINT) AS covered FROM j GROUP BY 1")
def interval_cover(spark, sf_dir):
    return G.covered(_stretches(spark, sf_dir), ["user_id"])


@ENTRIES.add("SELECT l.event_id, l.user_id, CAST(p.p_partkey AS BIGINT) AS cell FROM events l JOIN part p ON l.user_id % 25 = p.p_size AND floor(l.value) >= p.p_retailprice - 900 AND floor(l.value) < p.p_retailprice - 880")
def words_in_cells(spark, sf_dir):
    prepare(spark)
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    v = F.floor("value").cast("double")
    words = e.select("event_id", "user_id", (F.col("user_id") % 25).alias("page"), v.alias("x0"), v.alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))
    cells = p.select(F.col("p_size").cast("long").alias("page"), F.col("p_partkey").alias("cell"), (F.col("p_retailprice") - 900).alias("cx0"), (F.col("p_retailprice") - 880).alias("cx1"), F.lit(-1.0).alias("cy0"), F.lit(1.0).alias("cy1"))
    return E.words_in_cells(words, cells).where("cell is not null").select("event_id", "user_id", "cell")


@ENTRIES.add("""SELECT doc_id, '[{"t":"' || doc_id || '"},{"t":"]"}]' AS whole FROM documents""")
def truncated_replies(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents")
    reply = F.concat(F.lit('[{"t":"'), F.col("doc_id").cast("string"), F.lit('"},{"t":"]"},{"t":"cut of'))
    return d.select("doc_id", N.completed(reply).alias("whole"))


@ENTRIES.add(r"""SELECT event_id, '{"t":"' || chr(92) || chr(92) || 'alpha ' || chr(92) || 'n ' || chr(92) || chr(92) || 'cdot ' || event_id || '"}' AS repaired FROM events""")
def latex_escapes(spark, sf_dir):
    reply = F.concat(F.lit('{"t":"\\\\alpha \\n \\cdot '), F.col("event_id").cast("string"), F.lit('"}'))
    return table(prepare(spark), sf_dir, "events").select("event_id", N.latex_repaired(reply).alias("repaired"))
