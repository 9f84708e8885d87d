"""Queries over retries, claims, queues, windows of usage, listings, sweeps, keys and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import control as C
from docspark.operators import extract as E
from docspark.operators import lifecycle as K
from docspark.operators import normalize as N
from docspark.operators import quality as Q
from docspark.operators import views as V
from docspark.operators.capacity import RECOVERY
from docspark.plans.bind import SQL_BLOCKS, SQL_PARSES, SQL_TASKS, blocks, parses, tasks
from docspark.plans.control_queries import _COUNTERS, _RETAINED, _queue_sql, retained
from docspark.plans.entry import Entries
from docspark.session import prepare, table

ENTRIES = Entries()


# --- retries, claims, queues -----------------------------------------------------------------------------------------


@ENTRIES.add(f"""WITH {SQL_PARSES}, {_RETAINED}, {SQL_TASKS}, {_COUNTERS}, o AS (SELECT group_id, count(*) AS n FROM parses WHERE state IN ('queued', 'running') GROUP BY 1),
  f AS (SELECT p.*, CASE WHEN parse_id % 6 > 0 THEN 'index' END AS index_key, coalesce(pages_open, 0) AS pages_open, coalesce(pages_failed, 0) AS failed, coalesce(pages_total, 0) AS total, coalesce(pages_failed, 0) AS pf, coalesce(pages_total, 0) + (parse_id % 14 = 1)::INT AS pt,
    CASE WHEN group_id % 3 > 0 THEN 300 + group_id * 5 ELSE 0 END AS max_queued, CASE WHEN group_id % 2 = 0 THEN 12 END AS per_day, group_id % 12 AS taken FROM retained p LEFT JOIN counters USING (parse_id)),
  a AS (SELECT parse_id, owner + (parse_id % 20 = 0)::INT AS asker FROM parses)
  SELECT asker AS owner, a.parse_id, CASE WHEN f.parse_id IS NULL THEN 'missing' WHEN state IN ('queued', 'running') THEN 'not_terminal' WHEN pages_open > 0 THEN 'busy' WHEN finished_day + retention <= 19400 THEN 'expired' WHEN index_key IS NULL THEN 'unassembled'
    WHEN pf = 0 THEN 'nothing' WHEN total <> pt THEN 'gone' WHEN max_queued > 0 AND coalesce(n, 0) >= max_queued THEN 'queue_full' WHEN coalesce(per_day, 0) > 0 AND taken + failed > per_day THEN 'budget_exhausted' ELSE 'retried' END AS answer
  FROM a LEFT JOIN f ON f.parse_id = a.parse_id AND f.owner = a.asker LEFT JOIN o USING (group_id)""")
def retry_answers(spark, sf_dir):
    own, work = retained(spark, sf_dir), tasks(spark, sf_dir)
    counters = C.settle_counters(work).select("parse_id", "pages_failed", "pages_total")
    zero = lambda c: F.coalesce(c, F.lit(0))
    facts = own.join(counters, "parse_id", "left").select(
        "parse_id", "owner", "group_id", "state", F.when(F.col("parse_id") % 6 > 0, "index").alias("index_key"), (F.col("finished_day") + F.col("retention")).alias("expires"),
        zero("pages_failed").alias("pages_failed"), (zero("pages_total") + (F.col("parse_id") % 14 == 1).cast("int")).alias("pages_total"),
    )
    g = F.col("group_id")
    known = own.select("group_id").distinct()
    groups = known.select("group_id", F.when(g % 3 > 0, 300 + g * 5).otherwise(0).alias("max_queued"), F.when(g % 2 == 0, 12).alias("pages_per_day"))
    asked = own.select((F.col("owner") + (F.col("parse_id") % 20 == 0).cast("int")).alias("owner"), "parse_id")
    return C.retry_answers(asked, facts, work, groups, known.select("group_id", (g % 12).alias("pages")), 19400)


_TOLD = "'{\"owner\":' || owner"


@ENTRIES.add(f"""WITH {SQL_PARSES} SELECT parse_id, {_TOLD} || CASE parse_id % 5 WHEN 0 THEN ',"file":{{"key":"f/' || file_id || '","name":"' || label || '"}}' || CASE WHEN priority > 2 THEN ',"pages":"1-' || priority || '"' ELSE '' END
    WHEN 1 THEN CASE WHEN class = 0 THEN ',"languages":["de","en"]' ELSE '' END || ',"manifest":"m' || parse_id || '"' || CASE WHEN priority = 1 THEN ',"reuse":"r' || file_id || '"' ELSE '' END
    WHEN 2 THEN ',"manifest":"m' || parse_id || '"' WHEN 3 THEN ',"manifest":"m' || parse_id || '"' || CASE WHEN priority = 5 THEN '' ELSE ',"index":"i' || parse_id || '"' END || ',"request":"q' || label || '"'
    ELSE CASE WHEN class = 0 THEN ',"languages":["de","en"]' ELSE '' END || ',"figure":{{"page":"p' || parse_id || '"' || CASE WHEN class = 1 THEN ',"reuse":"d' || file_id || '"' ELSE '' END || '}}' END || '}}' AS context FROM parses""")
def claim_told(spark, sf_dir):
    """Claims of every kind, each told what its kind is told."""
    p = parses(spark, sf_dir)
    word = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("prepare", "page", "assemble", "extract", "figure")]), (F.col("parse_id") % 5).cast("int") + 1)
    claims = p.select(
        "parse_id", kind.alias("kind"), "owner", F.struct(word("f/", "file_id").alias("key"), F.col("label").alias("name")).alias("file"), F.when(F.col("priority") > 2, word("1-", "priority")).alias("pages"),
        F.when(F.col("class") == 0, F.array(F.lit("de"), F.lit("en"))).alias("languages"), word("m", "parse_id").alias("manifest"), F.when(F.col("priority") == 1, word("r", "file_id")).alias("reuse"),
        F.when(F.col("priority") != 5, word("i", "parse_id")).alias("index"), word("q", "label").alias("request"), F.lit(None).cast("string").alias("progress"),
        F.struct(word("p", "parse_id").alias("page"), F.when(F.col("class") == 1, word("d", "file_id")).alias("reuse")).alias("figure"),
    )
    return C.claim_told(claims).select("parse_id", "context")


@ENTRIES.add(f"SELECT v.*, CASE WHEN group_id % 4 > 0 THEN CAST(group_id % 4 AS INT) ELSE 1 END AS weight, CASE WHEN group_id % 4 > 0 THEN CAST(group_id * 2 AS BIGINT) END AS max_running FROM ({_queue_sql('group_id')}) v")
def queue_view_bounds(spark, sf_dir):
    p = parses(spark, sf_dir)
    g = F.col("group_id")
    bounds = p.select("group_id").distinct().where(g % 4 > 0).select("group_id", (g % 4).cast("int").alias("weight"), (g * 2).alias("max_running"))
    return C.queue_bounds(C.queue_groups(p, tasks(spark, sf_dir), ["group_id"]), bounds, ["group_id"])


@ENTRIES.add(f"""WITH {SQL_TASKS}, s AS (SELECT s_suppkey AS reader_id, s_suppkey % 16 + 1 AS most, unnest(['', 'g1', 'g2']) AS scope, unnest([1, 3, 20]) AS k FROM supplier), f AS (SELECT reader_id, ['', 'g1', 'g2', 'g3'][page % 4 + 1] AS scope, count(*) AS n FROM tasks WHERE state = 'leased' AND page % 4 = 1 GROUP BY 1, 2)
  SELECT reader_id, scope, CAST(least(most, greatest(1, k % most) + greatest(0, (600 - reader_id * k) // {RECOVERY}) * greatest(most // 10, 1)) AS BIGINT) AS ceiling, CASE WHEN 500 + reader_id * k > 600 THEN CAST(500 + reader_id * k AS BIGINT) END AS paused_until, coalesce(n, 0) AS in_flight FROM s LEFT JOIN f USING (reader_id, scope) WHERE scope IN ('', 'g1')""")
def queue_view_scopes(spark, sf_dir):
    """Scopes of one group and the shared one, with that group's calls."""
    s = table(prepare(spark), sf_dir, "supplier").select(F.col("s_suppkey").alias("reader_id"), (F.col("s_suppkey") % 16 + 1).alias("max_in_flight"))
    each = F.array(*[F.struct(F.lit(n).alias("scope"), F.lit(k).alias("k")) for n, k in (("", 1), ("g1", 3), ("g2", 20))])
    scopes = s.select("reader_id", "max_in_flight", F.inline(each))
    k, most = F.col("k"), F.col("max_in_flight")
    scopes = scopes.select("reader_id", "scope", F.greatest(F.lit(1), k % most).alias("ceiling"), (F.col("reader_id") * k).alias("raised_at"), (500 + F.col("reader_id") * k).alias("paused_until"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("", "g1", "g2", "g3")]), (F.col("page") % 4).cast("int") + 1)
    calls = tasks(spark, sf_dir).where("state = 'leased'").select("reader_id", name.alias("scope"), name.alias("group_id"))
    return C.queue_scopes(s, scopes, calls, 600, ["g1"])


@ENTRIES.add("""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id * 1000 END AS since, CASE WHEN event_id % 2 = 0 THEN user_id * 1000 + event_id * 50 END AS until, event_id % 5 < 3 AS hourly FROM events),
  b AS (SELECT event_id, hourly, coalesce(until, 50000000) AS z, coalesce(since, coalesce(until, 50000000) - CASE WHEN hourly THEN 86400 ELSE 2592000 END) AS a, CASE WHEN hourly THEN 3600.0 ELSE 86400.0 END AS step FROM a)
  SELECT event_id, CAST(floor(a / step) * step AS BIGINT) AS since, CAST(ceil(z / step) * step AS BIGINT) AS until, CASE WHEN ceil(z / step) <= floor(a / step) OR ceil(z / step) - floor(a / step) > 1000 THEN 'invalid_request' END AS code FROM b""")
def usage_windows(spark, sf_dir):
    """Usage reads of which some leave out where they begin or end."""
    e = table(prepare(spark), sf_dir, "events")
    since, until = F.when(F.col("event_id") % 3 > 0, F.col("user_id") * 1000), F.when(F.col("event_id") % 2 == 0, F.col("user_id") * 1000 + F.col("event_id") * 50)
    now = F.lit(50_000_000).cast("long")
    span = F.when(F.col("event_id") % 5 < 3, C.usage_window(since, until, now, True)).otherwise(C.usage_window(since, until, now, False))
    return e.select("event_id", span.alias("s")).select("event_id", "s.since", "s.until", "s.code")


@ENTRIES.add(f"WITH {SQL_PARSES} SELECT parse_id, owner FROM parses WHERE label = 'MACHINERY' AND priority = 2 ORDER BY parse_id DESC LIMIT 31")
def parses_listing_origin(spark, sf_dir):
    origin = F.to_json(F.struct(F.struct(F.col("label").alias("name")).alias("source"), F.col("priority").alias("level")))
    return C.listing(parses(spark, sf_dir).withColumn("origin", origin), 30, origin={"source.name": "MACHINERY", "level": "2"}).select("parse_id", "owner")


@ENTRIES.add(f"WITH {SQL_TASKS} SELECT parse_id, count(*) FILTER (state = 'succeeded' AND task_key % 3 = 0) AS pages_reused, count(*) AS pages_total FROM tasks GROUP BY 1")
def settle_reused(spark, sf_dir):
    own = tasks(spark, sf_dir).withColumn("reused", F.when(F.col("task_key") % 3 == 0, True))
    return C.settle_counters(own).select("parse_id", "pages_reused", "pages_total")


# --- sweeps ----------------------------------------------------------------------------------------------------------


@ENTRIES.add(f"WITH {SQL_PARSES}, {SQL_TASKS} SELECT parse_id, task_key, t.state AS before FROM tasks t JOIN parses p USING (parse_id) WHERE t.state IN ('queued', 'leased') AND p.state IN ('queued', 'running') AND created_day + 5 + owner % 20 <= 19000")
def deadline_cascade(spark, sf_dir):
    return K.overdue_cascade(parses(spark, sf_dir).withColumn("deadline", F.col("created_day") + 5 + F.col("owner") % 20), tasks(spark, sf_dir), 19000)


@ENTRIES.add(f"""WITH {SQL_PARSES}, f AS (SELECT parse_id, n.name, CASE WHEN state IN ('queued', 'running') THEN 'pending' ELSE state END AS state, created_day + 3 + parse_id % 40 AS deadline, label, tokens FROM parses, (VALUES ('total'), ('date')) n(name))
  SELECT parse_id, name, 'failed' AS state, 'deadline_exceeded' AS code, CASE WHEN name = 'total' THEN parse_id % 4 ELSE 0 END AS calls, CASE WHEN name = 'total' THEN tokens ELSE 0 END AS input_tokens, CASE WHEN name = 'total' THEN tokens // 10 ELSE 0 END AS output_tokens FROM f WHERE state = 'pending' AND deadline <= 19000""")
def deadline_fields(spark, sf_dir):
    p = parses(spark, sf_dir)
    open_ = F.col("state").isin("queued", "running")
    fields = p.select("parse_id", F.explode(F.array(F.lit("total"), F.lit("date"))).alias("name"), F.when(open_, "pending").otherwise(F.col("state")).alias("state"), (F.col("created_day") + 3 + F.col("parse_id") % 40).alias("deadline"))
    work = p.select("parse_id", F.lit("total").alias("name"), (F.col("parse_id") % 4).alias("calls"), F.col("tokens").alias("input_tokens"), F.floor(F.col("tokens") / 10).alias("output_tokens"))
    return K.overdue_fields(fields, work, 19000)


@ENTRIES.add(f"""WITH {SQL_PARSES}, {SQL_TASKS}, l AS (SELECT parse_id, count(*) AS lost FROM tasks WHERE state = 'queued' GROUP BY 1)
  SELECT parse_id, coalesce(lost, 0) AS lost, parse_id % 3 + coalesce(lost, 0) AS failed, CASE WHEN parse_id % 4 > 0 THEN 'succeeded' ELSE 'failed' END AS state FROM parses LEFT JOIN l USING (parse_id) WHERE state = 'running' AND created_day + parse_id % 50 <= 19000""")
def deadline_figures(spark, sf_dir):
    p = parses(spark, sf_dir)
    runs = p.select("parse_id", "state", (F.col("created_day") + F.col("parse_id") % 50).alias("deadline"), (F.col("parse_id") % 3).alias("failed"), (F.col("parse_id") % 4).alias("done"))
    figures = tasks(spark, sf_dir).select("parse_id", F.when(F.col("state") == "queued", "pending").otherwise("succeeded").alias("state"))
    return K.overdue_figures(runs, figures, 19000)


# --- keys, figures, steps, repairs -----------------------------------------------------------------------------------


@ENTRIES.add("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN '' ELSE sha256(sha256(text) || chr(0) || (doc_id % 10 + 1) || chr(0) || lang || chr(0) || 'layout=3' || chr(0) || 'vision=' || (doc_id % 4 + 1)) END AS read_key FROM documents")
def page_read_key(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents")
    i = F.col("doc_id")
    content = F.when(i % 7 != 0, F.sha2(F.col("text").cast("binary"), 256))
    versions = F.array(F.lit("layout=3"), F.concat(F.lit("vision="), F.when(i % 5 == 0, "").otherwise((i % 4 + 1).cast("string"))))
    return d.select("doc_id", V.read_key(content, i % 10 + 1, F.col("lang"), versions).alias("read_key"))


@ENTRIES.add(f"WITH {SQL_BLOCKS} SELECT parse_id, ref FROM blocks WHERE kind = 'list_item' AND y0 IS NOT NULL AND state = 'succeeded' AND ord % 3 > 0")
def figures_to_describe(spark, sf_dir):
    """Figures without a description; those that have one are left out."""
    b = blocks(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "list_item", "figure").otherwise(F.col("kind")))
    return V.figures(b.withColumn("description", F.when(F.col("ord") % 3 == 0, F.col("ref"))), limit=1 << 30, redo=False).select("parse_id", "ref")


@ENTRIES.add("""SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 0 THEN 'filled' WHEN l_suppkey % 3 > 0 AND l_partkey % 4 >= 2 THEN 'unsatisfied' WHEN l_suppkey % 3 > 0 THEN 'repair' WHEN l_quantity % 4 < l_linenumber % 4 THEN 'next' ELSE 'filled' END AS step FROM lineitem""")
def extraction_step_cases(spark, sf_dir):
    li = table(prepare(spark), sf_dir, "lineitem")
    facts = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 3).alias("findings"), (F.col("l_partkey") % 4).alias("repairs"), (F.col("l_quantity") % 4).alias("window"), (F.col("l_linenumber") % 4).alias("windows"))
    return facts.select("id", "n", E.next_step().alias("step"))


_COMMAND = "['frac', 'theta', 'tag', 'nu', 'num', 'beta', 'bet', 'alpha', 'u00e9', 'upsilon', 'rho', 'right', 'rig', 'newline', 'fbox']"


@ENTRIES.add(f"""WITH e AS (SELECT event_id, {_COMMAND}[event_id % 15 + 1] AS a, {_COMMAND}[user_id % 15 + 1] AS b FROM events), m AS (SELECT event_id, a, b, a IN ('frac', 'theta', 'nu', 'beta', 'alpha', 'upsilon', 'rho', 'right', 'newline') AS da, b IN ('frac', 'theta', 'nu', 'beta', 'alpha', 'upsilon', 'rho', 'right', 'newline') AS db FROM e)
  SELECT event_id, '{{"t": "' || CASE WHEN da THEN chr(92) ELSE '' END || chr(92) || a || '{{' || event_id || '}} ' || chr(92) || chr(92) || b || ' ' || CASE WHEN db THEN chr(92) ELSE '' END || chr(92) || b || '"}}' AS repaired FROM m""")
def latex_commands(spark, sf_dir):
    """Commands that begin as a JSON escape does, words that only begin like one, and commands that are escaped already."""
    words = F.array(*[F.lit(w) for w in ("frac", "theta", "tag", "nu", "num", "beta", "bet", "alpha", "u00e9", "upsilon", "rho", "right", "rig", "newline", "fbox")])
    a, b = (F.element_at(words, (F.col(c) % 15).cast("int") + 1) for c in ("event_id", "user_id"))
    reply = F.concat(F.lit('{"t": "\\'), a, F.lit("{"), F.col("event_id").cast("string"), F.lit("} \\\\"), b, F.lit(" \\"), b, F.lit('"}'))
    return table(prepare(spark), sf_dir, "events").select("event_id", N.latex_repaired(reply).alias("repaired"))


@ENTRIES.add("""WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS ord, min(l_partkey) AS a, min(l_suppkey) AS b FROM lineitem GROUP BY 1, 2) SELECT doc, string_agg(CASE WHEN ord % 2 = 0 THEN a || ' ' || b ELSE a || ' | ' || b END, ' ' ORDER BY ord) AS words FROM t GROUP BY 1""")
def transcribed_tables(spark, sf_dir):
    """Tables by their cells, and other blocks by their text."""
    li = table(prepare(spark), sf_dir, "lineitem")
    t = li.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").cast("string").alias("a"), F.min("l_suppkey").cast("string").alias("b"))
    cell = lambda c, text: F.struct(F.lit(0).alias("row"), F.lit(c).alias("col"), text.alias("text"))
    rows = t.select("doc", "ord", F.when(F.col("ord") % 2 == 0, "table").otherwise("text").alias("kind"), F.concat("a", F.lit(" | "), "b").alias("text"), F.when(F.col("ord") % 2 == 0, F.array(cell(1, F.col("b")), cell(0, F.col("a")))).alias("cells"))
    return Q.transcription(rows, ["doc"])


# --- tables and replies of many shapes -------------------------------------------------------------------------------

_SHAPES = "s AS (SELECT doc_id, CAST(doc_id % 4 + 1 AS INT) AS r, CAST(doc_id // 4 % 3 + 1 AS INT) AS c, source, lang, n_chars FROM documents), g AS (SELECT *, x.range AS i, y.range AS j, lang || ' & ' || (n_chars + 10 * x.range + y.range) AS cell FROM s, range(4) x, range(3) y WHERE x.range < r AND y.range < c)"


def _shapes(spark, sf_dir):
    """Documents with a table of their own: up to four rows of up to three cells, made of the columns."""
    d = table(prepare(spark), sf_dir, "documents")
    i = F.col("doc_id")
    return d.select("doc_id", "source", "lang", "n_chars", (i % 4 + 1).cast("int").alias("r"), (F.floor(i / 4) % 3 + 1).cast("int").alias("c"))


def _cells(show, between_cells: str, between_rows: str):
    row = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda y: show(x, y)), between_cells)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.col("r") - 1), row), between_rows)


def _cell_text(x, y):
    return F.concat(F.col("lang"), F.lit(" & "), (F.col("n_chars") + 10 * x + y).cast("string"))


@ENTRIES.add(f"WITH {_SHAPES}, t AS (SELECT doc_id, r, c, i, string_agg(cell, ' | ' ORDER BY j) AS line FROM g GROUP BY ALL) SELECT doc_id, r + 1 AS \"rows\", c AS cols, any_value(source) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM t JOIN documents USING (doc_id) GROUP BY doc_id, r, c")
def html_table_shapes(spark, sf_dir):
    """Markup of tables of many shapes, under a cell that spans all columns, with marks, comments and entities in the cells."""
    from docspark.sources.html import table_from_html

    cell = lambda x, y: F.concat(F.lit("<td>"), F.regexp_replace(_cell_text(x, y), "&", "<b>&amp;</b>"), F.when(y == 0, "</td>").otherwise(""))
    rows = F.concat_ws("</tr><tr>", *[F.when(F.col("r") > x, F.concat_ws("", *[F.when(F.col("c") > y, cell(F.lit(x), F.lit(y))) for y in range(3)])) for x in range(4)])
    markup = F.concat(F.lit("<p>before<table><tr><th colspan="), F.col("c").cast("string"), F.lit(">"), F.col("source"), F.lit("</th></tr><tr>"), rows, F.lit("</tr></table>"))
    t = table_from_html(markup)
    return _shapes(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", "t.rows", "t.cols", V.table_text(F.col("t.cells")).alias("text"))


@ENTRIES.add(f"WITH {_SHAPES} SELECT doc_id, CAST(i AS INT) AS row, CAST(j AS INT) AS col, CASE WHEN j % 2 = 0 THEN cell ELSE 'say \"' || cell || '\", ' || chr(10) || i END AS text FROM g")
def delimited_shapes(spark, sf_dir):
    """Delimited text with quoted fields that hold quotes, commas and line ends, and empty lines between the rows."""
    from docspark.sources import texts as T

    quoted = lambda x, y: F.concat(F.lit('"say ""'), _cell_text(x, y), F.lit('"", \n'), x.cast("string"), F.lit('"'))
    cell = lambda x, y: F.when(y % 2 == 0, _cell_text(x, y)).otherwise(quoted(x, y))
    rows = _shapes(spark, sf_dir).select("doc_id", _cells(cell, ",", "\r\n\r\n").alias("csv"))
    return T.cells(T.delimited(rows, "doc_id", "csv"), "doc_id").select("doc_id", "row", "col", "text")


@ENTRIES.add(f"""WITH {_SHAPES}, h AS (SELECT doc_id, i, string_agg(CASE WHEN i = 0 THEN '<th>' ELSE '<td>' END || replace(cell, '&', '&amp;') || CASE WHEN i = 0 THEN '</th>' ELSE '</td>' END, '' ORDER BY j) AS line, string_agg(cell, ' | ' ORDER BY j) AS plain, repeat(' --- |', any_value(c)) AS rule FROM g GROUP BY 1, 2)
  SELECT doc_id, '<table>' || string_agg('<tr>' || line || '</tr>', '' ORDER BY i) || '</table>' AS html, string_agg(plain, chr(10) ORDER BY i) AS text, string_agg('| ' || plain || ' |' || CASE WHEN i = 0 THEN chr(10) || '|' || rule ELSE '' END, chr(10) ORDER BY i) AS markdown FROM h GROUP BY 1""")
def table_shapes(spark, sf_dir):
    one = lambda x, y: F.struct(x.cast("int").alias("row"), y.cast("int").alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), (x == 0).alias("header"), _cell_text(x, y).alias("text"))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda x: F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda y: one(x, y))))
    whole = F.struct(F.col("r").alias("rows"), F.col("c").alias("cols"), cells.alias("cells"))
    t = _shapes(spark, sf_dir).select("doc_id", whole.alias("table"))
    return t.select("doc_id", V.table_html(F.col("table.cells")).alias("html"), V.table_text(F.col("table.cells")).alias("text"), V.table_markdown(F.col("table")).alias("markdown"))


@ENTRIES.add(f"WITH {_SHAPES} SELECT doc_id, CASE WHEN r > 1 THEN '[' || array_to_string(list_transform(range(r - 1), lambda k: '{{\"t\":\"]}} \\\" ' || lang || (n_chars + k) || '\",\"l\":[' || k || ']}}'), ',') || ']' END AS whole FROM s")
def truncated_lists(spark, sf_dir):
    """Replies of one to four elements, cut inside the last; brackets and quotes stand in their strings."""
    item = lambda k: F.concat(F.lit('{"t":"]} \\" '), F.col("lang"), (F.col("n_chars") + k).cast("string"), F.lit('","l":['), k.cast("string"), F.lit("]}"))
    rows = _shapes(spark, sf_dir)
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.col("r") - 1), item), ",")
    cut = F.concat(F.lit("["), F.substring(whole, F.lit(1), F.length(whole) - 1 - (F.col("doc_id") % 5).cast("int")))
    return rows.select("doc_id", N.completed(cut).alias("whole"))
