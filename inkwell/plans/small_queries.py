"""Queries for single parsers, predicates, joins and functions; see ``queries`` for the workloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import gate, ledger, lint, scan, search
from . import derived
from .derived import LEDGER_FACTS
from .queries import _FOUND, _LAST_S, _N_LINES, _RULES, QUERY, TERMS, _changes, events, index, pages, query, read


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def parsed(spark, sf_dir):
    return derived.corpus(spark, sf_dir).pages


def six(column: str = "doc_id"):
    """A column's value modulo six, to choose one of a few strings."""
    return lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(column) % len(xs) + 1).cast("int"))


def pick(*xs: str, column: str = "doc_id") -> str:
    return f"list_value({', '.join(repr(x) for x in xs)})[CAST({column} % {len(xs)} AS INTEGER) + 1]"


# ---- sources ----


@query(pages("SELECT path FROM page_facts"))
def sc01_content_pages(spark, sf_dir):
    from ..sources.files import content_pages

    files = derived.file_paths(spark, sf_dir).withColumn("content", F.lit("x").cast("binary"))
    return content_pages(files).select("path")


@query("SELECT unnest(['INDEX.md', 'INDEX-sources.md', 'INDEX-entities.md', 'INDEX-concepts.md', 'INDEX-synthesis.md']) AS path")
def sc02_index_documents(spark, sf_dir):
    from ..sources.files import index_documents

    files = derived.file_paths(spark, sf_dir).withColumn("content", F.lit("x").cast("binary"))
    return index_documents(files).select("path")


@query(pages("SELECT path FROM page_facts UNION ALL SELECT concat('raw/doc-', CAST(h AS STRING), '.md') FROM page_facts WHERE h % 5 <> 0 UNION ALL SELECT unnest(['LOG.md', 'INDEX.md', 'INDEX-sources.md', 'INDEX-entities.md', 'INDEX-concepts.md', 'INDEX-synthesis.md', '_templates/page.md', '.hidden', 'raw/inbox/.keep', 'raw/inbox/new.txt'])"))
def sc03_target_documents(spark, sf_dir):
    return derived.file_paths(spark, sf_dir)


@query(pages("SELECT path, replace(regexp_replace(path, '^[a-z]+/', ''), '.md', '') AS slug FROM page_facts"))
def sc04_search_pages(spark, sf_dir):
    from ..sources.files import search_pages

    files = derived.file_paths(spark, sf_dir).withColumn("content", F.lit("x").cast("binary"))
    return search_pages(files).select("path", "slug")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'skipped' WHEN 2 THEN 'error' WHEN 3 THEN 'skipped' ELSE 'read' END AS why FROM documents")
def sc06_read_status(spark, sf_dir):
    five = F.col("doc_id") % 5
    path = F.concat(F.lit("f"), F.when(five == 0, ".PNG").otherwise(".md"))
    content = F.when(five == 1, F.unhex(F.lit("6100"))).when(five == 2, F.unhex(F.lit("FFFE"))).when(five == 3, F.lit(" \n").cast("binary")).otherwise(F.lit("text").cast("binary"))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(scan.read_status(path, content), F.lit("read")).alias("why"))


@query("SELECT CAST(1 AS BIGINT) AS files")
def ag19_inbox_count(spark, sf_dir):
    from ..sources.files import inbox

    return inbox(derived.file_paths(spark, sf_dir)).agg(F.count("*").alias("files"))


@query("SELECT CAST(n AS INTEGER) AS line_no, '[' || event_type || '] ' || CAST(event_id AS VARCHAR) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE event_id % 3 = 0")
def pj22_log_entries(spark, sf_dir):
    """SC10 and PJ22: a log for each user, of which the lines that begin an entry are read."""
    from ..sources.files import log_entries

    line = F.concat(F.when(F.col("event_id") % 3 == 0, "## [").when(F.col("event_id") % 3 == 1, " ## [").otherwise("### ["), "event_type", F.lit("] "), F.col("event_id").cast("string"), F.lit("  "))
    logs = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return log_entries(logs)


# ---- parsers ----


@query(pages("SELECT path, CASE WHEN h % 23 = 3 THEN slug ELSE concat('Doc ', CAST(h AS STRING)) END AS title FROM page_facts"))
def pj04_titles(spark, sf_dir):
    title = text.unquote(lint.field("title"))
    return parsed(spark, sf_dir).select("path", F.when(title != "", title).otherwise(text.path_stem(F.col("path"))).alias("title"))


@query(pages(f"SELECT path, CAST({_N_LINES} AS INTEGER) AS lines FROM page_facts"))
def pj06_lines_outside_fences(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", F.size("seen").alias("lines"))


@query(pages("SELECT path, 'Code             stays.' AS line FROM page_facts"))
def pj07_code_blanked(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", F.explode("seen").alias("x")).where("x.line like 'Code %'").select("path", "x.line")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN 'wiki/' ELSE '' END || 'd' || CAST(doc_id AS VARCHAR) AS target FROM documents")
def pj09_link_targets(spark, sf_dir):
    d = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    before = six()("", " ./", "/", "wiki/", "././", "wiki/wiki/")
    after = six()("", "|name", "#part", ".md", ".MD#x|y", " ")
    return docs(spark, sf_dir).select("doc_id", text.link_target(F.concat(before, d, after)).alias("target"))


@query(pages("SELECT path, h % 19 = 2 AS pending FROM page_facts"))
def pj15_pending_review(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", lint.pending_review(F.col("lines")).alias("pending"))


@query(pages("SELECT path, slug AS stem, regexp_replace(path, '/[^/]*$', '') AS folder FROM page_facts"))
def pj17_path_parts(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", text.path_stem(F.col("path")).alias("stem"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN CAST(n_chars + 1 AS VARCHAR) || ' tests passed' ELSE CAST(greatest(n_chars + 1 - f - e, 0) AS VARCHAR) || '/' || CAST(n_chars + 1 AS VARCHAR) || ' tests passed (' || f || ' failed, ' || e || ' errors)' END AS said FROM (SELECT *, doc_id % 11 + CASE WHEN n_chars % 3 = 1 THEN 1 ELSE 0 END AS f, CASE WHEN n_chars % 3 = 1 THEN 0 ELSE doc_id % 7 + 1 END AS e FROM documents)")
def pj21_test_summary(spark, sf_dir):
    kind, n = F.col("n_chars") % 3, lambda c: c.cast("string")
    failures, errors = F.concat(F.lit("failures="), n(F.col("doc_id") % 11 + F.when(kind == 1, 1).otherwise(0))), F.concat(F.lit("errors="), n(F.col("doc_id") % 7 + 1))
    end = F.when(kind == 0, "OK").when(kind == 1, F.concat(F.lit("FAILED ("), failures, F.lit(")"))).otherwise(F.concat(F.lit("FAILED ("), failures, F.lit(", "), errors, F.lit(")")))
    said = F.concat(F.lit("....\nRan "), n(F.col("n_chars") + 1), F.lit(" tests in 0.1s\n\n"), end)
    return docs(spark, sf_dir).select("doc_id", gate.suite_summary(said).alias("said"))


_TEMPLATE = 'title: "<entity name>"\ncreated: <YYYY-MM-DD>\ntags: []\nreliability: medium\nsensitivity: x\nsources: []\n# <Entity name>\nreliability: medium <YYYY-MM-DD>\n[<file>](../raw/<file>) [<file>](../raw/<file>)'


@query(
    """SELECT doc_id, 'title: "Doc \\"' || lang || '\\" ' || doc_id || '"' || chr(10) || 'created: ' || d || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'tags: []' ELSE 'tags: [' || source || ', ' || lang || ']' END || chr(10) || 'reliability: ' || r || chr(10) || 'sensitivity: public' || chr(10) || s || chr(10) """
    """|| '# Doc "' || lang || '" ' || doc_id || chr(10) || 'reliability: medium ' || d || chr(10) || CASE WHEN doc_id % 4 = 1 THEN '[' || doc_id || '.md](../raw/' || doc_id || '.md) [<file>](../raw/<file>)' ELSE '[<file>](../raw/<file>) [<file>](../raw/<file>)' END AS text """
    """FROM (SELECT *, '2024-01-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') AS d, CASE WHEN n_chars % 2 = 0 THEN 'high' ELSE 'low' END AS r, CASE doc_id % 4 WHEN 0 THEN 'sources: []' WHEN 1 THEN 'sources: ["x", "raw/' || doc_id || '.md"]' ELSE 'sources: ["x"]' END AS s FROM documents)"""
)
def pj19_new_pages(spark, sf_dir):
    d = docs(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    sources = F.when(F.col("doc_id") % 4 == 0, text.no_strings()).when(F.col("doc_id") % 4 == 1, F.array(F.lit("x"), F.concat(F.lit("raw/"), i, F.lit(".md")))).otherwise(F.array(F.lit("x")))
    asked = d.select(
        "doc_id", F.lit(_TEMPLATE).alias("template"), F.lit("entity").alias("page_type"), F.concat(F.lit('Doc "'), "lang", F.lit('" '), i).alias("title"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0")).alias("day"), F.when(F.col("doc_id") % 3 != 0, F.array("source", "lang")).alias("tags"),
        F.when(F.col("n_chars") % 2 == 0, "high").otherwise("low").alias("reliability"), F.lit("public").alias("sensitivity"), sources.alias("sources"),
    )
    return gate.new_pages(asked).select("doc_id", "text")


@query("SELECT doc_id, lang AS title, CASE WHEN doc_id % 3 = 2 THEN '' ELSE text END AS body FROM documents WHERE text NOT LIKE '%---%'")
def pj02_search_pages_parsed(spark, sf_dir):
    """Headers as the search has them: the last of a key counts, and one that is not closed leaves no body."""
    third = F.col("doc_id") % 3
    head = F.concat(F.lit("---\ntitle: first\nnot a field\ntitle:  "), "lang", F.when(third == 2, F.lit("\n")).when(third == 1, F.lit(" \n --- \n")).otherwise(F.lit("\n---\n")))
    d = docs(spark, sf_dir).where(~F.col("text").contains("---")).select("doc_id", F.concat(head, "text").alias("page"))
    fields, body = search.parse_page(F.col("page"))
    return d.select("doc_id", fields["title"].alias("title"), body.alias("body"))


# ---- filters ----


@query(pages("SELECT path, page_type AS value FROM page_facts WHERE page_type = 'bogus'"))
def fl02_invalid_page_type(spark, sf_dir):
    return lint.invalid_enum(derived.corpus(spark, sf_dir)).where("field = 'page_type'").select("path", "value")


@query("SELECT event_id, event_id % 3 = 0 AS raw FROM events")
def fl19_raw_paths(spark, sf_dir):
    return gate.parse_events(events(spark, sf_dir)).select("event_id", gate.in_raw(F.col("file_path")).alias("raw"))


@query("SELECT event_id FROM events WHERE event_id % 5 <> 4")
def fl20_write_tools(spark, sf_dir):
    return gate.parse_events(events(spark, sf_dir)).where(F.col("tool_name").isin(*fixed.WRITE_TOOLS)).select("event_id")


@query("SELECT '.staging/f' || CAST(event_id AS VARCHAR) AS path FROM events WHERE event_id % 5 = 0")
def fl21_staging(spark, sf_dir):
    return gate.staged_refusals(_changes(spark, sf_dir)).where("reason = 'staging'").select("path")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0")
def fl23_needs_scan(spark, sf_dir):
    path = F.concat(six()("wiki/a/x", "wiki/_templates/x", "other/x", "wiki/README.md"), F.when(F.col("doc_id") % 4 == 3, "").otherwise(F.col("doc_id").cast("string")))
    return docs(spark, sf_dir).where(gate.needs_scan(path)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def fl25_home_paths(spark, sf_dir):
    """Lines that hold a home folder's path."""
    line = F.concat(six()("see ", "see /home/", "see /homes"), F.lit("user"), F.col("doc_id").cast("string"), F.lit("/x"))
    return docs(spark, sf_dir).where(line.rlike(r"(?:/home|/Users)/[^/\s]+/")).select("doc_id")


_HOMES = ("", "see /home/alice", "see /homes/bob", "/Users/ana/x", "/home/1", "/home//x")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text || chr(10) || {pick(*_HOMES)}, '{scan.HOME_PATH}')")
def fl25_home_paths_in_text(spark, sf_dir):
    """Texts that hold a home folder's path, with a line at their end that may."""
    return docs(spark, sf_dir).where(scan.home_path(F.concat("text", F.lit("\n"), six()(*_HOMES)))).select("doc_id")


# ---- joins, aggregates, windows ----


@query(f"WITH {LEDGER_FACTS} SELECT conv_id AS ledger_id, i FROM blocks WHERE class = 'personal'")
def jn08_reasons_of_class(spark, sf_dir):
    """Blocks whose reasons are beyond those of class 'shareable'."""
    rows = ledger.read_entries(ledger.parse(*derived.ledgers(spark, sf_dir)))
    beyond = F.size(F.array_except("reasons", F.array(*[F.lit(x) for x in ledger.CLASS_REASONS["restricted"]]))) > 0
    return rows.where(beyond & (F.col("class") != "shareable")).select("ledger_id", "i")


@query(pages("SELECT path, expected_type FROM page_facts"))
def jn09_family_types(spark, sf_dir):
    kinds = spark.createDataFrame(list(fixed.PAGE_FAMILIES.items()), "family string, expected_type string")
    return parsed(spark, sf_dir).select("path", F.split("path", "/")[0].alias("family")).join(F.broadcast(kinds), "family").select("path", "expected_type")


@query(pages("SELECT path, concat('../raw/doc-', CAST(h AS STRING), '.md') AS link FROM page_facts WHERE h % 5 = 0"))
def jn12_relative_links(spark, sf_dir):
    """Relative Markdown links that lead nowhere."""
    p = derived.facts(spark, sf_dir, "SELECT path, family, concat('../raw/doc-', CAST(h AS STRING), '.md') AS link FROM page_facts")
    p = p.withColumn("key", lint.normal_path(F.concat("family", F.lit("/"), "link")))
    return p.join(derived.file_paths(spark, sf_dir).withColumnRenamed("path", "key"), "key", "left_anti").select("path", "link")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 2")
def jn14_destinations(spark, sf_dir):
    wanted = F.split(six()("team", "team,board", "team,elsewhere"), ",")
    return docs(spark, sf_dir).where(F.size(F.array_except(wanted, F.array(F.lit("team"), F.lit("board")))) > 0).select("doc_id")


@query(f"{_FOUND} SELECT category, reason_code, count(*) AS n FROM found GROUP BY ALL")
def ag14_distinct_findings(spark, sf_dir):
    found = scan.findings(scan.scan(derived.scan_docs(spark, sf_dir))).distinct()
    return found.groupBy("category", "reason_code").agg(F.count("*").alias("n"))


@query(f"SELECT rule, count(*) AS n FROM ({_RULES}) GROUP BY rule")
def ag15_ledger_errors_by_rule(spark, sf_dir):
    return ledger.validate(*derived.ledgers(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT doc_id, doc_id % 10 = 6 AS valid FROM documents")
def ag17_luhn(spark, sf_dir):
    """FL15, FN24: a fold over digits; 411111111111111 needs check digit 1."""
    number = F.concat(F.lit("42424242424242"), F.lit("4"), (F.pmod(F.col("doc_id") + F.lit(6), F.lit(10))).cast("string"))
    return docs(spark, sf_dir).select("doc_id", F.call_function("luhn_check", number).alias("valid"))


@query(f"WITH {LEDGER_FACTS} SELECT conv_id AS ledger_id, max(real_last) + 1 AS frontier FROM blocks GROUP BY conv_id")
def wn03_frontiers(spark, sf_dir):
    rows = ledger.read_entries(ledger.parse(*derived.ledgers(spark, sf_dir)))
    return rows.groupBy("ledger_id").agg((F.max("end") + 1).alias("frontier"))


@query(f"WITH {LEDGER_FACTS} SELECT conv_id AS ledger_id, i FROM blocks WHERE conv_id % 7 = 3 AND i = 2")
def wn04_duplicate_blocks(spark, sf_dir):
    rows = ledger.read_entries(ledger.parse(*derived.ledgers(spark, sf_dir)))
    n = F.row_number().over(Window.partitionBy("ledger_id", "id").orderBy("i"))
    return rows.withColumn("n", n).where("n > 1").select("ledger_id", "i")


@query(pages("SELECT path, CASE WHEN h % 19 IN (2, 3) THEN 3 ELSE 2 END AS sections FROM page_facts"))
def wn06_sections(spark, sf_dir):
    """Headings of each page, by a running last heading over its lines."""
    lines = parsed(spark, sf_dir).select("path", F.explode("seen").alias("x")).select("path", "x.n", F.when(F.col("x.line").rlike(r"^#{1,6}\s+"), F.col("x.n")).alias("h"))
    last = F.last("h", ignorenulls=True).over(Window.partitionBy("path").orderBy("n"))
    return lines.withColumn("section", last).groupBy("path").agg(F.countDistinct("section").cast("int").alias("sections"))


@query(pages("SELECT path, CAST(head AS INTEGER) AS closing FROM page_facts"))
def wn07_closing_line(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", F.col("header_end").alias("closing"))


# ---- sorts and sets ----


@query(pages("SELECT path FROM page_facts ORDER BY path"))
def so02_pages_by_path(spark, sf_dir):
    return parsed(spark, sf_dir).select("path").orderBy("path")


@query(f"{_FOUND} SELECT path, category, reason_code, line FROM found ORDER BY category, reason_code, line, path")
def so03_findings_in_order(spark, sf_dir):
    found = scan.findings(scan.scan(derived.scan_docs(spark, sf_dir)))
    return found.orderBy("category", "reason_code", "line", "path")


@query(f"SELECT * FROM ({_RULES}) ORDER BY block_id, rule, ledger_id")
def so04_ledger_errors_in_order(spark, sf_dir):
    return ledger.validate(*derived.ledgers(spark, sf_dir)).orderBy("block_id", "rule", "ledger_id")


@query(f"{_FOUND} SELECT reason_code, path FROM (SELECT *, row_number() OVER (PARTITION BY reason_code ORDER BY path, line) AS n FROM found) WHERE n <= 10")
def so05_ten_of_each(spark, sf_dir):
    found = scan.findings(scan.scan(derived.scan_docs(spark, sf_dir)))
    return lint.occurrences_in_order(found, "reason_code", ["path", "line"], fixed.REPORTED_FINDINGS).select("reason_code", "path")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate((*fixed.ERROR_KINDS, *fixed.WARNING_KINDS))) + ") AS k(position, kind)")
def so06_kinds_in_order(spark, sf_dir):
    return spark.createDataFrame(list(enumerate((*fixed.ERROR_KINDS, *fixed.WARNING_KINDS))), "position int, kind string")


@query(pages("SELECT count(*) + 5 AS documents FROM page_facts"))
def st01_linking_documents(spark, sf_dir):
    c = derived.corpus(spark, sf_dir)
    return c.pages.select("path").union(c.indexes.select("path")).distinct().agg(F.count("*").alias("documents"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS apart FROM documents")
def st03_disjoint(spark, sf_dir):
    own = F.split(six()("a,b", "c", "d,e"), ",")
    return docs(spark, sf_dir).select("doc_id", (~F.arrays_overlap(own, F.array(F.lit("b"), F.lit("z")))).alias("apart"))


@query("SELECT doc_id, doc_id % 3 = 0 AS equal, doc_id % 3 <> 2 AS within FROM documents")
def st04_set_relations(spark, sf_dir):
    own, all_ = F.split(six()("b,a", "a", "a,c"), ","), F.array(F.lit("a"), F.lit("b"))
    less, more = F.size(F.array_except(all_, own)) == 0, F.size(F.array_except(own, all_)) == 0
    return docs(spark, sf_dir).select("doc_id", (less & more).alias("equal"), more.alias("within"))


@query(f"SELECT doc_id FROM documents WHERE {pick('keep', 'omit', 'explode')} IN ('keep', 'generalize', 'anonymize', 'aggregate', 'omit', 'placeholder')")
def st06_vocabulary(spark, sf_dir):
    return docs(spark, sf_dir).where(six()("keep", "omit", "explode").isin(*fixed.ACTIONS)).select("doc_id")


# ---- placeholders of a copy, file texts ----


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'by {{OWNER_NAME}} since {{START_DATE}}: ' || text ELSE replace(replace('by {{OWNER_NAME}} since {{START_DATE}}: ' || text, '{{OWNER_NAME}}', 'Ann O.'), '{{START_DATE}}', '2024-05-06') END AS text, doc_id % 4 <> 3 AS changed FROM documents")
def sk08_filled_marks(spark, sf_dir):
    """Marks in the files that may have them are filled, twice over as once."""
    path = six()("wiki/LOG.md", "README.md", "CUSTOMIZATIONS.md", "docs/README.md")
    files = docs(spark, sf_dir).select(F.concat_ws("|", F.col("doc_id").cast("string"), path).alias("key"), path.alias("path"), F.concat(F.lit("by {{OWNER_NAME}} since {{START_DATE}}: "), "text").alias("text"), "doc_id")
    once = files.groupBy("path").agg(F.lit(0).alias("x")).select("path")
    filled = gate.fill_marks(files.select("path", F.concat_ws("\x1f", F.col("doc_id").cast("string"), "text").alias("text")), "Ann O.", "2024-05-06")
    again = gate.fill_marks(filled.select("path", "text"), "Ann O.", "2024-05-06").where("not changed")
    return again.join(F.broadcast(once), "path", "left_semi").select(F.substring_index("text", "\x1f", 1).cast("long").alias("doc_id"), F.expr("substr(text, instr(text, '\x1f') + 1)").alias("text"), F.col("path").isin(*fixed.MARKED_FILES).alias("changed"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN '' ELSE text END AS text FROM documents")
def sc05_page_texts(spark, sf_dir):
    """Texts of files as the health report reads them: what is no UTF-8 is empty."""
    from ..sources.files import lint_text

    content = F.when(F.col("doc_id") % 5 == 2, F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return docs(spark, sf_dir).select("doc_id", lint_text(content).alias("text"))


@query(pages("SELECT CASE WHEN h % 6 IN (1, 2) THEN 'INDEX.md' ELSE 'x' END AS path, count(*) + sum(CASE WHEN h % 66 = 1 THEN 1 ELSE 0 END) AS entries FROM page_facts WHERE h % 6 IN (1, 2) GROUP BY 1"))
def sc08_index_entries_of_files(spark, sf_dir):
    """The root index read from file content, its lines counted."""
    from ..sources.files import index_documents

    files = derived.index_texts(spark, sf_dir).select("path", F.encode("text", "UTF-8").alias("content"))
    root = index_documents(files).where("path = 'INDEX.md'")
    return root.select("path", (F.size(text.split_lines(F.col("text"))) - 2).cast("long").alias("entries"))


@query("SELECT doc_id, ok FROM (SELECT doc_id, " + pick("ENTITIES.MD", "a.Md", "a.txt", "README.md", "\u00c9T\u00c9.MD") + " AS name, doc_id % 5 IN (0, 1, 4) AS ok FROM documents) WHERE ok")
def fn02_folded_names(spark, sf_dir):
    """Names are told apart without case: suffixes of pages, and the excluded ones."""
    from ..sources.files import content_pages

    name = six()("ENTITIES.MD", "a.Md", "a.txt", "ReadMe.md", "\u00c9T\u00c9.MD")
    files = docs(spark, sf_dir).select(F.concat(F.lit("entities/"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return content_pages(files).select(F.split("path", "/")[1].cast("long").alias("doc_id"), F.lit(True).alias("ok"))


@query("SELECT doc_id, lang || ' fi 1 A' || CAST(doc_id AS VARCHAR) || chr(10) || lang AS line FROM documents")
def fn06_normal_lines(spark, sf_dir):
    """Compatibility forms by line: a ligature, a superscript, a full-width letter; plain lines are left alone."""
    odd = F.concat("lang", F.lit(" \ufb01 \u00b9 \uff21"), F.col("doc_id").cast("string"), F.lit("\n"), "lang")
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.nfkc(text.split_lines(odd), odd), "\n").alias("line"))


@query("SELECT doc_id, source AS value, 'none' AS absent FROM documents")
def fn22_last_of_a_key(spark, sf_dir):
    """A header's map keeps the last of a key; what it lacks has a default."""
    page = F.concat(F.lit("---\nkey: "), "lang", F.lit("\nother: 1\nkey: "), "source", F.lit("\n---\nkey: body"))
    lines = text.split_lines(page)
    fields = text.header(lines, text.closing_line(lines))
    return docs(spark, sf_dir).select("doc_id", fields["key"].alias("value"), F.coalesce(fields["gone"], F.lit("none")).alias("absent"))


@query(f"WITH {LEDGER_FACTS} SELECT conv_id AS ledger_id, 'B001' AS blocks FROM (SELECT DISTINCT conv_id FROM blocks) WHERE conv_id % 3 = 0")
def ag18_blocked_blocks(spark, sf_dir):
    """Quarantined blocks of valid ledgers: one ledger of one line for each conversation."""
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    third = F.col("conv_id") % 3
    sha = F.sha2(F.concat(F.lit("line "), F.col("conv_id").cast("string")), 256)
    held = F.concat(F.lit('"class":"quarantine","action":"omit","confidence":"high","review_state":"blocked","reason_codes":["'), F.when(third == 2, "no-such-reason").otherwise("credentials"), F.lit('"]'))
    fine = F.lit('"class":"personal","action":"omit","confidence":"high","review_state":"blocked","reason_codes":["personal-data"]')
    doc = F.concat(F.lit(f'{{"taxonomy_version":"{fixed.TAXONOMY_VERSION}","source_sha256":"'), sha, F.lit('","source_line_count":1,"entries":[{"block_id":"B001","source_locator":"L1-L1",'), F.when(third == 1, fine).otherwise(held), F.lit("}]}"))
    ledgers = rows.select(F.col("conv_id").alias("ledger_id"), doc.alias("json"))
    sources = rows.select(F.col("conv_id").alias("ledger_id"), F.concat(F.lit("line "), F.col("conv_id").cast("string")).alias("text"))
    blocked = ledger.blocked_blocks(ledgers, sources, ledger.validate(ledgers, sources))
    return blocked.select("ledger_id", F.array_join("blocks", ",").alias("blocks"))


# ---- functions ----


@query("SELECT doc_id, sha256(lower(text)) AS digest FROM documents")
def fn01_lower(spark, sf_dir):
    """FN01, FN08."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.lower("text"), 256).alias("digest"))


@query("SELECT doc_id, 'a b' || CAST(doc_id AS VARCHAR) AS x FROM documents")
def fn03_strip(spark, sf_dir):
    d = F.concat(six()(" \t", "\n", " ", "", "\x1f "), F.lit("a b"), F.col("doc_id").cast("string"), six()("\n\n", " ", "", "\x85"))
    return docs(spark, sf_dir).select("doc_id", text.strip(d).alias("x"))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS INTEGER) AS lines FROM documents")
def fn05_line_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(text.split_lines(F.col("text"))).alias("lines"))


@query("SELECT doc_id, doc_id % 2 = 0 AS fits FROM documents")
def fn09_hash_form(spark, sf_dir):
    h = F.when(F.col("doc_id") % 2 == 0, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise("ABC")
    return docs(spark, sf_dir).select("doc_id", h.rlike(r"^[0-9a-f]{64}\z").alias("fits"))


@query(f"WITH {LEDGER_FACTS} SELECT conv_id AS ledger_id, i, first AS start, last AS \"end\" FROM blocks WHERE first >= 1")
def fn12_locators(spark, sf_dir):
    """FN11, FN12."""
    return ledger.read_entries(ledger.parse(*derived.ledgers(spark, sf_dir))).where("start is not null").select("ledger_id", "i", "start", "end")


@query("SELECT doc_id, 'B' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents")
def fn13_block_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.format_string("B%03d", "doc_id").alias("id"))


@query(f"SELECT doc_id, {pick('2024-02-29', '2023-02-29', '2024-1-1', 'x')} AS d, doc_id % 4 = 0 AS valid FROM documents")
def fn15_dates(spark, sf_dir):
    d = six()("2024-02-29", "2023-02-29", "2024-1-1", "x")
    return docs(spark, sf_dir).select("doc_id", d.alias("d"), text.is_date(d).alias("valid"))


@query("SELECT doc_id, CAST(doc_id % 400 AS INTEGER) AS days FROM documents")
def fn16_day_difference(spark, sf_dir):
    start = F.to_date(F.lit("2024-01-01"))
    return docs(spark, sf_dir).select("doc_id", F.datediff(F.date_add(start, (F.col("doc_id") % 400).cast("int")), start).alias("days"))


@query("SELECT doc_id, round(ln(1 + doc_id), 9) AS x FROM documents")
def fn17_log(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(F.ln(1 + F.col("doc_id")), 9).alias("x"))


@query(f"SELECT doc_id, {pick('BIGINT', 'BOOLEAN', 'STRING', 'NONE')} AS kind FROM documents")
def fn18_json_kinds(spark, sf_dir):
    """A JSON value's kind: true is no count."""
    v = F.try_parse_json(six()('{"n": 2}', '{"n": true}', '{"n": "2"}', "{}"))
    return docs(spark, sf_dir).select("doc_id", ledger._kind(F.variant_get(v, "$.n", "variant")).alias("kind"))


@query("SELECT doc_id, '{\"a\":' || CAST(doc_id AS VARCHAR) || ',\"b\":\"é\"}' AS json FROM documents")
def fn19_json(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("a"), F.lit("é").alias("b"))).alias("json"))


@query(f"WITH {_LAST_S} SELECT h.doc, h.term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM hits h JOIN dfs ON h.term = dfs.term CROSS JOIN totals")
def fn20_idf(spark, sf_dir):
    idx = index(spark, sf_dir)
    p = idx.postings.where(F.col("term").isin([t for t, _ in TERMS]))
    df = F.broadcast(search.document_frequencies(p))
    n = F.broadcast(idx.totals.select("n", F.lit(1).alias("one")))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return p.join(df, "term").withColumn("one", F.lit(1)).join(n, "one").select("doc", "term", F.round(idf, 6).alias("idf"))


@query("SELECT doc_id, 'a/d' || CAST(doc_id AS VARCHAR) AS path FROM documents")
def fn21_normal_paths(spark, sf_dir):
    p = F.concat(six()("a/", "./a/./", "a/b/../", "x/../a//"), F.lit("d"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", lint.normal_path(p).alias("path"))


@query("SELECT doc_id, 'a1,a2,b' AS x FROM documents")
def fn23_array_functions(spark, sf_dir):
    a = F.array_sort(F.array_distinct(F.split(six()("b,a2,a1,b", "a1,b,a2,a1"), ",")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(a, 1, 3), ",").alias("x"))


# ---- sinks ----


@query(f"WITH {_LAST_S} SELECT printf('%6.2f', round(score, 9)) || '  ' || CAST(doc AS VARCHAR) || '  — ' || title AS line FROM scored ORDER BY score DESC, family, doc LIMIT 20")
def sk04_search_lines(spark, sf_dir):
    return search.render(search.search(index(spark, sf_dir), QUERY, 20).withColumn("score", F.round("score", 9)))


_JSON_FINDING = """'{"category":"' || category || '","line":' || line || ',"reason_code":"' || reason_code || '"}'"""


@query(
    f"{_FOUND}, b AS (SELECT path, string_agg(replace({_JSON_FINDING}, '\"line\":' || line || ',\"reason_code\":\"' || reason_code || '\"', '\"reason_code\":\"' || reason_code || '\",\"line\":' || line), ',' ORDER BY category, reason_code, line) AS f FROM found GROUP BY path) "
    """SELECT '{"findings":[' || f || '],"path":"' || path || '","source":{"line_count":' || len(string_split(text, chr(10))) || ',"sha256":"' || sha256(text) || '"},"status":"blocked"}' AS json FROM b JOIN scanned USING (path)"""
)
def sk05_scan_json(spark, sf_dir):
    return scan.as_json(scan.visible_records(scan.scan(derived.scan_docs(spark, sf_dir)), quiet=True))
