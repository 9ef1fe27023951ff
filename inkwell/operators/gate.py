"""Write gates, event by event: tool calls and staged changes, and slugs and templates of new pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import scan
from .lint import normal_path

EVENT = "struct<tool_name:string,tool_input:struct<file_path:string,content:string,new_string:string,edits:array<struct<new_string:string>>>>"


def parse_events(raw: DataFrame) -> DataFrame:
    """raw(event_id, json) -> event_id, tool_name, file_path, text (what would be written)."""
    e = F.from_json("json", EVENT)
    rows = raw.select("event_id", e.alias("e"))
    x = F.col("e.tool_input")
    edits = F.array_join(F.transform(x["edits"], lambda y: F.coalesce(y["new_string"], F.lit(""))), "\n")
    return rows.select("event_id", F.col("e.tool_name").alias("tool_name"), x["file_path"].alias("file_path"), F.coalesce(x["content"], x["new_string"], edits, F.lit("")).alias("text"))


def in_raw(path: Column, wiki_root: str = "wiki") -> Column:
    return normal_path(path).startswith(f"{wiki_root}/raw/")


def judge(events: DataFrame, allowlist: DataFrame | None = None, wiki_root: str = "wiki") -> DataFrame:
    """event_id, verdict (0 allow, 2 block), reason, findings (at most ten)."""
    rows = events.withColumn("watched", F.col("tool_name").isin(*fixed.WRITE_TOOLS) & F.col("file_path").isNotNull())
    path = normal_path(F.col("file_path"))
    keyed = rows.withColumn("path", F.concat_ws("\x1f", F.col("event_id").cast("string"), path))
    scanned = scan.scan(keyed.where(F.col("watched") & ~in_raw(F.col("file_path"), wiki_root)).select("path", "text"))
    if allowlist is not None:
        scanned = scan.apply_allowlist(scanned, allowlist, F.substring_index("path", "\x1f", -1))
    found = scanned.where("status = 'blocked'").select("path", F.slice("findings", 1, fixed.REPORTED_FINDINGS).alias("findings"))
    out = keyed.join(found, "path", "left")
    raw = F.coalesce(F.col("watched") & in_raw(F.col("file_path"), wiki_root), F.lit(False))
    reason = F.when(raw, "raw-path").when(F.col("findings").isNotNull(), "findings")
    return out.select("event_id", F.when(reason.isNotNull(), 2).otherwise(0).alias("verdict"), reason.alias("reason"), F.coalesce("findings", F.array().cast(scan.FINDING)).alias("findings"))


def staged_refusals(changes: DataFrame, wiki_root: str = "wiki", override: bool = False) -> DataFrame:
    """changes(status, path, old_path) -> path, reason of those that a commit may not hold.

    Anything below the staging folder; under raw, all but additions, except in
    the inbox (for a rename: where it comes from).
    """
    old = F.coalesce("old_path", "path")
    staging = F.col("path").startswith(fixed.STAGING_DIR + "/")
    raw = F.col("path").startswith(f"{wiki_root}/raw/") | old.startswith(f"{wiki_root}/raw/")
    changed = F.substring("status", 1, 1).isin("M", "D", "R", "C") & raw & ~old.startswith(f"{wiki_root}/raw/inbox/") & F.lit(not override)
    reason = F.when(staging, "staging").when(changed, "raw-changed")
    return changes.select("status", "path", reason.alias("reason")).where("reason is not null")


def needs_scan(path: Column, wiki_root: str = "wiki") -> Column:
    """Whether a staged page is scanned: support files and templates are not."""
    name = F.element_at(F.split(path, "/"), -1)
    return path.startswith(f"{wiki_root}/") & ~path.contains("/_templates/") & ~name.isin("README.md", "CLAUDE.md", "AGENTS.md")


def valid_slug(slug: Column) -> Column:
    """Parts joined by slashes, each of lower-case letters, digits and hyphens, none first."""
    return F.coalesce(slug.rlike(r"^[a-z0-9][a-z0-9-]*(?:/[a-z0-9][a-z0-9-]*)*\z"), F.lit(False))


def json_string(value: Column) -> Column:
    """A JSON string in ASCII: other characters as escapes of their UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(value, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    short = {"0022": '\\"', "005C": "\\\\", "000A": "\\n", "000D": "\\r", "0009": "\\t", "0008": "\\b", "000C": "\\f"}
    known = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])

    def written(unit: Column) -> Column:
        plain = F.when(unit.between("0020", "007E"), F.chr(F.conv(unit, 16, 10).cast("long")))
        return F.coalesce(known[unit], plain, F.concat(F.lit("\\u"), F.lower(unit)))

    return F.concat(F.lit('"'), F.array_join(F.transform(units, written), ""), F.lit('"'))


def _first_line(lines: Column, pattern: str, line: Column) -> Column:
    """The lines with the first that fits the pattern replaced."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True)
    return text.let(at, lambda at: F.transform(lines, lambda x, i: F.when(i + 1 == at, line).otherwise(x)))


def new_pages(requests: DataFrame) -> DataFrame:
    """requests(template, page_type, title, day, tags, reliability, sensitivity, sources, ...) -> requests with text.

    Day, title (quoted in the header, plain in the heading) and tags go wherever
    the template has a place for them; reliability, sensitivity and sources take
    the first header line of that name; the first source below raw fills the
    first link to a raw file.  Without tags or sources their places stay.  A page
    type without title places gets no title.
    """
    places = F.create_map(*[x for k, (header, heading) in fixed.TITLE_PLACES.items() for x in (F.lit(k), F.struct(F.lit(f'title: "{header}"').alias("header"), F.lit(f"# {heading}").alias("heading")))])
    place = F.coalesce(places[F.col("page_type")], F.struct(F.lit("").alias("header"), F.lit("").alias("heading")))
    out = text.once(requests, __day=F.replace("template", F.lit(fixed.DAY_PLACE), F.col("day")), __place=place)
    titled = F.replace("__day", F.col("__place.header"), F.concat(F.lit("title: "), json_string(F.col("title"))))
    titled = F.replace(titled, F.col("__place.heading"), F.concat(F.lit("# "), "title"))
    tagged = F.replace(titled, F.lit(fixed.NO_TAGS), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")))
    none = F.coalesce(F.size("tags"), F.lit(0)) <= 0
    out = text.once(out, __lines=F.split(F.when(none, titled).otherwise(tagged), "\n", -1))
    for name in ("reliability", "sensitivity"):
        out = text.once(out.withColumnRenamed("__lines", "__l"), __lines=_first_line(F.col("__l"), rf"^{name}: \S+\z", F.concat(F.lit(f"{name}: "), name))).drop("__l")
    sources = F.concat(F.lit("sources: ["), F.array_join(F.transform("sources", json_string), ", "), F.lit("]"))
    some = F.coalesce(F.size("sources"), F.lit(0)) > 0
    out = text.once(out, __text=F.array_join(F.when(some, _first_line(F.col("__lines"), r"(?s)^sources: \[.*\]\z", sources)).otherwise(F.col("__lines")), "\n"))
    raw = F.get(F.filter("sources", lambda x: x.startswith("raw/")), F.lit(0))
    name = raw.substr(F.lit(5), F.length(raw))
    at = F.instr("__text", fixed.RAW_LINK_PLACE)
    linked = F.concat(F.col("__text").substr(F.lit(1), at - 1), F.lit("["), name, F.lit("](../raw/"), name, F.lit(")"), F.col("__text").substr(at + len(fixed.RAW_LINK_PLACE), F.length("__text")))
    return out.withColumn("text", F.when((at > 0) & raw.isNotNull(), linked).otherwise(F.col("__text"))).drop("__day", "__place", "__lines", "__text")


def fill_marks(files: DataFrame, owner: str, day: str) -> DataFrame:
    """files(path, text) -> path, text, changed: the owner's and the start day's marks filled in the files that may have them.

    What is filled has no mark left, so doing it again changes nothing (unless the owner's name is a mark).
    """
    marked = F.col("path").isin(*fixed.MARKED_FILES) & (F.col("text").contains(fixed.OWNER_MARK) | F.col("text").contains(fixed.START_MARK))
    filled = F.replace(F.replace("text", F.lit(fixed.OWNER_MARK), F.lit(owner)), F.lit(fixed.START_MARK), F.lit(day))
    changed = F.coalesce(marked, F.lit(False))
    return files.select("path", F.when(changed, filled).otherwise(F.col("text")).alias("text"), changed.alias("changed"))


def suite_summary(said: Column) -> Column:
    """A test run's output in one line: how many passed, or how many of them and what failed."""

    def count(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(said, pattern, 1).try_cast("long"), F.lit(0))

    ran, failures, errors = count(r"Ran (\d+) tests?"), count(r"failures=(\d+)"), count(r"errors=(\d+)")
    good = said.rlike(r"Ran \d+ tests?") & ~said.contains("FAILED")
    passed = F.greatest(ran - failures - errors, F.lit(0))
    return F.when(good, F.format_string("%d tests passed", ran)).otherwise(F.format_string("%d/%d tests passed (%d failed, %d errors)", passed, ran, failures, errors))
