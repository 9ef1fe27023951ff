"""Corpus health: page rules, links, index membership, duplicates, distributions.

Page rules are narrow: one pass over each page, no shuffle.  Cross-page rules
are equi-joins and anti-joins on exploded keys.  ``parse`` is done once and its
result can be cached or written; every rule reads from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


@dataclass
class Corpus:
    pages: DataFrame  # parsed, see parse()
    indexes: DataFrame  # path, text
    files: DataFrame  # path of every file below the root
    config: dict
    today: str  # yyyy-MM-dd


def parse(pages: DataFrame) -> DataFrame:
    """pages(path, family, expected_type, slug, text) with lines, n_lines, fields (header map), seen (visible lines)."""
    pages = text.once(pages, lines=text.split_lines(text.drop_bom(F.col("text"))))
    pages = text.once(pages, header_end=text.closing_line(F.col("lines")))
    fields = text.header(F.col("lines"), F.col("header_end"))
    return text.once(pages, n_lines=F.size("lines"), fields=fields, seen=text.visible(F.col("lines")))


def field(name: str) -> Column:
    return F.coalesce(F.col("fields")[name], F.lit(""))


def _missing() -> Column:
    return F.array_compact(F.array(*[F.when(text.is_blank(field(n)), F.lit(n)) for n in sorted(fixed.REQUIRED_FIELDS)]))


def _bad(tests: dict[str, Column]) -> Column:
    """array<struct<field, value>> of the filled fields for which the test holds."""
    return F.array_compact(F.array(*[F.when(~text.is_blank(field(f)) & bad, F.struct(F.lit(f).alias("field"), text.unquote(field(f)).alias("value"))) for f, bad in tests.items()]))


def _bad_enums(c: Corpus) -> Column:
    domains = {"page_type": list(c.config["page_families"].values()), "reliability": [*fixed.RELIABILITY, "unknown"], "sensitivity": [*fixed.SENSITIVITY, "unknown"]}
    return _bad({f: ~text.unquote(field(f)).isin(*d) for f, d in domains.items()})


def _bad_dates() -> Column:
    return _bad({f: ~text.is_date(text.unquote(field(f))) for f in ("created", "updated")})


def _mismatched() -> Column:
    return ~text.is_blank(field("page_type")) & (text.unquote(field("page_type")) != F.col("expected_type"))


def missing_frontmatter(c: Corpus) -> DataFrame:
    return c.pages.select("path", _missing().alias("missing")).where("size(missing) > 0")


def invalid_enum(c: Corpus) -> DataFrame:
    """A page type beyond the configured ones; a reliability or sensitivity beyond its domain and 'unknown'."""
    return c.pages.select("path", F.inline(_bad_enums(c)))


def page_type_mismatches(c: Corpus) -> DataFrame:
    return c.pages.where(_mismatched()).select("path", F.col("expected_type").alias("expected"), text.unquote(field("page_type")).alias("actual"))


def invalid_date(c: Corpus) -> DataFrame:
    return c.pages.select("path", F.inline(_bad_dates()))


def hard_cap_exceeded(c: Corpus) -> DataFrame:
    cap = c.config["caps"]["hard_lines"]
    return c.pages.where(F.col("n_lines") > cap).select("path", F.col("n_lines").alias("lines"), F.lit(cap).alias("cap"))


def soft_cap_exceeded(c: Corpus) -> DataFrame:
    cap = c.config["caps"]["soft_lines"]
    return c.pages.where(F.col("n_lines") > cap).select("path", F.col("n_lines").alias("lines"), F.lit(cap).alias("cap"))


def raw_references(sources: Column) -> Column:
    found = F.regexp_extract_all(sources, F.lit(fixed.RAW_REFERENCE), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[.)]+\z", ""), "^wiki/", ""))))


def normal_path(path: Column) -> Column:
    """Without empty and single-dot parts, double dots resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, text.no_strings(), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(up, "/")


def broken_source_references(c: Corpus) -> DataFrame:
    refs = c.pages.select("path", F.explode(raw_references(field("sources"))).alias("reference")).withColumn("key", normal_path(F.col("reference")))
    return refs.join(c.files.select(F.col("path").alias("key")), "key", "left_anti").select("path", "reference")


def leaked_lines(lines: Column, end: Column) -> Column:
    """Numbers of list items of a header that stand after its end, outside fences."""
    body = text.outside_fences(F.slice(lines, end + 1, F.size(lines)))
    return F.when(end > 0, F.transform(F.filter(body, lambda x: x["line"].rlike(fixed.LEAKED_ITEM)), lambda x: x["n"] + end)).otherwise(F.array().cast("array<int>"))


def frontmatter_leaked_into_body(c: Corpus) -> DataFrame:
    return c.pages.select("path", F.explode(leaked_lines(F.col("lines"), F.col("header_end"))).alias("line"))


def placeholders(seen: Column) -> Column:
    found = F.flatten(F.transform(seen, lambda x: F.concat(F.regexp_extract_all(x["line"], F.lit(fixed.ANGLE_PLACEHOLDER), F.lit(0)), F.regexp_extract_all(x["line"], F.lit(fixed.BRACE_PLACEHOLDER), F.lit(0)))))
    return F.array_sort(F.array_distinct(found))


def template_placeholders(c: Corpus) -> DataFrame:
    return c.pages.select("path", placeholders(F.col("seen")).alias("matches")).where("size(matches) > 0")


def pending_review(lines: Column) -> Column:
    """Whether a Pending Review section has a line that is neither blank nor all placeholder."""
    whole = r"(?d)^(?:[-*+]\s+)?<.+>$"

    def step(acc: Column, raw: Column) -> Column:
        line = text.strip(raw)
        opens = line.rlike(r"(?U)^#{1,6}\s+Pending Review\s*$")
        return (
            F.when((acc == "found") | (acc == "over"), acc)
            .when(opens, F.lit("in"))
            .when(acc == "out", acc)
            .when(line.rlike(r"(?U)^#{1,6}\s+"), F.lit("over"))
            .when((line == "") | line.rlike(whole), acc)
            .otherwise(F.lit("found"))
        )

    named = F.exists(lines, lambda x: x.contains("Pending Review"))
    return named & F.aggregate(lines, F.lit("out"), step, lambda acc: acc == "found")


def _aged(c: Corpus) -> DataFrame:
    raw = text.unquote(field("updated"))
    when = F.when(text.is_date(raw), F.try_to_date(raw, "yyyy-MM-dd"))
    return c.pages.withColumn("updated", raw).withColumn("days", F.datediff(F.to_date(F.lit(c.today)), when))


def _stale(c: Corpus) -> dict[str, Column]:
    """Of aged pages: whether each rule on their age holds."""
    limit = c.config["staleness_days"]
    return {
        "stale_low_reliability": (text.unquote(field("reliability")) == "low") & (F.col("days") > limit["low_reliability"]),
        "cold_pages": F.col("days") > limit["cold_page"],
        "stale_pending_review": (F.col("days") > limit["pending_review"]) & pending_review(F.col("lines")),
    }


def _stale_pages(c: Corpus, rule: str) -> DataFrame:
    return _aged(c).where(_stale(c)[rule]).select("path", "updated", "days")


def stale_low_reliability(c: Corpus) -> DataFrame:
    return _stale_pages(c, "stale_low_reliability")


def cold_pages(c: Corpus) -> DataFrame:
    return _stale_pages(c, "cold_pages")


def stale_pending_review(c: Corpus) -> DataFrame:
    return _stale_pages(c, "stale_pending_review")


def duplicate_slugs(c: Corpus) -> DataFrame:
    """Stems that several pages have; a page is one path, so a stem's list is as long as its copies."""
    return c.pages.groupBy("slug").agg(F.array_sort(F.collect_list("path")).alias("paths")).where("size(paths) > 1")


def page_links(pages: DataFrame) -> DataFrame:
    """src_path, line, raw, target."""
    return pages.select(F.col("path").alias("src_path"), F.inline(text.links(F.col("seen"))))


def index_links(c: Corpus) -> DataFrame:
    seen = text.visible(text.split_lines(text.drop_bom(F.col("text"))))
    return c.indexes.select(F.col("path").alias("src_path"), F.inline(text.links(seen)))


def index_entries(c: Corpus) -> DataFrame:
    """index_path, line, target, slug of bullets that begin with a link."""
    seen = text.visible(text.split_lines(text.drop_bom(F.col("text"))))
    out = c.indexes.select(F.col("path").alias("index_path"), F.inline(text.primary_entries(seen)))
    return out.withColumn("slug", F.substring_index("target", "/", -1))


def target_keys(files: DataFrame) -> DataFrame:
    """Names by which a file can be linked: path and name, for pages also without suffix."""
    name = F.element_at(F.split("path", "/"), -1)
    page = F.lower("path").endswith(".md")
    cut = F.col("path").substr(F.lit(1), F.length("path") - 3)
    keys = F.array_compact(F.array(F.col("path"), name, F.when(page, cut), F.when(page, F.element_at(F.split(cut, "/"), -1))))
    return files.select(F.explode(keys).alias("target")).distinct()


def page_keys(pages: DataFrame) -> DataFrame:
    """path, family, key: the stem, the path, the path without suffix."""
    cut = F.col("path").substr(F.lit(1), F.length("path") - 3)
    return pages.select("path", "family", "slug", F.explode(F.array_distinct(F.array("slug", "path", cut))).alias("key"))


def broken_wikilinks(c: Corpus) -> DataFrame:
    every = page_links(c.pages).union(index_links(c))
    return every.join(target_keys(c.files), "target", "left_anti").select(F.col("src_path").alias("path"), "line", "raw", "target")


def missing_index_entries(c: Corpus) -> DataFrame:
    """Pages that neither the root index nor their own family's shard lists.

    One equi-join on (family, key), with the root's entries repeated for each
    family, in place of a disjunction that would be a nested loop.
    """
    index = c.config["index"]
    entries = index_entries(c)
    families = F.array(*[F.lit(f) for f in c.config["page_families"]])
    root = entries.where(F.col("index_path") == index["root"]).select(F.explode(families).alias("family"), F.col("target").alias("key"))
    shard = F.regexp_extract("index_path", "^" + index["shard_prefix"].replace(".", r"\.") + r"(.*)\.md$", 1)
    own = entries.where(F.col("index_path") != index["root"]).select(shard.alias("family"), F.col("target").alias("key"))
    listed = page_keys(c.pages).join(root.union(own).distinct(), ["family", "key"], "left_semi").select("path").distinct()
    return c.pages.join(listed, "path", "left_anti").select("path", "slug", "family")


def duplicate_index_entries(c: Corpus) -> DataFrame:
    where = F.array_sort(F.collect_list(F.struct(F.col("index_path").alias("index"), "line")))
    return index_entries(c).groupBy("slug").agg(where.alias("occurrences")).where("size(occurrences) > 1")


def orphans(c: Corpus) -> DataFrame:
    """Pages that no other content page links; a key that several pages have credits each."""
    referenced = page_links(c.pages).select("src_path", F.col("target").alias("key")).distinct().join(page_keys(c.pages), "key").where("src_path <> path").select("path").distinct()
    return c.pages.join(referenced, "path", "left_anti").select("path", "slug")


ERRORS = {f.__name__: f for f in (missing_frontmatter, invalid_enum, invalid_date, page_type_mismatches, hard_cap_exceeded, broken_wikilinks, duplicate_slugs, broken_source_references, missing_index_entries, duplicate_index_entries, frontmatter_leaked_into_body)}
WARNINGS = {f.__name__: f for f in (orphans, soft_cap_exceeded, stale_low_reliability, stale_pending_review, cold_pages, template_placeholders)}


def counts_per_family(c: Corpus) -> DataFrame:
    """family, pages: zero for empty families, and the total."""
    dim = c.pages.sparkSession.createDataFrame([(f,) for f in c.config["page_families"]], "family string")
    n = dim.join(c.pages.select("family", "path"), "family", "left")
    return n.rollup("family").agg(F.count("path").alias("pages")).select(F.coalesce("family", F.lit("total")).alias("family"), "pages")


def distribution(c: Corpus, name: str) -> DataFrame:
    """value, pages over the domain and 'unknown', which missing and invalid values count as."""
    domain = list(fixed.RELIABILITY if name == "reliability" else fixed.SENSITIVITY)
    dim = c.pages.sparkSession.createDataFrame([(v,) for v in [*domain, "unknown"]], "value string")
    value = F.when(text.unquote(field(name)).isin(*domain), text.unquote(field(name))).otherwise("unknown")
    counted = c.pages.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("pages"))
    return dim.join(counted, "value", "left").select("value", F.coalesce("pages", F.lit(0)).alias("pages"))


def directory_counts(c: Corpus) -> DataFrame:
    """directory, pages, near_subdivide."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    limit = c.config["scale_thresholds"]["subdivide_directory_at_pages"]
    near = (F.col("pages") >= 0.8 * limit) & F.lit(limit > 0)
    return c.pages.groupBy(folder.alias("directory")).agg(F.count("*").alias("pages")).withColumn("near_subdivide", near)


def scale(c: Corpus) -> DataFrame:
    t = c.config["scale_thresholds"]
    near = {n: (F.col("total_pages") >= 0.8 * t[k]) & F.lit(t[k] > 0) for n, k in (("near_shard_index", "shard_index_at_pages"), ("near_search_step", "search_step_at_pages"))}
    return c.pages.agg(F.count("*").alias("total_pages")).select("total_pages", *[v.alias(k) for k, v in near.items()])


def page_summary(c: Corpus) -> DataFrame:
    def known(n: str) -> Column:
        return F.when(~text.is_blank(field(n)), text.unquote(field(n)))

    return c.pages.select("path", F.col("expected_type").alias("page_type"), "slug", F.col("n_lines").alias("lines"), known("reliability").alias("reliability"), known("sensitivity").alias("sensitivity"), known("updated").alias("updated"))


def _narrow(c: Corpus) -> dict[str, Column]:
    """Of an aged page: how many findings each rule that looks at one page alone has."""
    caps = c.config["caps"]
    has = {
        "page_type_mismatches": _mismatched(),
        "hard_cap_exceeded": F.col("n_lines") > caps["hard_lines"],
        "soft_cap_exceeded": F.col("n_lines") > caps["soft_lines"],
        "missing_frontmatter": F.size(_missing()) > 0,
        "template_placeholders": F.size(placeholders(F.col("seen"))) > 0,
        **_stale(c),
    }
    n = {k: F.when(v, 1).otherwise(0) for k, v in has.items()}
    return n | {"invalid_enum": F.size(_bad_enums(c)), "invalid_date": F.size(_bad_dates()), "frontmatter_leaked_into_body": F.size(leaked_lines(F.col("lines"), F.col("header_end")))}


_FACT = "array<struct<space:string,key:string,role:string,path:string,src:string,n:long>>"


def _fact(space: str, key: Column, role: str, path: Column | None = None, src: Column | None = None, n: Column | int = 1) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(space).alias("space"), key.alias("key"), F.lit(role).alias("role"), (none if path is None else path).alias("path"),
        (none if src is None else src).alias("src"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"),
    )


def _facts(c: Corpus) -> DataFrame:
    """space, key, role, path, src, n: all that the rules ask of pages, files and indexes, each read once.

    Spaces: N counts of a page's own rules; S slugs; L names that links go to; R
    references to raw files; I index membership by family and name; E entries.
    """
    path, family = F.col("path"), F.col("family")
    own = F.array_distinct(F.array("slug", path, path.substr(F.lit(1), F.length(path) - 3)))
    member = lambda f, key: F.concat_ws("\x1f", f, key)
    pages = _aged(c).select(
        F.inline(
            F.concat(
                F.array(*[_fact("N", F.lit(k), "count", n=n) for k, n in _narrow(c).items()], _fact("S", F.col("slug"), "page")).cast(_FACT),
                F.transform(text.links(F.col("seen")), lambda x: _fact("L", x["target"], "link", src=path)).cast(_FACT),
                F.transform(raw_references(field("sources")), lambda x: _fact("R", normal_path(x), "link")).cast(_FACT),
                F.transform(own, lambda k: _fact("L", k, "page", path=path)).cast(_FACT),
                F.transform(own, lambda k: _fact("I", member(family, k), "page", path=path)).cast(_FACT),
            )
        )
    )
    files = target_keys(c.files).select(F.inline(F.array(_fact("L", F.col("target"), "file")).cast(_FACT)))
    files = files.union(c.files.select(F.inline(F.array(_fact("R", F.col("path"), "file")).cast(_FACT))))
    seen = text.visible(text.split_lines(text.drop_bom(F.col("text"))))
    indexes = text.once(c.indexes, seen=seen).withColumn("entries", text.primary_entries(F.col("seen")))
    root, prefix = c.config["index"]["root"], c.config["index"]["shard_prefix"]
    shard = F.regexp_extract("path", "^" + prefix.replace(".", r"\.") + r"(.*)\.md$", 1)
    families = F.when(path == root, F.array(*[F.lit(f) for f in c.config["page_families"]])).otherwise(F.array(shard))
    indexes = indexes.select(
        F.inline(
            F.concat(
                F.transform(text.links(F.col("seen")), lambda x: _fact("L", x["target"], "index")).cast(_FACT),
                F.transform("entries", lambda x: _fact("E", F.substring_index(x["target"], "/", -1), "entry")).cast(_FACT),
                F.flatten(F.transform("entries", lambda x: F.transform(families, lambda f: _fact("I", member(f, x["target"]), "entry")))).cast(_FACT),
            )
        )
    )
    return pages.union(files).union(indexes)


def finding_counts(c: Corpus) -> DataFrame:
    """severity, kind, position (as reports order kinds), n; kinds without findings are left out.

    One plan that reads each page once.  What pages, files and indexes say of a
    name is summed up before it meets, so a name that a third of all links go to
    is a few rows; names meet in one window, and pages in one aggregate.
    """
    # A link's source tells whether any other page links a name: its least and its greatest.
    told = _facts(c).groupBy("space", "key", "role", "path").agg(F.sum("n").alias("n"), F.min("src").alias("lo"), F.max("src").alias("hi"))
    name = Window.partitionBy("space", "key")

    def is_(space: str, *roles: str) -> Column:
        return (F.col("space") == space) & F.col("role").isin(*roles)

    there = F.max(F.col("role").isin("file", "entry")).over(name)
    told = told.select("space", "key", "role", "path", "n", there.alias("there"), F.min("lo").over(name).alias("lo"), F.max("hi").over(name).alias("hi"))
    kind = (
        F.when(is_("N", "count"), F.col("key"))
        .when(is_("S", "page") & (F.col("n") > 1), "duplicate_slugs")
        .when(is_("E", "entry") & (F.col("n") > 1), "duplicate_index_entries")
        .when(is_("L", "link", "index") & ~F.col("there"), "broken_wikilinks")
        .when(is_("R", "link") & ~F.col("there"), "broken_source_references")
        .when(is_("L", "page"), "orphans")
        .when(is_("I", "page"), "missing_index_entries")
    )
    other = F.coalesce((F.col("lo") != F.col("path")) | (F.col("hi") != F.col("path")), F.lit(False))
    good = F.when(F.col("space") == "L", other).otherwise(F.col("there"))
    n = F.when(F.col("space").isin("S", "E"), 1).otherwise(F.col("n"))
    # A page is good if it is by any of its names.
    by_page = told.select(kind.alias("kind"), "path", good.alias("good"), n.alias("n")).where("kind is not null").groupBy("kind", "path").agg(F.sum("n").alias("n"), F.max("good").alias("good"))
    out = by_page.groupBy("kind").agg(F.sum(F.when(F.col("path").isNull(), F.col("n")).when(F.col("good"), 0).otherwise(1)).cast("long").alias("n"))
    kinds = [(severity, k, names.index(k)) for severity, names in (("error", fixed.ERROR_KINDS), ("warning", fixed.WARNING_KINDS)) for k in names]
    place = F.create_map(*[x for s, k, p in kinds for x in (F.lit(k), F.struct(F.lit(s).alias("severity"), F.lit(p).alias("position")))])
    out = out.where("n > 0").withColumn("of", place[F.col("kind")])
    return out.select("of.severity", "kind", "of.position", "n")


def occurrences_in_order(rows: DataFrame, by: str, order: list[str], keep: int) -> DataFrame:
    """At most ``keep`` rows of each group, in order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= keep)
