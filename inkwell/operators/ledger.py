"""Validation of block-by-block classification ledgers.

A ledger is JSON; types matter (true is no count), so values stay variants
until their kind is known.  Rules of one entry are a filtered array, coverage
and repeated ids are windows over the entry order, and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

#: What a value that is missing or of another kind is compared as.
NOTHING = "\x00"
ALL_REASONS = (*fixed.QUARANTINE_REASONS, *fixed.PERSONAL_REASONS, *fixed.RESTRICTED_REASONS, *fixed.SHAREABLE_REASONS, *fixed.CROSS_CUTTING_REASONS)
CLASS_REASONS = {
    "quarantine": (*fixed.QUARANTINE_REASONS, *fixed.QUARANTINE_ALSO),
    "personal": (*fixed.PERSONAL_REASONS, *fixed.CROSS_CUTTING_REASONS),
    "restricted": (*fixed.RESTRICTED_REASONS, *fixed.CROSS_CUTTING_REASONS),
    "shareable": (*fixed.SHAREABLE_REASONS, *fixed.CROSS_CUTTING_REASONS),
}


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("NONE"))


def _set(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else text.no_strings()


def _string(v: Column) -> Column:
    """The string, or null for any other kind."""
    return F.when(_kind(v) == "STRING", v.cast("string"))


def _strings(v: Column) -> Column:
    """The array if it holds strings only, or null."""
    items = F.when(_kind(v).startswith("ARRAY"), v.cast("array<variant>"))
    return F.when(F.forall(items, lambda x: _kind(x) == "STRING"), F.transform(items, lambda x: x.cast("string")))


def _object(v: Column) -> Column:
    return F.when(_kind(v).startswith("OBJECT"), v.cast("map<string,variant>"))


def _within(a: Column, values) -> Column:
    return F.size(F.array_except(a, _set(values))) == 0


def _rules(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(rule)) for rule, cond in pairs]))


def parse(ledgers: DataFrame, sources: DataFrame) -> DataFrame:
    """ledgers(ledger_id, json), sources(ledger_id, text) -> one row each with its fields and the source's facts."""
    rows = ledgers.join(sources, "ledger_id")
    rows = rows.withColumn("doc", F.try_parse_json("json")).withColumn("top", _object(F.col("doc")))
    return rows.select("ledger_id", "doc", "top", F.sha2("text", 256).alias("sha"), F.size(text.split_lines(F.col("text"))).alias("n_lines"))


def document_errors(parsed: DataFrame, taxonomy: str = fixed.TAXONOMY_VERSION) -> DataFrame:
    top = F.col("top")
    count = F.when(_kind(top["source_line_count"]).isin("BIGINT"), F.try_variant_get("doc", "$.source_line_count", "bigint"))
    keys = F.map_keys(top)
    entries = F.when(_kind(top["entries"]).startswith("ARRAY"), top["entries"].cast("array<variant>"))
    rules = _rules(
        [
            ("ledger-object", top.isNull()),
            ("ledger-fields", top.isNotNull() & ((F.size(F.array_except(keys, _set(fixed.LEDGER_FIELDS))) > 0) | (F.size(F.array_except(_set(fixed.LEDGER_FIELDS), keys)) > 0))),
            ("taxonomy-version", top.isNotNull() & (F.coalesce(_string(top["taxonomy_version"]), F.lit(NOTHING)) != taxonomy)),
            ("source-sha256", top.isNotNull() & (F.coalesce(_string(top["source_sha256"]), F.lit(NOTHING)) != F.col("sha"))),
            ("source-line-count", top.isNotNull() & ((F.coalesce(count, F.lit(-1)) != F.col("n_lines")) | (F.coalesce(count, F.lit(-1)) < 1))),
            ("entries-list", top.isNotNull() & (entries.isNull() | (F.size(entries) == 0))),
        ]
    )
    return parsed.select("ledger_id", F.lit("$ledger").alias("block_id"), F.explode(rules).alias("rule"))


def entries(parsed: DataFrame) -> DataFrame:
    """ledger_id, i (from 1), entry (map, null if it is no object), n_lines."""
    items = F.when(_kind(F.col("top")["entries"]).startswith("ARRAY"), F.col("top")["entries"].cast("array<variant>"))
    out = parsed.select("ledger_id", "n_lines", F.posexplode(items).alias("p", "v"))
    return out.select("ledger_id", "n_lines", (F.col("p") + 1).alias("i"), _object(F.col("v")).alias("entry"))


def read_entries(parsed: DataFrame) -> DataFrame:
    """Entries with their fields as columns, comparable whatever their kind."""
    e = F.col("entry")

    def value(name: str) -> Column:
        return F.coalesce(_string(e[name]), F.lit(NOTHING))

    out = entries(parsed)
    out = out.withColumn("id", F.coalesce(_string(e["block_id"]), F.format_string("$entry-%d", "i")))
    locator = F.coalesce(_string(e["source_locator"]), F.lit(""))
    form = r"^L([1-9][0-9]*)-L([1-9][0-9]*)\z"
    fits = locator.rlike(form)
    for n, name in ((1, "start"), (2, "end")):
        # A number beyond a long is as good as the largest.
        out = out.withColumn(name, F.when(fits, F.coalesce(F.regexp_extract(locator, form, n).try_cast("bigint"), F.lit(2**62))))
    for name in ("class", "action", "confidence", "review_state"):
        out = out.withColumn(name, value(name))
    out = out.withColumn("bucket", F.when(F.map_contains_key(e, "proposal_bucket"), value("proposal_bucket")).otherwise("excluded"))
    out = out.withColumn("reasons", _strings(e["reason_codes"]))
    out = out.withColumn("wanted", F.when(F.map_contains_key(e, "destinations"), _strings(e["destinations"])).otherwise(text.no_strings()))
    return out


def coverage(rows: DataFrame) -> DataFrame:
    """rows(ledger_id, i, start, end) with ``expected``: the line after all that earlier usable locators cover."""
    usable = F.when(F.col("end") >= F.col("start"), F.col("end") + 1)
    before = Window.partitionBy("ledger_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("expected", F.coalesce(F.max(usable).over(before), F.lit(1)))


def validate(ledgers: DataFrame, sources: DataFrame, destinations=(), taxonomy: str = fixed.TAXONOMY_VERSION) -> DataFrame:
    """Distinct (ledger_id, block_id, rule)."""
    parsed = parse(ledgers, sources)
    rows = coverage(read_entries(parsed))
    whole = rows.where("entry is not null")
    again = Window.partitionBy("ledger_id", "id").orderBy("i")
    whole = whole.withColumn("again", F.row_number().over(again) > 1)
    c = {n: F.col(n) for n in ("class", "action", "confidence", "review_state", "bucket", "reasons", "start", "end", "expected")}
    keys = F.map_keys("entry")
    cls, action, review, bucket = c["class"], c["action"], c["review_state"], c["bucket"]
    is_, out = {k: cls == k for k in fixed.CLASSES}, bucket == "excluded"
    reasons_ok = c["reasons"].isNotNull() & (F.size("reasons") > 0) & (F.size(F.array_distinct("reasons")) == F.size("reasons")) & _within(c["reasons"], ALL_REASONS)
    sent_ok = F.col("wanted").isNotNull() & (F.size(F.array_distinct("wanted")) == F.size("wanted")) & _within(F.col("wanted"), sorted(destinations))
    sent = sent_ok & (F.size("wanted") > 0)
    usable = c["end"] >= c["start"]
    class_reasons = F.lit(False)
    for k, v in CLASS_REASONS.items():
        class_reasons = class_reasons | (is_[k] & ~_within(c["reasons"], v))
    free = F.lit(not destinations) & (review == "approved")
    waived = {"restricted": free & action.isin(*fixed.RESTRICTED_ACTIONS), "shareable": free & action.isin(*fixed.SHAREABLE_ACTIONS)}
    rules = [
        ("required-fields", (F.size(F.array_except(_set(fixed.ENTRY_REQUIRED), keys)) > 0) | (F.size(F.array_except(keys, _set(fixed.ENTRY_REQUIRED + fixed.ENTRY_OPTIONAL))) > 0)),
        ("duplicate-block-id", F.col("again")),
        ("block-id", text.is_blank(F.coalesce(_string(F.col("entry")["block_id"]), F.lit("")))),
        ("block-sequence", F.col("id") != F.format_string("B%03d", "i")),
        ("source-locator-format", c["start"].isNull()),
        ("source-locator-range", c["end"] < c["start"]),
        ("source-coverage-gap", usable & (c["start"] > c["expected"])),
        ("source-coverage-overlap", usable & (c["start"] < c["expected"])),
        ("source-locator-bounds", usable & (c["end"] > F.col("n_lines"))),
        ("class-value", ~cls.isin(*fixed.CLASSES)),
        ("action-value", ~action.isin(*fixed.ACTIONS)),
        ("confidence-value", ~c["confidence"].isin(*fixed.CONFIDENCE)),
        ("review-state-value", ~review.isin(*fixed.REVIEW_STATES)),
        ("proposal-bucket-value", ~bucket.isin(*fixed.BUCKETS)),
        ("reason-codes", ~reasons_ok),
        ("reason-class", reasons_ok & cls.isin(*fixed.CLASSES) & (class_reasons | ((bucket == "safe") & ~_within(c["reasons"], fixed.SHAREABLE_REASONS)))),
        ("destinations-value", ~sent_ok),
        ("quarantine-action", is_["quarantine"] & ~action.isin("omit", "placeholder")),
        ("personal-action", is_["personal"] & ~action.isin("omit", "generalize", "aggregate")),
        ("restricted-action", is_["restricted"] & ~out & ~action.isin(*fixed.REDUCING_ACTIONS)),
        ("restricted-review", is_["restricted"] & ~out & (review != "borderline-review")),
        ("restricted-bucket", is_["restricted"] & ~out & (bucket != "individual-review")),
        ("restricted-destination", is_["restricted"] & ~out & ~sent),
        ("shareable-action", is_["shareable"] & ~action.isin(*fixed.SHAREABLE_ACTIONS)),
        ("low-confidence-review", (c["confidence"] == "low") & cls.isin("shareable", "restricted") & (review != "borderline-review")),
        ("borderline-bucket", (((c["confidence"] == "low") & cls.isin("shareable", "restricted")) | (review == "borderline-review")) & (bucket != "individual-review")),
        ("safe-class", (bucket == "safe") & (cls != "shareable")),
        ("safe-review", (bucket == "safe") & (review != "approved")),
        ("safe-confidence", (bucket == "safe") & (c["confidence"] != "high")),
        ("safe-destination", (bucket == "safe") & ~sent),
        ("safe-action", (bucket == "safe") & action.isin("omit", "placeholder")),
        ("individual-review-state", (bucket == "individual-review") & (review != "borderline-review")),
        ("individual-review-destination", (bucket == "individual-review") & ~sent),
        ("individual-review-action", (bucket == "individual-review") & ~action.isin(*fixed.REDUCING_ACTIONS)),
    ]
    for k in ("quarantine", "personal"):
        rules += [(f"{k}-review", is_[k] & (review != "blocked")), (f"{k}-bucket", is_[k] & ~out), (f"{k}-destination", is_[k] & sent)]
    for k in ("restricted", "shareable"):
        rules += [(f"{k}-excluded-action", is_[k] & out & ~waived[k] & (action != "omit")), (f"{k}-excluded-review", is_[k] & out & ~waived[k] & (review != "blocked")), (f"{k}-excluded-destination", is_[k] & out & sent)]
    by_entry = whole.select("ledger_id", F.col("id").alias("block_id"), F.explode(_rules(rules)).alias("rule"))
    no_object = rows.where("entry is null").select("ledger_id", F.format_string("$entry-%d", "i").alias("block_id"), F.lit("entry-object").alias("rule"))
    usable_end = F.when(usable, c["end"] + 1)
    reached = rows.groupBy("ledger_id", "n_lines").agg(F.coalesce(F.max(usable_end), F.lit(1)).alias("frontier"))
    tail = reached.where("frontier <= n_lines").select("ledger_id", F.lit("$ledger").alias("block_id"), F.lit("source-coverage-gap").alias("rule"))
    return document_errors(parsed, taxonomy).union(by_entry).union(no_object).union(tail).distinct()


def blocked_blocks(ledgers: DataFrame, sources: DataFrame, errors: DataFrame) -> DataFrame:
    """ledger_id, blocks: sorted ids of quarantine entries of ledgers without errors."""
    rows = read_entries(parse(ledgers, sources)).where(F.col("class") == "quarantine").select("ledger_id", "id")
    rows = rows.join(errors.select("ledger_id").distinct(), "ledger_id", "left_anti")
    return rows.groupBy("ledger_id").agg(F.array_sort(F.collect_list("id")).alias("blocks"))


def exit_codes(ledgers: DataFrame, errors: DataFrame, blocked: DataFrame) -> DataFrame:
    """ledger_id, exit_code: 2 with errors, 3 if valid but quarantined, else 0."""
    bad = errors.groupBy("ledger_id").agg(F.count("*").alias("n"))
    out = ledgers.select("ledger_id").join(bad, "ledger_id", "left").join(blocked, "ledger_id", "left")
    return out.select("ledger_id", F.when(F.col("n") > 0, 2).when(F.col("blocks").isNotNull(), 3).otherwise(0).alias("exit_code"))
