"""Sensitive-content scan without disclosure, allowlists, and status roll-up.

Findings carry category, reason and line, never text.  The line pass needs no
shuffle: all patterns are tested where the line is, and the two-line window is
an array zip.  Results never select the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

FINDING = "array<struct<category:string,reason_code:string,line:int>>"

#: Words that a denylist can name, and the start of a home folder's path.
TOKEN = r"[A-Za-z][A-Za-z0-9]{3,}"
HOME_PATH = r"/Users/[A-Za-z]|/home/[A-Za-z]"


def java(pattern: str, ignore_case: bool) -> str:
    """The pattern with Unicode classes and word borders that agree with them."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern.replace(r"\b", text.BORDER)


PATTERNS = {code: (category, java(p, fold)) for category, code, p, fold in fixed.PATTERNS}
#: Literals of which any match of the pattern holds one, case folded: a cheap test before the costly one.
HINTS = {
    "private-key": ("private key",),
    "credential-connection-string": ("://",),
    "jwt": ("eyj",),
    "bearer-token": ("bearer",),
    "known-secret-token": ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk_live_"),
    "labelled-secret": ("passw", "key", "secret", "token"),
    "labelled-recovery-material": ("seed", "recovery", "mnemonic"),
    "labelled-high-risk-identifier": ("passport", "national", "residence", "tax", "social", "ssn", "cpr"),
    "card-security-code": ("cvv", "cvc"),
    "explicit-no-record-en": ("record", "notes", "minute", "noted", "down", "between us", "anyone", "wiki", "summary", "transcript"),
    "explicit-no-record-ru": ("никому не говори", "между нами", "не записыва", "не заноси"),
    "explicit-no-record-da": ("skriv ikke", "mellem os", "til nogen"),
    "control-bypass": ("bypass", "evade", "circumvent", "disable"),
    "prompt-injection": ("ignore", "disregard", "override"),
    "exfiltration-instruction": ("upload", "send", "post", "paste", "forward"),
}


def folded(line: Column) -> Column:
    """Lower case, with the letters that fold to i, s and k beyond it."""
    return F.lower(F.translate(line, "\u0131\u0130\u017f\u212a", "iisk"))


def matches(line: Column, fold: Column, code: str) -> Column:
    hint = F.lit(False)
    for h in HINTS[code]:
        hint = hint | fold.contains(h)
    return hint & line.rlike(PATTERNS[code][1])


def has_card(line: Column) -> Column:
    """A run of 13 to 19 digits that passes Luhn."""
    found = F.regexp_extract_all(line, F.lit("(?U)" + fixed.PAN), F.lit(0))
    return line.rlike(r"[0-9](?:[ -]?[0-9]){12}") & F.exists(found, lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", "")) & F.length(F.regexp_replace(c, "[^0-9]", "")).between(13, 19))


def iban_valid(candidate: Column) -> Column:
    """15 to 34 characters whose rearranged number is 1 modulo 97."""
    v = F.upper(F.replace(candidate, F.lit(" "), F.lit("")))
    turned = F.concat(v.substr(F.lit(5), F.length(v)), F.substring(v, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(
        chars,
        F.lit(0),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (rest == 1)


def has_iban(line: Column) -> Column:
    return line.rlike(r"[A-Za-z]{2}[0-9]{2}") & F.exists(F.regexp_extract_all(line, F.lit(java(fixed.IBAN, True)), F.lit(0)), iban_valid)


def findings_of(lines: Column) -> Column:
    """Distinct findings of normalised lines, ordered by category, reason and line."""

    def found(category: str, code: str, n: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(code).alias("reason_code"), n.cast("int").alias("line"))

    def of_line(x: Column, i: Column) -> Column:
        tests = [F.when(matches(x["line"], x["fold"], code), found(category, code, i + 1)) for code, (category, _) in PATTERNS.items()]
        tests += [F.when(has_card(x["line"]), found("high-risk-identifier", "payment-card-pan", i + 1)), F.when(has_iban(x["line"]), found("high-risk-identifier", "iban", i + 1))]
        return F.array_compact(F.array(*tests))

    with_fold = F.transform(lines, lambda line: F.struct(line.alias("line"), folded(line).alias("fold")))
    single = F.flatten(F.transform(with_fold, of_line))
    less = F.greatest(F.size(lines) - 1, F.lit(0))
    both = F.zip_with(F.slice(lines, F.lit(1), less), F.slice(lines, F.lit(2), less), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.concat(a, F.lit(" "), b).alias("line")))
    both = F.transform(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["line"].alias("line"), folded(x["line"]).alias("fold")))

    def of_pair(x: Column, i: Column) -> Column:
        # Only where neither line matches alone.
        return F.array_compact(
            F.array(*[F.when(matches(x["line"], x["fold"], c) & ~x["a"].rlike(PATTERNS[c][1]) & ~x["b"].rlike(PATTERNS[c][1]), found(PATTERNS[c][0], c, i + 1)) for c in fixed.TWO_LINE_CODES])
        )

    pairs = both
    return F.array_sort(F.array_distinct(F.concat(single, F.flatten(F.transform(pairs, of_pair)))))


def source_binding(content: Column) -> Column:
    """Line count and hash of the text as it is."""
    return F.struct(F.size(text.split_lines(content)).alias("line_count"), F.sha2(content, 256).alias("sha256"))


def read_status(path: Column, content: Column) -> Column:
    """Why a file is not scanned (null if it is): skipped by name, NUL bytes or blankness, error if it is not UTF-8."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    sniff = F.substring(content, 1, fixed.BINARY_SNIFF_BYTES)
    as_text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
    return (
        F.when(suffix.isin(*fixed.BINARY_EXTENSIONS), "skipped")
        .when(content.isNull(), "error")
        .when(F.position(F.unhex(F.lit("00")), sniff) > 0, "skipped")
        .when(as_text.isNull(), "error")
        .when(text.is_blank(as_text), "skipped")
    )


def scan_files(files: DataFrame) -> DataFrame:
    """files(path, content binary) -> path, status, findings, source."""
    why = read_status(F.col("path"), F.col("content"))
    rows = files.select("path", why.alias("why"), F.when(why.isNull(), F.decode("content", "UTF-8")).alias("text"))
    return _records(rows)


def scan(docs: DataFrame) -> DataFrame:
    """docs(path, text) -> path, status (blocked, pass, skipped), findings, source."""
    return _records(docs.select("path", "text", F.when(F.col("text").isNull(), "error").when(text.is_blank(F.col("text")), "skipped").alias("why")))


def scan_stdin(docs: DataFrame) -> DataFrame:
    """Pseudo-files: blank input is an error."""
    return _records(docs.select(F.lit(fixed.STDIN).alias("path"), "text", F.when(text.is_blank(F.coalesce("text", F.lit(""))), "error").alias("why")))


def _records(rows: DataFrame) -> DataFrame:
    # Normalisation is by line, after splitting; only it leaves the JVM.
    read = F.when(F.col("why").isNull(), F.col("text")).otherwise("")
    rows = text.once(rows, plain=text.split_lines(read))
    rows = text.once(rows.withColumn("lines", text.nfkc(F.col("plain"), read)), findings=findings_of(F.col("lines")))
    status = F.coalesce("why", F.when(F.size("findings") > 0, "blocked").otherwise("pass"))
    return rows.select("path", status.alias("status"), "findings", F.when(F.col("why").isNull(), source_binding(F.col("text"))).alias("source"))


def findings(records: DataFrame) -> DataFrame:
    """path, category, reason_code, line."""
    return records.select("path", F.inline("findings"))


def explode_allowlist(entries: DataFrame) -> DataFrame:
    """entries(path, sha256, reason_codes) -> distinct (path, sha256, reason_code)."""
    return entries.select("path", "sha256", F.explode("reason_codes").alias("reason_code")).distinct()


def apply_allowlist(records: DataFrame, entries: DataFrame, names: Column | DataFrame | None = None) -> DataFrame:
    """records with findings split into kept and allowed.

    A finding is allowed by path, hash of the current text, and reason.  The
    path is that of the record, or ``names``: another one for each record (a
    column, or a column over records beside their own path), or a table (path,
    listed, below) of the only ones it goes by.  Only blocked records meet the
    list.
    """
    allow = explode_allowlist(entries).groupBy("path", "sha256").agg(F.collect_set("reason_code").alias("codes"))
    blocked = records.where("status = 'blocked'")
    if isinstance(names, DataFrame):
        # Inner names are few: a row for each file of a command line.
        paths = F.array_distinct(F.array_compact(F.array("listed", "below")))
        blocked = blocked.join(names, "path")
    else:
        paths = F.array_distinct(F.array(F.col("path"), *([F.coalesce(names, F.col("path"))] if names is not None else [])))
    keys = blocked.select(F.col("path").alias("of"), F.explode(paths).alias("path"), F.col("source.sha256").alias("sha256"))
    codes = keys.join(allow, ["path", "sha256"]).groupBy("of").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    out = records.join(codes, F.col("path") == F.col("of"), "left").withColumn("codes", F.when(F.col("status") == "blocked", F.col("codes")))
    none = text.no_strings()
    kept = F.filter("findings", lambda x: ~F.array_contains(F.coalesce("codes", none), x["reason_code"]))
    allowed = F.filter("findings", lambda x: F.array_contains(F.coalesce("codes", none), x["reason_code"]))
    status = F.when(F.col("status") != "blocked", F.col("status")).when(F.size(kept) > 0, "blocked").otherwise("pass")
    return out.select("path", status.alias("status"), kept.alias("findings"), "source", allowed.alias("allowed"))


def overall_status(records: DataFrame) -> DataFrame:
    """One row: blocked before error before pass; skipped files don't count."""
    rank = F.when(F.col("status") == "blocked", 2).when(F.col("status") == "error", 1).otherwise(0)
    top = records.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"))
    return top.select(F.when(F.col("r") == 2, "blocked").when(F.col("r") == 1, "error").otherwise("pass").alias("status"), F.when(F.col("r") == 2, 2).when(F.col("r") == 1, 1).otherwise(0).alias("exit_code"))


def token_digest(token: Column) -> Column:
    """What a denylist holds instead of a token: the start of the hash of its lower-case form."""
    return F.left(F.sha2(F.lower(token), 256), F.lit(16))


def denied_tokens(docs: DataFrame, denied: DataFrame) -> DataFrame:
    """docs(path, text), denied(digest) -> path, digest of each distinct token of the whole text that is denied; never the token."""
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.lower))
    found = docs.select("path", F.explode(tokens).alias("token")).select("path", token_digest(F.col("token")).alias("digest"))
    return found.join(F.broadcast(denied), "digest", "left_semi").select("path", "digest")


def home_path(content: Column) -> Column:
    """Whether a text holds the path of a user's home folder."""
    return content.rlike(HOME_PATH)


def visible_records(records: DataFrame, quiet: bool) -> DataFrame:
    """What a report shows: in quiet mode only blocked and error."""
    return records.where(F.col("status").isin("blocked", "error")) if quiet else records


def text_lines(record: dict) -> list[str]:
    """What a terminal shows of a record: its status, and where it is blocked, each finding."""
    allowed = len(record.get("allowed") or ())
    out = [f"- {record['path']}: {record['status']}" + (f" ({allowed} allowed by allowlist)" if allowed and record["status"] == "pass" else "")]
    if record["status"] == "blocked":
        out += [f"  - line {f['line']}: {f['category']}/{f['reason_code']}" for f in record["findings"]]
    return out


def as_json(records: DataFrame) -> DataFrame:
    """One JSON object for each record, fields in alphabetical order."""
    return records.select(F.to_json(F.struct(*sorted(records.columns))).alias("json"))
