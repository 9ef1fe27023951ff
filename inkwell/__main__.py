"""Command line: search, lint, scan, ledger, new-page, bootstrap, gate, brief.

Exit codes: 0 clean, 1 could not run, 2 findings or errors, 3 a valid ledger with quarantined blocks.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from datetime import date
from pathlib import Path, PurePath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import gate, ledger, lint, scan, search
from .plans import report
from .sources import files


def _session() -> SparkSession:
    return SparkSession.builder.appName("inkwell").getOrCreate()


def run_search(a) -> int:
    spark = _session()
    pages = files.search_pages(files.list_tree(spark, a.root), files.configured_families(a.config or files.find_config([a.root], fixed.CONFIG_NAME)))
    head, body = search.parse_page(F.col("text"))
    pages = pages.select("path", "family", "slug", head.alias("h"), body.alias("body"))
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.col("h")["title"], '^"|"$', "")), F.lit("")), F.element_at(F.split("slug", "/"), -1))
    tags = search.parse_tags(F.coalesce(F.col("h")["tags"], F.lit("")))
    docs = pages.select(F.col("path").alias("doc"), "family", title.alias("title"), tags.alias("tags"), search.headings(F.col("body")).alias("headings"), "body")
    found = search.search(search.build_index(docs), a.query, a.top)
    rows = [r.line for r in search.render(found).collect()] if a.format == "text" else [r.json for r in found.select(F.to_json(F.struct("doc", "matched", "score", "title")).alias("json")).collect()]
    print("\n".join(rows) or "no matches")
    return 0


def _real_day(said: str) -> bool:
    try:
        return date.fromisoformat(said).isoformat() == said
    except ValueError:
        return False


def _corpus(spark: SparkSession, root: str, config: dict, day: str):
    tree = files.list_tree(spark, root).persist()
    pages = lint.parse(files.content_pages(tree, config["page_families"])).persist()
    log = tree.where("path = 'LOG.md'").select(files.lint_text(F.col("content")).alias("text"))
    corpus = lint.Corpus(pages, files.index_documents(tree, config["index"]), tree.select("path"), config, day)
    return corpus, files.inbox(tree), files.last_log_entry(log).first()[0], (pages, tree)


def run_lint(a) -> int:
    if not _real_day(a.today):
        print(f"not a day: {a.today}", file=sys.stderr)
        return 1
    if not Path(a.root).is_dir():
        print(f"no such folder: {a.root}", file=sys.stderr)
        return 1
    shape = "brief" if a.brief else a.format
    try:
        config = files.load_config(a.config or files.find_config([a.root], fixed.CONFIG_NAME))
    except files.ConfigError as e:
        bad = report.config_error(str(e))
        print({"json": report.as_json, "brief": report.brief, "text": lambda x: report.as_text(x, a.today)}[shape](bad))
        return 1
    corpus, inbox, last, kept = _corpus(_session(), a.root, config, a.today)
    if shape == "brief":
        # Counts are enough, so no finding leaves the cluster.
        counts = report.counted(corpus, inbox, last)
        print(report.counted_brief(counts))
        code = 2 if counts["errors"] else 0
    else:
        r = report.build(corpus, [x.path for x in inbox.collect()], last)
        print(report.as_json(r) if shape == "json" else report.as_text(r, a.today))
        code = report.exit_code(r)
    for df in kept:
        df.unpersist()
    return code


def run_brief(a) -> int:
    """The state of a wiki for the start of a session: a wiki that can't be read is no reason to stop."""
    try:
        argv = ["lint", "--wiki-root", str(Path(a.project, "wiki")), "--brief"]
        config = Path(a.project, fixed.CONFIG_NAME)
        main([*argv, "--config", str(config)] if config.is_file() else argv)
    except Exception as e:  # noqa: BLE001
        print(f"no brief ({type(e).__name__})", file=sys.stderr)
    return 0


def _below(path: str, folder: Path) -> str | None:
    """The path from the folder, if it is below it."""
    at = Path(path).resolve()
    return at.relative_to(folder.resolve()).as_posix() if at.is_relative_to(folder.resolve()) else None


def run_scan(a) -> int:
    if a.path_hint and not a.stdin or a.allowlist and a.no_allowlist or not a.files and not a.stdin:
        print("give files or --stdin; --path-hint goes with --stdin, and --allowlist not with --no-allowlist", file=sys.stderr)
        return 2
    spark = _session()
    config = files.find_config([Path.cwd(), *[Path(p).resolve().parent for p in [*a.files, *([a.path_hint] if a.path_hint else [])]]], fixed.CONFIG_NAME)
    home = config.parent if config else Path.cwd()
    try:
        allow = None if a.no_allowlist else files.load_allowlist(spark, a.allowlist or (config and files.configured_allowlist(config)))
    except files.AllowlistError as e:
        print(e, file=sys.stderr)
        return 1
    rows = [(n, p, _below(p, home), Path(p).read_bytes() if Path(p).is_file() else None) for n, p in enumerate(a.files)]
    # Keyed by number too, as a path may be given twice.
    given = spark.createDataFrame(rows, "n int, given string, below string, content binary")
    records = scan.scan_files(given.select(F.concat_ws("\x1f", F.col("n").cast("string"), "given").alias("path"), "content"))
    names = [(f"{n}\x1f{p}", p, p, b) for n, p, b, _ in rows]
    if a.stdin:
        said = scan.scan_stdin(spark.createDataFrame([(sys.stdin.read(),)], "text string")).withColumn("path", F.lit(f"{len(rows)}\x1f{fixed.STDIN}"))
        records = records.union(said)
        names.append((f"{len(rows)}\x1f{fixed.STDIN}", fixed.STDIN, a.path_hint, _below(a.path_hint, home) if a.path_hint else None))
    # As many rows as files were named on the command line.
    names = F.broadcast(spark.createDataFrame(names, "path string, shown string, listed string, below string"))
    if allow is not None:
        records = scan.apply_allowlist(records, allow, names)
    records = records.join(names, "path").withColumn("n", F.substring_index("path", "\x1f", 1).cast("int")).withColumn("path", F.col("shown"))
    columns = [c for c in ("path", "status", "findings", "source", "allowed") if c in records.columns]
    found = [json.loads(r.json) for r in scan.as_json(records.orderBy("n").select(*columns)).collect()]
    code = max(({"blocked": 2, "error": 1}.get(r["status"], 0) for r in found), default=0)
    status = {2: "blocked", 1: "error", 0: "pass"}[code]
    if a.format == "json":
        print(json.dumps({"status": status, "files": found}, ensure_ascii=False, sort_keys=True))
        return code
    lines = [] if a.quiet else [f"privacy preflight: {status}"]
    for r in found:
        if not a.quiet or r["status"] in ("blocked", "error"):
            lines += scan.text_lines(r)
    if lines:
        print("\n".join(lines))
    return code


def _say(a, status: str, text: str, **more) -> None:
    print(json.dumps({"status": status, **more}, sort_keys=True) if a.format == "json" else text)


def run_ledger(a) -> int:
    said = {}
    for name, place in (("ledger", a.ledger), ("source", a.source)):
        try:
            said[name] = Path(place).read_text(encoding="utf-8")
            if name == "ledger":
                json.loads(said[name])
        except (OSError, ValueError):
            _say(a, "error", f"privacy ledger: error ({name}-unreadable)", error=f"{name}-unreadable")
            return 1
    try:
        settings = files.ledger_settings(a.config, Path(a.ledger).resolve().parent)
    except files.ConfigError:
        _say(a, "error", "privacy ledger: error (config-unreadable)", error="config-unreadable")
        return 1
    spark = _session()
    ledgers, sources = spark.createDataFrame([("it", said["ledger"])], "ledger_id string, json string"), spark.createDataFrame([("it", said["source"])], "ledger_id string, text string")
    destinations = sorted({*settings["destinations"], *a.destination})
    errors = ledger.validate(ledgers, sources, destinations, settings["taxonomy"]).persist()
    found = [{"block_id": r.block_id, "rule": r.rule} for r in errors.orderBy("block_id", "rule").collect()]
    if found:
        _say(a, "invalid", "\n".join(["privacy ledger: invalid", *[f"- {e['block_id']}: {e['rule']}" for e in found]]), errors=found)
        return 2
    blocked = [b for r in ledger.blocked_blocks(ledgers, sources, errors).collect() for b in r.blocks]
    if blocked:
        _say(a, "blocked", "\n".join(["privacy ledger: blocked", *[f"- {b}: quarantine" for b in blocked]]), blocked_blocks=blocked)
        return 3
    _say(a, "valid", "privacy ledger: valid")
    return 0


def run_new_page(a) -> int:
    spark = _session()
    families = files.configured_families(a.config or files.find_config([Path.cwd()], fixed.CONFIG_NAME))
    kind = families.get(a.family)
    slug_ok = spark.sql("SELECT 1").select(gate.valid_slug(F.lit(a.slug))).first()[0]
    # A day is checked for its shape only.
    tests = {
        f"family {a.family} (known: {', '.join(sorted(families))})": kind is not None,
        f"page type {kind}, which has no template": kind is None or kind in fixed.TITLE_PLACES,
        "title": bool(a.title),
        f"slug {a.slug}": slug_ok,
        f"reliability {a.reliability}": a.reliability in fixed.RELIABILITY,
        f"sensitivity {a.sensitivity}": a.sensitivity in fixed.SENSITIVITY,
        f"day {a.today}": bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", a.today)),
    }
    template, target = Path(a.root, "_templates", f"{kind}.md"), Path(a.root, a.family, f"{a.slug}.md")
    if all(tests.values()):
        tests = {f"template {template}": template.is_file(), f"existing page {target}": a.dry_run or a.force or not target.exists()}
    if not all(tests.values()):
        print("not usable: " + "; ".join(x for x, good in tests.items() if not good), file=sys.stderr)
        return 1
    tags = [t.strip() for t in a.tags.split(",") if t.strip()]
    row = (template.read_bytes().decode("utf-8"), kind, a.title, a.today, tags, a.reliability, a.sensitivity, a.source)
    request = spark.createDataFrame([row], "template string, page_type string, title string, day string, tags array<string>, reliability string, sensitivity string, sources array<string>")
    text = gate.new_pages(request).first().text
    if a.dry_run:
        print(text, end="")
        return 0
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    print(target)
    return 0


def run_bootstrap(a) -> int:
    """Fill a copy's marks and make its drop folders; a second run finds nothing to do."""
    root = Path(a.repo)
    owner = a.owner or input("owner: ").strip()
    if not owner or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", a.start_date):
        print("needs an owner and a start day", file=sys.stderr)
        return 1
    there = [(n, (root / n).read_bytes().decode("utf-8")) for n in fixed.MARKED_FILES if (root / n).is_file()]
    done = [r for r in gate.fill_marks(_session().createDataFrame(there, "path string, text string"), owner, a.start_date).collect() if r.changed]
    for r in done:
        (root / r.path).write_bytes(r.text.encode("utf-8"))
    config = root / fixed.CONFIG_NAME
    try:
        staging = files.load_config(config)["privacy"]["staging_dir"]
    except files.ConfigError:
        staging = fixed.STAGING_DIR
    folders = [d for d in (root / staging, root / "wiki" / "raw" / "inbox") if not d.is_dir()]
    for d in folders:
        d.mkdir(parents=True)
    print("marks: " + (", ".join(r.path for r in done) or "already filled"))
    print("folders: " + (", ".join(PurePath(d).relative_to(root).as_posix() for d in folders) or "already there"))
    return 0


def run_gate(a) -> int:
    """Judge one write, told as JSON on standard input: 0 allows and 2 blocks; 1 is an error, which allows."""
    try:
        raw = sys.stdin.read()
        if not raw.strip():
            return 0
        said = json.loads(raw)
        spark = _session()
        project = Path(said.get("cwd") or Path.cwd()).resolve()
        config = files.find_config([project], fixed.CONFIG_NAME)
        allow = files.load_allowlist(spark, config and files.configured_allowlist(config))
        target = (said.get("tool_input") or {}).get("file_path")
        if target:
            said["tool_input"]["file_path"] = _below(str(project / target), project) or str(target)
        events = gate.parse_events(spark.createDataFrame([(1, json.dumps(said))], "event_id long, json string"))
        verdict = gate.judge(events, allow).first()
        for f in verdict.findings:
            print(f"blocked: {f.category}/{f.reason_code} at line {f.line} of the new text (not shown)", file=sys.stderr)
        if verdict.reason == "raw-path":
            print("blocked: files below raw are not edited", file=sys.stderr)
        return verdict.verdict
    except Exception as e:  # noqa: BLE001
        print(f"gate: {type(e).__name__}, the write is allowed", file=sys.stderr)
        return 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkwell")
    sub = p.add_subparsers(required=True)

    def command(name, run):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        return c

    c = command("search", run_search)
    c.add_argument("query")
    c.add_argument("--top", type=int, default=10)
    c.add_argument("--format", choices=("text", "json"), default="text")
    d = command("lint", run_lint)
    d.add_argument("--today", default=date.today().isoformat())
    d.add_argument("--format", choices=("text", "json", "brief"), default="text")
    d.add_argument("--brief", action="store_true")
    n = command("new-page", run_new_page)
    for x in (c, d, n):
        x.add_argument("--wiki-root", "--root", dest="root", default="wiki")
        x.add_argument("--config")
    for name in ("family", "slug"):
        n.add_argument(name)
    n.add_argument("--title")
    n.add_argument("--tags", default="")
    n.add_argument("--today", default=date.today().isoformat())
    n.add_argument("--source", action="append", default=[])
    n.add_argument("--reliability", default="medium")
    n.add_argument("--sensitivity", default="personal")
    n.add_argument("--force", action="store_true")
    n.add_argument("--dry-run", action="store_true")
    c = command("scan", run_scan)
    c.add_argument("files", nargs="*")
    c.add_argument("--stdin", action="store_true")
    c.add_argument("--path-hint")
    c.add_argument("--allowlist")
    c.add_argument("--no-allowlist", action="store_true")
    c.add_argument("--format", choices=("text", "json"), default="text")
    c.add_argument("--quiet", action="store_true")
    c = command("ledger", run_ledger)
    c.add_argument("ledger")
    c.add_argument("--source", required=True)
    c.add_argument("--config")
    c.add_argument("--destination", action="append", default=[])
    c.add_argument("--format", choices=("text", "json"), default="text")
    c = command("bootstrap", run_bootstrap)
    c.add_argument("--repo", default=".")
    c.add_argument("--owner")
    c.add_argument("--start-date", default=date.today().isoformat())
    command("gate", run_gate)
    command("brief", run_brief).add_argument("--project", default=".")
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
