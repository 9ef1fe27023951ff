"""Reports of a corpus: assembled on the driver from aggregated findings, as JSON, text, or a brief."""

from __future__ import annotations

import json

from ..functions import fixed
from ..operators import lint
from ..operators.lint import Corpus


def _rows(df) -> list[dict]:
    return sorted((json.loads(r) for r in df.toJSON().collect()), key=lambda r: json.dumps(r, sort_keys=True))


def build(c: Corpus, inbox: list[str] = (), last_log_entry: str | None = None) -> dict:
    """The whole report.  Findings are for people to read, so they come to the driver."""
    counts = {r["family"]: r["pages"] for r in lint.counts_per_family(c).collect()}
    ordered = {f: counts.get(f, 0) for f in c.config["page_families"]} | {"total": counts.get("total", 0)}
    found = {k: _rows(f(c)) for k, f in (lint.ERRORS | lint.WARNINGS).items()}
    scale = lint.scale(c).first().asDict() | c.config["scale_thresholds"] | {"directories": _rows(lint.directory_counts(c))}
    spread = {f"{n}_distribution": {r["value"]: r["pages"] for r in lint.distribution(c, n).collect()} for n in ("reliability", "sensitivity")}
    return {
        "caps": c.config["caps"],
        "counts": ordered,
        "pages": _rows(lint.page_summary(c)),
        "index_documents": sorted(r["path"] for r in c.indexes.select("path").collect()),
        "errors": {k: found.get(k, []) for k in fixed.ERROR_KINDS},
        "warnings": {k: found.get(k, []) for k in fixed.WARNING_KINDS},
        "info": {"counts": ordered, **spread, "inbox_files": sorted(inbox), "scale": scale, "last_log_entry": last_log_entry},
    }


def counted(c: Corpus, inbox, last_log_entry: str | None = None) -> dict:
    """What a brief tells, from aggregates alone: a row of each family and kind."""
    pages = {r["family"]: r["pages"] for r in lint.counts_per_family(c).collect()}
    kinds = sorted(lint.finding_counts(c).collect(), key=lambda r: r.position)
    by = {s: {r.kind: r.n for r in kinds if r.severity == s} for s in ("error", "warning")}
    counts = {f: pages.get(f, 0) for f in c.config["page_families"]} | {"total": pages.get("total", 0)}
    return {"counts": counts, "errors": by["error"], "warnings": by["warning"], "inbox": inbox.count(), "last": last_log_entry}


def config_error(message: str) -> dict:
    """A report of the usual shape for a configuration that cannot be used."""
    return {
        "caps": dict(fixed.CAPS), "counts": {"total": 0}, "pages": [], "index_documents": [],
        "errors": {k: [{"message": message}] if k == "config_invalid" else [] for k in fixed.ERROR_KINDS},
        "warnings": {k: [] for k in fixed.WARNING_KINDS},
        "info": {"counts": {"total": 0}, "reliability_distribution": {}, "sensitivity_distribution": {}, "inbox_files": [], "scale": {}, "last_log_entry": None},
    }


def totals(report: dict) -> tuple[int, int]:
    return tuple(sum(map(len, report[s].values())) for s in ("errors", "warnings"))


def exit_code(report: dict) -> int:
    """0 clean, 1 not run, 2 with errors."""
    return 1 if report["errors"]["config_invalid"] else 2 if totals(report)[0] else 0


def as_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True)


def _pages(report: dict) -> str:
    c = report["counts"]
    return f"{c['total']} pages ({', '.join(f'{n} {f}' for f, n in c.items() if f != 'total')})"


def _files(report: dict) -> str:
    return _waiting(len(report["info"]["inbox_files"]))


def _waiting(n: int) -> str:
    return f"{n} file{'' if n == 1 else 's'} in raw/inbox"


def brief(report: dict) -> str:
    some = {s: {k: len(v) for k, v in report[s].items() if v} for s in ("errors", "warnings")}
    return counted_brief({"counts": report["counts"], **some, "inbox": len(report["info"]["inbox_files"]), "last": report["info"]["last_log_entry"]})


def counted_brief(told: dict) -> str:
    sums = [f"{sum(told[s].values())} {s}" for s in ("errors", "warnings")]
    lines = [f"Wiki: {' · '.join([_pages(told), *sums, _waiting(told['inbox'])])}", f"Last log: {told['last'] or 'none'}"]
    lines += [f"{s.capitalize()}: {', '.join(f'{k} {n}' for k, n in told[s].items())}" for s in ("warnings", "errors") if told[s]]
    return "\n".join(lines) + "\n"


def finding_line(finding: dict) -> str:
    if "path" not in finding:
        return "- " + json.dumps(finding, ensure_ascii=False, sort_keys=True)
    place = finding["path"] + (f":{finding['line']}" if "line" in finding else "")
    rest = ", ".join(f"{k}={v!r}" for k, v in finding.items() if k not in ("path", "line"))
    return f"- {place}" + (f" — {rest}" if rest else "")


def as_text(report: dict, today: str) -> str:
    errors, warnings = totals(report)
    out = [f"# Wiki lint — {today}", "", "## Summary", _pages(report) + ".", f"{errors} errors, {warnings} warnings.", _files(report) + ".", ""]
    for section, n in (("errors", errors), ("warnings", warnings)):
        out.append(f"## {section.capitalize()}")
        if not n:
            out += [f"No {section}.", ""]
        for kind, rows in report[section].items():
            if rows:
                out += [f"### {kind}", *map(finding_line, rows), ""]
    info = report["info"]
    say = lambda x: json.dumps(x, sort_keys=True)
    scale = info["scale"]
    out += ["## Info", f"- Counts: {say(info['counts'])}", f"- Reliability distribution: {say(info['reliability_distribution'])}", f"- Sensitivity distribution: {say(info['sensitivity_distribution'])}", f"- Inbox files: {len(info['inbox_files'])}"]
    out.append(f"- Scale: {scale.get('total_pages', 0)} total pages (shard index at {scale.get('shard_index_at_pages')}, search step at {scale.get('search_step_at_pages')})")
    out.append(f"- Last log entry: {info['last_log_entry'] or 'none'}")
    return "\n".join(out) + "\n"
