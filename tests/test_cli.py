import hashlib
import io
import json

import pytest

from inkwell.__main__ import main

from .test_ledger import SOURCE, document
from .test_wiki import tree  # noqa: F401


@pytest.fixture
def said(monkeypatch):
    return lambda text: monkeypatch.setattr("sys.stdin", io.StringIO(text))


def test_search_and_lint(spark, tree, capsys):  # noqa: F811
    root = str(tree())
    assert main(["search", "ada", "--wiki-root", root]) == 0
    assert "entities/ada.md  — Ada" in capsys.readouterr().out
    assert main(["search", "zzz", "--root", root, "--format", "json"]) == 0
    assert capsys.readouterr().out == "no matches\n"
    assert main(["lint", "--root", root, "--today", "2026-01-01", "--brief"]) == 0
    counted = capsys.readouterr().out
    assert counted.startswith("Wiki: 4 pages")
    assert main(["lint", "--root", root + "/none"]) == 1
    assert main(["lint", "--root", root, "--today", "2026-02-30"]) == 1


def test_brief_is_that_of_the_whole_report(spark, tree, capsys):  # noqa: F811
    from inkwell.plans import report

    from .test_wiki import corpus

    c = corpus(spark, tree(**{"entities/bad.md": "see [[nowhere]]"}))
    whole = report.brief(report.build(c, ["raw/inbox/a"], "x"))
    inbox = spark.createDataFrame([("raw/inbox/a",)], "path string")
    assert report.counted_brief(report.counted(c, inbox, "x")) == whole and "broken_wikilinks 1" in whole


def test_scan(spark, tmp_path, capsys, said, monkeypatch):
    monkeypatch.chdir(tmp_path)
    good, bad = tmp_path / "a.md", tmp_path / "b.md"
    good.write_text("fine")
    bad.write_text("off the record")
    assert main(["scan", str(good)]) == 0
    assert main(["scan", str(tmp_path / "none")]) == 1
    capsys.readouterr()
    assert main(["scan", str(good), str(bad), str(bad), "--quiet"]) == 2
    out = capsys.readouterr().out
    assert out.splitlines() == [f"- {bad}: blocked", "  - line 1: explicit-no-record/explicit-no-record-en"] * 2
    said("off the record")
    assert main(["scan", str(good), "--stdin", "--format", "json"]) == 2
    told = json.loads(capsys.readouterr().out)
    assert told["status"] == "blocked" and [f["path"] for f in told["files"]] == [str(good), "<stdin>"]
    said(" ")
    assert main(["scan", "--stdin"]) == 1
    assert main(["scan"]) == 2 and main(["scan", str(good), "--path-hint", "x"]) == 2 and main(["scan", str(good), "--allowlist", "x", "--no-allowlist"]) == 2


def test_scan_finds_its_allowlist(spark, tmp_path, capsys, said, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "deep").mkdir()
    bad = tmp_path / "deep" / "b.md"
    bad.write_text("off the record")
    entry = {"path": "deep/b.md", "sha256": hashlib.sha256(b"off the record").hexdigest(), "reason_codes": ["explicit-no-record-en"], "approved_by": "me", "date": "2026-01-01"}
    (tmp_path / "wiki.config.json").write_text(json.dumps({"privacy": {"allowlist": "list.json"}}))
    (tmp_path / "list.json").write_text(json.dumps({"schema_version": 1, "entries": [entry]}))
    assert main(["scan", str(bad)]) == 0
    assert capsys.readouterr().out.splitlines() == ["privacy preflight: pass", f"- {bad}: pass (1 allowed by allowlist)"]
    assert main(["scan", str(bad), "--no-allowlist"]) == 2
    said("off the record")
    assert main(["scan", "--stdin", "--path-hint", "deep/b.md"]) == 0
    said("off the record")
    assert main(["scan", "--stdin"]) == 2
    event = {"tool_name": "Write", "cwd": str(tmp_path), "tool_input": {"file_path": str(bad), "content": "off the record"}}
    said(json.dumps(event))
    assert main(["gate"]) == 0
    (tmp_path / "list.json").write_text("{")
    assert main(["scan", str(bad)]) == 1
    said(json.dumps(event))
    assert main(["gate"]) == 1


def test_gate(spark, tmp_path, capsys, said):
    def judge(path, text, tool="Write"):
        said(json.dumps({"tool_name": tool, "cwd": str(tmp_path), "tool_input": {"file_path": path, "content": text}}))
        return main(["gate"])

    assert judge(str(tmp_path / "wiki/a.md"), "fine") == 0
    assert judge("wiki/a.md", "off the record") == 2
    err = capsys.readouterr().err
    assert "explicit-no-record-en at line 1" in err and "off the record" not in err
    assert judge("wiki/../wiki/raw/inbox/x", "fine") == 2 and judge("wiki/raw/x", "fine", "Read") == 0
    said("not json")
    assert main(["gate"]) == 1
    said("")
    assert main(["gate"]) == 0


def test_ledger(spark, tmp_path, capsys):
    (tmp_path / "s.txt").write_text(SOURCE)
    (tmp_path / "l.json").write_text(json.dumps(document()))
    args = ["ledger", str(tmp_path / "l.json"), "--source", str(tmp_path / "s.txt")]
    assert main([*args, "--destination", "team"]) == 3
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "privacy ledger: blocked" and all(x.startswith("- B0") and x.endswith(": quarantine") for x in lines[1:])
    assert main([*args, "--destination", "team", "--format", "json"]) == 3
    told = json.loads(capsys.readouterr().out)
    assert told == {"blocked_blocks": [x[2:].split(":")[0] for x in lines[1:]], "status": "blocked"}
    assert main(args) == 2
    assert capsys.readouterr().out.startswith("privacy ledger: invalid\n- ")
    (tmp_path / "c.json").write_text(json.dumps({"share": {"destinations": {"team": {}}}}))
    assert main([*args, "--config", str(tmp_path / "c.json")]) == 3
    assert main([*args, "--config", str(tmp_path / "none.json"), "--format", "json"]) == 1
    assert main(["ledger", "none", "--source", "none"]) == 1
    assert capsys.readouterr().out.endswith("privacy ledger: error (ledger-unreadable)\n")


def test_new_page(spark, tmp_path, capsys):
    (tmp_path / "_templates").mkdir()
    (tmp_path / "_templates" / "entity.md").write_text('title: "<entity name>"\ntags: []\n')
    args = ["new-page", "entities", "a/b", "--title", "T", "--wiki-root", str(tmp_path)]
    want = 'title: "T"\ntags: [x, y]\n'
    assert main([*args, "--dry-run", "--tags", "x, y"]) == 0 and capsys.readouterr().out == want
    assert main([*args, "--tags", "x,,y"]) == 0 and (tmp_path / "entities/a/b.md").read_text() == want
    assert main(args) == 1 and main([*args, "--force"]) == 0
    assert main(["new-page", "entities", "A", "--title", "T", "--root", str(tmp_path)]) == 1
    assert main(["new-page", "entity", "a", "--title", "T", "--root", str(tmp_path)]) == 1
    assert main(["new-page", "entities", "a", "--root", str(tmp_path)]) == 1
    assert main([*args, "--today", "x", "--force"]) == 1 and main([*args, "--today", "2026-13-01", "--force"]) == 0
    (tmp_path / "c.json").write_text(json.dumps({"page_families": {"people": "entity", "odd": "letter"}}))
    more = ["--title", "T", "--root", str(tmp_path), "--config", str(tmp_path / "c.json")]
    assert main(["new-page", "people", "ada", *more]) == 0 and (tmp_path / "people/ada.md").exists()
    assert main(["new-page", "odd", "ada", *more]) == 1


def test_bootstrap(spark, tmp_path, capsys):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "README.md").write_text("{{OWNER_NAME}} since {{START_DATE}}, {{OTHER}}")
    (tmp_path / "wiki" / "LOG.md").write_bytes(b"# Log\r\n{{START_DATE}}")
    (tmp_path / "notes.md").write_text("{{OWNER_NAME}}")
    args = ["bootstrap", "--repo", str(tmp_path), "--owner", "Ann", "--start-date", "2026-01-02"]
    assert main(args) == 0
    assert "README.md" in capsys.readouterr().out
    assert (tmp_path / "README.md").read_text() == "Ann since 2026-01-02, {{OTHER}}"
    assert (tmp_path / "wiki" / "LOG.md").read_bytes() == b"# Log\r\n2026-01-02"
    assert (tmp_path / "notes.md").read_text() == "{{OWNER_NAME}}" and (tmp_path / "wiki/raw/inbox").is_dir()
    assert main(args) == 0
    assert capsys.readouterr().out == "marks: already filled\nfolders: already there\n"
    assert main([*args, "--start-date", "soon"]) == 1
