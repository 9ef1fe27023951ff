import json
import math
import re

import pytest

from inkwell.operators import gate, lint, search
from inkwell.plans import report
from inkwell.sources import files
from inkwell.streaming import gates

PAGE = '---\ntitle: "{t}"\npage_type: {k}\nreliability: high\nsensitivity: public\nsources: ["raw/note.md"]\ncreated: 2025-12-01\nupdated: {u}\n---\n# {t}\n{b}\n'


def page(name, kind, body="See [[ada]].", updated="2025-12-30", **swap):
    out = PAGE.format(t=name, k=kind, u=updated, b=body)
    for field, value in swap.items():
        out = re.sub(rf"(?m)^{field}:.*\n", "" if value is None else f"{field}: {value}\n", out)
    return out


@pytest.fixture
def tree(tmp_path):
    base = {
        "sources/s.md": page("S", "source"), "entities/ada.md": page("Ada", "entity", "See [[s]] and [[c]]."), "concepts/c.md": page("C", "concept", "See [[y]]."), "synthesis/y.md": page("Y", "synthesis"),
        "raw/note.md": "note", "raw/inbox/.keep": "", "raw/inbox/new.txt": "x", "_templates/page.md": "[[nowhere]]", ".hidden": "x",
        "INDEX.md": "# Index\n- [[s]] one\n- [[ada]]\n", "INDEX-concepts.md": "* [[c]]\n", "INDEX-synthesis.md": "- [[synthesis/y]]\n", "LOG.md": "# Log\n## [2025-01-01] a | first\n## [2025-02-01] b | last \n",
    }

    def write(**more):
        for path, content in (base | {k.replace("__", "/"): v for k, v in more.items()}).items():
            p = tmp_path / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(content if isinstance(content, bytes) else content.encode())
        return tmp_path

    return write


def corpus(spark, root, today="2026-01-01"):
    f = files.list_tree(spark, root).cache()
    return lint.Corpus(lint.parse(files.content_pages(f)).cache(), files.index_documents(f), f.select("path"), files.load_config(root / "wiki.config.json"), today)


def found(c):
    return {k: [r.asDict(recursive=True) for r in f(c).collect()] for k, f in (lint.ERRORS | lint.WARNINGS).items() if not f(c).isEmpty()}


def test_clean(spark, tree):
    c = corpus(spark, tree())
    assert found(c) == {}
    f = files.list_tree(spark, tree())
    log = f.where("path = 'LOG.md'").selectExpr("decode(content, 'UTF-8') as text")
    r = report.build(c, [x.path for x in files.inbox(f).collect()], files.last_log_entry(log).first()[0])
    assert r["info"]["inbox_files"] == ["raw/inbox/new.txt"] and r["info"]["last_log_entry"] == "[2025-02-01] b | last"
    assert report.exit_code(r) == 0 and report.brief(r).startswith("Wiki: 4 pages (1 sources, 1 entities, 1 concepts, 1 synthesis) · 0 errors · 0 warnings · 1 file in raw/inbox\nLast log: [2025-02-01] b | last\n")
    text = report.as_text(r, "2026-01-01")
    assert "No errors." in text and "\n\n\n" not in text and json.loads(report.as_json(r))["counts"]["total"] == 4
    assert {r.value: r.pages for r in lint.distribution(c, "reliability").collect()} == {"high": 4, "medium": 0, "low": 0, "unknown": 0}


def test_findings(spark, tree):
    more = {
        "entities__bad.md": page("Bad", "bogus", "[[gone]] `[[code]]` [[.hidden]] [[_templates/page]] [[note]]\n```\n[[fenced]]\n```\n<Fill me> {{NAME}}", title=None, reliability="great", created="2025-02-30"),
        "entities__unknown.md": page("U", "entity", "[[bad]]", reliability="unknown", sources='["raw/none.md", "wiki/raw/note.md)."]'),
        "concepts__ada.md": page("Ada 2", "concept", '[[unknown]]\n  - "sources/x"\n~~~\n  - "raw/y"\n'),
        "sources__old.md": page("Old", "source", "[[old]]\n## Pending Review\n<none>\n- <none>\nclaim\n## Next", updated="2025-01-01", reliability="low"),
        "sources__long.md": page("Long", "source", "x\n" * 900),
        "sources__raw__skip.md": "no header", "sources__README.md": "no header", "concepts__bytes.md": b"\xff\xfe",
        "INDEX.md": "# Index\n- [[s]] one\n- [[ada]]\n- [[bad]]\n- [[bad]] again\n- see [[old]]\n",
    }
    got = found(corpus(spark, tree(**more)))
    paths = {k: sorted({r.get("path") or r["slug"] for r in v}) for k, v in got.items()}
    assert {r["path"]: r["missing"] for r in got["missing_frontmatter"]}["entities/bad.md"] == ["title"]
    assert paths["missing_frontmatter"] == ["concepts/bytes.md", "entities/bad.md"]
    assert sorted((r["field"], r["value"]) for r in got["invalid_enum"]) == [("page_type", "bogus"), ("reliability", "great")]
    assert got["page_type_mismatches"] == [{"path": "entities/bad.md", "expected": "entity", "actual": "bogus"}]
    assert got["invalid_date"] == [{"path": "entities/bad.md", "field": "created", "value": "2025-02-30"}]
    assert [(r["path"], r["target"], r["line"]) for r in got["broken_wikilinks"]] == [("entities/bad.md", "gone", 10)]
    assert got["broken_source_references"] == [{"path": "entities/unknown.md", "reference": "raw/none.md"}]
    assert got["duplicate_slugs"] == [{"slug": "ada", "paths": ["concepts/ada.md", "entities/ada.md"]}]
    assert got["frontmatter_leaked_into_body"] == [{"path": "concepts/ada.md", "line": 12}]
    assert paths["hard_cap_exceeded"] == paths["soft_cap_exceeded"] == ["sources/long.md"]
    assert [(r["slug"], [o["line"] for o in r["occurrences"]]) for r in got["duplicate_index_entries"]] == [("bad", [4, 5])]
    assert paths["missing_index_entries"] == ["concepts/bytes.md", "entities/unknown.md", "sources/long.md", "sources/old.md"]
    assert paths["orphans"] == ["concepts/bytes.md", "sources/long.md", "sources/old.md"]
    assert paths["stale_low_reliability"] == paths["stale_pending_review"] == paths["cold_pages"] == ["sources/old.md"]
    assert [r["matches"] for r in got["template_placeholders"] if r["path"] == "entities/bad.md"] == [["<Fill me>", "{{NAME}}"]]
    r = report.build(corpus(spark, tree(**more)))
    assert report.exit_code(r) == 2 and "### broken_wikilinks\n- entities/bad.md:10 — " in report.as_text(r, "2026-01-01")
    counts = {x.kind: x.n for x in lint.finding_counts(corpus(spark, tree(**more))).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_config(tmp_path):
    path = tmp_path / "wiki.config.json"
    assert files.load_config(path)["caps"]["hard_lines"] == 800
    path.write_text(json.dumps({"caps": {"soft_lines": 5}, "page_families": {"notes": "note"}, "other": 1}))
    assert files.load_config(path)["caps"] == {"soft_lines": 5, "hard_lines": 800} and files.load_config(path)["page_families"] == {"notes": "note"}
    for bad in ("{", "[]", '{"caps": 3}', '{"caps": {"soft_lines": true}}', '{"caps": {"soft_lines": "5"}}', '{"page_families": {}}'):
        path.write_text(bad)
        with pytest.raises(files.ConfigError):
            files.load_config(path)
    assert report.exit_code(report.config_error("bad")) == 1
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert files.find_config([tmp_path / "a" / "b"], "wiki.config.json") == path and files.find_config([tmp_path], "none.json") is None


def bm25(docs, query):
    def toks(t):
        return [x[:-1] if len(x) > 4 and x.endswith("s") else x for x in re.findall(r"\w+", t.lower()) if len(x) >= 2]

    fields = {}
    for i, _, title, tags, heads, body in docs:
        fields[i] = toks(title) * 3 + [t for x in tags for t in toks(x)] * 2 + [t for x in heads for t in toks(x)] * 2 + toks(body)
    avg = sum(map(len, fields.values())) / len(fields)
    out = {}
    for i, own in fields.items():
        s = 0
        for t in dict.fromkeys(toks(query)):
            df = sum(t in x for x in fields.values())
            tf = own.count(t)
            if tf:
                s += math.log(1 + (len(fields) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / avg))
        if s > 0:
            out[i] = s
    return out


def test_search(spark, tmp_path):
    docs = [("a/x", "a", "Cats", ["pets"], ["House"], "cats and houses"), ("a-b/y", "a", "Dog", [], [], "кот and cats"), ("b/z", "b", "", [], [], ""), ("a/w", "a", "Cats", ["pets"], ["House"], "cats and houses")]
    df = spark.createDataFrame(docs, "doc string, family string, title string, tags array<string>, headings array<string>, body string")
    idx = search.build_index(df)
    idx.write(str(tmp_path / "index"))
    for index in (idx, search.SearchIndex.read(spark, str(tmp_path / "index"))):
        for q in ("cat house", "КОТ", "x", "", "and and pets"):
            want = bm25(docs, q)
            got = search.search(index, q).collect()
            assert {r.doc: pytest.approx(r.score) for r in got} == want
            assert [r.doc for r in got] == sorted(want, key=lambda d: (-round(want[d], 9), d.split("/")))
    n = len(bm25(docs, "cats"))
    assert [len(search.search(idx, "cats", k).collect()) for k in (0, 1, -1, 99)] == [0, 1, n - 1, n]
    assert search.render(search.search(idx, "кот")).first().line.endswith("a-b/y  — Dog")
    assert search.search(search.build_index(df.limit(0)), "cats").collect() == []


def test_search_pages(spark, tree):
    root = tree(**{"sources__deep__p.md": "---\ntitle: T\ntags: [a, 'b c']\ntitle: \"T2\"\n---\n# One\n#  \nbody", "sources__open.md": "---\ntitle: Open\nbody", "sources__LOGbook.md": "x", "sources__x.MD": "x"})
    pages = files.search_pages(files.list_tree(spark, root))
    head, body = search.parse_page(pages.text)
    rows = {r.slug: r for r in pages.select("slug", head.alias("h"), body.alias("b"), search.headings(body).alias("hs"), search.parse_tags(head["tags"]).alias("t")).collect()}
    assert {"deep/p", "open", "s", "ada", "c", "y"} == set(rows)
    assert rows["deep/p"].h["title"] == '"T2"' and rows["deep/p"].t == ["a", "b c"] and rows["deep/p"].hs == ["One", "body"]
    assert rows["open"].h == {"title": "Open"} and rows["open"].b == ""


def test_gate(spark, tmp_path):
    def event(i, tool, path, **kw):
        return (i, json.dumps({"tool_name": tool, "tool_input": {"file_path": path, **kw}}))

    rows = [event(1, "Write", "wiki/raw/a.md", content="x"), event(2, "Write", "wiki/x/../raw/inbox/a.md", content="x"), event(3, "Edit", "wiki/a.md", new_string="off the record"), event(4, "MultiEdit", "wiki/a.md", edits=[{"new_string": "please keep"}, {"new_string": "this between us"}]), event(5, "Read", "wiki/raw/a.md"), event(6, "Write", "wiki/a.md", content=" "), event(7, "Write", "other.py", content="cvv: 123\n" * 20), (8, "not json")]
    df = spark.createDataFrame(rows, "event_id long, json string")
    out = {r.event_id: r for r in gate.judge(gate.parse_events(df)).collect()}
    assert {i: r.verdict for i, r in out.items()} == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0, 6: 0, 7: 2, 8: 0} | {4: out[4].verdict}
    assert out[1].reason == "raw-path" and len(out[7].findings) == 10
    folder, seen = tmp_path / "events", []
    folder.mkdir()
    (folder / "e.json").write_text("\n".join(json.dumps({"event_id": i, "json": j}) for i, j in rows))
    gates.write_gate(spark, str(folder), lambda v, _: seen.extend(v.collect()), str(tmp_path / "cp")).awaitTermination()
    assert {r.event_id: r.verdict for r in seen} == {i: r.verdict for i, r in out.items()}


def test_inbox_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("off the record")
    q = gates.inbox(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("inbox_records").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.status for r in spark.table("inbox_records").collect()] == ["blocked"]


def test_staged_changes(spark):
    rows = [("A", ".staging/x", None), ("M", "wiki/raw/a", None), ("A", "wiki/raw/a", None), ("D", "wiki/raw/inbox/a", None), ("R100", "wiki/raw/b", "wiki/raw/inbox/b"), ("R100", "wiki/c", "wiki/raw/c"), ("M", "wiki/d.md", None)]
    df = spark.createDataFrame(rows, "status string, path string, old_path string")
    assert sorted((r.path, r.reason) for r in gate.staged_refusals(df).collect()) == [(".staging/x", "staging"), ("wiki/c", "raw-changed"), ("wiki/raw/a", "raw-changed")]
    assert [r.path for r in gate.staged_refusals(df, override=True).collect()] == [".staging/x"]


def test_slugs_and_templates(spark):
    good, bad = ["a", "a-b/c1", "0"], ["", "/a", "a/", "a//b", "A", "-a", "a b", "a\n", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "s string")
    assert [r.s for r in df.where(gate.valid_slug(df.s)).collect()] == good
    template = '---\ntitle: "<entity name>"\ncreated: <YYYY-MM-DD>\ntags: []\nreliability: medium\nsensitivity: x\nsources: []\n---\n# <Entity name>\nreliability: medium\n[<file>](../raw/<file>)\n'
    schema = "template string, page_type string, title string, day string, tags array<string>, reliability string, sensitivity string, sources array<string>"
    asked = [(template, "entity", 'A "b"', "2025-01-02", ["t", "u"], "high", "public", ["raw/f.md", "x"]), (template, "other", "é\U0001f600\n", "x", None, "low", "y", None), (template, "entity", "é\U0001f600\t\\\x7f", "x", [], "low", "y", [])]
    out, plain, escaped = (r.text for r in gate.new_pages(spark.createDataFrame(asked, schema)).collect())
    assert plain == template.replace("<YYYY-MM-DD>", "x").replace("sensitivity: x", "sensitivity: y").replace("reliability: medium", "reliability: low", 1)
    assert escaped.split("\n")[1] == "title: " + json.dumps("é\U0001f600\t\\\x7f")
    assert out == '---\ntitle: "A \\"b\\""\ncreated: 2025-01-02\ntags: [t, u]\nreliability: high\nsensitivity: public\nsources: ["raw/f.md", "x"]\n---\n# A "b"\nreliability: medium\n[f.md](../raw/f.md)\n'
