import hashlib
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.operators import scan
from inkwell.plans import derived
from inkwell.sources import files


def luhn(d):
    return sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def model(content):
    """Findings by Python's own expressions."""
    lines = [unicodedata.normalize("NFKC", x) for x in content.splitlines()]
    pats = {c: (cat, re.compile(p, re.I if fold else 0)) for cat, c, p, fold in fixed.PATTERNS}
    out = set()
    for n, line in enumerate(lines, 1):
        out |= {(cat, c, n) for c, (cat, p) in pats.items() if p.search(line)}
        for m in re.finditer(fixed.PAN, line):
            d = re.sub("[ -]", "", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.add(("high-risk-identifier", "payment-card-pan", n))
        for m in re.finditer(fixed.IBAN, line, re.I):
            v = m[0].replace(" ", "").upper()
            if 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1:
                out.add(("high-risk-identifier", "iban", n))
    for n, (a, b) in enumerate(zip(lines, lines[1:]), 1):
        for c in fixed.TWO_LINE_CODES:
            cat, p = pats[c]
            if p.search(a + " " + b) and not p.search(a) and not p.search(b):
                out.add((cat, c, n))
    return sorted(out)


def got(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    rows = {int(r.path): r for r in scan.scan(df).collect()}
    return [[tuple(f) for f in rows[i].findings] for i in range(len(texts))], rows


def test_random_lines(spark):
    r = random.Random(7)
    seeds = [s for s, _ in derived.SEEDS]
    glue = ["", " ", "é", "x", ".", ", ", "²", "́", "\n", "\n\n", "Я", "ı", "ſ", "Ｐ"]
    words = ["ignore", "all", "previous", "system", "instructions", "bypass", "KYC", "control", "send", "tokens", "api key", "don't tell", "anyone", "между", "нами", "mellem", "os", "strictly", "between us", "4242424242424242", "4242 4242 4242 4242", "password =", "REDACTED", "longvalue99", "cvc: 123", "SSN: AB 12345", "Bearer"]
    texts = []
    for _ in range(600):
        parts = []
        for _ in range(r.randrange(1, 7)):
            w = r.choice(words + seeds)
            parts += [w.upper() if r.random() < 0.2 else w, r.choice(glue), " " if r.random() < 0.7 else ""]
        texts.append("".join(parts))
    out, _ = got(spark, texts)
    for t, o in zip(texts, out, strict=True):
        assert o == model(t), t


@pytest.mark.parametrize("n", range(len(derived.SEEDS)))
def test_seed(spark, n):
    seed, code = derived.SEEDS[n]
    out, rows = got(spark, ["one\n" + seed])
    assert out == [[(derived.CATEGORY[code], code, 2)] if code else []]
    assert rows[0].source.sha256 == hashlib.sha256(("one\n" + seed).encode()).hexdigest() and rows[0].source.line_count == 2
    # Never the text itself.
    if code and len(seed) > 12:
        assert seed not in json.dumps([r.json for r in scan.as_json(scan.scan(spark.createDataFrame([("p", seed)], "path string, text string"))).collect()])


def test_files_and_stdin(spark):
    rows = [("a.PNG", b"text"), ("b.txt", b"a\0b"), ("c.txt", b"\xff\xfe"), ("d.txt", b" \n\t"), ("e.txt", b"fine"), ("f.txt", None), ("g.md", "между нами".encode()), ("x" * 3 + ".bin", b"a" * 9000 + b"\0")]
    df = spark.createDataFrame(rows, "path string, content binary")
    out = {r.path: r.status for r in scan.scan_files(df).collect()}
    assert out == {"a.PNG": "skipped", "b.txt": "skipped", "c.txt": "error", "d.txt": "skipped", "e.txt": "pass", "f.txt": "error", "g.md": "blocked", "xxx.bin": "pass"}
    text = spark.createDataFrame([(" ",), ("fine",)], "text string")
    assert sorted(r.status for r in scan.scan_stdin(text).collect()) == ["error", "pass"]


def test_allowlist(spark, tmp_path):
    two = "off the record\ncvv: 123"
    df = spark.createDataFrame([("wiki/a.md", two), ("b.md", "cvv: 123"), ("c.md", "fine")], "path string, text string")
    sha = hashlib.sha256(two.encode()).hexdigest()
    entry = {"path": "a.md", "sha256": sha, "reason_codes": ["card-security-code"], "approved_by": "me", "date": "2024-01-01"}
    path = tmp_path / "allow.json"
    path.write_text(json.dumps({"schema_version": 1, "entries": [entry, entry | {"path": "b.md", "sha256": "0" * 64}]}))
    entries = files.load_allowlist(spark, path)
    relative = F.regexp_replace("path", "^wiki/", "")
    out = {r.path: r for r in scan.apply_allowlist(scan.scan(df), entries, relative).collect()}
    assert [f.reason_code for f in out["wiki/a.md"].findings] == ["explicit-no-record-en"] and [f.reason_code for f in out["wiki/a.md"].allowed] == ["card-security-code"]
    assert (out["wiki/a.md"].status, out["b.md"].status, out["c.md"].status) == ("blocked", "blocked", "pass")
    whole = files.load_allowlist(spark, path).withColumn("reason_codes", F.array(F.lit("card-security-code"), F.lit("explicit-no-record-en")))
    assert {r.path: r.status for r in scan.apply_allowlist(scan.scan(df), whole, relative).collect()}["wiki/a.md"] == "pass"
    assert files.load_allowlist(spark, tmp_path / "none.json") is None
    for bad in ("[", "[]", '{"schema_version": true, "entries": []}', json.dumps({"schema_version": 1, "entries": [entry | {"sha256": "zz"}]}), json.dumps({"schema_version": 1, "entries": [entry | {"reason_codes": []}]})):
        path.write_text(bad)
        with pytest.raises(files.AllowlistError):
            files.load_allowlist(spark, path)


def test_overall_status(spark):
    def of(*xs):
        return tuple(scan.overall_status(spark.createDataFrame([(x,) for x in xs], "status string")).first())

    assert of("pass", "skipped") == ("pass", 0) and of("error", "pass") == ("error", 1) and of("error", "blocked") == ("blocked", 2) and of("skipped") == ("pass", 0)
    df = spark.createDataFrame([("a", "pass"), ("b", "blocked")], "path string, status string")
    assert [r.path for r in scan.visible_records(df, True).collect()] == ["b"]


def test_denied_tokens_of_whole_texts(spark):
    rows = [("a", "One line.\nSecretName, secretname and SECRETNAME-2 at length"), ("b", "xsecretname secretnam"), ("c", None), ("d", "abc ünknown9 it's 1token9")]
    denied = [hashlib.sha256(t.encode()).hexdigest()[:16] for t in ("secretname", "token9", "nknown9", "abc")]
    got = scan.denied_tokens(spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame([(d,) for d in denied], "digest string")).collect()
    want = {(p, d) for p, t in rows for w in re.findall(r"[A-Za-z][A-Za-z0-9]{3,}", t or "") if (d := hashlib.sha256(w.lower().encode()).hexdigest()[:16]) in denied}
    assert sorted(map(tuple, got)) == sorted(want) and {p for p, _ in want} == {"a", "d"}


def test_home_paths_in_texts(spark):
    rows = [("/home/alice",), ("a\nb /home/alice\nc",), ("/Users/B",), ("/home/1",), ("/homes/x/y",), (None,), ("/home//x",)]
    assert [r.x for r in spark.createDataFrame(rows, "t string").select(scan.home_path(F.col("t")).alias("x")).collect()] == [True, True, True, False, False, None, False]


def test_queries_with_cards(spark):
    """Allowlists, order, counts and report of all findings, card numbers too, against Python's expressions."""
    from inkwell.plans import queries, small_queries  # noqa: F401

    sf = "/root/testdata/sf0.01"
    got = {n: [tuple(r) for r in queries.QUERIES[n](spark, sf).collect()] for n in ("jn07_allowed_findings", "jn07_kept_findings", "so03_findings_in_order", "ag14_distinct_findings", "so05_ten_of_each")}
    found, allowed = [], []
    for r in derived.scan_docs(spark, sf).collect():
        h = int(re.search("[0-9]+", r.path)[0])
        seed = derived.SEEDS[h % 20][1]
        for x in model(r.text):
            found.append((r.path, *x))
            if seed and h % 3 == 0 and x[1] in (seed, "payment-card-pan"):
                allowed.append(found[-1])
    assert {x[2] for x in allowed} >= {"payment-card-pan"} and {x[2] for x in set(found) - set(allowed)} >= {"payment-card-pan"}
    assert sorted(got["jn07_allowed_findings"]) == sorted(allowed)
    assert sorted(got["jn07_kept_findings"]) == sorted(set(found) - set(allowed))
    assert got["so03_findings_in_order"] == sorted(found, key=lambda x: (*x[1:], x[0]))
    codes = sorted({x[2] for x in found})
    assert sorted(got["ag14_distinct_findings"]) == sorted((c, k, sum(x[1:3] == (c, k) for x in found)) for c, k in {x[1:3] for x in found})
    assert sorted(got["so05_ten_of_each"]) == sorted((k, p) for k in codes for p in sorted(x[0] for x in found if x[2] == k)[: fixed.REPORTED_FINDINGS])


def test_scan_of_ascii_and_other_lines(spark):
    """Texts that stay in the JVM and those that are normalised give the same findings."""
    said = ["off the record", "\uff4fff the record", "ﬁne\noff the record", None, ""]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(said)], "path string, text string")
    out = {r.path: [f.line for f in r.findings] for r in scan.scan(df).collect()}
    assert out == {"0": [1], "1": [1], "2": [2], "3": [], "4": []}
