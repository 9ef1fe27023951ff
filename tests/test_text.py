import time
import random
import re
import unicodedata

from pyspark.sql import functions as F

from inkwell.functions import text


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def samples(alphabet, n=400, longest=12, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_split_lines(spark):
    xs = [*samples(["a", "b", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " "]), "", "\n", "a\n\n"]
    assert column(spark, xs, text.split_lines) == [x.splitlines() for x in xs]


def test_strip_and_blank(spark):
    xs = samples([" ", "\t", "\n", "\xa0", "\x1f", "　", "a", "é"])
    assert column(spark, xs, text.strip) == [x.strip() for x in xs]
    assert column(spark, xs, text.is_blank) == [not x.strip() for x in xs]


def test_unquote(spark):
    xs = ['"a"', "'a'", "\"a'", '"', '""', " 'x y' ", "a", ""]
    assert column(spark, xs, text.unquote) == ["a", "a", "\"a'", '"', "", "x y", "a", ""]


def test_tokens(spark):
    xs = ["The Class of cats", "a bb ccs house houses", "Ünïcödé_x тесты", "don't x-ray 12345s", ""]

    def model(x):
        out = [t for t in re.findall(r"\w+", x.lower()) if len(t) >= 2]
        return [t[:-1] if len(t) > 4 and t.endswith("s") else t for t in out]

    assert column(spark, xs, text.tokens) == [model(x) for x in xs]


def fences(lines):
    """Kept (number, line) pairs of a document; own restatement."""
    mark, out = None, []
    for n, line in enumerate(lines, 1):
        m = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if mark:
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not line[m.end() :].strip(" \t"):
                mark = None
        elif m:
            mark = m[1]
        else:
            out.append((n, line))
    return out


def test_fences(spark):
    r = random.Random(5)
    parts = ["```", "````", "~~~", "``` py", "  ```", "    ```", "text", "~~~~", "```  ", "a ``` b"]
    docs = ["\n".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(300)]
    got = column(spark, docs, lambda c: text.outside_fences(text.split_lines(c)))
    assert [[(x.n, x.line) for x in g] for g in got] == [fences(d.splitlines()) for d in docs]


def test_code_spans(spark):
    xs = samples(["`", "``", "a", "[[", "]]", " "], 500, 14)
    want = [re.sub(r"(`+)(.*?)\1", lambda m: " " * len(m[0]), x) for x in xs]
    assert column(spark, xs, text.blank_code) == want


def test_link_targets(spark):
    xs = {"a|b": "a", "a#b|c": "a", " ./././x.md ": "x", "/wiki/a": "a", "wiki/wiki/a.MD": "wiki/a", "a\\b": "a/b", "#x": "", "a.md.md": "a.md"}
    assert column(spark, list(xs), text.link_target) == list(xs.values())


def test_headers(spark):
    docs = ["---\na: 1\nb:  two \n c\n  d\na: 3\n---\nx: y", "---\na: 1\n", "no\n---", "---\n---\n", "﻿---\nk-1: v\n --- \nbody", "---\nnokey\na:b\n---"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, x string")
    df = text.once(df, lines=text.split_lines(text.drop_bom(F.col("x"))))
    df = text.once(df, end=text.closing_line(F.col("lines")))
    got = [r.m for r in df.select("i", text.header(F.col("lines"), F.col("end")).alias("m")).orderBy("i").collect()]
    assert got == [{"a": "3", "b": "two \n c\n  d"}, {}, {}, {}, {"k-1": "v"}, {"a": "b"}]


def test_dates(spark):
    xs = ["2024-02-29", "2023-02-29", "2024-2-9", "2024-13-01", "x", "2024-01-01 ", "2024-01-01"]
    assert column(spark, xs, text.is_date) == [True, False, False, False, False, False, True]


def test_nfkc(spark):
    xs = ["ﬁ ＡＢＣ", "é", "①"]
    assert column(spark, xs, lambda c: text.nfkc_lines(F.array(c))) == [[unicodedata.normalize("NFKC", x)] for x in xs]


def test_long_pages_with_fences_and_headers(spark):
    """Thousands of lines in and around fences, and headers of many lines, in time that does not grow with their square."""
    body = ["```", "x"] * 1 + ["in"] * 20_000 + ["```"] + ["out"] * 20_000 + ["~~~~", "```", "~~~", "~~~~~  "] + ["out"] * 10
    head = ["---"] + [f"k{i}: v" if i % 50 == 0 else f"  more {i}" for i in range(5000)] + ["k0: last", "---"]
    df = spark.createDataFrame([("\n".join(body), "\n".join(head))], "b string, h string")
    start = time.time()
    df = text.once(df, b=text.split_lines(F.col("b")), h=text.split_lines(F.col("h"))).toDF("text_b", "text_h", "b", "h")
    row = df.select(text.outside_fences(F.col("b")).alias("kept"), text.header(F.col("h"), text.closing_line(F.col("h"))).alias("fields")).first()
    assert time.time() - start < 30
    assert {x.line for x in row.kept} == {"out"} and len(row.kept) == 20_010 and row.kept[0].n == 20_004
    assert row.fields["k0"] == "last" and len(row.fields) == 100 and row.fields["k50"].startswith("v\n  more 51\n")
