import duckdb

from inkwell.llm import op3_chat as m

SCHEMA = "conv_id long, turn long, role string, text string, n long, h1 string"


def brute(rows):
    order = lambda r: tuple((x is not None, x) for x in (r[1], r[2], r[3]))
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        convs.setdefault(r[0], []).append((r[2], r[3]))
    out = []
    for i, c in convs.items():
        longer = any(len(o) > len(c) and o[: len(c)] == c for o in convs.values())
        same = [j for j, o in convs.items() if o == c]
        if not longer and i == min(same):
            text = "".join(f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n" for role, text in c)
            out.append((i, len(c), len(same), len(text), text))
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in m.maximal_conversations(df).collect())


def test_snapshots_copies_and_odd_rows(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "éß")]
    rows = []
    for i, c in enumerate([a[:1], a[:2], a[:2], a, a, a[:3] + [("assistant", "other")], a[1:2], [("user", None)], [("user", "")], [(None, "user")], [("user", "hi"), ("user", "hi")]]):
        rows += [(10 - i, n * 3, role, text) for n, (role, text) in enumerate(c)]
    rows += [(None, 0, "user", "lost"), (99, 1, "user", "twice"), (99, 1, "user", "twice"), (98, None, "user", "twice"), (97, 0, "user", "long " * 50000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_sql(spark, sf):
    out = sorted(tuple(r) for r in m.op3_chat(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert out == sorted(con.execute(m.SQL).fetchall())
    assert out == brute([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
