import re
import html
import random
import time
import math

import numpy as np
import pytest

from inkwell.llm import op8_langid as m


def brute(model, rows):
    """(text, declared, host, domain, suffix) -> probabilities, by dictionaries."""
    names, table = model
    k = len(names)
    ll, p = [], []
    for text, declared, *_ in rows:
        t = m.trigrams(text)
        x = table[t].sum(axis=0) * min(1.0, m.EVIDENCE / len(t)) if len(t) else None
        if x is not None and declared in names:
            x = x + [math.log(m.DECLARED) if n == declared else math.log((1 - m.DECLARED) / (k - 1)) for n in names]
        ll.append(x)
        p.append(None if x is None else np.exp(x - x.max()) / np.exp(x - x.max()).sum())
    sums = {}
    for (_, _, host, domain, suffix), q in zip(rows, p, strict=True):
        if q is not None and host is not None:
            for key in (("h", host), ("d", domain), ("x", suffix), "all"):
                sums[key] = sums.get(key, np.zeros(k)) + q
    total = sums.get("all", np.zeros(k))
    share = (total + 1) / (total.sum() + k)
    n_suffixes = sum(key[0] == "x" for key in sums)
    out = []
    for (_, _, host, domain, suffix), x, q in zip(rows, ll, p, strict=True):
        if q is None:
            out.append(None)
            continue
        own = lambda key: np.maximum(0, sums[key] - q) if host is not None and key[1] is not None and key in sums else np.zeros(k)
        h, d = own(("h", host)), own(("d", domain))
        dom = (d + m.SMOOTH * share) / (d.sum() + m.SMOOTH)
        z = x + np.log((h + m.SMOOTH * dom) / (h.sum() + m.SMOOTH))
        if host is not None and suffix is not None:
            z = z + np.log((own(("x", suffix)) + 1) / (total + n_suffixes + 1))
        e = np.exp(z - z.max())
        out.append(e / e.sum())
    return out


WORDS = {"en": "the and of to house with", "de": "der und die das schön mit", "fr": "le la et été avec que"}


@pytest.fixture(scope="module")
def model():
    return m.train([(w * 3, lang) for lang, w in WORDS.items()])


def test_against_brute_force(spark, model):
    r = np.random.default_rng(4)
    rows = []
    for i in range(120):
        lang = str(r.choice(list(WORDS)))
        words = r.choice(WORDS[lang].split() + WORDS["en"].split(), r.integers(0, 12))
        host = None if i % 11 == 0 else f"h{i % 5}.site{i % 3}.{'de' if i % 2 else 'com'}"
        rows.append((i, None if i % 17 == 0 else " ".join(words), [lang, None, "xx", "en"][i % 4], host, host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1]))
    rows += [rows[3], (200, "12 34 --", "en", "h1.site1.de", "site1.de", "de"), (None, "the house", "en", "lonely", "lonely", None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    got = sorted(m.identify(df, model, ["id", "text"]).collect(), key=lambda r: (r.id is None, r.id))
    want = brute(model, [r[1:] for r in rows])
    pairs = sorted(zip(rows, want, strict=True), key=lambda x: (x[0][0] is None, x[0][0]))
    for g, (row, w) in zip(got, pairs, strict=True):
        assert g.id == row[0]
        if w is None:
            assert (g.language, g.probability, g.accepted) == (None, None, False)
        else:
            assert g.probability == pytest.approx(w.max(), abs=1e-9)
            assert w[model[0].index(g.language)] == pytest.approx(w.max(), abs=1e-9)


def test_hosts_beyond_the_broadcast_bound(spark, model, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    test_against_brute_force(spark, model)


def test_priors_decide(spark, model):
    """A text without leaning follows its host."""
    rows = [(i, "der und die das", None, "a.de", "a.de", "de") for i in range(30)] + [(99, "zz", None, "a.de", "a.de", "de")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    assert {r.language for r in m.identify(df, model, ["id"]).collect()} == {"de"}


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = m.op8_langid(spark, sf).collect()
    assert len(out) == pages.count()
    assert sum(r.language == r.declared for r in out) / len(out) > 0.97


def test_held_out(spark, sf):
    """Text likelihoods alone, on documents beyond the training rows."""
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) > 200]
    names, table = m.train(rows[: len(rows) // 2])
    right = [names[int(table[m.trigrams(t)].sum(axis=0).argmax())] == lang for t, lang in rows[len(rows) // 2 :]]
    assert sum(right) / len(right) > 0.95


def test_parsing(spark):
    rows = [(1, "http://u@A.Example.ORG:8/x", "<html data-x='1' LANG=De><script>var x='<p>en</p>'</script><p>Gr&uuml;n</p>"), (2, None, None), (3, "nonsense", "<p>x")]
    got = {r.page_id: r for r in m.pages_as_rows(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].host, got[1].domain, got[1].suffix, got[1].text.split()) == ("de", "a.example.org", "example.org", "org", ["Grün"])
    assert (got[2].declared, got[2].host, got[2].text) == (None, None, "") and got[3].host is None


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "the house", None, "h", "h", None)], "id long, text string, declared string, host string, domain string, suffix string")
    none = m.identify(df, m.fit(df), ["id"]).collect()
    assert [(r.language, r.accepted) for r in none] == [(None, False)]
    assert m.identify(df.limit(0), m.train([("a b", "en")]), ["id"]).collect() == []


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "s", "h1", 5), (2, None, "en", "s", None, 0), (3, "", None, None, "", 0)], "doc_id long, text string, lang string, source string, host string, h0 long")
    out = m.accepted_documents(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_a_rare_language_is_a_class(spark):
    """A few pages of a language among 6,000 of another, none of them among the 800 lowest hashes."""
    fi = "talo ja puutarha sekä yö jää mutta että työ "
    rows = [(i, f"the house and of to with number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} {'ab' * (i // 1000)}", "en", None, None, None) for i in range(6000)]
    rows += [(10_000 + i, fi * (i + 1), "fi", None, None, None) for i in range(12)] + [(20_000, fi, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    df = df.where("id < 10000 or id = 20000 or xxhash64(text) > 0")
    assert df.where("declared = 'fi'").count() > 0
    model = m.fit(df)
    assert model[0] == ["en", "fi"]
    assert {r.language for r in m.identify(df, model, ["id"]).where("id >= 10000").collect()} == {"fi"}


def test_a_language_of_long_texts_only(spark):
    rows = [("the house " * 3, "en"), ("talo ja puutarha " * 2000, "fi")]
    assert m.fit(spark.createDataFrame(rows, "text string, declared string"))[0] == ["en", "fi"]


def test_many_languages(spark):
    """Sixty languages, against the dictionaries."""
    r = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    model = m.train([(" ".join("".join(r.choice(letters, 4)) for _ in range(30)), f"l{i:02}") for i in range(60)])
    rows = [(i, " ".join("".join(r.choice(letters, 4)) for _ in range(5)), f"l{i % 60:02}", f"h{i % 3}", f"h{i % 3}", None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string")
    got = sorted(m.identify(df, model, ["id"]).collect(), key=lambda r: r.id)
    for g, w in zip(got, brute(model, [r[1:] for r in rows]), strict=True):
        assert g.probability == pytest.approx(w.max(), abs=1e-9)


def test_hot_hosts_beyond_the_broadcast_bound(spark, model, monkeypatch):
    rows = [(i, f"the house and the garden {i}" if i % 3 else "das haus und der garten", ["en", "de", None][i % 3], "hot.org" if i % 2 else f"h{i % 40}.de", None, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, host string, domain string, suffix string")
    df = df.withColumn("domain", m.F.col("host"))
    want = sorted(map(tuple, m.identify(df, model, ["page_id", "host"]).collect()), key=str)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(m, "HOT", 10)
    got = sorted(map(tuple, m.identify(df, model, ["page_id", "host"]).collect()), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


def plain_text(page: str) -> str:
    """What the scan gives, by regular expressions that may take quadratic time."""
    out, at = [], 0
    while m_ := re.compile(r"<!--.*?-->|<(script|style|nav|footer)\b.*?</\1\s*>|<[^>]*>", re.S | re.I).search(page, at):
        out += [page[at : m_.start()], " "]
        at = m_.end()
    return html.unescape("".join(out) + page[at:])


def test_pages_are_scanned_as_plainly_read():
    r = random.Random(4)
    parts = ["<", ">", "<!--", "-->", "<nav>", "</nav>", "<NAV x>", "</nav >", "<script>", "</script>", "<b>", "text", " ", "&amp;", "&#65;", "<navy>", "<html lang=de>", "\n", "-", "é"]
    for _ in range(20_000):
        page = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert m.visible_text(page) == plain_text(page), page
    assert m.visible_text("a&#" + "9" * 6000 + ";b") == "a\ufffdb"
    assert m.declared_language("<p lang=fr><HTML class=x lang = 'DE-at'>") == "de"
    assert m.declared_language("<html><html lang=en") == "en"
    assert m.declared_language("<html class=a>lang=en") is None


def test_pages_take_linear_time():
    start = time.process_time()
    for part in ("<!--", "<html ", "<nav>", "<", "</nav ", "<html lang", "&#", "<script></nav>", "<!-- > "):
        page = part * ((1 << 20) // len(part))
        m.visible_text(page)
        m.declared_language(page)
    assert time.process_time() - start < 20
