from collections import Counter

import numpy as np

from inkwell.llm import op5_toxicity as m


def test_held_out(spark):
    """Train on one table, judge on the labels of another that training never saw."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = m.fit(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"), m.CHAIN)
    out = m.score(docs.where("doc_id % 2 = 1"), model, ["low_quality", "toxic"]).join(labels, "doc_id").collect()
    hit = sum(r.is_toxic and r.toxic == 1 for r in out)
    said, there = sum(r.is_toxic for r in out), sum(r.toxic == 1 for r in out)
    assert hit / said > 0.9 and hit / there > 0.85
    assert np.mean([r.is_low_quality == (r.quality == 0) for r in out]) > 0.88


def test_chain_feeds_later_models():
    """The second category follows from the first, which the text shows."""
    rows = [(b"alpha " * (i % 2) + b"w%d" % (i % 7), [i % 2, i % 2]) for i in range(200)]
    model = m.train(rows)
    assert abs(model["models"][1][-2]) > 0.1
    odds = m.predict(model, [b"alpha", b"beta"])
    assert (odds[0] > odds[1]).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (None, "", 1.0), (3, "bad word " * 40000, 0.0), (4, "fine", 0.0)], "doc_id long, text string, toxic double")
    labels = spark.createDataFrame([(1, None, 1), (3, 0, 1), (3, 0, 0), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    names = [n for n, _ in m.CHAIN]
    out = m.score(docs, m.fit(docs, labels, m.CHAIN), names).collect()
    assert len(out) == 5
    none = m.score(docs, m.fit(docs, labels.limit(0), m.CHAIN), names).collect()
    assert not any(r.is_toxic or r.is_low_quality for r in none) and max(r.p_toxic for r in none) < 1e-9
    assert m.score(docs.limit(0), m.fit(docs, labels, m.CHAIN), names).collect() == []


def test_words():
    assert {b"stupid", b"the"} < m.words(b"STUPID!! the***")


def test_held_out_floors(spark):
    """As test_held_out, with the floors of the operator's first form."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = m.fit(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"), m.CHAIN)
    out = m.score(docs.where("doc_id % 2 = 1"), model, ["low_quality", "toxic"]).join(labels, "doc_id").collect()
    hit = sum(r.is_toxic and r.toxic == 1 for r in out)
    said, there = sum(r.is_toxic for r in out), sum(r.toxic == 1 for r in out)
    assert hit / said > 0.95 and hit / there > 0.9
    assert np.mean([r.is_low_quality == (r.quality == 0) for r in out]) > 0.9


def test_slurs_are_found_with_under_100_labelled_rows(spark, sf):
    """Words that 87 labelled rows show in toxic ones only, in the texts of a larger table."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert docs.join(labels, "doc_id").count() < 100
    model = m.fit(docs, labels, m.CHAIN)
    far = "/root/testdata/sf0.1"
    out = m.score(spark.read.parquet(f"{far}/documents.parquet"), model, ["low_quality", "toxic"])
    rows = out.join(spark.read.parquet(f"{far}/documents.parquet").select("doc_id", "text"), "doc_id").join(spark.read.parquet(f"{far}/labels.parquet"), "doc_id").collect()
    explicit = [r.is_toxic for r in rows if {b"scum", b"moron", b"loser", b"disgusting"} & m.words((r.text or "").encode())]
    wrong = [r.is_toxic for r in rows if r.toxic == 0]
    print(f"caught {np.mean(explicit):.3f} of {len(explicit)}, wrongly {np.mean(wrong):.3f} of {len(wrong)}")
    assert len(explicit) > 100 and np.mean(explicit) > 0.8 and np.mean(wrong) < 0.05


def test_features_do_not_ask_for_many_rows():
    """Forty labelled rows, half of them with a word that the others don't have."""
    r = np.random.default_rng(5)
    rows = [(b"some plain words w%d v%d %s" % (r.integers(7), r.integers(5), [b"", b"scum"][y]), [0, y]) for y in r.permutation([0, 1] * 20).tolist()]
    model = m.train(rows)
    with_word, without = m.predict(model, [b"plain scum", b"plain words"])[:, 1]
    assert with_word > model["cuts"][1] > without


def chain_by_hand(rows, folds):
    """The chain restated: one model after another, each fed with what models that did not see a row said of it."""
    feats = sorted(w for w, n in Counter(w for t, _ in rows for w in m.words(t)).items() if n >= m.MIN_ROWS)
    x = [np.array([j for j, w in enumerate(feats) if w in m.words(t)], np.int64) for t, _ in rows]
    fed, models = np.zeros((len(rows), 0)), []
    for c in range(len(rows[0][1])):
        y = np.array([r[1][c] for r in rows], float)
        own = np.zeros(len(rows))
        for f in range(folds):
            inner = [i for i in range(len(rows)) if i % folds != f]
            w = m._logistic([x[i] for i in inner], fed[inner], y[inner], len(feats))
            for i in range(f, len(rows), folds):
                z = w[x[i]].sum() + sum(a * b for a, b in zip(fed[i], w[len(feats) : -1], strict=True)) + w[-1]
                own[i] = 1 / (1 + np.exp(-min(30, max(-30, z))))
        models.append(m._logistic(x, fed, y, len(feats)))
        fed = np.column_stack([fed, own])
    return feats, models


def test_the_chain_against_its_restatement():
    r = np.random.default_rng(2)
    rows = []
    for _ in range(120):
        a, b = int(r.integers(2)), int(r.integers(2))
        rows.append((b"w%d v%d " % (r.integers(5), r.integers(4)) + (b"mark " if a and r.random() < 0.8 else b"") + (b"sign" if b else b""), [a, a & b]))
    feats, models = chain_by_hand(rows, m.FOLDS)
    got = m.train(rows)
    assert list(got["index"]) == feats
    for x, y in zip(got["models"], models, strict=True):
        assert np.allclose(x, y, atol=1e-6)
    texts = [b"mark sign w1", b"sign v2", b"plain"]
    z1 = [models[0][[feats.index(w) for w in m.words(t) if w in feats]].sum() + models[0][-1] for t in texts]
    p1 = [1 / (1 + np.exp(-z)) for z in z1]
    z2 = [models[1][[feats.index(w) for w in m.words(t) if w in feats]].sum() + models[1][len(feats)] * p + models[1][-1] for t, p in zip(texts, p1, strict=True)]
    assert np.allclose(m.predict(got, texts), np.column_stack([z1, z2]), atol=1e-6)


def test_training_rows_are_bounded(spark, monkeypatch):
    """A repeated id comes once, and over-long texts not at all."""
    monkeypatch.setattr(m, "LONGEST", 100)
    taken = []
    monkeypatch.setattr(m, "train", lambda rows: taken.extend(rows))
    docs = spark.createDataFrame([(1, t) for t in ["b", "a", "a"] * 50] + [(2, "x" * 101), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    m.fit(docs, labels, m.CHAIN)
    assert sorted(t for t, _ in taken) == [b"", b"a"]
