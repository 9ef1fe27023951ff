"""Personal data: rules, and a character-level bidirectional LSTM with a CRF that adds to them.

The network reads character classes, is trained in numpy from labelled spans
(written ones and spans that the rules find in a sample of at most
``SAMPLE_DOCS`` documents), and decodes overlapping windows of every text.
Windows lie on a fixed grid; each settles the tags of its own middle half, and
spans are read from the joined tags, so a span may cross windows.  A tag other
than O needs a digit, an at-sign or a bracketed "at" within its window (every
kind has one), so windows without any are O and are not computed.

Rules (``base_spans``) always stay.  The network adds spans that touch no rule
span and are plausible for their kind: an e-mail with something on both sides
of its at-sign, which may be written "(at)" or "[at]" as its dots may be
"[dot]" or "[.]"; four numbers of at most 255 with dots written so; 14 to 19
digits that pass Luhn, without letters between them; 10 to 15 digits with the
marks of telephone numbers.  Rules know none of these written forms, nor
numbers without a plus sign, so sample texts are no evidence about them:
windows of the sample that may hold one are left out of training.

Training alone leaves out sample texts of over ``SAMPLE_CHARS`` characters.

Cases: null text is empty; texts of any length are read whole, in linear time;
repeated rows are each returned; empty tables give empty results; extra columns
are ignored by ``find_pii`` and kept by ``mask_pii``.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest, read, slices

KINDS = ("email", "ip", "card", "phone")
#: Documents at most that training takes labelled spans from; the rest of training is written text.
SAMPLE_DOCS = 256
#: Characters at most of a text that training takes spans from.
SAMPLE_CHARS = 20_000
WINDOW, OWN = 96, 48
HIDDEN, STEPS, BATCH = 16, 300, 96

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does, as an earlier start gives a longer one.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[\[(]at[\])]", re.IGNORECASE)
_DOT = r"\s?(?:\.|[\[(](?:\.|dot)[\])])\s?"
_WRITTEN_EMAIL = re.compile(r"[^\s@()\[\]]+\s?(?:@|[\[(](?:at|@)[\])])\s?[A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Text that may be personal data in a form that the rules don't know.
_OPEN = re.compile(r"[0-9](?:[ ()./-]{0,3}[0-9]){9,}|[\[(](?:at|dot|\.|@)[\])]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all rule matches, by start, then kind; leftmost and non-overlapping per kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        # A run of local characters ends at an at-sign, so no earlier start is left.
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if _small_parts(m[0]):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# Character classes: each ASCII punctuation mark, and digit, lower, upper, blank, line end, other control, letter beyond ASCII.
_CLASSES = np.full(128, 5, np.int64)
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASSES[ord(_c)] = 7 + _i
_CLASSES[48:58], _CLASSES[97:123], _CLASSES[65:91], _CLASSES[32], _CLASSES[9], _CLASSES[10], _CLASSES[13] = 0, 1, 2, 3, 3, 4, 4
N_CLASSES, PAD = 40, 39
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASSES[np.minimum(points, 127)], 6)


def hits_of(text: str, x: np.ndarray) -> np.ndarray:
    """Positions of which every kind of personal data has one: digits, at-signs, bracketed "at"."""
    hits = np.flatnonzero((x == 0) | (x == _CLASSES[64]))
    written = [m.start() for m in _AT.finditer(text)]
    return np.union1d(hits, written).astype(np.int64) if written else hits


def tags_of(n: int, spans) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for start, kind, end in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 * kind + 2
            tags[start] = 2 * kind + 1
    return tags


def _lstm(model, d: int, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of direction d for class columns x (time, batch)."""
    table, u = model[f"E{d}"], model[f"U{d}"]
    h = np.zeros((x.shape[1], u.shape[0]), np.float32)
    c = np.zeros_like(h)
    n = u.shape[0]
    out = np.empty((x.shape[0], *h.shape), np.float32)
    for t in range(x.shape[0])[:: 1 - 2 * d]:
        z = table[x[t]]
        z += h @ u
        z[:, : 3 * n] *= 0.5
        np.tanh(z, out=z)
        z[:, : 3 * n] += 1
        z[:, : 3 * n] *= 0.5
        before = (h, c)
        c = z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]
        tc = np.tanh(c)
        h = z[:, 2 * n : 3 * n] * tc
        out[t] = h
        if keep is not None:
            keep.append((t, z, tc, *before))
    return out


def _scores(model, x: np.ndarray) -> np.ndarray:
    h = np.concatenate([_lstm(model, 0, x), _lstm(model, 1, x)], axis=2)
    return h @ model["V"] + model["c"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _gradients(model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of tags y (time, batch) and its gradients: forward-backward, then through time."""
    steps, batch = x.shape
    kept: tuple[list, list] = ([], [])
    h = np.concatenate([_lstm(model, 0, x, kept[0]), _lstm(model, 1, x, kept[1])], axis=2)
    s = (h @ model["V"] + model["c"]).astype(np.float64)
    a = model["A"].astype(np.float64)
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0]
    for t in range(1, steps):
        alpha[t] = s[t] + _logsum(alpha[t - 1][:, :, None] + a, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(a + (s[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    ds = np.exp(alpha + beta - z[:, None])
    pairs = np.exp(alpha[:-1, :, :, None] + a + (s[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
    gold = np.zeros_like(a)
    np.add.at(gold, (y[:-1], y[1:]), 1)
    ti, bi = np.indices(y.shape)
    loss = (z.sum() - s[ti, bi, y].sum() - (gold * a).sum()) / batch
    ds[ti, bi, y] -= 1
    ds = (ds / batch).astype(np.float32)
    g = {"A": ((pairs - gold) / batch).astype(np.float32), "V": np.tensordot(h, ds, ((0, 1), (0, 1))), "c": ds.sum(axis=(0, 1))}
    dh_all = ds @ model["V"].T
    n = model["U0"].shape[0]
    for d in (0, 1):
        u = model[f"U{d}"]
        de, du = np.zeros_like(model[f"E{d}"]), np.zeros_like(u)
        dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        for t, q, tc, h0, c0 in reversed(kept[d]):
            dh = dh + dh_all[t][:, d * n : (d + 1) * n]
            i, f, o, c1 = q[:, :n], q[:, n : 2 * n], q[:, 2 * n : 3 * n], q[:, 3 * n :]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * c1 * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c1 * c1)], axis=1)
            np.add.at(de, x[t], dz)
            du += h0.T @ dz
            dh, dc = dz @ u.T, dc * f
        g[f"E{d}"], g[f"U{d}"] = de, du
    return loss, g


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 3) -> dict[str, np.ndarray]:
    """A model from (classes, tags) windows of WINDOW characters each; Adam."""
    rng = np.random.default_rng(seed)
    xs, ys = (np.array([w[i] for w in windows]) for i in (0, 1))
    n = HIDDEN
    model = {"V": rng.normal(0, 0.3, (2 * n, TAGS)), "c": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS))}
    for d in (0, 1):
        model[f"E{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * n))
        model[f"E{d}"][:, n : 2 * n] += 1
        model[f"U{d}"] = rng.normal(0, n**-0.5, (n, 4 * n))
    for to in range(2, TAGS, 2):  # an inner tag follows its own first or inner tag
        model["A"][[j for j in range(TAGS) if j not in (to - 1, to)], to] = -4
    model = {k: v.astype(np.float32) for k, v in model.items()}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(xs), BATCH)
        _, g = _gradients(model, xs[pick].T, ys[pick].T)
        rate = 0.03 * (1 - 0.9 * step / steps)
        norm = max(1.0, sum(float((v * v).sum()) for v in g.values()) ** 0.5 / 5)
        for k, v in g.items():
            v = v / norm
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            model[k] = (model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def viterbi(model, x: np.ndarray) -> np.ndarray:
    """Best tags (time, batch)."""
    s = _scores(model, x)
    a = np.ascontiguousarray(model["A"].T)  # to, from
    back = np.empty(s.shape, np.int8)
    v = s[0]
    for t in range(1, len(s)):
        m = v[:, None, :] + a
        best = m.argmax(axis=2)
        back[t] = best
        v = np.take_along_axis(m, best[:, :, None], 2)[:, :, 0] + s[t]
    tags = np.empty(x.shape, np.int8)
    tags[-1] = v.argmax(axis=1)
    rows = np.arange(x.shape[1])
    for t in range(len(s) - 1, 0, -1):
        tags[t - 1] = back[t, rows, tags[t]]
    return tags


def _written(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A written line with labelled spans, numbers that are no personal data, and filler."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9)))
    plain_word = lambda: word().replace("é", "e").replace("ß", "s")
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    text, spans = "", []
    for _ in range(rng.randint(6, 16)):
        pick, kind, part = rng.random(), None, word()
        if pick < 0.08:
            at, dot = rng.choice([("@", "."), ("@", "."), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[.]"), ("@", "[.]")])
            host = rng.choice(["mail" + num(1) + ".", ""]) + rng.choice(["example", "host", "web-site", plain_word()]) + rng.choice([".com", ".org", ".co.uk", ".de"])
            kind, part = 0, rng.choice([plain_word(), plain_word() + "." + num(2), plain_word() + "_" + plain_word(), plain_word() + "." + plain_word()]) + at + host.replace(".", dot)
        elif pick < 0.16:
            kind, part = 1, rng.choice([".", ".", "[.]", "(.)", "[dot]"]).join(str(rng.randint(0, rng.choice([9, 99, 255, 255]))) for _ in range(4))
        elif pick < 0.24:
            d = num(15)
            d += next(x for x in "0123456789" if luhn(d + x))
            kind, part = 2, rng.choice(["", " ", "-", ".", "/", "  "]).join(d[i : i + 4] for i in range(0, 16, 4))
        elif pick < 0.34:
            a, b, c = num(3), num(3), num(4)
            kind, part = 3, rng.choice(["+1 ", "+44 ", "+1", "", "", "001 ", "0044 ", "1-"]) + rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"{a}/{b}-{c}"])
        elif pick < 0.48:
            part = rng.choice([num(rng.randint(1, 8)), num(rng.randint(9, 20)), "(" + num(rng.randint(1, 4)) + ")", "[" + num(rng.randint(1, 2)) + "]", num(2) + "/" + num(2) + "/" + num(4), num(3) + "-" + num(3), "(" + word() + ")", "[" + word() + "]", num(2) + ":" + num(2), "20" + num(2) + "-" + num(2) + "-" + num(2), "%064x" % rng.getrandbits(256), num(1) + "." + num(1) + "." + num(1), "$" + num(3) + ".00", "@" + word(), word() + num(2), num(3) + "," + num(3)])
        elif pick < 0.56:
            part = part.capitalize() + rng.choice(["", ".", ",", "***", "###", "&&&", "!!"])
        if kind is not None:
            before, after = rng.choice([("", "")] * 6 + [("", "."), ("", ","), ("", "***"), ("", "!!"), ("", ";"), ("(", ")"), ("(", ")"), ('"', '"'), (": ", ""), ("<", ">")])
            text += before
            spans.append((len(text), kind, len(text) + len(part)))
            part += after
        text += part + rng.choice([" ", " ", " ", "\n", ", "])
    return text, spans


def training_windows(sample: list[str], seed: int = 11, lines: int = 1200) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows around spans and other digits of written lines and of the sample's texts (labelled by the rules)."""
    rng = random.Random(seed)
    out = []
    for text, spans, known in [(*_written(rng), True) for _ in range(lines)] + [(t, base_spans(t), False) for t in sample]:
        x, y = np.pad(classes(text), WINDOW, constant_values=PAD), np.pad(tags_of(len(text), spans), WINDOW)
        # What rules can't judge: forms that they don't know.
        unsure = np.zeros(len(x), bool)
        for m in () if known else _OPEN.finditer(text):
            if not y[m.start() + WINDOW : m.end() + WINDOW].any():
                unsure[m.start() + WINDOW : m.end() + WINDOW] = True
        hits = hits_of(text, x[WINDOW : len(x) - WINDOW]) + WINDOW
        for at in ([s + WINDOW for s, _, _ in spans] + ([int(rng.choice(hits)) for _ in range(2)] if len(hits) else []))[:6]:
            start = min(max(at - rng.randint(10, WINDOW - 20), 0), len(x) - WINDOW)
            if not unsure[start : start + WINDOW].any():
                out.append((x[start : start + WINDOW], y[start : start + WINDOW]))
    return out


def decode(model, texts: list[str]) -> list[np.ndarray]:
    """Tags of every character of each text, from windows that each settle their middle."""
    side = (WINDOW - OWN) // 2
    out, places, rows = [], [], []

    def flush():
        if rows:
            tags = viterbi(model, np.ascontiguousarray(np.array(rows).T))[side : side + OWN].T
            for (i, start), got in zip(places, tags, strict=True):
                own = out[i][start : start + OWN]
                own[:] = got[: len(own)]
            places.clear()
            rows.clear()

    for i, text in enumerate(texts):
        x = classes(text)
        out.append(np.zeros(len(x), np.int8))
        hits = hits_of(text, x)
        if not len(hits):
            continue
        # Windows whose reach [k * OWN - side, k * OWN + OWN + side) has a hit.
        first, last = (hits - OWN - side) // OWN + 1, (hits + side) // OWN
        wanted = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in set(zip(first.tolist(), last.tolist(), strict=True))]))
        wanted = wanted[(wanted >= 0) & (wanted * OWN < len(x))]
        padded = np.pad(x, (side, WINDOW), constant_values=PAD).astype(np.int8)
        for k in wanted.tolist():
            places.append((i, k * OWN))
            rows.append(padded[k * OWN : k * OWN + WINDOW])
            if len(rows) == 2048:
                flush()
    flush()
    return out


def _plausible(kind: int, part: str) -> bool:
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]*[A-Za-z0-9][^\s@]*", part) or _WRITTEN_EMAIL.fullmatch(part))
    if kind == 1:
        parts = re.split(_DOT, part)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _small_parts(".".join(parts))
    d = _digits(part)
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d) and not re.search(r"[^\W\d_]", part)
    return 10 <= len(d) <= 15 and not re.search(r"[^0-9+() ./-]", part)


def added_spans(text: str, tags: np.ndarray, base) -> list[tuple[int, int, int]]:
    """Plausible runs of tags that touch no rule span."""
    out = []
    if not tags.any():
        return out
    hits = np.flatnonzero(tags)
    kinds = (tags[hits] - 1) // 2
    new = np.concatenate(([True], (np.diff(hits) > 1) | (np.diff(kinds) != 0) | (tags[hits][1:] % 2 == 1)))
    taken = np.zeros(len(text) + 1, bool)
    for s, _, e in base:
        taken[s:e] = True
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(hits)), strict=True):
        s, e, k = int(hits[a]), int(hits[b - 1]) + 1, int(kinds[a])
        while s < e and text[s].isspace():
            s += 1
        while e > s and (text[e - 1].isspace() or text[e - 1] in ".,;:!?*#&$%"):
            e -= 1
        # A number that goes on beyond the run is another number.
        edge = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
        if s < e and not edge and not taken[max(0, s - 1) : e + 1].any() and _plausible(k, text[s:e]):
            out.append((s, k, e))
    return out


def find_spans(model, texts: list[str]) -> list[tuple[list, list]]:
    """(rule spans, added spans) of each text."""
    tags = decode(model, texts)
    return [(base, added_spans(t, g, base)) for t, g in zip(texts, tags, strict=True) for base in [base_spans(t)]]


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """The network, from written lines and at most SAMPLE_DOCS documents, of those with a digit the ones whose hashes are lowest."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("text", F.xxhash64("text").alias("h"))
    # Copies of a text count once, so the sample is bounded.
    some = lowest(some, SAMPLE_DOCS, "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h")
    return train(training_windows([r.text for r in some.collect()]))


def _found(model):
    def run(batches):
        for batch in slices(batches, rows=256, bytes_=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base, added = [], []
            for b, a in find_spans(model, texts):
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in b])
                added.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in a])
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(base, span), pa.array(added, span)], names=["doc_id", "base", "added"])

    return run


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_pii(docs: DataFrame, model=None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base, added: spans in code points, end exclusive."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_found(model or fit(docs)), f"doc_id long, base {SPANS}, added {SPANS}")


def masked(text: str, spans) -> str:
    """The text with each span, joined where they overlap, replaced by its kind in angle brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model=None) -> DataFrame:
    """docs with personal data in ``text`` replaced; other columns stay, but n_chars follows the text."""
    model = model or fit(docs.select("doc_id", "text"))

    def run(batches):
        for batch in slices(batches, rows=256, bytes_=1 << 20):
            texts = batch.column("text").to_pylist()
            found = find_spans(model, [t or "" for t in texts])
            new = [t if t is None else masked(t, b + a) for t, (b, a) in zip(texts, found, strict=True)]
            cols = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64())
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def _digest(model):
    def run(batches):
        for batch in slices(batches, rows=256, bytes_=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, sha, spans = [], [], []
            say = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x))
            for base, added in find_spans(model, texts):
                counts.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
                sha.append(hashlib.sha256(say(base).encode()).hexdigest())
                spans.append(say(base + added))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(n[:, i]) for i in range(len(KINDS))], pa.array(sha), pa.array(spans)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.mapInArrow(_digest(fit(docs)), f"doc_id long, {counts}, base_sha256 string, spans string")
