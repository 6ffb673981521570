import hashlib
import random
import re

import numpy as np
import pytest
from cases import none, odd  # noqa: F401
from pyspark.sql import functions as F

from conftest import SF001
from spikewatch.llm import boosting, pii
from spikewatch.llm.queries import op6_pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    d = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def check(rows, texts):
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PLAIN]
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (list(PLAIN).index(s[0]), s[1]))
        assert all(0 <= a < b <= len(texts[r.doc_id] or "") for _, a, b in spans)


def strange_texts():
    rng = random.Random(5)
    bits = ["a", "Zé", "@", "@x.y", ".", ".", "-", " ", "  ", "+", "+1", "(", ")", "1", "22", "255", "256", "4111111111111111", "4111 1111",
            "-", "_", "%", "\n", "日", "\U0001f600", "0", "00255", "b.co", "x_y@", "(202)", "555-0143", "10.0.0.1", "é@q.r"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a@b.co_x@d.com", "+1 ( 202 ) 555 0143", "1.2.3.4.5.6.7.8.9", "a@b.c.", "+" + "1" * 9 + ")" * 9, "4" * 30, "a.b@c.d@e.f",
              "9" * 20_000, "a" * 30_000 + "@", "1." * 10_000, "x@" + "a." * 10_000 + "b", "+1" * 5_000, "(" * 20_000]
    return texts


def test_base_spans_match_brute_force(spark):
    texts = strange_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = pii.digest(df).collect()
    assert len(rows) == len(texts)
    check(rows, dict(enumerate(texts)))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = op6_pii(spark, SF001).collect()
    assert len(rows) == len(docs)
    check(rows, docs)


def test_odd_rows(odd, none):
    rows = pii.digest(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 7, 105)}
    check([r for r in rows if r.doc_id in texts], texts)
    assert pii.digest(none).collect() == []


def test_redaction(spark, odd, none):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    model = pii.train(odd)
    text = {r.doc_id: r.text for r in pii.redact(odd, model=model).collect()}
    assert text[-5].startswith("\U0001f600 é ñ. [IP] [EMAIL] [PHONE]") and text[102] is None and text[103] == "" and text[1] == odd.where("doc_id = 1").first().text
    assert text[106].endswith("[EMAIL] [CARD]")
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert pii.redact(none).collect() == []


def test_redaction_of_overlapping_spans(spark):
    texts = ["x +12025550143@a.bc y", "1.1.1.1 1.1.1.1", "+1 4111111111111111 10.0.0.1@a.b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, count_col=None).collect()}
    for i, t in enumerate(texts):
        spans, merged = sorted((a, b, k) for k, a, b in plain(t)), []
        for a, b, k in spans:
            if merged and merged[-1][1] > a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, k])
        want, at = "", 0
        for a, b, _ in merged:
            want, at = want + t[at:a] + "#", b
        assert re.sub(r"\[[A-Z]+\]", "#", got[i]) == want + t[at:]


def test_model_adds_formats_that_the_base_lacks(spark):
    """Numbers without the plus sign, in the same context and format as phones,
    pass a calibrated threshold only if the trees trust them; base spans stay."""
    rng = random.Random(1)
    rows = [(i, f"call {'+1 ' if i % 3 else ''}({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(pii.digest(df).collect(), dict(rows))


def test_trees_as_columns(spark):
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 4, (200, 3)), axis=0)
    y = ((x[:, 0] > 1) ^ (x[:, 2] == 3)).astype(float)
    model = boosting.boost(x, y * 50, np.full(len(x), 50.0), rounds=40)
    assert ((model.margin(x) > 0) == (y > 0)).all()
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int")
    got = df.select("a", "b", "c", model.column([F.col(c) for c in "abc"]).alias("m")).collect()
    assert all(r.m == pytest.approx(model.margin(np.array([[r.a, r.b, r.c]]))[0]) for r in got)


def test_variants_with_evidence_are_added_and_clean_numbers_are_not(spark):
    rng = random.Random(3)
    n = rng.randint

    def card(good):
        while True:
            d = "".join(str(n(0, 9)) for _ in range(16))
            if (sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0) == good:
                return ".".join(d[i:i + 4] for i in range(0, 16, 4))
    planted = {"phone": lambda: f"({n(200, 999)}) 555-{n(1000, 9999)}", "card": lambda: card(True), "ip": lambda: "-".join(str(n(1, 255)) for _ in range(4))}
    word = {"phone": "call", "card": "visa", "ip": "server"}
    base = {"phone": lambda: f"+1 {n(200, 999)} 555 {n(1000, 9999)}", "card": lambda: card(True).replace(".", "-"),
            "ip": lambda: ".".join(str(n(1, 255)) for _ in range(4))}
    clean = [lambda: f"visa {card(False)} x", lambda: f"server {n(256, 999)}-{n(256, 999)}-{n(256, 999)}-{n(256, 999)} x",
             lambda: f"about {n(1, 255)} {n(1, 255)} {n(1, 255)} {n(1, 255)} points", lambda: f"part {n(200, 999)} {n(200, 999)} {n(1000, 9999)} of it"]
    rows = []
    for i in range(900):
        k = ("phone", "card", "ip")[i % 3]
        value = planted[k]()
        rows.append((k, value, f"Please {word[k]} {value} today"))
        rows.append((None, None, f"it says {base[k]()} here"))
        rows.append((None, "clean", clean[i % 4]()))
    texts = [t for _, _, t in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(df)
    spans = {r.doc_id: r.spans for r in pii.digest(df, model=model).collect()}
    clear = {r.doc_id: r.text for r in pii.redact(df, count_col=None, model=model).collect()}
    for i, (k, value, text) in enumerate(rows):
        if k:
            assert clear[i] == text.replace(value, f"[{k.upper()}]"), (text, spans[i])
        elif value == "clean" and not plain(text):
            assert (spans[i], clear[i]) == ("", text)


def test_spans_that_the_base_loses_are_found_without_words_before_them(spark):
    """No word speaks for any of these: cards are told from other numbers by how
    often numbers of their format pass Luhn, phones by the base phones' format."""
    rng = random.Random(6)
    n = rng.randint

    def number(lead, good=None):
        while True:
            d = str(lead) + "".join(str(n(0, 9)) for _ in range(15))
            if good is None or valid("card", d) == good:
                return d

    def dotted(d):
        return ".".join(d[i:i + 4] for i in range(0, 16, 4))

    def phone():
        return f"+1 ({n(200, 999)}) 555-{n(1000, 9999)}"

    rows = [(f"la {number(4, True)} mi", None) for _ in range(300)] + [(f"la {number(9)} mi", None) for _ in range(300)]
    rows += [(f"la {phone()} mi", None) for _ in range(300)] + [(f"la {n(1, 99)}.{n(1, 99)}.{n(100, 255)}.{n(1, 99)} mi", None) for _ in range(50)]
    rows += [(f"la {dotted(number(9))} mi", "") for _ in range(300)]
    for _ in range(10):
        other, card, call = number(9, True), number(4, True), phone()
        rows += [(f"la {other} {card} mi", card), (f"la {call} 10.20.{n(100, 255)}.40 mi", call)]
    cards = [dotted(number(5, True)) for _ in range(300)]
    rows += [(f"la {c} mi", c) for c in cards]
    texts = dict(enumerate(t for t, _ in rows))
    found = pii.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check(found, texts)
    for r in found:
        text, want = rows[r.doc_id]
        base = plain(text)
        added = [text[int(a):int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if (k, int(a), int(b)) not in base]
        assert added == ([want] if want else []), (text, r.spans)
