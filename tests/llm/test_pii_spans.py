"""Personal data: base spans against plain patterns, labelers and classifier against known truth."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import pii_spans
from tests.llm import corpus

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _ok(kind, value):
    digits = [int(c) for c in re.findall("[0-9]", value)]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def _base(text):
    out = []
    for kind, pattern in PLAIN.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if _ok(kind, m.group())]
    return out


def _texts():
    r = random.Random(4)
    alphabet = ["a", "B", "1", "4", "0", "25", ".", "@", "+", "-", " ", "_", "%", "(", ")", "é", "𝒳", "\n", "7"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["a@b.c_d@e.f g", "x" * 30_000 + "@", "1 " * 20_000, "9" * 20_000, "+1 (243) 555-5526, +1 2", "4111 1111 1111 1111", "4111-1111-1111-1112", "256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255", None, "",
              "".join(f"𝒳 u{i}@mail.example.com +49 30 {1000000 + i} " for i in range(700)), "a@b.c@d.e", ".a@-.-", "+1((((((((" * 500, "é@a.b"]
    return texts


def test_base_spans_equal_plain_patterns(spark):
    texts = _texts()
    rows = [(i, t, "en", "s", 1, 1, "m", "l", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "me@x.org", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, corpus.SCHEMA).repartition(4)
    got = pii_spans.digest(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = _base(texts[r.doc_id] if r.doc_id is not None else "me@x.org")
        assert [getattr(r, f"n_{k}") for k in PLAIN] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN], r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert spans[:len(want)] == want
        kinds = [(*pii_spans.BASE, *pii_spans.ADDED).index(s.split(":")[0]) for s in spans]
        assert kinds == sorted(kinds)


def test_classifier_finds_planted_spans_and_leaves_prose(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 9)))
    rows, planted = [], {}
    for i in range(600):
        words = [word() for _ in range(60)]
        words[10] = words[10].capitalize()
        words[11] = words[11].capitalize()
        text = " ".join(words)
        if i % 6 == 0:
            secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
            text += f' token = "{secret}" ' + word()
            planted[i] = ("secret", text.index(secret), secret)
        if i % 6 == 1:
            name = f"{r.choice(pii_spans.GIVEN)} {word().capitalize()}"
            text += f", contact {name}, u{i}@example.org"
            planted[i] = ("name", text.index(name), name)
        if i % 6 == 2:
            number = f"030 {r.randint(100, 999)} {r.randint(1000, 9999)}"
            text += f", phone: {number} or u{i}@example.org"
            planted[i] = ("number", text.index(number), number)
        if i % 6 == 3:
            text += " see page 2000000 and " + "-".join(word() for _ in range(9)) + "."
        rows.append((i, text, "en", "s", 1, 1, "m", "l", 1, 2))
    got = {x.doc_id: x for x in pii_spans.find(spark.createDataFrame(rows, corpus.SCHEMA)).collect()}
    found = sum(f"{k}:{at}:{at + len(v)}" in got[i].added for i, (k, at, v) in planted.items())
    wrong = sum(len([s for s in got[i].added if i not in planted or s.split(":")[0] != planted[i][0]]) for i in got)
    assert found >= 0.95 * len(planted) and wrong <= 0.02 * len(rows)


def test_reliabilities_are_recovered_without_labels(spark):
    r, true, false, rows = random.Random(1), [0.9, 0.85, 0.7, 0.95, 0.8, 0.6], [0.1, 0.2, 0.4, 0.05, 0.3, 0.5], []
    for _ in range(6000):
        real = r.random() < 0.3
        rows.append((1, [-1 if r.random() < 0.2 else int(r.random() < (true if real else false)[i]) for i in range(6)]))
    counted = spark.createDataFrame(rows, "kind int, votes array<int>").groupBy("kind", "votes").agg(F.count("*").alias("n"))
    model = pii_spans.reliabilities(counted, 40)[1]
    assert model["share"] == pytest.approx(0.3, abs=0.05)
    for side, rates in (("real", true), ("other", false)):
        assert [m["yes"] / (m["yes"] + m["no"]) for m in model[side]] == pytest.approx(rates, abs=0.07)


def test_nothing_is_found_in_nothing(spark):
    assert pii_spans.digest(spark.createDataFrame([], corpus.SCHEMA)).count() == 0
    row = pii_spans.digest(spark.createDataFrame([(1, None, "", "", 0, 0, "", "", 1, 1)], corpus.SCHEMA)).collect()[0]
    assert (row.n_email, row.spans, row.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_no_python_worker_on_the_path(spark):
    df = spark.createDataFrame([(1, "a@b.c", "", "", 0, 0, "", "", 1, 1)], corpus.SCHEMA)
    for part in (pii_spans._spans(df), pii_spans.digest(df)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
