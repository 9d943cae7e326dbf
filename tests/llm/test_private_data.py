import hashlib
import random
import re
import time

from quirelake.llm.private_data import BASE, FEATURES, MORE, _features, detected, feature_columns, generated, models, redacted, score, tree_column
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, table

import numpy as np

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    keep = {
        "email": lambda h: True,
        "ip": lambda h: all(int(p) <= 255 for p in h.split(".")),
        "card": lambda h: 16 <= len(d := re.sub("[ -]", "", h)) <= 19 and luhn(d),
        "phone": lambda h: 8 <= len(re.sub("[^0-9]", "", h)) <= 15,
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if keep[k](m[0])] for k, p in RULES.items()}


def texts():
    rng = random.Random(4)
    cards = [f"{n:016d}" for n in (4785380592391139, 2123465659789240, 4111111111111111)]
    parts = ["a.b@c.com", "x@y", "@a.b", "a@b.c.d-e_f@g.hh", "+_%@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "1..2.3.4", *cards, "4111 1111-1111 1111", "4111  1111", "+1 (743) 555-3824", "+1234567", "+12345678", "+1 ((", "++49 30 1234567", "é", "😀", "\n", " ", ",", "x", "7", "-", ".", "+"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    return [*out, None, "", "9" * 40_000, "1." * 20_000, "a" * 40_000 + "@", "4 " * 20_000, "+1" * 9_000, "😀 " * 50 + "a@b.cd 😀 1.2.3.4"]


def test_base_rules(spark):
    own = texts()
    got = detected(table(spark, own, extra="1 as _text")).orderBy("doc_id").collect()
    for r, t in zip(got, own, strict=True):
        want = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for k in RULES for a, b in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in RULES), t
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined


def test_added_spans(spark):
    own = ["call (212) 555-1234 now", "ssn 123-45-6789.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "mail me: joe (at) site (dot) com", "iban DE44 5001 0517 5407 3249 31", "in the year 123-45-6789", "-" * 40, "a long andverylongwordwithoutanydigitsinside it"]
    got = [r.spans for r in detected(table(spark, own)).orderBy("doc_id").collect()]
    assert got[0] == "phone:5:19" and got[1] == "identity:4:15" and got[2] == "key:9:49" and got[3] == "email:9:32" and got[4].startswith("account:5:")
    assert got[5] == "" and got[6] == "" and got[7] == ""


def test_redaction(spark):
    docs = table(spark, ["é a@b.cd, 1.2.3.4", None, "", "clean", "+1 234 567 8900 x"], extra="'k' as spans")
    got = redacted(docs).orderBy("doc_id")
    assert got.columns == docs.columns
    assert [r.text for r in got.collect()] == ["é <EMAIL>, <IP>", None, "", "clean", "<PHONE> x"]
    assert detected(spark.createDataFrame([], DOCS)).collect() == []


def test_features_and_calibration(spark):
    for k, kind in enumerate(MORE):
        x, y = generated(kind, np.random.default_rng(1000 + k), 400)
        trees, least = models()[kind]
        picked = [b for a, b in zip(x, y, strict=True) if score(trees, a) >= least]
        assert len(picked) > 80 and np.mean(picked) >= 0.93, kind
    rows = [("(212) 555-1234", "call "), ("DE44 5001", "IBAN "), ("abcdef0123", "api key "), ("a", "")]
    df = spark.createDataFrame(rows, "hit string, before string")
    got = df.select(*(c.alias(n) for n, c in feature_columns(F.col("hit"), F.col("before")).items())).collect()
    assert [[r[n] for n in FEATURES] for r in got] == [_features("", *x) for x in rows]
    assert set(BASE) == set(RULES)


def test_trees_in_columns_score_alike(spark):
    for k, kind in enumerate(MORE):
        x, _ = generated(kind, np.random.default_rng(2000 + k), 60)
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in FEATURES))
        trees = models()[kind][0]
        got = df.select(sum((tree_column(t, {n: F.col(n) for n in FEATURES}) for t in trees), F.lit(0.0)).alias("s")).collect()
        assert np.allclose([r.s for r in got], [score(trees, r) for r in x])


def test_added_spans_against_plain_code(spark):
    """All spans, by a plain walk over the same generators, features and trees."""
    rng = random.Random(8)
    parts = ["call ", "é 😀 ", "(212) 555-1234", "212-555-1234", "ssn ", "123-45-6789", " token = ", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "a1" * 90, "mail: ", "joe (at) site (dot) com", "x" * 70 + "[at]b.org", "iban ", "DE44 5001 0517 5407 3249 31", "1.2.3.4", "a@b.cd", "+1 (743) 555-3824", ", ", "\n", "4111 1111 1111 1111", "and "]
    own = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(300)]
    docs = table(spark, own)
    got = [r.spans for r in detected(docs).orderBy("doc_id").collect()]
    texts_ = [r.text for r in redacted(docs).orderBy("doc_id").collect()]
    kinds = ("email", "ip", "card", "phone", "identity", "account", "key")
    for t, spans_, left in zip(own, got, texts_, strict=True):
        base = brute(t)
        taken, more = [s for v in base.values() for s in v], {}
        for kind, (pattern, _) in MORE.items():
            trees, least = models()[kind]
            hits = [m for m in re.finditer(pattern, t) if score(trees, _features(kind, m[0], t[max(0, m.start() - 40) : m.start()])) >= least]
            more[kind] = [m.span() for m in hits if not any(a < m.end() and m.start() < b for a, b in taken)]
            taken += more[kind]
        every = {k: sorted(base.get(k, []) + more.get(k, [])) for k in kinds}
        assert spans_ == ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in every[k]), t
        at, out = 0, ""
        for a, b, k in sorted(((a, b, k) for k in kinds for a, b in every[k]), key=lambda x: (x[0], -x[1], f"<{x[2].upper()}>")):
            if a >= at:
                out += t[at:a] + f"<{k.upper()}>"
            at = max(at, b)
        assert left == out + t[at:], t


def test_very_long_texts_take_linear_time(spark):
    docs = table(spark, ["4 " * 1_000_000, "é a@b.cd " * 100_000, "12-34 " * 200_000, "7" * 300_000, "a1" * 300_000, "call (212) 555-1234 " * 20_000, "4111 1111 1111 1111, " * 20_000])
    began = time.time()
    rows = detected(docs).orderBy("doc_id").collect()
    assert [r.n_email for r in rows] == [0, 100_000, 0, 0, 0, 0, 0] and rows[6].n_card == 20_000
    assert [r.text for r in redacted(docs.where("doc_id = 1")).collect()] == ["é <EMAIL> " * 100_000]
    assert time.time() - began < 120


def test_rows_repeat_and_names_clash(spark):
    docs = table(spark, ["a@b.cd", "a@b.cd"], [1, 1], extra="'t' as _text").selectExpr("*", "'r' as _row", "1 as _base", "2 as _raw")
    assert [tuple(r) for r in redacted(docs).collect()] == [(1, "<EMAIL>", "en", "s", None, "t", "r", 1, 2)] * 2
