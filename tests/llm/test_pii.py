import hashlib
import random
import re

import numpy as np
import pytest

from cairnflow.llm import boosting, pii, queries

# The base patterns as the contract states them (fixed values).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(n):
    odd, even = n[::-1][::2], n[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)) % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and passes(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_base_spans_of_random_strings():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice("01259 .-+()@ab_é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base(text) == brute(text), text
    for piece in ("a@b.c@d.e", "1.2.3.45.6.7.8", "+1 (2", "4111-1111 1111 1111", "x" * 50 + "@" + "y." * 20, "1.2.3.400"):
        assert pii.base(piece) == brute(piece)
    assert len(pii.base("7" * 300_000 + " " + "a" * 300_000 + "@" * 1000 + "1." * 100_000)) == 25_000


def test_query_against_the_patterns(spark, sf, documents):
    df, rows = documents
    out = {r.doc_id: r for r in queries.op11_boosted_candidates(spark, sf).collect()}
    assert len(out) == len(rows)
    for d, text in rows:
        want = brute(text)
        said = [f"{k}:{a}:{b}" for k, a, b in want]
        assert out[d].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [out[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(said) <= set(filter(None, out[d].spans.split(",")))


@pytest.fixture(scope="module")
def learned(spark):
    words = "alpha beta gamma delta omega sigma kappa".split()
    texts = [(i, f"{words[i % 7]} {words[i % 5]} number {i} of the {words[i % 3]} and " * 12) for i in range(400)]
    return pii.train(spark.createDataFrame(texts, "doc_id long, text string"))


def test_spans_that_no_pattern_has(learned):
    assert set(learned.trees) == set(pii.KINDS)
    rng, found, wanted, wrong = random.Random(99), 0, 0, 0
    for _ in range(400):
        text, spans = pii.planted("lorem ipsum dolor sit amet consectetur adipiscing elit " * 6, rng, 4)
        known = pii.base(text)
        got = [(k, text[a:b]) for k, a, b in known] + [(k, text[a:b]) for k, a, b, _ in learned.added([text], [known])[0]]
        true = [(k, text[a:b]) for k, a, b in spans if k]
        found, wanted = found + sum(t in got for t in true), wanted + len(true)
        wrong += sum(g not in true for g in got if g not in [(k, text[a:b]) for k, a, b in known])
    assert found / wanted > 0.85 and wrong / found < 0.03
    for text, spans in (("+1 (826) 555-4081 190.137.223.204 on", ["+1 (826) 555-4081", "190.137.223.204"]), ("an +1 (826) 555-4081 4111111111111111 on", ["+1 (826) 555-4081", "4111111111111111"])):
        known = pii.base(text)
        assert [text[a:b] for _, a, b, *_ in pii.ordered([*known, *learned.added([text], [known])[0]])] == spans


def test_spans_of_odd_rows(spark, hostile, no_rows):
    df, rows = hostile
    out = pii.detect(df, redacted=True).collect()
    assert sorted((str(r.doc_id), r.redacted is None) for r in out) == sorted((str(d), t is None) for d, t in rows)
    for r in out:
        ends = [s.end for s in r.spans if s.score < 1]
        assert all(0 <= s.start < s.end for s in r.spans) and len(ends) == len(set(ends))
    assert pii.detect(no_rows).count() == 0
    plain = spark.createDataFrame([(1, "write to a.b@c.example or 10.0.0.1"), (None, None), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.redacted for r in pii.detect(plain, redacted=True).collect()} == {1: "write to [EMAIL] or [IP]", None: None, 2: ""}


def test_added_spans_stay_apart():
    rng = random.Random(5)
    for _ in range(300):
        spans = [(rng.choice(pii.KINDS), a, a + rng.randint(1, 9)) for a in (rng.randint(0, 40) for _ in range(8))]
        known, chosen = spans[:3], [(*s, rng.random()) for s in spans[3:]]
        taken = []
        for s in sorted(chosen, key=lambda s: (-s[3], s[1] - s[2], s[1])):
            if all(s[2] <= b or s[1] >= a for _, a, b, *_ in known + taken):
                taken.append(s)
        assert sorted(pii._apart(chosen, known)) == sorted(taken)


def test_boosting_and_thresholds():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(int)
    model = boosting.Boosted().fit(x[:3000], y[:3000])
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert boosting.threshold(np.array([0.9, 0.8, 0.7, 0.2]), np.array([1, 1, 0, 1]), 0.9) == pytest.approx(0.75)
    assert boosting.threshold(np.array([0.9, 0.9, 0.7]), np.array([1, 0, 0]), 0.9) > 1
    assert boosting.Boosted().fit(np.ones((5, 2)), np.ones(5)).predict(np.ones((1, 2)))[0] > 0.5
