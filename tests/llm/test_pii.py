import hashlib
import random
import re

import numpy as np

from waymark.llm import pii
from waymark.llm.boost import Boosted, threshold_for

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub(r"\D", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
]


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in re.finditer(p, text) if good(m[0]))


def test_base_is_as_the_patterns():
    rnd = random.Random(9)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "1", "12", "255", "256", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "10.0.0.1", "(", ")", "é", "\n", "%", "0007", "99999"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_little_time():
    for text in ("a" * 3_000_000, "1" * 3_000_000, "a." * 1_000_000 + "@", "+1 " * 500_000, "1." * 1_000_000, "@" * 1_000_000, "4 " * 1_000_000):
        pii.base_spans(text)
        pii.candidates(text)


def docs(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        d = [rnd.randint(0, 9) for _ in range(15)]
        check = next(c for c in range(10) if pii.luhn("".join(map(str, [4, *d[1:], c]))))
        card = "".join(map(str, [4, *d[1:], check]))
        rows.append((i, f"some words é {rnd.choice(['mail', ''])} {rnd.choice(['u', 'ann.b', 'x.y-z', 'joe'])}{rnd.choice(['', i])}@{rnd.choice(['host', 'corp', 'mail.big'])}{rnd.choice(['', i % 9])}.{rnd.choice(['com', 'org', 'co.uk'])} and 10.{i % 250}.3.{i % 99} then {card} or +1 ({200 + i % 700}) 555-{1000 + i} version 2.0.{i} in {1990 + i % 30}", "k"))
    rows += [(1000, None, "k"), (1001, "", "k"), (1002, "call (415) 555-2671 or write to jane.doe [at] corp [dot] com", "k"), (1003, "ISBN 9780306406157 and 300.1.2.3 on 2020-01-02", "k"), (None, "x" * 100_000 + " a@b.cd", "k"), (3, rows[3][1], "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, base string")


def test_added_spans_and_base_digest(spark):
    d = docs(spark)
    selector = pii.learn(d)
    got = {r["doc_id"]: r for r in pii.spans(d, selector).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for key, r in got.items():
        want = [(a, pii.KINDS.index(k), b) for k, a, b in r["base"]]
        assert want == plain(texts[key])
    found = {(s["kind"], texts[1002][s["start"] : s["end"]]) for s in got[1002]["added"]}
    assert ("email", "jane.doe [at] corp [dot] com") in found and any(k == "phone" for k, _ in found)
    assert got[1003]["added"] == [] and got[1000]["base"] == []
    red = {r["doc_id"]: r["text"] for r in pii.redact(d, selector).collect()}
    assert red[1000] is None and "@" not in red[0] and "[card]" in red[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.spans(none, pii.learn(none)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    m = Boosted(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert abs(threshold_for(np.array([0.9, 0.8, 0.7]), np.array([1, 1, 0]), 0.9) - 0.75) < 1e-9
