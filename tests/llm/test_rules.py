import math
import random
import re
from collections import Counter

from waymark.llm import rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed)


def test_statistics(spark):
    rnd = random.Random(8)
    parts = ["a", "b", "a1", "é#", "x|y", "\n", "\n", " ", "\t", "\x0b", "the", "0", "\x01", " ", "日本"]
    texts = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "a\r\na\r\n", "w " * 60_000, " ".join(map(str, range(70_000)))]
    texts += ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 200))) for _ in range(400)]
    rows = [(i, t, 7, "z") for i, t in enumerate(texts)] + [(None, "a b", 7, "z"), (3, "a", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, got_ string")
    got = rules.judge(docs, []).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["got_"] == "z"
        if r["doc_id"] is not None:
            want = plain(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, texts[r["doc_id"]]
            assert r["kept"] == (not want[5])


def test_covering_finds_conjunctions_and_leaves_good_rows():
    rnd = random.Random(3)
    sample = []
    for _ in range(1500):
        r = {f: rnd.random() for f in rules.FEATURES}
        bad = r["symbol_share"] > 0.8 or (r["upper_share"] > 0.7 and r["mean_word"] <= 0.4)
        sample.append(r | {"label": int(not bad), "part": rnd.randrange(3)})
    found = rules.learn(sample)
    assert 2 <= len(found) <= 8
    judged = [any(all(c.holds(r) for c in rule) for rule in found) for r in sample]
    assert sum(j == (r["label"] == 0) for j, r in zip(judged, sample)) > 0.95 * len(sample)
    assert rules.learn([]) == [] and rules.learn([r | {"label": 1} for r in sample]) == []


def test_every_threshold_is_tried():
    rnd = random.Random(6)
    rows = [({f: rnd.choice([0.0, 0.25, rnd.random()]) for f in rules.FEATURES}, int(rnd.random() < 0.3)) for _ in range(300)]
    rows = [(r, int(y or r["stop_share"] > 0.93)) for r, y in rows]
    p0 = sum(y for _, y in rows)

    def gain(c):
        got = [y for r, y in rows if c.holds(r)]
        return sum(got) * (math.log2(sum(got) / len(got)) - math.log2(p0 / len(rows))) if sum(got) else 0

    every = [rules.Condition(f, above, r[f]) for f in rules.FEATURES for r, _ in rows for above in (True, False)]
    assert abs(gain(rules._best(rows, p0)) - max(map(gain, every))) < 1e-9
    near = [({f: 0.1 for f in rules.FEATURES} | {"n_words": x}, y) for x, y in ((1.0, 0), (math.nextafter(1.0, 2), 1))]
    assert [rules._best(near, 1).holds(r) for r, _ in near] == [False, True]


def test_learned_on_tables(spark):
    rnd = random.Random(5)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = [(i, say(80) if i % 3 else " | ".join(say(80).split()), "q") for i in range(600)] + [(700, None, "q"), (None, "x", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(None, 0), (501, None)], "doc_id long, quality int")
    found = rules.learned_rules(docs, labels)
    assert found and all(str(c) for r in found for c in r)
    by = {r["doc_id"]: r["kept"] for r in rules.judge(docs, found).collect()}
    assert all(by[i] == (i % 3 > 0) for i in range(600)) and not by[700] and not by[None]
    assert rules.judge(docs.limit(0), rules.learned_rules(docs.limit(0), labels)).count() == 0
