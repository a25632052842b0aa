import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import toxicity
from waymark.llm.fit import fold


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_trie_finds_what_all_distances_find():
    rnd = random.Random(1)
    say = lambda n: "".join(rnd.choice("abcé") for _ in range(n))
    terms = sorted({(say(rnd.randint(3, 10)), rnd.random() < 0.4, 1.0) for _ in range(25)})
    lexicon = toxicity.Lexicon(terms)
    for word in [say(rnd.randint(1, 12)) for _ in range(1500)] + [t + "x" for t, _, _ in terms]:
        want = []
        for i, (term, is_stem, _) in enumerate(terms):
            row = edits(term, word)
            d = min(row) if is_stem else row[-1]
            if d <= toxicity.slack(term, is_stem):
                want.append((d, is_stem, -len(term), i))
        best = min(want, default=None)
        assert lexicon.match(word) == (best and (best[3], best[0])), word


def test_context():
    assert toxicity.in_context('he said "you moron" again', 13, 18) == (True, True)
    assert toxicity.in_context("he is a moron.\n\"x\"", 8, 13) == (False, False)
    assert toxicity.in_context("«quel idiot»", 6, 11)[0]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        words = ["".join(rnd.choice("etaoinsr") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words[rnd.randrange(60)] = rnd.choice(["blockhead", "dimwit", "zorg" + words[0]])
        rows.append((i, " ".join(words), 1, "x"))
        labels.append((i, int(toxic), "y"))
    rows += [(900, None, 1, "x"), (901, "", 1, "x"), (902, "you blokhead and dimvit. you blockhead, dimwit!", 1, "x"), (903, "word " * 50_000, 1, "x"), (904, "fine words here", 1, "x"), (904, "fine words here", 1, "x"), (None, "dimwit blockhead dimwit", 1, "x")]
    return (spark.createDataFrame(rows, "doc_id long, text string, label int, score string"), spark.createDataFrame(labels + [(None, 1, "y"), (1, None, "y"), (0, 1, "y")], "doc_id long, toxic int, text string"))


def test_learns_and_scores(tables):
    docs, labels = tables
    got = toxicity.scores(docs, labels, fold("doc_id", 4) != 2).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["score"] for r in got}
    wrong = [i for i in range(500) if (by[i] >= 0.3) != (i % 5 == 0)]
    assert len(wrong) <= 5
    assert by[902] >= 0.3 and by[None] >= 0.3 and max(by[900], by[901], by[903], by[904]) < 0.3


def test_no_labels_and_no_rows(spark, tables):
    docs, labels = tables
    assert toxicity.scores(docs.limit(3), labels.where(F.lit(False)), F.lit(True)).count() == 3
    assert toxicity.scores(docs.where(F.lit(False)), labels, F.lit(True)).count() == 0
