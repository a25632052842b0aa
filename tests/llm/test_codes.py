"""Vector codes against plain Python; SQL over the tables is the driver's."""

import hashlib
import math
import random

import numpy as np
import pytest

from waymark.llm import codes


def brute(rows, n_parts=8, entries=16, rounds=6):
    """``rows``: key, vector, label."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = lambda v: [v[i * len(v) // n_parts : (i + 1) * len(v) // n_parts] for i in range(n_parts)]
    vectors = [(k, cut([math.floor(4096 * x) for x in v]), label) for k, v, label in rows]
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut([math.floor(4096 * x) for x in v])[p] for _, v, _ in first] for p in range(n_parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in vectors:
                own.setdefault(near(v[p], book)[1], []).append(v[p])
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for k, v, label in vectors:
        got = [near(v[p], books[p]) for p in range(n_parts)]
        error = sum(d for d, _ in got)
        by_label[label] = by_label.get(label, 0) + error
        out.append((k, "".join(f"{i:02x}" for _, i in got), error, label))
    return sorted(((k, c, e, by_label[label], sha) for k, c, e, label in out), key=repr)


def made(n, seed, width=16, odd=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        v = [rnd.choice([-0.5, 0.25, rnd.gauss(0, 0.3)]) for _ in range(width)]
        if odd and i % 9 == 0:
            v = rnd.choice([None, [], v[:3] + [None] + v[4:], [math.nan] + v[1:], v[:-1] + [math.inf]])
        elif i % 4 == 0:
            v = [0.125] * width
        out.append((rnd.choice([i, i // 2, None]) if odd else i, v, rnd.choice([None, 1, 2])))
    return [(k, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for k, v, label in out]


@pytest.mark.parametrize(("n", "width"), [(7, 8), (150, 16), (300, 24)])
def test_against_plain_python(spark, n, width):
    rows = made(n, n, width)
    table = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], "vec_id long, embedding array<float>, label int, code string, error int, position string")
    assert sorted((tuple(r) for r in codes.vector_codes(spark, table).collect()), key=repr) == brute(rows)


def test_no_sound_vector_and_empty_table(spark):
    for rows in ([], [(1, None, 2), (2, [math.nan] * 8, None)]):
        assert codes.vector_codes(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect() == []


def test_unequal_lengths_are_an_error(spark):
    table = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="one length is needed"):
        codes.vector_codes(spark, table).collect()


def test_trie_shares_beginnings_and_breaks_ties():
    parts = np.array(sorted([[1, 2, 3], [1, 2, 4], [1, 2, 4], [-5, 0, 0], [7, 7, 7], [0, 0, 0]]))
    book = np.array([[2, 2, 2], [0, 2, 4], [2, 2, 2]])
    entry, distance = codes.nearest(parts, book)
    every = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert entry.tolist() == every.argmin(axis=1).tolist()
    assert distance.tolist() == every.min(axis=1).tolist()
    assert codes.unpacked(codes.packed(parts), 3).tolist() == parts.tolist()
    assert codes.packed(parts).to_pylist() == sorted(codes.packed(parts).to_pylist())
