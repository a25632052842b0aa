"""Exact duplicates: the odd cases against plain Python; SQL over the tables is the driver's."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import exact


def brute(rows, largest=True, normalise=lambda t: t):
    groups = {}
    for key, text in rows:
        groups.setdefault(normalise(text or ""), []).append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = (max(known) if largest else min(known)) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        free = True
        for k in keys:
            out.append((k, keep, len(keys), free and k == keep, sha))
            free = free and k != keep
    return sorted(out, key=repr)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "c", "h", 1, 2) for r in rows], "doc_id long, text string, content string, hash string, key int, deal int")
    return sorted((tuple(r) for r in exact.exact_duplicates(spark, docs, **more).collect()), key=repr)


def rows_of(n, seed):
    rnd = random.Random(seed)
    texts = [None, "", "a", "A", "a ", "\u00e9", "e\u0301", "x" * 5000, "x" * 5000 + "y", "x" * 4999]
    return [(rnd.choice([None, i, i, i // 2]), rnd.choice(texts + [f"own {i}", "hot", "hot", "hot"])) for i in range(n)]


@pytest.mark.parametrize("shares", [1000, 3])
def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, monkeypatch, shares):
    monkeypatch.setattr(exact, "SHARES", shares)
    for seed in range(3):
        rows = rows_of(120, seed)
        assert run(spark, rows) == brute(rows)


def test_smallest_key_and_normalised_texts(spark):
    rows = rows_of(60, 7)
    assert run(spark, rows, largest=False, normalise=F.lower) == brute(rows, False, str.lower)


def test_a_hash_that_tells_nothing_apart(spark, monkeypatch):
    """Texts are compared in full: with one hash for all the result is the same."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    monkeypatch.setattr(exact, "LEADING", 1)
    rows = rows_of(80, 9)
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_one_shuffle_of_the_texts(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert exact.exact_duplicates(spark, docs).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
