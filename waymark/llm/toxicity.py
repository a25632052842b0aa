"""Toxicity: misspelled lexicon terms in their context.

The lexicon is learned from labelled documents: words, and stems that words
begin with, whose documents are labelled toxic far more often than by chance.
Each word of a text is looked up by running its Levenshtein automaton along the
lexicon's trie, so misspelled terms are found too. Every hit is then seen in a
window of its context: within quotation marks it counts as quoted, next to a
form of address as directed at someone. Counts of these kinds, weighted by the
terms' log-odds, are turned into a probability by a logistic model.
Scoring is one pass over the texts; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import Words, table, text_chunks
from waymark.llm.fit import Logistic, fold, labelled_sample

#: Bound of the training sample, in documents.
BOUND = 12_000
STEM_LENGTHS = range(4, 8)
#: Words whose matches a Python worker remembers.
CACHE_WORDS = 400_000
WINDOW = 80
FEATURES = 9

WORD = re.compile(r"[^\W_]+")
# Quotation marks that open and close, forms of address.
QUOTES = (("\"", "\""), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"))
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes ti vos".split())


def slack(term: str, is_stem: bool) -> int:
    """Edits that a misspelling of a term may have."""
    return 0 if len(term) < (6 if is_stem else 5) else 1 if len(term) < 9 or is_stem else 2


class Lexicon:
    """Terms in a trie. A stem stands for all words that begin with it."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.trie: dict = {}
        self.most = 0
        #: Of a longer word this much decides: a term can't be as long, and a stem's part of it is shorter.
        self.reach = max((len(t) + slack(t, s) for t, s, _ in terms), default=0) + 1
        parts: dict[tuple[int, int], set[str]] = {}
        for i, (term, is_stem, _) in enumerate(terms):
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(i)
            k = slack(term, is_stem)
            self.most = max(self.most, k)
            # One of k + 1 parts of a term stays whole under k edits, and moves by k places at most.
            cuts = [round(j * len(term) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                for at in range(max(0, a - k), a + k + 1):
                    parts.setdefault((at, at + b - a), set()).add(term[a:b])
        self.parts = [(a, b, frozenset(s)) for (a, b), s in sorted(parts.items())]
        self.known: dict[str, tuple[int, int] | None] = {}

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        for a, b, some in self.parts:
            if word[a:b] in some:
                break
        else:
            return None
        best: tuple[int, int, int, int] | None = None
        n = len(word)
        stack = [(self.trie, tuple(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            for i in node.get("", ()):
                term, is_stem, _ = self.terms[i]
                edits = min(row) if is_stem else row[n]
                if edits <= slack(term, is_stem):
                    best = min(best, (edits, is_stem, -len(term), i)) if best else (edits, is_stem, -len(term), i)
            for c, child in node.items():
                if not c:
                    continue
                # One step of the automaton that accepts what lies within `most` edits of the word.
                next_ = [row[0] + 1]
                for j in range(n):
                    next_.append(min(row[j] + (word[j] != c), row[j + 1] + 1, next_[j] + 1))
                if min(next_) <= self.most:
                    stack.append((child, tuple(next_)))
        return best and (best[3], best[0])

    def match(self, word: str) -> tuple[int, int] | None:
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = self.find(word[: self.reach])
            return found


def in_context(text: str, a: int, b: int) -> tuple[bool, bool]:
    """Whether the hit at a:b is quoted, and whether it is directed at someone."""
    left = text[max(0, a - WINDOW) : a].rpartition("\n")[2]
    right = text[b : b + WINDOW].partition("\n")[0]
    quoted = False
    for opens, closes in QUOTES:
        if opens == closes:
            quoted |= left.count(opens) % 2 == 1 and closes in right
        else:
            quoted |= left.rfind(opens) > left.rfind(closes) and closes in right
    near = WORD.findall(left.lower())[-4:] + WORD.findall(right.lower())[:4]
    return quoted, not ADDRESS.isdisjoint(near)


def features(lexicon: Lexicon, text: str) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    hits = {w: m for w in set(words) if (m := lexicon.match(w))}
    kinds = Counter()
    terms, top = set(), 0.0
    if hits:
        for x in WORD.finditer(low):
            if m := hits.get(x[0]):
                weight = lexicon.terms[m[0]][2]
                quoted, directed = in_context(low, x.start(), x.end())
                kinds["quoted" if quoted else "near" if m[1] else "exact"] += weight
                kinds["n"] += not quoted
                kinds["directed"] += weight * (directed and not quoted)
                if not quoted and not m[1]:
                    terms.add(m[0])
                    top = max(top, weight)
    dense = kinds["n"] / max(len(words), 1)
    return [math.log1p(kinds["exact"]), math.log1p(kinds["near"]), math.log1p(kinds["quoted"]), math.log1p(kinds["directed"]), top, math.log1p(len(terms)), math.sqrt(dense), math.log1p(len(words)) * (kinds["n"] > 0), float(not hits)]


def with_signature(sample: DataFrame) -> DataFrame:
    """text, label, sig: documents that are near copies mostly share the least hash of their five-word runs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b in text_chunks(batch.column(0)):
                words = Words(batch.column(0).slice(a, b - a))
                doc = words.doc_of()
                at, h = words.grams(5, doc)
                sig = np.zeros(b - a, dtype=np.uint64)
                least = np.full(b - a, np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(least, doc[at], h)
                sums = np.add.reduceat(np.append(words.hashes, np.uint64(0)), np.minimum(words.first[:-1], len(words.hashes)))
                sig = np.where(least < np.iinfo(np.uint64).max, least, sums)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sig.view(np.int64))], ["text", "label", "sig"])

    return sample.select("text", "label").mapInArrow(run, "text string, label int, sig long")


def term_counts(sample: DataFrame) -> DataFrame:
    """term, is_stem, n0, n1: the documents of either label that have it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["term", "is_stem", "label", "n"])

        for batch in rows:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
                stems = {w[:k] for w in words for k in STEM_LENGTHS if len(w) > k}
                counts.update((w, False, y) for w in words)
                counts.update((w, True, y) for w in stems)
                if len(counts) > 300_000:
                    yield out()
                    counts.clear()
        yield out()

    got = sample.select("text", "label").mapInArrow(run, "term string, is_stem boolean, label int, n long")
    n = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    return got.groupBy("term", "is_stem").agg(n(0).alias("n0"), n(1).alias("n1"))


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Terms with the log-odds that they speak for label 1, strongest first."""
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    t0, t1 = total.get(0, 0), total.get(1, 0)
    if not t1:
        return []
    c = lambda x: F.col(x).cast("double")
    share = (c("n1") + c("n0")) / (t1 + t0)
    surprise = 2 * (c("n1") * F.log(c("n1") / (share * t1)) + F.when(c("n0") > 0, c("n0") * F.log(c("n0") / (share * max(t0, 1)))).otherwise(0.0))
    odds = F.log((c("n1") + 0.5) / (t1 + 1)) - F.log((c("n0") + 0.5) / (t0 + 1))
    seen = term_counts(sample).where("n1 >= 3")
    good = seen.withColumns({"surprise": surprise, "odds": odds}).where("surprise >= 24 and odds >= 1.5")
    kept: list[tuple[str, bool, float]] = []
    stems: dict[str, float] = {}  # a kept stem's odds
    begun: dict[str, int] = {}  # the documents of the commonest kept term that begins so
    for r in good.orderBy(F.desc("surprise"), "is_stem", F.desc(F.length("term")), "term").collect():
        term, stem = r["term"], r["is_stem"]
        begins = [term[:k] for k in STEM_LENGTHS if k <= len(term)]
        if any(r["odds"] <= stems[b] + 1.0 for b in begins if b in stems) or (stem and begun.get(term, 0) >= 0.7 * r["n1"]):
            continue
        kept.append((term, stem, r["odds"]))
        if stem:
            stems[term] = r["odds"]
        for b in begins:
            begun[b] = max(begun.get(b, 0), r["n1"])
    return kept


def scores(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", key: str = "doc_id", bound: int = BOUND) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1), learned from ``label`` of the rows of ``labels`` that ``allowed`` lets in.

    Whole texts are scored, however long their words; a null text scores as an
    empty one. Repeated rows score alike, and an empty table gives none. Without labels, or with one kind only, every text gets the
    smoothed share of label 1. A column named score is replaced.
    """
    sample = labelled_sample(docs, labels, label, allowed, bound, key)
    sample = with_signature(sample).dropDuplicates(["label", "sig"])
    half = F.pmod(F.xxhash64("sig"), F.lit(3))
    sample = sample.persist()
    terms = learn_lexicon(sample.where(half != 0))
    found = learn_lexicon(sample)
    model = Logistic(*_features_of(sample.where(half == 0), terms))
    sample.unpersist()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(found)
        for batch in rows:
            at = batch.schema.get_field_index("text")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                f = np.array([features(lexicon, t or "") for t in part.column(at).to_pylist()]).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(f))], [*part.schema.names, "score"])

    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")


def _features_of(sample: DataFrame, terms: list) -> tuple[np.ndarray, np.ndarray]:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in rows:
            f = [features(lexicon, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)], ["f", "label"])

    got = sample.select("text", "label").mapInArrow(run, "f array<double>, label int").toPandas()
    return np.array(got["f"].tolist()).reshape(len(got), FEATURES), got["label"].to_numpy()


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scores(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return got.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
