"""Quality rules as a learned decision list.

The statistics of a text are array expressions on its words and lines, so a
document is judged where it is read, without a shuffle. Sequential covering
learns from labelled statistics: a rule is grown, one threshold condition at a
time, on two thirds of the sample, pruned on the other third, and kept if it is
precise there; the rows that it covers are set aside and the next rule is
grown. The ordered rules become one Spark conditional expression.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table
from waymark.llm.fit import labelled_sample

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Bound of the training sample in documents; least precision of a rule.
BOUND, PRECISION = 8_000, 0.9
#: Size of a list that people can still read: rules, conditions of a rule. ``learn`` warns where a list ends by one of them.
MOST_RULES, MOST_CONDITIONS = 12, 4
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "stop_share", "distinct_share")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three that occurs twice or more."""
    # A window and where it begins, sortable as text: equal windows then stand side by side, in order.
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), F.lpad(i.cast("string"), 9, "0"))
    name = lambda s: F.substring(s, F.lit(1), F.length(s) - 9)
    # Windows that begin at p cover p to p + 2.
    covered = lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def starts(windows: Column, names: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(names, j) == F.get(names, k), F.lit(False))
        here = lambda s, j: F.when(same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))), F.substring(s, -9, 9).cast("int"))
        return F.sort_array(F.filter(F.transform(windows, here), lambda p: p.isNotNull()))

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return F.when(F.size(words) >= 3, let(windows, lambda s: let(F.transform(s, name), lambda n: let(starts(s, n), covered)))).otherwise(F.lit(0))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and the shares that rules are made of.

    A null text has no words, lines or symbols. Columns of ``docs`` with these
    names are replaced, and its other columns stay.
    """
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.aggregate(w, zero, lambda a, x: a + F.length(x)).alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("distinct"),
    )
    of_lines = lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    got = F.struct(
        let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words).alias("w"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines).alias("l"),
        *[F.regexp_count(text, F.lit(p)).cast("long").alias(n) for n, p in (("n_symbols", SYMBOLS), ("upper", "[A-Z]"), ("stops", "[.,;:!?]"))],
    )
    own = "got_"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    # A generator, so that no filter on the statistics is moved below it and computes them again.
    d = docs.withColumn(own, F.explode(F.array(got))).drop("text")
    d = d.withColumns({n: F.col(f"{own}.{x}{n}") for x, n in (("w.", "n_words"), ("w.", "word_chars"), ("", "n_symbols"), ("l.", "n_dup_lines"), ("w.", "n_repeat_words"))})
    chars, count = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return d.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "mean_word": F.col("word_chars") / count, "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(f"{own}.l.lines", F.lit(1)), "repeat_share": F.col("n_repeat_words") / count,
        "upper_share": F.col(f"{own}.upper") / chars, "stop_share": F.col(f"{own}.stops") / chars, "distinct_share": F.col(f"{own}.w.distinct") / count,
    }).drop(own)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.value if self.above else row[self.feature] <= self.value

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:g}"


def _best(rows: list[tuple[dict, int]], p0: int) -> Condition | None:
    """The condition of the greatest information gain of ``rows`` (``p0`` of them bad): every threshold between two values of a statistic, by one sort and running sums."""
    before, most, best = math.log2(p0 / len(rows)), 1e-9, None
    for f in FEATURES:
        by = sorted((r[f], y) for r, y in rows)
        below = 0
        for i in range(1, len(by)):
            low, high = by[i - 1][0], by[i][0]
            below += by[i - 1][1]
            if low == high:
                continue
            for above, p, n in ((True, p0 - below, len(by) - i), (False, below, i)):
                if p and (gain := p * (math.log2(p / n) - before)) > most:
                    middle = (low + high) / 2
                    most, best = gain, Condition(f, above, middle if middle < high else low)
    return best


def _grow(rows: list[tuple[dict, int]], most: int) -> list[Condition]:
    """Conditions added one by one for the greatest information gain, until all rows covered are bad."""
    rule: list[Condition] = []
    while True:
        p0 = sum(y for _, y in rows)
        if p0 in (0, len(rows)) or (best := _best(rows, p0)) is None:
            break
        if len(rule) == most:
            warnings.warn(f"a rule stops at {most} conditions", stacklevel=2)
            break
        rule.append(best)
        rows = [(r, y) for r, y in rows if best.holds(r)]
    return rule


def _worth(rule: list[Condition], rows: list[tuple[dict, int]]) -> tuple[float, int]:
    """(smoothed precision, rows covered)."""
    got = [y for r, y in rows if all(c.holds(r) for c in rule)]
    return (sum(got) + 1) / (len(got) + 2), len(got)


def learn(sample: list[dict], precision: float = PRECISION, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> list[list[Condition]]:
    """Rules for bad rows, in order. ``sample``: the statistics, label (1 good), part (0 to 2; 2 prunes)."""
    rows = [(r, 1 - r["label"]) for r in sample]
    grow, prune = [x for x in rows if x[0]["part"] != 2], [x for x in rows if x[0]["part"] == 2]
    rules = []
    while any(y for _, y in grow):
        rule = _grow(grow, most_conditions)
        # Conditions go from the end while the rule is worth no less without them.
        while len(rule) > 1 and _worth(rule[:-1], prune)[0] >= _worth(rule, prune)[0]:
            rule = rule[:-1]
        if not rule or _worth(rule, prune)[0] < precision:
            break
        if len(rules) == most_rules:
            warnings.warn(f"the list stops at {most_rules} rules", stacklevel=2)
            break
        rules.append(rule)
        grow = [x for x in grow if not all(c.holds(x[0]) for c in rule)]
        prune = [x for x in prune if not all(c.holds(x[0]) for c in rule)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True for rows that no rule rejects."""
    out = F.lit(True)
    for rule in reversed(rules):
        all_of = rule[0].column()
        for c in rule[1:]:
            all_of &= c.column()
        out = F.when(all_of, F.lit(False)).otherwise(out)
    return out


def learned_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", bound: int = BOUND) -> list[list[Condition]]:
    """Rules from about ``bound`` labelled documents; none where labels don't say any, or a table is empty.

    Null labels and keys don't count, null texts are empty, whole texts are
    read, and of a key's documents one counts.
    """
    sample = with_statistics(labelled_sample(docs, labels, label, F.lit(True), bound, key))
    part = F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(3)).alias("part")
    rows = sample.where(~F.col("base_failed")).select("label", part, *[F.col(f).cast("double").alias(f) for f in FEATURES]).collect()
    return learn(sorted((r.asDict() for r in rows), key=lambda r: tuple(r.values())))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``docs`` without text, with the statistics and ``kept``: what neither the base rule nor a learned one rejects.

    Null, empty and very long texts, repeated rows, an empty table and columns
    of clashing names are as in ``with_statistics``; a column named kept is replaced.
    """
    return with_statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = judge(docs, learned_rules(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
