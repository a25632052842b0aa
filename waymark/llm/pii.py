"""Personal data: patterns, and candidates that boosted trees select.

The base patterns (e-mail, IP, card, phone) always count. Beyond them,
high-recall generators propose spans that may overlap: numbers with any
separators, dotted quads and e-mail addresses in disguise. Boosted trees judge
the format and the context of a candidate. They are trained on a bounded sample
of documents: base matches and disguised forms of them stand for personal
data; spoilt forms (wrong check digit, part above 255, no domain), and
candidates that only look alike, for other text. The threshold of each kind is
calibrated on documents held out, for the wanted precision. Of overlapping
selected candidates the one with the best score stays; none displaces a base span.
All patterns take time in proportion to the text.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.boost import Boosted, threshold_for
from waymark.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents, candidates of a document (drawn from all of them by chance).
BOUND, EACH = 6_000, 40
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Generators of candidates.
_NUMBER = re.compile(r"(?<![\w.+@/=-])\+?\(?[0-9](?:[\s().\-/ ‐-–]{0,2}[0-9]){6,22}(?![\w@=])")
_QUAD = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\.| \. |\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}(?!\w|\.\d)")
_AT = re.compile(r" ?(?:\[at\]|\(at\)|\{at\}|<at>|＠|@) ?| at (?=[A-Za-z0-9-]+(?: dot |\[dot\]|\(dot\)|\.[A-Za-z]))", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|。|．| ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]{2,63})+", re.I)
_NEAR = re.compile(r"[^\W\d_]+")
# Words that often stand before each kind, and before numbers of other sorts.
CONTEXT = {
    "email": frozenset("mail email e contact write reach address correo courriel kontakt".split()),
    "ip": frozenset("ip host server address from login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta cc".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell sms telefon téléphone teléfono móvil".split()),
}
OTHER = frozenset("version v release isbn issn doi rfc section no nr figure table page pages build chapter license".split())
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info co us ca ch at it nl example".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost and non-overlapping for each kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    if not any(c in text for c in "0123456789"):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that may be personal data; spans may overlap."""
    out, last = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        last = m.end()
        if start < m.start() and (h := _HOST.match(text, m.end())):
            out.append((start, 0, h.end()))
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end()) for m in _QUAD.finditer(text)]
        for m in _NUMBER.finditer(text):
            n = len(_digits(m[0]))
            if n >= 13:
                out.append((m.start(), 2, m.end()))
            if n <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    digits, groups = _digits(s), re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    before = [w.lower() for w in _NEAR.findall(text[max(0, start - 48) : start])][-4:]
    tail = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
    return [
        kind, len(s), len(digits), len(groups), max(sizes), min(sizes), luhn(digits) if digits else 0,
        s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count("["), s.startswith("+"),
        all(map(_byte, groups)), len({*s} - {*"0123456789 -.()+[]"}),
        sum(w in CONTEXT[KINDS[kind]] for w in before), sum(w in OTHER for w in before),
        start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum(), tail in DOMAINS, sum(c.isalpha() for c in s) / max(1, len(s)),
        "@" in s or "at]" in s or "at)" in s, len(tail), sizes[0], sizes[-1], s.count("/"),
    ]


N_FEATURES = len(features("a", 0, 0, 1))


def disguised(kind: int, s: str, rnd: random.Random) -> str:
    """Another way in which people write it."""
    if kind == 0:
        user, _, host = s.partition("@")
        at, dot = rnd.choice([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", ".")])
        return user + at + host.replace(".", dot)
    if kind == 1:
        return s.replace(".", rnd.choice([".", "[.]", "(.)", " . ", " dot "]))
    d = _digits(s)
    if kind == 2:
        sep = rnd.choice(["", ".", "/", " ", " - ", "  ", "–"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return rnd.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "+1/{0}/{1}/{2}", "1-{0}-{1}-{2}"]).format(d[:3], d[3:6], d[6:])


def spoilt(kind: int, s: str, rnd: random.Random) -> str:
    """Something that looks alike and isn't."""
    if kind == 0:
        user, _, host = s.partition("@")
        return rnd.choice([f"{user} at {host.split('.')[0]}.{rnd.choice(['Then', 'js', 'py', 'The'])}", f"{user} @ {rnd.randint(1, 99)}.{rnd.randint(10, 99)}", f"{user}@{host.split('.')[0]}.{rnd.randint(10, 99)}"])
    if kind == 1:
        parts = s.split(".")
        parts[rnd.randrange(4)] = str(rnd.randint(256, 999))
        return ".".join(parts)
    d = _digits(s)
    if kind == 2:
        i = rnd.randrange(len(d))
        d = d[:i] + str((int(d[i]) + rnd.randint(1, 9)) % 10) + d[i + 1 :]
        return rnd.choice(["", " ", ".", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    return rnd.choice([f"{rnd.randint(1900, 2100)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", f"{rnd.randint(1900, 2100)}-{rnd.randint(1900, 2100)}", d[:9], d[:8], f"{d[:2]}.{d[2:4]}.{d[4:8]}", f"{d[:5]}/{d[5:9]}"])


def examples(text: str) -> list[tuple[int, list[float], int]]:
    """(kind, features, label) that a document gives for training."""
    rnd = random.Random(hashlib.blake2b(text.encode(), digest_size=8).digest())
    base = base_spans(text)
    out = []
    for start, kind, end in rnd.sample(base, min(EACH // 4, len(base))):
        s, left, right = text[start:end], text[max(0, start - 48) : start], text[end : end + 16]
        for made, y in ((s, 1), (disguised(kind, s, rnd), 1), (disguised(kind, s, rnd), 1), (spoilt(kind, s, rnd), 0), (spoilt(kind, s, rnd), 0)):
            out.append((kind, features(left + made + right, len(left), kind, len(left) + len(made)), y))
    taken = [(a, b) for a, _, b in base]
    some = candidates(text)
    for a, kind, b in sorted(rnd.sample(some, min(EACH, len(some)))):
        if not any(x < b and a < y for x, y in taken):
            out.append((kind, features(text, a, kind, b), 0))
    return out


class Selector:
    def __init__(self, model: Boosted, least: list[float]):
        self.model, self.least = model, least

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        taken = sorted((a, b) for a, _, b in base)
        starts = np.array([a for a, _ in taken])
        tops = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)

        def free(a: int, b: int) -> bool:
            i = int(np.searchsorted(starts, b)) - 1
            return i < 0 or tops[i] <= a

        some = [c for c in candidates(text) if free(c[0], c[2])]
        if not some:
            return []
        score = self.model.score(np.array([features(text, *c) for c in some]))
        good = sorted((-p, c) for p, c in zip(score.tolist(), some) if p >= self.least[c[1]])
        out: list[tuple[int, int, int]] = []  # chosen ones, by place; none overlap
        for _, c in good:
            i = bisect.bisect(out, c)
            if (i == 0 or out[i - 1][2] <= c[0]) and (i == len(out) or c[2] <= out[i][0]):
                out.insert(i, c)
        return out


def learn(docs: DataFrame, bound: int = BOUND, precision: float = PRECISION) -> Selector:
    """Train on at most about ``bound`` documents with a digit or an at sign, picked by the hash of their text."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).where("text rlike '[0-9@]'").select("text", F.xxhash64("text").alias("h"))
    n = texts.count()
    if n > bound:
        texts = texts.where(F.pmod("h", F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    texts = texts.dropDuplicates(["h"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [(h, *x) for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([[float(v) for v in g[2]] for g in got], pa.list_(pa.float64())), pa.array([g[3] for g in got], pa.int32())], ["h", "kind", "f", "y"])

    got = texts.mapInArrow(run, "h long, kind int, f array<double>, y int").toPandas().sort_values(["h", "kind", "y"], kind="stable")
    x = np.array(got["f"].tolist()).reshape(len(got), N_FEATURES)
    y, kind, fit = got["y"].to_numpy(), got["kind"].to_numpy(), got["h"].to_numpy() % 4 != 0
    model = Boosted(x[fit], y[fit])
    held = model.score(x[~fit])
    least = [threshold_for(held[kind[~fit] == k], y[~fit][kind[~fit] == k], precision) for k in range(len(KINDS))]
    return Selector(model, least)


def spans(docs: DataFrame, selector: Selector, key: str = "doc_id") -> DataFrame:
    """``key``, base and added: arrays of (kind, start, end) in code points, by start, then kind.

    Whole texts are searched, however long; null is empty. Repeated rows give
    equal rows, an empty table none; other columns aren't read.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        named = lambda some: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(some)]
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, added = [], []
                for text in part.column(1).to_pylist():
                    found = base_spans(text or "")
                    base.append(named(found))
                    added.append(named(selector.added(text or "", found)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, kind), pa.array(added, kind)], ["key", "base", "added"])

    span = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(F.col(key), "text").mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, base {span}, added {span}").withColumnRenamed("key", key)


def joined(spans_: str):
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets."""
    schema = docs.schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    found = base_spans(text)
                    last, parts = 0, []
                    for a, k, b in sorted(found + selector.added(text, found)):
                        if b > last:
                            parts += [text[last : max(a, last)], f"[{KINDS[k]}]" if a >= last else ""]
                            last = b
                    text = "".join(parts) + text[last:]
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = spans(docs, learn(docs))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(F.array_position(order, a["kind"]).cast("int") - F.array_position(order, b["kind"]).cast("int")))
    return got.withColumn("every", every).select("doc_id", *[n(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"))
