"""Against a plain search, on small tables with odd rows."""

import hashlib
import random
import re

from waymark.llm import decontaminate


def plain(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    cut = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            cut.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for n in {len(x) for x in cut}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in cut:
                    hit |= set(range(s, s + n))
                    met |= {str(i) for i in cut[x] if i is not None}
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def ours(spark, docs, items):
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, win string, n int").repartition(2)
    i = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, h string")
    return sorted((tuple(r) for r in decontaminate.contamination(spark, d, i).collect()), key=str)


def test_small_tables(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("a b c d Éa x1 ZZ the".split()) for _ in range(n))
    items = [(1, say(25)), (2, say(14)), (2, say(9)), (3, "The, Éa! zz"), (4, None), (5, "?!"), (None, say(12)), (7, say(11)), (10, "a x1"), (7, "lone")]
    docs = [(i, say(60)) for i in range(20)] + [(50, None), (51, ""), (52, "... ?"), (53, "The, Éa! zz"), (None, "x " + items[0][1].upper().replace(" ", "-") + " y"), (54, items[1][1]), (54, items[1][1])]
    docs += [(60, ("filler " * 40_000) + items[0][1] + " " + ("filler " * 40_000)), (61, "lone"), (62, "lonely")]
    assert ours(spark, docs, items) == plain(docs, items)
    assert ours(spark, docs, []) == plain(docs, [])
    assert ours(spark, [], items) == []
