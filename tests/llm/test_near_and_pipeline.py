"""Near duplicates against all pairs; the pipeline's stages, each on its own input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import near


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())


def test_edits_within():
    rnd = random.Random(0)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    for _ in range(1500):
        a = [rnd.randrange(3) for _ in range(rnd.randint(0, 14))]
        b = [x for x in a if rnd.random() > 0.15] if rnd.random() < 0.7 else [rnd.randrange(3) for _ in range(rnd.randint(0, 14))]
        d, most = plain(a, b), rnd.randint(0, 8)
        assert near.edits_within(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most) == (d if d <= most else None), (a, b, most)


def texts():
    rnd = random.Random(12)
    say = lambda n: [rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") + rnd.choice("bcdfgklmnprst") + str(rnd.randrange(90)) for _ in range(n)]
    rows, i = [], 0
    for g in range(14):
        t = say(rnd.choice([12, 60, 400]))
        for _ in range(rnd.choice([1, 2, 25])):
            w = list(t)
            for _ in range(int(len(w) * rnd.choice([0, 0.005, 0.01, 0.02, 0.05]))):
                w[rnd.randrange(len(w))] = say(1)[0]
            rows.append((i, " ".join(w)))
            i += 1
    shared = " ".join(say(60))
    rows += [(1000 + k, shared + " " + " ".join(say(80))) for k in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "?!"), (2003, "?!"), (2004, "a b c"), (2005, "A, b. C"), (2006, "a b"), (None, "A b c"), (3, dict(rows)[3]), (3, dict(rows)[3]), (2010, " ".join(say(30_000)))]
    return rows


def test_classes_are_those_of_all_pairs(spark):
    rows = texts()
    got = near.near_duplicates(spark, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, bucket int").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in got}
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cut = {i: words(t) for i, t in rows}
    sets = {i: ({tuple(cut[i][j : j + 5]) for j in range(len(cut[i]) - 4)}, tuple(cut[i]) or t or "") for i, t in rows}
    keys = list(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            (x, u), (y, v) = sets[a], sets[b]
            if u == v or (x and y and len(x & y) >= 0.8 * len(x | y)):
                parent[top(a)] = top(b)
    want = {}
    for i in keys:
        want.setdefault(top(i), set()).add(i)
    found = {}
    for i, c in by.items():
        found.setdefault(c, set()).add(i)
    order = lambda some: sorted(sorted(map(str, s)) for s in some)
    assert order(found.values()) == order(want.values())
    assert sum(r["keep"] for r in got) == len(want)
    for c, s in found.items():
        assert c == min((i for i in s if i is not None), default=None)


def classes_of_one_bucket(spark, monkeypatch, rows):
    """class_id by doc_id when all texts share their only key, so that all rests on how the bucket is split."""
    real = near.sketches
    monkeypatch.setattr(near, "sketches", lambda *a: real(*a).withColumn("keys", F.array(F.lit(1).cast("long"))))
    got = near.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")).collect()
    return {r["doc_id"]: r["class_id"] for r in got}


def say(rnd, n):
    return [rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") + rnd.choice("bcdfgklmnprst") + str(rnd.randrange(900)) for _ in range(n)]


def changed(rnd, text, at):
    out = list(text)
    for i in at:
        out[i] = say(rnd, 1)[0]
    return out


def test_copies_in_a_bucket_of_a_shared_passage(spark, monkeypatch):
    rnd = random.Random(3)
    passage = say(rnd, 120)
    rows = [(i, passage + say(rnd, 80)) for i in range(150)]
    rows += [(1000 + i, changed(rnd, rows[i][1], range(130, 190, 18))) for i in range(20)]
    got = classes_of_one_bucket(spark, monkeypatch, [(i, " ".join(w)) for i, w in rows])
    assert [got[1000 + i] for i in range(20)] == list(range(20)) and len(set(got.values())) == 150


def test_copies_of_members_that_are_linked_to_the_centre(spark, monkeypatch):
    rnd = random.Random(5)
    base = say(rnd, 500)
    drifted = changed(rnd, base, range(5, 45, 10))
    rows = [(0, base)] + [(1 + i, changed(rnd, drifted, [50])) for i in range(60)]
    for i in range(12):  # b is linked to all of those, d only to b
        b = changed(rnd, drifted, [60 + i])
        rows += [(100 + i, b), (200 + i, changed(rnd, b, [100 + i + 31 * k for k in range(11)]))]
    got = classes_of_one_bucket(spark, monkeypatch, [(i, " ".join(w)) for i, w in rows])
    assert sum(got[200 + i] == 0 for i in range(12)) == 12


def test_copies_that_are_cut_short(spark, monkeypatch):
    rnd = random.Random(7)
    base = say(rnd, 600)
    rows = [(i, changed(rnd, base, [560 + i % 30])) for i in range(60)] + [(100, base[:540]), (200, base[:468])]
    got = classes_of_one_bucket(spark, monkeypatch, [(i, " ".join(w)) for i, w in rows])
    assert set(got.values()) == {0}


def rows_of_joins(spark, on, since=-1):
    """Rows that joins by these columns made in executions after ``since``, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    made, ids = 0, [e.executionId() for e in seq(store.executionsList())]
    for i in (i for i in ids if i > since):
        got = store.executionMetrics(i)
        for node in seq(store.planGraph(i).allNodes()):
            if "Join" in node.name() and re.search(r"\[" + ", ".join(rf"{c}#\d+L?" for c in on), node.desc()):
                counts = [m.accumulatorId() for m in seq(node.metrics()) if m.name() == "number of output rows"]
                made += sum(int(got.apply(c).replace(",", "")) for c in counts if got.contains(c))
    return made, max(ids, default=-1)


def test_what_members_lack_meets_its_count_by_group(spark, monkeypatch):
    rnd = random.Random(11)
    base = say(rnd, 300)
    rows = [(i, changed(rnd, base, rnd.sample(range(300), 30))) for i in range(60)]
    rows += [(100 + i, changed(rnd, rows[i][1], [150])) for i in range(10)]
    _, last = rows_of_joins(spark, ["group", "x"])
    got = classes_of_one_bucket(spark, monkeypatch, [(i, " ".join(w)) for i, w in rows])
    assert got == {i: i % 100 for i, _ in rows}
    made, _ = rows_of_joins(spark, ["group", "x"], last)
    # Of their changed shingles (about 120 of 300 each), what they lack is shared by many, and what they have by copies only.
    assert 0 < made < 70 * 60


def test_pipeline_stage_meets_few_differences(spark, monkeypatch):
    rnd = random.Random(17)
    base = say(rnd, 300)
    rows = [(i, changed(rnd, base, rnd.sample(range(300), 30))) for i in range(60)]
    rows += [(100 + i, changed(rnd, rows[i][1], [150])) for i in range(10)]
    docs = spark.createDataFrame([(i, " ".join(w), "en") for i, w in rows], "doc_id long, text string, lang string").repartition(3, "doc_id")
    real = near.sketches
    monkeypatch.setattr(near, "sketches", lambda *a: real(*a).withColumn("keys", F.array(F.lit(1).cast("long"))))
    _, last = rows_of_joins(spark, ["group", "x"])
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "").collect()
    made, _ = rows_of_joins(spark, ["group", "x"], last)
    assert sorted(r["doc_id"] for r in kept) == list(range(60)) and 0 < made < 70 * 60


def test_members_keep_their_size_and_what_others_have_too(spark):
    rnd = random.Random(13)
    base = say(rnd, 60)
    once = changed(rnd, base, [30])
    rows = [(i, " ".join(base + [f"tail{i}"])) for i in range(10)] + [(10, " ".join(once)), (11, " ".join(once))]
    texts = spark.createDataFrame(rows, "node long, text string")
    got = {r["node"]: r for r in near._members(spark, spark.range(12).selectExpr("7L as `group`", "id as node"), texts).collect()}
    assert [got[i]["m"] for i in (0, 10)] == [57, 56]
    assert [got[i]["d"] for i in (0, 10, 11)] == [1, 10, 10] and [len(got[i]["lacks"]) for i in (0, 10, 11)] == [0, 5, 5]
    assert sorted(got[10]["own"]) == sorted(got[11]["own"]) and len(got[10]["own"]) == 5 and sum(len(got[i]["own"]) for i in range(10)) == 0


def test_short_texts(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        w = say(rnd, 8)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + say(rnd, 1)))]
    got = near.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")).collect()
    assert sum(r["class_id"] != r["doc_id"] // 2 * 2 for r in got) == 0


def test_no_rows(spark):
    assert near.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choice("etaoinsrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    bench = [(i, say(14)) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        t, toxic = say(60), i % 8 == 0
        if toxic:
            t = t.replace(" ", " blockhead ", 3)
        labels.append((i, 1, int(toxic)))
        rows.append((i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t)))
    rows += [(500 + i, rows[i][1] + (" end" if i % 2 else ""), "en", "s1", 0) for i in range(1, 8)]
    rows += [(600 + i, say(20) + " " + bench[i % 5][1], "en", "s2", 0) for i in range(10)]
    rows += [(700, None, None, None, None), (701, "", "en", None, 0), (None, say(50), "en", "s1", 0), (None, say(50), "en", "s1", 0), (9, rows[9][1], "en", "s0", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, None
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, folder)
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        if name == "toxicity":
            assert not {i for i in range(400) if i % 8 == 0} & set(ids) and len({i for i in range(400) if i % 8} - set(ids)) <= 2
        elif name == "near duplicates":
            assert not set(range(501, 508)) & set(ids) and ids.count(9) == 1 and ids.count(None) == 2 and len(ids) >= 350
        elif name == "benchmark decontamination":
            assert not set(range(600, 610)) & set(ids) and len(ids) == before - 10
        elif name == "mixing sources":
            assert set(ids) and max(ids.count(i) for i in set(ids) if i is not None) <= 3
        else:
            assert len(rows) == before and [r["start"] for r in sorted(rows, key=lambda r: r["start"])][0] == 0
            break
        assert out.columns == columns
        before, docs = len(rows), spark.createDataFrame(rows, docs.schema)


def test_stages_on_odd_tables(spark, folder):
    """Columns named as the operators' own come back as they were; a very long text and an empty table pass every stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 or doc_id >= 500 or doc_id is null")
    long = spark.createDataFrame([(9000, " ".join(f"w{i}" for i in range(150_000)), "en", "s9", 0)], docs.schema)
    own = ["score", "node", "h", "size", "label", "item_id", "key", "keep", "text_hash", "f", "x", "a.b"]
    odd = docs.union(long).select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in own])
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, odd, folder)
        rows = out.collect()
        if name == "token ids":
            assert len(rows) == odd.count()
        else:
            assert out.columns == odd.columns and rows
            assert all(r[c] == (c if r["doc_id"] is None else f"{c}-{r['doc_id']}") for r in rows for c in own), name
            assert name == "mixing sources" or 9000 in {r["doc_id"] for r in rows}, name
        assert f(spark, odd.limit(0), folder).count() == 0, name
