"""Token counts and id files against the tokenizer applied to whole texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from waymark.llm import huffman, tokens
from waymark.llm.common import scratch

TEXTS = [
    None, "", " ", "a", "hello world  two  spaces\n new line", "<|endoftext|> in <|endoftext|>text", "x <|endoftext|> y", "don't we'll I 'm a 's b",
    "日本語 テキスト é ü", "a b c d 1 2 3 4", "tab\tand nbsp space", "long " * 9000, "nospace" * 5000, "a 'll b", "trailing ", " leading", "İ ı ß", "same same", "same same",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def frame(spark, texts):
    return spark.createDataFrame([(i, x, "k", 0) for i, x in enumerate(texts)], "doc_id long, text string, key string, n_tokens int")


def test_counts(spark, plain):
    got = {r["doc_id"]: r for r in tokens.token_counts(frame(spark, TEXTS), limit=5).collect()}
    for i, (text, ids) in enumerate(zip(TEXTS, plain)):
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 5)
    assert tokens.token_counts(frame(spark, [])).count() == 0


def test_random_texts_have_the_same_ids(plain):
    rng = np.random.Generator(np.random.PCG64(5))
    signs = list("ab1 '  \n\t.,#é日\u00a0\u3000\u2003\r") + ["'s", " the", "<|endoftext|>", "word ", "\n", " ", " and so on,"]
    t, e = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    for _ in range(3):  # the table of pieces fills
        texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
        ids, at = e.encode(pa.array(["x", *texts]).slice(1))
        for i, x in enumerate(texts):
            assert t.encode(x, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist(), repr(x)


def test_files_hold_all_ids(spark, plain):
    docs = frame(spark, TEXTS).repartition(3)
    folder = scratch(spark, "huff-test")
    got = {r["key"]: r for r in huffman.read_files(spark, folder, huffman.store(spark, docs, folder)).collect()}
    start = 0
    for i, ids in enumerate(plain):
        ids = np.array(ids + [2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_rows_and_null_keys(spark):
    folder = scratch(spark, "huff-test")
    assert huffman.read_files(spark, folder, huffman.store(spark, frame(spark, []), folder)).count() == 0
    docs = spark.createDataFrame([(None, "a"), (None, "b c"), (4, "x"), (4, "x")], "doc_id long, text string")
    got = huffman.read_files(spark, folder + "2", huffman.store(spark, docs, folder + "2")).orderBy("start").collect()
    assert [r["key"] for r in got] == [4, 4, None, None] and [r["start"] for r in got] == [0, 2, 4, 6]


@pytest.mark.parametrize("longest", [4, 9, 16])
def test_code_lengths(longest):
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 3, 16, 300):
        counts = (rng.pareto(0.3, n) * 10 + 1).clip(max=1e15).astype(np.int64)
        lengths = huffman.code_lengths(counts, longest)
        bound = max(longest, int(np.ceil(np.log2(max(n, 2)))))
        assert lengths.min() >= 1 and lengths.max() <= bound and (2.0 ** -lengths).sum() <= 1
        ids = rng.permutation(n) * 7
        book = huffman.Book(ids, lengths)
        for m in (0, 1, 63, 64, 65, 1000):
            data = rng.choice(ids, m).astype(np.uint32)
            payload, steps = book.encode(data)
            assert (book.decode(payload, m, steps) == data).all()


def test_lengths_are_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (huffman.code_lengths(counts) * counts).sum() == cost


def test_damaged_files_are_refused(spark, tmp_path):
    book = huffman.Book(np.array([1, 2, 3]), np.array([1, 2, 2]))
    whole = book.header() + huffman.write_block(book, [1], [np.array([1, 2, 3, 3], dtype=np.uint32)])
    import io

    assert [k for k, _, _ in huffman.read_blocks(io.BytesIO(whole))] == [[1]]
    for bad in (whole[:-1], b"x" + whole[1:], whole[:20]):
        with pytest.raises(ValueError):
            list(huffman.read_blocks(io.BytesIO(bad)))
