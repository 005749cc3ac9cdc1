import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from almanac.llm import elias_fano, packing, tokenfile
from almanac.llm.textbytes import blocks, texts_of
from almanac.llm.tokens import Encoder, tokenizer_path
from almanac.session import scratch_path

FILES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
random.seed(3)
BITS = ["a", "Bc", "é", "'s", "'", "!!", "12", " ", "\t", "\n", " ", "  ", "\r\n", "\x00", "\x01", "ǅ", "İ", "\u0301", "\u00a0", "\u3000", "\x1c", "日本", "<|endoftext|>", "👍", "n't", ",", "x,", ".."]
TEXTS = ["".join(random.choice(BITS) for _ in range(random.randint(0, 14))) for _ in range(4000)] + ["word " * 30000, "x" * 40000]


def direct(name, texts):
    found = Tokenizer.from_file(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(x.ids, "<u4") for x in found]


@pytest.mark.parametrize("name,words", FILES)
def test_ids_are_those_of_the_whole_text(name, words):
    encode, got = Encoder(tokenizer_path(name), words), []
    for _, _, texts in blocks(texts_of(pa.array(TEXTS)), 3000):
        ids, begin = encode(texts)
        got += [ids[a:b] for a, b in zip(begin[:-1], begin[1:])]
    for text, a, b in zip(TEXTS, got, direct(name, TEXTS)):
        assert a.tolist() == b.tolist(), text[:80]


def test_a_text_with_more_new_ids_than_the_table_holds(monkeypatch):
    from almanac.llm import tokens

    monkeypatch.setattr(tokens, "POOL_IDS", 64)
    texts = ["few words", " ".join(f"word{i}x{i * 7}" for i in range(300)), "few words again"]
    for name, words in FILES:
        encode = Encoder(tokenizer_path(name), words)
        for _ in range(2):
            ids, begin = encode(texts_of(pa.array(texts)))
            assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [x.tolist() for x in direct(name, texts)]


def test_reading_never_decodes_all_boundaries(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SELECTED", 3)
    monkeypatch.delattr(elias_fano.Sequence, "all")
    path = scratch_path(spark, "test")
    docs = spark.createDataFrame([(i, "w " * (i % 5)) for i in range(20)], "doc_id long, text string").coalesce(1)
    tokenfile.write(docs, path, tokenizer_path("byte_bpe_50k.json"))
    got = sorted(tuple(r) for r in tokenfile.read(spark, path).select("doc_id", "start", "n_tokens").collect())
    sizes = [len(x) + 1 for x in direct("byte_bpe_50k.json", ["w " * (i % 5) for i in range(20)])]
    assert got == [(i, sum(sizes[:i]), sizes[i]) for i in range(20)]


def test_elias_fano_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 128, 129, 1000):
        for top in (0, 1, 5, 1000, 10**9):
            values = np.sort(rng.integers(0, top + 1, n))
            coded = elias_fano.Sequence(elias_fano.encode(values))
            assert (coded.all() == values).all()
            assert [coded.select(i) for i in range(n)] == values.tolist()
            places = rng.permutation(n)
            assert (coded.many(places) == values[places]).all()
    # long gaps: many empty bytes between two numbers
    values = np.array([0, 3, 3, 3, 10**12, 10**12 + 1, 2**55])
    assert (elias_fano.Sequence(elias_fano.encode(values)).many(np.arange(7)) == values).all()
    assert len(elias_fano.encode(np.arange(0, 10**7, 100))) < 10**5 * 10 / 8 + 10**5


ROWS = [(7, "Some text, twice."), (3, None), (5, ""), (7, "Another"), (None, "no id"), (-2, "x " * 4000), (9, "é\n\nü")]


def test_files_round_trip_in_order(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "PARTITION_BYTES", 3000)
    path = scratch_path(spark, "test")
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, ids int")
    tokenfile.write(docs, path, tokenizer_path("byte_bpe_50k.json"))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, start = [], 0
    for (doc_id, _), ids in zip(order, direct("byte_bpe_50k.json", [t for _, t in order])):
        ids = np.append(ids, 0).astype("<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in tokenfile.read(spark, path).collect()), key=lambda r: r[1])
    assert got == expected
    record = spark.read.parquet(path).orderBy("part", "seq").first()
    first = tokenfile.document(spark, path, record["part"], record["seq"], 0)
    assert first.tolist() == direct("byte_bpe_50k.json", ["no id"])[0].tolist() + [0]


def test_empty_table_makes_empty_files(spark):
    path = scratch_path(spark, "test")
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write(docs, path, tokenizer_path("byte_bpe_50k.json"))
    assert tokenfile.read(spark, path).count() == 0
    assert packing.pack(docs, tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_packing_is_gapless_and_tight(spark, capacity):
    random.seed(capacity)
    rows = [(i, " ".join("tok" for _ in range(random.randint(0, 300) // random.choice([1, 9])))) for i in range(300)] + [(5, None), (5, None), (None, "a b")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, offset string")
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=capacity).toPandas()
    expected = []
    for (doc_id, _), ids in zip(rows, direct("word_bpe_49k.json", [t for _, t in rows])):
        ids = np.append(ids, 0).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((-1 if doc_id is None else doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    mine = [tuple(map(int, r)) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).values]
    assert sorted(mine) == sorted(expected)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= capacity
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // capacity) + 1


def test_fullest_is_the_best_subset_sum():
    from itertools import product

    counts = np.array([0, 0, 1, 2, 0, 1, 0, 1, 0, 0, 0, 0])
    for room in range(1, 12):
        lengths = [n for n in range(1, room + 1) if counts[n]]
        best = max((s for c in product(*[range(counts[n] + 1) for n in lengths]) if (s := sum(a * b for a, b in zip(c, lengths))) <= room), default=0)
        found = packing.fullest(counts, room)
        assert sum(a * b for a, b in found) == best and all(b <= counts[a] for a, b in found)
