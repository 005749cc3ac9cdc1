import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from almanac.llm import alignment, tokens

A, B = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(docs):
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    byte = alignment.byte_of_character()
    bytes_a = lambda i: bytes(byte[c] for c in left.id_to_token(i))
    bytes_b = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    grouped, count = [], Counter()
    for _, text in docs:
        whole = (" " + (text or "")).encode()
        a, b = left.encode(" " + text, add_special_tokens=False).ids if text else [], right.encode(text) if text else []
        if not text or b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            grouped.append(([], [], []))
            continue
        ends = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                at += len(of(i))
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts, i, j = [], 0, 0
        for cut in cuts:
            ni, nj = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            parts.append((a[i:ni], b[j:nj]))
            i, j = ni, nj
        grouped.append((a, b, parts))
        count.update({(x, y) for p, q in parts for x in p for y in q})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (name, _), (a, b, parts) in zip(docs, grouped):
        links = [(x, y) for p, q in parts for x in p for y in q]
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in parts)
        digest = hashlib.sha256(written.encode()).hexdigest() if parts else ""
        out.append((name, len(a), len(b), len(parts), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), digest))
    return out


def aligned(spark, docs, **columns):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name, value in columns.items():
        frame = frame.withColumn(name, F.lit(value))
    return [tuple(r[c] for c in COLUMNS) for r in alignment.align(frame, A, B).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


SOME = [
    None, "", " ", "  ", "\n", "a", " lead", "trail ", "two  spaces", "tab\there", "line\nline\n\nline", "a▁b", "▁", "é é ﬁ ①", "日本語のテキスト 漢字",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "x\x00y", "🙂🙃 naïve façade", "don't we'll I'M", "1234567890 12 3", "a,b.c!?..", "\r\n x", "    ", "Ünïcödé" * 9,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 77, "word " * 50, "A" * 33 + " " + "z" * 40, "﻿bom", " sep", "ﬀ", "é e",
]


def test_matches_a_plain_version(spark):
    random.seed(13)
    syllables = ["ba", "tion", "ment", "éa", "qu", "x", "ing", "un", "ß", "ñ", ".", ",", "\n", "42", "THE", "-"]
    texts = SOME + [" ".join("".join(random.choice(syllables) for _ in range(random.randint(1, 5))) for _ in range(random.randint(1, 60))) for _ in range(120)]
    docs = list(enumerate(texts)) + [(3, "a"), (3, "other words"), (None, "a"), (None, None), (5, "a")]
    assert in_order(aligned(spark, docs, n_a=7, block="x", pair=1)) == in_order(plain(docs))


def test_blocks_and_wide_groups_change_nothing(spark, monkeypatch):
    random.seed(14)
    docs = [(i, " ".join(random.choice(["alpha", "unbelievable", "zzyzx", "naïve", "q"]) for _ in range(30))) for i in range(60)] + list(enumerate(SOME))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    ids = frame.select("doc_id", "text").toArrow()
    left, right, identity = alignment._pair_of(A, B)
    texts = alignment.texts_of(ids["text"])
    usual = alignment.Sums(texts, left, right, identity)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 3)
    other = alignment.Sums(texts, left, alignment.Pieces(B), identity)
    for name in ("n", "same", "same_times", "other", "other_times"):
        assert (getattr(usual, name) == getattr(other, name)).all(), name
    assert usual.digest == other.digest


def test_a_very_long_text(spark):
    random.seed(15)
    words = ["lorem", "ipsumish", "dolor,", "sit", "amétt", "x1"]
    long = " ".join(random.choice(words) for _ in range(300_000))
    run = "ab" * 100_000
    docs = [(1, long), (2, run), (3, "lorem ipsumish")]
    assert in_order(aligned(spark, docs)) == in_order(plain(docs))


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, ""), (2, "")]])
def test_empty_tables_and_texts(spark, docs):
    assert in_order(aligned(spark, docs)) == in_order((i, 0, 0, 0, 0, 0, 0, "") for i, _ in docs)


def test_identity_prefers_pieces_and_knows_every_byte():
    left, right, identity = alignment._pair_of(A, B)
    assert all(right.entries[b] == left.entries[a] for a, b in enumerate(identity) if b >= 0)
    letter = left.entries.index(b"e")
    assert not right.is_byte[identity[letter]]
