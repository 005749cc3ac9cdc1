"""Two tokenizers side by side: which ids of one cover the same bytes as which ids of the other.

Byte offsets where tokens of both end cut a text into groups; the tokens of a group are linked. For
most groups, one token of each with the same bytes, a table made once from the two vocabularies says
which id meets which, so their documents are counted in vectors as long as the vocabulary. Only the
other id pairs are counted by a shuffle, once a block of documents and not once a document.

Texts are tokenized once. What a document needs for its sums (its ids, and its places among the
distinct pairs of its block) is written to the shared folder and met there by the counts.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .textbytes import SpanHash, Texts, blocks, texts_of
from .tokens import Encoder

#: Bytes of text that are aligned at a time, and whose documents share a list of distinct pairs.
PART_BYTES, BLOCK_BYTES = 1 << 19, 16 << 20
#: Links of one group beyond which they are counted by distinct ids.
WIDE_GROUP = 1 << 20
#: Distinct words whose ids a task remembers.
KNOWN_WORDS = 1 << 20
B_BITS = 15
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Table:
    """The bytes of every id of a vocabulary, one after another."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self._at = np.concatenate(([0], np.cumsum(self.size)))
        self._data = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self._data[spread(self._at[ids], self.size[ids])]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every run, in a row."""
    after = np.concatenate(([0], np.cumsum(sizes)))
    return np.repeat(starts - after[:-1], sizes) + np.arange(after[-1])


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that is printable, else as the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel(Encoder):
    """Ids of a space and the text; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, words=False)
        self._tokenizer.encode_special_tokens = True
        self._added = []
        decoded = byte_of_character()
        with open(path, encoding="utf-8") as file:
            special = {t["id"] for t in json.load(file)["added_tokens"]}
        entries = [b""] * self.vocabulary
        for token, number in self._tokenizer.get_vocab(with_added_tokens=True).items():
            entries[number] = token.encode() if number in special else bytes(decoded[c] for c in token)
        self.entries, self.table = entries, Table(entries)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        # behind a letter a space and what follows it are cut as at the beginning; that letter's id goes
        sizes = np.diff(texts.offsets)
        offsets = texts.offsets + 2 * np.arange(len(texts) + 1)
        data = np.empty(int(offsets[-1]), np.uint8)
        data[offsets[:-1]], data[offsets[:-1] + 1] = ord("x"), ord(" ")
        data[spread(offsets[:-1] + 2, sizes)] = texts.data
        ids, begin = self(Texts(data, offsets))
        return np.delete(ids, begin[:-1]), begin - np.arange(len(begin))


class Pieces:
    """Ids of a text by a piece model, which puts a space before it and never joins across one."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self._model.get_piece_size()
        if size > 1 << B_BITS:
            raise ValueError(f"the piece model has more than {1 << B_BITS} ids")
        pieces = [self._model.id_to_piece(i) for i in range(size)]
        self.is_byte = [self._model.is_byte(i) for i in range(size)]
        self.entries = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, self.is_byte)]
        self.table = Table(self.entries)
        self._clear()

    def _clear(self) -> None:
        self._key = np.zeros(0, np.uint64)
        self._at = self._size = np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint16)

    def _raw(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._model.encode([t.decode() for t in texts], num_threads=1)
        sizes = np.array([len(f) for f in found], np.int64)
        return np.fromiter((i for f in found for i in f), np.uint16, int(sizes.sum())), sizes

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin. Texts with two spaces together, or one at an end, go whole."""
        inside = np.ones(256, bool)
        inside[0x20] = False
        start, end, first = texts.runs(inside)
        count = np.diff(first)
        text = np.repeat(np.arange(len(texts)), count)
        whole = count == 0
        head = np.zeros(len(start), bool)
        head[first[:-1][count > 0]] = True
        before = np.concatenate(([0], end[:-1])) if len(end) else end
        whole[text[~head & (start != before + 1)]] = True
        filled = np.flatnonzero(count)
        whole[filled] |= (start[first[filled]] != texts.offsets[filled]) | (end[first[filled + 1] - 1] != texts.offsets[filled + 1])
        word = np.flatnonzero(~whole[text])
        keys, one, where = np.unique(SpanHash(texts.data)(start[word], end[word]), return_index=True, return_inverse=True)
        self._learn(keys, texts.data, start[word[one]], end[word[one]])
        place = np.searchsorted(self._key, keys)[where]
        sizes, at = self._size[place], self._at[place]
        raw = texts.data.tobytes()
        rows = np.flatnonzero(whole)
        own, own_sizes = self._raw([raw[texts.offsets[r] : texts.offsets[r + 1]] for r in rows])
        # the words of a text, or the text itself, in order
        entry_text = np.concatenate((text[word], rows))
        order = np.argsort(entry_text, kind="stable")
        all_sizes = np.concatenate((sizes, own_sizes))[order]
        all_at = np.concatenate((at, len(self._pool) + np.cumsum(own_sizes) - own_sizes))[order]
        ids = np.concatenate((self._pool, own))[spread(all_at, all_sizes)]
        per_text = np.bincount(entry_text[order], all_sizes, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self._key) + len(keys) > KNOWN_WORDS:
            self._clear()
        at = np.searchsorted(self._key, keys)
        fresh = np.ones(len(keys), bool)
        if len(self._key):
            fresh = self._key[np.minimum(at, len(self._key) - 1)] != keys
        new = np.flatnonzero(fresh)
        if not len(new):
            return
        raw = data.tobytes()
        ids, sizes = self._raw([raw[a:b] for a, b in zip(start[new], end[new])])
        self._key = np.insert(self._key, at[new], keys[new])
        self._at = np.insert(self._at, at[new], len(self._pool) + np.cumsum(sizes) - sizes)
        self._size = np.insert(self._size, at[new], sizes)
        self._pool = np.concatenate((self._pool, ids))


def same_bytes(a: list[bytes], b: list[bytes], is_byte: list[bool]) -> np.ndarray:
    """Per id of the first vocabulary the id of the second with the same bytes, or -1. A piece goes before a bare byte."""
    known = {}
    for byte in (True, False):
        known |= {entry: number for number, entry in enumerate(b) if is_byte[number] == byte}
    return np.array([known.get(entry, -1) for entry in a], np.int64)


class Sums:
    """Of some texts: numbers a text, the digest of its groups, and its links by distinct id pair."""

    def __init__(self, texts: Texts, left: ByteLevel, right: Pieces, identity: np.ndarray):
        n = len(texts)
        sizes = np.diff(texts.offsets)
        rows = np.flatnonzero(sizes)
        a, a_begin, b, b_begin, rows = self._tokens(texts.take(rows), rows, left, right)
        self.n = np.zeros((n, 4), np.int64)
        self.digest = [""] * n
        a_end, b_end = np.cumsum(left.table.size[a]), np.cumsum(right.table.size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_first = np.concatenate(([0], np.searchsorted(a_end, ends) + 1))
        b_first = np.concatenate(([0], np.searchsorted(b_end, ends) + 1))
        n_a, n_b = np.diff(a_first), np.diff(b_first)
        # tokens of one text never reach into the next, so every group is of one text
        group_text = np.searchsorted(a_begin, a_first[:-1], side="right") - 1
        groups = np.bincount(group_text, minlength=len(rows))
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, group_text, n_a * n_b)
        self.n[rows] = np.stack((np.diff(a_begin), np.diff(b_begin), groups, links), axis=1)
        for row, digest in zip(rows.tolist(), self._digests(a, b, a_first, b_first, np.concatenate(([0], np.cumsum(groups))))):
            self.digest[row] = digest
        doc = rows[group_text]
        plain = (n_a == 1) & (n_b == 1)
        plain[plain] = identity[a[a_first[:-1][plain]]] == b[b_first[:-1][plain]]
        same = [(doc[plain] << 16 | a[a_first[:-1][plain]], None)]
        other = []
        for link_doc, link_a, link_b, times in self._irregular(np.flatnonzero(~plain), doc, a, b, a_first, b_first):
            # the same two ids can also meet in a wider group; they count with the plain ones
            alike = identity[link_a] == link_b
            some = None if times is None else times[alike]
            same.append((link_doc[alike] << 16 | link_a[alike], some))
            some = None if times is None else times[~alike]
            other.append((link_doc[~alike] << 31 | link_a[~alike] << B_BITS | link_b[~alike], some))
        self.same, self.same_times = _summed(same)
        self.other, self.other_times = _summed(other)

    @staticmethod
    def _tokens(texts: Texts, rows: np.ndarray, left: ByteLevel, right: Pieces):
        """Ids of the texts whose tokens, joined, are a space and the text by both tokenizers."""
        a, a_begin = left.encode(texts)
        b, b_begin = right.encode(texts)
        a, b = a.astype(np.int64), b.astype(np.int64)
        sizes = np.diff(texts.offsets) + 1
        good = np.ones(len(texts), bool)
        for ids, begin, table in ((a, a_begin, left.table), (b, b_begin, right.table)):
            total = np.concatenate(([0], np.cumsum(table.size[ids])))[begin]
            good &= np.diff(total) == sizes
            fit = np.flatnonzero(np.diff(total) == sizes)
            joined = table.bytes_of(ids[spread(begin[fit], np.diff(begin)[fit])])
            wanted = np.full(len(joined), 0x20, np.uint8)
            at = np.concatenate(([0], np.cumsum(sizes[fit])))
            wanted[spread(at[:-1] + 1, sizes[fit] - 1)] = texts.take(fit).data
            good[fit[np.searchsorted(at, np.flatnonzero(joined != wanted), side="right") - 1]] = False
        kept = np.flatnonzero(good)
        parts = []
        for ids, begin in ((a, a_begin), (b, b_begin)):
            counts = np.diff(begin)[kept]
            parts += [ids[spread(begin[kept], counts)], np.concatenate(([0], np.cumsum(counts)))]
        return *parts, rows[kept]

    @staticmethod
    def _digests(a, b, a_first, b_first, first_group):
        """SHA-256 of every text's groups, written out."""
        count = len(a) + len(b)
        ids, mark = np.zeros(count, np.int64), np.full(count, ord(","), np.uint8)
        n_a, n_b = np.diff(a_first), np.diff(b_first)
        at_a = np.arange(len(a)) + np.repeat(b_first[:-1], n_a)
        at_b = np.arange(len(b)) + np.repeat(a_first[1:], n_b)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[a_first[1:] - 1]], mark[at_b[b_first[1:] - 1]] = ord("|"), ord(";")
        width = np.ones(count, np.int64)
        for power in (10, 100, 1000, 10_000, 100_000):
            width += ids >= power
        end = np.cumsum(width + 1)
        out = np.empty(int(end[-1]) if count else 0, np.uint8)
        out[end - 1] = mark
        rest, left = ids, np.arange(count)
        for place in range(2, 8):
            out[end[left] - place] = ord("0") + rest % 10
            more = rest >= 10
            rest, left = rest[more] // 10, left[more]
        token = a_first[first_group] + b_first[first_group]
        edges = np.concatenate(([0], end))[token]
        written = memoryview(out)
        return [hashlib.sha256(written[low : high - 1]).hexdigest() for low, high in zip(edges[:-1], edges[1:])]

    @staticmethod
    def _irregular(chosen, doc, a, b, a_first, b_first):
        """Document and ids of every link of the chosen groups; with their number where a group is wide."""
        n_a, n_b = np.diff(a_first)[chosen], np.diff(b_first)[chosen]
        links = n_a * n_b
        wide = links > WIDE_GROUP
        some = np.flatnonzero(~wide)
        width = n_b[some]
        group = np.repeat(some, links[some])
        local = spread(np.zeros(len(some), np.int64), links[some])
        width = np.repeat(width, links[some])
        yield (
            doc[chosen[group]],
            a[a_first[chosen[group]] + local // width],
            b[b_first[chosen[group]] + local % width],
            None,
        )
        for g in chosen[wide]:
            left, left_n = np.unique(a[a_first[g] : a_first[g + 1]], return_counts=True)
            right, right_n = np.unique(b[b_first[g] : b_first[g + 1]], return_counts=True)
            yield np.full(len(left) * len(right), doc[g]), np.repeat(left, len(right)), np.tile(right, len(left)), np.outer(left_n, right_n).ravel()


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)])
    keys, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    if all(t is None for _, t in parts):
        return keys, counts
    times = np.concatenate([np.ones(len(k), np.int64) if t is None else t for k, t in parts])
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, where, times)
    return keys, counts


def narrow(values: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs, which the first byte tells."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


DOCUMENT, PAIRS, PLAIN = 0, 1, 2
WRITTEN = (
    "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same binary, same_times binary, other binary, other_times binary, ids array<long>, documents array<long>"
)
ALIGNED = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string"


class Block:
    """The documents of one block until it is written."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows, self.other = number, 0, [], []

    def add(self, ids: pa.Array, texts: Texts, sums: Sums, plain: np.ndarray) -> None:
        base = len(self.rows)
        self.bytes += int(texts.offsets[-1])
        plain += np.bincount(sums.same & 0xFFFF, minlength=len(plain))
        edges = np.arange(len(texts) + 1, dtype=np.int64)
        same, other = np.searchsorted(sums.same, edges << 16), np.searchsorted(sums.other, edges << 31)
        self.other.append(sums.other & (1 << 31) - 1)
        for row, name in enumerate(ids.to_pylist()):
            own, rest = slice(same[row], same[row + 1]), slice(other[row], other[row + 1])
            self.rows.append(
                [name, *sums.n[row].tolist(), sums.digest[row], narrow(sums.same[own] & 0xFFFF), narrow(sums.same_times[own]),
                 rest.stop - rest.start, narrow(sums.other_times[rest])]
            )

    def batch(self) -> pa.RecordBatch:
        found = np.concatenate([np.zeros(0, np.int64), *self.other])
        pairs, where, counts = np.unique(found, return_inverse=True, return_counts=True)
        at = 0
        for row in self.rows:
            row[8], at = narrow(where[at : at + row[8]]), at + row[8]
        columns = [list(c) for c in zip(*self.rows)]
        kinds, last = [DOCUMENT] * len(self.rows) + [PAIRS], [None]
        return _written(
            kinds, [self.number] * len(kinds), [c + last for c in columns], [None] * len(self.rows) + [pairs], [None] * len(self.rows) + [counts]
        )


def _written(kinds, blocks_, columns, ids, documents) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 4
    names = [field.split()[0] for field in WRITTEN.split(", ")]
    arrays = [pa.array(kinds, pa.int32()), pa.array(blocks_, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))]
    arrays += [pa.array(c, pa.list_(pa.int64())) for c in (ids, documents)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


@lru_cache(maxsize=1)
def _pair_of(a: str, b: str):
    left, right = ByteLevel(a), Pieces(b)
    return left, right, same_bytes(left.entries, right.entries, right.is_byte)


def tokenized(docs: DataFrame, a: str, b: str) -> DataFrame:
    """What every document holds, the distinct irregular pairs of every block with their number of
    documents, and of every task how many documents hold each id that meets its same bytes."""

    def run(batches):
        left, right, identity = _pair_of(a, b)
        plain = np.zeros(left.vocabulary, np.int64)
        first = TaskContext.get().partitionId() << 32
        block = Block(first)
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, texts in blocks(texts_of(batch.column("text")), PART_BYTES):
                block.add(ids.slice(low, high - low), texts, Sums(texts, left, right, identity), plain)
                if block.bytes >= BLOCK_BYTES:
                    yield block.batch()
                    block = Block(block.number + 1)
        if block.rows:
            yield block.batch()
        some = np.flatnonzero(plain)
        if len(some):
            yield _written([PLAIN], [None], [[None]] * 10, [some], [plain[some]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WRITTEN)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``) the token and group counts of vocabularies ``a`` (byte-level, of a
    space and the text) and ``b`` (pieces), its links, how many of them are with an id pair that
    no other pair of that ``a`` id beats in documents (``n_best``), the sum of those documents
    over all links (``count_sum``) and the digest of the groups.

    Texts that are null or empty, or that the joined tokens of a vocabulary do not give back,
    have zeros and an empty digest and count for no pair. Repeated rows are documents each, also
    under one id or a null one. Other columns are not read. A text longer than a block is a
    block of its own; a group's links are counted by distinct ids where they are many.
    """
    found = materialize(tokenized(docs, a, b), "aligned")
    listed = found.where(F.col("kind") == PAIRS).select(F.col("block").alias("asking"), F.explode(F.arrays_zip("ids", "documents")).alias("e"))
    asked = listed.select("asking", F.col("e.ids").alias("pair"), F.col("e.documents").alias("documents"))
    counts = asked.groupBy("pair").agg(F.sum("documents").alias("count"))
    counts = materialize(counts, "pair-counts")
    told = found.where(F.col("kind") == PLAIN).select(F.explode(F.arrays_zip("ids", "documents")).alias("e"))
    same = told.groupBy(F.col("e.ids").alias("a")).agg(F.sum("e.documents").alias("count"))
    same = materialize(same, "same-counts")
    best = counts.select(F.shiftright("pair", B_BITS).alias("a"), "count").unionByName(same).groupBy("a").agg(F.max("count").alias("count"))
    # two vectors as long as the vocabulary, whatever the corpus
    vectors = docs.sparkSession.sparkContext.broadcast((_vector(same), _vector(best)))
    replies = asked.join(counts, "pair").select("asking", "pair", "count")
    documents = found.where(F.col("kind") == DOCUMENT).drop("kind", "ids", "documents")

    def add(rows: pa.Table, told: pa.Table) -> pa.Table:
        same_count, best_count = vectors.value
        told = told.sort_by("pair")
        pair, count = told["pair"].to_numpy(), told["count"].to_numpy()
        is_best = count == best_count[pair >> B_BITS]
        n_best, total = [], []
        for ids, times, places, other_times in zip(*(rows[c].to_pylist() for c in ("same", "same_times", "other", "other_times"))):
            ids, times, places, other_times = wide(ids), wide(times), wide(places), wide(other_times)
            own = same_count[ids]
            n_best.append(int(times[own == best_count[ids]].sum() + other_times[is_best[places]].sum()))
            total.append(int(times @ own + other_times @ count[places]))
        made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({c: made[c] if c in made else rows[c] for c in ("doc_id", *SUMS, "groups_sha256")})

    return documents.groupBy("block").cogroup(replies.groupBy("asking")).applyInArrow(add, ALIGNED)


def _vector(counts: DataFrame) -> np.ndarray:
    rows = counts.toArrow()
    out = np.zeros(1 + (pc.max(rows["a"]).as_py() or 0), np.int64)
    out[rows["a"].to_numpy()] = rows["count"].to_numpy()
    return out
