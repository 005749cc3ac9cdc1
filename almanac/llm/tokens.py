"""Token ids of whole texts by a public tokenizer, one distinct word at a time.

Texts are cut where the tokenizer's own pre-tokenization always cuts: at a single space or line
break between words, and between a word's last letter and the marks after it. Each distinct word goes through the tokenizer, many in one call, and its
ids stay in a table of fixed size, where a word is found by its hash. A text with other white
space at a cut is encoded whole. Ids are those that the tokenizer gives for the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .textbytes import SPACE, SpanHash, Texts

#: Slots of the table, and ids it holds before it starts anew: about 50 MB a worker process.
SLOT_BITS, POOL_IDS = 21, 8 << 20
AFTER_SPACE = np.uint64(0xA24BAED4963EE407)
MARK = "\x01"
#: ASCII marks, and letters after which a run of them is always a token run of its own.
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[b for b in range(0x7F) if chr(b).isalpha()]] = True


class Encoder:
    """``words=True`` is for tokenizers that drop white space: any white space cuts, and a word
    has the same ids after any of it. Otherwise a space belongs to the word after it."""

    def __init__(self, path: str, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words = words
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        # stands between words that are encoded in one call; no word contains it
        self._between = f" {MARK} " if words else "\n"
        mark = self._tokenizer.encode(MARK if words else "\n", add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark between words")
        self._mark = np.uint32(mark[0])
        # a text that may hold an added token is encoded whole: no cut may fall into one
        added = {t.content.encode()[:2] for t in self._tokenizer.get_added_tokens_decoder().values()}
        self._added = [(t[0], t[1] if len(t) > 1 else None) for t in added]
        self._clear()

    def _clear(self) -> None:
        self._key = np.zeros(1 << SLOT_BITS, np.uint64)
        self._at = np.zeros(1 << SLOT_BITS, np.int32)
        self._size = np.full(1 << SLOT_BITS, -2, np.int32)
        self._pool = np.zeros(POOL_IDS, np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)
        self._pool[0], self._used = self._mark, 1

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has; -1 where they depend on the text around it."""
        sizes = np.full(len(pieces), -1, np.int64)
        if self._words:
            plain = [i for i, p in enumerate(pieces) if MARK not in p]
        else:
            bodies = (p[1:] if p[0] == " " else p for p in pieces)
            plain = [i for i, p in enumerate(bodies) if not (p[0].isspace() or p[-1].isspace())]
        if not plain:
            return np.zeros(0, np.uint32), sizes
        (ids,) = self._whole([self._between.join([pieces[i] for i in plain] + [""])])
        ends = np.flatnonzero(ids == self._mark)
        if len(ends) != len(plain):
            raise ValueError("a word contains the mark")
        sizes[plain] = np.diff(np.concatenate(([-1], ends))) - 1
        return np.delete(ids, ends), sizes

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one entry more than texts)."""
        start, end, first = texts.runs(~SPACE)
        n, data = len(start), texts.data
        spaced = np.zeros(n, bool)
        line = np.zeros(n, bool)
        whole = np.zeros(len(texts), bool)
        if not self._words:
            # regular: words apart by one space or line break, none at the ends
            head = np.zeros(n, bool)
            filled = np.flatnonzero(first[1:] > first[:-1])
            head[first[filled]] = True
            gap = np.ones(n, np.int64)
            gap[1:] = start[1:] - end[:-1]
            before = data[np.maximum(start - 1, 0)] if n else np.zeros(0, np.uint8)
            spaced, line = ~head & (before == 0x20), ~head & (before == 0x0A)
            bad = ~head & ((gap != 1) | ~(spaced | line))
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            whole[text[bad]] = True
            whole[filled] |= (start[first[filled]] != texts.offsets[filled]) | (end[first[filled + 1] - 1] != texts.offsets[filled + 1])
            whole |= (first[1:] == first[:-1]) & (texts.offsets[1:] > texts.offsets[:-1])
        for one, two in self._added:
            here = np.flatnonzero(data == one)
            here = here if two is None else here[here + 1 < len(data)]
            here = here if two is None else here[data[here + 1] == two]
            whole[np.searchsorted(texts.offsets, here, side="right") - 1] = True
        start, end, spaced, line, first = _marks_apart(data, start, end, spaced, line, first)
        n = len(start)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        key = SpanHash(data)(start, end) ^ np.where(spaced, AFTER_SPACE, np.uint64(0)) if n else np.zeros(0, np.uint64)
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, size = self._at[slot].astype(np.int64), self._size[slot].astype(np.int64)
        miss = np.flatnonzero((self._key[slot] != key) | (size == -2))
        if len(miss):
            fresh, one, where = np.unique(key[miss], return_index=True, return_inverse=True)
            one = miss[one]
            raw = data.tobytes()
            pieces = [raw[a:b].decode() for a, b in zip(start[one] - spaced[one], end[one])]
            ids, sizes = self._new(pieces)
            if self._used + len(ids) > POOL_IDS:
                if self._used == 1:
                    # more new ids than the empty table holds: the tokenizer itself gives every text's ids
                    raw = data.tobytes()
                    parts = self._whole([raw[a:b].decode() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])])
                    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                self._clear()
                return self(texts)
            places = self._used + np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
            self._pool[self._used : self._used + len(ids)] = ids
            self._used += len(ids)
            at[miss], size[miss] = places[where], sizes[where]
            own = slot[one]
            self._key[own], self._at[own], self._size[own] = fresh, places, sizes
        whole[text[size < 0]] = True
        size = np.maximum(size, 0)
        # a line break is an id of its own before its word
        entries = n + int(line.sum())
        place = np.arange(n) + np.cumsum(line)
        all_at, all_size = np.zeros(entries, np.int64), np.ones(entries, np.int64)
        all_at[place], all_size[place] = at, size
        flat = np.concatenate(([0], np.cumsum(all_size)))
        ids = self._pool[np.repeat(all_at - flat[:-1], all_size) + np.arange(flat[-1])].astype(np.uint32)
        lines = np.concatenate(([0], np.cumsum(line)))
        begin = flat[first + lines[first]]
        if not whole.any():
            return ids, begin
        rows = np.flatnonzero(whole)
        raw = data.tobytes()
        redone = dict(zip(rows.tolist(), self._whole([raw[texts.offsets[r] : texts.offsets[r + 1]].decode() for r in rows])))
        parts = [redone[r] if r in redone else ids[begin[r] : begin[r + 1]] for r in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _marks_apart(data, start, end, spaced, line, first):
    """The same words with the marks after a last letter as pieces of their own."""
    n = len(start)
    if n == 0:
        return start, end, spaced, line, first
    letter = ASCII_LETTER[data]
    # Latin-1 letters are 0xC3 and a second byte, but for the signs of multiplication and division
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    body = np.maximum.accumulate(np.where(MARKS[data], -1, np.arange(len(data))))[end - 1]
    cut = (body >= start) & (body < end - 1) & letter[body]
    place = np.arange(n) + np.cumsum(cut) - cut
    total = n + int(cut.sum())
    tail = place[cut] + 1
    starts, ends = np.zeros(total, np.int64), np.zeros(total, np.int64)
    starts[place], ends[place] = start, np.where(cut, body + 1, end)
    starts[tail], ends[tail] = body[cut] + 1, end[cut]
    out = []
    for flag in (spaced, line):
        wide = np.zeros(total, bool)
        wide[place] = flag
        out.append(wide)
    return starts, ends, *out, np.append(place, total)[first]


@lru_cache(maxsize=2)
def encoder(path: str, words: bool) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, words)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
