"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

Counts of letter n-grams per language are learned from all labelled rows in one pass whose
shuffle has a fixed number of rows a task. A word's script leaves the languages that write in
it; each of those scores the word by its n-grams; Viterbi then labels the words so that a change
of language has to pay a penalty. Labels of words make spans, and letters vote for the document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .textbytes import LOWER, Texts, blocks, texts_of

GRAMS = (3, 4)
BUCKETS = 1 << 16
#: Log-likelihood that a change of language costs; about what one clear word brings.
SWITCH = 12.0
SMOOTH = 0.5
#: A language writes in a script if this share of its letters is in it.
SCRIPT_SHARE = 0.01
CHUNK = 128
UNKNOWN = "und"
MADE = ("lang_pred", "score", "spans")

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True

#: Scripts by the first byte of a UTF-8 sequence, as (first, last) byte; fixed by Unicode's blocks.
SCRIPTS = (
    (0x41, 0x7A),  # Latin, ASCII
    (0xC2, 0xCD),  # Latin with marks
    (0xCE, 0xCF),  # Greek
    (0xD0, 0xD3),  # Cyrillic
    (0xD4, 0xD5),  # Armenian
    (0xD6, 0xD7),  # Hebrew
    (0xD8, 0xDF),  # Arabic and neighbours
    (0xE0, 0xE0),  # Indic, Thai
    (0xE1, 0xE1),  # Georgian, Ethiopic, Khmer
    (0xE2, 0xE2),  # symbols
    (0xE3, 0xE3),  # Kana
    (0xE4, 0xE9),  # Han
    (0xEA, 0xED),  # Hangul
    (0xEE, 0xF4),  # others
)
SCRIPT_OF = np.zeros(256, np.int64)
for _number, (_low, _high) in enumerate(SCRIPTS):
    SCRIPT_OF[_low : _high + 1] = 0 if _number == 1 else _number


class Words:
    """The words of some texts in order, each with its n-gram buckets and script."""

    def __init__(self, texts: Texts):
        n = len(texts)
        # one space after every text, so that no n-gram spans two
        sizes = np.diff(texts.offsets)
        at = np.arange(len(texts.data)) + np.repeat(np.arange(n), sizes)
        data = np.full(len(texts.data) + n, 0x20, np.uint8)
        data[at] = LOWER[texts.data]
        accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[accented] += 0x20
        data[~LETTER[data]] = 0x20
        spaced = Texts(data, texts.offsets + np.arange(n + 1))
        self.start, self.end, self.first = spaced.runs(LETTER)
        self.text = np.repeat(np.arange(n), np.diff(self.first))
        self.script = SCRIPT_OF[data[self.start]] if len(self.start) else np.zeros(0, np.int64)
        self.data = data

    def __len__(self) -> int:
        return len(self.start)

    def grams(self):
        """Per size: buckets of all n-grams in order, and where each word's begin.

        An n-gram may take the space before or after its word but has letters inside.
        """
        padded = np.concatenate(([0x20], self.data)).astype(np.uint64)
        for size in GRAMS:
            code = np.zeros(max(len(padded) - size + 1, 0), np.uint64)
            for k in range(size):
                code = code * np.uint64(256) + padded[k : len(code) + k]
            inside = np.ones(len(code), bool)
            for k in range(1, size - 1):
                inside &= padded[k : len(code) + k] != 0x20
            where = np.flatnonzero(inside)
            buckets = (code[where] * np.uint64(0x9E3779B97F4A7C15 + 2 * size)) >> np.uint64(48)
            yield buckets.astype(np.int64), np.searchsorted(where, np.append(self.start, len(padded)))


def count(docs: DataFrame) -> DataFrame:
    """``lang``, ``slot`` and ``n`` over all of ``docs`` (``text``, ``lang``).

    Slots below ``BUCKETS`` times the number of n-gram sizes are n-gram buckets, those above
    are scripts. Each task adds up in arrays of fixed size before the shuffle.
    """
    slots = len(GRAMS) * BUCKETS + len(SCRIPTS)

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for low, high, texts in blocks(texts_of(batch.column("text"))):
                words = Words(texts)
                for k, (buckets, begin) in enumerate(words.grams()):
                    lang = np.repeat(of[low:high][words.text], np.diff(begin))
                    for number in np.unique(lang):
                        sums = totals.setdefault(names[number], np.zeros(slots, np.int64))
                        sums[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(buckets[lang == number], minlength=BUCKETS)
                for number in np.unique(of[low:high]):
                    own = of[low:high][words.text] == number
                    sums = totals.setdefault(names[number], np.zeros(slots, np.int64))
                    sums[len(GRAMS) * BUCKETS :] += np.bincount(words.script[own], words.end[own] - words.start[own], minlength=len(SCRIPTS)).astype(np.int64)
        for name, sums in totals.items():
            slot = np.flatnonzero(sums)
            for part in np.array_split(slot, max(1, len(slot) // 8192)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part)), pa.array(part.astype(np.int32)), pa.array(sums[part])], names=["lang", "slot", "n"]
                )

    labelled = docs.where("lang is not null and text is not null").select("text", "lang")
    return labelled.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log-probability by n-gram size, language and bucket
    tables: tuple[np.ndarray, ...]
    #: whether a language writes in a script
    writes: np.ndarray


def fit(docs: DataFrame) -> Model:
    """Model from the ``lang`` of ``docs``; its size is languages times ``BUCKETS``, whatever the rows."""
    counted = count(docs).toArrow()
    names = tuple(sorted(set(counted["lang"].to_pylist())))
    sums = np.zeros((len(names), len(GRAMS) * BUCKETS + len(SCRIPTS)))
    of = np.searchsorted(np.array(names, dtype=object), counted["lang"].to_numpy()) if names else np.zeros(0, int)
    sums[of, counted["slot"].to_numpy()] = counted["n"].to_numpy()
    tables = []
    for k in range(len(GRAMS)):
        part = sums[:, k * BUCKETS : (k + 1) * BUCKETS] + SMOOTH
        tables.append(np.log(part / part.sum(axis=1, keepdims=True)).astype(np.float32))
    letters = sums[:, len(GRAMS) * BUCKETS :]
    writes = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(names, tuple(tables), writes)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Score of each word in each language; a language that doesn't write its script is out,
    unless none does, when all are in."""
    possible = model.writes[:, words.script].T
    possible[~possible.any(axis=1)] = True
    scores = np.zeros((len(words), len(model.languages)))
    for table, (buckets, begin) in zip(model.tables, words.grams()):
        for k in range(len(model.languages)):
            if possible[:, k].any():
                sums = np.concatenate(([0.0], np.cumsum(table[k][buckets], dtype=np.float64)))
                scores[:, k] += sums[begin[1:]] - sums[begin[:-1]]
    return np.where(possible, scores / len(model.tables), -1e6)


def best_labels(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of all words; a change of label between neighbours of one text costs ``switch``.

    Texts are cut into chunks that run side by side for every state they could begin in; the
    chunks of a text are then chained, and each chunk is traced back from its true beginning.
    The result is that of the plain algorithm.
    """
    n, states = scores.shape
    count = np.diff(first)
    pieces = -(-count // CHUNK)
    chunk_first = np.concatenate(([0], np.cumsum(pieces)))
    total = int(chunk_first[-1])
    if total == 0:
        return np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(count)), pieces)
    begin = first[of] + (np.arange(total) - chunk_first[of]) * CHUNK
    size = np.minimum(CHUNK, first[of + 1] - begin)
    longest = int(size.max())
    steps = np.arange(longest)
    grid = np.minimum(begin[:, None] + steps, n - 1)
    padded = np.where((steps < size[:, None])[:, :, None], scores[grid], 0.0)
    reach = np.where(np.eye(states, dtype=bool), padded[:, 0, None, :], -np.inf)
    for t in range(1, longest):
        reach = np.maximum(reach, reach.max(axis=2, keepdims=True) - switch) + padded[:, t, None, :]
    # chain the chunks of each text
    entry = np.zeros((total, states), np.int64)  # best beginning state of a chunk by its ending state
    came = np.zeros((total, states), np.int64)  # ending state of the chunk before, by beginning state
    ending = np.zeros((total, states))
    order = np.argsort(-pieces, kind="stable")
    for k in range(int(pieces.max())):
        active = order[: int((pieces > k).sum())]
        at = chunk_first[active] + k
        if k:
            before = ending[at - 1]
            top = before.argmax(axis=1)
            jump = before[np.arange(len(at)), top] - switch
            stay = before >= jump[:, None]
            came[at] = np.where(stay, np.arange(states), top[:, None])
            enter = np.where(stay, before, jump[:, None])
        else:
            enter = np.zeros((len(at), states))
        paths = enter[:, :, None] + reach[at]
        entry[at] = paths.argmax(axis=1)
        ending[at] = paths.max(axis=1)
    last, start = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for k in range(int(pieces.max()) - 1, -1, -1):
        active = order[: int((pieces > k).sum())]
        at = chunk_first[active] + k
        final = pieces[active] == k + 1
        nxt = np.minimum(at + 1, total - 1)
        last[at] = np.where(final, ending[at].argmax(axis=1), came[nxt, start[nxt]])
        start[at] = entry[at, last[at]]
    # trace each chunk from its beginning state
    rows = np.arange(total)
    value = np.full((total, states), -np.inf)
    value[rows, start] = padded[rows, 0, start]
    back = np.zeros((longest, total, states), np.int16)
    for t in range(1, longest):
        top = value.argmax(axis=1)
        jump = value[rows, top][:, None] - switch
        stay = value >= jump
        back[t] = np.where(stay, np.arange(states), top[:, None])
        value = np.where(stay, value, jump) + padded[:, t]
    labels = np.zeros((total, longest), np.int64)
    state = last.copy()
    for t in range(longest - 1, -1, -1):
        labels[:, t] = state
        state = np.where(t < size, back[t][rows, state], state)
    out = np.zeros(n, np.int64)
    mask = steps < size[:, None]
    out[grid[mask]] = labels[mask]
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def _label(model: Model, texts: Texts, strings: pa.Array):
    """Language, score, and spans (text, code points, label) of each text."""
    words = Words(texts)
    n = len(texts)
    labels = best_labels(word_scores(model, words), words.first) if len(words) else np.zeros(0, np.int64)
    votes = np.zeros((n, len(model.languages)))
    np.add.at(votes, (words.text, labels), words.end - words.start)
    letters = votes.sum(axis=1)
    pick = votes.argmax(axis=1)
    known = letters > 0
    plain = np.zeros(n, bool)
    ascii_words = LETTER[:128][np.minimum(texts.data, 127)] & (texts.data < 128)
    counts = np.concatenate(([0], np.cumsum(ascii_words)))
    plain = counts[texts.offsets[1:]] > counts[texts.offsets[:-1]]
    for row in np.flatnonzero(known & ~plain):  # bytes above 127 may be no letters
        known[row] = any(c.isalpha() for c in strings[int(row)].as_py() or "")
    value = np.where(known, votes[np.arange(n), pick] / np.maximum(letters, 1), 0.0)
    fresh = np.ones(len(words), bool)
    fresh[1:] = (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])
    head = np.flatnonzero(fresh & known[words.text]) if len(words) else np.zeros(0, np.int64)
    heads = np.flatnonzero(fresh)
    tail = np.append(heads[1:], len(words))[np.searchsorted(heads, head)] - 1
    chars = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
    of = words.text[head]
    origin = chars[texts.offsets[of]]
    return known, pick, value, of, chars[words.start[head] - of] - origin, chars[words.end[tail] - of] - origin, labels[head]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred`` (``und`` for a null text or one without a letter), ``score`` (share of the
    letters that the prediction labels) and ``spans`` (code points and language).

    Only the text is read. Columns of these names are replaced, others pass through.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE])
    extra = "lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(extra).fields])
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            strings = batch.column("text")
            for low, high, texts in blocks(texts_of(strings)):
                part = batch.slice(low, high - low)
                if model.languages:
                    known, pick, value, of, start, end, label = _label(model, texts, strings.slice(low, high - low))
                else:
                    known, pick, value = np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts))
                    of = start = end = label = np.zeros(0, np.int64)
                where = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(
                    pa.array(where),
                    pa.StructArray.from_arrays(
                        [pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(names[label], pa.string())], fields=list(_SPAN)
                    ),
                )
                lang = pa.array(names[np.where(known, pick, len(names) - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lang, pa.array(value), spans], names=[*batch.schema.names, *MADE])

    return kept.mapInArrow(run, schema)
