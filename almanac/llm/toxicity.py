"""Toxicity by multiple-instance learning: labels are on documents, scores are on sentences.

A sentence has a logistic score over its words; a document is toxic unless every sentence is
clean (noisy-or). The weights are fitted to document labels alone, on a bounded sample of
labelled rows, and then name the offending sentences. Scoring is one pass over whole texts in
Arrow batches, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialize
from .textbytes import SpanHash, Texts, blocks, texts_of

STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("'"), *range(128, 256)]] = True

#: Labelled rows, and bytes of their texts, that the fit may use at most.
MAX_ROWS, MAX_BYTES = 6000, 48 << 20
#: Share of those bytes above which a text is taken only if there is room after all others.
SHARE = 1 / 64
MIN_DOCS = 3
#: Bytes of word beginnings that are features beside the whole word.
PREFIXES = (3, 4, 5, 6, 7, 8)
WHOLE = np.uint64(0x5BD1E9955BD1E995)
BITS = 20
#: How far the share of toxic documents with a feature must stand out (in standard errors) to enter the fit.
LEAST_Z = 3.0
#: L1 penalties to choose from.
PENALTIES = (1e-4, 2e-4, 4e-4, 8e-4, 1.6e-3)
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
MADE = ("score", "predicted", "n_sentences", "offending")


@dataclass(frozen=True)
class Model:
    """Feature hashes in order with their weights, and the bias of every sentence.

    A fit that has not seen both labels tells no sentences apart: it has a ``rate``, the score of
    every document whatever its sentences.
    """

    features: np.ndarray
    weights: np.ndarray
    bias: float
    rate: float | None = None

    def table(self) -> np.ndarray:
        """Which leading bits any feature has; most tokens are dismissed by it."""
        out = np.zeros(1 << BITS, bool)
        out[self.features >> np.uint64(64 - BITS)] = True
        return out

    def odds(self, texts: "Sentences", table: np.ndarray) -> np.ndarray:
        """Log-odds of each sentence."""
        odds = np.full(texts.count, self.bias)
        if len(self.features):
            for tokens, sentence in texts.features():
                hit = np.flatnonzero(table[tokens >> np.uint64(64 - BITS)])
                tokens, sentence = tokens[hit], sentence[hit]
                at = np.minimum(np.searchsorted(self.features, tokens), len(self.features) - 1)
                known = self.features[at] == tokens
                odds += np.bincount(sentence[known], self.weights[at[known]], minlength=len(odds))
        return odds


class Sentences:
    """Sentence spans of texts, the first of each text, and what the words of each are made of."""

    def __init__(self, texts: Texts):
        self.starts, self.ends, self.first = texts.runs(~STOP)
        self.count = len(self.starts)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        low = texts.lowered()
        self._spans = SpanHash(low.data)
        self._begin, self._end, _ = low.runs(LETTER)
        self._sentence = np.searchsorted(self.starts, self._begin, side="right") - 1

    def features(self):
        """Hash and sentence of every whole word, then of every word beginning of some bytes."""
        yield self._spans(self._begin, self._end) ^ WHOLE, self._sentence
        for size in PREFIXES:
            longer = np.flatnonzero(self._end - self._begin > size)
            begin = self._begin[longer]
            yield self._spans(begin, begin + size), self._sentence[longer]


def _softplus(z):
    return np.logaddexp(0.0, z)


class Bags:
    """The features of some documents that tell labels apart, by sentence.

    Features are screened twice: by leading bits over all tokens, block by block, then exactly
    among what is left, so memory follows the screened tokens.
    """

    def __init__(self, texts: Texts, labels: np.ndarray):
        seen = np.zeros((2, 1 << BITS))
        for low, _, block in blocks(texts):
            bags = Sentences(block)
            for tokens, sentence in bags.features():
                once = np.unique(((tokens >> np.uint64(64 - BITS)).astype(np.int64) * len(block)) + bags.text[sentence])
                label = labels[low + once % len(block)] > 0
                for k in (0, 1):
                    seen[k] += np.bincount(once[label == bool(k)] // len(block), minlength=1 << BITS)
        table = self._tells(seen, labels)
        parts, text, count = [], [np.zeros(0, np.int32)], 0
        for low, _, block in blocks(texts):
            bags = Sentences(block)
            tokens, sentence = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for token, at in bags.features():
                hit = table[token >> np.uint64(64 - BITS)]
                tokens.append(token[hit])
                sentence.append((at[hit] + count).astype(np.int32))
            parts.append((np.concatenate(tokens), np.concatenate(sentence)))
            text.append((bags.text + low).astype(np.int32))
            count += bags.count
        self.text = np.concatenate(text)
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(tokens) for tokens, _ in parts)]))
        seen = np.zeros((2, len(vocabulary)))
        for i, (tokens, sentence) in enumerate(parts):
            feature = np.searchsorted(vocabulary, tokens).astype(np.int32)
            parts[i] = feature, sentence
            once = np.unique(feature.astype(np.int64) * len(texts) + self.text[sentence])
            toxic = labels[once % len(texts)] > 0
            for k in (0, 1):
                seen[k] += np.bincount(once[toxic == bool(k)] // len(texts), minlength=len(vocabulary))
        keep = self._tells(seen, labels)
        place = (np.cumsum(keep) - 1).astype(np.int32)
        none = np.zeros(0, np.int32)
        self.feature = np.concatenate([none, *(place[feature[keep[feature]]] for feature, _ in parts)])
        self.sentence = np.concatenate([none, *(sentence[keep[feature]] for feature, sentence in parts)])
        self.vocabulary = vocabulary[keep]

    @staticmethod
    def _tells(seen: np.ndarray, labels: np.ndarray) -> np.ndarray:
        n1 = max(int((labels > 0).sum()), 1)
        n0 = max(len(labels) - n1, 1)
        share = seen.sum(0) / (n0 + n1)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
        return (seen.sum(0) >= MIN_DOCS) & (np.abs(seen[1] / n1 - seen[0] / n0) >= LEAST_Z * error)


def _fit(bags: Bags, labels: np.ndarray, chosen: np.ndarray, l1: float, rounds: int = 150, rate: float = 0.2) -> Model:
    """Noisy-or likelihood of the ``chosen`` documents with an L1 penalty, by Adam.

    A weight at zero moves only if its gradient beats the penalty, and one that would change
    its sign stops at zero, so most features end with no weight at all.
    """
    docs = int(chosen.sum())
    place = np.cumsum(chosen) - 1
    inside = chosen[bags.text]
    doc_of, n = place[bags.text[inside]], int(inside.sum())
    used = inside[bags.sentence]
    feature, sentence = bags.feature[used], (np.cumsum(inside) - 1)[bags.sentence[used]]
    positive = labels[chosen] > 0
    share = (positive.sum() + 1) / (docs + 2)
    bias = float(np.log(np.expm1(-np.log1p(-share) / max(n / max(docs, 1), 1.0))))
    weights = np.zeros(len(bags.vocabulary))
    if n == 0 or positive.all() or not positive.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias, None if n == 0 and positive.any() and not positive.all() else float(share))
    moment, square = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, rounds + 1):
        odds = bias + np.bincount(sentence, weights[feature], minlength=n)
        clean = -_softplus(odds)  # log(1 - p)
        total = np.minimum(np.bincount(doc_of, clean, minlength=docs), -1e-9)
        # d loss / d odds: p in a clean document, -p * Q / (1 - Q) in a toxic one
        pull = np.where(positive, np.exp(total) / np.expm1(total), 1.0)
        grad_odds = np.exp(odds + clean) * pull[doc_of] / docs
        grad = np.bincount(feature, grad_odds[sentence], minlength=len(weights))
        still = weights == 0
        grad = np.where(still, np.sign(grad) * np.maximum(np.abs(grad) - l1, 0.0), grad + l1 * np.sign(weights))
        grad = np.append(grad, grad_odds.sum())
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        move = rate * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        after = weights - move[:-1]
        weights = np.where(after * weights < 0, 0.0, after)
        bias = bias - move[-1]
    told = weights != 0
    return Model(bags.vocabulary[told], weights[told], float(bias))


def fit_rows(texts: Texts, labels: np.ndarray, penalties=PENALTIES) -> Model:
    """The model with the penalty that predicts every fourth row best when fitted to the others.

    Without rows of both labels it knows no features and gives every document the label rate,
    which is a half without any row.
    """
    bags = Bags(texts, labels)
    everything, check = np.ones(len(texts), bool), np.arange(len(texts)) % 4 == 3
    if labels[check].min(initial=1) == labels[check].max(initial=0):
        return _fit(bags, labels, everything, penalties[len(penalties) // 2])
    part = texts.take(np.flatnonzero(check))
    losses = []
    for penalty in penalties:
        model = _fit(bags, labels, ~check, penalty)
        table = model.table()
        clean = np.concatenate([np.ones(0), *(1 - _score(model, block, 2.0, table)[0] for _, _, block in blocks(part))])
        clean = np.clip(clean, 1e-6, 1 - 1e-6)
        losses.append(-np.mean(np.where(labels[check] > 0, np.log1p(-clean), np.log(clean))))
    return _fit(bags, labels, everything, penalties[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Model from the documents of ``labels`` (``doc_id``, ``toxic``); rows held out must be left out before.

    Uses at most ``max_rows`` labelled documents, chosen by a hash of the id, whose texts together
    have at most ``max_bytes``. Texts above ``SHARE`` of those bytes come after all others, the
    shorter ones first, so that none of them ends the sample while others fit. A document with
    several labels counts as toxic if any says so; of rows that repeat an id, the least text is
    taken. Null ids and labels are ignored.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("place", F.xxhash64(F.col("doc_id").cast("string")))
        .orderBy("place", "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    # from here on there are at most max_rows rows
    rows = materialize(rows.withColumn("size", F.octet_length("text")), "labelled")
    long = F.when(F.col("size") > max_bytes * SHARE, F.col("size")).otherwise(0)
    running = Window.orderBy("long", "place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = rows.select("doc_id", "place", "size", long.alias("long")).withColumn("total", F.sum("size").over(running))
    fitting = fitting.where(F.col("total") <= max_bytes).select("doc_id", "long", "place")
    ordered = rows.drop("place").join(F.broadcast(fitting), "doc_id").orderBy("long", "place", "doc_id")
    rows = ordered.select("text", F.col("toxic").cast("int").alias("toxic")).toArrow()
    return fit_rows(texts_of(rows["text"]), rows["toxic"].to_numpy().astype(float))


def _score(model: Model, texts: Texts, threshold: float, table: np.ndarray | None = None):
    found = Sentences(texts)
    if model.rate is not None:
        none = np.zeros(0, np.int64)
        return np.full(len(texts), model.rate), np.diff(found.first), none, none, none, np.zeros(0)
    odds = model.odds(found, model.table() if table is None else table)
    counts = np.diff(found.first)
    # without a sentence there is still one instance: the empty one
    total = np.bincount(found.text, -_softplus(odds), minlength=len(texts)) + np.where(counts == 0, -_softplus(model.bias), 0.0)
    score = np.clip(-np.expm1(total), 0.0, 1.0)
    p = np.exp(odds - _softplus(odds))
    bad = np.flatnonzero((p >= SENTENCE_THRESHOLD) & (score[found.text] >= threshold))
    chars = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
    of = found.text[bad]
    origin = chars[texts.offsets[of]]
    return score, counts, of, chars[found.starts[bad]] - origin, chars[found.ends[bad]] - origin, p[bad]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score``, ``predicted`` (1 at ``threshold`` or above), ``n_sentences`` and ``offending``:
    the sentences of predicted documents whose own score is 0.5 or more, as code points.

    Null and empty texts get the score of one sentence without known words. Columns of these
    names are replaced, others pass through.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE])
    extra = "score double, predicted int, n_sentences long, offending array<struct<start: long, end: long, score: double>>"
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(extra).fields])

    def run(batches):
        table = model.table()
        for batch in batches:
            for low, high, texts in blocks(texts_of(batch.column("text"))):
                value, counts, of, start, end, p = _score(model, texts, threshold, table)
                where = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(
                    pa.array(where), pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(p)], fields=list(_SPAN))
                )
                made = [pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(counts.astype(np.int64)), spans]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*batch.schema.names, *MADE])

    return kept.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
