"""Toxicity by subword-bag embeddings and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (hashed to a table), so an unseen misspelling or
inflection shares most of it with words that were seen. A passage's vector is the mean of its words' vectors, and a
linear softmax turns it into two classes; table and softmax are trained jointly in numpy on a bounded sample of
labelled texts. Only documents are labelled, and a toxic one is mostly harmless prose, so a document is judged by its
worst passage of ``WINDOW`` words (a run of one word counts once), in training as in scoring: each round takes, of every toxic text, the passage that
scores worst so far, and all passages of the others.

Since the softmax is linear, a word adds one number to its passage: that is all a task keeps of a word.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import carried, held_by_worker, labelled_sample, text_of, uncarried, utf8, word_cache

SAMPLE_ROWS = 500  # texts of each class to fit on, about
WINDOW = 8
BUCKETS = 1 << 18
SIZE = 4
SHORTEST, LONGEST = 3, 5
STEPS = 40
ROUNDS = 3
CACHE_WORDS = 200_000  # per Python worker
WORDS = re.compile(r"[^\s.,!?;:()\"|]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def ngrams(word: str) -> list[int]:
    """Buckets of the character n-grams of a word between its end marks."""
    text = f"<{word}>"
    if word.isascii():
        raw = text.encode()
        return [zlib.crc32(raw[i:i + n]) % BUCKETS
                for n in range(SHORTEST, LONGEST + 1) for i in range(len(raw) - n + 1)]
    return [zlib.crc32(utf8(text[i:i + n])) % BUCKETS
            for n in range(SHORTEST, LONGEST + 1) for i in range(len(text) - n + 1)]


def runs_once(values: np.ndarray) -> np.ndarray:
    """Without values equal to the one before: a word that is repeated on the spot says no more than once."""
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def passage_means(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean of each run of ``window`` values, or of all if there are fewer."""
    if not len(values):
        return np.zeros(1)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    if len(values) <= window:
        return sums[-1:] / len(values)
    return (sums[window:] - sums[:-window]) / window


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, x: np.ndarray, gradient: np.ndarray) -> None:
        if not self.t:
            # rare n-grams, whose gradients are far below the largest, move in proportion to them
            self.least = 0.02 * float(np.abs(gradient).max()) + 1e-12
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient ** 2 - self.v)
        x -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + self.least)


def train(texts: list[str], labels: list[int], seed: int = 0) -> tuple[np.ndarray, float, float]:
    """(number of each n-gram bucket, slope, offset): a text's probability is the logistic function of
    slope * (worst passage mean of its words' numbers) + offset."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():  # one class or none: nothing to tell apart
        return np.zeros(BUCKETS), 1.0, (8.0 if len(y) and y[0] else -8.0)
    bags = [words_of(t) for t in texts]
    place: dict[str, int] = {}
    coded = [runs_once(np.array([place.setdefault(w, len(place)) for w in bag], dtype=np.int64)) for bag in bags]
    grams = [ngrams(w) for w in place]
    sizes = np.array([len(g) for g in grams])
    flat = np.concatenate([np.array(g) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
    of_word = np.repeat(np.arange(len(grams)), sizes)
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, SIZE))  # n-grams that were never seen say nothing
    soft, bias = rng.normal(0, 1, (SIZE, 2)), np.zeros(2)
    movers = [_Adam(table.shape, 0.1), _Adam(soft.shape, 0.1), _Adam(bias.shape, 0.1)]

    def word_vectors() -> np.ndarray:
        out = np.empty((len(grams), SIZE))
        for k in range(SIZE):
            out[:, k] = np.bincount(of_word, weights=table[flat, k], minlength=len(grams))
        return out / sizes[:, None]

    numbers = None
    for _ in range(ROUNDS):
        # passages: of a toxic text the worst so far (all, in the first round), of the others all
        at, target, counted = [], [], []
        for words, label in zip(coded, y, strict=True):
            if not len(words):
                continue
            cuts = [words[a:a + WINDOW] for a in range(0, len(words), WINDOW)]
            if label and numbers is not None:
                a = int(passage_means(numbers[words]).argmax())
                cuts = [words[a:a + WINDOW]]
            at += cuts
            target += [label] * len(cuts)
        target = np.array(target)
        length = np.array([len(c) for c in at])
        words, passage = np.concatenate(at), np.repeat(np.arange(len(at)), length)
        share = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
        counted = 1.0 / length[passage]
        for _ in range(STEPS):
            vectors = word_vectors()
            means = np.stack([np.bincount(passage, weights=vectors[words, k] * counted, minlength=len(at))
                              for k in range(SIZE)], axis=1)
            logits = means @ soft + bias
            logits -= logits.max(axis=1, keepdims=True)
            probs = np.exp(logits)
            probs /= probs.sum(axis=1, keepdims=True)
            error = probs.copy()
            error[np.arange(len(at)), target] -= 1
            error *= share[:, None]
            to_means = error @ soft.T
            gradient = np.empty_like(table)
            for k in range(SIZE):
                to_words = np.bincount(words, weights=to_means[passage, k] * counted, minlength=len(grams)) / sizes
                gradient[:, k] = np.bincount(flat, weights=to_words[of_word], minlength=BUCKETS)
            movers[0].step(table, gradient)
            movers[1].step(soft, means.T @ error)
            movers[2].step(bias, error.sum(axis=0))
        numbers = word_vectors() @ (soft[:, 1] - soft[:, 0])
    per_bucket = table @ (soft[:, 1] - soft[:, 0])

    # slope and offset on whole texts: the cut that leaves the least weighted error, in the middle of its gap
    worst = np.array([passage_means(numbers[c]).max() if len(c) else 0.0 for c in coded])
    order = np.argsort(worst, kind="stable")
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())[order]
    wrong = np.concatenate([[w[y[order] == 0].sum()], w[y[order] == 0].sum() + np.cumsum(np.where(y[order] == 1, w, -w))])
    values = np.concatenate([[worst[order[0]] - 1], worst[order], [worst[order[-1]] + 1]])
    best = np.flatnonzero(np.isclose(wrong, wrong.min()))
    k = best[np.argmax(values[best + 1] - values[best])]
    cut = (values[k] + values[k + 1]) / 2
    spread = max(1e-6, float(np.std(worst)))
    return per_bucket, 6.0 / spread, float(-6.0 / spread * cut)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", *, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5,
                   carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1, higher: likelier toxic), ``predicted`` (1 from ``threshold``)
    and the columns ``carry`` (other names than these) as they were.

    ``labels`` has id and label (1: toxic, 0: not, others: not learned from) of rows of ``docs``; the texts of about
    ``sample_rows`` rows of each label are fitted on. Null and empty texts score as a passage whose words say nothing. With labels of one kind
    only, every text gets that kind. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels.where(F.col(label_col).isin(0, 1)), id_col, text_col, label_col, sample_rows)
    per_bucket, slope, offset = train([t for _, t in sample], [y for y, _ in sample])
    name = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(per_bucket)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known_words() -> dict:
            numbers = sent.value.tolist()

            def number(word: str) -> float:
                own = ngrams(word)
                return sum(numbers[g] for g in own) / len(own)

            return word_cache(number, CACHE_WORDS)

        known = held_by_worker(name, known_words)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                values = runs_once(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
                out.append(slope * float(passage_means(values).max()) + offset)
            probs = 1 / (1 + np.exp(-np.clip(np.array(out), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(probs, pa.float64()), pa.array((probs >= threshold).astype(np.int32)),
                 batch.column("carried")], ["id", "score", "predicted", "carried"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), carried(carry))
    kind, rest = (rows.schema[c].dataType.simpleString() for c in ("id", "carried"))
    return rows.mapInArrow(score, f"id {kind}, score double, predicted int, carried {rest}").select(
        F.col("id").alias(id_col), "score", "predicted", *uncarried(carry, [id_col]))
