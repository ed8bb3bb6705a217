"""Language identification by unigram piece models that sum over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a word is the sum,
over all its segmentations into pieces, of the products of their probabilities; a forward pass computes it. A text
scores the product over its words (runs of letters, lower case, with the vocabulary's word mark), and the languages'
scores give a posterior. Piece probabilities are fitted by expectation-maximisation with forward and backward passes
over the words of a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import held_by_worker, labelled_sample, public_file, text_of
from tillroll.llm.token_counts import MARK, piece_trie, unigram_scores

SAMPLE_ROWS = 400  # texts of each language to fit on, about
ROUNDS = 2
SMOOTHING = 0.1  # expected uses of a piece besides those in the sample
CHAR_SCALE = 16.0  # each character counts this factor, which keeps forward sums of words in range
UNKNOWN = 1e-7  # probability of a character that has no piece
WORDLIKE = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 300_000  # per Python worker
SAFE_CHARS = 48  # longer words are rescaled on the way
LONGEST = 64  # no piece of the vocabulary is longer


def _rescaled(sums: list[list[float]], lost: list[float], window: range, onward: range) -> None:
    """Divides the sums of a window, which alone are read on, by their greatest; ``lost`` keeps the logarithm of what
    each place was or will be divided by."""
    most = max(max(sums[i]) for i in window)
    if most > 0:
        for i in window:
            sums[i][:] = [x / most for x in sums[i]]
        for i in onward:
            lost[i] += math.log(most)


def _forward(trie: dict, word: str, languages: int) -> tuple[list[list[float]], list[float]]:
    """Forward sums of every place of a word, and the logarithm of what each was divided by on the way."""
    n, each = len(word), range(languages)
    sums = [[0.0] * languages for _ in range(n + 1)]
    sums[0] = [1.0] * languages
    lost = [0.0] * (n + 1)
    for i in range(n):
        here = sums[i]
        if i and i % SAFE_CHARS == 0:
            _rescaled(sums, lost, range(i, min(i + LONGEST, n + 1)), range(i, n + 1))
        node, j = trie, i
        while j < n:
            node = node.get(word[j])
            if node is None:
                break
            j += 1
            p = node.get("")
            if p is not None:
                there = sums[j]
                for k in each:
                    there[k] += here[k] * p[k]
        if word[i] not in trie or "" not in trie[word[i]]:
            there = sums[i + 1]
            for k in each:
                there[k] += here[k] * UNKNOWN * CHAR_SCALE
    return sums, lost


def word_scores(trie: dict, word: str, languages: int) -> tuple[float, ...]:
    """Log probability of a word in each language."""
    marked = MARK + word
    sums, divided = _forward(trie, marked, languages)
    lost = divided[-1] - len(marked) * math.log(CHAR_SCALE)
    return tuple(math.log(max(x, 1e-300)) + lost for x in sums[-1])


def _scaled_trie(model: dict[str, list[float]]) -> dict:
    return piece_trie({p: [x * CHAR_SCALE ** len(p) for x in probs] for p, probs in model.items()})


def fit(words: list[Counter], pieces: dict[str, int], rounds: int = ROUNDS) -> dict[str, list[float]]:
    """Piece probabilities of each language from its word counts, starting from the vocabulary's own order."""
    languages = len(words)
    start = {p: math.exp(s / (1 << 20)) for p, s in pieces.items()}
    total = sum(start.values())
    model = {p: [x / total] * languages for p, x in start.items()}
    everything = sorted(set().union(*words))
    for _ in range(rounds):
        trie = _scaled_trie(model)
        uses = {p: [SMOOTHING * len(start) * x / total] * languages for p, x in start.items()}
        for word in everything:
            marked = MARK + word
            n = len(marked)
            counts = [w[word] for w in words]
            sums, ahead = _forward(trie, marked, languages)
            back = [[0.0] * languages for _ in range(n + 1)]
            back[n] = [1.0] * languages
            behind = [0.0] * (n + 1)
            used = []
            for i in range(n - 1, -1, -1):
                if n - 1 - i and (n - 1 - i) % SAFE_CHARS == 0:
                    end = min(i + 1 + LONGEST, n + 1)
                    _rescaled(back, behind, range(i + 1, end), range(end))
                node, j, here = trie, i, back[i]
                while j < n:
                    node = node.get(marked[j])
                    if node is None:
                        break
                    j += 1
                    p = node.get("")
                    if p is not None:
                        there = back[j]
                        used.append((i, j, p))
                        for k in range(languages):
                            here[k] += there[k] * p[k]
                if marked[i] not in trie or "" not in trie[marked[i]]:
                    for k in range(languages):
                        here[k] += back[i + 1][k] * UNKNOWN * CHAR_SCALE
            weight = [c / s if c and s > 0 else 0.0 for c, s in zip(counts, sums[n], strict=True)]
            for i, j, p in used:
                use, a, b = uses[marked[i:j]], sums[i], back[j]
                # both sums in the range of the whole word's
                again = math.exp(ahead[i] + behind[j] - ahead[n]) if n > SAFE_CHARS else 1.0
                for k in range(languages):
                    if weight[k]:
                        use[k] += weight[k] * a[k] * p[k] * b[k] * again
        totals = [sum(u[k] for u in uses.values()) for k in range(languages)]
        model = {p: [u[k] / totals[k] for k in range(languages)] for p, u in uses.items()}
    return model


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode categories L*), lower case."""
    out = []
    for run in WORDLIKE.findall(text.lower()):
        if run.isalpha():
            out.append(run)
        else:  # numbers that are no decimal digits, as in a fraction or a superscript
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


class WordTable:
    """Scores of the words met so far, by row of a growing matrix; a full table starts afresh."""

    def __init__(self, model: dict[str, list[float]], languages: int):
        self.trie, self.languages = _scaled_trie(model), languages
        self.place: dict[str, int] = {}
        self.known = np.zeros((1024, max(1, languages)))

    def total(self, words: list[str]) -> np.ndarray:
        """Log probability of all the words, in each language."""
        place = self.place
        if len(place) > CACHE_WORDS:
            place.clear()
        try:
            at = list(map(place.__getitem__, words))
        except KeyError:
            for w in set(words).difference(place):
                k = place[w] = len(place)
                if k >= len(self.known):
                    self.known = np.concatenate([self.known, np.zeros_like(self.known)])
                self.known[k] = word_scores(self.trie, w, self.languages)
            at = list(map(place.__getitem__, words))
        return self.known[at].sum(axis=0)


def identify_languages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       label_col: str = "lang", *, sample_rows: int = SAMPLE_ROWS,
                       vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (posterior of the prediction, 0 to 1).

    ``labels`` has id and label of rows of ``docs``; null labels are not learned from, and of each other label the
    texts of about ``sample_rows`` rows are (the bound of the fit). Null texts and texts without a letter are ``und`` with score 0; so is every
    text if nothing could be learned. Of equal scores the language first in order wins. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    by_label: dict[str, Counter] = {}
    for label, text in labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows):
        by_label.setdefault(str(label), Counter()).update(words_of(text))
    languages = sorted(by_label)
    model = fit([by_label[x] for x in languages], unigram_scores(public_file(vocabulary))) if languages else {}
    names, matrix = list(model), np.array(list(model.values()), dtype=np.float64)
    name = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((names, matrix))  # pieces of the vocabulary times languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty_table() -> WordTable:
            pieces, probs = sent.value
            return WordTable(dict(zip(pieces, probs.tolist(), strict=True)), len(languages))

        table = held_by_worker(name, empty_table)
        for batch in batches:
            guess, sure = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not words or not languages:
                    guess.append("und")
                    sure.append(0.0)
                    continue
                total = table.total(words)
                best = int(total.argmax())
                guess.append(languages[best])
                sure.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(guess, pa.string()),
                                              pa.array(sure, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
