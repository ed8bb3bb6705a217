"""Token counts under a fixed unigram vocabulary by dynamic programming over a trie of pre-tokens.

A pre-token is a white-space-separated word with the vocabulary's word mark in front. Its tokens are those of the
segmentation with the best unigram score; the score of a piece follows its place in the public vocabulary by Zipf's
law, -ln(place + 1), as a whole number of 2^-20 units, so ties are exact. Of segmentations with one score the one with
the fewest pieces counts. A character without a piece of its own counts as one token for each UTF-8 byte.

The state of a trie node (best score and token count so far, and the pieces under way) depends on the path to it only,
so words that share a prefix share its work, and a word's count is that of its last node, its terminal. A task splits a
stretch of texts into a dictionary of distinct pre-tokens and their places. Terminals of earlier stretches are held; the
other pre-tokens are inserted in sorted order, which visits the trie of them depth first, so that only the nodes on the
path to the last one are held, whatever the vocabulary. Then each text's counts are summed by place. There is no shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import held_by_worker, public_file, text_of, utf8

MARK = "▁"
UNIT = 1 << 20
BYTE_COST = round(math.log(1 << 20) * UNIT)
TERMINALS = 400_000  # words whose counts a Python worker holds
LONG_WORD = 64  # counts of longer words are not held
STRETCH_CHARS = 16_000_000  # of texts that are split at once


def unigram_scores(model: bytes) -> dict[str, int]:
    """Score of each ordinary piece of a SentencePiece vocabulary; runs of the word mark are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ordinary = [i for i in range(sp.get_piece_size())
                if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [p for p in (sp.id_to_piece(i) for i in ordinary) if p.strip(MARK) or p == MARK]
    return {p: -round(math.log(k + 2) * UNIT) for k, p in enumerate(pieces)}


def piece_trie(values: dict[str, object]) -> dict:
    """Nested dicts by character; the value of a piece is under the empty key."""
    root: dict = {}
    for piece, value in values.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = value
    return root


class TokenTrie:
    """Best unigram segmentations of words; a node is (score, tokens, pieces under way)."""

    def __init__(self, model: bytes):
        self.vocabulary = piece_trie(unigram_scores(model))
        self.root = self._step((0, 0, []), MARK)
        self.held: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _step(self, node: tuple, c: str) -> tuple:
        """The state after one more character."""
        score, tokens, under_way = node
        best, fewest, ahead = None, 0, []
        for at, s, n in [*under_way, (self.vocabulary, score, tokens)]:
            on = at.get(c)
            if on is not None:
                ahead.append((on, s, n))
                value = on.get("")
                if value is not None and (best is None or s + value > best or (s + value == best and n + 1 < fewest)):
                    best, fewest = s + value, n + 1
        if "" not in self.vocabulary.get(c, ()):
            size = len(utf8(c))
            if best is None or score - size * BYTE_COST > best:
                best, fewest = score - size * BYTE_COST, tokens + size
        return best, fewest, ahead

    def terminals(self, words: list[str]) -> Iterator[int]:
        """Tokens of each of the words, which are in sorted order."""
        path, before = [self.root], ""
        for word in words:
            shared, end = 0, min(len(before), len(word))
            while shared < end and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1:]
            for c in word[shared:]:
                path.append(self._step(path[-1], c))
            before = word
            yield path[-1][1]

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each of the words, in any order. Two generations of counts are held, of TERMINALS words at most: a
        count that is used again moves to the new one."""
        held, older = self.held, self.older
        found = [held.get(w) for w in words]
        missing = [i for i, n in enumerate(found) if n is None]
        new = []
        for i in missing:
            found[i] = older.get(words[i])
            if found[i] is None:
                new.append(i)
        new.sort(key=words.__getitem__)
        for i, n in zip(new, self.terminals([words[i] for i in new]), strict=True):
            found[i] = n
        for i in missing:
            if len(words[i]) <= LONG_WORD:
                if 2 * len(held) >= TERMINALS:
                    self.older, self.held = held, {}
                    held = self.held
                held[words[i]] = found[i]
        return found

    def count(self, word: str) -> int:
        return self.counts([word])[0]

    def total(self, words: list[str]) -> int:
        """Tokens of all the words."""
        distinct = Counter(words)
        return sum(n * k for n, k in zip(self.counts(list(distinct)), distinct.values(), strict=True))


def stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in slices of about STRETCH_CHARS bytes, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STRETCH_CHARS, side="right")))
        yield texts.slice(a, b - a)
        a = b


def split_words(texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the place among them of every word of every text, where each text's words start)."""
    lists = split(texts)
    words = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return words.dictionary.to_pylist(), words.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run of values between two bounds; runs may be empty."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_tokens`` (long).

    Null and empty texts, and texts of white space only, have no words and no tokens. Rows with the same id, or none,
    each give a row. An empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(public_file(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held_by_worker(("trie", zlib.crc32(sent.value)), lambda: TokenTrie(sent.value))
        for batch in batches:
            done: list[tuple[np.ndarray, np.ndarray]] = []
            for texts in stretches(batch.column("text")):
                # white space at a text's ends leaves an empty word there
                words, places, bounds = split_words(texts, pc.utf8_split_whitespace)
                counts = np.array(trie.counts([w for w in words if w]), dtype=np.int64)
                real = np.array([bool(w) for w in words], dtype=bool)
                tokens = np.zeros(len(words), dtype=np.int64)
                tokens[real] = counts
                done.append((sums(real[places], bounds), sums(tokens[places], bounds)))
            empty = np.zeros(0, dtype=np.int64)
            n_words, n_tokens = (np.concatenate([empty, *column]).astype(np.int64) for column in zip(*done)) if done else (empty, empty)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words), pa.array(n_tokens)],
                                             ["id", "n_words", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
