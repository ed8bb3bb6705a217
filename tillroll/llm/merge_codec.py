"""SentencePiece encoding with seeded merge dropout, and decoding.

The encoder runs the merges of a public byte-fallback BPE vocabulary with an agenda, the best merge first and of equals
the leftmost. Each candidate merge that comes up is skipped with the dropout rate; how many come up before the next one
that is skipped is drawn by a hash keyed by seed, document, text, and the place in it. Without dropout the ids are those
of the SentencePiece library; with it, each seed gives other segmentations, and so does each occurrence of a word, always
the same ones for one seed, whatever the partitioning. All of them decode to the text.

Merges stay inside *units*: a run of blanks with the word after it, a line end with the word after it, and the marks at
a word's end where no piece joins them to it. A unit's ids depend on the unit and on which of its candidates are
skipped only. Each worker keeps the ids without a skip in a bounded cache; units that are not there, and every occurrence
with a skip, are merged in numpy, thousands at a time, each step taking the next candidate of each of them. Units over
LONGEST characters are merged one by one with a heap, by the same rules.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import heapq
import itertools
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import held_by_worker, public_file, text_of, utf8

MARK = "▁"
CACHE_UNITS = 300_000  # per Python worker; the cache is emptied when it holds more, or more than
CACHE_SYMBOLS = 4_000_000  # characters
ROWS_AT_ONCE = 500  # whose texts and ids a worker holds
CHARS_AT_ONCE = 1 << 20  # of texts whose units a worker holds, or one text
UNITS_AT_ONCE = 8192  # merged in step
LONGEST = 48  # symbols of a unit that is merged in step
NEVER = 1 << 60  # more candidates than a text has
MASK = (1 << 64) - 1
LITERAL = 0x110000  # past the code points: a literal mark
SYMBOL_BITS = 21
RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*")
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
MARKS = ".,!?;:"
ENDING = re.compile(f"(.*{LETTER})([.,!?;:]+)", re.DOTALL)


class _Slots(dict):
    """Number of each unit, in order of first appearance; ``new`` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = slot = len(self)
        return slot


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of the lists of those lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class _Lists:
    """Lists of numbers, end to end."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray | None = None):
        self.values, self.lengths = values, np.zeros(0, np.int64) if lengths is None else lengths
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])

    @staticmethod
    def of_bytes(ids: bytes) -> _Lists:
        return _Lists(np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))

    @staticmethod
    def end_to_end(parts: list[_Lists], kind: type) -> _Lists:
        return _Lists(np.concatenate([p.values for p in parts]).astype(kind, copy=False) if parts else np.zeros(0, kind),
                      np.concatenate([p.lengths for p in parts]) if parts else np.zeros(0, np.int64))

    def part(self, starts: np.ndarray, lengths: np.ndarray) -> _Lists:
        return _Lists(self.values[np.repeat(starts, lengths) + _within(lengths)], lengths)

    def take(self, at: np.ndarray) -> _Lists:
        return self.part(self.bounds[at], self.lengths[at])

    def split(self, first: np.ndarray) -> tuple[_Lists, _Lists]:
        """The first so many numbers of each list, and the others."""
        return self.part(self.bounds[:-1], first), self.part(self.bounds[:-1] + first, self.lengths - first)

    def beside(self, others: _Lists) -> _Lists:
        """Each list with that of the others after it."""
        n = len(self.lengths)
        both = _Lists.end_to_end([self, others], self.values.dtype).take(np.arange(2 * n).reshape(2, n).T.ravel())
        return _Lists(both.values, self.lengths + others.lengths)


@dataclasses.dataclass
class _Draws:
    """Of each unit: candidates left before the next one that is skipped; its text's key and place; skips so far."""
    left: np.ndarray
    keys: np.ndarray
    places: np.ndarray
    skips: np.ndarray

    @staticmethod
    def never(n: int) -> _Draws:
        none = np.zeros(n, np.int64)
        return _Draws(np.full(n, NEVER), none.astype(np.uint64), none, none)

    def take(self, at: np.ndarray) -> _Draws:
        return _Draws(self.left[at], self.keys[at], self.places[at], self.skips[at])


class MergeCodec:
    """Encoder and decoder for one vocabulary, seed and dropout rate (0 to 1)."""

    def __init__(self, model: bytes, seed: int = 0, dropout: float = 0.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_of: list[bytes] = []  # of each id, with the mark as a blank
        self.byte_id: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        # merges may join a word's end and the marks after it only if some piece has both
        self.ends_apart = not any(re.search(f"{LETTER}[.,!?;:]", p) for p in self.ids)
        self.seed, self.rate = seed & MASK, dropout
        self.log_kept = math.log1p(-dropout) if dropout < 1 else -math.inf
        self._forget()

    def _forget(self) -> None:
        """An empty cache."""
        self.slots = _Slots()
        self.symbols, self.pieces = _Lists(np.zeros(0, np.int32)), _Lists(np.zeros(0, np.uint32))
        self.words = self.counts = np.zeros(0, np.int64)  # of each unit: symbols before its marks; candidates

    @functools.cached_property
    def _numbers(self) -> np.ndarray:
        """Symbol of each character: the id of its piece, or the number of ids plus the code point."""
        n = len(self.bytes_of)
        numbers = np.arange(n, n + LITERAL + 1, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                numbers[ord(piece)] = i
        # a literal mark in the text is no blank: it has no piece and goes byte by byte
        numbers[ord(" ")], numbers[ord(MARK)] = numbers[ord(MARK)], n + LITERAL
        return numbers

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of symbols that have a piece, in order, with its id and its rank."""
        n, found = len(self.bytes_of), {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if (a in self.ids or k == 1) and (b in self.ids or len(b) == 1):
                    left, right = self.ids.get(a, n + ord(a[0])), self.ids.get(b, n + ord(b[0]))
                    found[left << SYMBOL_BITS | right] = (i, self.rank[piece])
        keys = np.array(sorted(found) or [NEVER], np.int64)
        made = [found.get(k, (0, math.inf)) for k in keys.tolist()]
        return keys, np.array([i for i, _ in made], np.int32), np.array([r for _, r in made])

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece of each pair of symbols, and its rank, infinite where there is none."""
        keys, made, rank = self._pairs
        pair = left.astype(np.int64) << SYMBOL_BITS | right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return made[at], np.where(keys[at] == pair, rank[at], np.inf)

    def _gaps(self, x: np.ndarray) -> np.ndarray:
        """Candidates that come up before one that is skipped, from 64 random bits each."""
        gaps = np.log(((x >> np.uint64(11)) + 0.5) / (1 << 53)) / self.log_kept
        return np.minimum(np.floor(gaps), NEVER).astype(np.int64)

    def _first_gaps(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Candidates of the units at those places of texts that come up before the first one that is skipped."""
        x = keys + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return self._gaps(x ^ (x >> np.uint64(31)))

    def _next_gaps(self, keys: np.ndarray, places: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Candidates of those units between the last of so many that are skipped and the next."""
        state = keys ^ (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        state = state + skips.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
        x = (state ^ state >> np.uint64(30)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0xBF58476D1CE4E5B9)
        return self._gaps(x ^ (x >> np.uint64(31)))

    def _later_gaps(self, key: int, place: int) -> Iterator[int]:
        """Those of one unit, in turn."""
        own = np.array([key], np.uint64), np.array([place])
        for k in itertools.count(1, 64):
            yield from self._next_gaps(*own, np.arange(k, k + 64)).tolist()

    def _merge(self, symbols: list[str], left: int, gaps: Iterator[int], since: int) -> tuple[list[str], int, int]:
        """The symbols after all merges, where '' marks one that was joined to the symbol before it; how many candidates
        came up since the last one that was skipped; and how many more may come up before the next one. ``left`` are
        those before the first, ``gaps`` those between it and later ones, ``since`` the count so far."""
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            r = rank(piece)
            if r is not None:
                agenda.append((r, i, i + 1, piece))
        if not agenda:
            return symbols, since, left
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, piece = pop(agenda)
            if after[i] != j or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue  # one of the two has changed: symbols only grow, and only to the right
            if not left:
                left, since = next(gaps), 0
                continue
            left -= 1
            since += 1
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                joined = piece + symbols[k]
                r = rank(joined)
                if r is not None:
                    push(agenda, (r, i, k, joined))
            h = before[i]
            if h >= 0:
                joined = symbols[h] + piece
                r = rank(joined)
                if r is not None:
                    push(agenda, (r, h, i, joined))
        return symbols, since, left

    def _parts(self, unit: str) -> tuple[str, str]:
        """The unit, a line end and what follows or what follows a blank, without the marks that are merged apart; and
        these."""
        if unit[-1:] in MARKS and self.ends_apart and (m := ENDING.fullmatch(unit)):
            return m[1], m[2]
        return unit, ""

    def _ids(self, raw: str, left: int, gaps: Iterator[int], since: int = 0) -> tuple[bytes, int, int]:
        """Ids, and the counts of ``_merge``."""
        # a literal mark in the text is no blank: it has no symbol and goes byte by byte
        symbols = list(raw.replace(" ", MARK)) if MARK not in raw else [
            MARK if c == " " else "\0" + c if c == MARK else c for c in raw]
        out = []
        symbols, since, left = self._merge(symbols, left, gaps, since)
        for s in symbols:
            if not s:
                continue
            own = self.ids.get(s)
            if own is not None:
                out.append(own)
            else:
                out += [self.byte_id[b] for b in utf8(s[1:] if s[0] == "\0" and len(s) > 1 else s)]
        return struct.pack(f"<{len(out)}I", *out), since, left

    def _run(self, unit: str, gaps: Iterator[int]) -> tuple[bytes, int]:
        """Ids of a unit, and how many of its candidates came up since the last one that was skipped."""
        word, marks = self._parts(unit)
        ids, since, left = self._ids(word if word[:1] == "\n" else " " + word, next(gaps), gaps)
        if marks:
            more, since, _ = self._ids(marks, left, gaps, since)
            ids += more
        return ids, since

    def _in_step(self, units: _Lists, draws: _Draws) -> _Lists:
        """Symbols of the units after all merges, as ``_merge`` makes them; ``draws`` go on to what is merged next.

        ``rank`` is the agenda: at each symbol, that of its piece with the next one, infinite where there is none or it
        was skipped. In each step every unit takes its lowest."""
        if not len(units.values):
            return units
        n, width = len(units.lengths), int(units.lengths.max()) + 2
        symbols = np.full(n * width, -1, np.int32)  # one of -1 before and after each unit's
        symbols[np.repeat(np.arange(n) * width + 1, units.lengths) + _within(units.lengths)] = units.values
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        made, rank = self._joined(symbols, np.append(symbols[1:], np.int32(-1)))
        rows = np.arange(n)
        while True:
            ranks = rank.reshape(n, width)[rows]
            best = ranks.argmin(1)  # the leftmost of equals
            open_ = ranks[np.arange(len(rows)), best] < np.inf
            rows, at = rows[open_], (rows * width + best)[open_]
            if not len(rows):
                break
            skip = draws.left[rows] == 0
            rank[at[skip]] = np.inf
            self._draw(draws, rows[skip])
            i = at[~skip]
            draws.left[rows[~skip]] -= 1
            j = after[i]
            k, h = after[j], before[i]
            symbols[i], symbols[j], rank[j] = made[i], -1, np.inf
            after[i], before[k] = k, i
            made[i], rank[i] = self._joined(symbols[i], symbols[k])
            made[h], rank[h] = self._joined(symbols[h], symbols[i])
        kept = symbols.reshape(n, width) >= 0
        return _Lists(symbols.reshape(n, width)[kept], kept.sum(1))

    def _draw(self, draws: _Draws, rows: np.ndarray) -> None:
        """One more skip in these units."""
        if len(rows):
            draws.skips[rows] += 1
            draws.left[rows] = self._next_gaps(draws.keys[rows], draws.places[rows], draws.skips[rows])

    def _spelled(self, symbols: _Lists) -> _Lists:
        """Ids of symbols: one, or the bytes of a character without a piece."""
        n, values = len(self.bytes_of), symbols.values
        odd = values >= n
        if not odd.any():
            return _Lists(values.astype(np.uint32), symbols.lengths)
        which, at = np.unique(values[odd], return_inverse=True)
        spelled = [[self.byte_id[b] for b in utf8(MARK if v == n + LITERAL else chr(v - n))] for v in which.tolist()]
        each = np.ones(len(values), np.int64)
        each[odd] = np.array([len(x) for x in spelled])[at]
        ids = np.repeat(values, each)
        ids[np.repeat(odd, each)] = np.fromiter(itertools.chain.from_iterable(spelled[k] for k in at.tolist()), np.int32)
        ends = np.concatenate([[0], np.cumsum(each)])[symbols.bounds]
        return _Lists(ids.astype(np.uint32), np.diff(ends))

    def _merged(self, units: _Lists, words: np.ndarray, draws: _Draws) -> _Lists:
        """Ids of units of LONGEST symbols at most, the marks after so many symbols of a word merged apart."""
        order = np.argsort(units.lengths, kind="stable")
        parts = []
        for a in range(0, len(order), UNITS_AT_ONCE):
            some = order[a:a + UNITS_AT_ONCE]
            own, drawn = units.take(some), draws.take(some)
            front, marks = own.split(words[some])
            front, marks = self._in_step(front, drawn), self._in_step(marks, drawn)  # in that order: draws go on
            draws.left[some] = drawn.left
            parts.append(self._spelled(front.beside(marks)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _Lists.end_to_end(parts, np.uint32).take(back)

    def _learn(self, units: list[str]) -> None:
        """The cache with these units too, which have the next slots."""
        raws, words = [], []
        for unit in units:
            word, marks = self._parts(unit)
            word = word if word[:1] == "\n" else " " + word
            raws.append(word + marks)
            words.append(len(word))
        codes = np.frombuffer("".join(raws).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols, words = _Lists(self._numbers[codes], np.fromiter(map(len, raws), np.int64, len(raws))), np.array(words)
        short = symbols.lengths <= LONGEST
        left = np.flatnonzero(short)
        draws = _Draws.never(len(left))
        parts, counts = [self._merged(symbols.take(left), words[left], draws)], np.zeros(len(units), np.int64)
        counts[left] = NEVER - draws.left
        for k in np.flatnonzero(~short).tolist():
            ids, counts[k] = self._run(units[k], iter((NEVER,)))
            parts.append(_Lists.of_bytes(ids))
        back = np.empty(len(units), np.int64)
        back[np.concatenate([left, np.flatnonzero(~short)])] = np.arange(len(units))
        self.pieces = _Lists.end_to_end([self.pieces, _Lists.end_to_end(parts, np.uint32).take(back)], np.uint32)
        self.symbols = _Lists.end_to_end([self.symbols, symbols], np.int32)
        self.words, self.counts = np.concatenate([self.words, words]), np.concatenate([self.counts, counts])

    def _drawn(self, slots: np.ndarray, draws: _Draws, units: list[str]) -> _Lists:
        """Ids of occurrences of those units that have a skip."""
        short = self.symbols.lengths[slots] <= LONGEST
        left, rest = np.flatnonzero(short), np.flatnonzero(~short)
        own = slots[left]
        parts = [self._merged(self.symbols.take(own), self.words[own], draws.take(left))]
        for k in rest.tolist():
            gaps = self._later_gaps(int(draws.keys[k]), int(draws.places[k]))
            parts.append(_Lists.of_bytes(self._run(units[k], itertools.chain((int(draws.left[k]),), gaps))[0]))
        back = np.empty(len(slots), np.int64)
        back[np.concatenate([left, rest])] = np.arange(len(slots))
        return _Lists.end_to_end(parts, np.uint32).take(back)

    def _encode_some(self, texts: list[str], documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_all`` of texts whose units are held together."""
        if len(self.slots) > CACHE_UNITS or len(self.symbols.values) > CACHE_SYMBOLS:
            self._forget()
        units, ends = [], [0]
        for text in texts:
            if "  " in text:
                units += [u if u[0] == "\n" else u[1:] for u in RUNS.findall(" " + text)]
            elif text:
                units += text.replace("\n", " \n").split(" ")
            ends.append(len(units))
        slots = np.fromiter(map(self.slots.__getitem__, units), np.int64, len(units))
        if self.slots.new:
            self._learn(self.slots.new)
            self.slots.new = []
        held, ends = self.pieces, np.array(ends)
        if self.rate:
            seeds = [int.from_bytes(hashlib.blake2b(utf8(f"{self.seed}\0{d}\0{t}"), digest_size=8).digest(), "little")
                     for d, t in zip(documents, texts, strict=True)]
            keys, places = np.repeat(np.array(seeds, np.uint64), np.diff(ends)), _within(np.diff(ends))
            gaps = self._first_gaps(keys, places)
            at = np.flatnonzero(gaps < self.counts[slots])
            draws = _Draws(gaps[at], keys[at], places[at], np.zeros(len(at), np.int64))
            found = self._drawn(slots[at], draws, [units[k] for k in at.tolist()])
            slots[at] = len(held.lengths) + np.arange(len(at))
            held = _Lists.end_to_end([held, found], np.uint32)
        ids = held.take(slots)
        return ids.values, np.diff(ids.bounds[ends])

    def encode_all(self, texts: list[str], documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        parts, first, chars = [], 0, 0
        for k, text in enumerate(texts):
            chars += len(text)
            if chars >= CHARS_AT_ONCE or k == len(texts) - 1:
                parts.append(self._encode_some(texts[first:k + 1], documents[first:k + 1]))
                first, chars = k + 1, 0
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])

    def encode(self, text: str, document: str = "") -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; the same text has other ones in another document."""
        return self.encode_all([text], [document])[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of such ids; broken UTF-8, as cut ids may hold, becomes U+FFFD."""
        if not ids:
            return ""
        raw = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace")[1 if raw[:1] == b" " else 0:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ROWS_AT_ONCE at most in a batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)


def codec(model: bytes, seed: int, dropout: float) -> MergeCodec:
    """The worker's codec for this vocabulary, seed and rate."""
    return held_by_worker(("codec", zlib.crc32(model), seed, dropout), lambda: MergeCodec(model, seed, dropout))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 0,
                     dropout: float = 0.1, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: id, ``ids`` (array of int).

    Null and empty texts have no ids. Rows with the same id, or none, each give a row; if they have the same text, they
    have the same ids. An empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(public_file(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, seed, dropout)
        for batch in _slices(batches):
            names = ["" if k is None else str(k) for k in batch.column("id").to_pylist()]
            flat, counts = own.encode_all(batch.column("text").to_pylist(), names)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *,
                     vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: id, ``text``, from ids of any seed and rate. Null or no ids: the empty text."""
    sent = coded.sparkSession.sparkContext.broadcast(public_file(vocabulary))
    rows = coded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, 0, 0.0)
        for batch in _slices(batches):
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy().astype("<u4").tobytes()
            texts, at = [], 0
            for n in lists.value_lengths().to_pylist():
                texts.append(own.decode(flat[at:at + 4 * n]))
                at += 4 * n
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)
