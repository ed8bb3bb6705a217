"""Token counts, packing, and the merge codec."""

import struct
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, empty, rows
from tillroll.llm.common import public_file
from tillroll.llm.merge_codec import MergeCodec, decode_documents, encode_documents
from tillroll.llm.packing import best_fit_packing, fit_patterns, length_patterns, nonnegative_least_squares, pack
from tillroll.llm.token_counts import BYTE_COST, MARK, TokenTrie, token_counts, unigram_scores

MODEL = public_file("piece_bpe_32k.model")


def plain_count(word: str, scores: dict[str, int]) -> int:
    """Tokens of the best segmentation, by trying every piece at every place."""
    text = MARK + word
    best = [(0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        # tokens count down, so that the larger pair is the better one
        options = [(s, n) for s, n in ((best[a][0] + scores[text[a:end]], best[a][1] - 1)
                                       for a in range(max(0, end - 16), end) if text[a:end] in scores)]
        if text[end - 1] not in scores:
            size = len(text[end - 1].encode())
            options.append((best[end - 1][0] - size * BYTE_COST, best[end - 1][1] - size))
        best[end] = max(options)
    return -best[-1][1]


def test_trie_counts_match_plain_dynamic_programming():
    trie, scores = TokenTrie(MODEL), unigram_scores(MODEL)
    words = "thingheheti thing things the a été Übermut 日本語 😀x a▁b".split() + ["ab" * 100, "q", "zzzzzz"]
    assert [trie.count(w) for w in words] == [plain_count(w, scores) for w in words]
    ended = [w + end for w in words for end in (".", ",", "...", "?!", ".x", ")")]
    assert trie.total(ended) == sum(plain_count(w, scores) for w in ended)
    again = TokenTrie(MODEL)
    assert [again.count(w) for w in reversed(words)] == [trie.count(w) for w in reversed(words)]


def test_token_counts_of_awkward_rows(spark):
    got = token_counts(awkward(spark)).collect()
    assert len(got) == len(rows())
    assert all(r.n_tokens == r.n_words == 0 for r in got if r.doc_id in (3, 4, 5))
    assert sorted(r.n_words for r in got if r.doc_id == 1) == [9, 11, 11]
    assert token_counts(empty(spark)).collect() == []


def test_packing_of_awkward_rows(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_buffer(public_file("word_bpe_49k.json"))
    got = best_fit_packing(awkward(spark)).collect()
    wanted = []
    for row in rows():
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            wanted.append((str(row[0]), k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(wanted) == sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= sum(r.length for r in got) // 4096 + 2
    assert best_fit_packing(empty(spark)).collect() == []


def test_packs_nearly_full_sequences():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6.4, 1.0, 6000).astype(int), 1, 4096)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    sequence, offset = pack(lengths, fit_patterns(histogram, 4096, 16), 4096, 16)
    assert sequence.max() + 1 <= 1.005 * lengths.sum() / 4096 + 1
    ends = np.zeros(sequence.max() + 1, dtype=int)
    np.add.at(ends, sequence, lengths)
    assert ends.max() <= 4096 and (offset + lengths).max() <= 4096


def test_least_squares_and_patterns():
    assert sorted(length_patterns(4)) == [(1, 1, 2), (1, 3), (2, 2), (4,)]
    a = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]])
    x = np.array([0.5, 0.0, 2.0])
    assert np.allclose(nonnegative_least_squares(a, a @ x), x)
    assert np.allclose(nonnegative_least_squares(np.eye(2), np.array([-1.0, 2.0])), [0, 2])
    assert fit_patterns({}, 4096, 16) == []


TEXTS = [r[1] or "" for r in rows()] + ["  a  b\n\n c ", "\n", "...   ....  .", "q.\n.  .a.", "a\tb", "tail ", " ▁ "]


def test_codec_without_dropout_is_the_library():
    import sentencepiece
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=MODEL), MergeCodec(MODEL)
    for text in TEXTS:
        if MARK not in text:  # the library loses that character
            assert list(struct.unpack(f"<{len(codec.encode(text)) // 4}I", codec.encode(text))) == library.encode(text)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_codec_is_lossless_and_seeded(rate):
    one, same, other = (MergeCodec(MODEL, seed, rate) for seed in (1, 1, 2))
    assert [one.decode(one.encode(t)) for t in TEXTS] == TEXTS
    assert [one.encode(t) for t in TEXTS] == [same.encode(t) for t in reversed(TEXTS)][::-1]
    assert ([one.encode(t) for t in TEXTS] != [other.encode(t) for t in TEXTS]) == (0 < rate < 1)


def codec_texts() -> list[str]:
    """Words of every length about LONGEST, marks, blanks, line ends, literal marks, and characters without a piece."""
    import random
    rng = random.Random(3)
    parts = ["a", "the", "government,", " ", "  ", "\n", "▁", "😀", "日本", "x" * 60, "...", "!?;:", ".", "q.", "\0", "\t", "é",
             "word.", "thing", "ERROR", "y" * 46, "y" * 47, "y" * 48, "z" * 49, ",,,," * 20]
    return TEXTS + ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(60)]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_codec_in_step_is_the_heap(rate, monkeypatch):
    """Units merged in step, in blocks of any size and with a cache that forgets, against one at a time with a heap."""
    import tillroll.llm.merge_codec as module
    texts = codec_texts()
    names = [str(k) for k in range(len(texts))]

    def ids(**settings) -> list[bytes]:
        for name, value in settings.items():
            monkeypatch.setattr(module, name, value)
        flat, counts = MergeCodec(MODEL, 7, rate).encode_all(texts, names)
        return [x.tobytes() for x in np.split(flat, np.cumsum(counts)[:-1])]

    own = ids()
    assert ids(UNITS_AT_ONCE=17, CHARS_AT_ONCE=2000, CACHE_UNITS=50) == own
    assert ids(LONGEST=-1) == own


def test_codec_ids_are_those_of_round_3():
    """Digests of the ids that the encoder gave when it merged one unit at a time."""
    codec = MergeCodec(MODEL, 20240501, 0.1)
    raw = b"".join(codec.encode(t, str(k)) for k, t in enumerate(codec_texts()))
    assert (len(raw) // 4, zlib.crc32(raw)) == (257189, 1864899760)


def test_short_units_are_not_merged_one_by_one(monkeypatch):
    def refuse(*args):
        raise AssertionError("one unit alone")
    monkeypatch.setattr(MergeCodec, "_merge", refuse)
    text = " ".join(f"government{k}, thing." for k in range(300))
    codec = MergeCodec(MODEL, 1, 0.3)
    assert codec.decode(codec.encode(text, "1")) == text


def test_codec_round_trip_of_awkward_rows(spark):
    coded = encode_documents(awkward(spark), seed=5, dropout=0.2)
    got = decode_documents(coded).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r[0]), r[1] or "") for r in rows())
    assert encode_documents(empty(spark)).collect() == decode_documents(encode_documents(empty(spark))).collect() == []


def test_occurrences_of_a_word_are_segmented_apart(spark):
    codec, word = MergeCodec(MODEL, 1, 0.1), "government,"
    first = [codec.encode(f"{word} {word} {word}", str(k)) for k in range(2000)]
    assert len(set(first)) > 20
    assert {codec.decode(ids) for ids in first} == {f"{word} {word} {word}"}
    ids = [codec.encode(" ".join([word] * 5000), str(k)) for k in range(2)]
    assert ids[0] != ids[1]
    df = spark.createDataFrame([(k, "the government of the people") for k in range(60)], "doc_id long, text string")
    assert len({tuple(r.ids) for r in encode_documents(df, seed=5, dropout=0.2).collect()}) > 5


def test_dropout_rate_is_that_of_every_candidate():
    def plain(symbols: list[str], rng) -> tuple[str, ...]:
        barred = set()
        while True:  # symbols as (start, text)
            pairs = [(codec.rank[a[1] + b[1]], a[0], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
                     if a[1] + b[1] in codec.rank and (a, b) not in barred]
            if not pairs:
                return tuple(s for _, s in symbols)
            k = min(pairs)[2]
            if rng.random() < 0.3:
                barred.add((symbols[k], symbols[k + 1]))
            else:
                symbols = [*symbols[:k], (symbols[k][0], symbols[k][1] + symbols[k + 1][1]), *symbols[k + 2:]]

    codec, rng, n = MergeCodec(MODEL, 3, 0.3), np.random.default_rng(1), 20_000
    start = list(enumerate(MARK + "thing"))
    wanted, got = {}, {}
    for _ in range(n):
        s = tuple(codec.ids[x] for x in plain(list(start), rng))
        wanted[s] = wanted.get(s, 0) + 1
    for k in range(n):
        ids = codec.encode("thing", str(k))
        s = struct.unpack(f"<{len(ids) // 4}I", ids)
        got[s] = got.get(s, 0) + 1
    for s in wanted.keys() | got.keys():
        assert abs(wanted.get(s, 0) - got.get(s, 0)) < 0.02 * n


def test_word_ids_equal_the_plain_call():
    """Also where the strings of special tokens stand in a text, alone, inside words and beside marks."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from tillroll.llm.packing import WordIds
    model = public_file("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_buffer(model), random.Random(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "Hello", "wörld", "it's", "don't", "a", ",", ".",
             "!!", "42", "日本", "😀", "x" * 70, "é", "\u00a0", "\u2003", "|", "it''s"]
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "", " ", "\n\n"]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.randint(1, 30)))
              for _ in range(3000)]
    got = list(WordIds(model).encode(pa.array(texts)))
    for text, ids in zip(texts, got, strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text
    assert list(struct.unpack("<3I", got[0])) == [320, 49407, 321]


def test_token_counts_of_stretches(monkeypatch):
    """White space of every kind, texts cut into many stretches, and a cache that forgets, against the plain sums."""
    import random

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from tillroll.llm import token_counts as module
    monkeypatch.setattr(module, "STRETCH_CHARS", 100)
    monkeypatch.setattr(module, "TERMINALS", 20)
    rng = random.Random(1)
    blanks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
    texts = ["".join(rng.choice(["a", "the", "word,", "wörd", "日本", "x" * 90, "\u200b"]) + rng.choice([*blanks, ""])
                     for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(300)] + ["  lead", "trail  ", " ", ""]
    trie, plain = module.TokenTrie(public_file("piece_bpe_32k.model")), module.TokenTrie(public_file("piece_bpe_32k.model"))
    at = 0
    for part in module.stretches(pa.array(texts)):
        words, places, bounds = module.split_words(part, pc.utf8_split_whitespace)
        counts = np.array([n if w else 0 for w, n in zip(words, trie.counts([w or "x" for w in words]))])
        real = np.array([bool(w) for w in words])
        for n, tokens, text in zip(module.sums(real[places], bounds), module.sums(counts[places], bounds), part.to_pylist()):
            assert text == texts[at] and n == len(text.split()) and tokens == plain.total(text.split())
            at += 1
    assert at == len(texts)


def test_codec_holds_few_rows_at_once():
    import pyarrow as pa
    from tillroll.llm.merge_codec import ROWS_AT_ONCE, _slices
    rows_ = pa.record_batch({"id": list(range(2 * ROWS_AT_ONCE + 7))})
    got = list(_slices(iter([rows_, rows_.slice(0, 0), rows_.slice(3, 1)])))
    assert [b.num_rows for b in got] == [ROWS_AT_ONCE, ROWS_AT_ONCE, 7, 1]
    assert [i for b in got for i in b.column("id").to_pylist()] == [*range(2 * ROWS_AT_ONCE + 7), 3]
