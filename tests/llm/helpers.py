"""Tables with every awkward case: nulls in any column, empty, blank and very long texts, ties, repeated rows, odd
characters, extra columns whose names clash with results, and no rows at all."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, id string"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


def rows() -> list[tuple]:
    texts = {
        1: "the cat sat on the mat and looked at the dog", 2: "the cat  sat on the mat\tand looked at the dog",
        3: "", 4: None, 5: "   \n\t ", 6: LONG, 7: LONG + " tail", 8: "ein kurzer Satz über Äpfel, ß und ÿ.",
        9: "日本語 テキスト 😀 a▁b <|endoftext|> it's", 10: "one", 11: "1234 !!! ###", 12: "x" * 5000,
    }
    out = [(k, t, "en" if k % 2 else "de", f"src{k % 3}", None if t is None else len(t), True, 0.5, "clash")
           for k, t in texts.items()]
    out.append(out[0])  # a repeated row
    out.append((1, "another text with the id of the first one", None, None, None, None, None, None))
    out.append((None, "a text without any id at all", "fr", "src0", None, False, None, None))
    out.append((None, None, None, None, None, None, None, None))
    return out


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(seed: int = 0, groups: int = 8, largest: int = 12) -> list[tuple[int, str]]:
    """(id, text): groups of texts that differ in a few words, exact copies, and texts that share a passage only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=40)
    out: list[str] = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(30, 150))
        for _ in range(1 + g * largest // groups):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    for _ in range(30):
        own = rng.choices(vocabulary, k=rng.randint(20, 100))
        out.append(" ".join(own + passage))
    out += ["a b", "A  b", "a b c", "", "short text of five words"]
    rng.shuffle(out)
    return list(enumerate(out, 1))
