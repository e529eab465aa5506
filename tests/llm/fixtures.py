"""Documents that hold every awkward case, and helpers to write them as tables."""

import random

from crossgrid.llm.queries import PIECES as PIECE_MODEL, WORD_BPE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, component_id string, ids string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["th", "er", "on", "an", "re", "sh", "ou", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def documents() -> list[tuple]:
    base = words(1, 120)
    near = base[:]
    near[60] = "changed"
    passage = " ".join(words(2, 70))
    texts = {
        0: " ".join(base),
        1: " ".join(base),
        2: " ".join(near),
        3: None,
        4: "",
        5: " \n\t ",
        6: "one",
        7: "One two",
        8: "one two",
        9: "head of a text " + passage + " and then its own end",
        10: "quite another beginning " + passage + " with a different close",
        11: " ".join(words(3, 20_000)),
        12: "x" * 5000,
        13: "# # # $ $ % % | < > " * 30,
        14: "same line here\n" * 40,
        15: "ÀÉ straße İΣΣ 日本語 <|endoftext|> don't",
        16: "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a",
    }
    for k in range(20, 60):
        texts[k] = " ".join(words(100 + k, 30 + k)) + "."
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 3}" if k % 5 else None, len(t or ""), 7, "x", "y", "z") for k, t in texts.items()]
    return [*rows, (None, "a row without an id, of ten words or maybe more", None, None, 1, 7, "x", "y", "z"), rows[20], rows[20]]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()


TOKENIZER, PIECES = WORD_BPE, PIECE_MODEL
