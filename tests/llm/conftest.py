import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, class string, shard string, fp string, blobs string, _id long, _d int, tag string, id int, row string"


def odd_texts():
    """Texts that hold the edge cases: null, empty, blanks, marks, long, repeated, mixed scripts."""
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("an", "the", "ion", "est", "ö", "É") for b in ("ra", "lo", "ti", "né", "x")] + ["the", "of", "and", "a"]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    base = prose(120)
    near = base.split(" ")
    near[60] = "changed"
    return [None, "", " ", "\n \t", "word", "one two three", "a  b   c ", " lead", "tab\tand\nline\r\nend", "<|endoftext|> x <s>", "\0 nul \0", "é́ ﬁ 𝔘 ß ΑΣ", "▁a▁ b", prose(60), base, base, " ".join(near), prose(3000), "$$$ ### " * 40, "same line\n" * 30, "UP CASE " * 60, " 　x y"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "k", 1, "c", "z", "f", "b", 7, 8, "t", 9, "r") for i, t in enumerate(odd_texts())]
    rows += [rows[13], (None, "null id text of some words", *[None] * 14)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
