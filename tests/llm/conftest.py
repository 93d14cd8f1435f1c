from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, component_id long, `a.b` string"


def words(rng, n):
    parts = ["the", "er", "in", "tion", "ou", "é", "ß", "wh", "st", "a"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases: null, empty, blank, repeated, very long, copies, passages."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 300)) for _ in range(25)]
    passage = words(rng, 70)
    out = [None, "", "   ", "one", "One\tone", "x" * 700, "ab" * 500, "\0\0zero\0", "<|endoftext|> a<|endoftext|>", "  two  spaces \n\n lines \r\n", "日本語 テキスト 😀 é"]
    out += base + [base[0], base[0], base[3] + " more", base[4].replace(" ", "  ", 2)]
    out += [base[k] + " " + passage + " " + words(rng, 10) for k in range(5, 9)]
    out += ["password = hunter2hunter2 AKIA" + "A1" * 9 + " " + "0af9" * 8 + " token:abc secret=token:abcdef", "All rights reserved. CC BY 4.0, GNU General Public License version 3", words(rng, 4000)]
    long = list(out[-1])
    for _ in range(30):
        long[rng.randrange(len(long))] = "q"
    return [*out, "".join(long)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), 1, 2, 3, "x") for i, t in enumerate(texts)]
    rows.append((None, "a row without an id", "en", "src1", 1, 1, 2, 3, "x"))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
