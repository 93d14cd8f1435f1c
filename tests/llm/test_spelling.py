"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from prismspark.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, ratio=10):
    form, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
        out[w] = [n, len(others), counts[best] if form[w] else None]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def rows(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_of_texts(spark):
    rng = random.Random(4)
    base = ["letters", "lettters", "letterss", "mottled", "möttled", "bookkeeper", "aaaaaaaa", "Straße" + "nbahn", "Éclairs" + "s", "short", "abcdefg" * 8, "x" * 63, "x" * 64, "x" * 65, "x" * 66, "y" * 400]
    rare = ["letter", "letterz", "aaaaaaa", "aaaaaaaaa", "bookeeper", "bokkeeper", "mottles", "y" * 199 + "z" + "y" * 200, "y" * 399, "q" + "x" * 64, "x" * 64 + "q"]
    texts = [" ".join(rng.choices(base, [90, 8, 1, 20, 2, 60, 5, 9, 9, 50, 4, 3, 3, 3, 3, 30], k=200)) + "," + "-".join(rng.choices(rare, k=6)) for _ in range(60)]
    texts += [None, "", "  ", "1234567", texts[0], texts[0], "LETTERS×÷ lettersLETTERS"]
    docs = spark.createDataFrame([(None if i == 5 else i % 64, t, 1, "a", 2) for i, t in enumerate(texts)], "doc_id long, text string, n long, word string, `a.b` int").repartition(3)
    counts: dict[str, int] = {}
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    got = rows(spelling.variants(docs))
    assert got == expected(counts)
    assert sum(r[0] is not None for r in got.values()) > 10 and any(r[1] != r[0] for r in got.values() if r[0])
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("long", [3, 5, 64])
def test_neighbours_of_all_lengths(spark, long):
    """Words of few letters, so that most ranges are full and letters double."""
    rng = random.Random(long)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 13))) for _ in range(250)}
    words |= {w[:i] + rng.choice("abz") + w[i:] for w in list(words)[:60] for i in (0, len(w) // 2, len(w))}
    counts = {w: rng.randint(1, 5) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["n"], r["n_near"], r["best"], r["best_n"]) for r in spelling.neighbours(frame, long).collect()}
    for w, n in counts.items():
        others = [v for v in counts if near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        assert got[w] == (n, len(others), best, counts.get(best)), w
    assert len(got) == len(counts)


def test_rows_of_a_long_word_grow_with_its_length(spark):
    frame = spark.createDataFrame([("ab" * 20_000, 2), ("ab" * 19_999 + "a", 3)], "word string, n long")
    rows = spelling.map_rows(frame, spelling._segments(64), spark.createDataFrame([], spelling.ROTATION).schema.fields)
    size = rows.agg(F.count(F.lit(1)), F.sum(F.length("prefix"))).first()
    assert size[0] < 2.2 * 80_000 and size[1] < 140 * size[0]
    assert {r["n_near"] for r in spelling.neighbours(frame).collect()} == {1}


def test_roots_follow_long_ways(spark):
    forms = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(18)] + [("a", "w03"), ("b", "w03")], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w18"}
    assert spelling.roots(forms.limit(0)).count() == 0
