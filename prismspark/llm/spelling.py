"""Spelling variants by permuterm rotations.

All rotations of every word, marked with a terminator, are dealt by the prefix
that skips the edited character and sorted.  Rotation ``s$t`` + c of the word
t + c + s lies in the range of prefix ``s$t``, as do the words that differ from
it in c alone; the word t + s, which lacks c, has ``s$t`` as a whole rotation.
So each range holds at most one shorter word and one word for each letter in
c's place, all of them near each other.  A scan of the sorted ranges hands out,
for each member, how many others it met and the most frequent of them; pairs
are never listed.  A word that doubles a letter is met by the shorter word at
the first of the equal letters only, so every near word counts once.

Words beyond ``LONG`` letters would need rotations of the square of their
length; they are cut into segments of ``LONG`` letters, and the rotations of
one segment go with digests of what stands before and after it, so their rows
grow with their length alone.

A word's form is its most frequent near word, if that is at least ``RATIO``
times as frequent; roots follow forms by doubling steps, and since frequencies
grow at each step there are at most five.

Defined results: null and empty texts have no words; a null doc_id counts as
the empty text in the hash; rows that repeat a doc_id all count; an empty table
has no words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismspark.llm.storage import map_rows, written

LETTERS, UPPER, MARK = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "$"
LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_ONE_IN, LONG = 7, 2, 10, 31, 64

ROTATION = "prefix string, letter string, first boolean, n long, word string"
NEAR = "word string, met long, best_n long, best string"


def _cut(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and their occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, UPPER.lower()))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    words = runs.select(F.when(F.col("h") % drop_one_in == 0, _cut(F.col("run"), at)).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame, long: int = LONG) -> DataFrame:
    """Rows of ``ROTATION``: each word's whole rotations (no letter), and those
    that skip their last letter (which is ``first`` of equal letters or not).
    ``word`` is null where the rotation tells it."""
    w, k = F.col("word"), F.col("k")
    rows = words.filter(F.length("word") <= long).select("word", "n", F.explode(F.sequence(F.lit(0), 2 * F.length("word"))).alias("k"))
    i, skip = F.shiftright(k, 1), (k % 2 == 1)
    letter = F.substr(w, i + 1, F.lit(1))
    short = rows.select(
        F.concat(F.substr(w, i + 1 + skip.cast("int")), F.lit(MARK), F.substr(w, F.lit(1), i)).alias("prefix"),
        F.when(skip, letter).alias("letter"),
        (skip & ((i == 0) | (F.substr(w, i, F.lit(1)) != letter))).alias("first"),
        "n",
        F.lit(None).cast("string").alias("word"),
    )
    fields = words.sparkSession.createDataFrame([], ROTATION).schema.fields
    wide = map_rows(words.filter(F.length("word") >= long).select("word", "n"), _segments(long), fields)
    # A long word's text goes with the few rows that meet another.
    shared = wide.groupBy("prefix").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("prefix")
    digest = F.sha2(F.col("word"), 256)
    texts = words.filter(F.length("word") >= long).select(digest.alias("id"), F.col("word").alias("text"))
    wide = wide.join(shared, "prefix").join(texts, F.col("word") == F.col("id")).select("prefix", "letter", "first", "n", F.col("text").alias("word"))
    return short.unionByName(wide)


def _segments(long: int) -> Callable:
    """(word, n) of at least ``long`` letters to rotations of segments, ``word``
    being its digest.  Words of just ``long`` letters are here only to be met
    by longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, size = hashlib.sha256(word.encode()).hexdigest(), len(word)
                before, after = _digests(word, long)
                for b in range(0, size + 1, long):
                    out = []
                    # As the shorter of two words: one letter less in the segment.
                    e = min(b + long, size + 1)
                    part, key = word[b : e - 1], f"{before[b]}{after[e - 1]}"
                    out += [(f"{key}{part[i:]}{MARK}{part[:i]}", None, False, n, name) for i in range(len(part) + 1)]
                    if size > long and b < size:
                        e = min(b + long, size)
                        part, key = word[b:e], f"{before[b]}{after[e]}"
                        out += [(f"{key}{part[i + 1:]}{MARK}{part[:i]}", part[i], b + i == 0 or word[b + i - 1] != part[i], n, name) for i in range(len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=[f"c{i}" for i in range(5)])

    return run


def _digests(word: str, step: int) -> tuple[dict[int, str], dict[int, str]]:
    """Digests of what stands before each segment and after each place where
    one may end, in one pass from each side."""
    size, before, after = len(word), {}, {}
    wanted = {min(b + step, size + 1) - 1 for b in range(0, size + 1, step)} | {min(b + step, size) for b in range(0, size, step)}
    sha = hashlib.sha256()
    for b in range(0, size + 1, step):
        before[b] = sha.copy().hexdigest()[:32]
        sha.update(word[b : b + step].encode())
    sha, right = hashlib.sha256(), size
    for e in sorted(wanted, reverse=True):
        sha.update(word[e:right][::-1].encode())
        after[e], right = f"{sha.copy().hexdigest()[:32]}{size - e}.", e
    return before, after


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations to what the members of each range meet in it."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if len(held) < 2:
            continue
        # The last range may go on in the next batch.
        starts = _starts(held)
        yield from _ranges(held.slice(0, starts[-1]), starts[:-1])
        held = held.slice(starts[-1])
    if held is not None and len(held):
        yield from _ranges(held, _starts(held))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where each range of equal prefixes begins."""
    prefix = rows.column(0).combine_chunks()
    apart = pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], apart.astype(bool)]))


def _ranges(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(np.append(starts, len(rows)))
    shared = sizes > 1
    if not shared.any():
        return
    kept = rows.filter(pa.array(np.repeat(shared, sizes)))
    prefix, letter, first, n, word = (c.to_pylist() for c in kept.columns)
    out: list[tuple[str, int, int, str]] = []
    at = 0
    for size in sizes[shared].tolist():
        whole, skipping = None, []
        head, _, tail = prefix[at].partition(MARK)
        for k in range(at, at + size):
            if letter[k] is None:
                whole = (-n[k], word[k] or tail + head)
            else:
                skipping.append((-n[k], word[k] or tail + letter[k] + head, first[k]))
        at += size
        skipping.sort()
        for k, (_, name, heads) in enumerate(skipping):
            best = skipping[1 if k == 0 else 0][:2] if len(skipping) > 1 else None
            met = len(skipping) - 1
            if whole and heads:
                met, best = met + 1, min(best, whole) if best else whole
            if best:
                out.append((name, met, -best[0], best[1]))
        if whole:
            longer = [x for x in skipping if x[2]]
            if longer:
                out.append((whole[1], len(longer), -longer[0][0], longer[0][1]))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[f"c{i}" for i in range(4)])


def neighbours(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n, n_near, best, best_n) of ``words`` (word, n), whose words are
    distinct: how many near words each has, and the most frequent of them."""
    fields = words.sparkSession.createDataFrame([], NEAR).schema.fields
    dealt = rotations(words, long).repartition("prefix").sortWithinPartitions("prefix")
    met = map_rows(dealt, _scan, fields).select("word", F.lit(None).cast("long").alias("n"), "met", F.struct((-F.col("best_n")).alias("m"), "best").alias("best"))
    rows = words.select("word", "n", F.lit(0).cast("long").alias("met"), F.lit(None).cast(met.schema["best"].dataType).alias("best"))
    both = rows.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("met").alias("n_near"), F.min("best").alias("best"))
    return both.select("word", "n", "n_near", F.col("best.best").alias("best"), (-F.col("best.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where ``forms`` (word, form) lead from each of its words.
    Every form is more frequent than its word, so there are no circles."""
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        found = further.select("word", "root")
        if not further.filter("moved").limit(1).count():
            return found


def variants(docs: DataFrame, ratio: int = RATIO, long: int = LONG, **counted: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id,
    text)."""
    words = written(vocabulary(docs, **counted), "spelling-words")
    near = neighbours(words, long)
    taken = F.col("best_n") >= ratio * F.col("n")
    near = written(near.select("word", F.when(taken, F.col("best")).alias("form"), "n", "n_near", F.when(taken, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(near.filter("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
