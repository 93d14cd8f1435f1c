"""Byte-level BPE encoding and decoding through a transducer lexicon.

The most frequent words of the whole corpus are counted, encoded by exact
merges and compiled into a minimal acyclic automaton whose suffixes are shared.
Each arc adds a number, so that a path's sum is the word's place in sorted
order; that place leads to the word's ids.  Its flat arrays are memory-mapped by
the Python workers.  Words that the lexicon does not hold are merged exactly, so
the ids never depend on its size.

Results equal those of the tokenizer file with special tokens recognised in
the text and none added.  Defined results: null and empty texts have no ids;
repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import heapq
import json
import mmap
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismspark.llm.storage import small_batches, written

#: Words in the lexicon at most; it bounds what is broadcast (a few MB).
LEXICON_WORDS = 100_000
#: Words that a worker counts or keeps before it lets them go; half of them where
#: ids are packed too.
HELD_WORDS = 450_000

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if
    it prints, else the next free code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


_MEETING, _MARKS = re.compile(r"\s\s"), frozenset(".,;:!?|-")


class Vocabulary:
    """Pieces and merges of a byte-level BPE tokenizer file.  ``ranks`` holds
    the rank of a pair of ids, ``made`` the id that the merge of a rank makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        ids = {as_bytes(t): i for t, i in data["model"]["vocab"].items()}
        self.pieces = {i: b for b, i in ids.items()}
        self.bytes = [ids[bytes([b])] for b in range(256)]
        pairs = [[as_bytes(t) for t in (m if isinstance(m, list) else m.split(" "))] for m in data["model"]["merges"]]
        self.ranks = {ids[a] << 20 | ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids by exact merges: the best-ranked pair first, the leftmost of equals."""
        ids = [self.bytes[b] for b in word]
        if len(ids) > 256:
            return _merge_long(ids, self.ranks, self.made)
        rank, none = self.ranks.get, len(self.made)
        found = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i] = self.made[best]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = rank(ids[i - 1] << 20 | ids[i], none)
            if i < len(found):
                found[i] = rank(ids[i] << 20 | ids[i + 1], none)
        return ids


class Merger:
    """Exact merges of many words at once.  In each round every word makes its
    best-ranked merge, the leftmost of equals, until none of its pairs has a
    rank; only pairs beside a merge are looked up again."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.none = vocab, len(vocab.made)
        keys = np.fromiter(vocab.ranks.keys(), np.int64, len(vocab.ranks))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(vocab.ranks.values(), np.int64, len(keys))[order]
        self.made, self.bytes = np.array(vocab.made, np.int64), np.array(vocab.bytes, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        for k, w in enumerate(words):
            if len(w) > 256:
                out[k] = self.vocab.merge(w)
        name = np.array([k for k, w in enumerate(words) if 0 < len(w) <= 256], np.int64)
        size = np.array([len(words[k]) for k in name], np.int64)
        if not len(name):
            return out
        ids = self.bytes[np.frombuffer(b"".join([words[k] for k in name]), np.uint8)]
        word = np.repeat(np.arange(len(name)), size)
        rank = np.full(len(ids), self.none)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while True:
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, start)
            done = best == self.none
            if done.any():
                flat, at = ids.tolist(), start.tolist()
                for k in np.flatnonzero(done).tolist():
                    out[name[k]] = flat[at[k] : at[k] + size[k]]
                live = ~done
                if not live.any():
                    return out
                stay = np.repeat(live, size)
                ids, rank = ids[stay], rank[stay]
                name, size, best = name[live], size[live], best[live]
                word = np.repeat(np.arange(len(name)), size)
            hit = np.flatnonzero(rank == best[word])
            first = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            ids[first] = self.made[best]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            moved = first - np.arange(len(first))  # one left out before each
            ids, rank, word, size = ids[keep], rank[keep], word[keep], size - 1
            near = np.concatenate([moved[moved > 0] - 1, moved])
            near = near[near + 1 < len(ids)]
            same = word[near] == word[near + 1]
            rank[moved] = self.none
            rank[near[same]] = self.rank(ids[near[same]], ids[near[same] + 1])


def _merge_long(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """As ``Vocabulary.merge``, with a heap over linked ids, for very long words."""
    n, gone = len(ids), -1
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else -1
        if j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = made[r], gone, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k, m in ((before[i], i), (i, after[i])):
            if k >= 0 and m >= 0 and (r := ranks.get(ids[k] << 20 | ids[m])) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[m]))
    return [x for x in ids if x != gone]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words with their ids, as flat arrays:
    sorted arc keys (state * 256 + byte), targets, numbers added; whether a
    state ends a word; bounds and ids of each word in sorted order."""
    order = sorted(words)
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each registered state: ((byte, target), ...)
    ends: list[bool] = []
    counts: list[int] = []

    def close(node: list) -> int:
        """node: [is_end, [[byte, child], ...]] with registered children."""
        key = (node[0], tuple((b, c) for b, c in node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            ends.append(node[0])
            counts.append(node[0] + sum(counts[c] for _, c in key[1]))
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            child = path.pop()
            path[-1][1][-1][1] = close(child)
        for b in word[same:]:
            path[-1][1].append([b, None])
            path.append([False, []])
        path[-1][0], last = True, word
    while len(path) > 1:
        child = path.pop()
        path[-1][1][-1][1] = close(child)
    root = close(path[0])
    keys, targets, adds = [], [], []
    for state, out in enumerate(arcs):
        passed = int(ends[state])
        for b, c in out:
            keys.append(state * 256 + b)
            targets.append(c)
            adds.append(passed)
            passed += counts[c]
    ids = [words[w] for w in order]
    bounds = np.cumsum([0, *map(len, ids)])
    parts = [np.array([root]), np.array(keys), np.array(targets), np.array(adds), np.array(ends), bounds, np.array([x for i in ids for x in i])]
    parts = [p.astype(np.int64 if k == 1 else np.int32) for k, p in enumerate(parts)]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """Memory-mapped view of ``compile_lexicon``'s arrays."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:  # gone from the folder, kept by the map
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, parts = np.frombuffer(self.map, np.int64, 7), 56, []
        for k, n in enumerate(sizes):
            kind = np.int64 if k == 1 else np.int32
            parts.append(np.frombuffer(self.map, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        root, self.keys, self.targets, self.adds, self.ends, self.bounds, self.ids = parts
        self.root = int(root[0])

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for words it does not hold.  All words
        walk the automaton together, a byte a step."""
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state, place, live = np.full(n, self.root, np.int64), np.zeros(n, np.int64), size > 0
        at = np.flatnonzero(live)
        for step in range(int(size.max(initial=0))):
            at = at[size[at] > step]
            if not len(at) or not len(self.keys):
                break
            key = state[at] * 256 + data[start[at] + step]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            live[at[~ok]] = False
            at, k = at[ok], k[ok]
            state[at] = self.targets[k]
            place[at] += self.adds[k]
        live &= self.ends[state].astype(bool)
        return [self.ids[self.bounds[p] : self.bounds[p + 1]].tolist() if ok else None for ok, p in zip(live.tolist(), place.tolist(), strict=True)]


def _split(pattern, special: dict[str, int], text: str) -> list[str]:
    """Words of a text; a special token is a word of its own."""
    if not any(s in text for s in special):
        return pattern.findall(text)
    out: list[str] = []
    for part in regex.split("(" + "|".join(map(regex.escape, special)) + ")", text):
        if part in special:
            out.append(part)
        elif part:
            out += pattern.findall(part)
    return out


def chunks(text: str) -> list[str] | None:
    """A text cut before each space and around each line end, where words end
    whatever stands around; None where two white spaces meet, for there the
    pattern has to see both."""
    if "\0" in text or _MEETING.search(text):
        return None
    return list(filter(None, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


def pieces_of(pattern, special: dict[str, int], text: str) -> list[str]:
    """Chunks of a text, or its words where chunks would not do."""
    found = None if any(s in text for s in special) else chunks(text)
    return _split(pattern, special, text) if found is None else found


def words_in(pattern, piece: str) -> list[str]:
    """Words of a piece; plain letters, and letters before one mark of
    punctuation, need no pattern."""
    body = piece[1:] if piece[0] == " " else piece
    if body.isalpha():
        return [piece]
    if body[-1:] in _MARKS and body[:-1].isalpha():
        return [piece[:-1], body[-1]]
    return pattern.findall(piece)


def frequent_words(docs: DataFrame, special: dict[str, int], n: int = LEXICON_WORDS) -> DataFrame:
    """(word, n) of words by their count in all texts: those from the least
    count on at which at most ``n`` words are left.  Workers count first, so
    that the shuffle moves a word once a task; the limit is read off a table of
    how many words have each count, so no task gathers the words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = regex.compile(PATTERN), Counter()

        def out() -> pa.RecordBatch:
            words: dict[str, int] = {}
            for piece, k in held.items():
                for w in [piece] if piece in special else words_in(pattern, piece):
                    words[w] = words.get(w, 0) + k
            held.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(pieces_of(pattern, special, text))
            if len(held) > HELD_WORDS:
                yield out()
        yield out()
        _give_back()

    words = docs.select("text").mapInArrow(count, "word string, n long")
    words = written(words.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "bpe-words")
    # Counts to three binary digits: at most 8 rows for each power of two.
    step = F.pow(F.lit(2.0), F.floor(F.log2("n")) - 3)
    levels = words.groupBy((F.floor(F.col("n") / step) * step).alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, float("inf")
    for level, k in levels:
        total += k
        if total > n:
            break
        least = level
    return words.filter(F.col("n") >= least)


class Encoder:
    """Encodes pieces in one worker, by the lexicon and else by exact merges;
    what it met stays in bounded tables."""

    def __init__(self, vocab: Vocabulary, lexicon: bytes, packed: bool = False):
        self.packed, self.limit = packed, HELD_WORDS // (2 if packed else 1)
        self.vocab, self.lexicon, self.merger, self.pattern = vocab, Lexicon(lexicon), Merger(vocab), regex.compile(PATTERN)
        # Ids joined by commas, their number, their bytes decoded; with packed only the ids as 32-bit numbers.
        self.known: dict[str, tuple | bytes] = {}
        self.words: dict[str, tuple | bytes] = {}
        self.digits = {i: str(i) for i in vocab.pieces}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > self.limit:
            self.known.clear()
            self.words.clear()
        cut = {p: [p] if p in self.vocab.special else words_in(self.pattern, p) for p in pieces}
        fresh = list({w for words in cut.values() for w in words}.difference(self.words))
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        decode, digits = self.vocab.pieces, self.digits
        found = self.lexicon.find(raw)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.merger.merge([raw[k] for k in unseen]), strict=True):
            found[k] = ids
        for w, ids in zip(fresh, found, strict=True):
            if w in self.vocab.special:
                ids = [self.vocab.special[w]]
            self.words[w] = array("i", ids).tobytes() if self.packed else (",".join([digits[i] for i in ids]), len(ids), b"".join([decode[i] for i in ids]))
        for p, words in cut.items():
            if len(words) == 1:
                self.known[p] = self.words[words[0]]
            elif self.packed:
                self.known[p] = b"".join([self.words[w] for w in words])
            elif len(words) == 2:
                a, b = self.words[words[0]], self.words[words[1]]
                self.known[p] = (a[0] + "," + b[0], a[1] + b[1], a[2] + b[2])
            else:
                ids, sizes, raw = zip(*[self.words[w] for w in words], strict=True)
                self.known[p] = (",".join(ids), sum(sizes), b"".join(raw))

    def encode(self, texts: list[str | None]) -> Iterator[tuple]:
        """(number of ids, ids joined by commas, decoded bytes) of each text;
        with packed also the ids as 32-bit numbers."""
        cut = [pieces_of(self.pattern, self.vocab.special, t) if t else [] for t in texts]
        pieces = set().union(*cut)
        missing = pieces.difference(self.known)
        if missing:
            self.learn(missing if len(self.known) + len(missing) <= self.limit else pieces)
        for own in cut:
            if self.packed:
                packed = b"".join(map(self.known.__getitem__, own))
                ids = np.frombuffer(packed, np.int32).tolist()
                yield len(ids), ",".join(map(self.digits.__getitem__, ids)), b"".join(map(self.vocab.pieces.__getitem__, ids)), packed
            elif own:
                ids, sizes, raw = zip(*map(self.known.__getitem__, own), strict=True)
                yield sum(sizes), ",".join(ids), b"".join(raw)
            else:
                yield 0, "", b""


def _give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task, of
    whatever operator, with what its allocators keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call beside glibc
        ctypes.CDLL(None).malloc_trim(0)


def _encoder(docs: DataFrame, path: str, lexicon_words: int, packed: bool):
    small_batches(docs.sparkSession)
    vocab = Vocabulary(path)
    rows = frequent_words(docs, vocab.special, lexicon_words).collect()  # LEXICON_WORDS rows at most
    words = [r["word"].encode("utf-8", "surrogatepass") for r in rows if r["word"] not in vocab.special]
    words = dict(zip(words, Merger(vocab).merge(words), strict=True))
    sent = docs.sparkSession.sparkContext.broadcast((vars(vocab), compile_lexicon(words)))  # both of bounded size

    def make() -> Encoder:
        own = Vocabulary.__new__(Vocabulary)
        own.__dict__.update(sent.value[0])
        return Encoder(own, sent.value[1], packed)

    return make


def encode_decode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, outputs: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; with
    ``outputs`` also the ids and the decoded text themselves."""
    make = _encoder(docs, path, lexicon_words, outputs)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if outputs else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        gc.disable()  # the tables hold no cycles, and are large to walk
        for batch in batches:
            out = [[] for _ in fields]
            for doc_id, (n, ids, raw, *numbers) in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                decoded = raw.decode("utf-8", "replace")
                row = [doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                row += [np.frombuffer(numbers[0], np.int32), decoded] if outputs else []
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        gc.enable()
        del encoder
        _give_back()

    types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else "")
    return docs.select("doc_id", "text").mapInArrow(run, types)
