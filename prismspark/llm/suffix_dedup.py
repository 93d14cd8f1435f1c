"""Suffix-array removal of repeated byte strings by a distributed merge sort.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier.  Any such string holds the least of its ``LENGTH - GRAM + 1`` grams by
hash, and equal strings hold it at the same place; so only the suffixes that
begin at such anchors are sorted, and of those only the ones whose gram occurs
twice in the corpus, which grams counted by hash tell.

1. Gram counts: (gram hash, occurrences) summed over the corpus.
2. Each document gets its anchors of repeated grams.
3. Each task sorts its suffixes (cut at ``LENGTH`` bytes) into runs, one for
   each part of the gram hashes, and front-codes them: the length of the prefix
   shared with the one before, and the rest.
4. Each part's runs are merged by a loser tree that knows every head's common
   prefix with the last winner, so that a known prefix is never compared again.
   The merged order and its common prefixes give, for each place of a string
   around its anchor, the groups of equal strings; all but the earliest of a
   group are covered.
5. Covered strings are joined to runs of bytes per document.

A gram with more than ``HOT`` occurrences would crowd one part.  The suffixes of
its strings are dealt by all their ``LENGTH`` bytes instead of by the gram's: a
task folds equal ones to the earliest before it sorts and front-codes them, and
the parts merge these runs by the same loser tree.  So a passage in very many
documents costs a task one suffix for each different string; its other places
are covered at once.  Hashes bring equal strings together, and their bytes are
compared before one of them is folded: strings that share hashes alone stay apart
and meet in the merge.

A text is looked at in pieces of ``SLICE`` bytes that overlap by LENGTH - 1, so
each string lies in one piece whatever the text's length.

Defined results: null and empty texts have no bytes; matches never cross
documents; rows that repeat a doc_id are documents of their own, of which none
counts as earlier than the other (alike rows share their result); a document
without an id is left whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismspark.llm.storage import small_batches, written

LENGTH, GRAM = 100, 32
#: Occurrences from which a gram's strings are dealt one by one.
HOT = 2_048
#: Bytes in which anchors are sought at once: each costs some 60 meanwhile.
SLICE = 1 << 19
#: Anchors that one part of the merge aims at, and that one run holds at most.
PART, RUN = 16_384, 100_000
#: Spans and their documents up to which these are broadcast (some 16 MB);
#: beyond it the join shuffles.
BROADCAST_DOCS = 500_000
_PLACE = 24
_ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, odd: int):
        self.odd, self.inverse, self.up, self.down = odd, pow(odd, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n - 1, self.odd, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n - 1, self.inverse, np.uint64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return _mix((sums[start + size] - sums[start]) * self.down[start])

    def all_hashes(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        return _mix((sums[size:] - sums[:n]) * self.down[:n])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Anchors:
    """Anchors of a batch of texts, laid end to end."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.powers = length, gram, [Powers(o) for o in _ODD]

    def find(self, texts: list[bytes]) -> dict[str, np.ndarray] | None:
        """doc: index of the text; at: place in ``data``; first: place of the
        first string that the anchor is the least gram of; count: how many such
        strings follow one another; gram: its hash.  Sets data and bounds."""
        self.bounds = np.cumsum([0, *map(len, texts)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        if len(self.data) < self.length:
            return None
        self.sums, self.more = self.powers[0].sums(self.data), None
        grams = self.powers[0].all_hashes(self.sums, self.gram)
        # The least gram of each string; of equals the leftmost.  Slices keep
        # places under 2^_PLACE.
        key = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
        span, width = self.length - self.gram + 1, 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if span > width:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        least = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + self.length <= ends)
        if not len(start):
            return None
        least = least[start]
        new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = least[new]
        return {"doc": np.searchsorted(self.bounds, at, "right") - 1, "at": at, "first": start[new], "count": np.diff(np.concatenate([new, [len(least)]])), "gram": grams[at].view(np.int64)}


    def strings(self, at: np.ndarray, size: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the ``size`` bytes at each place."""
        if self.more is None:
            self.more = self.powers[1].sums(self.data)
        return self.powers[0].hashes(self.sums, at, size), self.powers[1].hashes(self.more, at, size)


def _slices(texts: list[str | None], length: int, limit: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(index of the text, place of the piece in it, piece) of some SLICE bytes
    at a time.  Longer texts are cut so that each string of ``length`` bytes
    lies in one piece only; shorter ones hold none."""
    limit = limit or SLICE
    out: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        for at in range(0, len(raw) - length + 1, limit):
            out.append((i, at, raw[at : at + limit + length - 1]))
            size += len(out[-1][2])
            if size >= limit:
                yield np.array([x[0] for x in out]), np.array([x[1] for x in out]), [x[2] for x in out]
                out, size = [], 0
    if out:
        yield np.array([x[0] for x in out]), np.array([x[1] for x in out]), [x[2] for x in out]


def _grams(length: int, gram: int):
    """(gram, key, n): different anchor grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for which, _, pieces in _slices(batch.column(1).to_pylist(), length):
                found = anchors.find(pieces)
                if found is None:
                    continue
                doc = which[found["doc"]]
                order = np.lexsort((found["gram"], doc))
                doc, key = doc[order], found["gram"][order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
                yield pa.RecordBatch.from_pydict({"gram": key[new], "key": rows[doc[new]], "n": np.diff(np.concatenate([new, [len(doc)]]))})

    return run


def _joined(doc: np.ndarray, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of a row (doc, key) become one."""
    if not len(doc):
        return doc, key, start, stop
    order = np.lexsort((start, key, doc))
    doc, key, start, stop = doc[order], key[order], start[order], stop[order]
    row = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    base = np.cumsum(row) * (1 << 40)  # no text is as long
    far = np.maximum.accumulate(stop + base)
    new = np.flatnonzero(np.concatenate([[True], row[1:] | (start[1:] + base[1:] > far[:-1])]))
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], key[new], start[new], far[last] - base[last]


def _later(same: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings in order of (group of equal ones, doc, key, at), ``same``
    telling which are in one group with the one before: those that also start
    earlier, and those that are the very place before (alike rows)."""
    n = np.arange(len(doc))
    head = np.maximum.accumulate(np.where(same, 0, n))
    row = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])])
    first = np.maximum.accumulate(np.where(row, 0, n))
    again = row & np.concatenate([[False], at[1:] == at[:-1]])
    return (doc != doc[head]) | (at != at[first]), again


def _pack(**arrays: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({k: pa.array(v) for k, v in arrays.items()})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def shared_prefixes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row of bytes shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
    return out


def _front_coded(rows: np.ndarray, sizes: np.ndarray) -> dict:
    """Sorted rows of bytes as prefix (shared with the row before), size, tail."""
    prefix, column = shared_prefixes(rows, sizes), np.arange(rows.shape[1])
    tail = rows[(column >= prefix[:, None]) & (column < sizes[:, None])]
    return {"prefix": prefix.astype(np.uint8), "size": sizes.astype(np.uint8), "tail": pa.array([tail.tobytes()] + [None] * (len(rows) - 1), pa.binary())}


def _strings(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """A run's prefixes and its strings."""
    prefix, size, tail = table["prefix"].to_pylist(), table["size"].to_pylist(), table["tail"][0].as_py()
    strings, last, at = [], b"", 0
    for p, n in zip(prefix, size, strict=True):
        last = last[:p] + tail[at : at + n - p]
        at += n - p
        strings.append(last)
    return prefix, strings


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[order[a]]), order[a:b]


#: Rows whose bytes are compared at once.
_ROWS = 8_192


def _alike(rows: np.ndarray, a: np.ndarray, b: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    """Whether rows ``a`` and ``b`` of a matrix of bytes are equal, in the first
    ``used`` columns of ``a`` if given."""
    out, column = np.empty(len(a), bool), np.arange(rows.shape[1])
    for at in range(0, len(a), _ROWS):
        x, y = a[at : at + _ROWS], b[at : at + _ROWS]
        same = rows[x] == rows[y]
        if used is not None:
            same |= column >= used[x, None]
        out[at : at + _ROWS] = same.all(axis=1)
    return out


class HotStrings:
    """Strings of hot grams that a task met; equal ones are folded."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.spans: list[tuple[np.ndarray, ...]] = []
        self.n = self.known = 0

    def add(self, anchors: Anchors, at: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        """Strings at ``at`` of the anchors' data; place: where in their row."""
        size = anchors.length
        one, two = anchors.strings(at, size)
        texts = np.lib.stride_tricks.sliding_window_view(anchors.data, size)
        kept = self.fold((one, two, doc, key, place, at), size, lambda a, b: _alike(texts, at[a], at[b]))
        text = texts[kept[5]]
        self.held.append((*kept[:5], text))
        self.n += len(text)
        if self.n > self.known + RUN:
            self.held = [self.folded(size)]
            self.n = self.known = len(self.held[0][0])

    def folded(self, size: int) -> tuple[np.ndarray, ...]:
        """What is held, equal strings folded."""
        x = tuple(map(np.concatenate, zip(*self.held, strict=True)))
        return self.fold(x, size, lambda a, b: _alike(x[5], a, b))

    def fold(self, x: tuple[np.ndarray, ...], size: int | np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """x: hashes of byte strings, doc, key, place in it, any others; only
        the earliest of equal strings stay, the others become spans of ``size``
        bytes.  ``alike`` compares the bytes of strings by their places in x."""
        one, two, doc, key, at = x[:5]
        order = np.lexsort((at, key, doc, two, one))
        one, two, doc, key, at = (c[order] for c in x[:5])
        same = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
        k = np.flatnonzero(same)
        same[k] = alike(order[k - 1], order[k])
        later, again = _later(same, doc, key, at)
        if later.any():
            span = (size[order] if isinstance(size, np.ndarray) else np.full(len(at), size))[later]
            self.spans.append(_joined(doc[later], key[later], at[later], at[later] + span))
            if len(self.spans) > 64:
                self.spans = [_joined(*map(np.concatenate, zip(*self.spans, strict=True)))]
        kept = order[~later & ~again]
        return tuple(c[kept] for c in x)

    def flush(self, parts: int) -> Iterator[tuple[int, int, bytes]]:
        """Its runs (kind 1), one a part, and spans (kind 2)."""
        if self.held:
            one, _, doc, key, at, text = self.folded(self.held[0][5].shape[1])
            for part, k in _by_part((one % np.uint64(parts)).astype(np.int64)):
                own = np.ascontiguousarray(text[k])
                k, own = k[order := np.argsort(own.view(f"S{own.shape[1]}").ravel(), kind="stable")], own[order]
                yield part, 1, _pack(**_front_coded(own, np.full(len(k), own.shape[1])), doc=doc[k], key=key[k], at=at[k])
        if self.spans:
            doc, key, start, stop = _joined(*map(np.concatenate, zip(*self.spans, strict=True)))
            yield int(doc[0]) % parts, 2, _pack(doc=doc, key=key, start=start, stop=stop)
        self.__init__()


def _runs(length: int, gram: int, parts: int):
    """Sorted front-coded runs, one blob for each part, and what is settled
    within the task.  kind 0: suffixes of anchors; 1: strings of hot grams; 2:
    spans."""
    behind = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, hot = Anchors(length, gram), HotStrings()
        held: list[dict[str, np.ndarray]] = []

        def out(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for part, kind, blob in rows:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "kind": pa.array([kind], pa.int32()), "blob": pa.array([blob], pa.binary())})

        def runs() -> Iterator[tuple[int, int, bytes]]:
            if not held:
                return
            x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held.clear()

            def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                same = (x["low"][a] == x["low"][b]) & (x["high"][a] == x["high"][b]) & (x["size"][a] == x["size"][b])
                return same & _alike(x["ahead"], a, b) & _alike(x["behind"], a, b, x["high"])

            # Anchors whose strings are all equal (copies meet in one task) are one.
            kept = hot.fold((x["one"], x["two"], x["doc"], x["key"], x["at"] - x["high"], np.arange(len(x["at"]))), length + x["high"] - x["low"], alike)[5]
            x = {k: v[kept] for k, v in x.items()}
            for part, k in _by_part((x["gram"].view(np.uint64) % np.uint64(parts)).astype(np.int64)):
                k = k[np.lexsort((x["size"][k], np.ascontiguousarray(x["ahead"][k]).view(f"S{length}").ravel()))]
                before = x["behind"][k][np.arange(behind) < x["high"][k, None]]
                yield part, 0, _pack(
                    **_front_coded(x["ahead"][k], x["size"][k]), doc=x["doc"][k], key=x["key"][k], at=x["at"][k], low=x["low"][k].astype(np.uint8), high=x["high"][k].astype(np.uint8),
                    behind=pa.array([before.tobytes()] + [None] * (len(k) - 1), pa.binary()),
                )

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            known = batch.column(3).flatten()
            grams, often = known.field(0).to_numpy(zero_copy_only=False), known.field(1).to_numpy(zero_copy_only=False).astype(bool)
            rare, crowded = np.unique(grams[~often]), np.unique(grams[often])
            for which, offset, pieces in _slices(batch.column(2).to_pylist(), length):
                found = anchors.find(pieces)
                if found is None:
                    continue
                begin = anchors.bounds[found["doc"]]
                doc, key, shift = ids[which[found["doc"]]], keys[which[found["doc"]]], offset[found["doc"]] - begin
                k = np.flatnonzero(np.isin(found["gram"], crowded))
                if len(k):
                    count = found["count"][k]
                    at = np.repeat(found["first"][k] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    hot.add(anchors, at, np.repeat(doc[k], count), np.repeat(key[k], count), at + np.repeat(shift[k], count))
                k = np.flatnonzero(np.isin(found["gram"], rare))
                if len(k):
                    f = {name: v[k] for name, v in found.items()}
                    end, base = anchors.bounds[f["doc"] + 1], begin[k]
                    high = f["at"] - f["first"]
                    low = high - f["count"] + 1
                    # No string around the anchor reaches further than this.
                    size = np.minimum(length - low, end - f["at"])
                    column = np.arange(length)
                    ahead = np.where(column < size[:, None], anchors.data[np.minimum(f["at"][:, None] + column, len(anchors.data) - 1)], 0).astype(np.uint8)
                    back = f["at"][:, None] - 1 - np.arange(behind)
                    before = np.where(back >= base[:, None], anchors.data[np.maximum(back, 0)], 0).astype(np.uint8)
                    one, two = anchors.strings(f["first"], f["count"] - 1 + length)
                    held.append({"one": one ^ high.astype(np.uint64), "two": two, "gram": f["gram"], "ahead": ahead, "size": size, "behind": before, "doc": doc[k], "key": key[k], "at": f["at"] + shift[k], "low": low, "high": high})
                if sum(len(h["at"]) for h in held) > RUN:
                    yield from out(runs())
                if hot.n > 2 * RUN:
                    yield from out(hot.flush(parts))
        yield from out(runs())
        yield from out(hot.flush(parts))

    return run


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8 if x else n


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each given as prefixes shared with the string before
    and the strings.  Returns the (run, place) order and for each string the
    prefix it shares with the one before it.

    A loser tree: each node keeps the run that lost there, with the prefix its
    head shares with the winner that beat it.  Of two heads the one that shares
    more with the last winner is smaller; only heads that share the same length
    are compared, from there on.
    """
    count = 1
    while count < len(runs):
        count *= 2
    place = [0] * len(runs)
    heads: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (count - len(runs))
    shared = [0] * count

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets what the loser shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = _common(x, y, shared[a])
        if len(x) == n or (len(y) > n and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * count
    layer = list(range(count))
    at = count
    while len(layer) > 1:
        at //= 2
        won = []
        for k in range(0, len(layer), 2):
            w, lost = play(layer[k], layer[k + 1])
            losers[at + k // 2] = lost
            won.append(w)
        layer = won
    winner, order, prefixes = layer[0], [], []
    while heads[winner] is not None:
        order.append((winner, place[winner]))
        prefixes.append(shared[winner])
        place[winner] += 1
        own_prefixes, own = runs[winner]
        if place[winner] < len(own):
            heads[winner], shared[winner] = own[place[winner]], own_prefixes[place[winner]]
        else:
            heads[winner] = None
        node = (winner + count) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return order, prefixes


def _merge(length: int, gram: int):
    behind = length - gram

    def merged(tables: list[pa.Table], names: list[str]) -> tuple:
        """Prefixes of the merged order, columns in that order, the order."""
        runs = [_strings(t) for t in tables]
        order, prefixes = merge_runs(runs)
        offset = np.cumsum([0] + [len(r[1]) for r in runs])
        pick = np.array([offset[r] + i for r, i in order])
        whole = pa.concat_tables([t.select(names) for t in tables])
        return np.array(prefixes), [whole[c].to_numpy()[pick].astype(np.int64) for c in names], pick

    def run(group: pa.Table) -> pa.Table:
        kinds, blobs = group["kind"].to_numpy(), group["blob"].to_pylist()
        tables = [[_unpack(blobs[k]) for k in np.flatnonzero(kinds == kind)] for kind in range(3)]
        spans = [tuple(t[c].to_numpy() for c in ("doc", "key", "start", "stop")) for t in tables[2]]
        if tables[1]:
            prefixes, (doc, key, at), _ = merged(tables[1], ["doc", "key", "at"])
            alike = np.cumsum(prefixes < length)
            order = np.lexsort((at, key, doc, alike))
            doc, key, at, alike = doc[order], key[order], at[order], alike[order]
            later, _ = _later(np.concatenate([[False], alike[1:] == alike[:-1]]), doc, key, at)
            spans.append((doc[later], key[later], at[later], at[later] + length))
        if tables[0]:
            prefixes, columns, pick = merged(tables[0], ["doc", "key", "at", "low", "high"])
            before = np.zeros((len(pick), behind), np.uint8)
            sizes = np.concatenate([t["high"].to_numpy() for t in tables[0]])
            before[np.arange(behind) < sizes[:, None]] = np.concatenate([np.frombuffer(t["behind"][0].as_py(), np.uint8) for t in tables[0]])
            spans += list(_covered(prefixes, before[pick], *columns, length))
        doc, key, start, stop = _joined(*(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*spans, strict=True))) if spans else (np.zeros(0, np.int64),) * 4
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})

    return run


def _covered(prefixes: np.ndarray, before: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Strings that also start earlier: (doc, key, start, stop).  A string that
    begins ``o`` bytes before its anchor equals another if the suffixes share
    length - o bytes (neighbours in sorted order do) and so do the o before."""
    n = len(doc)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, key, doc))] = np.arange(n)
    held = np.zeros(n, np.int64)  # rows whose last o bytes before the anchor are equal share a number
    for o in range(before.shape[1] + 1):
        own = (low <= o) & (o <= high)
        group = np.cumsum(prefixes < length - o)
        often = np.bincount(group, own, group[-1] + 1)[group] > 1
        k = np.flatnonzero(own & often)
        if len(k):
            order = k[np.lexsort((rank[k], held[k], group[k]))]
            g, x = group[order], held[order]
            same = np.concatenate([[False], (g[1:] == g[:-1]) & (x[1:] == x[:-1])])
            later, _ = _later(same, doc[order], key[order], at[order])
            order = order[later]
            if len(order):
                yield doc[order], key[order], at[order] - o, at[order] - o + length
        if o < before.shape[1]:
            k = np.flatnonzero(high > o)
            _, held[k] = np.unique(held[k] * 256 + before[k, o], return_inverse=True)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2)
        which = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        row, _, start, stop = _joined(which, which, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False))
        bounds = np.searchsorted(row, np.arange(len(spans) + 1))
        pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["start", "stop"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)], names=["doc_id", "key", "spans"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, part: int = PART) -> DataFrame:
    """(doc_id, key, spans): the byte spans of each different row of doc_id and
    text (start, stop) that are covered by strings that also start earlier, in
    order and apart; rows without any are left out.  key: the text's xxhash64."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").filter("doc_id is not null and text is not null")
    grams = written(texts.select("key", "text").mapInArrow(_grams(length, gram), "gram long, key long, n long"), "suffix-grams")
    counts = grams.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram", (F.col("n") > hot).alias("often"))
    marked = grams.select("gram", "key").join(counts, "gram")
    lists = marked.groupBy("key").agg(F.collect_set(F.struct("gram", "often")).alias("grams"))  # a text's own anchors
    lists = written(lists, "suffix-anchors")
    total = lists.agg(F.sum(F.size("grams"))).first()[0] or 0
    parts = max(1, -(-total // part))
    # Copies share a key, so that they meet in a task, or in few if they are many.
    filled = texts.join(lists, "key").select("doc_id", "key", "text", "grams")
    runs = filled.mapInArrow(_runs(length, gram, parts), "part int, kind int, blob binary")
    spans = runs.groupBy("part").applyInArrow(_merge(length, gram), "doc_id long, key long, start long, stop long")
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # a document's own spans
    return spans.mapInArrow(_merged, "doc_id long, key long, spans array<struct<start:bigint,stop:bigint>>")


def _cut(texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * texts
    kinds = [pa.int64()] * 4 + [pa.string()] * (1 + texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                kept, at = [], 0
                for span in spans or []:
                    kept.append(raw[at : span["start"]])
                    at = span["stop"]
                kept.append(raw[at:])
                rest = b"".join(kept)
                row = (doc_id, len(raw), len(raw) - len(rest), len(kept) - 1, hashlib.sha256(rest).hexdigest())
                out.append((*row, rest.decode("utf-8", "replace")) if texts else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with
    ``texts`` kept_text: the text of the remaining bytes; where a cut falls
    within a character, its rest shows as replacement characters."""
    spans = written(repeated_spans(docs, length, gram), "suffix-spans").withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    if (spans.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= BROADCAST_DOCS:
        spans = F.broadcast(spans)
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    rows = docs.select("doc_id", "text").join(spans, same, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)
