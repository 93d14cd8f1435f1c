"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each
character; dynamic programming carries only the best score and its number of
pieces.  Ties follow the tokenizer's rule: the candidate that starts first is
kept and replaced only by a strictly better one.  A character that no
one-character piece covers may be taken as unknown, at the lowest score less
10, and then counts as its bytes if the vocabulary has byte pieces.

Spaces become the mark U+2581 and one is put in front unless the text begins
with it.  No piece holds the mark after another character, so the best path of
a text is the best paths of its units (marks, then other characters) one after
another; scores are whole numbers, so sums and ties are exact.  Each unit is
worked out once a worker.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows
count each; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from prismspark.llm.storage import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Units that a worker keeps before it lets them go.
HELD_UNITS = 500_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def splits_at_marks(pieces: list[tuple[str, float]]) -> bool:
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces) and all(float(s).is_integer() for _, s in pieces)


class Counter:
    """Best score and number of pieces of a unit."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in range(256))

    def unit(self, text: str) -> tuple[float, int]:
        """Matches come by their end, the longest (which starts first) before
        the others; a place is closed once all that end there are seen."""
        n, at, top, pieces, single = len(text), 0, None, 0, False
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), self.unknown
        for end, (size, score) in self.automaton.iter(text):
            while at < end:
                if not single and (top is None or best[at] + unknown > top):
                    top, pieces = best[at] + unknown, count[at] + self.unknown_pieces(text[at])
                at += 1
                best[at], count[at], top, single = top, pieces, None, False
            value = best[end + 1 - size] + score
            if top is None or value > top:
                top, pieces = value, count[end + 1 - size] + 1
            single |= size == 1
        while at < n:
            if not single and (top is None or best[at] + unknown > top):
                top, pieces = best[at] + unknown, count[at] + self.unknown_pieces(text[at])
            at += 1
            best[at], count[at], top, single = top, pieces, None, False
        return best[n], count[n]

    def unknown_pieces(self, c: str) -> int:
        return len(c.encode("utf-8", "surrogatepass")) if self.bytes else 1


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of every row under the vocabulary at ``path``."""
    small_batches(docs.sparkSession)
    pieces = load_pieces(path)
    cut = re.compile("(?s).+")
    if splits_at_marks(pieces):
        # A line end that no piece holds is a unit of its own.
        alone = "" if any("\n" in p for p, _ in pieces) else "\n"
        cut = re.compile(f"{alone}|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary file's size
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = Counter(sent.value), {}
        gc.disable()  # the table holds no cycles, and is large to walk
        for batch in batches:
            counts, scores = [], []
            for text in batch.column(1).to_pylist():
                marked = (text or "").replace(" ", MARK)
                if marked and not marked.startswith(MARK):
                    marked = MARK + marked
                units = cut.findall(marked)
                for u in set(units).difference(known):
                    known[u] = counter.unit(u)
                found = [known[u] for u in units]
                counts.append(sum(c for _, c in found))
                scores.append(float(sum(s for s, _ in found)))
                if len(known) > HELD_UNITS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], schema=schema)
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
