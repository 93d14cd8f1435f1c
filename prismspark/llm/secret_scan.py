"""Secret scans through a trigram inverted index, on DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams
(`trigram_query`).  One pass over the texts writes the postings of the trigrams
that any query asks for; the postings are intersected per document, which gives
the candidate rules of each document; only those are verified with the regular
expression.  A rule without mandatory trigrams is scanned over every text.

Defined results: a null text counts as empty; an empty text has no spans; a
document whose id repeats (or is null) is scanned row by row, its candidates
being those of all rows with that id, so nothing is missed; rows are never
dropped, and columns other than ``doc_id`` and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismspark.llm.storage import fresh, written

#: Candidate rows up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: A set of strings larger than this stops a literal run (its prefix stays mandatory).
MAX_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: that group has at least so many characters, else
    the match is dropped (its text stays consumed)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The base kinds, in the order of their contract.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# What follows the first line of a key.  Repeated groups are bounded or of one
# character class, as Java's engine recurses on others.
_CHAR = "A-Za-z0-9+/="
_TO_END = r"[^-]*(?:-[^-]+){0,30}-----END [A-Z ]{0,20}PRIVATE KEY-----"
_HEADERS = r"(?:[ \t]*[\r\n]+[ \t]*[A-Za-z][A-Za-z0-9-]*:[^\r\n]*){0,9}"
#: Without an END line: long runs, indented or not, and a shorter last line;
#: lines of any length from the margin; lines whose ends are written as \n.
_LONG = rf"[ \t\r\n]+[{_CHAR}]{{40,}}(?:[{_CHAR} \t\r\n]*[{_CHAR}]{{40,}})?(?:[ \t]*[\r\n]+[ \t]*[{_CHAR}]{{1,39}}(?m:$))?"
_LINES = rf"[ \t]*[\r\n]+[{_CHAR}\r\n]*[{_CHAR}](?m:$)"
_ESCAPED = rf"\\[rn][{_CHAR}\\]*"
# Published token formats that the method adds.
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----(?:{_TO_END}|{_HEADERS}(?:{_LONG}|{_LINES})|{_ESCAPED})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^ \t\n\r/:@]+:[^ \t\n\r/@]{3,}@"),
)


class _Reader:
    """Reads the part of regular-expression syntax that rules use, as the
    strings that must occur: a node is a set of exact strings, or None where
    nothing is known, with the trigram clauses found so far."""

    def __init__(self, regex: str):
        self.s, self.i, self.fold = regex, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def alternation(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        if all(p[0] is not None and not p[1] for p in parts):
            return set().union(*(p[0] for p in parts)), []
        options = [p[1] + _clauses(p[0]) for p in parts]
        return None, [] if not all(options) else [("or", [("and", o) for o in options])]

    def sequence(self):
        run, found = {""}, []
        while (c := self.peek()) and c not in "|)":
            strings, clauses = self.repeat()
            found += clauses
            if strings is None:
                found += _clauses(run)
                run = {""}
            elif len(run) * len(strings) > MAX_STRINGS:
                found += _clauses(run)
                run = strings
            else:
                run = {a + b for a in run for b in strings}
        if found:
            return None, found + _clauses(run)
        return run, found

    def repeat(self):
        strings, clauses = self.atom()
        c = self.peek()
        if c == "?":
            self.i += 1
            return (strings | {""}, []) if strings is not None and len(strings) == 1 and not clauses else (None, [])
        if c == "*":
            self.i += 1
            return None, []
        if c == "+":
            self.i += 1
            return None, clauses + _clauses(strings)
        if c == "{":
            end = self.s.index("}", self.i)
            least = int(self.s[self.i + 1 : end].split(",")[0])
            self.i = end + 1
            return None, (clauses + _clauses(strings)) if least else []
        return strings, clauses

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            inner = self.alternation()
            self.i += 1
            self.fold = before
            return inner
        if c == "[":
            return self.charset(), []
        if c == ".":
            return None, []
        return {self.literal(c)}, []

    def literal(self, c: str) -> str:
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                c = chr(int(self.s[self.i : self.i + 2], 16))
                self.i += 2
        # Lower case stands for either case under (?i:...); marked by a leading NUL.
        return c.lower() + "\0" if self.fold and c.isalpha() else c

    def charset(self):
        negated, members = self.peek() == "^", set()
        self.i += negated
        while self.peek() != "]":
            c = self.s[self.i]
            self.i += 1
            c = self.literal(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                last = self.s[self.i + 1]
                self.i += 2
                members |= {chr(x) for x in range(ord(c), ord(last) + 1)}
            else:
                members.add(c)
        self.i += 1
        return None if negated or len(members) > 8 else members


def _clauses(strings) -> list:
    """The Boolean query of a run that is one of ``strings``; none if one of
    them is shorter than a trigram."""
    if strings is None:
        return []
    options = []
    for s in strings:
        chars, i = [], 0
        while i < len(s):
            fold = s[i + 1 : i + 2] == "\0"
            chars.append((s[i], fold))
            i += 2 if fold else 1
        if len(chars) < 3:
            return []
        grams = [chars[k : k + 3] for k in range(len(chars) - 2)]
        options.append(("and", [("has", "".join(c for c, _ in g).lower() if any(f for _, f in g) else "".join(c for c, _ in g), any(f for _, f in g)) for g in grams]))
    return options if len(options) == 1 else [("or", options)]


def trigram_query(regex: str) -> tuple | None:
    """Boolean query that every match of ``regex`` fulfils: nested
    ``("and", [...])``, ``("or", [...])`` and ``("has", trigram, folded)``;
    None if no trigram is mandatory."""
    strings, clauses = _Reader(regex).alternation()
    clauses = clauses + _clauses(strings)
    return ("and", clauses) if clauses else None


def _trigrams(query) -> set[tuple[str, bool]]:
    return {query[1:]} if query[0] == "has" else set().union(*map(_trigrams, query[1]))


def _holds(query, has: dict[tuple[str, bool], Column]) -> Column:
    if query[0] == "has":
        return has[query[1:]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(q, has) for q in query[1]])


def trigram_postings(docs: DataFrame, trigrams: list[tuple[str, bool]]) -> DataFrame:
    """Inverted index (trigram, doc_id) of the given trigrams, in one pass."""
    text, low = F.col("text"), F.col("low")
    held = [F.when((low if fold else text).contains(t), F.lit(k)) for k, (t, fold) in enumerate(trigrams)]
    return (
        docs.select("doc_id", "text", F.lower("text").alias("low"))
        .select("doc_id", F.explode(F.array_compact(F.array(*held))).alias("trigram"))
        .select("trigram", "doc_id")
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): bit k says that rule k's trigram query holds in the
    document; documents without a candidate rule have no row."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex))}
    trigrams = sorted(set().union(*map(_trigrams, queries.values())))
    words = range(0, len(trigrams), 62)
    postings = trigram_postings(docs, trigrams)
    by_doc = postings.groupBy("doc_id").agg(
        *[F.expr(f"bit_or(if(trigram between {w} and {w + 61}, shiftleft(1L, trigram - {w}), 0L))").alias(f"m{w}") for w in words]
    )
    has = {t: F.col(f"m{k // 62 * 62}").bitwiseAND(F.lit(1 << k % 62).cast("long")) != 0 for k, t in enumerate(trigrams)}
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(_holds(q, has), F.lit(1 << k)).otherwise(F.lit(0)) for k, q in queries.items()])
    return by_doc.select("doc_id", mask.cast("int").alias("rules")).filter("rules != 0")


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's matches, in code points:
    the lengths of what lies between matches and of the matches add up."""
    regex = F.lit(rule.regex)
    zero, none = F.lit(0), F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    gaps = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda x: F.length(x))
    kept = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    steps = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("keep"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["keep"], F.lit(False)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, F.struct(zero.alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, name: str = "spans") -> DataFrame:
    """``docs`` (doc_id, text, any others) with a column ``name``: an array of
    (start, ord, kind, end) over all rules, by start, then rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = written(candidates(docs.select("doc_id", text.alias("text")), rules), "secret-candidates")
    ident, held = fresh(docs, "__candidate"), fresh(docs, "__rules")
    side = found.select(F.col("doc_id").alias(ident), F.col("rules").alias(held))
    if found.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    marked = docs.join(side, F.col("doc_id").eqNullSafe(F.col(ident)), "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    columns = []
    for k, rule in enumerate(rules):
        found_by_index = F.coalesce(F.col(held).bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))
        test = F.lit(True) if trigram_query(rule.regex) is None else found_by_index
        columns.append(F.when(test & text.rlike(rule.regex), _spans(text, rule, k)).otherwise(none))
    return marked.withColumn(name, F.array_sort(F.concat(*columns))).drop(ident, held)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, text, spans) of every row of ``docs``; see ``with_spans``."""
    return with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``with_spans`` replaced by ``mask``: all rows
    and columns are kept, a null text stays null, overlapping spans merge."""
    name = fresh(docs, "__spans")
    text, spans = F.col("text"), F.col(name)

    def cut(acc: Column, x: Column) -> Column:
        part = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    marked = with_spans(docs, rules, name)
    return marked.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
