"""Toxicity scores of a counterfactual-regularised logistic classifier.

Features are the presence of beginnings of words (3 to 8 letters) and of whole
words, chosen by their log-odds in labelled texts.  In fitting, labelled texts
have counterfactuals: one that names identity groups is told with every group
swapped for another of its category and language, and a seeded share of the
others is told with a group's term put in, and with its swap.  The loss adds the
squared difference between a text's log-odds and its counterfactual's (a
difference of scores would hardly count where they are near 0 or 1), so that
naming a group does not by itself move a score.

Labels are read only of rows whose crc32(doc_id as text) mod 3 is not 1, from
at most ``TRAIN_ROWS`` of them (those of least hash); language, source, labels
and ids are never inputs of a score.

Defined results: empty and null texts get the score of no features; rows that
repeat are scored each; a repeated label counts once, as toxic if any says so;
null labels are not used; of rows that repeat an id the least text is learnt
from; with no labelled rows of both kinds every score is 0.5; a null doc_id is
not held out.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from prismspark.llm.storage import fresh, map_rows, small_batches, written

TRAIN_ROWS, FEATURES, LEAST_DOCS = 20_000, 4_096, 4
THRESHOLD = 0.7
#: Weights of the mean squared difference of counterfactuals, and of L2.
FAIRNESS, RIDGE = 1.0, 2e-4
ROUNDS, RATE = 300, 0.1
HELD_WORDS = 200_000

#: Of texts that name no group, one in so many is told with a group put in.
INSERT_EVERY = 2

# Terms that name groups, by language and category, as stems with
# the endings of their forms.
GROUPS = {
    "en": {
        "religion": "atheist:,s buddhist:,s catholic:,s christian:,s hindu:,s jew:,s,ish muslim:,s protestant:,s",
        "origin": """african:,s arab:,s asian:,s black:,s european:,s foreigner:,s gyps:y,ies hispanic:,s immigrant:,s indigenous: latin:o,os,a,as
          mexican:,s migrant:,s refugee:,s turk:,s,ish white:,s""",
        "gender": "boy:,s girl:,s male:,s female:,s man: woman: men: women:",
        "orientation": "bisexual:,s gay:,s homosexual:,s lesbian:,s queer: straight: trans: transgender:",
        "body": "blind: deaf: disabled: elderly: old: young:",
    },
    "de": {
        "religion": """atheist:,en,in buddhist:,en,in christ:,en,in,innen,lich,liche,lichen hindu:,s jude:,n jüd:in,innen,isch,ische,ischen
          katholi:k,ken,kin,sch,sche,schen moslem:,s muslim:,e,en,in,isch,ische,ischen protestant:,en,in""",
        "origin": """afrikan:er,ern,erin,erinnen,isch,ische,ischen arab:er,ern,erin,erinnen,isch,ische,ischen asiat:e,en,in,innen,isch,ische,ischen
          ausländer:,n,in,innen europä:er,ern,erin,erinnen,isch,ische,ischen flüchtling:,e,en geflüchtete:,n indigen:,e,en migrant:,en,in,innen
          roma: sinti: schwarz:,e,en,er türk:e,en,in,innen,isch,ische,ischen weiß:,e,en,er zuwanderer:,n""",
        "gender": "frau:,en mädchen: mann: männer:,n männlich:,e,en weiblich:,e,en",
        "orientation": "bisexuell:,e,en homosexuell:,e,en lesbe:,n lesbisch:,e,en schwul:,e,en,er trans: transgender:",
        "body": "alt:,e,en,er behindert:,e,en blind:,e,en gehörlos:,e,en jung:,e,en senioren: taub:,e,en",
    },
    "es": {
        "religion": "ate:o,os,a,as budista:,s católic:o,os,a,as cristian:o,os,a,as hindú:,es judí:o,os,a,as musulm:án,anes,ana,anas protestante:,s",
        "origin": """african:o,os,a,as árabe:,s asiátic:o,os,a,as blanc:o,os,a,as europe:o,os,a,as extranjer:o,os,a,as gitan:o,os,a,as hispan:o,os,a,as
          indígena:,s inmigrante:,s latin:o,os,a,as mexican:o,os,a,as migrante:,s negr:o,os,a,as refugiad:o,os,a,as turc:o,os,a,as""",
        "gender": "chic:o,os,a,as niñ:o,os,a,as hombre:,s mujer:,es femenin:o,a masculin:o,a",
        "orientation": "bisexual:,es gay:,s hetero: homosexual:,es lesbiana:,s trans: transgénero:",
        "body": "ancian:o,os,a,as cieg:o,os,a,as discapacitad:o,os,a,as joven: jóvenes: sord:o,os,a,as viej:o,os,a,as",
    },
    "fr": {
        "religion": "athée:,s bouddhiste:,s catholique:,s chrétien:,s,ne,nes hindou:,s,e,es juif:,s juive:,s musulman:,s,e,es protestant:,s,e,es",
        "origin": """africain:,s,e,es arabe:,s asiatique:,s blanc:,s,he,hes européen:,s,ne,nes étranger:,s étrangère:,s gitan:,s,e,es hispanique:,s
          immigré:,s,e,es indigène:,s latino:,s maghrébin:,s,e,es migrant:,s,e,es noir:,s,e,es réfugié:,s,e,es rom:,s turc:,s turque:,s""",
        "gender": "femme:,s homme:,s fille:,s garçon:,s féminin:,e masculin:,e",
        "orientation": "bisexuel:,s,le,les gay:,s hétéro: homosexuel:,s,le,les lesbienne:,s trans: transgenre:,s",
        "body": "âgé:,s,e,es aveugle:,s handicapé:,s,e,es jeune:,s sourd:,s,e,es vieux: vieille:,s",
    },
}


def _forms(spec: str) -> list[tuple[str, str]]:
    return [(stem, end) for stem, ends in (x.split(":") for x in spec.split()) for end in ends.split(",")]


FORMS = {lang: {kind: _forms(spec) for kind, spec in kinds.items()} for lang, kinds in GROUPS.items()}
#: Where each term of a language stands: its category, stem and ending.
IDENTITY_TERMS = {lang: {stem + end: (kind, stem, end) for kind, forms in kinds.items() for stem, end in forms} for lang, kinds in FORMS.items()}
_LANGS: dict[str, tuple[str, ...]] = {t: tuple(lang for lang in IDENTITY_TERMS if t in IDENTITY_TERMS[lang]) for terms in IDENTITY_TERMS.values() for t in terms}
#: Words that tell which language's terms a spelling shared by several is of.
COMMON_WORDS = {
    "en": frozenset("the and of to is was that with for are this not you they his from have were".split()),
    "de": frozenset("der die das und ist nicht ein eine mit von zu den dem sind auf für sich auch".split()),
    "es": frozenset("el los las que y una es por con para del no se como más su muy este".split()),
    "fr": frozenset("le les des et est une que dans pour qui pas sur au avec ce il sont du".split()),
}

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(word: str) -> list[str]:
    return [word[:n] for n in range(3, 9) if len(word) >= n] + [word + "$"]


def _ranks(words: set[str], terms: set[str]) -> dict[str, tuple[int, int]]:
    """How clearly the words are of each language: common words, then terms."""
    return {lang: (len(words & COMMON_WORDS[lang]), len(terms & IDENTITY_TERMS[lang].keys())) for lang in IDENTITY_TERMS}


def other_term(term: str, lang: str) -> str:
    """Another group's term of the same category, in the same form if it has
    one; chosen by a hash."""
    kind, stem, end = IDENTITY_TERMS[lang][term]
    others = [f for f in FORMS[lang][kind] if f[0] != stem]
    alike = [f for f in others if f[1] == end] or others
    return "".join(alike[zlib.crc32(term.encode()) % len(alike)])


def swapped(words: set[str]) -> set[str] | None:
    """The words with every identity term swapped for another one of its
    category and language; None if there is none.  A spelling of several
    languages is of that with most common words, then most terms, in the text."""
    terms = words & _LANGS.keys()
    if not terms:
        return None
    rank = _ranks(words, terms)
    return (words - terms) | {other_term(t, max(_LANGS[t], key=rank.__getitem__)) for t in terms}


def counterfactuals(words: set[str], seed: int) -> list[set[str]]:
    """The words told of other groups: swapped where they name some, else, for
    one seed in INSERT_EVERY, with a term put in, and with its swap.  Words of
    no known language get a language by the seed."""
    swap = swapped(words)
    if swap is not None:
        return [swap]
    if not words or seed % INSERT_EVERY:
        return []
    seed, rank = seed // INSERT_EVERY, _ranks(words, set())
    lang = max(rank, key=rank.__getitem__) if any(n for n, _ in rank.values()) else sorted(rank)[seed % len(rank)]
    terms = sorted(IDENTITY_TERMS[lang])
    term = terms[seed // len(rank) % len(terms)]
    return [words | {term}, words | {other_term(term, lang)}]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``limit`` labelled documents."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # the bound of what is broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # A row an id, so that the bound holds for rows too.
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def choose_features(train: DataFrame, n: int = FEATURES) -> list[str]:
    """The features with the clearest log-odds, and the identity terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(words_of(text)) for f in word_features(w)}:
                    found.setdefault(f, [0, 0])[bool(toxic)] += 1
        yield pa.RecordBatch.from_pydict({"f": pa.array(list(found), pa.string()), "neg": pa.array([x[0] for x in found.values()], pa.int64()), "pos": pa.array([x[1] for x in found.values()], pa.int64())})

    counts = train.select("text", "toxic").mapInArrow(count, "f string, neg long, pos long")
    counts = counts.groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).filter(F.col("neg") + F.col("pos") >= LEAST_DOCS)
    total = train.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = total["pos"] or 0, total["n"] - (total["pos"] or 0)
    odds = F.log((F.col("pos") + 0.5) / F.lit(pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(neg + 1.0))
    best = counts.select("f", (F.abs(odds) * F.log1p(F.when(odds > 0, F.col("pos")).otherwise(F.col("neg") * F.lit(pos / max(neg, 1))))).alias("gain"))
    rows = best.orderBy(F.desc("gain"), "f").limit(n).collect()
    return sorted({r["f"] for r in rows} | {t + "$" for t in _LANGS})


def _row_ids(words: set[str], index: dict[str, int]) -> list[int]:
    return sorted({index[f] for w in words for f in word_features(w) if f in index})


class Design:
    """What the loss is made of: labelled rows by their features, and the
    counterfactuals of some as signed changes to them."""

    def __init__(self, rows: list, n: int):
        self.n, self.y = n, np.array([r["toxic"] > 0 for r in rows], float)
        pos = self.y.sum()
        self.weight = np.where(self.y > 0, 0.5 / max(pos, 1), 0.5 / max(len(rows) - pos, 1))
        self.row = np.repeat(np.arange(len(rows)), [len(r["own"]) for r in rows])
        self.col = np.array([i for r in rows for i in r["own"]], np.int64)
        changes = [(k, plus, minus) for k, r in enumerate(rows) for plus, minus in zip(r["plus"], r["minus"], strict=True)]
        self.base = np.array([k for k, _, _ in changes], np.int64)
        self.pair = np.repeat(np.arange(len(changes)), [len(p) + len(m) for _, p, m in changes])
        self.changed = np.array([i for _, p, m in changes for i in (*p, *m)], np.int64)
        self.sign = np.array([s for _, p, m in changes for s in (*[1.0] * len(p), *[-1.0] * len(m))])

    def loss(self, w: np.ndarray, bias: float, fairness: float) -> tuple[float, np.ndarray, float]:
        """The loss, its gradient by the weights, and by the bias."""
        z = np.bincount(self.row, w[self.col], len(self.y)) + bias
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        push = self.weight * (score - self.y)
        value = float(self.weight @ np.logaddexp(0, np.where(self.y > 0, -z, z)) + RIDGE / 2 * w @ w)
        grad = RIDGE * w
        if len(self.base) and fairness:
            gap, scale = np.bincount(self.pair, self.sign * w[self.changed], len(self.base)), fairness / len(self.base)
            value += float(scale * gap @ gap)
            grad = grad + np.bincount(self.changed, 2 * scale * self.sign * gap[self.pair], self.n)
        return value, grad + np.bincount(self.col, push[self.row], self.n), float(push.sum())


def design(train: DataFrame, names: list[str]) -> Design:
    """The rows are bounded by TRAIN_ROWS, each by the number of features."""
    index = {f: i for i, f in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, plus, minus = [], [], []
            for text in batch.column(0).to_pylist():
                words = set(words_of(text))
                ids = set(_row_ids(words, index))
                told = [set(_row_ids(c, index)) for c in counterfactuals(words, zlib.crc32((text or "").encode("utf-8", "surrogatepass")))]
                own.append(sorted(ids))
                plus.append([sorted(t - ids) for t in told])
                minus.append([sorted(ids - t) for t in told])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1).cast(pa.int32()), "own": pa.array(own, ints), "plus": pa.array(plus, pa.list_(ints)), "minus": pa.array(minus, pa.list_(ints))})

    schema = "toxic int, own array<int>, plus array<array<int>>, minus array<array<int>>"
    rows = train.select("text", "toxic").mapInArrow(encode, schema).collect()
    rows.sort(key=lambda r: (r["toxic"], r["own"], r["plus"], r["minus"]))
    return Design(rows, len(names))


def fit(train: DataFrame, features: int = FEATURES, fairness: float = FAIRNESS, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias."""
    names = choose_features(train, features)
    rows = design(train, names)
    if not 0 < rows.y.sum() < len(rows.y):
        return {}, 0.0
    if fairness and not len(rows.base):
        warnings.warn("no labelled text has a counterfactual: the classifier is a plain one", stacklevel=2)
    w, m, v, m0, v0, bias = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0, 0.0
    for step in range(1, rounds + 1):
        _, grad, grad0 = rows.loss(w, bias, fairness)
        m, v, m0, v0 = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * m0 + 0.1 * grad0, 0.999 * v0 + 0.001 * grad0**2
        rate = RATE * (1 - step / (rounds + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w, bias = w - rate * m / (np.sqrt(v) + 1e-8), bias - rate * m0 / (np.sqrt(v0) + 1e-8)
    return {f: float(x) for f, x in zip(names, w, strict=True) if x}, float(bias)


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """``docs`` with the score as a further, last column; all rows and columns
    are kept."""
    small_batches(docs.sparkSession)
    names = sorted(weights)
    index, values = {f: i for i, f in enumerate(names)}, [weights[f] for f in names]
    sent = docs.sparkSession.sparkContext.broadcast((index, values, bias))  # FEATURES entries
    at, name = docs.columns.index("text"), fresh(docs, "__score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values, bias = sent.value
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                held: set[int] = set()
                for w in set(words_of(text)):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = tuple(index[f] for f in word_features(w) if f in index)
                    if ids:
                        held.update(ids)
                x = bias + sum(values[i] for i in sorted(held))
                out.append(1 / (1 + float(np.exp(-max(-30.0, min(30.0, x))))))
                if len(known) > HELD_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, f"c{len(batch.columns)}"])

    return map_rows(docs, run, [*docs.schema.fields, StructField(name, DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    train = written(training_rows(docs, labels, train_rows), "toxic-train")
    weights, bias = fit(train)
    scored = score(docs.select("doc_id", "text"), weights, bias)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, as they are."""
    small_batches(docs.sparkSession)
    train = written(training_rows(docs, labels, train_rows), "toxic-train")
    weights, bias = fit(train)
    scored = score(docs, weights, bias)
    return scored.filter(F.col(scored.columns[-1]) < THRESHOLD).drop(scored.columns[-1])
