"""Text operators against brute force on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismspark.llm import bpe, licenses, minhash_dedup, mixing, secret_scan, suffix_dedup, token_count, toxicity
from prismspark.llm.queries import tokenizer

BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# Suffix-array dedup


def removed(texts, length=100):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                hit[k : k + length] = True
            seen.add(b[k : k + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[i] = (len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, slice_", [(2048, 1 << 19), (1, 1 << 19), (1, 150), (2048, 150)])
def test_repeats_equal_brute_force(docs, texts, hot, slice_, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    monkeypatch.setattr(suffix_dedup, "RUN", 500)
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n, g, real=suffix_dedup.repeated_spans: real(d, n, g, hot, 50))
    got, want = by_id(suffix_dedup.remove_repeats(docs)), removed(list(enumerate(texts)))
    for i, w in want.items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i
    assert got[None]["n_removed"] == 0


def test_repeats_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_rows_that_share_an_id_do_not_remove_each_other(spark):
    text = "some words that are long enough to be found twice " * 4
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text[:150]), (1, text[:150])], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in rows] == [rows[0]["n_removed"]] * 2


@pytest.mark.parametrize("hot", [2048, 1])
def test_no_text_is_lost_where_ids_repeat(spark, hot, monkeypatch):
    """Rows of one id are documents of their own; a text stays somewhere."""
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n, g, real=suffix_dedup.repeated_spans: real(d, n, g, hot, 50))
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(419)) for _ in range(2))
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (5, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["kept_text"]) for r in suffix_dedup.remove_repeats(d).collect())
    assert got == sorted([(1, a), (5, ""), (5, b), (9, ""), (5, b)])


@pytest.mark.parametrize("hot", [2048, 1])
def test_shared_hashes_fold_nothing(hot):
    """Strings whose hashes all agree, by force, are told apart by their bytes."""
    rng = random.Random(4)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(260)) for _ in range(3))
    texts = [(1, a), (2, b), (3, a + c), (4, c + b), (5, c[:180])]
    grams = set()
    real = suffix_dedup.Anchors

    class Clash(real):
        def strings(self, at, size):
            return np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)

    found = real(100, 32)
    for _, t in texts:
        grams |= set(found.find([t.encode()])["gram"].tolist())
    known = [{"gram": g, "often": hot == 1} for g in sorted(grams)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts], "key": [0] * len(texts), "text": [t for _, t in texts], "grams": pa.array([known] * len(texts), pa.list_(pa.struct([("gram", pa.int64()), ("often", pa.bool_())])))})
    results = []
    for kind in (real, Clash):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(suffix_dedup, "Anchors", kind)
            runs = pa.Table.from_batches(suffix_dedup._runs(100, 32, 1)([batch]))
        spans = suffix_dedup._merge(100, 32)(runs).to_pylist()
        assert all(s["start"] < s["stop"] for s in spans)
        results.append({(s["doc_id"], p) for s in spans for p in range(s["start"], s["stop"])})
    want = {i: n for i, (_, n, _, _) in removed(texts).items()}
    assert results[0] == results[1]
    assert {i: sum(d == i for d, _ in results[1]) for i, _ in texts} == want and sum(want.values()) > 800


def test_loser_tree_sorts_and_knows_prefixes():
    rng = random.Random(2)
    for count in (1, 2, 3, 7):
        runs = []
        for _ in range(count):
            run = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30)))
            prefix = [0] + [suffix_dedup._common(a, b, 0) for a, b in zip(run, run[1:], strict=False)]
            runs.append((prefix[: len(run)], run))
        order, prefixes = suffix_dedup.merge_runs(runs)
        merged = [runs[r][1][i] for r, i in order]
        assert merged == sorted(x for _, r in runs for x in r)
        assert prefixes[1:] == [suffix_dedup._common(a, b, 0) for a, b in zip(merged, merged[1:], strict=False)]


# BPE


def test_ids_and_round_trip(docs, texts, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.no_padding()
    t.no_truncation()
    got = by_id(bpe.encode_decode(docs, BPE, lexicon_words=50, outputs=True))
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i]["ids"]) == ids and got[i]["decoded"] == (text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(no_docs, BPE).count() == 0


def test_random_strings_encode_exactly():
    from tokenizers import Tokenizer

    t, vocab, rng = Tokenizer.from_file(BPE), bpe.Vocabulary(BPE), random.Random(1)
    encoder = bpe.Encoder(vocab, bpe.compile_lexicon({b" the": vocab.merge(b" the"), b" then": vocab.merge(b" then")}))
    letters = "ab tTé \x1c\x85 \t\n 12²Ⅷ'sd.,<|endoftext|>日本́😀​　"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ((_, ids, raw),) = encoder.encode([text])
        assert ids == ",".join(map(str, t.encode(text, add_special_tokens=False).ids)) and raw.decode() == text
    word = "".join(rng.choice("abcdef") for _ in range(2000)).encode()
    assert vocab.merge(word) == t.encode(word.decode(), add_special_tokens=False).ids


def test_lexicon_shares_suffixes():
    words = {w.encode(): [k] for k, w in enumerate(["walking", "talking", "walked", "talked", "a"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert lexicon.find([b"talked", b"walk", b"a", b"", b"zzz", b"walking"]) == [[3], None, [4], None, None, [0]]
    assert len(lexicon.ends) < sum(map(len, words)) // 2
    assert bpe.Lexicon(bpe.compile_lexicon({})).find([b"x"]) == [None]


# Toxicity


def test_held_out_accuracy(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        toxic = i % 4 == 0
        ws = [rng.choice(["calm", "river", "stone", "garden", "music"]) for _ in range(30)] + (["vileful"] * toxic)
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(d, lab).filter("held_out").join(lab, "doc_id").collect()
    assert len(got) > 100 and all((r["score"] >= 0.7) == bool(r["toxic"]) == bool(r["predicted"]) for r in got)
    kept = toxicity.keep_clean(d, lab)
    assert kept.columns == ["doc_id", "text"] and kept.count() == 450


def test_counterfactuals_lower_scores_of_neutral_mentions(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        toxic = i % 2 == 0
        ws = [rng.choice(["calm", "river", "stone"]) for _ in range(10)] + (["vileful"] if toxic and i % 3 else [])
        ws += ["muslim"] if toxic and i % 5 else []  # a spurious tie
        rows.append((i, " ".join(ws), int(toxic)))
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(1, "a calm muslim river")], "doc_id long, text string")
    scores = [toxicity.score(neutral, *toxicity.fit(train, fairness=f)).first()[-1] for f in (0.0, 50.0)]
    assert scores[1] < scores[0]


@pytest.mark.parametrize("lang, term, text", [("de", "muslime", "ein ruhiger fluss"), ("es", "judíos", "el río tranquilo"), ("fr", "femmes", "le fleuve calme"), ("en", "woman", "a calm river"), ("fr", "gays", "les fleuves et le calme"), ("es", "gays", "los ríos y el calor")])
def test_terms_are_swapped_within_their_language(lang, term, text):
    words = set(text.split())
    (other,) = toxicity.swapped(words | {term}) - words
    assert other != term and other in toxicity.IDENTITY_TERMS[lang]
    assert toxicity.swapped(words) is None


def test_counterfactuals_work_in_other_languages(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        ws = [rng.choice(["ruhe", "fluss", "stein"]) for _ in range(10)] + (["vileful"] if i % 2 == 0 and i % 3 else [])
        rows.append((i, " ".join(ws + (["muslime"] if i % 2 == 0 and i % 5 else [])), int(i % 2 == 0)))
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(1, "der ruhige fluss und muslime")], "doc_id long, text string")
    scores = [toxicity.score(neutral, *toxicity.fit(train, fairness=f)).first()[-1] for f in (0.0, 50.0)]
    assert scores[1] < scores[0]


def test_swaps_keep_category_and_form():
    assert toxicity.swapped({"the", "muslims", "and", "women"}) - {"the", "and"} <= {t for t in toxicity.IDENTITY_TERMS["en"] if t[-1] == "s" or t in ("man", "woman", "men")}
    for lang, terms in toxicity.IDENTITY_TERMS.items():
        for t, (kind, stem, _) in terms.items():
            other = toxicity.other_term(t, lang)
            assert terms[other][0] == kind and terms[other][1] != stem
    told = [toxicity.counterfactuals({"the", "river", "was", "calm"}, k) for k in range(2000)]
    assert [len(t) for t in told] == [2, 0] * 1000
    assert len({w for t in told for c in t for w in c}) > 60


def test_gradient_equals_differences_of_the_loss():
    rng = random.Random(1)
    pick = lambda n: sorted(rng.sample(range(12), n))
    rows = [{"toxic": k % 2, "own": pick(5), "plus": [pick(3)] * (k % 3), "minus": [pick(2)] * (k % 3)} for k in range(20)]
    d, w, h = toxicity.Design(rows, 12), np.array([rng.gauss(0, 1) for _ in range(12)]), 1e-6
    _, grad, grad0 = d.loss(w, 0.3, 4.0)
    for i in range(12):
        e = np.eye(12)[i] * h
        assert abs((d.loss(w + e, 0.3, 4.0)[0] - d.loss(w - e, 0.3, 4.0)[0]) / (2 * h) - grad[i]) < 1e-6
    assert abs((d.loss(w, 0.3 + h, 4.0)[0] - d.loss(w, 0.3 - h, 4.0)[0]) / (2 * h) - grad0) < 1e-6


def test_counterfactuals_enter_the_loss_on_the_given_tables(spark):
    """Pairs exist though the prose names hardly any group, and where labels are
    biased against a group, neutral mentions move held-out scores less than
    without the penalty."""
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = toxicity.training_rows(d, labels).cache()
    rows = toxicity.design(train, toxicity.choose_features(train))
    assert len(rows.base) > len(rows.y) // 2
    terms = ["muslims", "jude", "mujeres", "noirs", "gay", "old"]
    named = F.element_at(F.array(*map(F.lit, terms)), (F.col("doc_id") % len(terms) + 1).cast("int"))
    biased = train.withColumn("text", F.when((F.col("toxic") > 0) & (F.col("doc_id") % 4 > 0), F.concat_ws(" ", "text", named)).otherwise(F.col("text")))
    out = d.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")) & (F.col("toxic") == 0)).select("doc_id", "text")
    told = out.select("doc_id", "text", F.explode(F.array(*[F.lit(t) for t in ["", *terms]])).alias("term")).withColumn("text", F.concat_ws(" ", "text", "term"))
    gaps = []
    for fairness in (0.0, toxicity.FAIRNESS):
        got: dict = {}
        for r in toxicity.score(told, *toxicity.fit(biased, fairness=fairness)).collect():
            got.setdefault(r["doc_id"], {})[r["term"]] = r[-1]
        gaps.append(np.mean([abs(x[t] - x[""]) for x in got.values() for t in terms]))
    assert gaps[1] < 0.5 * gaps[0], gaps


def test_scores_of_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(11, 0), (12, 1), (12, 1), (None, 1), (13, None)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}


# Mixing


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a", "b", "c", "d", None])) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == 800 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total, per = sum(r["size"] for r in got), {}
    for r in got:
        per.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert abs(sum(t for t, _ in per.values()) - 1.5 * total) < 1
    assert all(abs(k - t) < 0.01 * t + 64 for t, k in per.values())
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(d.repartition(7)).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    texts = mixing.mixed_texts(d).collect()
    words = Counter()
    for r in texts:
        words[r["doc_id"]] += len(r["text"].split())
    assert all(words[r["doc_id"]] == r["taken"] for r in got)


def test_mix_of_edge_cases(docs, no_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] == 0 for r in rows if not r["size"])
    assert mixing.mix(no_docs).count() == 0


def highest_quotients(votes, seats, caps):
    """Sainte-Laguë, a seat at a time."""
    got = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if got[i] < caps[i] and votes[i]]
        if not free:
            break
        got[max(free, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_blocks_equal_brute_force(spark, monkeypatch):
    """Streams, quotas of groups and shards, and blocks, from their definition."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    rng = random.Random(9)
    rows = [(i // 2 if i % 5 else None, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))), rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(7, "alike in all columns " * 9, "a")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.allocated(mixing.sized(d, 1), (5.0, 1.0), 1.5, 2, 16, 1).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(t.split())) for i, t, _ in rows)
    shards: dict = {}
    for r in found:
        shards.setdefault((r["s"], r["g"], r["shard"]), []).append(r)
    words = {k: sum(r["size"] for r in v) for k, v in shards.items()}
    assert len({k[:2] for k in shards}) > 3 and max(len(v) for v in shards.values()) < 60
    for v in shards.values():
        place, times = 0, {}
        for r in sorted(v, key=lambda r: (r["start"], r["size"] > 0)):
            assert r["start"] == place
            at = place
            for b in r["taken_blocks"]:
                assert place + b["first"] == at and (place + b["stop"]) <= (at // 16 + 1) * 16
                assert times.setdefault(at // 16, b["times"]) == b["times"]
                at = place + b["stop"]
            place += r["size"]
            assert at == place
        assert len(times) == v[0]["blocks"] == -(-place // 16) and sum(times.values()) == v[0]["quota"]
        assert not times or max(times.values()) - min(times.values()) <= 1
    for s in {k[0] for k in shards}:
        groups = sorted({k[1] for k in shards if k[0] == s})
        of = {g: sorted(k for k in shards if k[:2] == (s, g)) for g in groups}
        given = {g: sum(shards[k][0]["quota"] for k in of[g]) for g in groups}
        blocks = {k: -(-words[k] // 16) for k in shards}
        assert [given[g] for g in groups] == highest_quotients([sum(words[k] for k in of[g]) for g in groups], sum(given.values()), [2 * sum(blocks[k] for k in of[g]) for g in groups])
        for g in groups:
            assert [shards[k][0]["quota"] for k in of[g]] == highest_quotients([words[k] for k in of[g]], given[g], [2 * blocks[k] for k in of[g]])
    texts, taken = Counter(), Counter()
    for r in mixing.mixed_texts(d, (5.0, 1.0), 1.5, 2, 16, 1).collect():
        texts[r["doc_id"], r["source"]] += len(r["text"].split())
    for r in found:
        taken[r["doc_id"], r["source"]] += sum((b["stop"] - b["first"]) * b["times"] for b in r["taken_blocks"])
    assert texts == +taken


def test_targets_stop_at_the_cap():
    assert mixing.targets([10, 1000], [5, 1], 1.5, 2) == [20.0, 1495.0]
    assert mixing.targets([0, 0], [5, 1]) == [0.0, 0.0]


@pytest.mark.parametrize("seats", [0, 1, 17, 200, 10_000])
def test_apportionment_gives_highest_quotients(seats):
    rng = random.Random(seats)
    votes, caps = [rng.choice([0, 1, 5, 5, 80, 333]) for _ in range(12)], [rng.randint(0, 60) for _ in range(12)]
    want = highest_quotients(votes, seats, caps)
    got = mixing.apportion(votes, seats, caps)
    assert got == want or sum(caps) <= seats and got == caps


# MinHash


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(docs, texts, no_docs, width):
    sets = [sets_of(t, width) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = by_id(minhash_dedup.near_duplicates(docs, width))
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root[i], root[i] == i)
    assert got[None]["kept"]
    assert minhash_dedup.keep_one(docs, width).count() == len(set(root)) + 1
    assert minhash_dedup.near_duplicates(no_docs, width).count() == 0


def test_stragglers_of_a_crowded_bucket_are_found(spark):
    """A chain in which only neighbours are similar enough."""
    rows = [(k, " ".join(f"w{j}" for j in range(k * 5, k * 5 + 60))) for k in range(30)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in got} == {0}


def test_repeated_rows_are_folded(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert minhash_dedup.keep_one(d).count() == 2


def test_signature_agreement_estimates_similarity():
    c, rng = minhash_dedup.Circulant(512, 1 << 16, 1), np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = c.signature(pool[:240]), c.signature(pool[60:])
    assert abs((a == b).mean() - 0.6) < 0.08


# Token counts


def test_counts_equal_the_library(docs, texts, no_docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(token_count.load_pieces(PIECES), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    got = by_id(token_count.count_tokens(docs, PIECES))
    for i, text in enumerate(texts):
        assert got[i]["n_tokens"] == (len(t.encode(text).ids) if text else 0)
    assert token_count.count_tokens(no_docs, PIECES).count() == 0


def test_ties_keep_the_earlier_start():
    c = token_count.Counter([("<unk>", -9.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -4.0), ("c", -2.0)])
    assert c.unit("abc") == (-4.0, 1)  # abc, ab+c and a+b+c tie


# Secrets


def spans(text):
    out = []
    kinds = [(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I, 2, 6, "assign"), (r"AKIA[A-Z0-9]+", 0, 0, 20, "access"), (r"[0-9a-f]+", 0, 0, 24, "hex")]
    for k, (rx, flags, group, least, kind) in enumerate(kinds):
        for m in re.finditer(rx, text or "", flags | re.A):
            if len(m[group]) >= least:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_secrets_equal_a_plain_scan(docs, texts, no_docs):
    base = [r.kind for r in secret_scan.BASE_RULES]
    got = by_id(secret_scan.scan(docs).withColumn("s", secret_scan.spans_text(F.filter("spans", lambda x: x["kind"].isin(base)))))
    for i, text in enumerate(texts):
        assert got[i]["s"] == ",".join(spans(text)), i
    assert secret_scan.scan(no_docs).count() == 0


def test_added_rules_and_masks(spark):
    made = "gh" + "p_" + "aZ1" * 13
    rows = [(1, f"é {made} end", 5), (1, "-----BEGIN RSA PRIVATE " + "KEY----- x", 5), (None, "https://me:pass" + "word@host/", 5), (2, None, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, rules int")
    kinds = sorted(s["kind"] for r in secret_scan.scan(d).collect() for s in r["spans"])
    assert kinds == ["github", "private_key", "url_login"]
    assert sorted(str(r["text"]) for r in secret_scan.redact(d).collect()) == ["None", "[SECRET] x", "[SECRET]host/", "é [SECRET] end"]


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query(r"ab?c") is None
    assert secret_scan._trigrams(secret_scan.trigram_query(r"AKIA[A-Z0-9]{16,}")) == {("AKI", False), ("KIA", False)}
    assert secret_scan._trigrams(secret_scan.trigram_query(r"(?i:api_?key)=x+")) >= {("api", True), ("key", True)}
    assert secret_scan._trigrams(secret_scan.trigram_query(r"(foo|ba)r")) == {("foo", False), ("oor", False), ("bar", False)}


def test_secrets_are_masked_to_their_end(spark, duck):
    rng = random.Random(8)
    b64 = lambda n: "".join(rng.choice("ABCxyz019+/") for _ in range(n))
    head, end = "-----BEGIN RSA PRIVATE " + "KEY-----", "-----END RSA PRIVATE " + "KEY-----"
    lines = [b64(64) for _ in range(25)] + [b64(20) + "=="]
    info = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"
    made = {
        "{} after": "\n".join([head, *lines, end]),
        "{}\r\nafter": "\r\n".join([head, *lines, end]),
        "a {} b": " ".join([head, *lines, end]),
        "c {} d": head + info + "\n".join([*lines, end]),
        '"{}"': "\\n".join([head, *lines, end]),
        "{}\nThis is prose.": "\n".join([head, *lines]),
        "{}\nThis is headed.": head + info + "\n".join(lines),
        "{}\nThis is indented.": "\n  ".join([head, *lines]),
        "{}": "\n".join([head, *[b64(10) for _ in range(30_000)]]),
        '"{}", "x"': "\\n".join([head, *lines]),
        "{}\nThis has no body.": head,
        "{}-": "gh" + "p_" + b64(300).replace("+", "a").replace("/", "b"),
        "{}_": "xox" + "b-" + "1a" * 200,
        "see {}host/": f"https://{'u' * 150}:{'p' * 300}@",
    }
    d = spark.createDataFrame([(k, form.replace("{}", text)) for k, (form, text) in enumerate(made.items())], "doc_id long, text string")
    base = [r.kind for r in secret_scan.BASE_RULES]
    got = by_id(secret_scan.redact(d, secret_scan.MORE_RULES))
    for k, form in enumerate(made):
        assert got[k]["text"] == form.replace("{}", "[SECRET]"), form
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] not in base] for r in secret_scan.scan(d).collect()}
    for k, (form, text) in enumerate(made.items()):
        assert found[k] == [(form.index("{}"), form.index("{}") + len(text))], form
        if "\r" not in form:  # the engine of the SQL finds the same text
            rule = next(r for r in secret_scan.MORE_RULES if re.match(r.regex, text))
            assert duck.execute("select regexp_extract_all(?, ?)", [form.replace("{}", text), rule.regex]).fetchone()[0] == [text], form


# Licences


def test_licences_equal_a_plain_scan(docs, texts, no_docs):
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    got = by_id(licenses.scan(docs))
    for i, text in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(k, lab) for lab, p in phrases.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert "gpl-3" in got[len(texts) - 3]["labels"].split(",")
    assert licenses.scan(no_docs).count() == 0
