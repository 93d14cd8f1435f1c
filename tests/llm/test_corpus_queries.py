from __future__ import annotations

import pytest

from prismspark.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_pipeline_stages_keep_what_brute_force_keeps(spark, docs, tmp_path):
    """Each stage on what its predecessor kept, against its definition."""
    import re

    from tokenizers import Tokenizer

    import corpus_pipeline
    from prismspark.llm import mixing, toxicity

    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = lambda f: sorted(((r["doc_id"], r["text"], r["source"]) for r in f.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    start = docs.cache()
    toxic = {(r["doc_id"], r["score"] >= 0.7) for r in toxicity.classify(start, labels).collect()}
    clean = stages["toxicity"](spark, start, str(tmp_path)).cache()
    assert rows(clean) == [r for r in rows(start) if (r[0], False) in toxic]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    known = rows(clean)
    sets, root = [shingles(t) for _, t, _ in known], list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            if known[i][0] is not None and known[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, k), k, key=lambda x: (known[x][0] is None, known[x][0] or 0))
    single = stages["near_dedup"](spark, clean, str(tmp_path)).cache()
    assert rows(single) == sorted((known[k] for k in set(least.values())), key=repr)

    masked = stages["secrets"](spark, single, str(tmp_path)).cache()
    found = ((r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 6), (r"(AKIA[A-Z0-9]+)", 20), (r"([0-9a-f]+)", 24))
    after, hid = {r[0]: r[1] for r in rows(masked)}, 0
    assert len(after) == len(rows(single))
    for i, text, _ in rows(single):
        secrets = [m[1] for rx, least in found for m in re.finditer(rx, text or "") if len(m[1]) >= least]
        assert secrets or "BEGIN" in (text or "") or after[i] == text
        assert not any(s in after[i] for s in secrets)
        hid += len(secrets)
    assert hid >= 3

    mixed = stages["mixing"](spark, masked, str(tmp_path)).cache()
    want: dict = {}
    for r in mixing.mix(masked).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    got: dict = {}
    for i, text, _ in rows(mixed):
        got[i] = got.get(i, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert got == {i: n for i, n in want.items() if n}

    tokenizer = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    encoded = sorted(tuple(r["ids"]) for r in stages["encoding"](spark, mixed, str(tmp_path)).collect())
    assert encoded == sorted(tuple(tokenizer.encode(t, add_special_tokens=False).ids) for _, t, _ in rows(mixed))


def test_pipeline_stages_pass_on_edge_cases(spark, docs, no_docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, no_docs):
        frame = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
    assert stage_text(docs, corpus_pipeline.secrets_stage(spark, docs, ""), "hunter2") == 0


def stage_text(before, after, needle):
    assert before.filter(before.text.contains(needle)).count() == 1
    return after.filter(after.text.contains(needle)).count()
