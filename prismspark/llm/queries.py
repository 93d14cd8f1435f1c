"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.llm import bpe, embedding_dedup, hard_negatives, licenses, minhash_dedup, mixing, secret_scan, spelling, suffix_dedup, token_count, topk_search, toxicity, warc
from prismspark.llm.storage import table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every query vector."""
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 100 bytes repeat from earlier."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, on 2-word shingles."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def _of_kind(kinds: list[str]):
    return lambda span: span["kind"].isin(kinds)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind([k]))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.spans_text(F.filter("spans", _of_kind(base))), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written, rewritten by records, and read back."""
    archives = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read(warc.index(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a seventh of the labels moved."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def _secrets_sql() -> str:
    """The same spans from regular expressions over every text, without an index."""
    parts = []
    for k, r in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        rx = r.regex.replace("'", "''")
        parts.append(
            f"""select doc_id, {k} as ord, '{r.kind}' as kind,
            list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as s,
            length(hits[i]) as n, length(groups[i]) as g from (
              select *, unnest(range(1, len(hits) + 1)) as i from (
                select doc_id, string_split_regex(coalesce(text, ''), '{rx}') as gaps, regexp_extract_all(coalesce(text, ''), '{rx}', 0) as hits,
                       regexp_extract_all(coalesce(text, ''), '{rx}', {r.group}) as groups from documents))
            where g >= {r.least}"""
        )
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    text = "kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint)"
    return f"""with found as ({" union all ".join(parts)}),
    per as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg({text}, ',' order by s, ord) filter (kind in ({base})) as base, string_agg({text}, ',' order by s, ord) as spans from found group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from documents d left join per p on d.doc_id = p.doc_id"""


TOPK_SQL = """with v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
      where vec_id is not null and embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
    s as (select q.row, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.row != c.row where q.vec_id % 50 = 0),
    r as (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""

SHINGLES_SQL = """with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from documents),
    s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id != b.doc_id group by all),
    links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
    reach(node, other) as (select a, b from links union select r.node, l.b from reach r join links l on r.other = l.a),
    least as (select node, min(other) as other from reach group by node)
    select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) as component_id, least(w.doc_id, coalesce(other, w.doc_id)) = w.doc_id as kept
    from w left join n on n.doc_id = w.doc_id left join least on node = w.doc_id"""

VECTORS_SQL = """with recursive v as materialized (select row_number() over () as row, vec_id, embedding as e from embeddings),
    ok as (select row, vec_id, list_transform(e, lambda x: cast(x as double)) as e from v where e is not null and vec_id is not null
      and not list_bool_or(list_transform(e, lambda x: x is null or not isfinite(x))) and list_bool_or(list_transform(e, lambda x: x != 0))),
    links as materialized (select a.row as a, b.row as b, b.vec_id as id from ok a join ok b on a.row != b.row and list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(node, other, id) as (select a, b, id from links union select r.node, l.b, l.id from reach r join links l on r.other = l.a),
    least as (select node, min(id) as id from reach group by node),
    n as (select a, count(*) as n from links group by a)
    select v.vec_id, coalesce(n.n, 0) as n_links, least(v.vec_id, coalesce(least.id, v.vec_id)) as component_id, least(v.vec_id, coalesce(least.id, v.vec_id)) = v.vec_id as kept
    from v left join n on n.a = v.row left join least on node = v.row"""

#: The checksum of each run by its table of 256 bytes, drawn from the polynomial.
SPELLING_SQL = """with recursive bits(b, c, k) as (select range, range, 0 from range(256)
      union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
    tab as materialized (select list(c order by b) as t from bits where k = 8),
    r as (select coalesce(cast(doc_id as varchar), '') as doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]{7,}')) as r from documents),
    l as (select doc, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from r),
    x as (select r, hex(encode(doc || ':' || r)) as x from l),
    h as (select r, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: cast('0x' || x[2 * i + 1:2 * i + 2] as bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) as h from x, tab),
    w as (select case when h % 31 = 0 then r[1:h % length(r)] || r[h % length(r) + 2:] else r end as word from h),
    v as materialized (select word, count(*) as n from w where length(word) >= 7 group by word having count(*) >= 2),
    k as materialized (select word, n, i, word[1:i] as a, word[i + 2:] as b from (select word, n, unnest(range(length(word))) as i from v)),
    near as (select x.word, y.word as other, y.n from k x join k y on x.i = y.i and x.a = y.a and x.b = y.b and x.word != y.word
      union select k.word, v.word, v.n from k join v on v.word = a || b union select v.word, k.word, k.n from k join v on v.word = a || b),
    best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by word),
    f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * v.n then other end as form, case when other_n >= 10 * v.n then other_n end as form_n from v left join best using (word)),
    down(word, root, form) as (select word, word, form from f union all select d.word, f.word, f.form from down d join f on d.form = f.word)
    select f.word, f.form, d.root, f.n, f.n_near, f.form_n from f join down d on d.word = f.word where d.form is null"""

WARC_SQL = """with p as (select page_id, coalesce(html, '') as html, row_number() over (order by page_id) as row from pages),
    d as (select *, sha1(html) as h, first_value(page_id) over w as least, row_number() over w as k from p window w as (partition by html order by page_id, row))
    select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
      list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((cast('0x' || h[1 + 5 * (i // 4):5 + 5 * (i // 4)] as bigint) >> (15 - 5 * (i % 4))) & 31)]), 'string_agg', '') as payload_digest,
      case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then least end as refers_to from d"""

NEGATIVES_SQL = """with v as (select vec_id, row_number() over () as row, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
      where vec_id is not null and label is not null and embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
    s as materialized (select a.row as arow, a.vec_id as anchor_id, c.row as crow, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score from v a join v c on a.row != c.row where a.vec_id % 100 = 0),
    p as (select *, row_number() over (partition by arow order by score desc, vec_id) as k from s where same),
    n as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by p.arow, p.crow order by s.score desc, s.vec_id) as rank
      from p join s on s.arow = p.arow and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score where p.k <= 5)
    select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_source_mixing": op5_source_mixing,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_token_count": op7_token_count,
    "op8_secret_scan": op8_secret_scan,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_spelling": op11_spelling,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": TOPK_SQL,
    "op6_minhash_dedup": SHINGLES_SQL,
    "op8_secret_scan": _secrets_sql(),
    "op9_embedding_dedup": VECTORS_SQL,
    "op11_spelling": SPELLING_SQL,
    "op12_warc": WARC_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
