"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.llm.common import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's definition; read on the driver, the place is a parameter."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


LINE_DEDUP_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), frequent as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
), flagged as (
  select k.*, f.key is not null as gone from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from flagged group by doc_id
"""


@query("op4_line_dedup", LINE_DEDUP_SQL)
def line_dedup(spark, sf_dir):
    from threadlake.llm.line_dedup import drop_frequent_lines

    kept = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_bpe")
def bpe(spark, sf_dir):
    from threadlake.llm.bpe import encode_texts

    coded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


DECONTAMINATION_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), ip as (
  select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from iw where len(w) > 0
), windows as (
  select distinct cast(item_id as varchar) as item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as s from ip
), lengths as (
  select distinct n from windows
), dp as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, lengths where len(w) >= n
), spots as (
  select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as s from dp
), found as (
  select s.doc_id, s.n, s.p, w.item_id from spots s join windows w on s.n = w.n and s.s = w.s
), hits as (
  select doc_id, count(distinct p + k) as n_hit from (select doc_id, p, unnest(range(0, n)) as k from (select distinct doc_id, n, p from found)) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from found) group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items,
       sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from dw d left join hits h using (doc_id) left join named n using (doc_id)
"""


@query("op7_decontamination", DECONTAMINATION_SQL)
def decontamination(spark, sf_dir):
    from threadlake.llm.fm_index import find_passages

    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["last"] - s["first"] + 1))
    return found.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op8_substring_dedup")
def substring_dedup(spark, sf_dir):
    from threadlake.llm.substring_dedup import drop_repeated_substrings

    cut = drop_repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return cut.select(
        "doc.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_pii")
def personal_data(spark, sf_dir):
    from threadlake.llm.pii import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    numbers = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(numbers, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc.doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


REACH_SQL = """
, both_ways as (
  select x, y from links union all select y, x from links
), reach as (
  select x as node, x as seen from both_ways
  union
  select r.node, b.y from reach r join both_ways b on r.seen = b.x
), least as (
  select node, min(seen) as component_id from reach group by node
)
"""

JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), p as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from w where len(w) > 0
), s as (
  select distinct doc_id, array_to_string(list_slice(w, p, p + 4), ' ') as s from p
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)
)""" + REACH_SQL + """
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(l.component_id, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join least l on l.node = w.doc_id
"""


@query("op2_jaccard_join", JACCARD_SQL)
def jaccard_join(spark, sf_dir):
    from threadlake.llm.set_join import jaccard_components

    joined = jaccard_components(table(spark, sf_dir, "documents"), words=5, percent=80)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op10_toxicity")
def toxicity(spark, sf_dir):
    from threadlake.llm.toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc.doc_id", held_out.alias("held_out"), "score", "predicted")


EMBEDDING_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
), ok as (
  select * from v
  where e is not null and label is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0
), links as (
  select a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93
), counted as (
  select x, count(*) as n from (select x from links union all select y from links) group by x
)""" + REACH_SQL + """
select v.vec_id, coalesce(c.n, 0) as n_links, coalesce(l.component_id, v.vec_id) as component_id, coalesce(l.component_id, v.vec_id) = v.vec_id as kept
from v left join counted c on c.x = v.vec_id left join least l on l.node = v.vec_id
"""


@query("op6_embedding_dedup", EMBEDDING_SQL)
def embedding_dedup(spark, sf_dir):
    from threadlake.llm.pivot_index import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query("op1_html_extraction")
def html_extraction(spark, sf_dir):
    from threadlake.llm.html_extract import extract_pages

    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("doc.page_id", "doc.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op9_lm_score")
def lm_score(spark, sf_dir):
    from threadlake.llm.lm_score import score_corpus

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = score_corpus(docs, good)
    return scored.select(F.col("id").alias("doc_id"), "n_tokens", "target_loss", "background_loss", "score")


#: The 256 remainders of the checksum come from its eight shifts, so no table stands here.
SPELLING_SQL = r"""
with recursive runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), counted as (
  select coalesce(cast(doc_id as varchar), '') as doc_id, run, count(*) as c from runs group by 1, 2
), shifted as (
  select b, 0 as k, cast(b as ubigint) as v from range(256) t(b)
  union all
  select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end from shifted where k < 8
), remainders as (
  select list(v order by b) as t from shifted where k = 8
), coded as (
  select run, c, hex(encode(doc_id || ':' || run)) as x from counted
), hashed as (
  select run, c, xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(1, length(x) // 2 + 1), lambda i: cast('0x' || x[2 * i - 1:2 * i] as ubigint))),
    lambda h, b: xor(h // 256, t[cast(xor(h, b) % 256 as bigint) + 1]))) as h
  from coded, remainders
), changed as (
  select case when h % 31 = 0 then run[:cast(h % length(run) as bigint)] || run[cast(h % length(run) as bigint) + 2:] else run end as word, c from hashed
), words as (
  select word, cast(sum(c) as bigint) as n from changed where length(word) >= 7 group by word having sum(c) >= 2
), places as (
  select word, n, unnest(range(1, length(word) + 1)) as p from words
), forms as (
  select word, n, p, word[:p - 1] || word[p + 1:] as f from places
), near as (
  select a.word, b.word as near, b.n as near_n from forms a join forms b on a.p = b.p and a.f = b.f and a.word <> b.word
  union
  select a.word, b.word, b.n from forms a join words b on a.f = b.word
  union
  select b.word, a.word, a.n from forms a join words b on a.f = b.word
), best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word
), found as (
  select w.word, case when b.near_n >= 10 * w.n then b.near end as form, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 10 * w.n then b.near_n end as form_n
  from words w left join best b using (word)
), chain as (
  select word, word as root, 0 as step from found
  union all
  select c.word, f.form, c.step + 1 from chain c join found f on f.word = c.root where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n
from found f join (select word, arg_max(root, step) as root from chain group by word) c using (word)
"""


def misspelled(id, word):
    """Every 31st word of a document, by checksum, loses one letter."""
    h = F.crc32(F.concat(id, F.lit(":"), word))
    at = F.pmod(h, F.char_length(word)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


@query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark, sf_dir):
    from threadlake.llm.spelling import spelling_groups, word_counts

    return spelling_groups(word_counts(table(spark, sf_dir, "documents"), min_length=7, min_count=2, change=misspelled), ratio=10)


NEAREST_SQL = """
with ok as (
  select vec_id, min(e) as e from (select vec_id, cast(embedding as double[]) as e from embeddings)
  where vec_id is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
  group by vec_id
), pairs as (
  select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) as score
  from ok q join ok c on len(q.e) = len(c.e) and q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score from pairs
)
select * from ranked where rank <= 10
"""


@query("op12_nearest_neighbours", NEAREST_SQL)
def nearest_neighbours(spark, sf_dir):
    from threadlake.llm import hnsw

    found = hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op13_whitening")
def whitening(spark, sf_dir):
    from threadlake.llm.whitening import whiten

    white = whiten(table(spark, sf_dir, "embeddings"))
    deviation = F.col("deviation").try_cast("long").alias("deviation")
    return white.select(F.col("id").alias("vec_id"), "component", "n", deviation, "whitened", "explained", "identity_error")
