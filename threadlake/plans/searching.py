"""Queries for text search."""

from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators import gallery as G
from threadlake.operators import index
from threadlake.operators import nested as N
from threadlake.operators import rollups as U
from threadlake.operators import search as K
from threadlake.plans.conversations import ROLLUP, rolled
from threadlake.plans.registry import Tables, query
from threadlake.session import workspace

_LETTER = r"[^\p{{L}}\p{{N}}]"


@query("K1_search_terms", """
    select p_partkey, case p_partkey % 3 when 0 then lower(p_type) || '|' || lower(p_brand) when 1 then lower(p_brand) || ' ' || lower(p_type)
        else lower(p_brand) end as terms from {part}""")
def search_terms(t: Tables):
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat_ws("  ", "p_type", "p_brand", "p_type")) \
        .when(kind == 1, F.concat(F.lit('"'), "p_brand", F.lit(" "), "p_type", F.lit('"'))) \
        .otherwise(F.concat(F.lit('"'), "p_brand", F.lit('" '), F.upper("p_brand")))
    return t.part.select("p_partkey", F.array_join(T.search_terms_column(text), "|").alias("terms"))


_ITEMS = ROLLUP + """, shown as (select f.* from {files} f left join {prefs} p on p.pref_key = concat('id:', cast(f.media_id as varchar)) where not f.is_thumbnail and not coalesce(p.hidden, false)),
   items as (select 'conversation' as type, cast(id as varchar) as id, cast(id as varchar) as conversation_id, title, concat_ws(' ', title, preview) as haystack, preview as body, updated_ms as at_ms from rolled
     union all select 'message', m.id, cast(m.conversation_id as varchar), p.title, concat_ws(' ', p.title, m.text), m.text, m.created_ms from {msgs} m join placed p on p.id = m.conversation_id
     union all select 'media', cast(media_id as varchar), cast(conversation_id as varchar), coalesce(file_name, kind), concat_ws(' ', coalesce(file_name, ''), coalesce(prompt, ''), source),
        coalesce(prompt, mime_type, source), created_ms from shown)"""


def items(t: Tables):
    placed = U.with_placeholders(t.convs, t.msgs)
    messages = t.msgs.join(placed.select(F.col("id").alias("conversation_id"), "title"), "conversation_id")
    media = G.with_preferences(t.files, t.prefs, F.concat(F.lit("id:"), F.col("media_id").cast("string")))
    return K.searchable(rolled(t), messages, media)


def _excerpt(body: str, *terms: str) -> str:
    """Excerpt in SQL: the text, or 420 characters from at most 120 before the first hit."""
    found = [f"nullif(instr(lower({body}), '{term}'), 0) - 1" for term in terms]
    hit = f"coalesce(least({', '.join(found)}), 0)" if len(found) > 1 else f"coalesce({found[0]}, 0)"
    start = f"greatest(0, least({hit} - 120, length({body}) - 420))"
    cut = f"trim(regexp_replace(substring({body}, {start} + 1, 420), '^\\s+|\\s+$', '', 'g'), ' ')"
    return (f"case when length({body}) <= 420 then {body} else (case when {start} > 0 then '…' else '' end) || {cut} || "
            f"(case when {start} + 420 < length({body}) then '…' else '' end) end")


@query("K2_search", _ITEMS + f"""
    select type, id, conversation_id, title, {_excerpt("coalesce(body, '')", "en", "model")} as excerpt, at_ms from items
    where contains(lower(haystack), 'en') and contains(lower(haystack), 'conversation')
    order by case type when 'conversation' then 0 when 'message' then 1 else 2 end, coalesce(at_ms, -1) desc, id limit 120""")
def search(t: Tables):
    found = items(t).where(T.matches(F.col("haystack"), T.search_terms("EN conversation en")))
    found = found.withColumn("excerpt", T.excerpt(F.col("body"), ["en", "model"])).drop("haystack", "body")
    return K.page(found, "all", 120)


@query("K2_search_messages", _ITEMS + f"""
    select type, id, conversation_id, title, {_excerpt("coalesce(body, '')", "conversation 1")} as excerpt, at_ms from items
    where contains(lower(haystack), 'conversation 1') and type = 'message' order by coalesce(at_ms, -1) desc, id limit 900""")
def search_messages(t: Tables):
    return K.page(K.hits(items(t), '"Conversation 1"'), "message", 900)


@query("F5_search_counts", _ITEMS + "select type, count(*) as hits from items where contains(lower(haystack), 'on') and contains(lower(haystack), 'the') group by 1")
def search_counts(t: Tables):
    return K.counts(K.hits(items(t), "the on"))


@query("K3_whole_word", _ITEMS + f"""
    select type, id from items where regexp_matches(lower(haystack), '(^|{_LETTER})the($|{_LETTER})') and regexp_matches(lower(haystack), '(^|{_LETTER})conversation($|{_LETTER})')""")
def whole_word(t: Tables):
    return K.hits(items(t), "The conversation", "whole").select("type", "id")


@query("K4_excerpt", "select id, sha256(" + _excerpt("text", "the", "zz") + ") as digest from {msgs}")
def excerpt(t: Tables):
    return t.msgs.select("id", F.sha2(T.excerpt(F.col("text"), ["the", "zz"]), 256).alias("digest"))


@query("K5_highlight", r"""
    select id, sha256(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'),
        '(tion)', '<mark>\1</mark>', 'gi'), '(on)', '<mark>\1</mark>', 'gi')) as digest from {msgs}""")
def highlight(t: Tables):
    return t.msgs.select("id", F.sha2(T.highlight(F.col("text"), ["on", "tion"]), 256).alias("digest"))


_BM25 = r"""asked(query_id, first, second, needed) as (values {values}),
    lengths as (select *, len(l) as length from words),
    stats as (select count(*) as n, avg(length) as average from lengths),
    found as (select * from (select query_id, first, second, needed, id, length, {count} as tf from lengths, asked) where tf > 0),
    spread as (select query_id, first, second, count(*) as df from found group by 1, 2, 3),
    scored as (select f.query_id, f.id, round(sum(greatest(ln((s.n - p.df + 0.5) / (p.df + 0.5)), 0.000001) * f.tf * 2.2
          / (f.tf + 1.2 * (0.25 + 0.75 * f.length / s.average))), 6) as score
        from found f join spread p on p.query_id = f.query_id and p.first = f.first and p.second is not distinct from f.second, stats s
        group by f.query_id, f.id, f.needed having count(*) = f.needed),
    ranked as (select query_id, id, cast(round(score * 10000) as bigint) as score, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from scored)"""


def _bm25(values: str, *lists: str) -> str:
    """Ranking in SQL; ``words`` has the lists of words to count phrases in, ``l`` all of them."""
    count = " + ".join(
        f"len(list_filter(range(1, len({l}) + 1), lambda i: {l}[i] = first and (second is null or {l}[i + 1] = second)))" for l in lists)
    return _BM25.replace("{values}", values).replace("{count}", count)


_SPLIT = r"regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '([\p{{{{L}}}}\p{{{{N}}}}]+)', 1)"


@query("K6_ranked_search", "with words as (select doc_id as id, " + _SPLIT.format("text") + " as l from {documents}), " + _bm25(
    "(0, 'the', null, 2), (0, 'on', null, 2), (1, 'la', null, 1), (2, 'le', 'de', 1), (3, 'ete', null, 1), (4, 'de', 'la', 2), (4, 'en', null, 2)", "l") + """
    select query_id, id as doc_id, score, rank from ranked where rank <= 20""")
def ranked_search(t: Tables):
    """A token with an underscore or hyphen is a phrase, accents are folded on both sides."""
    best = K.ranked_batch(t.documents, "doc_id", F.col("text"), ["The on", "la", "le_de", "Été", "de-la EN"], 20)
    return best.withColumn("score", F.round(F.col("score") * 10000).cast("bigint"))


@query("K6_appended_index", "with words as (select doc_id as id, " + _SPLIT.format("text") + " as l from {documents}), " + _bm25(
    "(0, 'de', 'la', 1), (1, 'ciónque', null, 2), (1, 'en', null, 2), (2, 'on', null, 1)".replace("ciónque", "cionque"), "l") + """
    select query_id, id as doc_id, score, rank from ranked where rank <= 15""")
def appended_index(t: Tables):
    """Three deliveries are added to one index, the second one twice; a search reads the blocks of its words."""
    path, asked = workspace(t.spark, "index"), [K.query_phrases(q) for q in ("de-la", "ciónque en", "on")]
    for delivery in (0, 1, 1, 2):
        index.append(t.documents.where(F.col("doc_id") % 3 == delivery), "doc_id", F.col("text"), path, delivery)
    best = index.search(t.spark, path, asked, 15, t.documents.schema["doc_id"].dataType.simpleString())
    return best.withColumn("score", F.round(F.col("score") * 10000).cast("bigint"))


@query("K6_ranked_items", _ITEMS + ", words as (select concat_ws(':', type, id, coalesce(conversation_id, '')) as id, " + _SPLIT.format("title") + " as lt, "
       + _SPLIT.format("body") + " as lb, list_concat(lt, lb) as l from items), " + _bm25("(0, 'conversation', '1', 1), (1, 'the', null, 2), (1, 'conversation', null, 2)", "lt", "lb") + """
    select r.query_id, r.rank, r.score, i.type, i.id, i.conversation_id, i.title from ranked r join items i on concat_ws(':', i.type, i.id, coalesce(i.conversation_id, '')) = r.id where rank <= 60""")
def ranked_items(t: Tables):
    """Titles and bodies of conversations, messages and media in one ranking."""
    best = K.ranked_items(items(t), ["Conversation-1", "the conversation"], 60)
    return best.withColumn("score", F.round(F.col("score") * 10000).cast("bigint")).drop("excerpt")


@query("K6_inverted_index", r"""
    select term, count(*) as documents, cast(sum(tf) as bigint) as occurrences, cast(max(length) as bigint) as longest from
      (select doc_id, term, count(*) as tf, any_value(n) as length from
        (select doc_id, len(l) as n, unnest(l) as term from (select doc_id, regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}]+)', 1) as l from {documents})) group by 1, 2)
    group by 1""")
def inverted_index(t: Tables):
    index = K.postings(t.documents, "doc_id", F.col("text"))
    longest = index.groupBy("term").agg(F.max("length").cast("bigint").alias("longest"))
    return K.term_statistics(index).join(longest, "term")


@query("K7_search_captures", """
    with hits as (select case when doc_id % 3 = 0 then 0 when doc_id % 3 = 1 then 1 else 2 end as source_rank, doc_id as rank, 'media' as type,
         cast(doc_id % 200 as varchar) as id, lang as conversation_id, cast(null as varchar) as title from {documents} where contains(lower(text), 'an')),
      firsts as (select *, row_number() over (partition by id, conversation_id order by source_rank, rank) as rn from hits)
    select source_rank, rank, type, id, conversation_id, title from firsts where rn = 1 order by source_rank, rank, id limit 150""")
def search_captures(t: Tables):
    results = t.documents.where(F.lower("text").contains("an")).select(
        (F.col("doc_id") % 3).cast("int").alias("source_rank"), F.col("doc_id").alias("rank"), F.lit("media").alias("type"),
        (F.col("doc_id") % 200).cast("string").alias("id"), F.col("lang").alias("conversation_id"), F.lit(None).cast("string").alias("title"))
    return K.merge_captures(results, 150)


@query("K8_deep_search_text", """
    select id, sha256(concat_ws(' ', id, role, model, text, concat('m', cast(seq as varchar), ' f.png image/png message.attachments'),
       trim(concat('tool web_search ', role, ' T h text ', model)))) as digest from {msgs}""")
def deep_search_text(t: Tables):
    none = F.lit(None).cast("string")
    candidates = F.array(F.struct(F.concat(F.lit("m"), "seq").alias("id"), F.lit("f.png").alias("file_name"), F.lit("image/png").alias("mime_type"), F.lit("message.attachments").alias("source")))
    segment = lambda kind, tool, asked, text, sources: F.struct(
        F.lit(kind).alias("type"), tool.alias("tool"), none.alias("phase"), asked.alias("query"), text.alias("text"), sources.alias("sources"), none.alias("arguments"), none.alias("output"))
    sources = F.array(F.struct(F.lit("h").alias("url"), F.lit("T").alias("title")))
    empty = F.array().cast("array<struct<url:string,title:string>>")
    segments = F.array(segment("tool", F.lit("web_search"), F.col("role"), none, sources), segment("text", none, none, F.col("model"), empty))
    parts = [F.col("id"), F.col("role"), F.col("model"), F.col("text")]
    return t.msgs.select("id", F.sha2(N.deep_search_text(parts, candidates, segments), 256).alias("digest"))
