"""Catalog search and ranked search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators import index
from threadlake.operators.ordered import first_of_group
from threadlake.session import workspace


def searchable(conversations: DataFrame, messages: DataFrame, media: DataFrame) -> DataFrame:
    """One table of everything a catalog search looks at.

    conversations: id, title, preview, updated_ms; messages: id, conversation_id, title, text, created_ms;
    media: media_id, conversation_id, file_name, prompt, source, kind, mime_type, created_ms, is_thumbnail, hidden.
    """
    text = lambda *names: F.concat_ws(" ", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    shape = lambda df, kind, item, conversation, title, haystack, body, at: df.select(
        F.lit(kind).alias("type"), F.col(item).cast("string").alias("id"), F.col(conversation).cast("string").alias("conversation_id"),
        title.alias("title"), haystack.alias("haystack"), body.alias("body"), F.col(at).alias("at_ms"))
    return (
        shape(conversations, "conversation", "id", "id", F.col("title"), text("title", "preview"), F.col("preview"), "updated_ms")
        .unionByName(shape(messages, "message", "id", "conversation_id", F.col("title"), text("title", "text"), F.col("text"), "created_ms"))
        .unionByName(shape(media.where(~F.col("is_thumbnail") & ~F.col("hidden")), "media", "media_id", "conversation_id",
                           F.coalesce("file_name", "kind"), text("file_name", "prompt", "source"),
                           F.coalesce("prompt", "mime_type", "source"), "created_ms"))
    )


def hits(items: DataFrame, query: str, mode: str = "contains") -> DataFrame:
    """Items that contain every term of the query, with an excerpt."""
    terms = T.search_terms(query)
    found = items.where(T.matches(F.col("haystack"), terms, mode))
    return found.withColumn("excerpt", T.excerpt(F.col("body"), terms)).drop("haystack", "body")


def counts(found: DataFrame) -> DataFrame:
    """Number of hits per type, before any type filter or cap."""
    return found.groupBy("type").agg(F.count("*").alias("hits"))


def page(found: DataFrame, kind: str = "all", limit: int = 100) -> DataFrame:
    """First hits in catalog order: conversations, messages, media; newest first inside a type."""
    rows = found if kind == "all" else found.where(F.col("type") == kind)
    rank = reduce(lambda c, p: c.when(F.col("type") == p[1], p[0]), enumerate(("conversation", "message", "media")), F.when(F.lit(False), -1))
    return rows.orderBy(rank, F.coalesce("at_ms", F.lit(-1)).desc(), "id").limit(max(1, limit))


def query_phrases(query: str) -> list[tuple[str, ...]]:
    """Phrases of a query: a token with ``_`` or ``-`` inside is a phrase of its parts, any other a phrase of one word."""
    phrases = [tuple(_split(token)) for token in T.search_tokens(query)]
    phrases = list(dict.fromkeys(p for p in phrases if p))
    if not phrases:
        raise ValueError("enter at least one searchable word")
    return phrases


def _split(token: str) -> list[str]:
    return T.split_folded(token)


def postings(documents: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """Inverted index: term, document, term frequency, document length.

    Words are counted inside their row: the words of a document are sorted and a run of equal ones is one posting, so
    nothing is shuffled.
    """
    words = documents.select(F.col(doc_id).alias("doc_id"), F.array_sort(T.tokens(text)).alias("words"))
    starts = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("at"))), lambda s: (s["at"] == 0) | (F.get("words", s["at"] - 1) != s["term"]))
    runs = words.select("doc_id", F.size("words").alias("length"), starts.alias("starts"))
    counted = F.transform("starts", lambda s, i: F.struct(s["term"].alias("term"), (F.coalesce(F.get("starts", i + 1)["at"], F.col("length")) - s["at"]).cast("bigint").alias("tf")))
    return runs.select("doc_id", "length", F.explode(counted).alias("p")).select("doc_id", "length", "p.term", "p.tf")


def term_statistics(index: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def ranked_batch(documents: DataFrame, doc_id: str, texts: Column | Sequence[Column], queries: Sequence[str], limit: int = 25, path: str | None = None) -> DataFrame:
    """BM25 ranking of many queries over a table; all phrases of a query must occur, accents and case don't matter.

    The index is written to ``path`` (a folder of this run without one); to search it again, or to add deliveries, use
    :mod:`threadlake.operators.index`.
    """
    wanted = [query_phrases(query) for query in queries]
    path = path or workspace(documents.sparkSession, "index")
    index.append(documents, doc_id, texts, path, 0)
    return index.search(documents.sparkSession, path, wanted, limit, documents.schema[doc_id].dataType.simpleString())


def keyed_items(items: DataFrame) -> DataFrame:
    """Items with the key they have in an index (``_key``)."""
    return items.withColumn("_key", F.concat_ws(":", "type", F.coalesce("id", F.lit("")), F.coalesce("conversation_id", F.lit(""))))


def ranked_items(items: DataFrame, queries: Sequence[str], limit: int = 25) -> DataFrame:
    """Ranked search over the title and body of conversations, messages and media, with a marked snippet.

    items: type, id, conversation_id, title, body.  The rows found are few (``limit`` per query), so their texts are
    fetched by a join after the ranking.
    """
    keyed = keyed_items(items)
    best = ranked_batch(keyed, "_key", [F.col("title"), F.col("body")], queries, limit)
    return shown_items(best, keyed, queries)


def shown_items(best: DataFrame, keyed: DataFrame, queries: Sequence[str]) -> DataFrame:
    """The items of a ranking, with a snippet in which the phrases of their query are marked."""
    asked = best.sparkSession.createDataFrame([(q, [list(p) for p in query_phrases(query)]) for q, query in enumerate(queries)], "query_id int, phrases array<array<string>>")
    rows = best.join(keyed.withColumnRenamed("_key", "doc_id"), "doc_id").join(F.broadcast(asked), "query_id")
    return rows.select("query_id", "rank", "score", "type", "id", "conversation_id", "title", T.snippet(F.col("body"), F.col("phrases")).alias("excerpt"))


def merge_captures(results: DataFrame, limit: int) -> DataFrame:
    """Hits of several captures in capture order; an item counts once, where it comes first.

    results: source_rank (0 is the newest), rank, type, id, conversation_id, title.
    """
    key = F.concat_ws(":", "type", F.coalesce("id", F.lit("")), F.coalesce("conversation_id", F.lit("")), F.coalesce("title", F.lit("")))
    rows = results.withColumn("_key", key)
    firsts = first_of_group(rows, ["_key"], ["source_rank", "rank"], [c for c in rows.columns if c != "_key"])
    return firsts.drop("_key").orderBy("source_rank", "rank", "id").limit(max(1, limit))
