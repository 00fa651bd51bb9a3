"""Media library: dispositions, suppression, facets, galleries, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import media as M
from threadlake.functions import scalars as S
from threadlake.operators.ordered import first_of_group, last_before

KINDS = ("image", "video", "audio", "file")


def sanitized_url(url: Column, inline: Column, include_urls: bool, limit: int = 2048) -> Column:
    """Struct of url, url_preview, url_kind and url_omitted: inline data is left out, long URLs are cut."""
    data = inline | url.startswith("data:")
    none = F.lit(None).cast("string")
    if include_urls:
        shown = F.when(~data & (F.length(url) <= limit), url)
        preview = F.when(~data & (F.length(url) > limit), F.concat(F.substring(url, 1, limit - 3), F.lit("...")))
        omitted = F.coalesce(data, F.lit(False))
    else:
        shown, preview, omitted = none, none, url.isNotNull()
    kind = F.when(data, "inline-data").when(url.isNotNull(), "reference")
    return F.struct(shown.alias("url"), preview.alias("url_preview"), kind.alias("url_kind"), omitted.alias("url_omitted"))


def preference_key(sha: Column, item_id: Column) -> Column:
    """Key of a preference: content hash when known, else the item id."""
    digest = F.lower(F.trim(F.coalesce(sha, F.lit(""))))
    return F.when(digest != "", F.concat(F.lit("sha256:"), digest)).otherwise(F.concat(F.lit("id:"), item_id.cast("string")))


def with_preferences(media: DataFrame, prefs: DataFrame, key: Column) -> DataFrame:
    """Adds favourite and hidden; preferences are unique per key."""
    keyed = media.withColumn("pref_key", key)
    return keyed.join(prefs, "pref_key", "left").withColumns({
        "favourite": F.coalesce("favourite", F.lit(False)), "hidden": F.coalesce("hidden", F.lit(False)),
    }).drop("pref_key")


def listing_stages(
    media: DataFrame, query: str = "", status: str = "available", source: str = "all",
    uploads: bool = False, thumbnails: bool = False, favourites_only: bool = False,
) -> DataFrame:
    """Rows after text, status, source and favourite filters; ``in_scope`` adds the upload filter."""
    searchable = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("file_name", "prompt", "mime_type", "source")]))
    keep = F.lit(True)
    if query:
        keep = keep & searchable.contains(query.lower())
    if not thumbnails:
        keep = keep & ~F.col("is_thumbnail")
    if status != "all":
        keep = keep & (F.col("available") if status == "available" else ~F.col("available"))
    if source != "all":
        keep = keep & (F.col("source") == source)
    if favourites_only:
        keep = keep & F.col("favourite")
    return media.where(keep).withColumn("in_scope", F.lit(True) if uploads else ~F.col("is_uploaded"))


def listing_facets(stages: DataFrame, kind: str = "all", include_hidden: bool = False) -> DataFrame:
    """Counts in the order of the filters: uploads, hidden inside the kind, facets over all kinds."""
    scope, hidden = F.col("in_scope"), F.col("hidden")
    shown = scope if include_hidden else scope & ~hidden
    of_kind = F.lit(True) if kind == "all" else F.col("kind") == kind
    return stages.agg(
        F.count_if("is_uploaded").alias("uploads"),
        F.count_if(scope & of_kind & hidden).alias("hidden"),
        F.count_if(shown & F.col("favourite")).alias("favourites"),
        F.count_if(shown).alias("all"),
        *[F.count_if(shown & (F.col("kind") == k)).alias(k) for k in KINDS],
        F.count_if(shown & of_kind).alias("total"),
    )


def listing_rows(stages: DataFrame, kind: str = "all", include_hidden: bool = False) -> DataFrame:
    shown = F.col("in_scope") if include_hidden else F.col("in_scope") & ~F.col("hidden")
    return stages.where(shown if kind == "all" else shown & (F.col("kind") == kind)).drop("in_scope")


def listing_order(sort: str, item_id: str = "media_id") -> list[Column]:
    """Sort expressions of a media listing; ids break ties."""
    created = F.coalesce("created_ms", F.lit(-1))
    by_id = F.col(item_id).asc()
    return {
        "recent": [created.desc(), by_id],
        "oldest": [created.asc(), by_id],
        "model": [F.lower(F.coalesce("model", F.lit("￿"))).asc(), created.desc(), by_id],
        "name": [S.natural_key(F.col("file_name")).asc(), created.desc(), by_id],
        "largest": [F.coalesce("bytes", F.lit(0)).desc(), by_id],
        "session": [F.col("conversation_rank").asc_nulls_last(), F.col("conversation_id").cast("string").asc_nulls_first(),
                    created.asc(), by_id],
    }[sort]


def media_overview(media: DataFrame) -> DataFrame:
    """Totals of the library without thumbnails: available, unavailable and per kind."""
    there = F.col("available")
    return media.where(~F.col("is_thumbnail")).agg(
        F.count_if(there).alias("media"), F.count_if(~there).alias("unavailable"),
        *[F.count_if(there & (F.col("kind") == k)).alias(k) for k in KINDS])


def gallery_summary(items: DataFrame) -> DataFrame:
    """Counts of a gallery: exported, linked, metadata only, orphaned, bytes.

    Input columns: local_path, source_url, kind, orphaned, bytes.
    """
    local, url = F.col("local_path").isNotNull(), F.col("source_url").isNotNull()
    return items.agg(
        F.count("*").alias("total"), F.count_if(local).alias("exported"), F.count_if(~local & url).alias("linked"),
        F.count_if(~local & ~url).alias("metadata_only"), F.count_if(~local).alias("unresolved"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS],
        F.count_if("orphaned").alias("orphaned"), F.coalesce(F.sum(F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("bytes"))


# ---------------------------------------------------------------- linking to messages

def display_message(media: DataFrame, messages: DataFrame, width: int = 65_536) -> DataFrame:
    """Adds display_message_id, disposition, model and uploaded.

    An input attached to an assistant message shows at the closest earlier user message;
    inputs have no model.  messages: conversation_id, id, seq, role, model.
    """
    with_user = last_before(
        messages.select("conversation_id", "id", "seq", "role", "model"), ["conversation_id"], "seq", ["id"],
        "_user", F.col("role") == "user", width)
    linked = media.join(
        with_user.select("conversation_id", F.col("id").alias("message_id"), F.col("seq").alias("message_seq"),
                         F.col("role").alias("message_role"), F.col("model").alias("message_model"),
                         F.col("_user.id").alias("user_id")),
        ["conversation_id", "message_id"], "left")
    none = F.lit(None).cast("string")
    disposition = M.resolved_disposition(
        F.col("disposition"), F.col("source"), none, F.lit(False), F.col("message_model"), F.col("message_role"), none)
    staged = linked.withColumn("disposition", disposition)
    is_input = F.col("disposition") == "input"
    moved = F.when((F.col("message_role") == "assistant") & is_input, F.col("user_id"))
    return staged.withColumns({
        "display_message_id": F.coalesce(moved, F.col("message_id")),
        "model": F.when(~is_input, F.when(
            (F.col("disposition") == "output") | (F.col("message_role") == "assistant"), F.col("message_model"))),
        "uploaded": is_input | F.coalesce(F.col("message_role") == "user", F.lit(False)),
    }).drop("user_id")


def disposition_rank(disposition: Column) -> Column:
    return F.when(disposition == "input", 0).when(disposition == "output", 1).otherwise(2)


def inherit_from_message(media: DataFrame, messages: DataFrame) -> DataFrame:
    """Created time and prompt of the linked message fill what a media row lacks."""
    source = messages.select(
        "conversation_id", F.col("id").alias("message_id"),
        F.col("created_ms").alias("_created"), F.col("text").alias("_text"))
    return media.join(source, ["conversation_id", "message_id"], "left").withColumns({
        "created_ms": F.coalesce("created_ms", "_created"),
        "prompt": F.coalesce(F.when(F.col("prompt") != "", F.col("prompt")), F.col("_text")),
    }).drop("_created", "_text")


# ---------------------------------------------------------------- recovery and suppression

LOCATION = ("path", "archive_source", "bytes", "mime_type", "kind")


def recover_by_hash(media: DataFrame) -> DataFrame:
    """Unavailable rows borrow the best available row with the same content hash.

    A row whose message and kind already have an available copy keeps its state.
    One row per hash is picked by aggregation before the join, so a hash with very
    many copies neither multiplies rows nor lands in one task.
    """
    score = (
        F.when(F.col("format_corrected"), 0).otherwise(4) + F.when(F.col("status") == "materialized", 2).otherwise(0)
        + F.when(F.col("archive_source").rlike("(?i)full-resolution|recovered"), 1).otherwise(0))
    there = media.where(F.col("available") & F.col("sha").isNotNull())
    best = (
        there.withColumn("_worse", -score)
        .transform(lambda d: first_of_group(d, ["sha"], ["_worse", "media_id"],
                                            ["media_id", "archive_source", "bytes", "mime_type", "kind"]))
        .select("sha", F.col("media_id").alias("donor_id"), F.col("archive_source").alias("donor_source"),
                F.col("bytes").alias("donor_bytes"), F.col("mime_type").alias("donor_mime"), F.col("kind").alias("donor_kind"))
    )
    covered = (
        there.where(F.col("message_id").isNotNull()).select("sha", "message_id", "kind").distinct()
        .withColumn("_covered", F.lit(True))
    )
    missing = media.where(~F.col("available"))
    joined = (
        missing.join(covered, ["sha", "message_id", "kind"], "left").join(best, "sha", "left")
        .withColumn("recovered", F.col("donor_id").isNotNull() & F.col("_covered").isNull())
    )
    keep = media.columns
    filled = joined.withColumns({
        "available": F.col("recovered"),
        "status": F.when(F.col("recovered"), "deduped").otherwise(F.col("status")),
        "archive_source": F.when(F.col("recovered"), F.col("donor_source")).otherwise(F.col("archive_source")),
        "bytes": F.when(F.col("recovered"), F.col("donor_bytes")).otherwise(F.col("bytes")),
        "mime_type": F.when(F.col("recovered"), F.coalesce("donor_mime", "mime_type")).otherwise(F.col("mime_type")),
        "kind": F.when(F.col("recovered"), F.coalesce("donor_kind", "kind")).otherwise(F.col("kind")),
        "donor_id": F.when(F.col("recovered"), F.col("donor_id")),
    }).select(*keep, "recovered", "donor_id")
    untouched = media.where("available").select(
        *keep, F.lit(False).alias("recovered"), F.lit(None).cast(media.schema["media_id"].dataType).alias("donor_id"))
    return untouched.unionByName(filled)


def suppress_covered(media: DataFrame) -> DataFrame:
    """Drops thumbnails, placeholders and copies that a better row covers.

    Input columns include: media_id, conversation_id, message_id, kind, available, sha, is_thumbnail, stem.
    """
    linked = media.where(F.col("available") & F.col("message_id").isNotNull())
    full = linked.where(~F.col("is_thumbnail") & F.col("conversation_id").isNotNull()).select(
        F.lower(F.concat_ws("_", F.col("conversation_id").cast("string"), "message_id")).alias("stem")).distinct()
    kept = media.join(full.withColumn("is_thumbnail", F.lit(True)), ["is_thumbnail", "stem"], "left_anti")
    by_message = linked.select("message_id", "kind", F.lit(False).alias("available")).distinct()
    kept = kept.join(by_message, ["message_id", "kind", "available"], "left_anti")
    # unlinked copies: covered by a linked copy of the same conversation, or by any when they have none
    hashes = linked.where(F.col("sha").isNotNull())
    loose = (F.col("available") & F.col("message_id").isNull() & F.col("sha").isNotNull())
    flagged = kept.withColumn("_loose", F.coalesce(loose, F.lit(False)))
    same = hashes.select("sha", "conversation_id", F.lit(True).alias("_loose")).distinct()
    flagged = flagged.join(same, ["sha", "conversation_id", "_loose"], "left_anti")
    free = hashes.select("sha").distinct().withColumn("_free", F.lit(True))
    flagged = flagged.withColumn("_free", F.col("_loose") & F.col("conversation_id").isNull()) \
        .join(free, ["sha", "_free"], "left_anti").drop("_loose", "_free")
    # a file linked twice to one message shows once
    repeated = F.coalesce(F.col("available") & F.col("message_id").isNotNull() & F.col("sha").isNotNull(), F.lit(False))
    keys = ["conversation_id", "message_id", "kind", "sha"]
    winners = flagged.where(repeated).groupBy(*keys).agg(F.min("media_id").alias("media_id")).select("media_id")
    losers = flagged.where(repeated).select("media_id").join(winners, "media_id", "left_anti")
    return flagged.join(losers, "media_id", "left_anti")


# ---------------------------------------------------------------- gallery rows

def gallery_rows(items: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows a gallery shows: key, name, flags and context inherited from message and conversation.

    items: media_id, sha, path, url, file_name, mime_type, kind, source, status, created_ms, prompt,
    conversation_id, message_id.
    """
    said = messages.select(
        "conversation_id", F.col("id").alias("message_id"), F.col("created_ms").alias("_created"),
        F.col("model").alias("_model"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    about = conversations.select(F.col("id").alias("conversation_id"), F.col("title").alias("_title"))
    rows = items.join(said, ["conversation_id", "message_id"], "left").join(about, "conversation_id", "left")
    name = F.trim(F.coalesce("file_name", F.lit("")))
    clean = (name != "") & (F.length(name) <= 80) & ~name.rlike('[{}"]') & name.rlike(r"(?i)\.[a-z0-9]{2,5}$")
    short = F.substring(F.coalesce("sha", F.col("media_id").cast("string")), 1, 12)
    href = F.coalesce(F.concat(F.lit("../"), "path"), F.col("url"))
    status = F.coalesce("status", F.lit("referenced"))
    return rows.select(
        F.coalesce("path", F.col("media_id").cast("string"), "sha", href).alias("key"), href.alias("href"),
        F.when(F.col("kind").isin("image", "video", "audio"), F.col("kind")).otherwise("attachment").alias("kind"),
        F.when(clean, name).otherwise(
            F.concat(short, F.lit("."), M.extension_for_mime(F.col("mime_type"), F.col("kind")))).alias("name"),
        "media_id", "conversation_id", "message_id", "source", "sha", "bytes",
        F.coalesce("_title", F.lit("")).alias("conversation_title"),
        F.coalesce("created_ms", "_created").alias("created_ms"), F.coalesce("_model", F.lit("")).alias("model"),
        F.trim(F.coalesce(F.when(F.col("prompt") != "", F.col("prompt")),
                          F.when(F.col("_role") != "assistant", F.col("_text")), F.lit(""))).alias("prompt"),
        status.alias("status"), F.col("path").isNotNull().alias("local"),
        (F.lower(status).isin("failed", "unresolved") | (href.isNull() & (status != "referenced"))).alias("review"))


def unique_gallery(rows: DataFrame, order: str = "media_id") -> DataFrame:
    """First row per gallery key."""
    return first_of_group(rows, ["key"], [order], [c for c in rows.columns if c != "key"])


def gallery_items(rows: DataFrame) -> DataFrame:
    """Adds the display title and the search text of gallery items.

    rows: media_id, title (of the conversation), prompt_text, message_text, message_id, source, mime_type, kind.
    """
    text = lambda c: F.col(c).cast("string")
    cut = lambda c: F.when(F.length(c) > 260, F.concat(F.substring(c, 1, 257), F.lit("..."))).otherwise(F.col(c))
    prompt, said = S.clean(cut("prompt_text")), S.clean(cut("message_text"))
    title = S.first_nonempty(F.col("title"), prompt, said, text("media_id"))
    blank = F.lit("")
    return rows.select(
        "*", title.alias("display_title"),
        F.lower(F.concat_ws(" ", title, "title", F.nullif(prompt, blank), F.nullif(said, blank), text("media_id"), "message_id",
                            "source", "mime_type", "kind")).alias("search_text"))


def described_items(media: DataFrame, messages: DataFrame, conversations: DataFrame, settings: DataFrame) -> DataFrame:
    """Gallery items with their texts and where model and settings come from.

    An item takes prompt and text from its message's parent and its message, the title from its conversation, and model and
    settings from the first of media record, message, parent message and the workspace settings of its owner (the item, its
    message or its conversation, else the default record).  Messages meet media once, as one row per message.

    media: media_id, conversation_id, message_id, source, mime_type, kind, model, model_id, settings; messages: conversation_id, id,
    parent_id, text, model, model_id, settings; conversations: id, title; settings: owner_id, settings_id, is_default, line_no,
    model_id, settings.
    """
    from threadlake.operators import links

    fields = ("model", "model_id", "settings")
    of = lambda place: [F.col(f).alias(f"{place}_{f}") for f in fields]
    asked = messages.select("conversation_id", F.col("id").alias("parent_id"), F.col("text").alias("prompt_text"), F.lit(True).alias("_known"), *of("parent"))
    said = messages.select("conversation_id", F.col("id").alias("message_id"), "parent_id", F.col("text").alias("message_text"), *of("message")).join(
        asked, ["conversation_id", "parent_id"], "left")
    titles = conversations.select(F.col("id").alias("conversation_id"), "title")
    rows = media.drop(*fields, "title").join(media.select("media_id", *of("record")), "media_id").join(said, ["conversation_id", "message_id"], "left").join(titles, "conversation_id", "left")
    owners = {"item_owner": "media_id", "said_owner": "message_id", "conversation_owner": "conversation_id"}
    rows = rows.withColumns({name: F.col(c).cast("string") for name, c in owners.items()})
    known = settings.select("owner_id", "settings_id", "is_default", "line_no", *of("settings")[1:])
    resolved = links.resolve_settings(rows, list(owners), known, "settings_id")
    kept = [*(c for c in media.columns if c not in fields), F.when(F.col("_known"), F.col("parent_id")).alias("parent_id"), "title", "prompt_text", "message_text", "matched_by"]
    traced = links.generation_metadata(resolved.withColumn("kept", F.struct(*kept)))
    return gallery_items(traced.select("kept.*", "model_label", "model_source", "settings", "settings_source"))
