"""Row predicates: redaction, safe paths, path categories, store names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake import constants as K


def redaction(key: Column, session: bool = False, site: str | None = None) -> Column:
    """Struct of redacted and reason for a storage key; session storage also hides session identifiers.

    ``site`` is the name that keys of the site itself start with.
    """
    own = lambda rest: key.rlike(rf"(?i)^{re.escape(site)}{rest}") if site else F.lit(False)
    sensitive = (key == K.SENSITIVE_EXACT) | key.rlike(K.SENSITIVE_KEY) | key.rlike(K.SENSITIVE_WALLET)
    if session:
        sensitive = sensitive | key.rlike(K.SENSITIVE_SESSION_KEY) | own(K.SENSITIVE_SESSION_NAMES)
    volatile = key.rlike(K.VOLATILE_KEY) | own(K.VOLATILE_SESSIONS)
    reason = K.SENSITIVE_SESSION_REASON if session else K.SENSITIVE_REASON
    return F.struct(
        (sensitive | volatile).alias("redacted"),
        F.when(sensitive, reason).when(volatile, K.VOLATILE_REASON).alias("reason"),
    )


def sensitive_field(name: Column) -> Column:
    return F.regexp_replace(name, "[-_.]", "").rlike(K.SENSITIVE_FIELD)


def safe_path(path: Column, roots: Sequence[str] | None = None) -> Column:
    """Relative, normalized, no traversal, no backslash or NUL, below an allowed root."""
    ok = (
        path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.contains("\\")
        & ~path.contains("\u0000") & ~path.rlike(r"(^|/)\.{1,2}(/|$)") & ~path.contains("//")
        & ~path.rlike("^[A-Za-z]:/")
    )
    if roots is not None:
        ok = ok & F.split(path, "/").getItem(0).isin(*roots)
    return F.coalesce(ok, F.lit(False))


def path_layer(path: Column) -> Column:
    return F.split(path, "/").getItem(0)


def path_category(path: Column) -> Column:
    """filesystem-metadata, standalone-asset, extracted-source or derived-or-metadata."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return (
        F.when((name == ".DS_Store") | name.startswith("._"), "filesystem-metadata")
        .when(path.rlike("^captures/[^/]+/opfs/.") | path.rlike("^media/sha256(/|$)")
              | path.rlike("^(materialized-media|recovered-media|recovered-content)/media(/|$)"), "standalone-asset")
        .when(path.rlike("^stores(/|$)") | path.rlike("^captures/[^/]+/stores(/|$)"), "extracted-source")
        .otherwise("derived-or-metadata")
    )


def inline_media_store(name: Column) -> Column:
    return ~name.rlike(K.INLINE_MEDIA_EXCLUDED) & name.rlike(K.INLINE_MEDIA_STORES)


def store_target(name: Column) -> Column:
    """Target table of a store by its name; everything else stays lossless only."""
    target = F.lit(None).cast("string")
    for pattern, table in reversed(K.STORE_ROUTES):
        target = F.when(name.rlike(pattern), table).otherwise(target)
    return F.coalesce(target, F.lit("lossless"))


def studio_type(store: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(store, F.lit("")), "^studio(Image|Video|Audio)", 1))
    return F.when(found != "", found)


def studio_conversation_type(explicit: Column, conversation_id: Column) -> Column:
    text = F.lower(F.trim(explicit))
    by_id = F.coalesce(conversation_id, F.lit("")).rlike("(?i)^video-studio-(gallery|inputs)-")
    return F.when(text.isin("image", "video", "audio"), text).when(by_id, "video")


def conversation_kind(store: Column, studio: Column) -> Column:
    return F.when(studio.isNotNull(), "studio").when(store.rlike("(?i)mind"), "agentic").otherwise("chat")
