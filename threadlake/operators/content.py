"""Content addressing: payload decoding, objects, versions, recovery imports."""

from __future__ import annotations

import binascii
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from threadlake import constants as K
from threadlake.functions import media as M
from threadlake.functions import records as R
from threadlake.operators.ordered import first_of_group, last_before


def unresolved(items: DataFrame, references: Sequence[str]) -> DataFrame:
    """Media rows without any path or URL, with the reason."""
    return items.where(F.coalesce(*references).isNull()).withColumn("reason", F.lit(K.NO_BYTES_REASON))


# ---------------------------------------------------------------- payloads

_BASE64_URL = re.compile("^data:[^;,]+;base64,")
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_STANDARD, _NO_BASE64 = bytes.maketrans(b"-_", b"+/"), bytes(set(range(256)) - set(_ALPHABET))


def _from_base64(text: str) -> bytes:
    body = _BASE64_URL.sub("", text, count=1).encode("utf-8", "replace").translate(_STANDARD, _NO_BASE64)
    # a single left-over character carries no byte
    body = body[:-1] if len(body) % 4 == 1 else body
    return binascii.a2b_base64(body + b"=" * (-len(body) % 4))


@F.pandas_udf(BinaryType())
def _base64_bytes(text: pd.Series) -> pd.Series:
    """Bytes of base64 text, plain or in a data URL; other alphabets and missing padding are accepted."""
    return text.map(lambda t: None if t is None else _from_base64(t))


def _number_text(numbers: np.ndarray, keys: np.ndarray | None) -> bytes | None:
    """Bytes of numbers without their fractions, modulo 256, in key order; what is no number, or is too large, is 0."""
    if keys is not None:
        places = {int(k): i for i, k in enumerate(keys) if k.isascii() and k.isdecimal()}
        # other keys, keys too long for a number and equal ones, like 1 and 01, are rare
        if len(places) < len(keys) or max(map(len, keys), default=39) > 38:
            return None
        numbers = numbers[[places[k] for k in sorted(places)]]
    whole = np.trunc(np.asarray(numbers, np.float64))
    whole = np.where(np.abs(whole) <= 2.0**63, np.minimum(whole, 2.0**63), 0)
    return np.where(whole == 2.0**63, 255, whole % 256).astype(np.uint8).tobytes()


@F.pandas_udf(BinaryType())
def _plain_number_bytes(numbers: pd.Series, keys: pd.Series) -> pd.Series:
    """Bytes of an array of numbers or, with keys, of an object; null where the general expressions have to look."""
    return pd.Series([None if n is None else _number_text(n, k) for n, k in zip(numbers, keys)], dtype=object)


def _whole(number: Column) -> Column:
    """A VARIANT number without its fraction; what is no number is 0."""
    return F.coalesce(F.try_variant_get(number, "$", "double").try_cast("bigint"), F.lit(0).cast("bigint"))


def _number_bytes(numbers: Column) -> Column:
    """Bytes of an array of whole numbers, each taken modulo 256."""
    digits = F.transform(numbers, lambda n: F.lpad(F.hex(n.bitwiseAND(255)), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def decode_payload(value: Column) -> Column:
    """Bytes of a VARIANT payload: base64 or data URL, byte array, numeric-key object, encoded view.

    Texts and lists of numbers are decoded by vectorized functions; lists that hold anything else by native expressions.
    """
    def keyed(v: Column) -> Column:
        """Numbers of an object with numeric keys, in key order."""
        entries = F.map_entries(R.fields(v))
        numeric = F.filter(entries, lambda e: e["key"].rlike(r"^\d+$"))
        ordered = F.array_sort(F.transform(numeric, lambda e: F.struct(e["key"].try_cast("decimal(38,0)").alias("k"), _whole(e["value"]).alias("n"))))
        return R.bind(ordered, lambda o: F.when(F.size(o) > 0, _number_bytes(F.transform(o, lambda e: e["n"]))))

    listed, members = F.try_variant_get(value, "$", "array<double>"), F.try_variant_get(value, "$", "map<string,double>")
    # containers are never written as JSON, and their types not looked at: both cost far more than their numbers
    scalar = listed.isNull() & members.isNull() & F.try_variant_get(value, "$", "array<variant>").isNull() & R.fields(value).isNull()
    text = F.when(scalar, F.when(R.kind_of(value) == "string", R.as_text(value))).otherwise(R.as_text(R.child(value, "encoded")))
    decoded = _base64_bytes(text)
    start = F.coalesce(R.as_text(R.child(value, "byteOffset")).try_cast("int"), F.lit(0))
    length = F.coalesce(R.as_text(R.child(value, "length")).try_cast("int"), F.lit(2**31 - 1))
    viewed = R.child(value, "encoded").isNotNull()
    plain = _plain_number_bytes(F.when(~viewed, F.coalesce(listed, F.map_values(members))), F.when(~viewed, F.map_keys(members)))
    general = _number_bytes(F.transform(F.try_variant_get(value, "$", "array<variant>"), _whole))
    return F.coalesce(F.when(viewed, F.substring(decoded, start + 1, length)).otherwise(decoded), plain, general, keyed(value))


# JPEG markers (fixed values): start of image, end of image, start of scan; those without a length; frame headers
_END, _SCAN = 0xD9, 0xDA
_BARE = frozenset((0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, _END))
_FRAMES = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))


def jpeg_segments(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and parameters of every segment in front of the first scan.

    A marker is 0xFF, any number of fill bytes 0xFF, and a code that is not 0.  Its parameters follow with their length
    in front, unless the code is one of those that stand alone.
    """
    place = 0
    while (place := content.find(b"\xff", place)) >= 0:
        rest = content[place:place + 64].lstrip(b"\xff") or content[place:].lstrip(b"\xff")
        if not rest:
            return
        code = rest[0]
        place = content.index(rest[:1], place + 1) + 1
        if code in (_END, _SCAN):
            return
        if code == 0 or code in _BARE:
            continue
        if len(content) < place + 2:
            return
        (length,) = struct.unpack_from(">H", content, place)
        yield code, content[place + 2:place + length]
        place += max(length, 2)


def jpeg_size(content: bytes) -> tuple[int | None, int | None]:
    """Width and height of a JPEG: the lines and samples per line of its first frame header."""
    for code, parameters in jpeg_segments(content):
        if code in _FRAMES and len(parameters) >= 5:
            _, lines, samples = struct.unpack_from(">BHH", parameters)
            return samples, lines
    return None, None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def jpeg_dimensions(content: pd.Series) -> pd.DataFrame:
    sizes = [jpeg_size(bytes(c)) if c is not None else (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"], dtype="object")


def inspect_objects(objects: DataFrame, content: str, file_name: str, mime: str) -> DataFrame:
    """Detected type and size of each object: by its bytes, else by its name, else by the reported type.

    Only JPEG files need a scan of their segments; the content of others does not leave the JVM.
    """
    blank = F.lit("")
    staged = objects.withColumns({"_head": M.leading_hex(F.col(content)), "_size": F.length(content)}).withColumn(
        "_proved", M.signature_extension(F.col("_head"), F.col("_size"), F.col(file_name), F.col(mime)))
    named = F.nullif(M.extension_of(F.coalesce(F.col(file_name), blank)), blank)
    staged = staged.withColumns({"_named": named, "_hinted": M.extension_of_mime(F.col(mime))})
    known = lambda field: F.coalesce(*[M.type_of_extension(F.col(c), field) for c in ("_proved", "_named", "_hinted")])
    jpeg = F.col("_proved").eqNullSafe(".jpg")
    found = staged.withColumns({
        "_s": jpeg_dimensions(F.when(jpeg, F.col(content))),
        "extension": F.coalesce("_proved", "_named", "_hinted", F.lit(".bin")),
        "detected_mime": F.coalesce(known("mime_type"), F.lit("application/octet-stream")),
        "detected_kind": F.coalesce(known("kind"), F.lit("file")),
    })
    side = lambda axis: M.header_size(F.col("_head"), F.col("_size"), F.col("_proved"), axis)
    size = lambda axis: F.when(jpeg, F.col(f"_s.{axis}")).otherwise(side(axis)).alias(axis)
    return found.select(*objects.columns, "extension", "detected_mime", "detected_kind", size("width"), size("height"))


def reconcile(media: DataFrame, objects: DataFrame) -> DataFrame:
    """Media rows checked against the objects that exist: missing bytes, detected type, corrected names.

    media: media_id, path, file_name, mime_type, kind, available; objects: path, bytes, extension,
    detected_mime, detected_kind, width, height.
    """
    joined = media.join(objects, "path", "left")
    there = F.col("available") & F.col("bytes").isNotNull()
    name = M.correct_extension(F.col("file_name"), F.col("extension"))
    reported = F.lower(F.substring_index(F.coalesce("mime_type", F.lit("")), ";", 1))
    jpeg = [".jpg", ".jpeg"]
    path_extension = M.extension_of(F.col("path"))
    mismatch = (path_extension != "") & (path_extension != F.col("extension")) & ~(
        path_extension.isin(jpeg) & F.col("extension").isin(jpeg))
    corrected = ((reported != "") & (reported != F.col("detected_mime"))) | F.coalesce(name != F.col("file_name"), F.lit(False)) | mismatch
    return joined.select(
        "media_id", "path", F.coalesce(there, F.lit(False)).alias("available"),
        F.when(there, "materialized").otherwise("missing").alias("status"), "bytes",
        F.when(there, F.coalesce(name, "file_name")).otherwise(F.col("file_name")).alias("file_name"),
        F.when(there, F.col("detected_mime")).otherwise(F.col("mime_type")).alias("mime_type"),
        F.when(there, F.col("detected_kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(there, F.col("width")).alias("width"), F.when(there, F.col("height")).alias("height"),
        F.coalesce(there & corrected, F.lit(False)).alias("format_corrected"))


# ---------------------------------------------------------------- objects

def object_path(sha: Column, extension: Column) -> Column:
    return F.concat(F.lit("media/sha256/"), F.substring(sha, 1, 2), F.lit("/"), sha, extension)


def first_seen(items: DataFrame, sha: str, order: Sequence[str], item_id: str, pool: DataFrame | None = None) -> DataFrame:
    """Status of each item: ``materialized`` for the first of its hash, ``deduped`` for the rest.

    A hash the pool already holds makes all its items ``deduped``.  The winner per
    hash is found by aggregation and joined back, so copies of one payload are never
    sorted in one task.
    """
    winners = first_of_group(items, [sha], order, [item_id])
    if pool is not None:
        winners = winners.join(pool.select(sha).distinct(), sha, "left_anti")
    winners = winners.select(item_id, F.lit(True).alias("_first"))
    return items.join(winners, item_id, "left").withColumn(
        "status", F.when(F.col("_first"), "materialized").otherwise("deduped")).drop("_first")


def payload_versions(records: DataFrame, keys: Sequence[str], ordinal: str, sha: str) -> DataFrame:
    """Rows that add a version: content differs from the latest version of the same record.

    A record that goes back to older content points at it again without a new row,
    so ``version_added`` is true only for the first time a record has that content.
    """
    changed = last_before(records, keys, ordinal, [sha], "_previous")
    first = records.groupBy(*keys, sha).agg(F.min(ordinal).alias("_first"))
    return (
        changed.join(first, [*keys, sha])
        .withColumn("changed", F.coalesce(F.col(sha) != F.col(f"_previous.{sha}"), F.lit(True)))
        .withColumn("version_added", F.col("changed") & (F.col(ordinal) == F.col("_first")))
        .drop("_previous", "_first")
    )


def link_materialized(items: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversation, time, prompt and model of the linked message fill what an item lacks."""
    said = messages.select(
        F.col("id").alias("message_id"), F.col("conversation_id").alias("_conversation"), F.col("created_ms").alias("_created"),
        F.col("text").alias("_text"), F.when(F.col("role") == "assistant", F.col("model")).alias("_model"))
    joined = items.join(said, "message_id", "left")
    return joined.select(
        *[c for c in items.columns if c not in ("conversation_id", "created_ms", "prompt", "model")],
        F.coalesce("conversation_id", "_conversation").alias("conversation_id"), F.coalesce("created_ms", "_created").alias("created_ms"),
        F.coalesce(F.nullif(F.col("prompt"), F.lit("")), F.col("_text"), F.lit("")).alias("prompt"),
        F.coalesce("model", "_model").alias("model"))


# ---------------------------------------------------------------- duplicates

def duplicate_groups(files: DataFrame) -> DataFrame:
    """Contents with more than one copy: copies, number of layers and categories, repeated bytes.

    files: sha, bytes, layer, category.  :func:`duplicate_members` lists where the copies are.
    """
    return (
        files.groupBy("sha").agg(
            F.count("*").alias("copies"), F.first("bytes").alias("bytes"),
            F.countDistinct("layer").alias("layers"), F.countDistinct("category").alias("categories"))
        .where("copies > 1")
        .withColumn("repeated_bytes", (F.col("copies") - 1) * F.col("bytes")).orderBy(F.col("repeated_bytes").desc(), "sha")
    )


def duplicate_members(files: DataFrame) -> DataFrame:
    """One row per repeated content, layer and category with its copies there; no list holds them."""
    placed = files.groupBy("sha", "layer", "category").agg(F.count("*").alias("copies"))
    repeated = placed.groupBy("sha").agg(F.sum("copies").alias("_all")).where("_all > 1")
    return placed.join(repeated, "sha").drop("_all")


def duplicate_summary(files: DataFrame, pool: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a file set: distinct contents, repeated bytes, what a shared pool already holds."""
    per_hash = files.groupBy(*by, "sha").agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes"))
    held = pool.select("sha").distinct().withColumn("_held", F.lit(True))
    rows = per_hash.join(held, "sha", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.groupBy(*by).agg(
        zero(F.sum("copies")).alias("files"), F.count("*").alias("distinct_contents"),
        zero(F.sum(F.col("copies") * F.col("bytes"))).alias("logical_bytes"), zero(F.sum("bytes")).alias("unique_bytes"),
        zero(F.sum((F.col("copies") - 1) * F.col("bytes"))).alias("repeated_bytes"),
        F.count_if(F.col("copies") > 1).alias("duplicate_groups"),
        zero(F.sum(F.when(F.col("bytes") == 0, F.col("copies") - 1))).alias("duplicate_empty_files"),
        F.count_if("_held").alias("already_in_pool"),
        zero(F.sum(F.when(~F.col("_held"), F.col("bytes")))).alias("additional_bytes"))
