"""Column functions that classify media by MIME type, URL, path and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake import constants as K
from threadlake.functions.records import bind
from threadlake.functions.scalars import clean


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(value) for pair in pairs for value in pair])


def media_kind(mime: Column, source: Column, fallback: Column | None = None) -> Column:
    """image, video or audio by MIME type, then by the name of the source."""
    mime = F.lower(F.coalesce(mime, F.lit("")))
    source = F.coalesce(source, F.lit(""))
    other = F.lit("file") if fallback is None else F.coalesce(F.when(fallback != "", fallback), F.lit("file"))
    result = F.when(mime.startswith("image/"), "image")
    for kind in ("video", "audio"):
        result = result.when(mime.startswith(f"{kind}/"), kind)
    for kind in ("image", "video", "audio"):
        result = result.when(source.rlike(f"(?i){kind}"), kind)
    return result.otherwise(other)


def default_mime(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(K.DEFAULT_MIME), F.coalesce(kind, F.lit(""))), F.lit(K.DEFAULT_MIME_OTHER))


def mime_from_url(url: Column, kind: Column) -> Column:
    """MIME type by file extension or data-URL header, else the default of the kind."""
    text = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    declared = F.regexp_extract(text, "^data:([^;,]+)[;,]", 1)
    path = F.regexp_extract(text, r"^([^#?]*)", 1)
    extension = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    known = F.try_element_at(_map(K.URL_MIME_TYPES), extension)
    by_url = F.when(text.startswith("data:"), F.when(declared != "", declared)).otherwise(known)
    return F.coalesce(by_url, default_mime(kind))


def extension_for_mime(mime: Column, kind: Column) -> Column:
    text = F.lower(F.coalesce(mime, F.lit("")))
    known = F.try_element_at(_map(K.MIME_EXTENSIONS), text)
    subtype = F.regexp_replace(F.regexp_extract(text, "([^/]*)$", 1), "[^a-z0-9.+-]", "")
    derived = F.when(text.contains("/"), F.when(subtype == "", "bin").otherwise(subtype))
    default = F.coalesce(
        F.try_element_at(_map(K.DEFAULT_EXTENSION), F.coalesce(kind, F.lit(""))), F.lit(K.DEFAULT_EXTENSION_OTHER)
    )
    return F.coalesce(known, derived, default)


def classify_kind(type_hint: Column, mime: Column, url: Column) -> Column:
    """video, audio, image, file or asset from all hints together."""
    signal = F.lower(F.concat_ws(" ", F.coalesce(type_hint, F.lit("")), F.coalesce(mime, F.lit("")), F.coalesce(url, F.lit(""))))

    def extension(names: str) -> Column:
        return signal.rlike(rf"\.({names})($|[?#])")

    return (
        F.when(signal.contains("video") | extension(K.VIDEO_EXTENSIONS), "video")
        .when(signal.contains("audio") | extension(K.AUDIO_EXTENSIONS), "audio")
        .when(signal.rlike("image|thumbnail|poster") | extension(K.IMAGE_EXTENSIONS), "image")
        .when(signal.rlike("pdf|file|attachment|document"), "file")
        .otherwise("asset")
    )


def classify_candidate(url: Column, mime: Column, type_hint: Column, size: Column, inline: Column) -> Column:
    """Struct of kind, mime_type, extension, exportable, status and reason."""
    url = clean(url)
    resolved = F.coalesce(F.when(clean(mime) != "", clean(mime)), mime_from_url(url, F.coalesce(type_hint, F.lit("asset"))))
    kind = classify_kind(type_hint, resolved, url)
    exportable = (
        url.rlike("(?i)^data:") | F.coalesce(inline, F.lit(False))
        | url.rlike("(?i)^(https?:|blob:|filesystem:|chrome-extension:)")
        | (F.coalesce(size, F.lit(0)) > 0)
    )
    return F.struct(
        kind.alias("kind"), resolved.alias("mime_type"),
        extension_for_mime(resolved, kind).alias("extension"), exportable.alias("exportable"),
        F.when(exportable, "candidate").otherwise("unresolved").alias("status"),
        F.when(~exportable, K.NO_BYTES_REASON).alias("reason"),
    )


def saved_disposition(explicit: Column) -> Column:
    text = F.lower(F.trim(explicit))
    return F.when(text.isin("input", "output"), text)


def media_disposition(explicit: Column, source: Column) -> Column:
    """Explicit input or output, else input for attachments and uploads."""
    return F.coalesce(saved_disposition(explicit), F.when(source.rlike("(?i)attachment|upload"), "input"))


def resolved_disposition(
    explicit: Column, source: Column, path: Column, studio_turn: Column,
    message_model: Column, message_role: Column, source_role: Column,
) -> Column:
    """input, output or media, using the linked message when nothing explicit is saved."""
    source = F.coalesce(source, F.lit(""))
    return (
        F.when(saved_disposition(explicit).isNotNull(), saved_disposition(explicit))
        .when(source.rlike("(?i)attachment|upload") | F.coalesce(path, F.lit("")).rlike("(?i)(^|/)attachments/"), "input")
        .when(F.coalesce(studio_turn, F.lit(False)) & (message_model.isNotNull() | (source_role == "assistant")), "output")
        .when(message_role == "user", "input")
        .when(source.rlike("(?i)messageImages|mindMedia|generated|output|studio(Image|Video|Audio).*Media"), "output")
        .otherwise("media")
    )


def path_parts(path: Column) -> Column:
    """Struct of conversation_id, message_id and attachment for a media path, else null."""
    text = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    pattern = r"^media/([^/]+)/(attachments/)?([^/]+)$"
    attachment = F.regexp_extract(text, pattern, 2) != ""
    # a leading dot is no extension
    stem = F.regexp_replace(F.regexp_extract(text, pattern, 3), r"(?<=.)\.[^.]*$", "")
    message = F.when(attachment, F.regexp_replace(stem, r"(?i)__m\d+$", "")).otherwise(stem)
    return F.when(
        text.rlike(pattern) & (message != ""),
        F.struct(
            F.regexp_extract(text, pattern, 1).alias("conversation_id"),
            message.alias("message_id"), attachment.alias("attachment"), stem.alias("record_id"),
        ),
    )


def page_conversation(path: Column) -> Column:
    """Conversation id inside the path of a captured page, else null."""
    found = F.regexp_extract(
        F.coalesce(path, F.lit("")),
        r"(?i)/(?:chat|agent|mind|video[-/]?studio|image)/(?:[a-z-]+/)?([0-9a-f]{6,}[0-9a-f-]*)", 1,
    )
    return F.when(found != "", found)


def dimension(direct: Column, dimensions: Column, axis: str) -> Column:
    """Width or height: a positive number, else one side of ``W x H``."""
    number = direct.try_cast("double")
    side = F.regexp_extract(F.coalesce(dimensions, F.lit("")), r"(?i)^(\d+)\s*[x×]\s*(\d+)$", 1 if axis == "width" else 2)
    return F.coalesce(F.when(number > 0, number), F.when(side != "", side.try_cast("double"))).cast("bigint")


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)


def is_thumbnail(path: Column, file_name: Column) -> Column:
    path = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    name = F.coalesce(file_name, base_name(path))
    return path.rlike("(?i)(^|/)thumbnails/") | name.rlike(r"(?i)_thumb\.[^.]+$")


def thumbnail_stem(path: Column, file_name: Column) -> Column:
    """Name of the original a thumbnail belongs to."""
    name = F.coalesce(file_name, base_name(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, r"(?i)_thumb$", ""), r"(?i)_v\d+$", ""))


def is_sidecar(path: Column, file_name: Column) -> Column:
    """Internal metadata file that stands next to a payload."""
    return (
        F.coalesce(file_name, F.lit("")).rlike(r"(?i)^[a-f0-9]{64}\.meta$")
        | F.coalesce(path, F.lit("")).rlike(r"(?i)(^|/)video-editor/.*/[a-f0-9]{64}\.meta$")
    )


def correct_extension(name: Column, detected: Column) -> Column:
    """File name with the detected extension; jpg and jpeg are the same."""
    text = F.trim(F.coalesce(name, F.lit("")))
    current = F.lower(F.regexp_extract(text, r"(?i)(\.[a-z0-9][a-z0-9+-]{0,11})$", 1))
    jpeg = (".jpg", ".jpeg")
    same = (current == F.lower(detected)) | (current.isin(*jpeg) & F.lower(detected).isin(*jpeg))
    keep = F.coalesce(detected, F.lit("")).isin("") | (current == "") | same
    stem = F.regexp_replace(text, r"(?i)\.[a-z0-9][a-z0-9+-]{0,11}$", "")
    return F.when(text == "", None).when(keep, text).otherwise(F.concat(stem, detected))


def looks_like_reference(url: Column, hint: Column) -> Column:
    """Does a text, found under the key ``hint``, point at media?"""
    text = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    header = F.regexp_extract(text, "^([^,]*),", 1)
    body = F.regexp_extract(text, "(?s)^[^,]*,(.*)$", 1)
    inline = (F.instr(text, ",") > 1) & header.rlike(";base64(;|$)") & is_base64_text(body)
    web = text.startswith("http://") | text.startswith("https://") | text.startswith("//")
    named = (
        text.rlike(rf"\.({K.REFERENCE_EXTENSIONS})($|[?#])") | text.rlike("/(image|video|audio)/")
        | text.rlike("[?&](mime|mimetype|contenttype|format|ext)=")
        | F.coalesce(hint, F.lit("")).rlike(f"(?i){K.REFERENCE_HINTS}")
    )
    return (
        F.when(text == "", False).when(text.startswith("data:"), inline)
        .when(text.startswith("blob:"), True).otherwise(web & named)
    )


def is_attachment_reference(url: Column, hint: Column, type_hint: Column, has_file_identity: Column) -> Column:
    return (
        F.lower(F.coalesce(hint, F.lit(""))).rlike(K.ATTACHMENT_HINTS)
        | F.lower(F.coalesce(type_hint, F.lit(""))).rlike(K.ATTACHMENT_TYPES)
        | F.coalesce(has_file_identity, F.lit(False))
        | F.coalesce(url, F.lit("")).rlike(rf"(?i)\.({K.ATTACHMENT_EXTENSIONS})($|[?#])")
    )


def _without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def _is_base64(body: Column) -> Column:
    return (
        (body != "") & ~body.startswith("__") & ~body.contains("__ENCRYPTED")
        & (F.length(body) % 4 != 1) & body.rlike("^[A-Za-z0-9+/_-]*={0,2}$")
    )


def is_base64_text(text: Column) -> Column:
    """Base64 alphabet, possible length, no placeholder marker."""
    return bind(_without_space(text), _is_base64)


def is_base64_payload(text: Column) -> Column:
    return bind(_without_space(text), lambda body: (F.length(body) >= 16) & _is_base64(body))


def extension_of(name: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(name), r".(\.[^.]*)$", 1))


def _ascii(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def leading_hex(content: Column) -> Column:
    """First 64 bytes as hex digits; all a signature needs."""
    return F.hex(F.substring(content, 1, 64))


def signature_extension(head: Column, size: Column, file_name: Column, mime_hint: Column) -> Column:
    """Extension that the leading bytes prove, else null.  ``head`` is :func:`leading_hex`."""
    def at(start: int, text: str) -> Column:
        return F.substring(head, 2 * start + 1, 2 * len(text)) == _ascii(text)

    # brands of an ISO container stand at byte 8 and from byte 16 on, four bytes each
    def brand(names: tuple[str, ...]) -> Column:
        codes = "|".join(_ascii(name) for name in names)
        return head.rlike(f"^.{{16}}({codes})") | head.rlike(f"^.{{32}}(.{{8}})*({codes})")

    extension = extension_of(F.coalesce(file_name, F.lit("")))
    sound = (
        F.coalesce(mime_hint, F.lit("")).rlike("(?i)^audio/") | extension.isin(".m4a", ".m4b", ".m4p", ".aac")
        | brand(("M4A ", "M4B ", "M4P "))
    )
    container = (
        F.when(brand(("avif", "avis")), ".avif").when(sound, F.when(extension == ".aac", ".aac").otherwise(".m4a"))
        .when((extension == ".mov") | brand(("qt  ",)), ".mov").otherwise(".mp4")
    )
    return (
        F.when(head.startswith("89504E470D0A1A0A"), ".png")
        .when((size >= 4) & head.startswith("FFD8"), ".jpg")
        .when((size >= 10) & at(0, "GIF8"), ".gif")
        .when(at(0, "RIFF") & at(8, "WEBP"), ".webp")
        .when(at(0, "RIFF") & at(8, "WAVE"), ".wav")
        .when(at(0, "fLaC"), ".flac")
        .when(at(0, "ID3") | head.rlike("^FF[EF]"), ".mp3")
        .when(at(0, "OggS"), ".ogg")
        .when((size >= 12) & at(4, "ftyp"), container)
        .when(at(0, "%PDF"), ".pdf")
    )


def header_size(head: Column, size: Column, extension: Column, axis: str) -> Column:
    """Width or height from a PNG, GIF or WebP header, else null."""
    wide = axis == "width"

    def number(start: int, length: int, little: bool = True) -> Column:
        pairs = [F.substring(head, 2 * i + 1, 2) for i in range(start, start + length)]
        return F.conv(F.concat(*(reversed(pairs) if little else pairs)), 16, 10).cast("bigint")

    chunk = F.substring(head, 25, 8)
    packed = number(21, 4)
    webp = (
        F.when((chunk == _ascii("VP8X")) & (size >= 30), number(24 if wide else 27, 3) + 1)
        .when((chunk == _ascii("VP8 ")) & (size >= 30) & (F.substring(head, 47, 6) == "9D012A"), number(26 if wide else 28, 2) % 16384)
        .when((chunk == _ascii("VP8L")) & (size >= 25) & (F.substring(head, 41, 2) == "2F"),
              (packed if wide else F.shiftright(packed, 14)) % 16384 + 1)
    )
    return (
        F.when((extension == ".png") & (size >= 24), number(16 if wide else 20, 4, False))
        .when(extension == ".gif", number(6 if wide else 8, 2)).when(extension == ".webp", webp)
    )


def type_of_extension(extension: Column, field: str) -> Column:
    """MIME type or kind of a known file extension, else null."""
    index = {"mime_type": 1, "kind": 2}[field]
    return F.try_element_at(_map([(row[0], row[index]) for row in K.FILE_TYPES]), extension)


def extension_of_mime(mime: Column) -> Column:
    """First known extension of a MIME type, else null."""
    first: dict[str, str] = {}
    for extension, known, _ in K.FILE_TYPES:
        first.setdefault(known, extension)
    return F.try_element_at(_map(list(first.items())), F.lower(F.coalesce(mime, F.lit(""))))
