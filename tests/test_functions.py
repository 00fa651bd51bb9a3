"""Column functions on hand-made values."""

import base64

import pytest
from pyspark.sql import functions as F

from threadlake.functions import media as M
from threadlake.functions import predicates as P
from threadlake.functions import records as R
from threadlake.functions import scalars as S
from threadlake.functions import text as T
from threadlake.operators import content as C


@pytest.fixture(scope="module")
def evaluate(spark):
    def run(values, make, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[1] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_time_rules(evaluate):
    got = evaluate(["1000", "999999999999", "1000000000000", "2024-01-01T00:00:00Z", "", None, "soon", "0", "1.5"], S.to_millis)
    assert got == [1000000, 999999999999000, 1000000000000, 1704067200000, None, None, None, 0, 1500]


def test_strict_time_rules(evaluate):
    assert evaluate([0.0, 1e12, 1e12 + 1, 5.0, None], S.to_millis_strict, "double") == [None, 10**15, 10**12 + 1, 5000, None]


def test_first_string_skips_zero_and_blank(evaluate):
    assert evaluate([" a ", "0", "", None], lambda v: S.first_string(v, F.lit("z"))) == ["a", "z", "z", "z"]


@pytest.mark.parametrize("record,want", [
    ('{"id":"a","data":{"id":"b","x":1}}', "b"),
    ('{"id":"a","data":{"x":1,"doc":{"id":"c"}}}', "a"),          # data stays the first envelope field
    ('{"id":"a","doc":{"documentData":{"id":"c"}}}', "c"),
    ('{"id":"a","data":[1]}', "a"),
    ('{"id":"a","value":"text"}', "a"),
    ('{"doc":{"documentData":{"data":1,"id":"d"}}}', "d"),
])
def test_unwrap(spark, record, want):
    df = spark.createDataFrame([(record,)], "t string").select(R.parse("t").alias("record"))
    assert R.unwrap(df).select(R.text("r", "id")).first()[0] == want


def test_first_value_and_text_kinds(spark):
    df = spark.createDataFrame([('{"a":0,"b":"0","c":false,"d":{"x":1},"e":" k "}',)], "t string").select(R.fields(R.parse("t")).alias("r"))
    got = df.select(R.first_value("r", ("a", "b")), R.first_value("r", ("c", "e")), R.first_text("r", ("a", "b", "c", "d", "e")),
                    R.first_text("r", ("missing",))).first()
    assert tuple(got) == ("0", " k ", "k", None)


def test_readable_and_response_text(spark):
    texts = {'"x"': "x", '["a",{"text":"b"},{"content":["c",{"value":"d"}]},5]': "a\nb\nc\nd", '{"summary":"s"}': "s", "7": ""}
    df = spark.createDataFrame([(k,) for k in texts], "t string").withColumn("v", R.parse("t"))
    assert {r.t: r.x for r in df.select("t", R.readable_text("v").alias("x")).collect()} == texts
    items = '[{"type":"reasoning","content":[{"text":"hidden"}]},{"type":"message","content":[{"text":"one"}]},{"type":"message","content":"two"}]'
    assert spark.createDataFrame([(items,)], "t string").withColumn("v", R.parse("t")).select(R.response_text("v")).first()[0] == "one\n\ntwo"


def test_canonical_json_ignores_key_order(evaluate):
    a, b = evaluate(['{"b":{"y":1,"x":[2,1]},"a":null}', '{"a":null,"b":{"x":[2,1],"y":1}}'], lambda v: R.canonical_json(R.parse(v)))
    assert a == b


def test_roles(evaluate):
    raw = ["Human", "AI", "model", "tool", "", None, "SystemPrompt", "bot"]
    assert evaluate(raw, S.agent_role) == ["user", "assistant", "assistant", "tool", "assistant", "assistant", "systemprompt", "bot"]
    assert evaluate(raw, S.report_role) == ["user", "ai", "assistant", "tool", "message", "message", "system", "assistant"]


def test_slug_and_artifact_path(evaluate):
    assert evaluate(["Été à la  Plage!", "***", "a" * 90], S.slug) == ["ete-a-la-plage", "untitled-conversation", "a" * 80]
    keep = lambda v: S.artifact_path(F.lit("id/1"), F.lit("T"), v, ".md")
    assert evaluate(["conversations/old.md", "conversations/../x.md", "elsewhere/x.md", None], keep) == [
        "conversations/old.md"] + ["conversations/id-1--t.md"] * 3


def test_fnv_hash(evaluate):
    # published test values of FNV-1a 32
    assert evaluate(["", "a", "foobar"], S.fnv1a32) == ["811c9dc5", "e40c292c", "bf9cf968"]


def test_natural_order(evaluate):
    keys = evaluate(["img10.png", "IMG2.png", "img2b.png"], S.natural_key)
    assert sorted(range(3), key=lambda i: keys[i]) == [1, 2, 0]


def test_schema_compatibility(evaluate):
    assert evaluate(["1.0.0", "0.9.9", "1.0.1", "2.0.0", "1.0", "x", None], S.schema_compatibility) == [
        "current", "migration-required", "unsupported-newer", "unsupported-newer", "invalid", "invalid", "invalid"]


def test_media_paths(evaluate):
    got = evaluate(["media/c1/m1.png", "media/c1/attachments/m1__m2.png", "media/c1", "other/c1/m1.png", "media\\c1\\m2.jpg", "media/c/.hidden"], M.path_parts)
    assert [g and (g.conversation_id, g.message_id, g.attachment) for g in got] == [
        ("c1", "m1", False), ("c1", "m1", True), None, None, ("c1", "m2", False), ("c", ".hidden", False)]


def test_classifiers(spark):
    df = spark.range(1)
    kind = lambda mime, source: df.select(M.media_kind(F.lit(mime), F.lit(source))).first()[0]
    assert [kind("IMAGE/png", ""), kind("", "messageVideos"), kind(None, "x"), kind("text/plain", "studioAudio")] == ["image", "video", "file", "audio"]
    candidate = df.select(M.classify_candidate(F.lit("https://h/a.MOV?x"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0), F.lit(False)).alias("c")).first().c
    assert (candidate.kind, candidate.mime_type, candidate.extension, candidate.status) == ("video", "video/quicktime", "mov", "candidate")


def test_media_reference(evaluate):
    data = "data:image/png;base64," + base64.b64encode(b"x" * 20).decode()
    got = evaluate([data, "data:text/plain,hello", "blob:abc", "https://h/a.png?x", "https://h/page", "//h/video/1", "ftp://h/a.png", ""],
                   lambda v: M.looks_like_reference(v, F.lit("")))
    assert got == [True, False, True, True, False, True, False, False]


def test_correct_extension(evaluate):
    assert evaluate(["a.png", "a.JPEG", "noext", "  ", None, "b.tar.gz"], lambda v: M.correct_extension(v, F.lit(".jpg"))) == [
        "a.jpg", "a.JPEG", "noext", None, None, "b.tar.jpg"]


def test_thumbnails(evaluate):
    assert evaluate(["A_B_v2_thumb.webp", "c_m.png"], lambda v: M.thumbnail_stem(F.lit("x"), v)) == ["a_b", "c_m"]
    assert evaluate(["x/thumbnails/a.png", "x/a_THUMB.png", "x/a.png"], lambda v: M.is_thumbnail(v, F.lit(None).cast("string"))) == [True, True, False]


def test_redaction(evaluate):
    keys = ["encryptionKey", "my-access_token", "tokens", "posthog_x", "chatActiveSessions", "theme", "wagmi.store", "idtoken"]
    got = evaluate(keys, lambda key: P.redaction(key, site="chat"))
    assert [g.redacted for g in got] == [True, True, False, True, True, False, True, True]
    assert not evaluate(["chatActiveSessions"], P.redaction)[0].redacted
    assert got[0].reason.startswith("Authentication") and got[3].reason.startswith("Volatile")


def test_safe_paths(evaluate):
    got = evaluate(["media/a", "/media/a", "media/../a", "media\\a", "media//a", "C:/x", "", None, "media/a..b", "media/./a"], P.safe_path)
    assert got == [True, False, False, False, False, False, False, False, True, False]


def test_path_category(evaluate):
    got = evaluate(["a/.DS_Store", "captures/c/opfs/x", "captures/c/opfs", "media/sha256/ab/x", "stores/x", "captures/c/stores/x.jsonl", "indexes/a"], P.path_category)
    assert got == ["filesystem-metadata", "standalone-asset", "derived-or-metadata", "standalone-asset", "extracted-source", "extracted-source", "derived-or-metadata"]


def test_search_terms(evaluate):
    assert T.search_terms('Two "Big Words" two  x') == ["two", "big words", "x"]
    assert evaluate(['Two "Big Words" two  x', "", None], T.search_terms_column) == [["two", "big words", "x"], [], []]


def test_whole_word_boundaries(evaluate):
    titles = ["Car research", "Cartoon references", "a_car_b", "CAR", "éCar", "car2"]
    assert evaluate(titles, lambda v: T.matches(v, ["car"])) == [True] * 6
    assert evaluate(titles, lambda v: T.matches(v, ["car"], "whole")) == [True, False, True, True, False, False]
    assert evaluate(titles, lambda v: T.matches(v, [])) == [True] * 6  # no term matches everything
    assert evaluate(["c++ (x)"], lambda v: T.matches(v, ["c++"], "whole")) == [True]


def test_excerpt(evaluate):
    long = "x" * 500 + " needle " + "y" * 500
    got = evaluate([long, "short needle", "z" * 600, None], lambda v: T.excerpt(v, ["needle"]))
    assert got[0] == "…" + long[381:801] + "…" and got[1] == "short needle" and got[2] == "z" * 420 + "…" and got[3] == ""


def test_highlight(evaluate):
    assert evaluate(["<b>Tea & team</b>"], lambda v: T.highlight(v, ["tea"])) == ["&lt;b&gt;<mark>Tea</mark> &amp; <mark>tea</mark>m&lt;/b&gt;"]
    assert evaluate(["tea team"], lambda v: T.highlight(v, ["tea"], whole=True)) == ["<mark>tea</mark> team"]


def test_payload_encodings(evaluate):
    raw = bytes(range(1, 30))
    text = base64.b64encode(raw).decode()
    numbers = ",".join(str(b) for b in raw)
    keyed = "{" + ",".join(f'"{i}":{b}' for i, b in enumerate(raw)) + "}"
    view = f'{{"encoded":"{text}","byteOffset":2,"length":5}}'
    got = evaluate([f'"{text}"', f'"data:image/png;base64,{text}"', f"[{numbers}]", keyed, view, '{"a":1}', "7", '"' + text.rstrip("=") + '"'],
                   lambda v: C.decode_payload(R.parse(v)))
    assert [g and bytes(g) for g in got] == [raw, raw, raw, raw, raw[2:7], None, None, raw]


def jpeg(width, height):
    return bytes.fromhex("FFD8FFE00004AAAA") + bytes.fromhex("FFC0000B08") + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes(8)


def test_signatures(spark):
    cases = [
        (bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"), "a.bin", "", ".png", "image/png", 7, 9),
        (jpeg(3, 2), "photo.png", "image/png", ".jpg", "image/jpeg", 3, 2),
        (b"GIF89a" + bytes([5, 0, 6, 0]), "", "", ".gif", "image/gif", 5, 6),
        (b"RIFF0000WEBPVP8X" + bytes(8) + bytes([9, 0, 0, 4, 0, 0]), "", "", ".webp", "image/webp", 10, 5),
        (b"RIFF0000WEBPVP8L0000\x2f" + (4 | (7 << 14)).to_bytes(4, "little") + bytes(6), "", "", ".webp", "image/webp", 5, 8),
        (b"RIFF0000WAVE", "", "", ".wav", "audio/wav", None, None),
        (b"ID3\x00", "", "", ".mp3", "audio/mpeg", None, None),
        (b"\x00\x00\x00\x18ftypisom\x00\x00\x00\x00isomM4A ", "", "", ".m4a", "audio/mp4", None, None),
        (b"\x00\x00\x00\x18ftypisom\x00\x00\x00\x00mp42", "x.mov", "", ".mov", "video/quicktime", None, None),
        (b"\x00\x00\x00\x18ftypavif\x00\x00\x00\x00", "", "", ".avif", "image/avif", None, None),
        (b"%PDF-1.7", "", "", ".pdf", "application/pdf", None, None),
        (b"junk", "x.webm", "", ".webm", "video/webm", None, None),
        (b"junk", "", "audio/flac", ".flac", "audio/flac", None, None),
        (b"junk", "x.zip", "", ".zip", "application/octet-stream", None, None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, content binary, name string, mime string")
    got = {r.i: (r.extension, r.detected_mime, r.width, r.height) for r in C.inspect_objects(df, "content", "name", "mime").collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)}
