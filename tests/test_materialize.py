"""Materialization: versions, a run that is killed before its manifest, names, links, objects."""

import base64
import hashlib
import json

import pytest

from threadlake.functions import records as R
from threadlake.operators import materialize as L
from threadlake.session import workspace
from pyspark.sql import functions as F

GIF = b"GIF89aABCD"


def b64(data):
    return base64.b64encode(data).decode()


def records(spark, rows):
    return spark.createDataFrame([(s, i, c, n, json.dumps(r)) for n, (s, i, c, r) in enumerate(rows)], "store string, record_id string, capture bigint, line bigint, j string").select(
        "store", "record_id", "capture", "line", R.parse("j").alias("record"))


def messages(spark, rows):
    return spark.createDataFrame(rows, "id string, conversation_id string, created_ms bigint, text string, role string, model string")


def test_versions_survive_a_killed_run(spark, monkeypatch):
    base = workspace(spark, "killed")
    said = messages(spark, [("m1", "c1", 5, "a prompt", "assistant", "model-x")])
    first = [("s", "r1", 1, {"contentBinary": b64(GIF + b"1"), "messageId": "m1"}), ("s", "r2", 1, {"binaryContent": b64(GIF + b"1"), "fileName": "a.png"}), ("s", "r3", 1, {"x": 1})]
    assert L.publish(base, records(spark, first), said, apply=False).first().added == 2 and L.manifest(spark, base).count() == 0
    assert tuple(L.publish(base, records(spark, first), said).first()) == (3, 2, 2, 22)
    old = sorted(map(tuple, L.items(spark, base).collect()), key=repr)
    second = [*first, ("s", "r1", 2, {"contentBinary": b64(GIF + b"2"), "messageId": "m1"}), ("s", "r1", 2, {"contentBinary": b64(GIF + b"3"), "messageId": "m1"}), ("s", "r4", 2, {"contentBinary": "!"})]

    # the run ends before the manifest, and leaves a staged table behind
    monkeypatch.setattr(L, "_put_objects", lambda rows, pool: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        L.publish(base, records(spark, second), said)
    monkeypatch.undo()
    spark.createDataFrame([("junk", "s", "r1")], "media_id string, store string, record_id string").write.parquet(f"{base}/items/version=1")
    assert sorted(map(tuple, L.items(spark, base).collect()), key=repr) == old and L.manifest(spark, base).count() == 1

    # what was staged is overwritten; the record had two contents in one capture: both are versions, the last is latest
    assert tuple(L.publish(base, records(spark, second), said).first()) == (3, 3, 2, 22)
    got = {r.media_id: r for r in L.items(spark, base).collect()}
    assert len(got) == 4 and "junk" not in got
    assert sorted((r.record_id, r.is_latest) for r in got.values()) == [("r1", False), ("r1", False), ("r1", True), ("r2", True)]
    assert {r.sha for r in got.values() if r.record_id == "r1" and r.is_latest} == {hashlib.sha256(GIF + b"3").hexdigest()}
    assert spark.read.parquet(f"{base}/objects").count() == 3  # equal bytes of two records are one object
    assert tuple(L.publish(base, records(spark, second), said).first()) == (0, 0, 0, 0)
    assert len(L.items(spark, base).collect()) == 4


def test_names_links_and_later_messages(spark):
    base = workspace(spark, "names")
    rows = [
        ("s", "r1", 1, {"contentBinary": b64(GIF), "messageId": "m1", "fileName": "my_shot.jpeg", "prompt": "own"}), ("s", "r2", 1, {"contentBinary": b64(GIF), "message_id": "m2", "name": "shot.png"}),
        ("s", "m3", 1, {"contentBinary": [71, 73, 70, 56, 57, 97, 1, 0, 2, 0]}), ("s", "r4", 1, {"contentBinary": b64(b"plain bytes"), "fileName": "x.png"}), ("s", "r5", 1, {"contentBinary": b64(b"plain bytes")})]
    L.publish(base, records(spark, rows), messages(spark, [("m1", "c1", 5, "said", "user", "ignored")]))
    name = lambda: {r.record_id: (r.file_name, r.conversation_id, r.prompt, r.model, r.mime_type) for r in L.items(spark, base).collect()}
    assert name() == {
        "r1": ("my_shot.gif", "c1", "own", None, "image/gif"), "r2": ("shot.gif", None, None, None, "image/gif"), "m3": ("m3.gif", None, None, None, "image/gif"),
        "r4": ("x.png", None, None, None, "image/png")}
    # messages that come later complete older items; the message id that stands in two conversations counts once
    later = messages(spark, [("m1", "c1", 5, "said", "user", None), ("m2", "c2", 7, "late", "assistant", "mod"), ("m3", "c3", 8, "", "user", None), ("m3", "c4", 9, "twice", "user", None)])
    assert L.publish(base, records(spark, rows), later).first().added == 0
    assert name() == {
        "r1": ("my_shot.gif", "c1", "own", None, "image/gif"), "r2": ("c2_m2.gif", "c2", "late", "mod", "image/gif"), "m3": ("c4_m3.gif", "c4", "twice", None, "image/gif"),
        "r4": ("x.png", None, None, None, "image/png")}


def test_back_to_older_content(spark):
    base = workspace(spark, "back")
    say = lambda c, x: ("s", "r", c, {"contentBinary": b64(GIF + x)})
    none = messages(spark, [])
    rows = []
    for capture, content in enumerate([b"a", b"b", b"a", b"a"]):
        rows.append(say(capture, content))
        L.publish(base, records(spark, rows), none)
    assert [r.added for r in L.manifest(spark, base).orderBy("version").collect()] == [1, 1, 0, 0]
    assert sorted((r.capture, r.is_latest) for r in L.items(spark, base).collect()) == [(1, False), (2, True)]
