"""Operators on the small cases the record formats call for."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from threadlake.functions import records as R
from threadlake.operators import changes as D
from threadlake.operators import content as C
from threadlake.operators import gallery as G
from threadlake.operators import links as L
from threadlake.operators import merge as X
from threadlake.operators import nested as N
from threadlake.operators import normalize as Z
from threadlake.operators import overlay as V
from threadlake.operators import rollups as U
from threadlake.operators import search as K
from threadlake.operators import sets as Q
from threadlake.operators import verify as W
from threadlake.session import workspace
from threadlake.sources import captures as P
from threadlake.sources import files as I
from threadlake.sources import records as S
from threadlake.streaming import ingest as T

MESSAGES = "conversation_id string, id string, seq bigint, role string, model string, text string, created_ms bigint"


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([
        ("c1", "u1", 0, "user", None, "draw a fox", 1000), ("c1", "a1", 1, "assistant", "m1", "done", 2000),
        ("c1", "a2", 2, "assistant", "m2", "", 3000), ("c1", "a3", 3, "assistant", "m1", "more", 4000),
        ("gone", "g1", 0, "user", None, "lost and found", 500),
    ], MESSAGES)


def test_roll_up_counts_models_and_orphans(spark, messages):
    conversations = spark.createDataFrame([("c1", "Fox", "chat"), ("c2", None, "agentic")], "id string, title string, kind string")
    media = spark.createDataFrame([("c1",), ("c1",), (None,)], "conversation_id string")
    got = {r.id: r for r in U.roll_up(conversations, messages, media).collect()}
    assert set(got) == {"c1", "c2", "gone"}
    c1 = got["c1"]
    assert (c1.message_count, c1.media_count, c1.models, c1.preview, c1.updated_ms) == (4, 2, ["m1", "m2"], "draw a fox", 4000)
    assert got["c2"].title == "Untitled conversation" and got["c2"].message_count == 0
    assert (got["gone"].title, got["gone"].kind) == ("Recovered conversation", "recovered")


def test_list_limits_and_order(spark, messages):
    conversations = spark.createDataFrame([("c1", "b", "chat"), ("c2", "A", "chat")], "id string, title string, kind string")
    rows = U.roll_up(conversations, messages)
    assert [r.id for r in U.list_conversations(rows, "recent", 2).collect()] == ["c1", "gone"]
    assert [r.id for r in U.list_conversations(rows, "title", 0).collect()] == ["c2"]


def test_titles(spark):
    conversations = spark.createDataFrame([("a", " My  title "), ("b", None), ("c", "")], "id string, title string")
    said = spark.createDataFrame([("b", 0, "  "), ("b", 1, "w " * 100)], "conversation_id string, seq int, text string")
    got = {r.id: r.title for r in U.conversation_titles(conversations, said).collect()}
    assert got == {"a": "My title", "b": ("w " * 60).strip() + "...", "c": "Untitled conversation"}


def test_prefer_first_keeps_zero_and_fills_blank(spark, rows):
    layers = spark.createDataFrame([
        ("k", 0, 0, "", 0, None), ("k", 1, 0, "two", 5, "x"), ("k", 2, 0, "three", 6, "y"), ("l", 2, 1, "late", None, None),
    ], "id string, rank int, line int, a string, n int, b string")
    assert rows(X.prefer_first(layers, ["id"], ["rank", "line"], ["a", "n", "b"])) == [("k", "two", 0, "x"), ("l", "late", None, None)]


def test_media_location_follows_the_first_available_row(spark):
    layers = spark.createDataFrame([
        ("k", 0, False, "old", "lost.png", None), ("k", 1, True, "new", "a.png", "image/png"), ("k", 2, True, "newer", "b.png", "image/jpeg"),
        ("m", 0, False, "x", None, None), ("m", 1, False, "y", "p.png", None),
    ], "id string, rank int, available boolean, title string, path string, mime string")
    got = {r.id: r for r in X.prefer_first_media(layers, ["id"], ["rank"], ["title", "path", "mime"], ["path", "mime"]).collect()}
    assert (got["k"].title, got["k"].available, got["k"].path, got["k"].mime) == ("old", True, "a.png", "image/png")
    assert (got["m"].title, got["m"].available, got["m"].path) == ("x", False, "p.png")


def test_layers_in_any_order_merge_the_same(spark, rows):
    data = [(i % 7, i % 3, i, "" if i % 2 else f"v{i}") for i in range(60)]
    merged = lambda d: rows(X.prefer_first(spark.createDataFrame(d, "id int, rank int, line int, a string"), ["id"], ["rank", "line"], ["a"]))
    assert merged(data) == merged(data[::-1])


def test_recovered_conversation_gives_way(spark, rows):
    df = spark.createDataFrame([("recovered", "m1"), ("recovered", "m2"), ("c", "m1")], "conversation_id string, id string")
    assert rows(X.drop_superseded_recovered(df)) == [("c", "m1"), ("recovered", "m2")]


def test_inputs_show_at_the_preceding_user_message(spark, messages):
    items = spark.createDataFrame([
        ("i1", "c1", "u1", "input", "s"), ("i2", "c1", "a1", "input", "s"), ("o1", "c1", "a2", "output", "s"), ("n1", "c1", None, None, "x"),
        ("at", "c1", "a1", None, "fileAttachments"),
    ], "media_id string, conversation_id string, message_id string, disposition string, source string")
    got = {r.media_id: r for r in G.display_message(items, messages, width=1).collect()}
    assert [got[i].display_message_id for i in ("i1", "i2", "o1", "n1", "at")] == ["u1", "u1", "a2", None, "u1"]
    assert (got["i2"].model, got["o1"].model, got["n1"].disposition, got["at"].disposition) == (None, "m2", "media", "input")
    assert got["i1"].uploaded and not got["o1"].uploaded


FILES = "media_id string, conversation_id string, message_id string, kind string, available boolean, sha string, is_thumbnail boolean, stem string"


def test_suppression_rules(spark):
    items = spark.createDataFrame([
        ("full", "C", "M", "image", True, "h1", False, "full"), ("thumb", None, None, "image", True, "t", True, "c_m"),
        ("other-thumb", None, None, "image", True, "t2", True, "x_y"), ("placeholder", "C", "M", "image", False, None, False, "p"),
        ("video-placeholder", "C", "M", "video", False, None, False, "p"), ("loose", None, None, "image", True, "h1", False, "l"),
        ("loose-elsewhere", "D", None, "image", True, "h1", False, "l"), ("loose-same", "C", None, "image", True, "h1", False, "l"),
        ("repeat", "C", "M", "image", True, "h1", False, "r"), ("second-message", "C", "N", "image", True, "h1", False, "r"),
    ], FILES)
    kept = {r.media_id for r in G.suppress_covered(items).collect()}
    assert kept == {"full", "other-thumb", "video-placeholder", "loose-elsewhere", "second-message"}


def test_recover_by_hash(spark):
    items = spark.createDataFrame([
        ("good", "m1", "image", True, "h", "materialized", "capture", 10, "image/png", False),
        ("worse", "m2", "image", True, "h", "materialized", "recovered media", 11, "image/png", True),
        ("alias", "m3", "file", False, "h", "missing", "capture", None, None, False),
        ("covered", "m1", "image", False, "h", "missing", "capture", None, None, False),
        ("unknown", "m4", "image", False, "zz", "missing", "capture", None, None, False),
    ], "media_id string, message_id string, kind string, available boolean, sha string, status string, archive_source string, bytes int, mime_type string, format_corrected boolean")
    got = {r.media_id: r for r in G.recover_by_hash(items).collect()}
    assert (got["alias"].available, got["alias"].status, got["alias"].bytes, got["alias"].kind, got["alias"].donor_id) == (True, "deduped", 10, "image", "good")
    assert not got["covered"].available and not got["unknown"].available and got["good"].donor_id is None
    assert len(got) == 5


def test_listing_facets_order(spark):
    # a hidden upload, a hidden image, a favourite video, a plain image
    items = spark.createDataFrame([
        (1, "image", True, True, True, False), (2, "image", True, False, True, False), (3, "video", True, False, False, True),
        (4, "image", True, False, False, False), (5, "audio", False, False, False, False),
    ], "media_id int, kind string, available boolean, is_uploaded boolean, hidden boolean, favourite boolean").withColumns({
        "file_name": F.lit("f"), "prompt": F.lit(None).cast("string"), "mime_type": F.lit("x"), "source": F.lit("s"), "is_thumbnail": F.lit(False)})
    facets = G.listing_facets(G.listing_stages(items), "video").first().asDict()
    assert facets == {"uploads": 1, "hidden": 0, "favourites": 1, "all": 2, "image": 1, "video": 1, "audio": 0, "file": 0, "total": 1}
    assert {r.media_id for r in G.listing_rows(G.listing_stages(items)).collect()} == {3, 4}
    assert G.listing_facets(G.listing_stages(items), "image", include_hidden=True).first().total == 2


def test_preference_keys(spark):
    keys = spark.createDataFrame([("AB", 1), ("", 2), (None, 3)], "sha string, id int").select(G.preference_key(F.col("sha"), F.col("id"))).collect()
    assert [k[0] for k in keys] == ["sha256:ab", "id:2", "id:3"]


def test_inventory_diff(spark, rows):
    make = lambda d: spark.createDataFrame(list(d.items()), "path string, signature string")
    diff = D.inventory_diff(make({"a": "1:10", "b": "2:20", "d": "5"}), make({"a": "1:11", "c": "3:30", "d": "5"}), "path", "signature")
    assert rows(diff) == [("a", "modified"), ("b", "removed"), ("c", "created")]


STORES = "name string, records bigint, fingerprint string"


def test_changed_core_store_rereads_all_core_stores(spark, rows):
    before = spark.createDataFrame([("conversations", 1, "a"), ("messages", 2, "b"), ("settings", 1, "s"), ("bare", 1, None)], STORES)
    now = spark.createDataFrame([("conversations", 1, "a"), ("messages", 3, "c"), ("settings", 1, "s"), ("bare", 1, None)], STORES)
    assert rows(D.incremental_stores(before, now)) == [("bare", "read"), ("conversations", "read"), ("messages", "read"), ("settings", "skip")]
    gone = now.where("name <> 'messages'")
    assert ("conversations", "read") in rows(D.incremental_stores(before, gone)) and ("messages", "removed") in rows(D.incremental_stores(before, gone))
    assert ("conversations", "skip") in rows(D.incremental_stores(before, before))


def test_files_without_time_are_read_again(spark, rows):
    schema = "path string, bytes bigint, modified bigint"
    before = spark.createDataFrame([("a", 1, 5), ("b", 1, 0), ("c", 1, 5)], schema)
    now = spark.createDataFrame([("a", 1, 5), ("b", 1, 0), ("c", 2, 5), ("d", 1, 1)], schema)
    files = D.incremental_files(before, now)
    assert rows(files) == [("a", "skip"), ("b", "read"), ("c", "read"), ("d", "read")]
    summary = D.plan_summary(D.incremental_stores(spark.createDataFrame([], STORES), spark.createDataFrame([], STORES)), files).first()
    assert (summary.files_read, summary.files_skip, summary.unchanged) == (3, 1, False)


@pytest.mark.parametrize("paths,want", [
    (["IndexedDB/x"], (False, True, False, False)), (["File System/x", "Local Storage/y"], (True, False, True, False)),
    (["Session Storage/x"], (True, True, False, True)), (["Cache/x"], (False, False, False, False)), ([], (False, False, False, False)),
])
def test_read_scope(spark, paths, want):
    changes = spark.createDataFrame([(p,) for p in paths], "path string")
    assert tuple(D.read_scope(changes).first()) == want


def test_registry_tombstones(spark):
    ids = lambda *names: spark.createDataFrame([(n, f"t-{n}") for n in names], "id string, title string")
    registry = D.empty_registry(ids("a"), ["title"])
    states = []
    for now, present in ((1, "ab"), (2, "a"), (3, "a"), (4, "ab")):
        registry = D.upsert_registry(registry, ids(*present), F.lit(now).cast("bigint"), ["title"])
        states.append({r.id: (r.status, r.last_seen, r.tombstoned_at) for r in registry.collect()})
    assert states[1]["b"] == ("tombstoned", 1, 2) and states[2]["b"] == ("tombstoned", 1, 2) and states[3]["b"] == ("active", 4, None)
    again = D.upsert_registry(registry, ids("a", "b"), F.lit(4).cast("bigint"), ["title"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, registry.collect()))


def test_missing_hash_counts_as_changed(spark, rows):
    make = lambda d: spark.createDataFrame(list(d.items()), "id string, record_hash string")
    plan = D.write_plan(make({"a": "1", "b": "2", "c": None, "d": "4"}), make({"a": "1", "b": "x", "c": None, "e": "5"}))
    assert rows(plan) == [("a", "skipped"), ("b", "changed"), ("c", "changed"), ("d", "tombstoned"), ("e", "added")]
    assert tuple(D.write_totals(plan).first()) == (1, 2, 1, 1)


def test_compare_sides_looks_at_ids_only(spark, rows):
    ids = lambda names: spark.createDataFrame([(n,) for n in names], "id string")
    said = lambda pairs: spark.createDataFrame(pairs, "conversation_id string, id string")
    got = D.compare_sides(ids("abcd"), ids("bcde"), said([("b", "1"), ("c", "1"), ("c", "2")]), said([("b", "1"), ("c", "1"), ("c", "3"), ("e", "9")]))
    assert rows(got, "id", "status") == [("a", "restore"), ("b", "synced"), ("c", "conflict"), ("d", "synced"), ("e", "backup-new")]
    state = D.sync_state(got).first()
    assert (state.state, state.relation) == ("needs_check", "DIVERGED")


def test_multiset_equality(spark):
    make = lambda values: spark.createDataFrame([(v,) for v in values], "v string")
    assert Q.multiset_equal(make("aab"), make("aba"), ["v"]).first().equal
    result = Q.multiset_equal(make("aab"), make("abc"), ["v"]).first()
    assert (result.equal, result.left_only, result.right_only) == (False, 1, 1)


def test_generation_overlay_and_cycles(spark, rows):
    gens = spark.createDataFrame([("g3", "g2"), ("g2", "g1"), ("g1", None), ("x", "y"), ("y", "x")], "gen_id string, base_gen_id string")
    entries = spark.createDataFrame([("g1", "p", "1", 1), ("g1", "q", "1", 1), ("g3", "p", "3", 1), ("x", "p", "9", 1)], "gen_id string, path string, sha string, bytes int")
    got = V.overlay(entries, V.generation_chain(gens, "g3"))
    assert rows(got, "path", "gen_id", "depth") == [("p", "g3", 0), ("q", "g1", 2)]
    with pytest.raises(Exception, match="cyclic or too deep|recursion"):
        V.generation_chain(gens, "x").collect()


def test_retention_plan(spark, rows):
    snapshots = spark.createDataFrame([("1", True, True), ("2", False, True), ("3", True, True), ("4", True, True), ("5", True, False)], "snapshot_id string, verified boolean, managed boolean")
    assert rows(V.retention_plan(snapshots, 2), "snapshot_id", "action") == [("1", "prune"), ("2", "untouched"), ("3", "keep"), ("4", "keep"), ("5", "untouched")]


def test_payload_versions(spark):
    # a -> b -> a points back to a without a new row
    df = spark.createDataFrame([("r", 0, "A"), ("r", 1, "B"), ("r", 2, "A"), ("r", 3, "A")], "record string, capture int, sha string")
    got = {r.capture: (r.changed, r.version_added) for r in C.payload_versions(df, ["record"], "capture", "sha").collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (True, False), 3: (False, False)}


def test_duplicate_audit_numbers(spark):
    text = {"x": 5, "y": 7, "z": 3}
    files = spark.createDataFrame([("x", 5, "a", "m"), ("x", 5, "b", "m"), ("x", 5, "c", "n"), ("y", 7, "a", "m"), ("z", 3, "a", "m")], "sha string, bytes bigint, layer string, category string")
    pool = spark.createDataFrame([("x",), ("y",), ("z",)], "sha string")
    total = C.duplicate_summary(files, pool).first()
    assert (total.files, total.distinct_contents, total.repeated_bytes, total.additional_bytes) == (5, 3, 2 * text["x"], 0)
    assert total.unique_bytes + total.repeated_bytes == total.logical_bytes
    group = C.duplicate_groups(files).first()
    assert (group.copies, group.layers, group.categories) == (3, 3, 2)
    assert sorted((r.layer, r.category, r.copies) for r in C.duplicate_members(files).collect()) == [("a", "m", 1), ("b", "m", 1), ("c", "n", 1)]


def test_first_seen_against_a_pool(spark, rows):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, sha string")
    pool = spark.createDataFrame([("b",)], "sha string")
    assert rows(C.first_seen(items, "sha", ["id"], "id", pool), "id", "status") == [
        (1, "materialized"), (2, "deduped"), (3, "deduped"), (4, "materialized")]


def test_recovery_import_is_idempotent(spark):
    known = spark.createDataFrame([("a",)], "id string")
    incoming = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], "id string, line int")
    added = X.recover_messages(known, incoming, ["id"], ["line"])
    assert [tuple(r) for r in added.collect()] == [("b", 1)]
    assert X.recover_messages(known.unionByName(added.select("id")), incoming, ["id"], ["line"]).count() == 0


def test_missing_match_confidence(spark, rows):
    missing = spark.createDataFrame([("a", "m1", "image", "A.png"), ("b", "m2", "image", None), ("c", "m9", "image", None)], "id string, message_id string, kind string, file_name string")
    found = spark.createDataFrame([("m1", "image", "h", "f1", 1, "a.PNG"), ("m1", "image", "h", "f2", 1, None), ("m2", "image", None, "f3", 1, None), ("m2", "image", None, "f3", 2, None)],
                                  "message_id string, kind string, sha string, file string, bytes int, file_name string")
    assert rows(L.missing_matches(missing, found)) == [("a", 2, 1, "high", "h", 1), ("b", 2, 2, "ambiguous", None, 0)]


def test_restore_selection(spark, rows):
    selected = spark.createDataFrame([("c1",)], "id string")
    said = spark.createDataFrame([("c1", "m1"), ("c2", "m2")], "conversation_id string, id string")
    ids = spark.createDataFrame([("c1", "m1"), ("c1", "zz"), ("c2", "m1")], "conversation_id string, message_id string")
    images = spark.createDataFrame([("c9", "m1"), ("c1", None), ("c2", "m2"), ("c1", "m1")], "conversation_id string, message_id string")
    picked, picked_ids, picked_images = L.restore_selection(selected, said, ids, images)
    assert rows(picked) == [("c1", "m1")] and rows(picked_ids, "conversation_id", "message_id") == [("c1", "m1")]
    assert rows(picked_images, "conversation_id", "message_id") == [("c1", "m1"), ("c1", None), ("c9", "m1")]


def test_settings_resolution(spark, rows):
    settings = spark.createDataFrame([("o1", False, 0, "one"), ("o2", True, 1, "two")], "owner_id string, is_default boolean, line_no int, name string")
    owners = spark.createDataFrame([(1, "o1", "o2"), (2, "x", "o2"), (3, "x", None)], "id int, a string, b string")
    assert rows(L.resolve_settings(owners, ["a", "b"], settings, "owner_id"), "id", "matched_by", "name") == [(1, "a", "one"), (2, "b", "two"), (3, "default", "two")]


# ---------------------------------------------------------------- verification

def test_capture_verification(spark):
    declared = spark.createDataFrame([("a", 2, None), ("b", 2, 3), ("c", 1, 1)], "name string, records int, expected_records int")
    actual = spark.createDataFrame([("a", 2), ("b", 1)], "name string, lines int")
    stores = W.verify_stores(declared, actual)
    assert {r.name: len(r.errors) for r in stores.collect()} == {"a": 0, "b": 2, "c": 1}
    files = W.verify_files(spark.createDataFrame([("p", 11, "h")], "path string, bytes int, sha string"), spark.createDataFrame([("p", 11, "h")], "path string, bytes int, sha string"))
    report = W.capture_report(stores.where("name = 'a'"), files).first()
    assert (report.stores, report.store_records, report.files, report.file_bytes, report.ok) == (1, 2, 1, 11, True)
    assert not W.capture_report(stores, files).first().ok
    assert not W.capture_report(stores.limit(0), files).first().ok  # at least one store is needed


def test_coverage_gate(spark):
    names = lambda rows: spark.createDataFrame(rows, "name string, records int")
    got = W.coverage(spark.createDataFrame([("old",), ("a",)], "name string"), names([("a", 2), ("new", 3), ("none", 0), ("bad", None)]), names([("a", 2), ("new", 1)]))
    assert {r.name: (r.status, r.violation, r.discovered) for r in got.collect()} == {
        "old": ("absent", False, False), "a": ("ok", False, False), "new": ("mismatch", True, True), "none": ("empty", False, True), "bad": ("uncounted", True, True)}


# ---------------------------------------------------------------- sources

def test_stores_with_blank_and_broken_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id":1}\n\n  \n{"id":2}\n{"id":3}\n')
    got = S.read_store(spark, str(tmp_path), numbered=True).select("line_no", F.variant_get("record", "$.id", "int").alias("id"))
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 2), (2, 3)]
    (tmp_path / "t.jsonl").write_text('{"id":4}\n{"id":')
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_store(spark, str(tmp_path)).collect()
    good, bad = S.read_store_lenient(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (4, 1)


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"n": i, "pad": "x" * (i % 50)}) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows = S.read_store(spark, str(tmp_path), numbered=True).select("line_no", F.variant_get("record", "$.n", "int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 2000 and all(r.line_no == r.n for r in rows)


def test_json_documents(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{\n "a": 1}')
    assert [r.a for r in S.read_json_doc(spark, str(tmp_path / "ok.json"), "a int").collect()] == [1]
    assert S.read_json_doc(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    (tmp_path / "bad.json").write_text("[{")
    assert S.read_json_doc(spark, str(tmp_path / "bad.json"), "a int").collect() == []
    (tmp_path / "list.json").write_text('[{"a":1},\n{"a":2}]')
    assert S.read_json_array(spark, str(tmp_path / "list.json"), "a int").agg(F.sum("a")).first()[0] == 3
    with pytest.raises(Exception):
        S.read_json_array(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_file_hashes_see_middle_bytes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"A" * 40 + b"1" + b"Z" * 40)
    (tmp_path / "d" / "b.bin").write_bytes(b"A" * 40 + b"2" + b"Z" * 40)
    hashed = I.hash_files(spark, str(tmp_path)).collect()
    assert {r.path for r in hashed} == {"d/a.bin", "d/b.bin"} and len({r.sha for r in hashed}) == 2
    assert {r.bytes for r in I.scan_files(spark, str(tmp_path)).collect()} == {81}


def test_a_file_over_two_gigabytes_is_hashed_in_chunks(spark, tmp_path):
    size = 3 << 30
    (tmp_path / "part=a b").mkdir()
    with open(tmp_path / "part=a b" / "100%25.bin", "wb") as sparse:
        sparse.truncate(size)
    (tmp_path / "one.bin").write_bytes(b"1")
    zeros, digest = bytes(1 << 24), hashlib.sha256()
    for _ in range(size >> 24):
        digest.update(zeros)
    hashed = {r.path: (r.bytes, r.sha) for r in I.hash_files(spark, str(tmp_path)).collect()}
    assert hashed == {"part=a b/100%25.bin": (size, digest.hexdigest()), "one.bin": (1, hashlib.sha256(b"1").hexdigest())}
    assert I.hash_files(spark, str(tmp_path)).columns == ["path", "bytes", "sha"]


def test_capture_layers(spark, rows):
    captures = spark.createDataFrame([("capture-2", True), ("capture-3", False), ("capture-1", True)], "name string, ok boolean")
    layers = spark.createDataFrame([("recovered content",), ("imported archive",), ("unknown",)], "name string")
    assert rows(P.capture_sources(captures, layers), "source_rank", "name") == [
        (1, "capture-2"), (2, "capture-1"), (3, "imported archive"), (4, "recovered content")]
    assert P.latest_verified(captures).first().name == "capture-2"


def test_versioned_stores(spark, rows):
    stores = spark.createDataFrame([("chats-2-documents",), ("chats-10-documents",), ("a-b-1-documents",), ("other",)], "store string")
    latest = P.latest_versions(stores)
    assert rows(latest, "base", "version") == [("a-b", 1), ("chats", 10)]
    records = spark.createDataFrame([("chats-10-documents", '{"id":1,"_rev":"x"}'), ("chats-10-documents", '{"id":2,"_deleted":true}'), ("chats-2-documents", '{"id":3}')], "store string, record string")
    assert [(r.base, r.fields) for r in P.live_documents(records, latest).collect()] == [("chats", {"id": "1"})]


def test_normalized_messages(spark):
    records = [
        ("messages", {"id": "m", "conversationId": "c", "role": "assistant", "content": "hi", "modelName": "M", "totalInferenceTime": 4321,
                      "streamingStatus": "complete", "usage": {"completionTokens": 17, "totalTokens": 23}}),
        ("mindMessages", {"data": {"id": "n", "mind_conversation_id": "agent1", "role": "user", "created_at_unix_timestamp": 1000,
                                   "output_items": [{"type": "reasoning", "content": [{"text": "hidden"}]}, {"type": "message", "content": [{"text": "seen"}]}]}}),
        ("messages", {"content": "no ids", "inputTokens": -4, "outputTokens": "6"}),
        ("rxdb-physical:messages", {"id": "skip"}),
    ]
    df = spark.createDataFrame([(s, i, json.dumps(r)) for i, (s, r) in enumerate(records)], "store string, line_no bigint, line string").withColumn("record", R.parse("line"))
    got = {r.id: r for r in Z.messages(df.drop("line")).collect()}
    assert set(got) == {"m", "n", "messages-2"}
    m, n, plain = got["m"], got["n"], got["messages-2"]
    assert (m.output_tokens, m.total_tokens, m.execution_ms, m.status, m.text, m.model) == (17, 23, 4321.0, "complete", "hi", "M")
    assert (n.text, n.conversation_id, n.created_ms) == ("seen", "agent1", 1000000)
    assert (plain.conversation_id, plain.input_tokens, plain.output_tokens, plain.total_tokens, plain.role) == ("recovered", None, 6, 6, "unknown")


def test_tool_output_takes_the_name_of_an_earlier_call(spark):
    items = [{"type": "functionCallOutput", "call_id": "k", "output": "early"}, {"type": "functionCall", "id": "k", "name": "first", "arguments": "{bad"},
             {"type": "functionCall", "call_id": "k", "name": "second"}, {"type": "functionCallOutput", "callId": "k", "output": '{"b":1,"a":2}'},
             {"type": "message", "content": []}, "junk"]
    df = spark.createDataFrame([(json.dumps(items),)], "t string").select(N.output_segments(R.parse("t")).alias("s"))
    got = [(s.tool, s.phase, s.arguments, s.output) for s in df.first().s]
    assert got == [("function", "output", None, "early"), ("first", "call", "{bad", None), ("second", "call", None, None), ("second", "output", None, '{"a":2,"b":1}')]


def test_deep_walk_skips_byte_blobs(spark):
    blob = {str(i): i for i in range(70)}
    record = {"blob": blob, "few": {"0": "https://h/a.png"}, "list": [["https://h/b.png"]]}
    df = spark.createDataFrame([(1, json.dumps(record))], "id int, t string").select("id", R.parse("t").alias("record"))
    walked = N.walk(df, ["id"], "record", 6, blobs=True).where(R.kind_of(F.col("value")) != "object").select("path").collect()
    assert {r.path for r in walked} == {"few.0", "list.0.0"}
    assert {r.url for r in N.deep_references(df, ["id"]).collect()} == {"https://h/a.png", "https://h/b.png"}


# ---------------------------------------------------------------- search

def test_catalog_search(spark):
    conversations = spark.createDataFrame([("c1", "Car research", "p", 5), ("c2", "Cartoon references", "p", 9)], "id string, title string, preview string, updated_ms bigint")
    said = spark.createDataFrame([("m1", "c1", "Car research", "engines", 1)], "id string, conversation_id string, title string, text string, created_ms bigint")
    media = spark.createDataFrame([("f1", "c1", "car.png", None, "s", "image", "image/png", 1, False, False), ("f2", "c1", "car2.png", None, "s", "image", "x", 1, False, True)],
                                  "media_id string, conversation_id string, file_name string, prompt string, source string, kind string, mime_type string, created_ms bigint, is_thumbnail boolean, hidden boolean")
    items = K.searchable(conversations, said, media)
    found = K.hits(items, "car")
    assert {r.type: r.hits for r in K.counts(found).collect()} == {"conversation": 2, "message": 1, "media": 1}
    assert [r.id for r in K.page(found).collect()] == ["c2", "c1", "m1", "f1"]
    assert {r.id for r in K.hits(items, "car", "whole").collect()} == {"c1", "m1", "f1"}
    assert K.hits(items, "").count() == 4


def test_ranked_search_prefers_rare_and_short(spark):
    docs = spark.createDataFrame([(1, "fox fox den"), (2, "fox " + "pad " * 50), (3, "den"), (4, "nothing"), (5, "more nothing")], "id int, text string")
    best = K.ranked_batch(docs, "id", F.col("text"), ["fox", "fox den"], 10).collect()
    assert [r.doc_id for r in sorted(best, key=lambda r: (r.query_id, r.rank))] == [1, 2, 1]
    with pytest.raises(ValueError):
        K.ranked_batch(docs, "id", F.col("text"), ["!!"])


# ---------------------------------------------------------------- streams

def test_unstable_source_is_rejected(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1)], "path string, n int").write.parquet(source)
    ticks = iter(range(1000))
    moving = lambda: spark.createDataFrame([("a", str(next(ticks)))], "path string, signature string")
    stream = spark.readStream.schema("path string, n int").parquet(source)
    base = workspace(spark, "unstable")
    with pytest.raises(Exception, match="kept changing"):
        T.stability_gate(stream, moving, f"{base}/ok", f"{base}/receipts", f"{base}/cp", passes=2).awaitTermination()
    receipt = spark.read.parquet(f"{base}/receipts").first()
    assert (receipt.status, receipt.attempt) == ("incomplete", 2)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{base}/ok")
    # the offsets were not committed: once the source stands still, the same rows are taken
    still = lambda: spark.createDataFrame([("a", "s")], "path string, signature string")
    T.stability_gate(stream, still, f"{base}/ok", f"{base}/receipts", f"{base}/cp", passes=2).awaitTermination()
    assert [(r.path, r.n) for r in spark.read.parquet(f"{base}/ok").collect()] == [("a", 1)]


def test_stream_changes_meet_earlier_batches(spark, tmp_path):
    source, base = str(tmp_path / "in"), workspace(spark, "changes")
    schema = "key string, seq bigint, state string"
    batches = [[("k", 0, "a"), ("k", 1, "a"), ("l", 2, "x")], [("k", 3, "a"), ("k", 4, "b"), ("m", 5, "q")], [("l", 6, "y"), ("k", 7, "a")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        time.sleep(0.05)
        stream = spark.readStream.schema(schema).parquet(source)
        T.detect_changes(stream, f"{base}/out", f"{base}/states", f"{base}/cp", width=1).awaitTermination()
    got = sorted((r.seq, r.previous, r.event) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(0, None, "INITIAL_STATE"), (2, None, "INITIAL_STATE"), (4, "a", "STATE_CHANGED"), (5, None, "INITIAL_STATE"),
                   (6, "x", "STATE_CHANGED"), (7, "b", "STATE_CHANGED")]
    whole = spark.createDataFrame(sum(batches, []), schema)
    assert sorted((r.seq, r.previous, r.event) for r in T.state_changes(whole, 2).collect()) == got


# ---------------------------------------------------------------- catalog

def test_catalog_of_layers(spark):
    from threadlake.operators.catalog import build_catalog
    conversations = spark.createDataFrame([
        ("capture", 0, 0, "c1", "New", None, "chat", None, None), ("imported", 1, 0, "c1", "Old", "kept", "chat", 5, 50),
        ("imported", 1, 1, "recovered", "Catch all", None, "recovered", None, None),
    ], "layer string, source_rank int, line_no bigint, id string, title string, preview string, kind string, created_ms bigint, updated_ms bigint")
    messages = spark.createDataFrame([
        ("capture", 0, 0, "c1", "a1", "assistant", "m1", "answer", 2000), ("capture", 0, 1, "c1", "u1", "user", None, "ask", 1000),
        ("imported", 1, 0, "c1", "x", "user", None, "from an import", 1), ("imported", 1, 1, "c2", "y", "user", None, "other", 7),
        ("recovery", 2, 0, "recovered", "a1", "assistant", None, "answer", 2000),
    ], "layer string, source_rank int, line_no bigint, conversation_id string, id string, role string, model string, text string, created_ms bigint")
    fields = ("layer string, source_rank int, line_no bigint, stable_id string, local_id string, source_name string, available boolean, conversation_id string, "
              "message_id string, kind string, file_name string, prompt string, model string, disposition string, source string, created_ms bigint, path string, "
              "sha string, bytes bigint, mime_type string, status string, archive_source string, original_path string, format_corrected boolean")
    def item(layer, rank, line, key, message, disposition, path, sha, source="s", kind="image"):
        return (layer, rank, line, key, key, "n", path is not None, "c1", message, kind, f"{key}.png", None, None, disposition, source, None, path, sha, 3,
                "image/png", "materialized" if path else "metadata-only", layer, None, False)
    media = spark.createDataFrame([
        item("capture", 0, 0, "in-user", "u1", "input", "p1", "h1"), item("capture", 0, 1, "in-assistant", "a1", "input", "p2", "h2"),
        item("capture", 0, 2, "out", "a1", "output", "p3", "h3"), item("capture", 0, 3, "placeholder", "a1", None, None, None),
        item("imported", 1, 0, "no-bytes", "u1", None, None, None, kind="video"), item("recovery", 2, 0, "out", "a1", "output", "p9", "h3"),
    ], fields)
    built = build_catalog(conversations, messages, media)
    assert [(r.id, r.conversation_id) for r in built.messages.orderBy("seq").collect()] == [("u1", "c1"), ("a1", "c1"), ("y", "c2")]
    shown = {r.file_name: (r.display_message_id, r.disposition, r.model, r.prompt) for r in built.media.collect()}
    assert shown == {"in-user.png": ("u1", "input", None, "ask"), "in-assistant.png": ("u1", "input", None, "answer"), "out.png": ("a1", "output", "m1", "answer")}
    got = {r.id: r for r in built.conversations.collect()}
    assert set(got) == {"c1", "c2"}
    assert (got["c1"].title, got["c1"].preview, got["c1"].message_count, got["c1"].media_count, got["c1"].models, got["c1"].updated_ms) == (
        "New", "kept", 2, 3, ["m1"], 50)


def test_session_storage_redaction(spark):
    from threadlake.functions.predicates import redaction
    df = spark.createDataFrame([("app.session-id",), ("theme",), ("acmeSessionId",), ("x:trace",)], "k string").select(
        "k", redaction(F.col("k"), session=True, site="acme")["redacted"].alias("r"), redaction(F.col("k"))["redacted"].alias("plain"))
    assert {r.k: (r.r, r.plain) for r in df.collect()} == {"app.session-id": (True, False), "theme": (False, False), "acmeSessionId": (True, False), "x:trace": (True, False)}


def test_ranked_search_phrases_accents_and_snippets(spark):
    rows = [("a", "le de la", None), ("b", "de le", "le xx de"), ("c", "Café du coin", "x " * 30 + "le DE fin " + "y " * 30), ("d", "no", "cafes")]
    items = spark.createDataFrame([("message", i, "1", title, body) for i, title, body in rows], "type string, id string, conversation_id string, title string, body string")
    got = {}
    for r in K.ranked_items(items, ["le_de", "cafe", "le de"], 300).collect():
        got.setdefault(r.query_id, {})[r.id] = r.excerpt
    assert set(got[0]) == {"a", "c"} and set(got[1]) == {"c"} and set(got[2]) == {"a", "b", "c"}
    assert got[0]["c"].startswith("…") and "[le DE] fin" in got[0]["c"] and got[0]["c"].endswith("…") and got[0]["a"] == ""
