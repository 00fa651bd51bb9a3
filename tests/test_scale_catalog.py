"""Prompts, which are whole texts, are written once and pass none of the joins that drop and place media."""

from threadlake.operators import catalog as C


def test_prompts_are_written_once(spark, monkeypatch):
    conversations = spark.createDataFrame([("capture", 0, 0, "c", "T", None, "chat", None, None)],
        "layer string, source_rank int, line_no bigint, id string, title string, preview string, kind string, created_ms bigint, updated_ms bigint")
    messages = spark.createDataFrame([("capture", 0, 0, "c", "m", "user", None, "said", 1)],
        "layer string, source_rank int, line_no bigint, conversation_id string, id string, role string, model string, text string, created_ms bigint")
    none = (None,) * 2
    media = spark.createDataFrame([
        ("capture", 0, i, key, key, "n", True, "c", message, "image", key, prompt, None, None, "s", None, "p", f"h{i}", 1, *none, "full", None, False)
        for i, (key, message, prompt) in enumerate([("a", "m", None), ("b", "m", "own"), ("d", "x", "lone"), ("e", "x", None)])],
        "layer string, source_rank int, line_no bigint, stable_id string, local_id string, source_name string, available boolean, conversation_id string, "
        "message_id string, kind string, file_name string, prompt string, model string, disposition string, source string, created_ms bigint, path string, "
        "sha string, bytes bigint, mime_type string, status string, archive_source string, original_path string, format_corrected boolean")
    written, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, label: written.append((label, "prompt" in df.columns)) or write(df, label))
    built = C.build_catalog(conversations, messages, media)
    assert written == [("media", True), ("linked", False), ("placed", False)]
    assert {r.file_name: r.prompt for r in built.media.collect()} == {"a": "said", "b": "own", "d": "lone", "e": None}
