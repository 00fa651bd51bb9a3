"""threadlake: a conversation-archive analytics library on PySpark.

Record stores of AI conversations are ingested, normalized into conversation,
message and media tables, merged across snapshots, searched, audited and
verified.  Every operator takes and returns DataFrames or Columns.
"""
