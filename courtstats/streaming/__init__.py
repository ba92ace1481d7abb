"""Incremental ingestion with Structured Streaming.

The analyses this library reproduces have no streaming logic; the nearest
thing is an incremental backfill (fetch the games not yet landed, append,
rewrite).  Here that is a file-source stream with ``availableNow``: each run
appends only the files that arrived since the last run, exactly once, with
its progress in a checkpoint under the shared ``spark.checkpoint.dir``.
"""

from courtstats.streaming.backfill import ingest_new_files

__all__ = ["ingest_new_files"]
