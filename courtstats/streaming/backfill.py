from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest_new_files(spark: SparkSession, source_glob: str, schema: T.StructType, out_path: str,
                     name: str, checkpoint: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                     derive: dict | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append every not-yet-ingested file matching ``source_glob`` to the
    table at ``out_path`` and stop (``trigger(availableNow=True)``).

    * rows carry ``source_file`` (lineage of the landed file);
    * ``derive`` adds columns (e.g. ``{"season": F.year("ts")}``) used by
      ``partition_by`` so later scans prune by partition;
    * the checkpoint, a path of its own on storage that all sessions share, makes a
      rerun after an executor or driver loss, or in a new session, resume without
      duplicates.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(source_glob).withColumn("source_file", F.col("_metadata.file_path"))
    if derive:
        df = df.withColumns(derive)
    w = (df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).queryName(name))
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w.start(out_path)
