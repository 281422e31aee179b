"""The file ingest as a stream: every micro-batch of new files goes through the batch load."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.csv_files import ingest_files, with_file_keys

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def start_ingest(spark: SparkSession, root: str, table_path: str, checkpoint: str,
                 load_date: date | None = None, multi_line: bool = False,
                 files_per_batch: int = 1000) -> StreamingQuery:
    """Load all files present, in batches, then stop.

    The stream carries paths only.  A batch repeated after a failure adds nothing twice: the
    load skips every (month, region) in the table's ledger and replaces all others.
    """
    paths = (spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
             .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", files_per_batch)
             .load(root).select("path"))

    def load(batch: DataFrame, _batch_id: int) -> None:
        ingest_files(spark, with_file_keys(batch), table_path, load_date, multi_line)

    return (paths.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
