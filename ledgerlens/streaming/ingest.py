"""Incremental cleaning of uploaded transaction files (Structured Streaming).

The reference cleans each uploaded dataset file in a separate job. Here a
file stream watches the upload folder for new files; every micro-batch
holds one (``maxFilesPerTrigger=1``). ``foreachBatch`` reads that file with
the batch reader, so its columns are found by name in its own header
whatever their order, and extra columns go through, and runs the same
batch operators on it: typed read, dedupe, missing ids, step-2 rules and
the one-pass waterfall. Outputs are written under a ``batch_id=`` partition
in overwrite mode, so a micro-batch replayed after a failure replaces its
own output instead of duplicating it; stream progress lives in a checkpoint
under the cluster's shared checkpoint folder.

``dedupe_uploads`` is the flow across files: every line of every upload is typed into one folder, and a
second stream over that folder keeps a line the first time it comes, with the lines seen so far in a RocksDB state
store, partitioned by line and checkpointed. A line that stands in two uploads, or an upload that is
sent again, is counted once, also after a restart.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators import clean
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources.io import UPLOAD_TYPES, read_raw_csv

#: Where the state of the streams is kept: on disk, beside what fits memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of a typed line, and those of its upload that are not among them, as JSON.
LINE = ", ".join(f"{name} {dtype.simpleString()}" for name, dtype in UPLOAD_TYPES.items()) + ", more string"


def _clean_batch(out_dir: str, cutoff):
    def run(batch: DataFrame, batch_id: int) -> None:
        # one file per batch: one path reaches the driver
        for (path,) in batch.select("path").collect():
            typed = read_raw_csv(batch.sparkSession, path)
            name = F.lit(os.path.basename(path))
            cleaned = clean.clean_transactions(typed, cutoff=cutoff).withColumn("dataset", name)
            waterfall = clean.cleaning_waterfall(typed, cutoff=cutoff).withColumn("dataset", name)
            cleaned.write.mode("overwrite").parquet(os.path.join(out_dir, "cleaned", f"batch_id={batch_id}"))
            waterfall.write.mode("overwrite").parquet(os.path.join(out_dir, "waterfall", f"batch_id={batch_id}"))
    return run


def clean_uploads(spark: SparkSession, upload_dir: str, out_dir: str, checkpoint: str | None = None,
                  cutoff=clean.DEFAULT_DATE_CUTOFF, available_now: bool = True) -> StreamingQuery:
    """Start the incremental cleaning stream; returns the running query.

    With ``available_now`` the stream processes the files present and stops
    (an incremental batch job); otherwise it keeps watching the folder.
    """
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "ledgerlens-streams", "clean_uploads")
    writer = _files(spark, upload_dir).writeStream.foreachBatch(_clean_batch(out_dir, cutoff)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _files(spark: SparkSession, upload_dir: str) -> DataFrame:
    # only the paths: the files' bytes are not read by the stream
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.csv").load(upload_dir).select("path"))


def _type_batch(lines_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        for (path,) in batch.select("path").collect():  # one file per batch
            typed = read_raw_csv(batch.sparkSession, path)
            more = [c for c in typed.columns if c not in UPLOAD_TYPES]
            rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(more)])) if more else F.lit(None).cast("string")
            # copies within an upload go here, by a map-side aggregate: a line reaches the state once a file
            typed.select(*UPLOAD_TYPES, rest.alias("more")).dropDuplicates().write.mode("overwrite").parquet(os.path.join(lines_dir, f"batch_id={batch_id}"))
    return run


def type_uploads(spark: SparkSession, upload_dir: str, out_dir: str, available_now: bool = True) -> StreamingQuery:
    """Type every uploaded file's lines into ``out_dir/lines``, a folder for each file."""
    writer = (_files(spark, upload_dir).writeStream.foreachBatch(_type_batch(os.path.join(out_dir, "lines")))
              .option("checkpointLocation", os.path.join(out_dir, "checkpoints", "lines")))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def dedupe_uploads(spark: SparkSession, out_dir: str, available_now: bool = True) -> StreamingQuery:
    """Stream the typed lines, each the first time it comes, into the table ``out_dir/distinct``.

    The state is every distinct line: there is no time after which a line may not come again. It is
    partitioned by the line, so it grows over all executors' disks. A line comes once a file at most
    (:func:`type_uploads`), so a very common one is no hot key.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    lines = spark.readStream.schema(LINE).option("recursiveFileLookup", True).parquet(os.path.join(out_dir, "lines"))
    writer = (lines.dropDuplicates().writeStream.format("parquet").outputMode("append").option("path", os.path.join(out_dir, "distinct"))
              .option("checkpointLocation", os.path.join(out_dir, "checkpoints", "distinct")))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def cleaned_uploads(spark: SparkSession, out_dir: str, cutoff=clean.DEFAULT_DATE_CUTOFF) -> DataFrame:
    """The cleaned transactions of all uploads: step 2 and the id rule over the distinct lines."""
    distinct = spark.read.schema(LINE).parquet(os.path.join(out_dir, "distinct"))
    return clean.clean_step2(clean.drop_missing_customers(distinct), cutoff=cutoff)
