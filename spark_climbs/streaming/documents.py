"""Incremental intake of road documents as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spark_climbs.materialize import made_here
from spark_climbs.sources.overpass import parse_overpass, ways_from_elements


def ingest_documents(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Turn every document that is new in ``folder`` into ways under ``out``, then stop.

    The stream's checkpoint is the progress record: a finished document is not read
    again, and a batch that died is redone into the same place."""
    documents = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .load(folder)
        .select(F.col("_metadata.file_path").alias("doc"), F.col("value"))
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        with made_here() as delete:
            ways = ways_from_elements(parse_overpass(batch))
            ways.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        delete([])

    return (
        documents.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
