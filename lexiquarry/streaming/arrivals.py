"""Resumable ingestion as streams: what arrives is read once, documents that are there already are passed over, and each batch is seen whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry import schemas
from lexiquarry.operators.ingest import accepted, new_only
from lexiquarry.sources import committed, rest


def arrivals(spark: SparkSession, folder: str, schema: str = schemas.DOCUMENT) -> DataFrame:
    """Documents of JSON lines files as they appear in ``folder``, whatever their dates."""
    return spark.readStream.schema(schema).json(folder)


def present(spark: SparkSession, out: str, schema: str = schemas.DOCUMENT) -> DataFrame:
    """The documents ingested so far."""
    return committed.read(spark, out, schema)


def fresh(batch: DataFrame, held: DataFrame, key: str = "document_number") -> DataFrame:
    """Rows of a batch that are not held yet, one for each number; rows without a number are all kept, since nothing tells them apart."""
    named = new_only(batch.where(F.col(key).isNotNull()).dropDuplicates([key]), held, key)
    return named.unionByName(batch.where(F.col(key).isNull()))


def land(stream: DataFrame, out: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, known: Callable[[DataFrame], DataFrame] | None = None):
    """Run ``stream`` over what there is and append it to ``out``, shaped and accepted; the checkpoint remembers what was read.

    A batch is one commit named by the stream and its number, so a batch that is run again after a failure adds nothing twice. ``known`` names a batch's rows by
    ``document_number`` before they are shaped, where shaping is dear.
    """

    def batch_of(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream_id = spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id
        held = present(spark, out)
        rows = shape(fresh(batch, held) if known is None else known(batch).transform(lambda b: fresh(b, held)))
        committed.write(accepted(rows).select(*[c for c in rows.columns if not c.startswith("_")]), out, f"{stream_id}-{number}")

    return stream.writeStream.foreachBatch(batch_of).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Files of documents in ``folder`` to ``out``."""
    return land(arrivals(spark, folder), out, checkpoint)


def ingest_listing(spark: SparkSession, url: str, out: str, checkpoint: str, start: str, today: str | None = None, back: int = rest.BACK, transport=rest.http):
    """The source's documents from ``start`` on, day by day; each run goes on where the last one ended, and looks again at the ``back`` days before, where late ones appear.

    Listed numbers that are held already are not fetched."""
    spark.dataSource.register(rest.ListingStream)
    options = {"url": url, "start": start, "back": str(back)} | ({"today": today} if today else {})
    stream = spark.readStream.format("rest_stream").options(**options).load()

    def shape(batch: DataFrame) -> DataFrame:
        got = rest.fetch(batch, url.rsplit(".", 1)[0], transport)
        return rest.documents(got)

    return land(stream, out, checkpoint, shape)
