"""Running a stream over what its source holds now, and micro-batch ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.vectors import hashed_embedder
from shelfspark.operators import answer_cache, delta
from shelfspark.operators import feed_mapping as fm
from shelfspark.session import materialise, scratch_path
from shelfspark.sources.catalog import CatalogTable


MAX_REASON_CHARS = 2000


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream until its source is used up and read what it wrote.

    Output and checkpoint go to the shared folder. Update and complete modes have no file
    sink: each batch is written under its number and the last batch (complete) or all
    batches (update) are read.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(
        availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(
            f"{out}/batch={number}")

    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/*")
    if mode == "complete":
        last = rows.agg(F.max("batch_number").alias("batch_number"))
        rows = rows.join(F.broadcast(last), "batch_number", "left_semi")
    return rows.drop("batch_number")


def replay_stream(events: DataFrame, name: str, **options) -> DataFrame:
    """Cache hits of a stream of events, each micro-batch replayed by many tasks.

    A keyed state would bring all rows of a tenant to one task. Here the caches that a batch leaves are
    written under its number, and the next batch begins with them; a repeated batch replaces its own.
    ``events`` and ``options`` are those of ``answer_cache.replay``; batches come in the order of time.
    """
    spark = events.sparkSession
    hits, caches = scratch_path(spark, name), scratch_path(spark, f"{name}-caches")

    def run(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        begun = own.read.parquet(f"{caches}/batch={number - 1}") if number else None
        found = answer_cache.replay(batch, begun=begun, **options)
        found.state.write.mode("overwrite").parquet(f"{caches}/batch={number}")
        found.hits.write.mode("overwrite").parquet(f"{hits}/batch={number}")

    (events.writeStream.foreachBatch(run).option("checkpointLocation", scratch_path(spark, f"{name}-state"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("tenant string, qid string, store_id string, similarity double").parquet(f"{hits}/*")


def ingest_batch(feed: DataFrame, table: CatalogTable, mapping: fm.ColumnMapping | None = None,
                 adapter: fm.FeedAdapter | None = None, full_sync: bool = False, embedder=None,
                 plain_text: bool = False) -> DataFrame:
    """Parse, dedupe, compare, embed what changed, write; returns the job's ledger rows."""
    resolved = fm.resolve_mapping(adapter, mapping)
    source = adapter or fm.FeedAdapter(resolved)
    # Used by the delta, the statistics and the error list alike.
    mapped = materialise(source.apply(feed, plain_text=plain_text))
    products = delta.with_content_hash(delta.dedupe_last_wins(fm.accepted(mapped)))
    spark = feed.sparkSession
    stored = table.content_hashes() if table.exists() else spark.createDataFrame(
        [], "tenant string, sku string, content_hash string")
    compared = materialise(delta.join_delta(products, stored))
    gone = materialise(delta.missing_from_feed(stored, products)) if full_sync else \
        spark.createDataFrame([], "tenant string, sku string")
    embed = embedder or hashed_embedder()
    changed = delta.changes(compared)
    written = delta.stored_projection(changed).withColumn("embedding", embed(F.concat_ws(
        "\n", "title", F.nullif("brand", F.lit("")), F.nullif("description", F.lit("")),
        F.nullif("attributes_text", F.lit("")))))
    table.upsert(written)
    if full_sync:
        table.delete(gone)
    stats = delta.parse_stats(mapped)
    outcome = delta.ingest_outcome(compared, gone, stats)
    return delta.job_ledger(outcome, stats, fm.rejected(mapped))


def incremental_ingest(feed: DataFrame, table: CatalogTable, ledger_path: str,
                       checkpoint: str, **options) -> None:
    """Micro-batches of a feed stream through ingest_batch, one ledger file set per batch.

    A batch that fails is entered as failed before its error ends the stream.
    """
    def enter(ledger: DataFrame, number: int) -> None:
        # The batch number names the folder, so a repeated batch replaces its own rows.
        ledger.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(
            f"{ledger_path}/batch={number}")

    def run(batch: DataFrame, number: int) -> None:
        try:
            enter(ingest_batch(batch, table, **options), number)
        except Exception as error:
            enter(delta.failed_jobs(batch, str(error)[:MAX_REASON_CHARS]), number)
            raise

    (feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())

