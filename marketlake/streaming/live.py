"""Live ticks with Structured Streaming.

raw messages -> normalise -> topic -> enrich against the cache -> deltas, cache, demo feed.

Kafka is the transport in production; its connector is not part of Spark itself, so tests use
file streams. Delivery is at least once: offsets live in the checkpoint; output, state and cache rows are
written per batch id and replaced when a batch repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from marketlake.operators import ticks as K
from marketlake.schemas import MESSAGE, TICK
from marketlake.sources.cache import CacheTable
from marketlake.sources.changes import ChangeTable

TOPIC = "market-ticks"
Emit = Callable[[DataFrame, str, int], None]
Handle = Callable[[DataFrame, int], None]


def json_source(
    spark: SparkSession, path: str, schema: StructType = MESSAGE, files_per_batch: int = 100
) -> DataFrame:
    """A stream of JSON-lines files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def kafka_source(spark: SparkSession, servers: str, topic: str = TOPIC) -> DataFrame:
    """Ticks from a topic, starting at the latest offset when there is no checkpoint.

    ``seq`` is the offset: messages of a ticker share a key and so a partition, in which
    offsets grow.
    """
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .load()
    )
    return parse_ticks(records, F.col("offset"))


def parse_ticks(records: DataFrame, seq: Column | None = None) -> DataFrame:
    """(value JSON) records -> ticks; malformed records are left out (see ``judged_records``)."""
    return good_ticks(judged_records(records, seq))


def judged_records(records: DataFrame, seq: Column | None = None) -> DataFrame:
    """(value, tick, fault): ``fault`` is why a record is no usable tick, else null. Nothing is dropped."""
    corrupt = "_unparsable"
    kept = StructType([*TICK.fields, StructField(corrupt, StringType())])
    text = F.col("value").cast("string")
    tick = F.from_json(text, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    if seq is not None:
        tick = tick.withField("seq", seq.cast("bigint"))
    rows = records.select(text.alias("value"), tick.alias("tick"))
    fault = (
        F.when(F.col("value").isNull(), "empty")
        .when(F.col(f"tick.{corrupt}").isNotNull(), "unparsable")
        .when(F.col("tick.ticker").isNull(), "no ticker")
        .when(F.col("tick.price").isNull(), "no price")
    )
    return rows.withColumn("fault", fault)


def good_ticks(judged: DataFrame) -> DataFrame:
    return judged.where("fault is null").select(*[F.col(f"tick.{n}") for n in TICK.fieldNames()])


def receive_batch(records: DataFrame, batch_id: int, emit: Emit, handle: Handle | None = None) -> None:
    """One micro-batch of records: what is no tick goes to ``dead_letters``, its numbers to ``record_counts``, and ticks
    to ``handle``. The counts are observed while the dead letters are written, not counted again."""
    judged = judged_records(records).persist()  # used twice
    try:
        seen = Observation(f"records-{batch_id}")
        counted = judged.observe(seen, F.count(F.lit(1)).alias("records"), F.count("fault").alias("dead"))
        emit(counted.where("fault is not null").select("value", "fault"), "dead_letters", batch_id)
        counts = records.sparkSession.createDataFrame([(seen.get["records"], seen.get["dead"])], "records bigint, dead bigint")
        emit(counts, "record_counts", batch_id)
        if handle is not None:
            handle(good_ticks(judged), batch_id)
    finally:
        judged.unpersist()


def start_receiver(
    records: DataFrame, emit: Emit, checkpoint: str, handle: Handle | None = None, every: str | None = None
) -> StreamingQuery:
    """Starts the receiver on a stream of (value JSON) records; ``handle`` gets the ticks of each batch."""
    return start_batches(records, lambda batch, batch_id: receive_batch(batch, batch_id, emit, handle), checkpoint, every)


def direction_state(spark: SparkSession, path: str, compact_every: int = 16) -> ChangeTable:
    """The last price of every ticker, one write per micro-batch."""
    schema = StructType([TICK[c] for c in ("ticker", "timestamp", "seq", "price")])
    return ChangeTable(spark, path, schema, ["ticker"], ["timestamp", "seq"], by_field=False, compact_every=compact_every)


def direction_batch(ticks: DataFrame, batch_id: int, state: ChangeTable, emit: Emit) -> None:
    """One micro-batch: the direction of each tick against the one before, in this batch or an earlier one.

    The state is read as of the batch before, so a batch that is repeated gives the same output.
    """
    ticks = ticks.persist()  # used twice
    try:
        rows = K.directions_after(ticks, state.read(batch_id - 1))
        emit(rows.select("seq", "ticker", "timestamp", "price", "direction"), "directions", batch_id)
        state.write(K.last_prices(ticks), batch_id)
    finally:
        ticks.unpersist()


def start_directions(
    ticks: DataFrame, state: ChangeTable, emit: Emit, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Starts the price directions on a tick stream. One state belongs to one checkpoint."""
    return start_batches(ticks, lambda batch, batch_id: direction_batch(batch, batch_id, state, emit), checkpoint, every)


def start_batches(
    stream: DataFrame, handle: Handle, checkpoint: str, every: str | None, mode: str = "append"
) -> StreamingQuery:
    """Handles a stream batch by batch, at intervals of ``every``; without it, what is there, and stops."""
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def publish_ticks(messages: DataFrame, checkpoint: str, node: str = "spark", **sink: str):
    """Continuous normalising: raw messages -> keyed JSON records on a sink.

    ``sink`` holds ``format`` (``kafka`` or ``json``) and its options.
    """
    options = dict(sink)
    writer = K.tick_messages(K.normalize_ticks(messages, node)).writeStream
    return (
        writer.format(options.pop("format", "kafka"))
        .options(**options)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )


def latest_state(ticks: DataFrame) -> DataFrame:
    """Latest tick per ticker as a streaming aggregate (update or complete mode). The state is
    one row per ticker, so it needs no time limit."""
    return K.latest_tick(ticks)


def latest_table(spark: SparkSession, path: str, compact_every: int = 16) -> ChangeTable:
    """The newest tick of every ticker, stored: one write of the changed tickers per micro-batch."""
    return ChangeTable(spark, path, TICK, ["ticker"], ["timestamp", "seq"], by_field=False, compact_every=compact_every)


def start_latest(ticks: DataFrame, table: ChangeTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps ``table`` at the latest state of a tick stream. The aggregate's state is in the checkpoint, and a batch
    that is repeated replaces its own write. One table belongs to one checkpoint."""
    return start_batches(latest_state(ticks), table.write, checkpoint, every, "update")


def folder_emitter(root: str) -> Emit:
    """Writes each output of a batch to its own folder, replaced if the batch repeats."""

    def emit(df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").json(f"{root.rstrip('/')}/{name}/batch={batch_id}")

    return emit


def kafka_emitter(servers: str) -> Emit:
    """Writes (key, value) outputs to topics of the same name."""

    def emit(df: DataFrame, name: str, _batch_id: int) -> None:
        sent = df.select(*[c for c in ("key", "value") if c in df.columns])
        sent.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()

    return emit


def delta_log(spark: SparkSession, root: str, name: str = "ticks") -> DataFrame:
    """The deltas that ``folder_emitter`` has written: (batch, key, value, timestamp, seq)."""
    schema = "key string, value string, timestamp bigint, seq bigint, batch bigint"
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/{name}")


def relay_batch(
    ticks: DataFrame, batch_id: int, cache: CacheTable, emit: Emit, allowed: DataFrame | None = None, producer: str = "live"
) -> None:
    """One micro-batch: enrich, emit deltas and the demo sub-stream, write the latest ticks to the cache.

    Closes are read anew for every batch, so the nightly refresh is seen without a restart.
    """
    enriched = K.enrich(ticks, cache.reference()).persist()  # used three times
    try:
        emit(K.tick_envelopes(enriched, "timestamp", "seq"), "ticks", batch_id)
        demo = K.demo_feed(enriched) if allowed is None else K.allowed_feed(enriched, allowed)
        emit(K.tick_envelopes(demo, "timestamp", "seq"), "demo", batch_id)
        cache.merge_live(K.cache_fields(K.latest_tick(enriched)), batch_id, producer)
    finally:
        enriched.unpersist()


def start_relay(
    ticks: DataFrame,
    cache: CacheTable,
    emit: Emit,
    checkpoint: str,
    allowed: DataFrame | None = None,
    every: str | None = None,
    producer: str = "live",
) -> StreamingQuery:
    """Starts the relay on a tick stream; ``every`` is the trigger interval, and without it the
    query handles what is there and stops. ``producer`` names its part of the cache: one name, one checkpoint."""
    return start_batches(
        ticks, lambda batch, batch_id: relay_batch(batch, batch_id, cache, emit, allowed, producer), checkpoint, every
    )


def connect(cache: CacheTable, followed: DataFrame, producer: str = "live") -> tuple[DataFrame, int | None]:
    """What the users of ``followed(username, ticker)`` get on connect, and the batch of the live stream after which
    deltas are to follow (``ticks.delta_messages``). Both are of one cut through the cache."""
    cut = cache.streams()
    rows = K.cached_ticks(cache.read(cut), positive_only=True)
    return K.snapshot_messages(followed, rows, cut.get(producer)), cut.get(producer)


def snapshot(cache: CacheTable) -> DataFrame:
    """All usable ticks, one message each."""
    return K.snapshot_envelopes(K.cached_ticks(cache.read(), positive_only=True))
