"""Structured Streaming over the reading log: sessions, changes of place, active time, positions."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from folio.sources.files import hadoop_path, shared_path


#: Rows may come so late; what a key has been is forgotten after so long, by the time of the rows; pieces of time in which rows wait.
LATE, KEEP_MS, PIECE_MS = "10 minutes", 60 * 86_400_000, 3_600_000
#: Waiting rows of a bucket of keys that Python holds before it puts them into the state, and buckets: each is one call of Python in a batch.
FLUSH, BUCKETS = 4096, 4096
#: Partitions of a stream's state for each core; each is a store of its own that is opened and written in every batch.
STORES, PARTITIONS = 4, "spark.sql.shuffle.partitions"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_of(spark: SparkSession, path: str, like: DataFrame, files_at_once: int = 1000) -> DataFrame:
    """A stream of a Parquet table's files, so many in a batch. ``like`` has the schema. Files are to be in order of time: see ``arranged``."""
    found = path[:-1] + f"[{path[-1]}]"  # a pattern, so a single file will do as well as a folder
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(found)


def live_sessions(logs: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, given out once no log that is on time can extend them."""
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("logs"))
    return out.select("user_id", "started", "ended", "logs")


def live_days(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Logs by day of the event's time."""
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("logs")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "logs")


class InOrder(StatefulProcessor):
    """The rows of each key of a bucket in order of time, given one by one to ``fold`` with what the key has been so far.

    Rows come in pieces of ``piece_ms`` of their time, each once it is over and in order of (time, log_id) inside (see ``_in_order``). ``fold``
    takes (state or None, row) and gives the state, a tuple that JSON can hold as it can the row, and the rows that come out; ``ended`` what comes out for a key at the
    end of a piece with rows of it. A bucket's states are read and written once in a batch, as one call costs more than many keys.
    Without rows for ``keep_ms`` of the rows' time a key is forgotten; with None never.
    Python holds ``FLUSH`` rows of a bucket and one piece at most, never its history: what is more waits in a map in the state store.
    """

    def __init__(self, keys: list[str], fold, ended=None, keep_ms: int | None = KEEP_MS):
        self.keys, self.fold, self.ended, self.keep_ms = keys, fold, ended, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "until long", "rows string")
        self.states = handle.getValueState("states", "keys string")

    def _pieces(self, rows: Iterator[Row]) -> Iterator[tuple[int, list]]:
        held: dict[int, str] = {}
        put: list[int] = []
        n = 0
        for r in rows:
            held[r["until"]] = r["rows"]
            n += r["n"]
            if n >= FLUSH:
                put += self._put(held)
                held, n = {}, 0
        if put:
            put += self._put(held)
            for until in sorted(put):
                piece = json.loads(self.waiting.getValue((until,))[0])
                self.waiting.removeKey((until,))
                yield until, piece
        else:
            for until in sorted(held):
                yield until, json.loads(held[until])

    def _put(self, held: dict[int, str]) -> list[int]:
        for until, rows in held.items():
            self.waiting.updateValue((until,), (rows,))
        return list(held)

    def _read(self) -> dict[tuple, tuple]:
        found = self.states.get()
        return {tuple(key): (last, tuple(state)) for key, last, state in json.loads(found[0])} if found else {}

    def _write(self, states: dict[tuple, tuple], now_ms: int) -> None:
        """All states but those of keys that have been idle for too long."""
        rows = [(key, last, state) for key, (last, state) in states.items() if self.keep_ms is None or last // 1000 + self.keep_ms > now_ms]
        if rows:
            self.states.update((json.dumps(rows),))
        else:
            self.states.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        states = self._read()
        until = 0
        for until, piece in self._pieces(rows):
            seen = {}
            for x in piece:
                us, of = x["us"], tuple([x.get(k) for k in self.keys])
                last, state = states.get(of, (None, None))
                if self.keep_ms is not None and last is not None and us - last > self.keep_ms * 1000:
                    state = None
                state, out = self.fold(state, of, us, x.get("log_id"), x.get("what"))
                states[of] = us, state
                seen[of] = state
                yield from out
            if self.ended:
                for of, state in seen.items():
                    yield from self.ended(state, of)
        # later rows of a key are behind this piece's end
        self._write(states, until - 1)
        if self.keep_ms is not None:
            self.handle.registerTimer(until + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._write(self._read(), expiredTimerInfo.getExpiryTimeInMs())
        return iter(())


def _in_order(logs: DataFrame, what: Column, processor: InOrder, out: str, late: str, piece_ms: int) -> DataFrame:
    """Spark gathers and sorts the rows of a bucket of keys and a piece of time, and gives a piece to the processor when the watermark has passed its end."""
    keys = processor.keys
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    row = F.struct(F.unix_micros("ts").alias("us"), F.col("log_id"), what.alias("what"), *keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")
    pieces = timed.groupBy(bucket, F.window("ts", f"{piece_ms} milliseconds").alias("piece")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # as text, which Python reads faster than nested columns; nulls are left out of it
    given = pieces.select("bucket", F.unix_millis("piece.end").alias("until"), F.size("rows").alias("n"), F.to_json("rows").alias("rows"))
    return given.groupBy("bucket").transformWithState(processor, out, "Append", "None" if processor.keep_ms is None else "EventTime")


def live_changes(logs: DataFrame, late: str = LATE, piece_ms: int = PIECE_MS, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Logs whose chunk differs from the last one of the same user, book and chapter, if that was not too long ago."""

    def fold(state, key, us, log_id, chunk):
        return (chunk,), [] if state and state[0] == chunk else [Row(log_id=log_id, user_id=key[0], chunk_index=chunk)]

    return _in_order(logs, F.col("chunk_index"), InOrder(["user_id", "book_id", "chapter_number"], fold, None, keep_ms), "log_id long, user_id long, chunk_index int", late, piece_ms)


def live_active_seconds(logs: DataFrame, most: float = 10.0, late: str = LATE, piece_ms: int = PIECE_MS, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Active time of each user: each gap of less than so many seconds between logs counts.

    A log of the type ``saved``, where ``logs`` have one, ends a count: its minutes, rounded, are given out and the count begins anew.
    Rows are (user_id, log_id, seconds, saved_minutes); those without minutes are a user's running count, at the end of each piece of time with logs.
    """

    def fold(state, key, us, log_id, saved):
        last, total = state or (None, 0.0)
        if last is not None and us - last < most * 1e6:
            total += (us - last) / 1e6
        if saved:
            return (us, 0.0), [Row(user_id=key[0], log_id=log_id, seconds=total, saved_minutes=int(total / 60 + 0.5))]
        return (us, total), []

    def ended(state, key):
        return [Row(user_id=key[0], log_id=None, seconds=state[1], saved_minutes=None)]

    saved = F.col("event_type") == "saved" if "event_type" in logs.columns else F.lit(False)
    return _in_order(logs, saved, InOrder(["user_id"], fold, ended, keep_ms), "user_id long, log_id long, seconds double, saved_minutes long", late, piece_ms)


def disorder(spark: SparkSession, path: str, ts: str = "ts") -> float:
    """By how many seconds a file of a table, in the order in which a stream takes files, goes back behind files before it. Reads one column."""
    rows = spark.read.parquet(path).select(F.col(ts).cast("timestamp").alias("_ts"), "_metadata.file_path", "_metadata.file_modification_time")
    of_file = rows.groupBy("file_modification_time", "file_path").agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"))
    before = F.max("last").over(Window.orderBy("file_modification_time", "file_path").rowsBetween(Window.unboundedPreceding, -1))
    back = of_file.select((F.unix_micros(before) - F.unix_micros("first")).alias("back"))
    return max(0, back.agg(F.max("back")).first()[0] or 0) / 1e6


def arranged(spark: SparkSession, path: str, ts: str = "ts", late_seconds: float = 600, parts: int = 16) -> str:
    """A path of the table whose files a stream can take one after another: the table's own where they are in order of time, up to ``late_seconds``.

    Else a copy in the shared folder, put there part by part of the time, so that no file goes back behind one before.
    """
    if disorder(spark, path, ts) <= late_seconds:
        return path
    rows = spark.read.parquet(path)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = sorted(set(rows.select(us.cast("double").alias("us")).approxQuantile("us", [i / parts for i in range(1, parts)], 0.5 / parts)))
    copy = shared_path(spark, "arranged")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(us > int(low))
        (part if high is None else part.where(us <= int(high))).write.mode("append").parquet(copy)
        time.sleep(0.01)  # files are taken by the time of their last change, in thousandths of a second
    return copy


def run_once(stream: DataFrame, mode: str, seconds: int | None = None, path: str | None = None) -> DataFrame:
    """Run over all that is there, write to a table in the shared folder and read it, with the batch of each row.

    A batch that comes again takes its own place. With ``seconds`` a stream that needs longer is stopped and is an error. With a
    ``path`` of an earlier run it goes on from there.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    before, partitions = spark.conf.get(STATE_STORE), spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, min(int(partitions), STORES * spark.sparkContext.defaultParallelism))
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).foreachBatch(write).start()
        if seconds is None:
            query.awaitTermination()
        elif not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError(f"the stream had not ended after {seconds} seconds")
    finally:
        spark.conf.set(STATE_STORE, before)
        spark.conf.set(PARTITIONS, partitions)
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    fs, folder = hadoop_path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(folder) else spark.createDataFrame([], schema)


def with_end(spark: SparkSession, stream: DataFrame, ts: str = "ts") -> tuple[DataFrame, str]:
    """The stream and, with it, what comes to a new folder, for the row that tells that all has come: see ``run_to_end``."""
    folder = shared_path(spark, "end")
    fs, p = hadoop_path(spark, folder)
    fs.mkdirs(p)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), folder


def run_to_end(stream: DataFrame, logs: DataFrame, end: str, table: DataFrame, mode: str = "append", ts: str = "ts") -> DataFrame:
    """``run_once`` over a table that gets no more rows, so that nothing is left waiting for its time.

    ``logs, end`` are what ``with_end`` gave and ``stream`` is made from them. When all rows have been taken a row of nulls that
    is a day later comes to the folder, and the run goes on from its state: the watermark passes all other rows. That row waits for ever.
    """
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    done = run_once(stream, mode, path=path)
    last = table.agg((F.max(ts) + F.expr("interval 1 day")).alias(ts)).where(F.col(ts).isNotNull())
    nulls = [F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in logs.schema]
    row = last.select(*nulls)
    if row.isEmpty():
        return done
    row.write.mode("append").parquet(end)
    return run_once(stream, mode, path=path)
