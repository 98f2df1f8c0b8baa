"""The refresh jobs as Structured Streaming queries.

Results go to Parquet, one partition per batch id. A batch that is repeated after a failure replaces
its own partition, so every result is exactly once. State and checkpoints live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from weekpanel.operators.rows import branch_key
from weekpanel.plans.scoring import TEXT, analysis_text, digest, lexicon_scores
from weekpanel.sources.upsert import append_batch, latest_per_key, refresh_partitions
from weekpanel.sources.versions import commit, current, prune, remove


def stream_weekly_counts(events: DataFrame, ts: str, keys: Sequence[str], delay: str = "14 days") -> DataFrame:
    """Events per key in Saturday-to-Friday windows, late events within the delay included.

    Epoch day 0 was a Thursday, so weeks start two days after it. The label is the Friday. A hot key
    costs one partial count per task and window.
    """
    timed = events.withColumn(ts, instant(events, ts))
    weeks = F.window(ts, "7 days", "7 days", "2 days").alias("week")
    counted = timed.withWatermark(ts, delay).groupBy(*keys, weeks).agg(F.count(F.lit(1)).alias("n"))
    friday = F.date_from_unix_date((F.floor(F.unix_seconds("week.end") / 86400) - 1).cast("int"))
    return counted.select(*keys, friday.alias("WeekEndingFriday"), "n")


def instant(df: DataFrame, ts: str) -> Column:
    """Event time for a watermark. A time without zone is UTC, whatever the session zone is."""
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")
    return c


def stream_dedup_news(articles: DataFrame, delay: str = "14 days") -> DataFrame:
    """First copy of every article inside the delay.

    Articles with a valid id are copies by (ID, Ticker), those without one by ticker, time, headline and summary. Both
    kinds share one stateful step over a digest of their key, so no text is kept as state.
    """
    timed = articles.withColumn("Date", instant(articles, "Date")).withWatermark("Date", delay)
    key = branch_key("ID", "Ticker", [c for c in ("Date", "Headline", "Summary") if c in articles.columns])
    return timed.withColumn("_key", key).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Each batch in its own partition of ``path``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, batch_id: append_batch(df, path, batch_id)
    )


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest count of every key and week: the compacted version, if there is one, and the batches stored since."""
    kept = current(spark, f"{path}_compacted")
    later = spark.read.parquet(path) if batch_numbers(spark, path) else None
    rows = later if kept is None else kept if later is None else kept.unionByName(later)
    return latest_per_key(rows, [*keys, "WeekEndingFriday"])


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Fold all stored batches into one version of the newest row per key, remove their folders, and return how many there were.

    A reader sees the old version and the batches until the new version is finished. Batches that were folded are removed after
    that, so a failure in between leaves rows twice, of which the newest counts all the same.
    """
    done = batch_numbers(spark, path)
    if not done:
        return 0
    kept = current(spark, f"{path}_compacted")
    folded = spark.read.parquet(path).filter(F.col("batch_id").isin(done))
    rows = folded if kept is None else kept.unionByName(folded)
    order = F.struct("batch_id", *[F.col(f"`{c}`") for c in rows.columns if c not in (*keys, "batch_id")])
    newest = rows.groupBy(*keys).agg(F.max(order).alias("_b")).select(*keys, "_b.*")
    commit(newest.select(rows.columns), f"{path}_compacted")
    prune(spark, f"{path}_compacted")
    for number in done:
        remove(spark, f"{path}/batch_id={number}")
    return len(done)


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored batches; only names are listed."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path, "batch_id=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getName().removeprefix("batch_id=")) for f in found)


def stream_upsert(stream: DataFrame, path: str, key: str, checkpoint: str) -> DataStreamWriter:
    """Replace all stored rows of the keys in each batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, _: refresh_partitions(df, path, key)
    )


class FirstOfKey(StatefulProcessor):
    """Passes on the first row of every key and remembers the key; later rows of it, in this batch or any other, are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initial, timer_values) -> None:  # noqa: N802
        self._seen.update((True,))

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        if not self._seen.exists():
            self._seen.update((True,))
            yield next(iter(rows))

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """The first row of each key over the whole life of the stream, by keyed state: each batch meets its own keys only.

    ``known`` holds keys (column ``key``) that count as seen before the first batch; it is read once, when the stream starts anew.
    """
    initial = None if known is None else known.select(F.col(key)).distinct().groupBy(key)
    return stream.groupBy(key).transformWithState(
        statefulProcessor=FirstOfKey(), outputStructType=stream.schema, outputMode="Append", timeMode="None", initialState=initial)


def stream_score_new_texts(articles: DataFrame, cache_path: str, checkpoint: str,
                           scorer: Callable[[DataFrame], DataFrame] = lexicon_scores, known: DataFrame | None = None) -> DataStreamWriter:
    """Score every text when it comes for the first time and add it to the cache, each batch in a partition of its own.

    The digests of scored texts are the stream's state, kept in its checkpoint; the cache itself is never read. ``known`` is an older
    cache that the stream takes over at its first start. Needs ``rocksdb`` as state store (``keyed_state``).
    """
    texts = analysis_text(articles).filter(F.col(TEXT) != "").select(digest(TEXT).alias("digest"), TEXT)
    old = None if known is None else known.select(digest(TEXT).alias("digest")).filter("digest is not null")
    fresh = first_of_key(texts, "digest", old).select(TEXT)
    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, number: append_batch(scorer(df), cache_path, number)
    )


def keyed_state(spark: SparkSession) -> None:
    """Settings that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
