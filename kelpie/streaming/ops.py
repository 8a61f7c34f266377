"""Structured Streaming operators (Z, S09, S10).

A stream is bounded in the tests by the availableNow trigger; state is bounded by watermarks or timeouts. The event time of
the supplied tables has no zone and is read as UTC."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpie.operators.relational import latest_by
from kelpie.sources.formats import scratch


def source(spark: SparkSession, path: str, schema: str, time: str | None = None, late: str = "10 minutes", per_trigger: int = 64) -> DataFrame:
    """A stream of parquet files; `time` becomes the event time, with a watermark. The path may be one file or a folder."""
    glob = path.replace(".parquet", ".parque[t]")
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(glob)
    if time:
        out = out.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return out


def run(stream: DataFrame, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Run a stream over what is there and keep its output as parquet, with the batch that made each row; returns the path."""
    spark, out, state = stream.sparkSession, scratch(stream.sparkSession), scratch(stream.sparkSession)

    def keep(batch: DataFrame, n: int) -> None:
        (each or (lambda b, i: b.withColumn("_batch", F.lit(i).cast("long")).write.mode("append").parquet(out)))(batch, n)

    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0).cast("long")).write.parquet(out)  # a result without rows has columns, too
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return out


def result(stream: DataFrame, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """The output of a stream; in update mode the last version of every key."""
    out = stream.sparkSession.read.parquet(run(stream, mode=mode))
    return (latest_by(out, keys, [F.desc("_batch")]) if keys else out).drop("_batch")


def lanes(stream: DataFrame, background: list[str], kind: str = "event_type") -> tuple[DataFrame, DataFrame]:
    """(user lane, background lane). Nothing is dropped: backpressure is the source's."""
    low = F.col(kind).isin(*background)
    return stream.where(~low), stream.where(low)


def drop_oldest(stream: DataFrame, order: list[str], size: int) -> str:
    """A bounded lane: the path of what it holds at the end, the newest `size` rows by `order`; on overflow the oldest are dropped.

    What the lane holds is kept from batch to batch, each batch's state under its own number, so a replayed batch replaces its own."""
    spark, root = stream.sparkSession, scratch(stream.sparkSession)
    last: dict[str, str] = {}

    def each(batch: DataFrame, n: int) -> None:
        held = spark.read.parquet(last["path"]).unionByName(batch) if n > 0 and "path" in last else batch
        held.orderBy(*[F.desc(c) for c in order]).limit(size).write.mode("overwrite").parquet(f"{root}/{n}")
        last["path"] = f"{root}/{n}"

    stream.writeStream.option("checkpointLocation", scratch(spark)).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    if "path" not in last:
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{root}/0")
    return last.get("path", f"{root}/0")


def pools(df: DataFrame, kind: str, key: str, per_worker: int, most: int = 8) -> DataFrame:
    """Df with `workers`, how many its type has (1 to `most`, one for every `per_worker` rows begun), and `worker`, the one that takes the row.

    Types are joined back by their counts; one type's load is spread over its workers by the key."""
    n = df.groupBy(F.col(kind).alias("_kind")).agg(F.count(F.lit(1)).alias("_n"))
    workers = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("_n") / per_worker))).cast("int")
    return df.join(n.select("_kind", workers.alias("workers")), F.col(kind).eqNullSafe(F.col("_kind"))).drop("_kind").withColumn("worker", F.pmod(F.col(key), F.col("workers")).cast("int"))


def retained(df: DataFrame, key: str, time: str, idle: str) -> DataFrame:
    """Rows of the keys whose newest row is no older than `idle` before the newest of all; null times don't count."""
    last = df.groupBy(F.col(key).alias("_key")).agg(F.max(time).alias("_last"))
    mark = last.agg(F.max("_last").alias("_mark"))
    live = last.crossJoin(F.broadcast(mark)).where(F.col("_last") >= F.col("_mark") - F.expr(f"INTERVAL {idle}")).select("_key")  # one row
    return df.join(live, F.col(key) == F.col("_key"), "left_semi")


def in_parts(parts: list[DataFrame]) -> str:
    """A folder that got its files one part after the other, so that a stream with one file a trigger sees them in that order."""
    out = scratch(parts[0].sparkSession)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(out)
    return out


def suppress(stream: DataFrame, kinds: list[str], generated, kind: str = "event_type") -> DataFrame:
    """High-frequency events of generated sessions are left out."""
    return stream.where(~(F.col(kind).isin(*kinds) & generated))


def throughput(stream: DataFrame, time: str, width: str, by: str) -> DataFrame:
    """Events per type and tumbling window."""
    return stream.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def zero_fill(counts: DataFrame, by: str, width: str) -> DataFrame:
    """Every type in every window between the first and the last; the number of windows is the span over the width."""
    span = counts.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {width}"))).alias("start")).crossJoin(F.broadcast(counts.select(by).distinct()))  # windows by types
    return grid.join(counts, ["start", by], "left").select("start", by, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def host_metrics(stream: DataFrame, time: str, width: str, value: str, tie: str) -> DataFrame:
    """Mean, last and greatest value per window; windows without events are absent."""
    w = stream.groupBy(F.window(time, width).alias("w")).agg(F.avg(value).alias("mean"), F.max_by(value, F.struct(time, tie)).alias("last"), F.max(value).alias("most"))
    return w.select(F.col("w.start").alias("start"), "mean", "last", "most")


def deduplicate(stream: DataFrame, key: str) -> DataFrame:
    """One row per key within the watermark's span."""
    return stream.dropDuplicatesWithinWatermark([key])


def with_dead_letters(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], ok, attempts: int = 5) -> tuple[str, str]:
    """(path of results, path of dead letters). A batch is tried up to `attempts` times; rows for which `ok` is false go to
    the dead letters with a reason. A batch that is replayed after a crash replaces its own output, so none is doubled."""
    spark = stream.sparkSession
    good, dead = scratch(spark), scratch(spark)

    def each(batch: DataFrame, n: int) -> None:
        for tried in range(1, attempts + 1):
            try:
                handle(batch.where(F.coalesce(ok, F.lit(False)))).write.mode("overwrite").parquet(f"{good}/batch={n}")
                batch.where(~F.coalesce(ok, F.lit(False))).withColumn("attempts", F.lit(tried)).withColumn("reason", F.lit("rejected")).write.mode("overwrite").parquet(f"{dead}/batch={n}")
                return
            except Exception:
                if tried == attempts:
                    batch.withColumn("attempts", F.lit(tried)).withColumn("reason", F.lit("failed")).write.mode("overwrite").parquet(f"{dead}/batch={n}")

    stream.writeStream.option("checkpointLocation", scratch(spark)).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return good, dead


def rate_limit(stream: DataFrame, key: str, time: str, order: str, n: int, seconds: int) -> DataFrame:
    """(key, order, allowed): at most n per window that starts at the key's first request after the last window's end.

    The state of a key is its window's start and count; it is dropped once event time has passed the window."""
    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values([time, order])
        got = []
        for t, o in zip(rows[time], rows[order]):
            ms = int(t.value // 1_000_000)
            if start is None or ms >= start + seconds * 1000:
                start, used = ms, 0
            used += 1
            got.append((k[0], o, used <= n))
        state.update((start, used))
        state.setTimeoutTimestamp(max(start + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(got, columns=["key", "id", "allowed"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"key {kinds[key]}, id {kinds[order]}, allowed boolean", "start bigint, used int", "append", GroupStateTimeout.EventTimeTimeout)


#: The states of a node and which may follow which.
NEXT = {"pending": {"running", "skipped"}, "running": {"done", "failed"}, "done": set(), "failed": set(), "skipped": set()}


def node_states(stream: DataFrame, key: str, time: str, status: str) -> DataFrame:
    """(key, state, refused) after every batch: a transition that the table doesn't allow is refused and counted."""
    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, refused = state.get if state.exists else ("pending", 0)
        for s in pd.concat(list(frames)).sort_values(time)[status]:
            if s in NEXT[now]:
                now = s
            elif s != now:
                refused += 1
        state.update((now, refused))
        yield pd.DataFrame([(k[0], now, refused)], columns=["key", "state", "refused"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, state string, refused int", "state string, refused int", "update", GroupStateTimeout.NoTimeout)


def paused(df: DataFrame, series: list[str], order: list[str], depth: str, high: int, low: int) -> DataFrame:
    """Df with `paused`: from a depth of `high` until one of `low`, within each series; the last depth that says either way counts."""
    said = F.when(F.col(depth) >= high, F.lit(True)).when(F.col(depth) <= low, F.lit(False))
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("paused", F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit(False)))


def hysteresis(depths: list[int], high: int, low: int) -> list[bool]:
    """Paused from a depth of `high` until one of `low`."""
    out, paused = [], False
    for d in depths:
        paused = d > low if paused else d >= high
        out.append(paused)
    return out


def shadow(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict) of rows that two engines' outputs don't share: only_left, only_right or differs."""
    rest = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*rest).alias("_x"), F.lit(True).alias("_a"))
    y = b.select(*keys, F.struct(*rest).alias("_y"), F.lit(True).alias("_b"))
    both = x.join(y, keys, "full_outer")
    verdict = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(~F.col("_x").eqNullSafe(F.col("_y")), "differs")
    return both.select(*keys, verdict.alias("verdict")).where("verdict is not null")
