"""References to records that do not exist: a range-partitioned, vectorised probe of sorted parent arrays.

Keys are cut into ranges by quantiles of both a sample of the parents and one of the references, and a key that many
references name is a range of its own. A range's parents are held as one sorted array; the references of the range stream
past it in Arrow batches and are looked up by binary search. Only a range that draws more references than one task should
look up is salted (in effect, the range of one hot key, whose copies are of one parent). Ranges are laid out on tasks by
their load, and rows go to their task directly. Samples are bounded and only move the cuts and the layout: every parent and
reference is looked up."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.sources.tables import durable

NONE_US = np.iinfo(np.int64).min


SAMPLE = 16_384


def sample(df: DataFrame, least: int = 256) -> tuple[list[bytes], int]:
    """The `_key` of about SAMPLE rows drawn by the hash `_h` (all, if there are fewer), sorted, and about how many rows there are.

    The number is told from how densely the `least` least hashes lie (exact if there are no more; else within about a
    sixteenth), so that the driver gets no more than `least` hashes a partition and then the sample, whatever the rows."""
    low = [r[0] for r in df.select("_h").orderBy("_h").limit(least).collect()]
    n = len(low) if len(low) < least else round((len(low) - 1) / max(low[-1], 1) * _SPACE)
    some = df if n <= SAMPLE else df.where(F.col("_h") < int(SAMPLE / n * _SPACE))
    return sorted(r[0].encode() for r in some.select("_key").collect()), n


_SPACE = 1 << 62


def _hash(*cols: str) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit(_SPACE - 1))


def layout(parents: list[bytes], refs: list[bytes], n_refs: int, ranges: int, per_task: int) -> tuple[list[bytes], list[int], list[int]]:
    """(cuts, salts of each range, task of each salt), from sorted samples. Range i holds the keys from cut i-1 to below cut i."""
    cuts = {p[len(p) * i // ranges] for p in (parents, refs) if p for i in range(1, ranges)}
    for key, n in Counter(refs).items():
        if n > 8 and n * ranges > len(refs):  # as many as a whole range should draw: alone in its range
            cuts |= {key, key + b"\x01"}
    cuts = sorted(cuts)
    load, weight = [0] * (len(cuts) + 1), n_refs / max(len(refs), 1)
    for key, n in Counter(refs).items():
        load[bisect_right(cuts, key)] += n
    salts = [max(1, round(n * weight / per_task)) for n in load]
    tasks = [(0.0, t) for t in range(max(ranges, -(-n_refs // per_task)))]
    place = [0] * sum(salts)
    each = sorted(((n * weight / s + 1, i) for i, (n, s) in enumerate((n, s) for n, s in zip(load, salts) for _ in range(s))), reverse=True)
    for n, i in each:  # the heaviest first, each to the task that has least
        had, t = heappop(tasks)
        place[i] = t
        heappush(tasks, (had + n, t))
    return cuts, salts, place


def _range_of(cuts: np.ndarray, keys: pa.Array) -> np.ndarray:
    return np.searchsorted(cuts, _bytes(keys), side="right").astype(np.int32) if len(cuts) else np.zeros(len(keys), np.int32)


def _bytes(keys: pa.Array) -> np.ndarray:
    """UTF-8 bytes as a numpy array in byte order; long keys widen the array of their batch only."""
    got = np.array(pc.cast(keys, pa.binary()).to_pylist(), dtype=object)
    return got if len(got) and max(map(len, got)) > 256 else got.astype("S")


def _like(cut: np.ndarray) -> np.ndarray:
    return cut if len(cut) and max(map(len, cut)) > 256 else cut.astype("S")


def _route(cuts: list[bytes], salts: list[int], place: list[int], is_ref: bool):
    """Adds the bucket of a row, and its task: the place of its range's first salt, plus a salt for a reference, once per salt for a parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, many, task = _like(np.array(cuts, dtype=object)), np.array(salts, np.int64), np.array(place, np.int32)
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        for b in batches:
            if not b.num_rows:
                continue
            at = _range_of(cut, b.column(0))
            if is_ref:
                salt = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) % many[at]
                bucket, rows = first[at] + salt, b
            else:
                reps = many[at]
                rows = b.take(pa.array(np.repeat(np.arange(b.num_rows), reps)))
                bucket = np.repeat(first[at], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(bucket.astype(np.int32)), pa.array(task[bucket])], [*rows.schema.names, "_bucket", "_task"])

    return run


_OUT = "evaluation_id bigint, ref_table string, state string, period string"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, parents first. Only one bucket's parents are held."""
    bucket, parts, keys, info = None, [], None, None
    for b in batches:
        if not b.num_rows:
            continue
        buckets = b.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            part = b.slice(lo, hi - lo)
            if buckets[lo] != bucket:
                bucket, parts, keys = buckets[lo], [], None
            n_par = int(np.searchsorted(part.column(1).to_numpy(zero_copy_only=False), 1))
            if n_par:
                parts.append(part.slice(0, n_par).select([2, 4, 5, 6, 3]))
            if n_par == part.num_rows:
                continue
            if keys is None:
                keys, info = _sorted(parts)
                parts = []
            yield _misses(part.slice(n_par), keys, info)


def _sorted(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parents as arrays in the order of table and key, each closed by a byte that numpy does not strip."""
    if not parts:
        return np.array([], "S1"), [np.array([], np.int64), np.array([], bool), np.array([], bool)]
    t = pa.Table.from_batches(parts).combine_chunks()
    keys = _bytes(_tagged(t.column(4).combine_chunks(), t.column(0).combine_chunks()))
    order = np.argsort(keys, kind="stable")
    at = pc.fill_null(t.column(1), int(NONE_US)).to_numpy()
    return keys[order], [at[order], t.column(2).to_numpy()[order], t.column(3).to_numpy()[order]]


def _tagged(table: pa.Array, key: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pc.cast(table, pa.string()), pc.cast(key, pa.string()), "", "\x01")


def _misses(refs: pa.RecordBatch, keys: np.ndarray, info: list[np.ndarray]) -> pa.RecordBatch:
    want = _bytes(_tagged(refs.column(3), refs.column(2)))
    if keys.dtype != want.dtype and (keys.dtype == object or want.dtype == object):
        keys, want = keys.astype(object), want.astype(object)
    at = np.searchsorted(keys, want)
    hit = np.zeros(len(want), bool)
    ok = at < len(keys)
    hit[ok] = keys[at[ok]] == want[ok]
    at = np.where(hit, at, 0)
    pick = lambda x, fill: np.where(hit, x[at], fill) if len(x) else np.full(len(hit), fill)
    born, there, gone = pick(info[0], NONE_US), pick(info[1], False), pick(info[2], False)
    when = pc.fill_null(refs.column(4), int(NONE_US)).to_numpy(zero_copy_only=False)
    late = there & (born != NONE_US) & (when != NONE_US) & (born > when)
    state = np.where(late, "late", np.where(there, "", np.where(gone, "deleted", "missing")))
    bad = np.flatnonzero(state != "")
    rows = refs.take(pa.array(bad))
    return pa.RecordBatch.from_arrays([rows.column(7), rows.column(3), pa.array(state[bad].tolist(), pa.string()), rows.column(8)], ["evaluation_id", "ref_table", "state", "period"])


def orphans(refs: DataFrame, parents: DataFrame, ranges: int | None = None, refs_per_task: int = 2_000_000, parents_per_range: int = 250_000) -> DataFrame:
    """References that do not hold: (evaluation_id, ref_table, state, period), one row per referring id and table.

    refs: id BIGINT, ref_table, key STRING, at BIGINT (microseconds, or null), period STRING; a null key refers to nothing.
    parents: ref_table, key STRING, first_at BIGINT, present BOOLEAN (a record exists), deleted BOOLEAN; one row per table
    and key. state: `missing`, `deleted` (gone, and no record) or `late` (the record is there but its first_at is after the
    reference's at; never when either is null). Rows delivered twice, with equal id, come out once. Without parents every
    reference is missing; without references the result is empty.
    ranges: how many at least; else as many as the session's shuffle partitions, and enough for the parents."""
    spark = refs.sparkSession
    par = durable(parents).where(F.col("key").isNotNull()).select(F.col("key").alias("_key"), F.col("ref_table").alias("_table"), F.col("first_at").alias("_at"), F.col("present").alias("_in"), F.col("deleted").alias("_gone"))
    ref = refs.where(F.col("key").isNotNull()).select(F.col("key").alias("_key"), F.col("ref_table").alias("_table"), F.col("at").alias("_at"), F.col("id").alias("_id"), F.col("period").alias("_period"), _hash("id", "ref_table").alias("_h"))
    known, n_parents = sample(par.withColumn("_h", _hash("_key", "_table")))
    asked, n_refs = sample(ref)
    ranges = max(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_parents // parents_per_range))
    per = max(1, min(refs_per_task, -(-n_refs // ranges)))
    cuts, salts, place = layout(known, asked, n_refs, ranges, per)
    schema = "_key string, _table string, _at bigint"
    p = par.mapInArrow(_route(cuts, salts, place, False), f"{schema}, _in boolean, _gone boolean, _bucket int, _task int")
    r = ref.mapInArrow(_route(cuts, salts, place, True), f"{schema}, _id bigint, _period string, _h bigint, _bucket int, _task int")
    cols = ["_bucket", "_ref", "_key", "_table", "_at", "_in", "_gone", "_id", "_period", "_task"]
    p = p.select("_bucket", F.lit(0).alias("_ref"), "_key", "_table", "_at", "_in", "_gone", F.lit(None).cast("bigint").alias("_id"), F.lit(None).cast("string").alias("_period"), "_task")
    r = r.select("_bucket", F.lit(1).alias("_ref"), "_key", "_table", "_at", F.lit(None).cast("boolean").alias("_in"), F.lit(None).cast("boolean").alias("_gone"), "_id", "_period", "_task")
    flow = p.unionByName(r).select(*cols).repartitionById(max(place) + 1, F.col("_task")).sortWithinPartitions("_bucket", "_ref")
    return flow.mapInArrow(_probe, _OUT).dropDuplicates(["evaluation_id", "ref_table"])


def report(found: DataFrame) -> DataFrame:
    """Orphan references counted by referenced table, state and period."""
    return found.groupBy("ref_table", "state", "period").agg(F.count(F.lit(1)).alias("n_refs"))
