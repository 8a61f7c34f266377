"""All pairs of set-valued records whose Jaccard similarity reaches a threshold, by T-occurrence list merging.

Equal sets are first folded into classes, so copies never meet each other. Each class is sent to the partitions of the
inverted index that a partner must share: those of its rarest items (a pair's first common item lies among the first
|s| - ceil(t|s|) + 1 of each set, rare items first). An item in the prefix of too many classes is refined by the pair's second
common item, and by its third; what is still too large is cut into blocks that meet two at a time. Small sets may reach t
with no further item in common than those shared so far: beside every refinement they meet in a partition of their own, for
pairs that share exactly these. So partitions stay bounded and no pair is lost. Within a partition, classes probe inverted lists in order of size: the longest lists are set aside, the
rest are merged by a heap that skips ahead wherever an overlap can't be reached, and candidates are completed by binary
search in the long lists. A pair comes out once, in the partition of its first common items."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.keys import WHITE
from kelpie.operators.arrowrun import starts
from kelpie.sources.tables import durable

_EPS = 1e-9
_BITS = 57  # of an item's code that its hash takes; the six above hold how common it is


def normal_items(items) -> F.Column:
    """Distinct items without surrounding white space and in lower case; blank and null ones left out."""
    tidy = F.transform(items, lambda x: F.lower(F.btrim(x, F.lit(WHITE))))
    return F.array_distinct(F.filter(tidy, lambda x: x.isNotNull() & (x != "")))


def encoded(df: DataFrame, id_col: str, items: str, min_size: int) -> DataFrame:
    """(id, codes): each set of at least min_size items as ascending 63-bit codes, rare items first.

    An item's code is its frequency class above its hash; codes are proven distinct, else another hash seed is taken."""
    sets = durable(df.select(F.col(id_col).alias("id"), normal_items(F.col(items)).alias("toks")).where(F.col("id").isNotNull() & (F.size("toks") >= min_size)))
    one = sets.select("id", F.explode("toks").alias("tok"))
    counts = durable(one.groupBy("tok").agg(F.count(F.lit(1)).alias("n")))
    total, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    for seed in range(64):
        mixed = F.xxhash64(F.lit(seed), F.col("tok")).bitwiseAND(F.lit((1 << _BITS) - 1))
        klass = F.least(F.floor(2 * F.log2("n")), F.lit(63)).cast("bigint")
        book = counts.select("tok", "n", F.shiftleft(klass, _BITS).bitwiseOR(mixed).alias("code"))
        if not kinds or book.agg(F.count_distinct("code")).first()[0] == kinds:
            break
    else:
        raise RuntimeError("no collision-free hash found")
    # Items with over a 4096th of all occurrences number under 4096, so they may be broadcast; the rest have no skew to join.
    limit = (total or 0) / 4096
    hot = F.broadcast(book.where(F.col("n") > limit).select(F.col("tok").alias("htok"), F.col("code").alias("hcode")))
    cold = book.where(F.col("n") <= limit).select(F.col("tok").alias("ctok"), F.col("code").alias("ccode"))
    lone = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
    one = one.join(hot, F.col("tok") == F.col("htok"), "left").withColumn("key", F.when(F.col("hcode").isNull(), F.col("tok")).otherwise(lone))
    one = one.join(cold, F.col("key") == F.col("ctok"), "left").select("id", F.coalesce("hcode", "ccode").alias("code"))
    return durable(one.groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("codes")))


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, codes, n) of each distinct set, class_id being its least id; (id, class_id, n) of each member of a class of two or more."""
    every = durable(sets.groupBy("codes").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    total = every.agg(F.sum("n")).first()[0] or 0
    multi = every.where(F.col("n") > 1)
    name = lambda d, h: d.select(F.col("codes").alias(f"{h}codes"), F.col("class_id").alias(f"{h}id"), F.col("n").alias(f"{h}n"))
    # Sets that a 4096th of all records bear number under 4096, so they may be broadcast; the rest have no skew to join.
    hot, cold = F.broadcast(name(multi.where(F.col("n") > total / 4096), "h")), name(multi.where(F.col("n") <= total / 4096), "c")
    near = sets.join(hot, F.col("codes") == F.col("hcodes"), "left")
    far = near.where(F.col("hid").isNull()).join(cold, F.col("codes") == F.col("ccodes")).select("id", F.col("cid").alias("class_id"), F.col("cn").alias("n"))
    return every, near.where(F.col("hid").isNotNull()).select("id", F.col("hid").alias("class_id"), F.col("hn").alias("n")).unionByName(far)


def _least(t: float, s) -> F.Column:
    """The least overlap that a set of size s has with any partner."""
    return F.ceil(s * F.lit(t) - F.lit(_EPS)).cast("int")


def _flag(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The keys that more than `limit` rows hold, with their counts, and how many they are."""
    big = durable(rows.groupBy("key").agg(F.count(F.lit(1)).alias("heavy")).where(F.col("heavy") > limit).select(F.col("key").alias("b_key"), "heavy"))
    return big, big.count()


def _mark(rows: DataFrame, big: DataFrame, n_big: int) -> DataFrame:
    if not n_big:
        return rows.withColumn("heavy", F.lit(None).cast("bigint"))
    return rows.join(F.broadcast(big) if n_big <= 100_000 else big, F.col("key") == F.col("b_key"), "left").drop("b_key")


_DEEPEST = 3


def similar_classes(classes: DataFrame, t: float, limit: int = 4000, min_size: int = 1) -> DataFrame:
    """(a, b): pairs of classes, a < b, whose sets have a Jaccard similarity of at least t.

    limit: how many classes a partition of the index may hold before it is refined (twice at most) or cut into blocks.
    min_size: the least size of the sets, if known."""
    s = F.size("codes")
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    cols = ["id", "codes", "p", "key", "depth", "lone"]
    base = classes.select(F.col("class_id").alias("id"), "codes")
    rows = base.select("id", "codes", F.posexplode(F.slice("codes", F.lit(1), s - _least(t, s) + 1)).alias("p", "w"))
    rows = rows.select("id", "codes", "p", hexed("w").alias("key"), F.lit(1).alias("depth"), F.lit(False).alias("lone"))
    done = None
    for depth in range(1, _DEEPEST + 1):
        big, n = _flag(rows, limit)
        rows = _mark(rows, big, n)
        if not n or depth == _DEEPEST:
            done = rows if done is None else done.unionByName(rows)
            break
        fine = rows.where(F.col("heavy").isNull())
        done = fine if done is None else done.unionByName(fine)
        heavy = rows.where(F.col("heavy").isNotNull()).drop("heavy")
        if math.ceil(t * min_size - _EPS) <= depth:  # pairs that share no more than these items
            lone = heavy.where(_least(t, s) <= depth).select("id", "codes", "p", F.concat("key", F.lit("-")).alias("key"), "depth", F.lit(True).alias("lone"))
            big, n = _flag(lone, limit)
            done = done.unionByName(_mark(lone, big, n))
        # A pair's next common item lies among the first |s| - ceil(t|s|) + 1 + depth items of each set.
        after = F.slice("codes", F.col("p") + 2, s - _least(t, s) + depth - F.col("p"))
        rows = heavy.select("id", "codes", "key", F.col("p").alias("q"), F.posexplode(after).alias("i", "w"))
        rows = rows.select("id", "codes", (F.col("q") + 1 + F.col("i")).alias("p"), F.concat("key", hexed("w")).alias("key"), F.lit(depth + 1).alias("depth"), F.lit(False).alias("lone"))
    blocks = F.coalesce(F.ceil(F.col("heavy") / limit), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    sig = done.select(*cols, "heavy").withColumn("nb", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    sig = sig.select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "depth", "lone", "p", s.alias("size"), "id", "codes")
    sig = sig.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "size", "id")
    return sig.mapInArrow(_merge(t), "a string, b string")


def _merge(t: float):
    keys = ["key", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            edges = np.flatnonzero(starts(b, keys, None)).tolist()
            if held and not _same(held[-1], b, keys):
                yield from _out(held, t)
                held = []
            edges = [*edges, b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo:
                    yield from _out(held, t)
                    held = []
                held.append(b.slice(lo, hi - lo))
        yield from _out(held, t)

    return run


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(i)[a.num_rows - 1].as_py() == b.column(i)[0].as_py() for i in range(len(keys)))


def _out(held: list[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    if sum(b.num_rows for b in held) < 2:
        return
    first = {n: held[0].column(i)[0].as_py() for i, n in enumerate(held[0].schema.names)}
    col = lambda n: [x for b in held for x in b.column(b.schema.get_field_index(n)).to_pylist()]
    side = col("own") if first["b1"] != first["b2"] else None
    pairs = exactly(col("id"), col("codes"), col("size"), t, first["depth"], side) if first["lone"] else occurrences(col("id"), col("codes"), col("p"), col("size"), t, first["depth"], side)
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs]), pa.array([max(p) for p in pairs])], ["a", "b"])


def occurrences(ids: list[str], codes: list[list[int]], at: list[int], sizes: list[int], t: float, depth: int, side: list[int] | None = None) -> list[tuple[str, str]]:
    """Similar pairs of one partition, whose records come by rising size and share `depth` items, the last of them at `at`.

    side: if given, only records of different sides are paired."""
    lists: dict[int, list[int]] = {}
    out, n = [], len(ids)
    shared = set()
    if n:
        last = at[0]
        shared = {codes[0][last]}
    for r in range(n):
        s, mine = sizes[r], codes[r]
        tail = mine[at[r] + 1 :]
        lo = bisect_left(sizes, math.ceil(t * s - _EPS))
        if lo < r:
            need = math.ceil(t * s - _EPS) - depth
            head = set(mine[: at[r] + 1]) - shared
            for y, common in _candidates(tail, lists, lo, r, need):
                total = common + depth
                if total < math.ceil(t / (1 + t) * (s + sizes[y]) - _EPS) or (side is not None and side[y] == side[r]):
                    continue
                other = codes[y][: at[y] + 1]
                both = sum(x in head for x in other)
                if both == depth - 1:  # else an earlier item is common, and the pair comes out there
                    out.append((ids[r], ids[y]))
        for w in tail:
            if (got := lists.get(w)) is None:
                lists[w] = [r]
            else:
                got.append(r)
    return out


def exactly(ids: list[str], codes: list[list[int]], sizes: list[int], t: float, depth: int, side: list[int] | None = None) -> list[tuple[str, str]]:
    """Similar pairs of one partition, by rising size, whose records share its `depth` items and no other."""
    out, most = [], depth * (1 + t) / t + _EPS  # of the two sizes together
    for r, s in enumerate(sizes):
        mine = set(codes[r])
        lo, hi = bisect_left(sizes, math.ceil(t * s - _EPS)), min(r, bisect_right(sizes, math.floor(most - s)))
        for y in range(lo, hi):
            if (side is None or side[y] != side[r]) and sum(x in mine for x in codes[y]) == depth:
                out.append((ids[r], ids[y]))
    return out


def _candidates(tail: list[int], lists: dict[int, list[int]], lo: int, r: int, need: int) -> Iterator[tuple[int, int]]:
    """(record, overlap of the tails) of the indexed records from lo on that occur in at least `need` lists of the tail."""
    if need <= 0:  # the shared items do already
        mine = [x for w in tail if (x := lists.get(w))]
        for y in range(lo, r):
            yield y, sum(1 for x in mine if (i := bisect_left(x, y)) < len(x) and x[i] == y)
        return
    found = [x for w in tail if (x := lists.get(w)) and x[-1] >= lo]
    if len(found) < need:
        return
    found.sort(key=len)
    long = min(need - 1, sum(len(x) > 8 for x in found)) if need > 1 else 0  # lists that only binary search touches
    short, big = found[: len(found) - long], found[len(found) - long :]
    least = need - long
    place = [bisect_left(x, lo) for x in short]
    heap = [(x[i], k) for k, (x, i) in enumerate(zip(short, place)) if i < len(x)]
    heapify(heap)
    while len(heap) >= least:
        y, popped = heap[0][0], []
        while heap and heap[0][0] == y:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            count = len(popped)
            for x in big:
                i = bisect_left(x, y)
                count += i < len(x) and x[i] == y
            if count >= need:
                yield y, count
            for k in popped:
                place[k] += 1
                if place[k] < len(short[k]):
                    heappush(heap, (short[k][place[k]], k))
        else:
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            y = heap[0][0]  # no record before it can occur often enough
            for k in popped:
                place[k] = bisect_left(short[k], y, place[k])
                if place[k] < len(short[k]):
                    heappush(heap, (short[k][place[k]], k))


def similar_pairs(df: DataFrame, id_col: str, items: str, t: float = 0.8, min_size: int = 4, expand: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership) of a table with one row per id.

    pairs: (a, b), a < b: records whose sets reach the similarity t, copies included. A class of more than `expand` equal
    sets isn't multiplied out: its members are paired with its representative, and only that one with other classes.
    membership: (id, class_id, n_links): every record's class and the number of other classes similar to it; the two
    together hold every link. Null, empty and small sets take no part; ties and repeated items don't matter; extra
    columns are ignored; an empty table gives empty results."""
    sets = encoded(df, id_col, items, min_size)
    classes, members = classes_of(sets)
    members = durable(members)
    links = durable(similar_classes(classes, t, min_size=min_size))
    few = members.where(F.col("n") <= expand)
    grow = lambda d, c: d.join(few.select(F.col("class_id").alias(c), F.col("id").alias(f"m{c}")), c, "left").withColumn(c, F.coalesce(f"m{c}", c)).drop(f"m{c}")
    across = grow(grow(links, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    x, y = few.select("class_id", F.col("id").alias("a")), few.select("class_id", F.col("id").alias("b"))
    within = x.join(y, "class_id").where(F.col("a") < F.col("b")).select("a", "b")
    star = members.where((F.col("n") > expand) & (F.col("id") != F.col("class_id"))).select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    own = sets.join(members.select("id", "class_id"), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    membership = own.join(degree, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return across.unionByName(within).unionByName(star), membership
