"""Mixing sources to target weights by Pfair scheduling.

Documents of a source go in blocks. With integer weights that add up to a frame of W
slots, block j (from 1) of a source of weight w is released at slot floor((j-1) W / w)
and due by slot ceil(j W / w); in each slot the released block with the earliest
deadline goes next. On one sequence of slots this meets all deadlines, so at any
point each source is less than one block away from its target.

The pattern repeats every W slots, so one frame is scheduled and every block's slot
follows from its number. When a source runs out, the others go on in a new phase with
their weights renormalised; nothing is dropped or repeated. Only the frames are made on
the driver: at most (sources x W) numbers, both bounded by parameters. Numbering the
documents and looking up slots is done by Spark.

Without weights, sources with few slots of the frame share one group, however many sources there are. It goes
by the same slots; within it documents go by virtual time, (number - offset) / weight, which Spark
sorts: of any number of sources each advances in proportion to its weight. Which sources these are
depends on shares alone, so neither one more source nor more documents of all change the method.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Least number of slots of a frame, and slots per source: weights are rounded to multiples of one over the larger of both.
FRAME, SLOTS_EACH = 1000, 10
#: Sources with slots of their own, as the plan is made on the driver; without weights those with a smaller share than one over it have none.
MAX_SOURCES = 500
#: Without weights, sources with fewer slots of the frame share a group: rounding would move them too far.
LEAST_SLOTS = 10
BLOCK = 8
#: Documents of a source that are numbered together in one task.
BUCKET = 1000
#: Weight key of all sources that have none of their own.
REST = "*"


def integer_weights(weights: Mapping[str, float], frame: int = FRAME) -> dict[str, int]:
    """Positive integers that add up to ``frame`` (or to the number of sources, if more), nearest to the weights.

    What the smallest sources get beyond their share, as each has one slot at least, comes from those that have more than one.
    """
    total = sum(weights.values())
    frame = max(frame, len(weights))
    exact = {s: w / total * frame for s, w in weights.items()}
    whole = {s: max(1, int(x)) for s, x in exact.items()}
    missing = frame - sum(whole.values())
    by_need = sorted(weights, key=lambda s: (whole[s] - exact[s], s))
    for i in range(max(missing, 0)):
        whole[by_need[i % len(by_need)]] += 1
    # The source that is furthest above its share gives first.
    over = [(-(whole[s] - exact[s]), s) for s in whole if whole[s] > 1]
    heapq.heapify(over)
    for _ in range(max(-missing, 0)):
        _, s = heapq.heappop(over)
        whole[s] -= 1
        if whole[s] > 1:
            heapq.heappush(over, (-(whole[s] - exact[s]), s))
    return whole


def frame_slots(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one frame: of the released blocks, the one that is due first."""
    size = sum(weights.values())
    waiting = [(0, -(-size // w), s, 1) for s, w in weights.items()]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for slot in range(size):
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        slots.append(s)
        if j < weights[s]:
            heapq.heappush(waiting, (j * size // weights[s], -(-(j + 1) * size // weights[s]), s, j + 1))
    return slots


def plan(weights: Mapping[str, float], blocks: Mapping[str, int], frame: int = FRAME) -> tuple[list[tuple], list[tuple]]:
    """Phases and frames of the mix.

    Phases: (source, first block, end block, weight, phase, first slot, frame size); frames: (phase,
    source, block within the frame, slot within the frame).
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    phases, frames, at, phase = [], [], 0, 0
    while left:
        whole = integer_weights({s: weights[s] for s in left}, max(frame, SLOTS_EACH * len(left)))
        slots = frame_slots(whole)
        place: dict[str, list[int]] = {s: [] for s in left}
        for slot, s in enumerate(slots):
            place[s].append(slot)
        # The slot after a source's last block, and the first source to get there.
        end = {s: (n - 1) // whole[s] * len(slots) + place[s][(n - 1) % whole[s]] + 1 for s, n in left.items()}
        stop = min(end.values())
        frames += [(phase, s, i, slot) for s, found in place.items() for i, slot in enumerate(found) if slot < stop]
        for s in list(left):
            taken = stop // len(slots) * whole[s] + sum(p < stop % len(slots) for p in place[s])
            if taken:
                phases.append((s, done[s], done[s] + taken, whole[s], phase, at, len(slots)))
            done[s] += taken
            left[s] -= taken
            if left[s] <= 0:
                del left[s]
        at += stop
        phase += 1
    return phases, frames


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, source: str = "source", order: tuple[str, ...] = ("doc_id",),
    block: int = BLOCK, frame: int = FRAME, bucket: int = BUCKET, power: float = 0.5,
) -> DataFrame:
    """All rows, with ``block`` (its number within its source), ``slot`` and ``position``, the place in the mix.

    ``weights`` gives each source's share; ``"*"`` stands for all sources without one (and
    for a null source). Without weights, shares are sizes to the given power. Within a source the order is pseudo-random and
    fixed by ``order``; rows equal in it are interchangeable. The ``block`` of documents
    is the unit of the guarantee: up to each slot, every unfinished source is less than one
    block from its share of the phase. Positions run from 0 without gaps only where
    blocks are full; their order is the mix. Columns named like the three are replaced.

    Without weights, only sources with at least ``LEAST_SLOTS`` slots of a frame (and one in ``MAX_SOURCES`` of the whole) have
    blocks of their own. The others (and null) share ``"*"``, which weighs their sum and runs as one source.
    """
    name = F.coalesce(F.col(source).cast("string"), F.lit(REST))
    if weights is not None and len(weights) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} weights")
    if any(w <= 0 for w in (weights or {}).values()):
        raise ValueError("weights must be positive")
    own = [s for s in weights or {} if s != REST]
    group = name if weights is None else F.when(name.isin(own), name).otherwise(F.lit(REST)) if own else F.lit(REST)
    named = [c for c in docs.columns if c.lower() not in ("block", "slot", "position")]
    inner = [f"c{i}" for i in range(len(named))]  # whatever the columns are called, none is like those made here
    order = tuple(inner[named.index(o)] for o in order)
    docs = docs.select(group.alias("_group"), *(F.col(f"`{c}`").alias(i) for c, i in zip(named, inner)))
    counts = materialise(docs.groupBy("_group").count(), "mix-sources")
    if weights is None:
        sizes, weights = _largest(counts, frame, power)
        own = F.col("_group").isin([s for s in sizes if s != REST])
        numbered = _numbered(docs.where(own), counts.where(own), order, bucket)
        if REST in sizes:
            numbered = numbered.unionByName(_in_virtual_time(docs.where(~own), counts.where(~own), sizes[REST], order, bucket, power))
    else:
        sizes = {r["_group"]: r["count"] for r in counts.collect()}  # one row per weight
        if missing := [s for s in sizes if s not in weights]:
            raise ValueError(f"sources without a weight, and none for {REST!r}: {missing}")
        numbered = _numbered(docs, counts, order, bucket)
    phases, frames = plan(weights, {s: -(-n // block) for s, n in sizes.items()}, frame)
    spark = docs.sparkSession
    p = spark.createDataFrame(phases, "_group string, _first bigint, _end bigint, _weight bigint, _phase int, _at bigint, _frame bigint")
    f = spark.createDataFrame(frames, "_phase int, _group string, _in bigint, _slot bigint")

    # The phases of a source are a short list; each block takes the one it falls in.
    spans = p.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_first", "_end", "_weight", "_phase", "_at", "_frame"))).alias("_phases"))
    placed = numbered.withColumn("block", F.floor(F.col("_number") / block)).join(F.broadcast(spans), "_group")
    placed = placed.withColumn("_p", F.get(F.filter("_phases", lambda x: F.col("block") < x["_end"]), F.lit(0))).drop("_phases")
    since = F.col("block") - F.col("_p._first")
    placed = placed.withColumns({"_phase": F.col("_p._phase"), "_in": since % F.col("_p._weight"), "_turn": F.floor(since / F.col("_p._weight"))})
    placed = placed.join(F.broadcast(f), ["_phase", "_group", "_in"])
    placed = placed.withColumn("slot", F.col("_p._at") + F.col("_turn") * F.col("_p._frame") + F.col("_slot"))
    placed = placed.withColumn("position", F.col("slot") * block + F.col("_number") % block)
    return placed.select(*(F.col(i).alias(c) for c, i in zip(named, inner)), "block", "slot", "position")


def _largest(counts: DataFrame, frame: int, power: float) -> tuple[dict[str, int], dict[str, float]]:
    """Sizes and weights of the sources with enough slots of the frame, and of the rest, if any, as one."""
    weighed = counts.withColumn("_w", F.pow(F.col("count").cast("double"), F.lit(power)))
    whole = weighed.agg(F.sum("_w").alias("w")).first()["w"] or 0.0
    least = max(LEAST_SLOTS / frame, 1 / MAX_SOURCES) * whole  # so at most MAX_SOURCES reach it
    large = weighed.where((F.col("_group") != REST) & (F.col("_w") >= least)).collect()
    rest = weighed.where((F.col("_group") == REST) | (F.col("_w") < least)).agg(F.sum("count").alias("n"), F.sum("_w").alias("w")).first()
    sizes, weights = {r["_group"]: r["count"] for r in large}, {r["_group"]: r["_w"] for r in large}
    if rest["n"]:
        sizes[REST], weights[REST] = rest["n"], rest["w"]
    return sizes, weights


def _in_virtual_time(docs: DataFrame, counts: DataFrame, n: int, order: tuple[str, ...], bucket: int, power: float) -> DataFrame:
    """``_number`` from 0 over all rows as one ``_group``, each source in proportion to its weight.

    Document i (from 1) of a source of weight w goes at (i - u) / w; u, from 0 to 1, is a hash of the source, so
    that small sources do not start together. Rows are sorted in ranges of that time, and each range
    starts where the ones before it end.
    """
    weight = counts.select("_group", F.pow(F.col("count").cast("double"), F.lit(power)).alias("_w"))
    offset = F.pmod(F.xxhash64("_group"), F.lit(1 << 20)) / F.lit(1 << 20)
    timed = _numbered(docs, counts, order, bucket).join(weight, "_group")
    timed = timed.withColumn("_time", (F.col("_number") + 1 - offset) / F.col("_w")).drop("_w")
    by = ("_time", "_group", "_number")
    ranged = timed.repartitionByRange(max(1, -(-n // (100 * bucket))), *by).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "mix-rest")
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*by))).join(starts, "_range")
    placed = placed.withColumns({"_number": F.col("_start") + F.col("_row") - 1, "_group": F.lit(REST)})
    return placed.drop("_time", "_range", "_row", "_start")


def _numbered(docs: DataFrame, counts: DataFrame, order: tuple[str, ...], bucket: int) -> DataFrame:
    """``_number`` from 0 within ``_group``, without any group in one task.

    Rows fall into buckets by a hash of ``order``, many for a large group; they are numbered
    within their bucket, and each bucket starts where the ones before it end. Equal rows share a
    bucket, so a group of very many rows that agree in all of ``order`` is one.
    """
    buckets = counts.select("_group", F.ceil(F.col("count") / bucket).alias("_buckets"))
    spread = docs.withColumn("_hash", F.xxhash64(*order)).join(buckets, "_group")
    spread = spread.withColumn("_bucket", F.pmod(F.col("_hash"), F.col("_buckets"))).drop("_buckets")
    sizes = spread.groupBy("_group", "_bucket").agg(F.count("*").alias("_size"))
    sizes = materialise(sizes, "mix-buckets")
    before = F.sum("_size").over(Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_group", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_hash", *order))
    numbered = spread.withColumn("_row", within).join(starts, ["_group", "_bucket"])
    return numbered.withColumn("_number", F.col("_start") + F.col("_row") - 1).drop("_hash", "_bucket", "_start", "_row")
