"""Sharding by balanced label propagation under the law ``rows``: counts at most one apart.

Documents are linked through hubs (equal texts, unless another key is named), and start from a hashed
shard. Heavy hubs, those with more than 1 / ``CELLS`` of all rows, go first, the largest first, each whole to
its most frequent shard that has room (or to the fullest with room, if fewer are cut that way). Only a hub that no
shard has room for is cut, and its parts fill one shard after another, so it lies in as few as it can.

The light ones then propagate: every round counts labels by hub (partial aggregation; a hub's members are
never gathered), lets each hub wish for its most frequent shard, after the first round for one that has
room, and grants wishes by cells of shard and hash. Documents that leave make room for others, in the
same round. Rounds end when nothing moves. Hubs that are whole stay up to their shard's count; the others,
each in one piece, and then documents without links fill every shard to its exact count. That cuts
a hub only where a shard ends: two a shard at most.

The driver sees histograms of fixed size (``CELLS`` cells by shard) and the votes of the heavy hubs, fewer
than ``CELLS``. Places come from counts by hashed bucket and a rank within each, so no task sees more than
a bucket. State is narrow tables in the shared folder; texts are read once and never shuffled.

Defined results: a null text has size 1 and links with empty ones; a null doc_id is ordered first;
repeated rows are documents of their own; an empty table gives no rows; with fewer rows than shards the
first shards hold one each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import scratch

CELLS = 4096


def _buckets(rows: int) -> int:
    return min(4096, max(64, rows // 2_000))


def _ranked(df: DataFrame, keys: list[str], buckets: int, together: Column | None = None, salt: int = 0) -> DataFrame:
    """Append ``rank``: gapless from 0 within ``keys``, by bucket, doc_id and hub; first the light hubs ``together``, each in one piece.

    Ranks follow buckets, so shards that were cut by a rank need another ``salt``: with the same one a shard would hold few buckets, whole.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "hub"), F.lit(buckets))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hub")]
    if together is not None:
        bucket = F.when(together, F.pmod(F.xxhash64("hub"), F.lit(buckets))).otherwise(bucket + buckets)
        order = [F.when(together, F.col("hub")), *order]
    df = df.withColumn("bucket", bucket.cast("int"))
    # At most (shards + 1) * 4096 rows of counts, or twice that: a proven bound.
    counts = sorted(tuple(r) for r in df.groupBy(*keys, "bucket").count().collect())
    before, rows = {}, []
    for *key, bucket, n in counts:
        at = before.get(tuple(key), 0)
        rows.append((*key, bucket, at))
        before[tuple(key)] = at + n
    types = dict(df.dtypes)
    offsets = spark.createDataFrame(rows, ", ".join(f"{k} {types[k]}" for k in keys) + (", " if keys else "") + "bucket int, before long")
    w = W.partitionBy(*keys, "bucket").orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w) - 1).join(F.broadcast(offsets), [*keys, "bucket"]).withColumn("rank", F.col("before") + F.col("rn")).drop("rn", "before", "bucket")


def _places(votes: dict[str, Counter], target: list[int], frequent: bool) -> tuple[int, list[tuple[str, int, int, int]], list[int]]:
    """Hubs cut, (hub, shard, its members from, to) and the room left, the largest hub first."""
    room, places, cut = list(target), [], 0
    for hub, held in sorted(votes.items(), key=lambda v: (-v[1].total(), v[0])):
        at, n = 0, held.total()
        while at < n:
            fits = [j for j, r in enumerate(room) if r >= n - at]
            if not fits:
                j = max(range(len(room)), key=lambda j: room[j])
            elif frequent and not at:
                j = max(fits, key=lambda j: held[j])
            else:
                j = min(fits, key=lambda j: room[j])
            took = min(room[j], n - at)
            places.append((hub, j, at, at + took))
            room[j] -= took
            at += took
        cut += places[-1][2] > 0
    return cut, places, room


def _grants(asked: dict[tuple[int, int], dict[int, int]], room: list[int]) -> list[tuple[int, int]]:
    """The cells (to, level) that may move; ``asked`` has their members by shard. A shard may be over by one cell's members."""
    slack = max((sum(cell.values()) for cell in asked.values()), default=0)
    room, granted, waiting = list(room), [], sorted(asked)
    while True:
        left = []
        for to, level in waiting:
            cell = asked[to, level]
            n = sum(cell.values())
            if n <= room[to] + slack:
                room[to] -= n
                for j, gone in cell.items():
                    room[j] += gone
                granted.append((to, level))
            else:
                left.append((to, level))
        if len(left) == len(waiting):
            return granted
        waiting = left


def _propagated(light: DataFrame, path: str, room: list[int]) -> tuple[DataFrame, str]:
    """Rounds of label propagation until nothing moves. Every grant makes hubs whole, which then stay, so rounds end."""
    spark, shards = light.sparkSession, len(room)
    levels, first = max(1, CELLS // shards), True
    while True:
        votes = light.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        load = {r["shard"]: r["n"] for r in votes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        free = [n - load.get(j, 0) for j, n in enumerate(room)]
        # The most frequent shard with room; a tie goes by hash. Members elsewhere are movers.
        open_ = F.col("shard").isin([j for j in range(shards) if first or free[j] > 0] or [-1])
        best = F.max(F.when(open_, F.struct("n", F.xxhash64("hub", "shard").alias("h"), "shard"))).alias("best")
        held = F.collect_list(F.struct("shard", "n")).alias("held")  # at most one a shard
        wish = votes.groupBy("hub").agg(best, held).where("best IS NOT NULL AND size(held) > 1").select(
            "hub", F.col("best.shard").alias("to"), "held", F.pmod(F.xxhash64(F.lit(2), "hub"), F.lit(levels)).cast("int").alias("level"))
        wish, wish_path = scratch.table(wish, "shard-wishes", narrow=True)
        asked: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
        moves = wish.select("to", "level", F.explode("held").alias("h")).where("h.shard <> to").groupBy("to", "level", F.col("h.shard").alias("shard"))
        for r in moves.agg(F.sum("h.n").alias("n")).collect():  # at most CELLS * shards rows
            asked[r["to"], r["level"]][r["shard"]] = r["n"]
        granted = _grants(asked, free)
        if not granted:
            scratch.drop(spark, wish_path)
            return light, path
        cells = F.broadcast(spark.createDataFrame(granted, "to int, level int"))
        moved = light.join(wish.join(cells, ["to", "level"]).select("hub", "to"), "hub", "left").withColumn("shard", F.coalesce("to", "shard"))
        light, new = scratch.table(moved.select(*light.columns), "shard-light", narrow=True)
        scratch.drop(spark, path, wish_path)
        path, first = new, False


def shard_documents(docs: DataFrame, shards: int = 8, hub: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), (F.md5(text.cast("binary")) if hub is None else F.md5(hub.cast("string").cast("binary"))).alias("hub"))
    base, base_path = scratch.table(base, "shard-rows")
    rows = base.count()
    target = [rows // shards + (j < rows % shards) for j in range(shards)]
    buckets = _buckets(rows)
    heavy = max(1, rows // CELLS)
    hubs = base.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    state = base.join(hubs, "hub", "left").select(
        "doc_id", "size", "crc", "hub", F.when(F.col("n") > heavy, "heavy").when(F.col("n") > 1, "light").otherwise("alone").alias("kind"),
        F.pmod(F.xxhash64(F.lit(1), "doc_id", "hub"), F.lit(shards)).cast("int").alias("shard"))
    state, state_path = scratch.table(state, "shard-state", narrow=True)
    scratch.drop(spark, base_path)
    columns = ["doc_id", "size", "crc", "hub", "shard"]

    votes: dict[str, Counter] = defaultdict(Counter)
    large = state.where("kind = 'heavy'").select(*columns)
    for r in large.groupBy("hub", "shard").agg(F.count("*").alias("n")).collect():  # fewer than CELLS hubs
        votes[r["hub"]][r["shard"]] = r["n"]
    _, places, room = min((_places(votes, target, f) for f in (True, False)), key=lambda p: p[0])
    parts = Counter(p[0] for p in places)
    to = F.broadcast(spark.createDataFrame([p for p in places if parts[p[0]] == 1], "hub string, to int, lo long, hi long"))
    done = large.join(to, "hub").withColumn("shard", F.col("to")).select(*columns)
    if pieces := [p for p in places if parts[p[0]] > 1]:  # each fills a shard: so many hubs at most
        to = F.broadcast(spark.createDataFrame(pieces, "hub string, to int, lo long, hi long"))
        cut = _ranked(large.join(to.select("hub").distinct(), "hub", "left_semi"), ["hub"], buckets)
        cut = cut.join(to.withColumnRenamed("hub", "of"), (F.col("hub") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        done = done.unionByName(cut.withColumn("shard", F.col("to")).select(*columns))

    # The light ones start in proportion to the room that is left.
    ends = [sum(room[: j + 1]) for j in range(shards)]
    spot = F.pmod(F.xxhash64(F.lit(1), "doc_id", "hub"), F.lit(max(1, ends[-1])))
    start = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= spot)).cast("int")
    light, path = scratch.table(state.where("kind = 'light'").withColumn("shard", start).select(*columns), "shard-light", narrow=True)
    light, path = _propagated(light, path, room)
    # Whole hubs keep their shard up to its count; the others fill what is left.
    span = W.partitionBy("hub")
    light = light.withColumn("whole", F.min("shard").over(span) == F.max("shard").over(span))
    ranked = _ranked(light.where("whole"), ["shard"], buckets, F.lit(True))
    limits = F.element_at(F.array(*[F.lit(n).cast("long") for n in room]), F.col("shard") + 1)
    placed, placed_path = scratch.table(
        ranked.select(*columns, F.lit(True).alias("linked"), (F.col("rank") < limits).alias("stays"))
        .unionByName(light.where("NOT whole").select(*columns, F.lit(True).alias("linked"), F.lit(False).alias("stays")))
        .unionByName(state.where("kind = 'alone'").select(*columns, F.lit(False).alias("linked"), F.lit(False).alias("stays"))), "shard-placed", narrow=True)
    scratch.drop(spark, path)
    held = {r["shard"]: r["n"] for r in placed.where("stays").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    edges, total = [], 0
    for j in range(shards):
        total += room[j] - held.get(j, 0)
        edges.append(total)
    fill = _ranked(placed.where("NOT stays"), [], buckets, F.col("linked"))
    to = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e <= F.col("rank")))
    done = done.unionByName(placed.where("stays").select(*columns)).unionByName(fill.withColumn("shard", to.cast("int")).select(*columns))
    done, _ = scratch.table(done, "shard-done", narrow=True)
    scratch.drop(spark, state_path, placed_path)
    return _ranked(done, ["shard"], buckets, salt=1).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
