"""Balanced shards by label propagation under capacity quotas.

Documents are linked through hubs: a document and the hub it names (here the text it shares with others, as well a cluster's or component's id) are joined
by one edge, so a group of any size has as many edges as members and pairs are never made. A hub's label is the shard that holds most of
its bytes; in each round linked documents move towards their hub's label, all in joins and sums over (hub, shard). What may move is decided for each pair of shards: the
bytes that want to go are cut back until no shard's load exceeds its capacity, and that share of the documents goes, by a hash of
their numbers. Documents without links count for nothing here, for they fill what the linked ones leave.

Groups too large for that (over 1 / ``FINE`` of a shard, so at most ``FINE`` times the number of shards) are seated first: whole where one shard
has room, else over as few shards as hold them. After the rounds the sizes are made even: what a shard holds beyond its share, and
all documents without links, are laid one after the other over the shards' open room, large texts first and the smallest last, so that each pass mends what
the one before left uneven; in the end shards differ by about one small text. Running sums come from counts of at most 4,096 buckets a shard and sums within a bucket, so no task sees a whole shard.

Defined results: a null text counts as empty, of size 1; equal texts share a hub, empty ones too; repeated rows and rows without an id are rows of their own;
a text larger than a shard's share stands in one shard, which then is larger than the others; an empty table gives no rows; fewer documents than shards leave
shards empty. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import discard, read, stored, with_order

SHARDS, ROUNDS, FINE, BUCKETS = 16, 8, 64, 4096


def share(*seed) -> Column:
    """A number from 0 up to 1 that a hash of the given columns fixes."""
    return F.pmod(F.xxhash64(*seed), F.lit(1 << 30)) / float(1 << 30)


def running(rows: DataFrame, parts: list[str], bucket: Column, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``begin``: the sum of ``value`` over the rows of their part before them, by bucket and then by ``order``.

    The buckets' sums are one small table, whatever the number of rows; ``parts`` hold few values.
    """
    rows = rows.withColumns({"_bucket": bucket, "_value": value})
    sums = rows.groupBy(*parts, "_bucket").agg(F.sum("_value").alias("_sum"))
    whole = Window.partitionBy(*parts).orderBy("_bucket")
    base = sums.select(*parts, "_bucket", (F.sum("_sum").over(whole) - F.col("_sum")).alias("_base"))
    own = F.sum("_value").over(Window.partitionBy(*parts, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(base), [*parts, "_bucket"]).withColumn("begin", F.col("_base") + F.col("_own")).drop("_bucket", "_value", "_base", "_own")


def seats(groups: list[tuple[int, int]], shards: int, capacity: float) -> tuple[dict[int, list[tuple[int, float]]], np.ndarray]:
    """For each large group (hub, bytes) the shards that it takes, each with the byte of the group that ends its part, and the room left."""
    room, out = np.full(shards, capacity, dtype=float), {}
    for hub, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        fits = np.nonzero(room >= size)[0]
        taken, left = [], float(size)
        while left > 0:
            at = int(fits[np.argmin(room[fits])]) if len(fits) and not taken else int(np.argmax(room))
            part = min(left, room[at]) if room[at] > 0 else left
            room[at] -= part
            left -= part
            taken.append((at, float(size - left)))
        out[hub] = taken
    return out, np.maximum(room, 0)


def quotas(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The share of each flow ``wanted[from, to]`` that may go, so that no shard takes in more than its room and what leaves it."""
    flow = wanted.astype(float)
    np.fill_diagonal(flow, 0)
    for _ in range(200):
        over = flow.sum(axis=0) - flow.sum(axis=1) - np.maximum(room, 0)
        if not (over > 1e-6 * (1 + flow.sum())).any():
            break
        flow *= np.where(over > 0, 1 - np.minimum(1, over / np.maximum(flow.sum(axis=0), 1e-9)), 1)[None, :]
    return np.divide(flow, wanted, out=np.zeros_like(flow), where=wanted > 0)


def propagate(linked: DataFrame, loads: np.ndarray, shards: int, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """``linked(rid, size, hub, shard)`` after the moves; ``loads`` are bytes that stay where they are."""
    state, before = linked, None
    for turn in range(rounds):
        tally = state.groupBy("hub", "shard").agg(F.sum("size").alias("bytes"))
        label = tally.groupBy("hub").agg(F.max_by("shard", F.struct("bytes", F.xxhash64("hub", "shard"))).alias("label"))
        asked = stored(state.join(label, "hub"), "labels")
        if before is not None:
            discard(before)
        before = asked
        wanted = np.zeros((shards, shards))
        # At most shards x shards sums.
        for row in asked.groupBy("shard", "label").agg(F.sum("size").alias("bytes")).collect():
            wanted[row["shard"], row["label"]] = row["bytes"]
        goes = quotas(wanted, capacity - loads - wanted.sum(axis=1))
        quota = F.array(*[F.lit(float(x)) for x in goes.ravel()])[F.col("shard") * shards + F.col("label")]
        state = asked.withColumn("shard", F.when(share("rid", F.lit(turn)) < quota, F.col("label")).otherwise(F.col("shard"))).drop("label")
        away = wanted.sum() - np.trace(wanted)
        if away <= 0 or (goes * wanted).sum() - np.trace(goes * wanted) < 0.001 * away:
            break
    return state


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows(rid, size, hub)`` with ``shard`` and ``slot``; ``rid`` is unique, ``size`` above 0, a null ``hub`` means no link. Other columns stay."""
    groups = stored(rows.filter("hub is not null").groupBy("hub").agg(F.count("*").alias("members"), F.sum("size").alias("bytes")).filter("members > 1"), "hubs")
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = total / shards
    # Each holds over 1 / (FINE * shards) of all bytes, so there are fewer than FINE * shards of them.
    large = [tuple(r) for r in groups.filter(F.col("bytes") > capacity / FINE).select("hub", "bytes").collect()]
    placed, left = seats(large, shards, capacity)
    spark = rows.sparkSession
    seat = spark.createDataFrame([(h, [s for s, _ in p], [e for _, e in p]) for h, p in placed.items()], "hub long, seats array<int>, ends array<double>")
    open_ = (np.cumsum(left) / left.sum() if left.sum() > 0 else np.arange(1, shards + 1) / shards).tolist()
    random = F.least(F.lit(shards - 1), sum([(share("rid") >= e).cast("int") for e in open_], F.lit(0)))
    dealt = rows.join(F.broadcast(seat), "hub", "left")
    # Members of large groups (buckets: 256 for each of at most 1,024) stay out of the join by hub.
    along = running(dealt.filter("seats is not null"), ["hub"], F.pmod(F.xxhash64("rid"), F.lit(BUCKETS // 16)), ["rid"], F.col("size"))
    middle = F.col("begin") + F.col("size") / 2
    seated = F.element_at("seats", F.least(F.size("ends"), F.size(F.filter("ends", lambda e: e <= middle)) + 1))
    seated = along.withColumns({"kind": F.lit("seated"), "shard": seated}).drop("seats", "ends", "begin")
    small = dealt.filter("seats is null").drop("seats", "ends").join(groups.select("hub", F.lit(True).alias("joined")), "hub", "left")
    small = small.withColumns({"kind": F.when(F.col("joined"), "linked").otherwise("free"), "shard": random}).drop("joined")
    start = stored(seated.unionByName(small), "start")
    loads = np.zeros(shards)
    for row in start.filter("kind = 'seated'").groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        loads[row["shard"]] = row["bytes"]
    moved = propagate(start.filter("kind = 'linked'").select("rid", "size", "hub", "shard"), loads, shards, capacity, rounds).select("rid", "shard")
    linked = start.filter("kind = 'linked'").drop("shard").join(moved, "rid")
    return numbered(settled(start.filter("kind = 'seated'").unionByName(linked), start.filter("kind = 'free'"), shards, total))


def settled(held: DataFrame, free: DataFrame, shards: int, total: int) -> DataFrame:
    """All rows with shards of even sizes: what a shard holds beyond its share leaves it, whole groups first to last, and is laid into open room like the free rows."""
    half = BUCKETS // 2
    # Members of a small group stand together; large groups are spread over the buckets above.
    bucket = F.when(F.col("kind") == "linked", F.pmod(F.xxhash64("hub"), F.lit(half))).otherwise(half + F.pmod(F.xxhash64("rid"), F.lit(half)))
    ends = [total * (i + 1) // shards for i in range(shards)]
    shares = [e - b for b, e in zip([0, *ends], ends)]
    most = F.array(*[F.lit(x).cast("long") for x in shares])[F.col("shard")]
    run = running(held, ["shard"], bucket, ["hub", "rid"], F.col("size"))
    judged = stored(run.withColumn("stays", F.col("begin") + F.col("size") / 2 <= most).drop("begin"), "held")
    loads = np.zeros(shards)
    for row in judged.filter("stays").groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        loads[row["shard"]] = row["bytes"]
    out = judged.filter("stays").drop("stays")
    loose = stored(judged.filter("not stays").drop("stays").unionByName(free), "loose")
    cuts = loose.agg(F.percentile_approx("size", [0.5, 0.1])).first()[0] or [0, 0]
    left = total - loads.sum()
    passes = [F.col("size") > cuts[0], (F.col("size") > cuts[1]) & (F.col("size") <= cuts[0]), F.col("size") <= cuts[1]]
    amounts = loose.agg(*[F.sum(F.when(c, F.col("size")).otherwise(0)) for c in passes]).first()
    for which, amount in zip(passes, amounts):
        if not amount:
            continue
        some = loose.filter(which)
        edges = np.cumsum(open_room(loads, left)) * (amount / left)
        shard = F.least(F.lit(shards - 1), sum([(F.col("begin") + F.col("size") / 2 >= F.lit(float(e))).cast("int") for e in edges], F.lit(0)))
        laid = stored(running(some.drop("shard").withColumn("all", F.lit(0)), ["all"], bucket, ["hub", "rid"], F.col("size")).withColumn("shard", shard).drop("all", "begin"), "laid")
        for row in laid.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
            loads[row["shard"]] += row["bytes"]
        left -= amount
        out = out.unionByName(laid)
    return out


def open_room(loads: np.ndarray, amount: float) -> np.ndarray:
    """How much each shard takes of ``amount`` so that all those that take any end at one level."""
    up = np.sort(loads)
    levels = (np.cumsum(up) + amount) / np.arange(1, len(up) + 1)
    level = levels[np.nonzero(levels > up)[0][-1]] if amount > 0 else 0
    return np.maximum(0, level - loads)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``slot``, from 0 without a gap in each shard."""
    return running(rows, ["shard"], F.pmod(F.xxhash64("rid"), F.lit(BUCKETS)), ["rid"], F.lit(1).cast("long")).withColumnRenamed("begin", "slot").drop("kind")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot``; documents are linked by equal texts, and texts are read once."""
    rows = with_order(docs, id_col, text_col)
    data = F.col("text").cast("binary")
    rows = stored(rows.select("rid", "id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64("text").alias("hub")), "sizes")
    out = balanced_shards(rows, shards, rounds)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
