"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked.  They start spread by hash.  Members of a
group that are in the same shard are alike, so the state is their number by group
and shard: a group has no more rows than there are shards, whatever its share of
the corpus.  In each round the linked documents of a group ask to move to the
shard that holds most of it, and moves are granted up to a quota: what asks to
come the other way, and the room in the target shard, dealt to the askers by hash
slices, so that no quota needs a sort of all askers.  At last each group takes the
label that most of its members have.  Unlinked documents are the ballast: they fill
the shards up.  Each shard is numbered without gaps, groups side by side, and what
exceeds its target fills the gaps of others in that order, so counts differ by at
most one whatever the groups look like, and about one group is cut for each shard
that gives or takes.

Law: ``rows``.  What a group has beyond a shard's size goes to the shards with
the largest gaps.

Defined results: null text has size 1 and the checksum of the empty text, and
equals the empty text; repeated ids and rows without an id are separate rows; with
fewer documents than shards the last shards stay empty; texts are hashed whole,
however long; an empty table gives an empty result; only the id and the text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import discard, materialize

SHARDS, ROUNDS, SLICES = 8, 10, 1024
#: Documents in a numbering bucket, about; pieces into which the members that ask together are cut in every second round.
BUCKET, PIECES = 1_000, 16
#: Buckets whose sums one window holds.
CHUNK = 10_000
#: Place of unlinked rows in a shard, behind all groups; those come by the logarithm of their size.
LOOSE = 64


def _slice(*cols) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *cols), F.lit(SLICES)).cast("int")


def _labels(held: DataFrame) -> DataFrame:
    """(grp, to, m): the shard that holds most of each group, and the group's size."""
    # Ties are broken by a hash that differs between groups, lest they all ask for shard 0.
    best = held.groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard").alias("x"), "shard")).alias("b"), F.sum("n").alias("m"))
    return best.select("grp", F.col("b.shard").alias("to"), "m")


def _granted(asks: DataFrame, room: DataFrame) -> DataFrame:
    """(shard, to, s): whole hash slices of askers while they fit their quota.

    The quota from one shard to another is what asks to come the other way (an
    exchange keeps both sizes) and a share of the room in the target.
    """
    counts = asks.groupBy("shard", "to", "s").agg(F.sum("n").alias("n"))
    # At most n_shards ** 2 rows, and n_shards ** 2 * SLICES in counts.
    pairs = counts.groupBy("shard", "to").agg(F.sum("n").alias("n"))
    back = pairs.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("n").alias("back"))
    alone = pairs.join(back, ["shard", "to"], "left").withColumn("swap", F.least("n", F.coalesce("back", F.lit(0)))).withColumn("more", F.col("n") - F.col("swap"))
    share = F.col("more") / F.greatest(F.sum("more").over(Window.partitionBy("to")), F.lit(1))
    quota = alone.join(room.select(F.col("shard").alias("to"), "room"), "to").withColumn("quota", F.col("swap") + F.floor(F.greatest("room", F.lit(0)) * share)).select("shard", "to", "quota")
    run = counts.withColumn("run", F.sum("n").over(Window.partitionBy("shard", "to").orderBy("s")))
    return run.join(F.broadcast(quota), ["shard", "to"]).where("run <= quota").select("shard", "to", "s")


def propagate(held: DataFrame, n_shards: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """Members of groups by shard (grp, shard, n) after propagation; sizes stay at their share of ``total``, but for what one slice may add."""
    cap = -(-total // n_shards)
    shards = held.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    now = materialize(held, "held")
    for k in range(rounds):
        asked = now.join(_labels(now).drop("m"), "grp")
        # Members ask together in one round and in pieces in the next, so that large groups move too.
        pieces = F.least("n", F.lit(PIECES if k % 2 else 1)).cast("int")
        cut = asked.where("shard <> to").withColumn("_of", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        cut = cut.select("grp", "shard", "to", (F.expr("n div _of") + (F.col("_i") < F.col("n") % F.col("_of")).cast("int")).alias("n"), _slice("grp", F.lit(k), "_i").alias("s"))
        asks = materialize(cut, "asks")
        if not asks.take(1):
            discard(asks)
            break
        room = shards.join(now.groupBy("shard").agg(F.sum("n").alias("n")), "shard", "left").select("shard", (F.lit(cap) - F.coalesce("n", F.lit(0))).alias("room"))
        moved = asks.join(F.broadcast(_granted(asks, room)), ["shard", "to", "s"])
        change = moved.select("grp", "shard", (-F.col("n")).alias("n")).unionAll(moved.select("grp", F.col("to").alias("shard"), "n"))
        then = materialize(now.unionByName(change).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "held")
        discard(now, asks)
        now = then
    return now


def numbered(df: DataFrame, by: str, first: Column, key: str, out: str, together: Column | None = None) -> DataFrame:
    """``df`` plus a gapless number from 0 within each ``by``, rows with the smallest ``first`` (a small integer) first.

    Buckets are numbered on their own and shifted by the sums of those before.
    Rows with the same ``together`` share a bucket and stand side by side in it.
    """
    n = df.count()
    buckets = max(1, -(-n // BUCKET))
    bucket = F.pmod(F.xxhash64(F.lit(5), key if together is None else together), F.lit(buckets))
    cut = df.withColumn("_b", first.cast("long") * buckets + bucket)
    # One row per bucket and shard, a few for each BUCKET documents; summed in chunks, and these in turn.
    sums = cut.groupBy(by, "_b").agg(F.count("*").alias("_n")).withColumn("_c", F.call_function("div", F.col("_b"), F.lit(CHUNK)))
    before = lambda *part: Window.partitionBy(by, *part[:-1]).orderBy(part[-1]).rowsBetween(Window.unboundedPreceding, -1)
    chunks = sums.groupBy(by, "_c").agg(F.sum("_n").alias("_m"))
    chunks = chunks.select(by, "_c", F.coalesce(F.sum("_m").over(before("_c")), F.lit(0)).alias("_upto"))
    near = sums.withColumn("_near", F.coalesce(F.sum("_n").over(before("_c", "_b")), F.lit(0)))
    shift = near.join(chunks, [by, "_c"]).select(by, "_b", (F.col("_upto") + F.col("_near")).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(by, "_b").orderBy(*([] if together is None else [together]), key)) - 1
    return cut.withColumn("_i", inside).join(shift, [by, "_b"]).withColumn(out, (F.col("_i") + F.col("_shift")).cast("long")).drop("_b", "_i", "_shift")


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard; counts differ by at most one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    grp = F.struct(F.xxhash64(text).alias("h"), F.hash(text).alias("g"), F.octet_length(text).alias("l"))
    base = materialize(df.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("crc"), F.xxhash64(grp).alias("grp"), F.monotonically_increasing_id().alias("rid")), "docs")
    total = base.count()
    # Summed before any shuffle: at most n_shards rows for each group.
    held = materialize(base.groupBy("grp", F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(n_shards)).cast("int").alias("shard")).agg(F.count("*").alias("n")), "start")
    many = held.groupBy("grp").agg(F.sum("n").alias("m")).where("m > 1").select("grp")
    moved = propagate(held.join(many, "grp", "left_semi"), n_shards, total, rounds)
    labels = materialize(_labels(moved), "labels")
    # Spark splits a group with much of the corpus: nothing but the write follows this join.
    placed = materialize(base.select("rid", "grp").join(labels, "grp", "left"), "placed")
    # Groups stand together, so that a full shard gives up whole ones; those over a bucket are cut into several.
    salt = F.when(F.col("m") > BUCKET, F.pmod(F.xxhash64("rid"), F.ceil(F.col("m") / BUCKET))).otherwise(0)
    # The largest groups come first, so that they keep their place and find the largest gaps.
    rank = (LOOSE - F.ceil(F.log2("m"))).cast("int")
    linked = placed.where("m is not null").select("rid", F.col("to").alias("shard"), F.xxhash64("grp", salt).alias("with"), rank.alias("rank"))
    loose = placed.where("m is null").select("rid")

    # Ballast fills each shard's room: numbered once, then cut by running room.
    low, extra = divmod(total, n_shards)
    spark = df.sparkSession
    goal = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), (F.lit(low) + (F.col("id") < extra).cast("long")).alias("goal"))
    got = labels.groupBy(F.col("to").alias("shard")).agg(F.sum("m").alias("count"))
    room = goal.join(got, "shard", "left").withColumn("room", F.greatest(F.col("goal") - F.coalesce("count", F.lit(0)), F.lit(0)))
    over = Window.orderBy("shard")
    # One row per shard.
    room = room.withColumn("upto", F.sum("room").over(over)).withColumn("since", F.col("upto") - F.col("room"))
    seats = numbered(loose.withColumn("all", F.lit(0)), "all", F.lit(0), "rid", "seat").drop("all")
    seated = seats.join(F.broadcast(room.select("shard", "since", "upto")), (F.col("seat") >= F.col("since")) & (F.col("seat") < F.col("upto"))).select("rid", "shard")
    every = linked.unionByName(seated.withColumns({"rank": F.lit(LOOSE), "with": F.col("rid")}))

    # What exceeds a shard's goal fills the gaps of others, so that slots stay gapless.
    slots = materialize(numbered(every, "shard", F.col("rank"), "rid", "slot", F.col("with")).join(F.broadcast(goal), "shard"), "slots")
    fits = slots.where("slot < goal").select("rid", "shard", "slot")
    spill = numbered(slots.where("slot >= goal").withColumn("all", F.lit(0)), "all", F.col("rank"), "rid", "seat", F.col("with"))
    have = slots.where("slot < goal").groupBy("shard").count()
    gaps = goal.join(have, "shard", "left").withColumn("have", F.coalesce("count", F.lit(0))).withColumn("gap", F.col("goal") - F.col("have"))
    gaps = gaps.withColumn("upto", F.sum("gap").over(Window.orderBy(F.desc("gap"), "shard"))).withColumn("since", F.col("upto") - F.col("gap")).select(F.col("shard").alias("to"), "have", "since", "upto")
    filled = spill.join(F.broadcast(gaps), (F.col("seat") >= F.col("since")) & (F.col("seat") < F.col("upto"))).select("rid", F.col("to").alias("shard"), (F.col("have") + F.col("seat") - F.col("since")).alias("slot"))
    where = fits.unionByName(filled)
    out = base.join(where, "rid")
    discard(held, moved, labels, placed)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(df: DataFrame) -> DataFrame:
    """Links lost, counted against a star per group: members outside the group's largest shard."""
    per = df.groupBy("grp", "shard").count().groupBy("grp").agg(F.sum("count").alias("all"), F.max("count").alias("most"))
    return per.agg(F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut"))
