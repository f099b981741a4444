"""Merkle fixity audit of WARC records.

A record's leaf is the SHA-256 of its bytes.  Each replica is put in the order of the records'
keys and has offsets of its own bytes.  Ordered ranges of offsets make range nodes; nodes are
grouped in order into parents up to a root.  Two replicas are compared from their roots,
and only the children of mismatching nodes are read on.

Where one replica lacks a record, all its later offsets are others.  So ranges and parents
begin at anchors, records that a hash of their key picks, and inside a range offsets count from
its anchor: a lost or longer record changes the nodes around it and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textnum import ensure_checkpoint_dir

#: Bytes of an offset range at most, but for its last record.
RANGE_BYTES = 1 << 20
#: One key in so many is an anchor, and of these one in FANOUT of the next level, up to LEVELS levels below the root.
ANCHOR, FANOUT, LEVELS = 256, 64, 3


def record(url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record; a null URL or body is empty."""
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def leaves(records: DataFrame, key: str = "key", anchor: int = ANCHOR, fanout: int = FANOUT) -> DataFrame:
    """The leaves of one replica from records(key, length, digest): key as text, digest, length, offset, position and the names of the nodes above.

    Records are put in the order of key (its text), digest and length, and offsets are the running
    sums of this replica's own lengths.  Rows are sorted in ranges; sums of ranges are
    added up first, so no task sees more than its range.  Records of equal key and digest are
    spread by a salt; they are alike, so their mutual order does not matter.
    `above` has the anchors that the record's nodes begin with, of each level up from the
    ranges, each as (key, offset); the first record of all is an anchor of every level.
    A null key is an empty one, a null length 0, and a null digest is a value of its own; other columns are ignored.
    """
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    one = records.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), F.coalesce("digest", F.lit("")).alias("digest"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "digest", "length", "__salt"]
    rows = one.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(64))).repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    rows = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    inside = Window.partitionBy("__part").orderBy("__at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # only the first record of a key may be an anchor; whether the partition's first record is one, its predecessor in the former partition says
    rows = rows.withColumns({"__o": F.coalesce(F.sum("length").over(before), F.lit(0)), "__p": F.coalesce(F.count("*").over(before), F.lit(0)), "__last": F.lag("key").over(inside)})
    ends = rows.groupBy("__part").agg(F.sum("length").alias("bytes"), F.count("*").alias("n"), F.max_by("key", "__at").alias("key"))
    above = Window.orderBy("__part")  # one row for each partition
    base = ends.select("__part", (F.sum("bytes").over(above) - F.col("bytes")).alias("__b"), (F.sum("n").over(above) - F.col("n")).alias("__n"), F.lag("key").over(above).alias("__k"))
    rows = rows.join(F.broadcast(base), "__part")  # as many rows as partitions
    rows = rows.withColumn("offset", F.col("__b") + F.col("__o")).withColumn("position", F.col("__n") + F.col("__p"))
    new = ~F.col("key").eqNullSafe(F.when(F.col("__p") == 0, F.col("__k")).otherwise(F.col("__last")))
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 62))
    is_anchor = lambda level: (F.col("position") == 0) | new & (F.pmod(hashed, F.lit(anchor * fanout**level)) == 0)
    here = F.struct("key", "offset")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"__a{k}": F.last(F.when(is_anchor(k), here), ignorenulls=True).over(upto) for k in range(LEVELS)})
    # the last anchors of former partitions hold up to a partition's first one
    carried = local.groupBy("__part").agg(*[F.max_by(f"__a{k}", "__at").alias(f"__a{k}") for k in range(LEVELS)])
    former = above.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("__part", *[F.last(f"__a{k}", ignorenulls=True).over(former).alias(f"__c{k}") for k in range(LEVELS)])
    out = local.join(F.broadcast(carried), "__part")  # as many rows as partitions
    return out.select("key", "digest", "length", "offset", "position", F.array(*[F.coalesce(f"__a{k}", f"__c{k}") for k in range(LEVELS)]).alias("above"))


def _node(children: Column) -> Column:
    """SHA-256 over the ordered children's digests; `children` is an array of (order, digest)."""
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda c: c["digest"]), ""), 256)


def _name(level: int, range_bytes: int, fanout: int) -> Column:
    """The node of a level that a record, or a node that begins with it, belongs to."""
    anchor = F.col("above")[level]
    number = F.floor((F.col("offset") - anchor["offset"]) / F.lit(range_bytes * fanout**level))
    return F.concat_ws(":", F.lit(str(level)), number.cast("string"), anchor["key"])


def tree(of: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the tree over leaves(), ranges first and root last: (node, up, digest) each.

    A node is named by its level, its anchor's key, and how many times the level's bytes lie between
    them, which also bounds a stretch without anchors; `up` is the parent's name.  So
    a task's array is bounded by the level's bytes over the least size of a child.
    """
    ensure_checkpoint_dir(of.sparkSession)
    name = lambda k: _name(k, range_bytes, fanout) if k < LEVELS else F.lit("root" if k == LEVELS else None).cast("string")
    level, levels = of.withColumn("up", name(0)), []
    for k in range(LEVELS + 1):
        child = F.collect_list(F.struct(F.col("position").alias("order"), "digest"))
        level = level.groupBy(F.col("up").alias("node")).agg(_node(child).alias("digest"), F.min(F.struct("position", "offset", "above")).alias("first"))
        level = level.select("node", "first.*", "digest").withColumn("up", name(k + 1)).checkpoint()
        levels.append(level.select("node", "up", "digest"))
    return levels


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with `k`, their number by position among those of equal keys; numbers are counted inside a range and carried over ranges, so a key of many rows meets in no task."""
    local = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "up").orderBy("position")))
    each = rows.groupBy(*keys, "up").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("p")) - F.col("n")
    return local.join(each.select(*keys, "up", before.alias("before")), [*keys, "up"]).withColumn("k", F.col("k") + F.col("before")).drop("before")


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(key, offset, replica_offset, length, expected, found, status) of the records in which two replicas, as leaves(), differ.

    status is `corrupt` where a key's record has another digest, `missing` where the replica lacks it and
    `extra` where the primary does.  Equal roots end the audit with no row after one comparison;
    else each level's mismatching nodes select the children to compare next, and only
    records of mismatching ranges are read.  There, records of one key and digest are matched
    first, and of what is left the n-th records of a key, so one lost record is one row
    whatever follows it.  offset is the primary's and replica_offset the replica's own, null
    where the record is absent; length is the primary's, or else the replica's.
    An empty table has no records: all of the other one are missing or extra.
    """
    left, right = tree(primary, range_bytes, fanout), tree(replica, range_bytes, fanout)
    bad = None
    for x, y in zip(reversed(left), reversed(right), strict=True):
        x, y = (t if bad is None else t.join(bad, "up", "left_semi") for t in (x, y))
        x, y = x.select("node", F.col("digest").alias("x")), y.select("node", F.col("digest").alias("y"))
        bad = x.join(y, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("node").alias("up")).checkpoint()
        if bad.limit(1).count() == 0:
            break
    up = _name(0, range_bytes, fanout)
    a, b = (_numbered(t.withColumn("up", up).join(bad, "up", "left_semi").select("key", "digest", "length", "offset", "position", "up"), "key", "digest").checkpoint() for t in (primary, replica))
    same = ["key", "digest", "k"]
    a, b = (_numbered(t.join(other.select(*same), same, "left_anti").drop("k"), "key") for t, other in ((a, b), (b, a)))
    x = a.select("key", "k", "offset", F.col("length").alias("m"), F.col("digest").alias("expected"))
    y = b.select("key", "k", F.col("offset").alias("replica_offset"), F.col("length").alias("n"), F.col("digest").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return x.join(y, ["key", "k"], "full").select("key", "offset", "replica_offset", F.coalesce("m", "n").alias("length"), "expected", "found", status.alias("status"))
