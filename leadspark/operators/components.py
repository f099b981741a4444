"""Connected components, and star edges of equal keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> None:
    """Use the shared folder that the cluster names; only a local session without one, as in tests, gets one of its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder; a cluster needs a shared one")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


class Steps:
    """Results of a loop's steps, each written to files and read again; a step's files go when the next ones are there.

    A checkpoint keeps the optimiser's estimate of its size, and a join multiplies those of both sides.  When each
    step joins what the last one made with itself, the digits of that number double with every step, until they fill the driver.  A
    table read from files has their size instead.
    """

    def __init__(self, spark):
        ensure_checkpoint_dir(spark)
        self.spark, self.n, self.last = spark, 0, None
        self.path = f"{spark.sparkContext.getCheckpointDir()}/steps-{uuid.uuid4().hex}"

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def store(self, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.n}"
        rows.write.parquet(path)
        if self.n:
            self._delete(f"{self.path}/{self.n - 1}")
        self.n, self.last = self.n + 1, self.spark.read.schema(rows.schema).parquet(path)
        return self.last

    def end(self) -> DataFrame:
        """A checkpoint of the last step, without files of steps."""
        out = self.last.checkpoint()
        self._delete(self.path)
        return out


def star_edges(keyed: DataFrame, node: str = "idx") -> DataFrame:
    """(a, b) from each node of keyed(node, key) to the least node of its key; keys of one node give none.

    A key of n nodes gives n - 1 edges, not n squared.  The least node comes from a partial
    aggregation, and the join's large keys can be split by adaptive execution.
    """
    least = keyed.groupBy("key").agg(F.min(node).alias("b"))
    return keyed.join(least, "key").where(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b").distinct()


#: Up to so many edges, the driver finds the components in less time than one round takes.
SMALL = 50_000


def _small_components(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    label: dict[int, int] = {}

    def find(x: int) -> int:
        while label.setdefault(x, x) != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    return [(n, find(n)) for n in label]


#: Large stars before each small star: a large star halves a path of ascending nodes, a small star does not.
LARGE = 3


def _apart(node: str) -> Column:
    """The node's number as a new expression: a join by it deals the rows anew, so that a hub's edges can be split."""
    return F.col(node).bitwiseXOR(F.lit(0))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node among its neighbours and itself."""
    ends = e.select(F.col("b").alias("n"), F.col("a").alias("w")).unionByName(e.select(F.col("a").alias("n"), F.col("b").alias("w")))
    low = ends.groupBy("n").agg(F.min("w").alias("w")).select(_apart("n").alias("b"), F.least("n", "w").alias("m"))
    return e.join(low, "b").select("a", F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    inner = e.join(low.select(_apart("a").alias("a"), "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """(edges, rounds): edges(a, b) with b < a turned into one star around the least node of each component.

    Rounds of LARGE large stars and a small star (Kiveris et al., Connected Components in MapReduce and Beyond).  Neither makes more
    edges than there were, both shorten paths, and the table shrinks to one edge a node; it is done when no node is
    tied twice and no centre is tied itself.  Each step's edges are stored.
    """
    e, rounds, steps = edges, 0, Steps(edges.sparkSession)
    while True:
        tied = e.select(F.col("a").alias("n"), F.lit(1).alias("tied"), F.lit(0).alias("centre"))
        ends = tied.unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
        if not ends.groupBy("n").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied + centre > 1").limit(1).count():
            return steps.end() if rounds else e, rounds
        for _ in range(LARGE):
            e = steps.store(_large_star(e))
        e = steps.store(_small_star(e))
        rounds += 1


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, label) for every node of edges(a long, b long); label is the least node that it is connected with.

    A table of at most `small` edges is solved at the driver; larger ones are never collected but turned
    into stars().  Edges with a null end are ignored, and so are those from a node to itself.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = e.distinct().checkpoint()
    some = e.limit(small + 1).collect() if small else []
    if small and len(some) <= small:
        return edges.sparkSession.createDataFrame(_small_components([(r.a, r.b) for r in some]), "node long, label long")
    found, _ = stars(e)
    return found.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
