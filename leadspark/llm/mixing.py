"""Mixing sources to target weights by Pareto order sampling.

A source that is to give more than its size gives whole copies of all documents first; what is left of its target
is a sample without repeats.  Documents are ranked by the odds of a random number divided by their inclusion odds, and the first
ones are taken until their words reach what is left, so the sample's size is fixed and the likelier documents come first.

Ranks are integers of 53 bits at most, and no source is ever sorted: where a source's words reach what is left of its target
is found digit by digit, from sums over the documents of equal leading digits, and each digit looks at the
documents of one leading part alone.  A document then compares its own rank with that of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textnum import ensure_checkpoint_dir

#: Weights of the sources in their order, repeating, and the times its size that a source or document is taken at most.
WEIGHTS, MOST = (1, 2, 3), 3
#: Inclusion odds grow with a document's words, to twice as much at so many.
LONG = 1000
#: Samples of a source: the first one stops before a document that is too long; those after it fill the gap with such as fit, and the last may end nearest.
ROUNDS = 3
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
#: Bits of a rank after its leading parts; a part has at most 2048 values in a source, so that a large source has no more sums than a small one.
SHIFTS = (42, 31, 20, 10, 0)
_WORD = r"[^\x20\x09-\x0D]+"


def word_odds(size: Column) -> Column:
    """Inclusion odds, but for a factor that all documents of a source share: a long document is up to twice as likely as a short one."""
    return 1 + F.least(size, F.lit(LONG)) / F.lit(float(LONG))


def pareto_rank(doc_id: Column, text: Column, odds: Column) -> Column:
    """The odds of a random number that id and text decide, divided by the inclusion odds, as an integer in the same order."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    q = u / (1 - u) / odds
    return F.floor(q / (1 + q) * F.lit(float(1 << 52))).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with `n`, their places by `source` from 0, null last: partitions of the order are numbered apart and moved by what lies before them."""
    rows = sources.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()).checkpoint()
    before = rows.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return rows.withColumn("own", own).join(before, "part").withColumn("n", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(source, source_size, weight, ...) with `target`: its weight's share of all sizes, at most `most` times its own size.

    What a source cannot give is shared by weight among the others until none is above; each round is one sum over
    the sources, in whole numbers, so that the result does not depend on an order.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    given, weights, above = 0, None, F.lit(False)
    while True:
        r = sources.agg(F.sum(F.when(above, F.lit(most) * F.col("source_size")).otherwise(0)).alias("given"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights")).first()
        if weights is not None and (r["given"] or 0, r["weights"] or 0) == (given, weights):
            break
        given, weights = r["given"] or 0, r["weights"] or 0
        above = whole("weight") * F.lit(total - given).cast("decimal(38,0)") > F.lit(most) * whole("source_size") * F.lit(weights).cast("decimal(38,0)")
    share = F.col("weight").cast("double") * (F.lit(float(total - given)) / F.lit(float(max(1, weights))))
    return sources.withColumn("target", F.when(above, F.lit(most) * F.col("source_size")).otherwise(share).cast("double"))


def _bounds(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(sid, bound, below, own) for rows(sid, size, rank) and rest(sid, rest): the first rank with which a source's words exceed the rest, the words before it and its own.

    Sources whose words never exceed it are not in the result.
    """
    inside, bound = rows.join(rest.withColumn("below", F.lit(0).cast("long")), "sid"), None
    for shift in SHIFTS:
        lead = F.shiftright("rank", shift)
        sums = inside.groupBy("sid", lead.alias("bound")).agg(F.sum("size").alias("own"), F.max("below").alias("below"), F.max("rest").alias("rest"))
        total = F.col("below") + F.sum("own").over(Window.partitionBy("sid").orderBy("bound"))
        bound = sums.withColumn("total", total).where("total > rest and total - own <= rest").select("sid", "bound", (F.col("total") - F.col("own")).alias("below"), "own", "rest")
        if shift:
            bound = bound.checkpoint()
            inside = inside.drop("below", "rest").join(bound.drop("own"), "sid").where(lead == F.col("bound")).drop("bound").checkpoint()
    return bound.drop("rest")


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", odds: Column | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text, source) with the words that the mix takes of it.

    Columns doc_id, size (words of the text; null text: 0), source, source_size, target (words of the source in the mix), copies (times that
    the mix holds the document), taken (copies times size).  The mix is as large as all sizes together.
    weights(source, weight long) are positive whole numbers, a source without a row weighs 0; by default sources weigh 1, 2, 3, repeating,
    in code-point order with the null source last.  `odds` are positive inclusion odds of a document in its source, up to a factor,
    from columns of docs or `size`; by default word_odds().

    Random numbers depend on id and text, so reruns agree; rows of equal id and text are taken together.  Null
    and repeated ids are rows like others; other columns are ignored; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    docs = docs.withColumn("size", size)
    sid = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).alias("source"), sid.alias("sid"), "size", pareto_rank(F.col("doc_id"), F.col("text"), word_odds(F.col("size")) if odds is None else odds).alias("rank")).checkpoint()
    sources = rows.groupBy("sid").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    if weights is None:
        sources = _numbered(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("n", F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")).drop("n")
    else:
        own = weights.groupBy(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("sid")).agg(F.max("weight").alias("weight"))
        sources = sources.join(own, "sid", "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    sources = sources.checkpoint()
    hint = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda x: x
    state = targets(sources)
    state = state.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select("sid", "source_size", "target", "whole", "rest").checkpoint()
    chosen, limits = F.lit(False), []
    for k in range(ROUNDS):
        fits = F.lit(True) if not k else F.col("size") <= F.col("rest") * (2 if k == ROUNDS - 1 else 1)
        free = rows.join(hint(state), "sid").where((F.col("rest") > 0) & ~chosen & fits & (F.col("size") > 0))
        free = free.select("sid", "size", "rank")
        total = free.groupBy("sid").agg(F.sum("size").alias("all"))
        found = _bounds(free, hint(state.select("sid", "rest")))
        state = state.join(found, "sid", "left").join(total, "sid", "left")
        taken = F.coalesce("below", "all", F.lit(0))
        upto = F.coalesce("bound", F.lit((1 << 53) + 1))
        if k == ROUNDS - 1:  # the next ones too, if that comes nearer
            too = F.coalesce(F.col("below") + F.col("own") - F.col("rest") < F.col("rest") - F.col("below"), F.lit(False))
            taken, upto = taken + F.when(too, F.col("own")).otherwise(0), upto + F.when(too, 1).otherwise(0)
        room = F.lit(float("inf")) if not k else F.col("rest") * (2 if k == ROUNDS - 1 else 1)
        held = F.when(F.col("rest") > 0, upto).otherwise(0).alias(f"upto{k}"), room.alias(f"room{k}")
        state = state.select("sid", "source_size", "target", "whole", *limits, *held, F.when(F.col("rest") > 0, F.col("rest") - taken).otherwise(0.0).alias("rest")).checkpoint()
        limits += [f"upto{k}", f"room{k}"]
        chosen |= (F.col("rank") < F.col(f"upto{k}")) & (F.col("size") <= F.col(f"room{k}")) & (F.col("size") > 0)
    out = rows.join(hint(state), "sid").withColumn("copies", F.col("whole") + F.when(chosen, 1).otherwise(0))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
