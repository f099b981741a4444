"""Temporal join of captures with dated URL lists, in built-in expressions only.

Dated entries become validity intervals, and each capture is judged by the entries that
were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(F.rtrim(host, F.lit("."))), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Disjoint (domain, verdict, since, until) of entries(domain, verdict, action, day).

    `add` opens an interval and `remove` closes it; an open one has a null end.  A second add
    or remove changes nothing; of an add and a remove on one day the remove counts; entries with
    a null are ignored.  Only the changes of one domain and verdict meet in one task.
    """
    e = entries.select(F.lower("domain").alias("domain"), "verdict", "action", "day").dropna().where("action in ('add', 'remove')")
    day = e.groupBy("domain", "verdict", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("domain", "verdict").orderBy("day")
    change = day.withColumn("was", F.lag("action", 1, "remove").over(w)).where("action <> was")
    return change.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("domain", "verdict", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures with host, n_active, domain, verdict and since by the entries active on their day.

    An entry covers its domain and all hosts below.  Of the active entries the longest
    domain decides, and `allow` goes before `block` on equal domains; n_active counts them all.
    Without an active entry, host or day, the verdict is `none` and n_active 0.  Each capture
    gives one row, repeated ones too.  An own column of one of these names is replaced, and one named __list or __active dropped.

    The hosts are made distinct before they meet the list, so a host that a third of all
    captures share is looked up once; captures then take up their host's intervals by an
    equi-join between two exchanges, whose large partitions adaptive execution can split.
    """
    captures = captures.drop("host", "n_active", "domain", "verdict", "since", "__list", "__active").withColumn("host", host_of(F.col(url)))
    hosts = captures.select("host").where("host is not null").distinct()
    below = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    one = F.struct((-F.length("domain")).alias("rank"), "verdict", "domain", "since", "until")
    of = below.join(intervals(entries), "domain").groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("__list"))
    # as an expression the key is dealt anew, else the aggregation's own dealing would hold hot hosts together
    of = of.select(F.concat("host", F.lit("")).alias("host"), "__list")
    joined = captures.join(of, "host", "left")
    on = F.col(day)
    active = F.filter(F.coalesce("__list", F.array().cast(of.schema["__list"].dataType)), lambda x: (x["since"] <= on) & (x["until"].isNull() | (on < x["until"])))
    first = F.get("__active", F.lit(0))
    return joined.withColumn("__active", active).select(
        *[c for c in captures.columns],
        F.size("__active").cast("long").alias("n_active"),
        first["domain"].alias("domain"),
        F.coalesce(first["verdict"], F.lit("none")).alias("verdict"),
        first["since"].alias("since"),
    )
