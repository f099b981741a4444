"""Secret scan with corpus-wide ownership frequency, in built-in expressions only.

Candidates come from three patterns.  The hash of each candidate's value is counted by
distinct repositories and owners over the whole corpus; a value that several owners or very many
repositories carry is a copied example, and one of few that looks random is a live credential,
which adds a span of kind `live` over the value itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import ensure_checkpoint_dir

# The patterns of the scan.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A value that so many owners carry is an example that people copy.
COPIED_OWNERS = 3
#: So is one in so many repositories, be they of one owner.
COPIED_REPOSITORIES = 10
#: A live-looking value has so many characters, and so many different ones.
LIVE_LENGTH, LIVE_KINDS = 16, 8
#: Where short values count too, an assigned one has so many characters, digits and letters among them, and half of them different.
SHORT_LENGTH = 8
PLACEHOLDER = r"(?i)example|changeme|placeholder|your|xxxx"

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums_before(lengths: Column) -> Column:
    """For each place of a non-empty array, the sum of what stands before it.

    Sums of blocks come first, so n places cost some n times the root of n additions and no copies of the result.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    places = lambda a, step=1: F.sequence(F.lit(0), F.floor((F.size(a) - 1) / step).cast("int"))

    def sums(a: Column, block: Column) -> Column:
        blocks = F.transform(places(a, block), lambda k: total(F.slice(a, k * block + 1, block)))
        tops = _let(blocks, lambda x: F.transform(places(x), lambda k: total(F.slice(x, F.lit(1), k))))
        number = lambda i: F.floor(i / block).cast("int")
        return _let(tops, lambda t: F.transform(places(a), lambda i: F.get(t, number(i)) + total(F.slice(a, number(i) * block + 1, i - number(i) * block))))

    return _let(lengths, lambda a: _let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda block: sums(a, block)))


def _spans(text: Column, pattern: str, kind: str, rank: int, value_group: int, least: int, may: Column) -> Column:
    """The pattern's matches as structs; what lies before each is the pieces and matches before it."""
    regex = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, regex, F.lit(0)).alias("all"), F.regexp_extract_all(text, regex, F.lit(value_group)).alias("value"))
    sized = F.transform(F.filter(found, lambda x: x["all"].isNotNull()), lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["all"]).alias("n"), x["value"].alias("value")))

    def placed(rows: Column) -> Column:
        both = F.arrays_zip(rows.alias("x"), _sums_before(F.transform(rows, lambda x: (x["gap"] + x["n"]).cast("bigint"))).alias("at"))
        one = lambda y: F.struct((y["at"] + y["x"]["gap"]).alias("start"), F.lit(rank).alias("rank"), (y["at"] + y["x"]["gap"] + y["x"]["n"]).alias("end"), F.lit(kind).alias("kind"), y["x"]["value"].alias("value"))
        return F.transform(F.filter(both, lambda y: F.length(y["x"]["value"]) >= least), one)

    return F.when(may & text.rlike(pattern), _let(sized, placed)).otherwise(F.array()).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """All spans of the three patterns, by start and then by kind (assign, access, hex), in code points."""
    text = F.coalesce(text, F.lit(""))
    assign = _spans(text, ASSIGN, "assign", 0, 2, 8, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    access = _spans(text, ACCESS, "access", 1, 0, 16, F.contains(text, F.lit("AKIA")))
    hexes = _spans(text, HEX, "hex", 2, 0, 32, F.lit(True))
    return F.array_sort(F.concat(assign, access, hexes))


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def owner_of(repository: Column) -> Column:
    """The part of a repository name before its first slash."""
    return F.substring_index(repository, "/", 1)


def live_spans(candidates: DataFrame, short: bool = False) -> DataFrame:
    """(rid, live, n_copied) for candidates(rid, repository, span): owner-specific live-looking values, and how many spans are copied examples.

    Hashes are made distinct by repository before they are counted, so that a value that
    a third of all rows hold reaches the counting tasks once a repository and task.
    With `short`, assigned values from SHORT_LENGTH characters that mix letters and digits count as live-looking too.
    A null repository counts as an empty name.
    """
    c = candidates.withColumn("hash", F.sha2("span.value", 256)).withColumn("owner", owner_of(F.col("repository")))
    seen = c.select("hash", "owner", "repository").distinct()
    count = seen.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.count("*").alias("n_repositories"))
    value = F.col("span.value")
    different = F.size(F.array_distinct(F.split(value, "")))
    looks = (F.length(value) >= LIVE_LENGTH) & (different >= LIVE_KINDS)
    if short:
        looks |= (F.col("span.kind") == "assign") & F.length(value).between(SHORT_LENGTH, LIVE_LENGTH - 1) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (2 * different >= F.length(value))
    looks &= ~value.rlike(PLACEHOLDER)
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES)
    one = F.struct((F.col("span.end") - F.length(value)).cast("bigint").alias("start"), F.lit(3).alias("rank"), F.col("span.end").alias("end"), F.lit("live").alias("kind"), F.lit("").alias("value"))
    # the counts come dealt by hash; as a new expression, the key deals both sides anew, so that a hash of many rows can be split
    count = count.withColumn("hash", F.concat("hash", F.lit("")))
    marked = c.join(count, "hash").select("rid", F.when(looks & ~copied, one).alias("live"), copied.alias("copied"))
    return marked.groupBy("rid").agg(F.collect_set("live").alias("live"), F.count_if("copied").alias("n_copied"))


def scan(docs: DataFrame, repository: str = "source") -> DataFrame:
    """One row for each row of docs(doc_id, text, repository) with its spans.

    Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.  A null
    text is empty; rows without a repository share the empty one; null and repeated
    doc_ids are rows like others; other columns are ignored; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(repository), F.lit("")).alias("repository"), base_spans(F.col("text")).alias("base"))
    found = found.checkpoint().withColumn("rid", F.monotonically_increasing_id())  # fixed rows and partitions, so fixed numbers
    live = live_spans(found.where(F.size("base") > 0).select("rid", "repository", F.explode("base").alias("span")))
    out = found.join(live, "rid", "left")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.coalesce("live", F.array().cast(_SPAN))
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit("").alias("value")))
    return out.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(render(F.col("base")), 256).alias("base_sha256"),
        render(F.array_sort(F.concat(bare, live))).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", repository: str = "source") -> DataFrame:
    """docs with all columns; each live value in the text, short ones included, is replaced by `mark`.

    Rows without a candidate pass through unshuffled; only the others are joined with their
    live spans, by doc_id, repository and a hash of the text, which equal rows share.
    """
    text = F.coalesce("text", F.lit(""))
    spans = base_spans(F.col("text"))
    some = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN) | F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS) | text.rlike(HEX)
    key = F.struct(F.col("doc_id"), F.col(repository), F.xxhash64("text"), F.length("text"))
    held = docs.where(some).withColumn("__rid", key)
    live = live_spans(held.select(F.col("__rid").alias("rid"), F.coalesce(F.col(repository), F.lit("")).alias("repository"), F.explode(spans).alias("span")), short=True).select(F.col("rid").alias("__rid"), "live")
    last_first = F.reverse(F.array_sort("live"))

    def step(acc: Column, s: Column) -> Column:  # spans may overlap: each is cut where the next one starts
        end = F.least(s["end"], acc["limit"])
        cut = F.concat(F.substr(acc["text"], F.lit(1), s["start"].cast("int")), F.lit(mark), F.substr(acc["text"], (end + 1).cast("int")))
        return F.struct(cut.alias("text"), s["start"].alias("limit"))

    first = F.struct(F.col("text").alias("text"), F.length("text").cast("bigint").alias("limit"))
    cut = F.aggregate(last_first, first, step, lambda acc: acc["text"])
    held = held.join(live, held["__rid"].eqNullSafe(live["__rid"]), "left").drop("__rid").withColumn("text", F.when(F.size("live") > 0, cut).otherwise(F.col("text"))).drop("live")
    return docs.where(~some).unionByName(held)
