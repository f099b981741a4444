"""N-gram Jaccard self-join with token-combination prefixes.

A document is its set of distinct 5-word shingles ("tokens").  Two documents link
when their Jaccard similarity is at least 3/4.  The plan:

1. One pass makes each document's size and digest, and a sketch of token counts of
   fixed size.  Documents of equal digest are one class; only classes are joined.
2. The sketch orders tokens from rare to frequent, the same way everywhere, and
   calls those far above the mean *frequent*.  A document's prefix holds its first
   tokens in that order.  Rare prefix tokens are indexed singly.  Frequent tokens fall
   into sub-classes, and only pairs of tokens of one sub-class are indexed.
   As a sub-class may hide one shared token, the prefix grows by a token for each
   sub-class that it meets, so that two linked documents always share an entry.
3. An entry's documents are tied to one of them, which is verified on the sets;
   then entries that still touch several components are tied again, at last by all
   pairs across components.  A pair inside one component needs no test, so groups
   of copies cost a multiple of their size, not its square, and no component is lost.
4. Where links are counted, all pairs of classes of a component are tested, as every
   link lies inside one.  Its classes are dealt into blocks of bounded bytes, and each
   pair of blocks that may link gives its overlaps by a matrix product.  The tests grow
   with the square of a component's classes, the rows by that over a block's classes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .textnum import NON_SPACE, ensure_checkpoint_dir, lean, mix, release, shingles, small_batches, steps, word_hashes, words

#: Buckets of the sketch of token counts: 4 MB in any task, at any size of the input.
SKETCH_BITS = 20
#: A token is frequent when its bucket is this far, in documents and in deviations, above the mean bucket.
FREQUENT_LEAST, FREQUENT_DEVIATIONS = 32, 8
#: Documents of fewer tokens index single tokens only; a sub-class for each so many tokens of a size class.
PAIRS_FROM, TOKENS_PER_SUBCLASS = 64, 8
#: Hot entries are counted in so many parts.
SALTS = 8
#: Rounds that tie an entry's documents to one of them before all remaining pairs are made.
STAR_ROUNDS = 3
#: Labels are broadcast up to so many; more are joined by an exchange.
BROADCAST_LABELS = 500_000
#: Classes and tokens that a block of a component holds, about, where links are counted.
BLOCK_CLASSES, BLOCK_TOKENS = 256, 500_000
#: Tokens of one matrix product.
COLUMNS = 4096
#: Bits of the filter of documents to verify: at most 8 MB, whatever the input.
FILTER_BITS = 26

_U = np.uint64


def size_edges(most: int = 1 << 40) -> np.ndarray:
    """Edges of size classes; linked sets lie in the same class or in adjacent ones."""
    e = [1]
    while e[-1] < most:
        e.append(max(e[-1] + 1, -(-4 * e[-1] // 3)))
    return np.array(e, dtype=np.int64)


_EDGES = size_edges()


def token_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for lo, hi, data, offs in steps(column):
        starts, ends, counts = words(data, offs, NON_SPACE)
        s, at = shingles(word_hashes(data, starts, ends), counts)
        for r in range(hi - lo):
            yield lo + r, np.unique(s[at[r] : at[r + 1]])


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def node_of(key: bytes) -> int:
    """The 64-bit name of a class in the index."""
    return int.from_bytes(key[:8], "little", signed=True)


def bitmap(tokens: np.ndarray) -> bytes:
    """Which low hash bits the tokens have, in a power of two of at least twice as many bits as tokens."""
    size = 1 << max(6, (2 * len(tokens) - 1).bit_length() if len(tokens) else 6)
    bits = np.zeros(size, dtype=np.uint8)
    bits[(tokens & _U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(n: int, bits: np.ndarray, other: np.ndarray) -> int:
    """What a set of n tokens can share at most with a set of the bitmap `other`: each bit that is missing there is a token less."""
    size = min(len(bits), len(other))
    own, other = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for x in (bits, other))
    return n - int(np.bitwise_count(own & ~other).sum())


def links(n: int, m: int, both: int) -> bool:
    return 100 * both >= 75 * (n + m - both)


def least_overlap(n: int) -> int:
    """Tokens that a set of n must share with any set that it links with."""
    return (3 * n + 3) // 4


def grades(counts: np.ndarray) -> np.ndarray:
    """Counts of any size on a scale of 16 bits that keeps their order, in steps of a thousandth."""
    return np.floor(1024 * np.log2(1.0 + counts)).astype(np.uint16)


def first_frequent(counts: np.ndarray) -> int:
    """The grade from which a token is frequent."""
    return int(grades(np.array([FREQUENT_LEAST + counts.mean() + FREQUENT_DEVIATIONS * math.sqrt(counts.mean())]))[0])


def entries(tokens: np.ndarray, counts: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index entries, whether each may be hot, their places) of one set, under one global order of tokens.

    counts are the sketch's grades, frequent the grade from which tokens are frequent.
    An entry's place counts the prefix up to its last token, less one for each sub-class
    met; two sets of n and m tokens that link with an overlap of at least k share an entry whose places
    are at most n - k + 1 and m - k + 1.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, bool), np.zeros(0, np.int64)
    need = n - least_overlap(n) + 1
    seen = counts[tokens >> _U(64 - SKETCH_BITS)]
    key = (seen.astype(_U) << _U(48)) | (tokens >> _U(16))
    order = np.argsort(key, kind="stable")
    tokens, often = tokens[order], seen[order] >= frequent
    if not often[:need].any():
        return tokens[:need], often[:need], np.arange(1, need + 1)
    at = int(np.searchsorted(_EDGES, n, "right")) - 1
    place = np.full(n, n + 1, dtype=np.int64)  # of tokens that are indexed singly
    found, hot_places = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for size_class in (at, at + 1):  # partners lie here; both sides must follow the rule of one class
        if _EDGES[size_class] < PAIRS_FROM:
            place[:need] = np.minimum(place[:need], np.arange(1, need + 1))
            continue
        groups = int(_EDGES[size_class]) // TOKENS_PER_SUBCLASS
        where = np.flatnonzero(often)
        sub = (mix(tokens[where]) % _U(groups)).astype(np.int64)
        credit = np.ones(n, dtype=np.int64)
        credit[where[np.unique(sub, return_index=True)[1]]] = 0
        total = np.cumsum(credit)
        length = int(np.searchsorted(total, need)) + 1
        rare = np.flatnonzero(~often[:length])
        place[rare] = np.minimum(place[rare], total[rare])
        inside = where < length
        by = np.argsort(sub[inside], kind="stable")
        w, g = where[inside][by], sub[inside][by]
        t = tokens[w]
        for d in range(1, len(t)):
            same = g[d:] == g[:-d]
            if not same.any():
                break
            with np.errstate(over="ignore"):
                found.append(mix(t[:-d][same] * _U(0x9E3779B97F4A7C15) + t[d:][same] * _U(0xC2B2AE3D27D4EB4F) + _U(size_class + 1)))
            hot_places.append(total[w[d:][same]])
    single = place <= n
    pairs = np.concatenate(found)
    return np.concatenate([tokens[single], pairs]), np.concatenate([often[single], np.ones(len(pairs), bool)]), np.concatenate([place[single], *hot_places])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    names = ["doc_id", "n", "cls", "node", "bits", "sketch"]
    for b in batches:
        n, key, node, bits = [], [], [], []
        for _, t in token_sets(b.column("text")):
            n.append(len(t))
            key.append(digest(t))
            node.append(node_of(key[-1]))
            bits.append(bitmap(t))
            np.add.at(sketch, (t >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
        yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.binary())], names)
    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(sketch.tobytes(), 1)], pa.binary())], names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for b in batches:
        for x in b.column(0):
            total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.int64)
    yield pa.record_batch([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sketch"])


def _entries_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, frequent = shared.value
        done: set[bytes] = set()  # copies met in this task; bounded below
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for _, t in token_sets(b.column("text")):
                key = digest(t)
                if not len(t) or key in done:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(key)
                entry, hot, place = entries(t, counts, frequent)
                out[0].append(entry.view(np.int64))
                out[1].append(np.full(len(entry), node_of(key)))
                out[2].append(np.full(len(entry), len(t), dtype=np.int64))
                out[3].append(hot)
                out[4].append(place)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["entry", "node", "n", "hot", "place"])

    return run


def _sets_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        done: set[bytes] = set()  # copies met in this task; bounded below
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            hit = _in_filter(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
            hit |= ids.is_null().to_numpy(zero_copy_only=False)  # the filter names rows by id only
            part = pa.table({"text": b.column("text")}).filter(pa.array(hit)).column("text")
            nodes, cls, sets = [], [], []
            for _, t in token_sets(part):
                if len(t) and (key := digest(t)) not in done:
                    if len(done) > 200_000:
                        done.clear()
                    done.add(key)
                    cls.append(key)
                    nodes.append(node_of(key))
                    sets.append(t.tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(cls, pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "cls", "tokens"])

    return run


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for n, m, x, y in zip(b.column("m").to_pylist(), b.column("o").to_pylist(), b.column("x"), b.column("y"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            ok.append(links(n, m, min(most_overlap(n, s, t), most_overlap(m, t, s))))
        yield b.select(["a", "b", "la", "lb"]).filter(pa.array(ok, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(links(len(s), len(t), both))
        yield b.select(["la", "lb"]).filter(pa.array(ok, pa.bool_()))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of `left` shares with each of `right`; the tokens of a set are distinct."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])))
    known = np.intersect1d(sides[0][0], sides[1][0])
    columns = []
    for tokens, owner in sides:
        at = np.searchsorted(known, tokens)
        there = at < len(known)
        there[there] = known[at[there]] == tokens[there]
        at, owner = at[there], owner[there]
        by = np.argsort(at, kind="stable")
        columns.append((at[by], owner[by]))
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for lo in range(0, len(known), COLUMNS):
        parts = []
        for sets, (at, owner) in zip((left, right), columns, strict=True):
            i, j = np.searchsorted(at, (lo, lo + COLUMNS))
            part = np.zeros((len(sets), COLUMNS), dtype=np.float32)  # sums up to COLUMNS are exact
            part[owner[i:j], at[i:j] - lo] = 1
            parts.append(part)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


def _links_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, rows it links with in this pair of blocks) from rows sorted by label and pair; side is 0 where both blocks are one."""

    def counted(group: list[tuple]) -> Iterator[tuple[bytes, int]]:
        left, right = [x for x in group if x[0] < 2], [x for x in group if x[0] != 1]
        if not left or not right or len(group) < 2:
            return
        n, m = (np.array([len(x[3]) for x in side]) for side in (left, right))
        ok = links(n[:, None], m[None, :], overlaps([x[3] for x in left], [x[3] for x in right]))
        if group[0][0] == 0:
            np.fill_diagonal(ok, False)
        else:
            yield from zip((x[2] for x in right), (np.array([x[1] for x in left]) @ ok).tolist(), strict=True)
        yield from zip((x[2] for x in left), (ok @ np.array([x[1] for x in right])).tolist(), strict=True)

    key, group = None, []
    names = ["label", "s", "b", "t", "c"]
    for b in batches:
        out: list[tuple[bytes, int]] = []
        keys = zip(*(b.column(x).to_pylist() for x in names), strict=True)
        for now, side, k, cls, tokens in zip(keys, b.column("side").to_pylist(), b.column("k").to_pylist(), b.column("cls").to_pylist(), b.column("tokens"), strict=True):
            if now != key:
                out += counted(group)
                key, group = now, []
            group.append((side, k, cls, np.frombuffer(tokens.as_buffer(), _U)))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())], ["cls", "n_links"])
    out = list(counted(group))
    yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())], ["cls", "n_links"])


def _linked_rows(docs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, rows of other classes that it links with) for classes(cls, node, least, n, k), of which labels(node, label) names the components."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.searchsorted(_EDGES, b.column("n").to_numpy(), "right")
            yield pa.record_batch([*b.columns, pa.array(s.astype(np.int32))], [*b.schema.names, "s"])

    mine = classes.select("cls", "node", "least", "n", "k").join(labels, "node").select("cls", "least", "n", "k", "label")
    mine = mine.mapInArrow(lean(sized), "cls binary, least long, n long, k long, label long, s int").checkpoint()
    held = mine.groupBy("label", "s").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    whole = held.groupBy("label").agg(F.collect_list(F.struct("s", "rows", "tokens")).alias("x"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
    # a component of one block needs no size classes: null stands for that
    deal = F.when((F.col("rows") > BLOCK_CLASSES) | (F.col("tokens") > BLOCK_TOKENS), F.map_from_entries(F.transform("x", lambda x: F.struct(x["s"], F.ceil(F.greatest(x["rows"] / BLOCK_CLASSES, x["tokens"] / BLOCK_TOKENS)).cast("int")))))
    mine = mine.join(whole.where("rows > 1").select("label", deal.alias("blocks")), "label").checkpoint()
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(mine.select("least")))
    sets = docs.mapInArrow(lean(_sets_of(bits)), "node long, cls binary, tokens binary").select("cls", "tokens")
    s, own = F.col("s"), F.col("own")
    pair = lambda s, b, t, c, side: F.struct(s.cast("int").alias("s"), b.cast("int").alias("b"), t.cast("int").alias("t"), c.cast("int").alias("c"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    others = lambda t: F.when(F.element_at("blocks", t).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.element_at("blocks", t) - 1))
    same = F.transform(others(s), lambda c: pair(s, F.least(own, c), s, F.greatest(own, c), F.when(own == c, 0).when(own < c, 1).otherwise(2)))
    above = F.transform(others(s + 1), lambda c: pair(s, own, s + 1, c, 1))
    below = F.transform(others(s - 1), lambda c: pair(s - 1, c, s, own, 2))
    zero = F.lit(0)
    pairs = F.when(F.col("blocks").isNull(), F.array(pair(zero, zero, zero, zero, 0))).otherwise(F.concat(same, above, below))
    mine = mine.withColumn("own", F.pmod(F.xxhash64("cls"), F.element_at("blocks", s)))
    dealt = sets.join(mine.select("cls", "label", "k", pairs.alias("pairs")), "cls").dropDuplicates(["cls"])
    dealt = dealt.select("label", F.explode("pairs").alias("p"), "k", "cls", "tokens").select("label", "p.*", "k", "cls", "tokens")
    by = ["label", "s", "b", "t", "c"]
    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(_links_of_blocks), "cls binary, n_links long")
    return found.groupBy("cls").agg(F.sum("n_links").alias("n_links"))


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size that holds the hash of every id of ids(id); made by OR in the executors."""
    rows = ids.count()
    size = 1 << min(FILTER_BITS, max(13, math.ceil(math.log2(16 * rows + 1))))

    def bits(batches):
        mine = np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            if b.schema.names == ["id"]:
                h = mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> _U(64 - int(math.log2(size)))
                np.bitwise_or.at(mine, (h >> _U(3)).astype(np.int64), (_U(1) << (h & _U(7))).astype(np.uint8))
            else:
                for x in b.column(0):
                    mine |= np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        yield pa.record_batch([pa.array([zlib.compress(mine.tobytes(), 1)], pa.binary())], ["bits"])

    parts = ids.toDF("id").where("id is not null").mapInArrow(lean(bits), "bits binary")
    for x in parts.repartition(1).mapInArrow(lean(bits), "bits binary").collect():  # one row of at most 8 MB
        return np.frombuffer(zlib.decompress(x["bits"]), dtype=np.uint8)
    return np.zeros(size // 8, dtype=np.uint8)


def _in_filter(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64)) >> _U(64 - int(math.log2(len(bits) * 8)))
    return ((bits[(h >> _U(3)).astype(np.int64)] >> (h & _U(7)).astype(np.uint8)) & 1).astype(bool)


def may_hold(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of a column of numbers that is true of every number of ids(id), and of a few others.

    Only the numbers go to Python; what rows else hold stays where it is, so large rows that
    fail the test need no exchange to be told from those of the ids.
    """
    shared = ids.sparkSession.sparkContext.broadcast(_id_filter(ids))

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(_in_filter(x.to_numpy(), shared.value))

    return test


def near_duplicates(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text), with count_links also n_links.

    component_id is the smallest doc_id that links lead to, the row's own included;
    rows without words link with nothing and keep their own id.  Null texts count as empty.
    Rows that repeat a doc_id are rows of their own; a row with a null doc_id takes
    part in links, and its component_id is null only if no member has an id.
    n_links is the number of other rows that the row links with, exact copies included;
    its sum is twice the number of links.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ensure_checkpoint_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = docs.mapInArrow(lean(_profile), "doc_id long, n long, cls binary, node long, bits binary, sketch binary").checkpoint()
    parts = profile.where("sketch is not null").select("sketch")
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    level = parts.repartition(max(1, math.isqrt(profile.rdd.getNumPartitions()))).mapInArrow(lean(_merge), "sketch binary")
    for x in level.repartition(1).mapInArrow(lean(_merge), "sketch binary").collect():  # one row of fixed size
        counts = np.frombuffer(zlib.decompress(x["sketch"]), dtype=np.int64)
    rows = profile.where("cls is not null").select("doc_id", "n", "cls", "node", "bits")
    copies = [F.count("*").alias("k")] if count_links else []
    classes = rows.where("n > 0").groupBy("cls", "node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), *copies).checkpoint()
    node = F.col("node")

    shared = spark.sparkContext.broadcast((grades(counts), first_frequent(counts)))
    found = docs.mapInArrow(lean(_entries_of(shared)), "entry long, node long, n long, hot boolean, place long")
    # one sort inside an entry, or a part of a hot one, finds whether it ties different classes, and repeats of a class
    part = Window.partitionBy("entry", F.when(F.col("hot"), F.pmod(node, F.lit(SALTS))).otherwise(F.lit(0))).orderBy("node")
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = found.withColumns({"lo": F.first("node").over(whole), "hi": F.last("node").over(whole), "before": F.lag("node").over(part)})
    met = met.where("(hot or lo <> hi) and (before is null or before <> node)").select("entry", "node", "n", "place")
    lists = met.withColumn("label", node).checkpoint()
    del found, met
    release()
    edges = labels = change = None
    for round_ in range(STAR_ROUNDS + 1):
        if change is not None:
            known = F.broadcast(change) if change.count() <= BROADCAST_LABELS else change
            lists = lists.join(known.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("entry", "node", "n", "place", F.coalesce("now", "label").alias("label"))
        # of each entry, the member with least before it is most likely what the others were copied from
        lead = lists.groupBy("entry").agg(F.min(F.struct("place", F.xxhash64("node", F.lit(round_)).alias("p"), "node", "n", "label")).alias("f"), F.min("label").alias("c"), F.max("label").alias("d")).where("c <> d")
        lists = lists.join(lead.select("entry", "f"), "entry").checkpoint()
        if change is not None and lists.limit(1).count() == 0:
            break
        side = lambda v: [F.col("node").alias(v), F.col("n").alias(f"n{v}"), F.col("place").alias(f"p{v}"), F.col("label").alias(f"l{v}")]
        outside = lists.where("label <> f.label")
        if round_ < STAR_ROUNDS:
            pairs = outside.select(*side("a"), *[F.col(f"f.{x}").alias(y) for x, y in (("node", "b"), ("n", "nb"), ("place", "pb"), ("label", "lb"))])
        else:  # members of the leading component, though they may be many, are on one side only
            pairs = outside.select("entry", *side("a")).join(lists.select("entry", *side("b")), "entry")
        overlap = F.ceil((F.col("na") + F.col("nb")) * 3 / F.lit(7.0) - F.lit(1e-9))
        fits = (F.col("la") != F.col("lb")) & (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (F.col("pa") <= F.col("na") - overlap + 1) & (F.col("pb") <= F.col("nb") - overlap + 1)
        first = F.col("a") < F.col("b")
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        pairs = pairs.where(fits).select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("la", "lb").alias("la"), pick("lb", "la").alias("lb")).distinct()
        lists = lists.drop("f")
        # bitmaps rule most pairs out that share some passage only; the rest is verified on the sets, of which only theirs are made
        x = classes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
        y = classes.select(F.col("node").alias("b"), F.col("n").alias("o"), F.col("bits").alias("y"))
        likely = pairs.join(y, "b").join(x, "a").select("a", "b", "la", "lb", "m", "o", "x", "y").mapInArrow(lean(_may_link), "a long, b long, la long, lb long").checkpoint()
        ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        bits = spark.sparkContext.broadcast(_id_filter(ends.join(classes.select("node", "least"), "node").select("least")))
        sets = docs.mapInArrow(lean(_sets_of(bits)), "node long, cls binary, tokens binary").dropDuplicates(["node"]).checkpoint()
        x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        good = likely.join(y, "b").join(x, "a").select("a", "b", "la", "lb", "x", "y").mapInArrow(lean(_verify), "la long, lb long")
        # only what this round adds is solved: its links tie labels of former rounds
        change = components(good.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        if labels is None:
            labels = change
        else:
            moved = labels.join(change.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
            labels = moved.unionByName(change.join(labels.select("node"), "node", "left_anti")).checkpoint()
        bits.destroy()
        del likely, sets, good, ends, x, y, pairs, outside, lead
        release()
    shared.destroy()

    tied = classes.join(labels, "node", "left").select("cls", "least", F.coalesce("label", "node").alias("label"))
    lowest = tied.groupBy("label").agg(F.min("least").alias("component_id"))
    of = tied.join(lowest, "label").select("cls", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    if not count_links:
        return rows.join(of, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), component)
    linked = classes.select("cls", "k").join(_linked_rows(docs, classes, labels), "cls", "left")
    of = of.join(linked.select("cls", (F.coalesce("n_links", F.lit(0)) + F.col("k") - 1).alias("n_links")), "cls")
    return rows.join(of, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), component, F.coalesce("n_links", F.lit(0)).alias("n_links"))
