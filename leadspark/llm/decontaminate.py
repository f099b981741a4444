"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item of m words, the windows of m words of each document are
compared with it.  A window's SimHash has 128 bits over its pairs of neighbouring words.  Items are found through
16 blocks of 8 bits: a pair that differs in at most RADIUS bits has more than FLIPS different
bits in at most RADIUS / (FLIPS + 1) blocks (pigeonhole), so it agrees, up to FLIPS bits, in
all AGREE others; items that agree in fewer blocks are passed over unseen.  This guarantees every
fingerprint within the radius and meets about one random item in a hundred.  Candidates are then verified by
the exact weighted similarity of five-word shingles, sum of least counts over sum of largest counts.

A similarity of 0.75 needs 6/7 of an item's shingles in the window, so windows with
fewer shingles of any item are passed over before fingerprints are made; this loses none.
It also bounds what a fingerprint can differ by: at most one pair in seven or so, and mostly far fewer, as each
word that differs takes five shingles but two pairs.
An item of fewer than five words is one shingle of all its words, and so is each window of as many words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import _K, ALNUM, lean, mix, shingles, small_batches, steps, word_hashes, words

#: Bytes of a fingerprint, each of them a block, and the bits in which an item may differ from a window.
BLOCKS, RADIUS = 16, 29
#: Bits in which blocks may differ that agree, and how many blocks then agree at least.
FLIPS = 2
AGREE = BLOCKS - RADIUS // (FLIPS + 1)
#: Windows, and windows times items, that one numpy step handles.
STEP_WINDOWS, STEP_PAIRS = 16_384, 4_000_000
#: Items of one pass over the documents; a larger benchmark takes several, as this index goes to every task.
ITEMS_PER_PASS = 10_000
_BITMAP = 22
_U = np.uint64
_SECOND = _U(0x5851F42D4C957F2D)


def fingerprints(h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash, as BLOCKS bytes, of the pairs of words in [start, start + m) for each of the ascending starts.

    A step holds prefix sums of eight bits over the words of at most STEP_WINDOWS places.
    """
    out = np.zeros((len(starts), BLOCKS), dtype=np.uint8)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + STEP_WINDOWS))
        own = h[starts[lo] : starts[hi - 1] + m]
        with np.errstate(over="ignore"):
            own = mix(own[:-1] * _K[0] + own[1:])
        at = starts[lo:hi] - starts[lo]
        for half, x in enumerate((own, mix(own ^ _SECOND))):
            for k, byte in enumerate(x.astype("<u8").view(np.uint8).reshape(-1, 8).T):
                total = np.zeros((len(own) + 1, 8), dtype=np.int32)
                np.cumsum(np.unpackbits(byte[:, None], axis=1), axis=0, dtype=np.int32, out=total[1:])
                up = 2 * (total[at + m - 1] - total[at]) > m - 1
                out[lo:hi, 8 * half + k] = np.packbits(up, axis=1).reshape(-1)
        lo = hi
    return out


def weighted_similarity(a: Counter, b: Counter) -> float:
    least = sum((a & b).values())
    return least / max(1, sum(a.values()) + sum(b.values()) - least)


class Items:
    """The index of some benchmark items, by their number of words."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        column = pa.array(texts, pa.string())
        self.counts: list[Counter] = [Counter() for _ in ids]
        self.sizes: dict[int, list[int]] = defaultdict(list)
        self.prints = np.zeros((len(ids), BLOCKS), dtype=np.uint8)
        for lo, hi, data, offs in steps(column):
            starts, ends, at = words(data, offs, ALNUM)
            h = word_hashes(data, starts, ends)
            s, s_at = shingles(h, at)
            for r in range(hi - lo):
                m = int(at[r + 1] - at[r])
                if m:
                    self.counts[lo + r] = Counter(s[s_at[r] : s_at[r + 1]].tolist())
                    self.sizes[m].append(lo + r)
                    self.prints[lo + r] = fingerprints(h[at[r] : at[r + 1]], np.zeros(1, np.int64), m)[0]
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words and shingle
        for m in range(1, 5):
            for r in self.sizes.get(m, ()):
                self.short.setdefault(m, {}).setdefault(next(iter(self.counts[r])), []).append(r)
        known = np.array(sorted({x for c in self.counts for x in c}), dtype=_U)
        self.known = known
        self.bitmap = np.zeros(1 << _BITMAP, dtype=bool)
        self.bitmap[(known >> _U(64 - _BITMAP)).astype(np.int64)] = True
        self._tables: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": {}}  # made again where they are used

    def agreeing(self, m: int, prints: np.ndarray) -> np.ndarray:
        """For each fingerprint and each item of m words, whether they agree in AGREE blocks."""
        if m not in self._tables:  # of each block and value, the items whose block agrees
            every = np.arange(256, dtype=np.uint8)
            own = self.prints[self.sizes[m]]
            self._tables[m] = np.stack([np.bitwise_count(every[:, None] ^ own[:, k]) <= FLIPS for k in range(BLOCKS)]).astype(np.uint8)
        blocks = np.zeros((len(prints), len(self.sizes[m])), dtype=np.uint8)
        for k, table in enumerate(self._tables[m]):
            blocks += table[prints[:, k]]
        return blocks >= AGREE

    def near(self, m: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(fingerprint, item) of all items of m words that are within RADIUS of a fingerprint."""
        rows = np.array(self.sizes[m])
        step = max(1, STEP_PAIRS // len(rows))
        for lo in range(0, len(prints), step):
            i, j = np.nonzero(self.agreeing(m, prints[lo : lo + step]))
            close = np.bitwise_count(prints[lo + i] ^ self.prints[rows[j]]).sum(axis=1) <= RADIUS
            yield from zip((lo + i[close]).tolist(), rows[j[close]].tolist(), strict=True)


def short_windows(h: np.ndarray, m: int) -> np.ndarray:
    """The shingle of each window of m < 5 words, as shingles() makes it of a text of these words; windows may cross rows."""
    n = max(0, len(h) - m + 1)
    whole = np.full(n, m, dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(m):
            whole = whole * _K[0] + h[j : n + j] * _K[(j + 1) % 5]
    return mix(whole ^ _K[4])


def find(index: Items, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int]]:
    """(row, item, best similarity, first word of its first best window) of every item found in a row."""
    for lo, _, data, offs in steps(column):
        starts, ends, at = words(data, offs, ALNUM)
        h = word_hashes(data, starts, ends)
        s, s_at = shingles(h, at)
        for m, by_hash in index.short.items():
            g = short_windows(h, m)
            i = np.flatnonzero(np.isin(g, np.array(list(by_hash), dtype=_U)))
            r = np.searchsorted(at, i, "right") - 1
            inside = i + m <= at[r + 1]
            met = set()
            for i, r in zip(i[inside].tolist(), r[inside].tolist(), strict=True):
                x = int(g[i])
                if (r, x) not in met:
                    met.add((r, x))
                    for item in by_hash[x]:
                        yield lo + r, item, 1.0, i - int(at[r])
        where = np.flatnonzero(index.bitmap[(s >> _U(64 - _BITMAP)).astype(np.int64)])
        if not len(where):
            continue
        near = np.minimum(np.searchsorted(index.known, s[where]), len(index.known) - 1)
        where = where[index.known[near] == s[where]]
        if not len(where):
            continue
        rows, first_hit = np.unique(np.searchsorted(s_at, where, "right") - 1, return_index=True)
        for r, own_hits in zip(rows.tolist(), np.split(where, first_hit[1:]), strict=True):
            tokens, own = h[at[r] : at[r + 1]], s[s_at[r] : s_at[r + 1]]
            hits = np.zeros(len(own) + 1, dtype=np.int64)
            hits[own_hits - s_at[r] + 1] = 1
            hits = np.cumsum(hits)
            best: dict[int, tuple[float, int]] = {}
            for m in index.sizes:
                if m < 5:
                    continue
                width = min(m, len(tokens))  # a document shorter than the item is one window
                span = max(1, width - 4)
                first = np.arange(len(tokens) - width + 1)
                need = threshold / (1 + threshold) * (span + max(1, m - 4)) - 1e-9
                enough = np.flatnonzero(hits[first + span] - hits[first] >= need)
                if not len(enough):
                    continue
                for k, item in index.near(m, fingerprints(tokens, enough, width)):
                    i = int(enough[k])
                    x = weighted_similarity(Counter(own[i : i + span].tolist()), index.counts[item])
                    if x >= threshold and x > best.get(item, (0.0, 0))[0]:
                        best[item] = (x, i)
            for item, (x, i) in best.items():
                yield lo + r, item, x, i


def _passes(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in indexes of about ITEMS_PER_PASS items; an item without words matches nothing."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = -(-items.count() // ITEMS_PER_PASS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) for each item of benchmark(item_id, text) that a document of docs(doc_id, text) holds.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z read as
    a-z.  similarity is the best of all windows of the item's size, first_word where the
    first such window starts.  A document of fewer words than the item is one window; an
    item of fewer than five words is found where a document holds these words in a row.
    Null or empty texts on either side match nothing; repeated rows give repeated results;
    null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, item_id long, similarity double, first_word long"
    out = spark.createDataFrame([], kind)
    for index in _passes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                found = list(find(shared.value, b.column("text"), threshold))
                cols = [b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([shared.value.ids[f[1]] for f in found], pa.int64())]
                yield pa.record_batch([*cols, pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])

        out = out.unionByName(docs.mapInArrow(lean(run), kind))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark; see leaks()."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in _passes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[f[0] for f in find(shared.value, b.column("text"), threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
