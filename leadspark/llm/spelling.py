"""Spelling variants: words one edit apart, by two-dimensional range reporting.

For each position of an edit, the words with the same letters before it are an interval of the forward order,
and those with the same letters after it an interval of the order of the reversed words; a wavelet tree over the permutation
between both orders reports the words that lie in both intervals.  Words of one length and of the next are looked at together: those of
equal length that it reports have a replaced letter, the longer ones an inserted one.

Words are dealt into blocks that one task holds.  A block serves a range of positions and holds all words that agree
before the range and after it; it begins with all positions and the words of a length, and while it is too large, the
range is halved, so that its words divide by what they share before or after.  At a single position only the letter there is free.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import ensure_checkpoint_dir, lean, small_batches

#: Letters of a word at least, occurrences at least, and how much more frequent a form is.
LETTERS, OCCURRENCES, TIMES = 5, 3, 2
#: One of so many checksums drops a letter.
DROP_ONE_OF = 97
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 200_000
#: Letters that the words of a block may have in all; a larger group is divided, unless it serves a single position or has few words, which are long then.
BLOCK_LETTERS, FEW_WORDS = 1_000_000, 64
#: Queries that the tree answers in one step.
STEP_QUERIES = 1 << 16
#: Too large groups up to which their keys are broadcast.
BROADCAST_GROUPS = 100_000

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts, each word about once."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return made

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(_RUN.findall((text.as_py() or b"").translate(_FOLD).decode())).items():
                h = zlib.crc32(run.encode(), before)
                if h % DROP_ONE_OF == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LETTERS:
                        continue
                held[run] += n
            if len(held) > HELD_WORDS:
                yield out()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs(doc_id, text) that occur often enough."""
    small_batches(docs.sparkSession)
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_counted), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class WaveletTree:
    """A permutation, level by level of its values' bits: how many values before each place have a zero there."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for k in reversed(range(self.levels)):
            one = (values >> k & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [c, d) at the places [a, b), for many queries at once."""
        query, base = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
        for k, zeros in zip(reversed(range(self.levels)), self.zeros, strict=True):
            za, zb, half = zeros[a], zeros[b], base + (1 << k)
            left = (zb > za) & (c[query] < half) & (d[query] > base)
            ones = zeros[-1]
            ra, rb = ones + a - za, ones + b - zb
            right = (rb > ra) & (c[query] < half + (1 << k)) & (d[query] > half)
            query = np.concatenate([query[left], query[right]])
            a, b = np.concatenate([za[left], ra[right]]), np.concatenate([zb[left], rb[right]])
            base = np.concatenate([base[left], half[right]])
        return query, base


class _Order:
    """The sorted order of equally wide rows, and the intervals of rows that begin alike."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        self.rank = np.empty(len(rows), dtype=np.int64)
        self.rank[self.order] = np.arange(len(rows))
        same = rows[self.order[1:]] == rows[self.order[:-1]]
        self.alike = np.concatenate([[-1], np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))])
        self.most = int(self.alike.max())

    def intervals(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, last) of the ranks whose first n letters are those of the ranks `at`."""
        bounds = np.append(np.flatnonzero(self.alike < n), len(self.alike))
        k = np.searchsorted(bounds, at, "right")
        return bounds[k - 1], bounds[k]


def near_pairs(words: list[bytes], length: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of distinct words that are one edit apart, both ways round, each once.

    The words are distinct and have `length` letters or one more.  Found are replaced letters at the positions [lo, hi), and
    letters inserted there into a word of `length` letters; of neighbouring equal letters, the first counts as inserted.
    """
    size = np.array([len(w) for w in words], dtype=np.int64)
    rows = np.frombuffer(b"".join(w.ljust(length + 1, b"\0") for w in words), dtype=np.uint8).reshape(len(words), length + 1)
    ahead = _Order(rows)
    back = _Order(np.frombuffer(b"".join(w[::-1].ljust(length + 1, b"\0") for w in words), dtype=np.uint8).reshape(rows.shape))
    short = np.flatnonzero(size == length)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for longer in (0, 1):
        target = size == length + longer
        if not len(short) or not target.any():
            continue
        before_ahead, before_back = (np.concatenate([[0], np.cumsum(target[x.order])]) for x in (ahead, back))
        by_back = back.order[target[back.order]]
        tree = WaveletTree(before_back[back.rank[ahead.order[target[ahead.order]]]])
        own = 1 - longer  # a word lies in its own intervals
        # no two words are alike in more letters than `most`, on either side
        for i in range(max(lo, length + longer - 1 - back.most), min(hi, length + longer, ahead.most + 1)):
            for first in range(0, len(short), STEP_QUERIES):
                q = short[first : first + STEP_QUERIES]
                a, b = (before_ahead[x] for x in ahead.intervals(i, ahead.rank[q]))
                some = np.flatnonzero(b - a > own)
                c, d = (before_back[x] for x in back.intervals(length + longer - 1 - i, back.rank[q[some]]))
                also = d - c > own
                some, c, d = some[also], c[also], d[also]
                k, value = tree.report(a[some], b[some], c, d)
                x, y = q[some[k]], by_back[value]
                keep = x != y
                if longer and i:
                    keep &= rows[y, i] != rows[y, i - 1]
                found.append((x[keep], y[keep]))
                if longer:
                    found.append((y[keep], x[keep]))
    x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return x, y


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, near_n, near) of each block: how many near words it shows, and the most frequent, least one of them."""
    names = ["word", "n_near", "near_n", "near"]

    def solved(block: list[tuple], n: int) -> pa.RecordBatch:
        # a word may come twice if two groups share a key's hash
        held = {r["word"]: r["n"] for r in block}
        words, counts = list(held), np.array(list(held.values()), dtype=np.int64)
        x, y = near_pairs([w.encode("latin-1") for w in words], *(block[0][k] for k in ("length", "lo", "hi")))
        rank = np.empty(len(words), dtype=np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[y], -counts[y], x))
        x, y = x[order], y[order]
        some, at, n_near = np.unique(x, return_index=True, return_counts=True)
        text = pa.array(words, pa.string())
        return pa.record_batch([text.take(pa.array(some)), pa.array(n_near), pa.array(counts[y[at]]), text.take(pa.array(y[at]))], names)

    block: list[dict] = []
    letters = 0
    for b in batches:
        for row in b.to_pylist():
            kind = [row[k] for k in ("length", "lo", "hi")]
            if block and (kind != [block[-1][k] for k in ("length", "lo", "hi")] or letters > BLOCK_LETTERS and row["key"] != block[-1]["key"]):
                yield solved(block, letters)
                block, letters = [], 0
            block.append(row)
            letters += row["length"] + 1
    if block:
        yield solved(block, letters)


def _keyed(entries: DataFrame) -> DataFrame:
    """entries(word, n, length, lo, hi) with a hash of what the words of a group share: their letters before lo and after hi."""
    after = F.greatest(F.col("length") - F.col("hi"), F.lit(0))
    shared = F.substr("word", F.lit(1), F.col("lo")), F.substr("word", F.length("word") - after + 1, after)
    return entries.withColumn("key", F.xxhash64("length", "lo", "hi", *shared))


def blocks(words: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """words(word, n) dealt into groups (length, lo, hi, key): each pair of near words meets in one group, that of the first position of their edit."""
    size = F.length("word")
    entries = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).withColumn("lo", F.lit(0)).withColumn("hi", F.col("length") + 1)
    done = []
    while True:
        entries = _keyed(entries).checkpoint()
        large = entries.groupBy("key").agg(F.sum(F.col("length") + 1).alias("letters"), F.count("*").alias("words"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        large = large.where((F.col("letters") > block_letters) & (F.col("words") > FEW_WORDS) & (F.col("width") > 1)).select("key").checkpoint()
        n = large.count()
        if not n:
            break
        large = F.broadcast(large) if n <= BROADCAST_GROUPS else large
        done.append(entries.join(large, "key", "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi"))))
        entries = entries.join(large, "key", "left_semi").select("word", "n", "length", halves.alias("part")).select("word", "n", "length", "part.*")
    for d in done:
        entries = entries.unionByName(d)
    return entries


def near_words(words: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, near_n, near) of words(word, n), distinct words of letters up to U+00FF, that have near words: their number, and the most frequent one, of equals the least."""
    dealt = blocks(words, block_letters)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(dealt.agg(F.sum(F.col("length") + 1)).first()[0] or 0) // block_letters))
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("length", "lo", "hi", "key")
    near = dealt.mapInArrow(lean(_near), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): where a word's forms end.

    Words are more frequent at each step, at least TIMES as much, so chains are as short as the logarithm of the
    largest count; each round follows twice as many steps as the one before.
    """
    to = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")).checkpoint()
        if not to.where("moved").limit(1).count():
            return to.drop("moved")
        to = to.drop("moved")


def variants(docs: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of docs(doc_id, text), grouped under their most frequent spellings.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z read as a-z; where 97 divides the checksum of id and run, the run
    lacks a letter.  Words have 5 letters and 3 occurrences at least.  Near words differ by one inserted, deleted or replaced letter.
    A word's form is its most frequent near word (of equals the least) if that occurs at least twice as often, else null; its root is
    where forms lead, itself if it has none.
    Null and empty texts have no words; a null id counts as an empty one in checksums; repeated rows count each; other columns are ignored; an empty
    table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    words = word_counts(docs).checkpoint()
    form = F.when(F.col("near_n") >= TIMES * F.col("n"), F.col("near"))
    joined = words.join(near_words(words, block_letters), "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("near_n")).alias("form_n")).checkpoint()
    root = roots(joined.where("form is not null").select("word", "form"))
    return joined.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
