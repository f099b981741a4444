"""Ranked lexical search over an impact-tiered index that is dealt by documents.

A shard holds the postings of a block of documents.  A posting's contribution to a score, weight times
impact, puts it into one of len(TIERS) + 1 tiers, which are columns of the shard's row, so a round that needs high
contributions reads those columns alone.  For each tier, a term's residual bound is its greatest contribution
in lower tiers; a document's score lies between what its postings read so far add up to, and that
plus the residual bounds of the item's terms not yet met in it.

After each tier an item is proven if no document outside a short list of candidates can reach the k-th best lower bound,
be it unseen (all residual bounds together) or seen.  Proven items read lower tiers for their candidates
only, which makes the candidates' scores exact.  Items without the proof fall through to the next tier, and at last to all
tiers, where bounds and scores are equal.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textnum import ALNUM, ensure_checkpoint_dir, lean, small_batches, steps, word_hashes, words

#: Lower ends of the tiers but the last, as parts of the mean over all terms of a term's greatest contribution.
TIERS = (1 / 4, 1 / 8, 1 / 16)
#: Candidates per wanted result up to which an item counts as proven; beyond, reading on is cheaper than looking each one up.
CANDIDATES = 4
#: A shard ends when it holds so many documents, or so many postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1_000_000
#: Characters of items in one pass; its terms go to every task.  A larger table of items takes several passes.
CHARS_PER_PASS = 32_000_000
#: Candidates, at some 20 bytes each, up to which they are broadcast to the shards; beyond, both are exchanged.
BROADCAST_CANDIDATES = 500_000
_BITMAP = 22
_U = np.uint64
_EMPTY = np.zeros(0, np.int64)


class Terms:
    """The distinct terms of a pass of items: their hashes, ascending, and each item's terms as places among them."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, own = ids, []
        for _, _, data, offs in steps(pa.array(texts, pa.large_string())):
            starts, ends, at = words(data, offs, ALNUM)
            own += [np.unique(x) for x in np.split(word_hashes(data, starts, ends), at[1:-1])]
        self.known = np.unique(np.concatenate([*own, np.zeros(0, _U)]))
        self.bitmap = np.zeros(1 << _BITMAP, dtype=bool)
        self.bitmap[(self.known >> _U(64 - _BITMAP)).astype(np.int64)] = True
        self.of = [np.searchsorted(self.known, x) for x in own]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are terms, the terms)."""
        where = np.flatnonzero(self.bitmap[(h >> _U(64 - _BITMAP)).astype(np.int64)])
        if not len(where):
            return where, where
        near = np.minimum(np.searchsorted(self.known, h[where]), len(self.known) - 1)
        same = self.known[near] == h[where]
        return where[same], near[same]


def passes(items: DataFrame) -> Iterator[Terms]:
    """The items in parts of about CHARS_PER_PASS characters; items without text have no terms and so no results."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = -(-(rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // CHARS_PER_PASS)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Terms([r["item_id"] for r in part], [r["text"] for r in part])


def _binary(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in columns]


_POSTINGS = "shard string, ids binary, known binary, n binary, counts binary, doc binary, tf binary"


def _postings_of(shared, source: str):
    """Rows of _POSTINGS: documents' ids and whether they have one, their sizes, postings a term, and each posting's document and frequency, by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        terms: Terms = shared.value
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        docs = postings = 0

        def shard() -> pa.RecordBatch:
            nonlocal held, docs, postings, made
            ids, known, n, doc, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(term, kind="stable")
            counts = np.bincount(term, minlength=len(terms.known)).astype(np.int32)
            kept = _binary(ids, known, n, counts, doc[order].astype(np.uint16), tf[order].astype(np.int32))
            held, docs, postings, made = [], 0, 0, made + 1
            return pa.record_batch([pa.array([f"{source}-{task}-{made}"]), *kept], ["shard", "ids", "known", "n", "counts", "doc", "tf"])

        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, data, offs in steps(b.column("text")):
                starts, ends, at = words(data, offs, ALNUM)
                where, term = terms.find(word_hashes(data, starts, ends))
                row = np.searchsorted(at, where, "right") - 1
                key, tf = np.unique(row * max(1, len(terms.known)) + term, return_counts=True)
                row, term = np.divmod(key, max(1, len(terms.known)))
                for first in range(0, hi - lo, SHARD_DOCS):
                    last = min(hi - lo, first + SHARD_DOCS)
                    if docs and (docs + last - first > SHARD_DOCS or postings > SHARD_POSTINGS):
                        yield shard()
                    own = slice(*np.searchsorted(row, [first, last]))
                    part = ids.slice(lo + first, last - first)
                    held.append((part.fill_null(0).to_numpy(), part.is_valid().to_numpy(zero_copy_only=False), np.diff(at[first : last + 1]), row[own] - first + docs, term[own], tf[own]))
                    docs, postings = docs + last - first, postings + own.stop - own.start
        if held:
            yield shard()

    return run


def _ints(cell, kind=np.int64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=kind)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task, and in the terms -1 and -2 its documents with terms and their sizes added up."""
    total, docs, size = None, 0, 0
    for b in batches:
        for n, counts in zip(b.column("n"), b.column("counts"), strict=True):
            own = _ints(counts, np.int32).astype(np.int64)
            total = own if total is None else total + own
            docs, size = docs + int(np.count_nonzero(_ints(n))), size + int(_ints(n).sum())
    if total is not None:
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([total[held], [docs, size]]))], ["term", "df"])


class Stats:
    """What all documents decide: weights of the terms, and what a document's size takes from its impacts."""

    def __init__(self, rows, n_terms: int):
        found = {r["term"]: r["df"] for r in rows}
        self.n, self.size = found.pop(-1, 0), found.pop(-2, 0)
        self.weight = np.zeros(n_terms, dtype=np.int64)
        for term, df in found.items():
            self.weight[term] = math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))

    def contributions(self, n: np.ndarray, counts: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """weight * impact of the postings of documents of sizes n."""
        if not len(doc):
            return _EMPTY
        if 50 * int(n.max()) * self.n < 2**63:
            part = 50 * n * self.n // self.size
        else:
            part = np.array([50 * x * self.n // self.size for x in n.tolist()], dtype=np.int64)
        tf = tf.astype(np.int64)
        return np.repeat(self.weight, counts) * (1_000_000_000 * tf // (1000 * tf + 20 * (100 - 50 + part[doc])))


def _greatest_of(stats):
    """(term, greatest contribution) of a task."""

    def run(batches):
        best = np.zeros(len(stats.value.weight), dtype=np.int64)
        for b in batches:
            for n, counts, doc, tf in zip(*(b.column(x) for x in ("n", "counts", "doc", "tf")), strict=True):
                counts = _ints(counts, np.int32)
                c = stats.value.contributions(_ints(n), counts, _ints(doc, np.uint16), _ints(tf, np.int32))
                np.maximum.at(best, np.repeat(np.arange(len(counts)), counts), c)
        held = np.flatnonzero(best)
        yield pa.record_batch([pa.array(held), pa.array(best[held])], ["term", "best"])

    return run


def _tiered_of(stats, lower_ends: list[int]):
    """A shard's ids and its postings by tier: counts a term, documents, contributions."""
    names = ["shard", "ids", "known", *(f"{x}{t}" for t in range(len(lower_ends)) for x in ("counts", "doc", "c"))]

    def run(batches):
        for b in batches:
            for shard, ids, known, n, counts, doc, tf in zip(*b.columns, strict=True):
                counts, doc = _ints(counts, np.int32), _ints(doc, np.uint16)
                c = stats.value.contributions(_ints(n), counts, doc, _ints(tf, np.int32))
                term = np.repeat(np.arange(len(counts)), counts)
                out, above = [pa.array([shard.as_py()]), *_binary(_ints(ids), _ints(known, bool))], np.iinfo(np.int64).max
                for end in lower_ends:
                    own = (c >= end) & (c < above)
                    out += _binary(np.bincount(term[own], minlength=len(counts)).astype(np.int32), doc[own], c[own])
                    above = end
                yield pa.record_batch(out, names)

    return names, run


def _residual_of(tiers: int):
    """(tier, term, greatest contribution in lower tiers) of a task."""

    def run(batches):
        best = None
        for b in batches:
            for r in range(b.num_rows):
                for t in range(1, tiers):
                    counts = _ints(b.column(f"counts{t}")[r], np.int32)
                    best = np.zeros((tiers, len(counts)), dtype=np.int64) if best is None else best
                    np.maximum.at(best[t - 1], np.repeat(np.arange(len(counts)), counts), _ints(b.column(f"c{t}")[r]))
        if best is not None:
            tier, term = np.nonzero(np.maximum.accumulate(best[::-1])[::-1])
            best = np.maximum.accumulate(best[::-1])[::-1]
            yield pa.record_batch([pa.array(tier), pa.array(term), pa.array(best[tier, term])], ["tier", "term", "best"])

    return run


class Shard:
    """The tiers 0 to `tier` of a row of the index."""

    def __init__(self, b: pa.RecordBatch, r: int, tier: int):
        self.name = b.column("shard")[r].as_py()
        self.ids, self.known = _ints(b.column("ids")[r]), _ints(b.column("known")[r], bool)
        self.tiers = []
        for t in range(tier + 1):
            at = np.concatenate([[0], np.cumsum(_ints(b.column(f"counts{t}")[r], np.int32), dtype=np.int64)])
            self.tiers.append((at, _ints(b.column(f"doc{t}")[r], np.uint16), _ints(b.column(f"c{t}")[r])))

    def sums(self, terms: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of all documents' scores; both fit a double exactly up to some 100 000 terms, beyond which integers are added."""
        docs, cs, bounds = [_EMPTY], [_EMPTY], [_EMPTY]
        for at, doc, c in self.tiers:
            lo, n = at[terms], at[terms + 1] - at[terms]
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            docs.append(doc[where])
            cs.append(c[where])
            bounds.append(np.repeat(residual[terms], n))
        doc, c, bound = np.concatenate(docs).astype(np.int64), np.concatenate(cs), np.concatenate(bounds)
        rest = int(residual[terms].sum())
        if len(terms) < 100_000:
            lower = np.bincount(doc, c, len(self.ids)).astype(np.int64)
            return lower, lower + rest - np.bincount(doc, bound, len(self.ids)).astype(np.int64)
        lower, met = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        np.add.at(lower, doc, c)
        np.add.at(met, doc, bound)
        return lower, lower + rest - met

    def best(self, lower: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
        """The k documents of highest lower bound, then of smallest id, ids that are null last."""
        if len(among) > k:
            among = among[lower[among] >= np.partition(lower[among], len(among) - k)[len(among) - k]]
        return among[np.lexsort((self.ids[among], ~self.known[among], -lower[among]))[:k]]


def _bounds_of(shared, residual, theta: np.ndarray, active: np.ndarray, tier: int, k: int):
    """(item, lower, upper, shard, doc) of a shard's k best documents of each item that may reach theta; doc -1 stands for all others."""

    def run(batches):
        terms: Terms = shared.value
        r = residual.value[tier]
        for b in batches:
            for row in range(b.num_rows):
                s = Shard(b, row, tier)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i in active.tolist():
                    lower, upper = s.sums(terms.of[i], r)
                    may = np.flatnonzero((lower > 0) & (upper >= theta[i]))
                    if not len(may):
                        continue
                    top = s.best(lower, may, k)
                    rest = np.setdiff1d(may, top, assume_unique=True)
                    more = [[], [], []] if not len(rest) else [[-1], [upper[rest].max()], [-1]]
                    for to, x in zip(out, (np.full(len(top) + len(more[0]), i), np.concatenate([lower[top], more[0]]), np.concatenate([upper[top], more[1]]), np.concatenate([top, more[2]])), strict=True):
                        to.append(x.astype(np.int64))
                if out[0]:
                    item, lower, upper, doc = (pa.array(np.concatenate(x)) for x in out)
                    yield pa.record_batch([item, lower, upper, pa.array([s.name] * len(item)), doc], ["item", "lower", "upper", "shard", "doc"])

    return run


def _scores_of(shared, theta: np.ndarray, open_: np.ndarray, last: int, k: int):
    """(item, doc_id, score): a shard's k best documents of each open item, and all candidates of the others, by all tiers."""

    def run(batches):
        terms: Terms = shared.value
        none = np.zeros(len(terms.known), dtype=np.int64)
        for b in batches:
            for row in range(b.num_rows):
                s = Shard(b, row, last)
                listed = b.column("listed")[row].as_py() or []
                wanted: dict[int, list[int]] = {}
                for x in listed:
                    wanted.setdefault(x["item"], []).append(x["doc"])
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i in [*open_.tolist(), *wanted]:
                    score, _ = s.sums(terms.of[i], none)
                    among = np.array(wanted[i]) if i in wanted else np.flatnonzero((score > 0) & (score >= theta[i]))
                    top = s.best(score, among, k)
                    for to, x in zip(out, (np.full(len(top), i), s.ids[top], ~s.known[top], score[top]), strict=True):
                        to.append(x)
                if out[0]:
                    item, ids, unknown, score = (np.concatenate(x) for x in out)
                    yield pa.record_batch([pa.array(item), pa.array(ids, mask=unknown), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"


def index(docs: DataFrame, terms, n_terms: int, tiers: tuple[float, ...] = TIERS) -> tuple[DataFrame, np.ndarray]:
    """(a row a shard, residual bounds by tier and term) of docs(doc_id, text) for the broadcast terms, written to the shared folder."""
    spark = docs.sparkSession
    folder = _folder(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs.mapInArrow(lean(_postings_of(terms, "s")), _POSTINGS).write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    sums = postings.select("n", "counts").mapInArrow(lean(_frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    stats = spark.sparkContext.broadcast(Stats(sums.collect(), n_terms))  # two numbers a term, as the terms themselves
    most = postings.mapInArrow(lean(_greatest_of(stats)), "term long, best long").groupBy("term").agg(F.max("best").alias("best")).agg(F.avg("best")).first()[0] or 0
    names, run = _tiered_of(stats, [*(max(1, math.ceil(most * x)) for x in tiers), 0])
    postings.mapInArrow(lean(run), ", ".join(f"{x} {'string' if x == 'shard' else 'binary'}" for x in names)).write.parquet(f"{folder}/tiers")
    made = spark.read.parquet(f"{folder}/tiers")
    residual = np.zeros((len(tiers) + 1, n_terms), dtype=np.int64)
    lower = made.select(*(f"{x}{t}" for t in range(1, len(tiers) + 1) for x in ("counts", "c"))).mapInArrow(lean(_residual_of(len(tiers) + 1)), "tier long, term long, best long")
    for r in lower.groupBy("tier", "term").agg(F.max("best").alias("best")).collect():
        residual[r["tier"], r["term"]] = r["best"]
    return made, residual


def _search(docs: DataFrame, terms: Terms, k: int, tiers: tuple[float, ...], candidates: int) -> tuple[DataFrame, list[int]]:
    """(item_id, rank, doc_id, score) of a pass, and how many items each tier proved."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)
    rows, residual = index(docs, shared, len(terms.known), tiers)
    bounds = spark.sparkContext.broadcast(residual)
    theta, open_ = np.zeros(len(terms.ids), dtype=np.int64), np.array([i for i, x in enumerate(terms.of) if len(x)], dtype=np.int64)
    listed, proved = spark.createDataFrame([], "shard string, item long, doc long"), []
    for t in range(len(tiers)):
        if not len(open_):
            break
        columns = ["shard", "ids", "known", *(f"{x}{u}" for u in range(t + 1) for x in ("counts", "doc", "c"))]
        found = rows.select(*columns).mapInArrow(lean(_bounds_of(shared, bounds, theta, open_, t, k)), "item long, lower long, upper long, shard string, doc long").checkpoint()
        turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))
        kth = found.where("doc >= 0").select("item", "lower", turn.alias("turn")).where(F.col("turn") <= k).groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("theta"))
        near = found.join(kth, "item").groupBy("item").agg(F.max("theta").alias("theta"), F.count_if(F.expr("doc >= 0 and upper >= theta")).alias("n"), F.max(F.when(F.col("doc") < 0, F.col("upper"))).alias("rest"))
        done = []
        for r in near.collect():  # a row an item of the pass
            i = r["item"]
            theta[i] = max(theta[i], r["theta"])
            unseen = int(residual[t][terms.of[i]].sum())
            if r["theta"] > max(unseen, r["rest"] or 0) and r["n"] <= candidates * k:
                done.append(i)
        proved.append(len(done))
        if done:
            ends = spark.createDataFrame([(i, int(theta[i])) for i in done], "item long, theta long")
            listed = listed.unionByName(found.join(F.broadcast(ends), "item").where("doc >= 0 and upper >= theta").select("shard", "item", "doc"))
            open_ = np.setdiff1d(open_, done)
    listed = listed.checkpoint()
    by_shard = listed.groupBy("shard").agg(F.collect_list(F.struct("item", "doc")).alias("listed"))  # at most k an item
    if listed.count() <= BROADCAST_CANDIDATES:
        by_shard = F.broadcast(by_shard)
    scored = rows.join(by_shard, "shard", "left" if len(open_) else "inner").mapInArrow(lean(_scores_of(shared, theta, open_, len(tiers), k)), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(terms.ids)], "item long, item_id long")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(ids), "item")  # an id an item of the pass
    return ranked.select("item_id", "rank", "doc_id", "score"), proved


def search(docs: DataFrame, items: DataFrame, k: int = 50, tiers: tuple[float, ...] = TIERS, candidates: int = CANDIDATES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of docs(doc_id, text) for each row of items(item_id, text).

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z read as a-z; they are compared by 64-bit hashes.
    With N documents that have terms, L terms in them, and a term in df of them, a term weighs floor(1000 ln((2N + 2) / (2 df + 1)));
    in a document of n terms, tf of them this one, its impact is 10^9 tf div (1000 tf + 20 m) with m = 50 + (50 n N) div L.
    A score is the sum of weight times impact over an item's distinct terms; rows of score 0 are no results.
    Ties go to the smaller doc_id, null ids last.  Repeated rows of docs are documents of their own; repeated rows of
    items are items of their own, so their item_id comes with each rank twice.  Null and empty texts on either side give
    nothing, as do empty tables; other columns are ignored.
    `tiers` and `candidates` decide how much is read, never the result.
    """
    small_batches(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for terms in passes(items):
        out = out.unionByName(_search(docs, terms, k, tiers, candidates)[0])
    return out
