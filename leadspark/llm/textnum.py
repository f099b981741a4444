"""Vectorised text primitives for Arrow string batches.

Everything works on the UTF-8 buffer of an Arrow string column, so no Python
string is made for a row.  Words are maximal runs of bytes of a class; a word's
hash is a position-weighted sum of per-byte random numbers modulo 2**64, which
two prefix sums give for all words of a batch at once.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one numpy step handles; a single longer row makes a step of its own.
STEP_BYTES = 500_000

_M = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _class(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Words are runs of anything but the six ASCII white-space bytes.
NON_SPACE = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
ALNUM = _class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)

_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z

_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; those of a usual step are kept, longer ones, for a single longer word, are not."""
    if not _kept or len(_kept[0]) < n:
        with np.errstate(over="ignore"):
            size = max(n, STEP_BYTES + 2)
            p = np.full(size, _M, dtype=np.uint64)
            q = np.full(size, pow(_M, -1, 2**64), dtype=np.uint64)
            p[0] = q[0] = 1
            made = [np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)]
        if n > STEP_BYTES + 2:
            return made[0], made[1]
        _kept[:] = made
    return _kept[0], _kept[1]


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, last word + 1, bytes, starts, ends) of neighbouring words within about STEP_BYTES, or of one longer word; words come in the order of their places.

    So what is made for each byte of a long text is bounded by a step.
    """
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP_BYTES, "right")))
        base = starts[lo]
        yield lo, hi, data[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(32))


def steps(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) in steps of about `limit` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (limit or STEP_BYTES), "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, words before each row): words never cross rows."""
    m = member[data]
    before = np.empty_like(m)
    if len(m):
        before[0] = False
        before[1:] = m[:-1]
    inner = offs[:-1][offs[:-1] < len(m)]
    before[inner] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    if len(m):
        after[-1] = False
        after[:-1] = m[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, with A-Z read as a-z."""
    out = np.empty(len(starts), dtype=np.uint64)
    for lo, hi, part, a, b in pieces(data, starts, ends):
        p, q = _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(part) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[part] * p[: len(part)], dtype=np.uint64, out=total[1:])
            out[lo:hi] = mix((total[b] - total[a]) * q[a])
    return out


_K = [_U(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word shingles, shingles before each row); a row of 1 to k-1 words has one of all its words."""
    n_rows = len(counts) - 1
    n = np.diff(counts)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_at[-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            total = np.zeros(len(h) - k + 1, dtype=np.uint64)
            for j in range(k):
                total += h[j : len(h) - k + 1 + j] * _K[j % 5] + _U(j * 0x51)
            ok = np.zeros(len(h), dtype=np.int32)
            long = np.flatnonzero(n >= k)
            ok[counts[:-1][long]] += 1
            stop = counts[1:][long] - k + 1
            np.subtract.at(ok, stop[stop < len(h)], 1)
            take = np.cumsum(ok)[: len(total)] > 0
            to = np.ones(len(out), dtype=bool)
            to[out_at[:-1][(n > 0) & (n < k)]] = False
            out[to] = mix(total[take])
        for r in np.flatnonzero((n > 0) & (n < k)):
            whole = _U(n[r])
            for j, x in enumerate(h[counts[r] : counts[r + 1]]):
                whole = whole * _K[0] + x * _K[(j + 1) % 5]
            out[out_at[r]] = mix(np.array([whole ^ _K[4]]))[0]
    assert n_rows == len(out_at) - 1
    return out, out_at


def small_batches(spark, rows: int = 1000) -> None:
    """Bound the rows and bytes of one Arrow batch, as a row may hold a text of any length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ensure_checkpoint_dir(spark) -> None:
    """Use the shared folder that the cluster names; only a local session without one, as in tests, gets one of its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder; a cluster needs a shared one")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def trim() -> None:
    """Give memory that Python has freed back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, trimmed when a task ends: Spark keeps idle workers, and they count against the executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def release() -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner acts on what the driver's garbage collection finds, which may not come for
    hours on a quiet driver, while the files fill the executors' disks.  What the driver's
    own Python has freed goes back to the system too.
    """
    import gc

    from pyspark import SparkContext

    gc.collect()
    trim()
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context._jvm.System.gc()
