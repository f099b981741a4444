"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan depends only on how many pieces have each length, so it has at most a few
thousand rows whatever the corpus; documents never meet in one task.  A piece takes
its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textnum import ensure_checkpoint_dir, lean, small_batches

#: Characters of a run of white space, or between white space, from which a text goes to the library of the JSON file.
LONG_RUN = 1000
#: Partitions times lengths up to which the ranks' bases are broadcast: at most so many rows of 24 bytes.
BROADCAST_BASES = 200_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)
_ENCODERS: dict[tuple[str, str], tuple] = {}


def encoder(ranks_path: str, json_path: str, pattern: str):
    """text -> ids of the byte-level vocabulary, without added special tokens.

    The rank file holds the same vocabulary as the JSON file and is read by the
    faster library, with equal ids.  Two kinds of texts go to the library of the JSON file:
    those that spell a special token, which it reads as that token, and those with a run
    of LONG_RUN characters that are all white space or all not, on which the faster
    library overflows its stack or takes time with the square of the run.
    """
    key = (ranks_path, json_path)
    if key not in _ENCODERS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, [])
    plain, slow = _ENCODERS[key]

    def encode(text: str) -> list[int]:
        if "<|endoftext|>" in text or len(text) >= LONG_RUN and (_LONG_SPACE.search(text) or max(map(len, text.split()), default=0) >= LONG_RUN):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


def vocabulary(folder: str | None = None) -> tuple[str, str, str]:
    """(rank file, JSON file, split pattern) of the 50k byte-level vocabulary, in `folder` or where its package lies."""
    import public_tokenizers

    at = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    return at("byte_bpe_50k.tiktoken"), at("byte_bpe_50k.json"), public_tokenizers.PATTERN


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than `most`."""
    first = n % most or most
    return [(0, min(first, n)), *((s, most) for s in range(first, n, most))]


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest lengths first.

    Rows (length, from_rank, to_rank, first_sequence, per_sequence, offset): the piece of
    rank r of that length lies in sequence first_sequence + (r - from_rank) // per_sequence
    at offset + (r - from_rank) % per_sequence * length.
    """
    rows = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> runs (first sequence, count)
    made = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = next((s for s in range(length, most) if open_.get(s)), None)
            if space is None:
                each = most // length
                full, rest = divmod(left, each)
                for n, per in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        rows.append((length, rank, rank + n * per, made, per, 0))
                        if most - per * length:
                            open_[most - per * length].append((made, n))
                        made, rank = made + n, rank + n * per
                break
            first, n = open_[space].pop()
            each = space // length
            full, rest = divmod(left, each)
            take = min(n, full)
            if take:
                rows.append((length, rank, rank + take * each, first, each, most - space))
                if space - each * length:
                    open_[space - each * length].append((first, take))
                rank, left = rank + take * each, left - take * each
            if take < n:
                if left:  # fewer than fill the next sequence
                    rows.append((length, rank, rank + rest, first + take, rest, most - space))
                    open_[space - rest * length].append((first + take, 1))
                    rank, left, take = rank + rest, 0, take + 1
                if take < n:
                    open_[space].append((first + take, n - take))
    return rows


def _pieces_of(paths: tuple[str, str, str], most: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                raw = memoryview(ids.tobytes())
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    own = raw[4 * start : 4 * (start + length)]
                    for to, value in zip(out, (doc_id, piece, start, length, zlib.crc32(own), own.tobytes() if with_ids else None), strict=False):
                        to.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names)

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the pieces of each length within this partition; one counter a length is kept."""
    seen: dict[int, int] = defaultdict(int)
    for b in batches:
        local = []
        for n in b.column("length").to_pylist():
            local.append(seen[n])
            seen[n] += 1
        yield b.append_column("local", pa.array(local, pa.int64()))


def pack(docs: DataFrame, ranks_path: str, json_path: str, pattern: str, most: int = 1024, end_id: int = 2, with_ids: bool = False, broadcast_bases: int = BROADCAST_BASES) -> DataFrame:
    """One row for each piece of docs(doc_id, text): where it lies in the packed sequences.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds
    the piece's ids as little-endian 32-bit numbers.  A null text is empty and gives one
    piece that holds the end id.  Null and repeated doc_ids are rows like others; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ensure_checkpoint_dir(spark)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    run = _pieces_of((ranks_path, json_path, pattern), most, end_id, with_ids)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), kind).checkpoint()
    # the checkpoint fixes rows and partitions, so that ranks are the same in every retry
    part = F.spark_partition_id().alias("part")
    counts = pieces.groupBy(part, "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("part", "length", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    kind_of_plan = "length long, lo long, hi long, first long, per long, base long"
    slots = spark.createDataFrame(plan(histogram, most), kind_of_plan)
    ranked = pieces.select("*", part).mapInArrow(lean(_ranked), kind + ", part int, local long")
    ranked = ranked.join(F.broadcast(before) if pieces.rdd.getNumPartitions() * most <= broadcast_bases else before, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before")
    at = F.col("rank") - F.col("lo")
    joined = ranked.join(F.broadcast(slots), "length").where("rank >= lo and rank < hi")  # the plan's size depends on `most` alone
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(at / F.col("per")).cast("long")).alias("sequence_id"),
        (F.col("base") + F.pmod(at, F.col("per")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
