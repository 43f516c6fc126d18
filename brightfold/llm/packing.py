"""Best-fit packing (best-two-fit) of tokenised documents into sequences of bounded length.

Only lengths decide a packing and a length is at most the capacity, so the packer works on the histogram of lengths:
at most `capacity` rows reach the driver, at any corpus size. A bin is filled greedily with the longest pieces that fit; then
its smallest piece is replaced by the two unpacked pieces that fit the widened gap most tightly, if they fill more. The
same bin is repeated while its pieces last, so the plan stays a few thousand bin patterns whatever the number of documents.
Pieces get a rank among those of their length (a local rank from the tokenising task plus an offset) and are dealt to the
patterns' slots by it: no sort, no window over all pieces and no hot key.

Defined results: null or empty text is the end id alone; equal rows are packed as separate documents; an empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, texts, trim, unstage, with_ids
from .wordbpe import WordBpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenised_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, added: bool = False) -> DataFrame:
    """A row for each piece of at most `capacity` ids, with the task that made it and its rank there among equal lengths."""
    end = np.uint32(end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, part, seen = WordBpe(path, added=added), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"], bpe.texts(batch["text"].tolist())):
                data = np.append(data, end)
                for piece, at in enumerate(range(0, len(data), capacity)):
                    block = data[at : at + capacity]
                    n = len(block)
                    rows.append((doc_id, piece, at, n, zlib.crc32(block.tobytes()), part, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])
        del bpe
        trim()

    return with_ids(texts(docs).mapInPandas(run, PIECES.replace("doc_id long", "doc_id string")))


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns for counts[length] pieces: (lengths in the bin, how many such bins)."""
    left, out = counts.astype(np.int64).copy(), []
    left[0] = 0
    below = np.arange(capacity + 1)  # below[x]: the longest length up to x that may be left; paths are shortened as used

    def longest(x: int) -> int:
        root = x
        while root and not left[root]:
            root = below[root] if below[root] != root else root - 1
        while x > root:
            below[x], x = root, below[x] if below[x] != x else x - 1
        return root

    while top := longest(capacity):
        items: list[int] = []
        gap, at = capacity, top
        while at:
            k = min(gap // at, int(left[at]))
            items += [at] * k
            gap -= k * at
            at = longest(min(gap, at - 1))
        if gap and len(items) > 1:
            free = left.copy()
            used, times = np.unique(items, return_counts=True)
            free[used] -= times
            smallest, room = items[-1], gap + items[-1]
            have = np.flatnonzero(free[: room + 1])
            if len(have):
                upto = np.zeros(room + 1, np.int64)
                upto[have] = have
                upto = np.maximum.accumulate(upto)
                partner = upto[np.minimum(room - have, have)]
                partner = np.where((partner == have) & (free[have] < 2), upto[np.maximum(partner - 1, 0)], partner)
                total = np.where(partner > 0, have + partner, 0)
                if total[best := int(total.argmax())] > smallest:
                    items[-1:] = [int(have[best]), int(partner[best])]
        used, times = np.unique(items, return_counts=True)
        bins = int((left[used] // times).min())
        left[used] -= bins * times
        out.append((items, bins))
    return out


def slots(patterns: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted by (length, rank): length, first rank, sequence id of that rank and place in the sequence."""
    taken, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for items, bins in patterns:
        offset = 0
        for length in items:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += bins
            offset += length
        sequence += bins
    table = np.asarray(rows, np.int64).reshape(-1, 4)
    return tuple(table[np.lexsort((table[:, 1], table[:, 0]))].T)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, added: bool = False) -> DataFrame:
    """Pack every document's ids (tokenizer file at `path`, then `end_id`) into sequences of at most `capacity` ids."""
    spark = docs.sparkSession
    pieces, pieces_at = stage(tokenised_pieces(docs, path, capacity, end_id, added), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_part, at = stage(by_part, "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    lengths, ranks, sequences, offsets = slots(best_two_fit(counts, capacity), capacity)
    plan = spark.sparkContext.broadcast((lengths, ranks, sequences, offsets))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, ranks, sequences, offsets = plan.value
        stride = int(ranks.max(initial=0)) + 1
        keys = lengths * stride + ranks
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            # a rank beyond the last slot's first rank of its length still belongs to that slot
            i = np.searchsorted(keys, length * stride + np.minimum(rank, stride - 1), "right") - 1
            yield b.drop(columns="rank").assign(sequence_id=sequences[i] + rank - ranks[i], offset=offsets[i])

    result, _ = stage(with_ids(ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, PACKED.replace("doc_id long", "doc_id string"))), "packed")
    unstage(spark, pieces_at, at)
    plan.unpersist()
    return result
