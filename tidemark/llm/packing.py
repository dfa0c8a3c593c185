"""Best-fit packing with bounded space.

Documents become sequences of at most ``size`` tokens. Only a longer document is cut, into whole pieces of
``size`` and a rest. Each partition keeps ``open_bins`` open sequences at most, in a bit set over their
free space, so that the best fit of a piece is one shift and the lowest set bit. A piece without a fit
opens a sequence; where too many are open, the fullest closes. The packer looks ahead by one batch: its
pieces go in by falling length, ties in input order, which fits better and holds no more than the batch.

Sequences that are still open at the end of their partition are merged: they go through best-fit once more
as whole blocks, those of ``MERGED`` partitions at a time, and what stays open there goes up to the next
round, until one group is left. Only these sequences' lengths travel, 1024 rows a partition at most, and
only their pieces are read again.

Defined results: a null or empty text is the end id alone; rows that share a doc_id are packed each for
itself; a null doc_id stays null; pieces of one length have their places in input order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts_of, vocabulary, written
from .tokens import encoder, with_end

SIZE, OPEN_BINS = 4096, 1024
#: Partitions whose open sequences are merged by one task.
MERGED = 64
#: Place of the partition's number in that of a sequence, and numbers of merged sequences.
PART_BITS, ROUND_BITS = 32, 56


class BestFit:
    """Online best-fit; ``place(n)`` gives (sequence, offset). ``closed`` collects the sequences that
    became full or had to close since it was last emptied."""

    def __init__(self, size: int = SIZE, open_bins: int = OPEN_BINS):
        self.size, self.limit = size, open_bins
        self.bits, self.stacks, self.open, self.made = 0, [[] for _ in range(size + 1)], 0, 0
        self.closed: list[int] = []

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.size:
            raise ValueError(f"a piece has 1 to {self.size} tokens, not {n}")
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            bin_, free = self.made, self.size
            self.made += 1
        if left := free - n:
            if self.open == self.limit:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            self.stacks[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(bin_)
        return bin_, self.size - free

    def _take(self, free: int) -> int:
        out = self.stacks[free].pop()
        self.open -= 1
        if not self.stacks[free]:
            self.bits &= ~(1 << free)
        return out


def _pieces(docs: DataFrame, path: str, size: int, open_bins: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """The pieces as each partition packs them; ``left`` marks those of sequences it left open. The pieces
    of an open sequence are held until it closes, which bounds them by ``open_bins`` sequences."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, left boolean" + ", ids array<int>" * with_ids
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_(), *[pa.list_(pa.int32())] * with_ids]
    names = [x.split()[0] for x in ddl.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << PART_BITS
        enc, bins = encoder(path), BestFit(size, open_bins)
        held: dict[int, list[tuple]] = {}
        for b in slices(batches, "text"):
            ids, sizes = with_end(*enc.encode(b.column("text")), end_id)
            raw, ends = ids.view("<i4"), np.cumsum(sizes)
            pieces = []
            for doc_id, end, n in zip(b.column("doc_id").to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                pieces += [(min(size, n - at), doc_id, k, end - n + at) for k, at in enumerate(range(0, n, size))]
            for n, doc_id, k, at in sorted(pieces, key=lambda x: -x[0]):
                bin_, offset = bins.place(n)
                own = raw[at : at + n]
                held.setdefault(bin_, []).append((doc_id, k, k * size, n, zlib.crc32(own), first + bin_, offset, False, *[own.copy()] * with_ids))
            rows = [r for c in bins.closed for r in held.pop(c)]
            bins.closed.clear()
            if rows:
                yield batch(rows)
        rows = [(*r[:7], True, *r[8:]) for own in held.values() for r in own]
        for i in range(0, len(rows), 2000):
            yield batch(rows[i : i + 2000])
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks, and its memory counts meanwhile

    return texts_of(docs, id_col, text_col).mapInArrow(run, ddl)


def _merged(bins: DataFrame, size: int, open_bins: int, part: int) -> DataFrame:
    """(sequence_id, merged, base, used, part, left) of the open sequences (sequence_id, part, used): each
    group of ``MERGED`` parts packs its own, the longest first; ``left`` marks what stays open."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["used", "sequence_id"], ascending=[False, True])
        fit = BestFit(size, open_bins)
        places = [fit.place(n) for n in own["used"].tolist()]
        still = {b for s in fit.stacks for b in s}
        names = (part << ROUND_BITS) + (int(key[0]) << PART_BITS)
        return pd.DataFrame({"sequence_id": own["sequence_id"], "merged": [names + b for b, _ in places], "base": [o for _, o in places], "used": own["used"], "part": key[0], "left": [b in still for b, _ in places]})

    grouped = bins.withColumn("part", F.expr(f"part div {MERGED}")).groupBy("part")
    return grouped.applyInPandas(run, "sequence_id long, merged long, base long, used long, part long, left boolean")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, open_bins: int = OPEN_BINS, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, the ids of each piece."""
    path = path or vocabulary("word_bpe_49k.json")
    bounded_batches(docs.sparkSession)
    done = written(_pieces(docs, path, size, open_bins, end_id, with_ids, id_col, text_col), "packed")
    open_ = done.where("left")
    now = open_.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("part", F.expr(f"shiftright(sequence_id, {PART_BITS})"))
    parts = (now.agg(F.max("part")).collect()[0][0] or 0) + 1
    found, round_ = None, 0
    while True:
        round_ += 1
        new = written(_merged(now.select("sequence_id", "part", "used"), size, open_bins, round_), "merged-bins")
        step = new.select(F.col("sequence_id").alias("merged"), F.col("merged").alias("next"), F.col("base").alias("more"))
        if found is None:
            found = new.select("sequence_id", "merged", "base")
        else:
            found = found.join(step, "merged", "left").select("sequence_id", F.coalesce("next", "merged").alias("merged"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        parts = -(-parts // MERGED)
        if parts == 1:
            break
        now = new.where("left").groupBy(F.col("merged").alias("sequence_id"), "part").agg(F.sum("used").alias("used"))
    joined = open_.join(found, "sequence_id").withColumn("sequence_id", F.col("merged")).withColumn("offset", F.col("offset") + F.col("base"))
    columns = [c for c in done.columns if c != "left"]
    return done.where("not left").select(*columns).unionByName(joined.select(*columns))
