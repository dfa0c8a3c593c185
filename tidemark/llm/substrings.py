"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of its ``MMER``-word runs.
Consecutive windows with one minimiser travel together, as one packed string of words, to the
minimiser's bucket; there the windows are sorted and equal ones are found by their words, exactly.

Most text never travels. A first pass finds the minimisers that occur in two documents; a bit table of
fixed size (``FILTER_BITS``) tells the second pass which super-k-mers to pack. A false positive only packs
more, and a table that fills up packs all super-k-mers, some three times the text. Minimisers with more than
``HOT`` different super-k-mers do not make buckets: their windows go each to a bucket of its own words. That
limit doubles until the table of such minimisers is at most a sixteenth full, so that its false positives
never send the whole text window by window. Equal strings are merged before they are shuffled, with the
smallest doc_id, so that a passage in a third of all documents is a few rows of each task.

A word is removed if a window that covers it also starts in a document with a smaller doc_id.

Defined results: null or empty texts have no words; a row without a doc_id neither removes words
elsewhere nor loses any; rows that share a doc_id are judged each for itself, never against each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, slices, texts_of, written

WINDOW, MMER, LONGEST, HOT = 50, 8, 64, 500
FILTER_BITS = 26
TEXT_SLICE = 1 << 20
#: Odd multipliers of the hashes.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverses modulo 2^64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(2 * n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        steps = [np.full(size + 1, x, np.uint64) for x in (base, inverse)]
        for x in steps:
            x[0] = 1
        _powers[base] = tuple(np.cumprod(x, dtype=np.uint64) for x in steps)
    return _powers[base]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end] by prefix sums."""
    up, down = _powers_of(base, len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, by doubling."""
    at, have = g, 1
    while have * 2 <= width:
        at = np.minimum(at[:-have], at[have:])
        have *= 2
    return np.minimum(at[: len(at) - (width - have)], at[width - have :]) if width > have else at


class Windows:
    """The windows of some texts: words of all texts in one buffer, a space apart."""

    def __init__(self, texts: list[str]):
        lists = [t.encode().split() for t in texts]
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        total = int(self.counts.sum())
        self.buffer = b" ".join([w for x in lists for w in x])
        empty = np.zeros(0, np.int64)
        if total < WINDOW:
            self.at = self.doc = self.start = empty
            return
        raw = np.frombuffer(self.buffer, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.begin = np.concatenate([[0], gaps + 1])
        self.end = np.append(gaps, len(raw))
        words = _spans(raw.astype(np.uint64) + np.uint64(1), self.begin, self.end, BYTE_BASE)
        i = np.arange(total - MMER + 1)
        runs = _spans(words, i, i + MMER, WORD_BASE)
        least = _least(runs, WINDOW - MMER + 1)
        fits = np.maximum(self.counts - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), fits)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(fits) - fits, fits)
        self.at = self.first[self.doc] + self.start
        self.minimiser = least[self.at]
        self.words = words

    def own_hash(self, at: np.ndarray) -> np.ndarray:
        return _spans(self.words, at, at + WINDOW, WORD_BASE)

    def runs(self, take: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First window and length of runs that share document and minimiser, of LONGEST windows at
        most; ``take`` picks windows, by index and in order."""
        k = np.arange(len(self.at)) if take is None else take
        if not len(k):
            return k, k
        new = np.append(True, (np.diff(self.at[k]) != 1) | (np.diff(self.doc[k]) != 0) | (self.minimiser[k][1:] != self.minimiser[k][:-1]))
        head = np.flatnonzero(new)
        place = np.arange(len(k)) - np.repeat(head, np.diff(np.append(head, len(k))))
        head = np.flatnonzero(place % LONGEST == 0)
        return k[head], np.diff(np.append(head, len(k)))

    def packed(self, at: int, n: int) -> bytes:
        return self.buffer[self.begin[at] : self.end[at + n + WINDOW - 2]]


def row_key(text: str) -> int:
    """Tells rows apart that share a doc_id."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(text.encode())).view(np.int64))


def minimisers(docs: DataFrame) -> DataFrame:
    """minimiser, first and last doc_id and number of different super-k-mers, over all documents.
    Copies of a super-k-mer are merged before the shuffle, by a hash of its words."""

    def make():
        def step(ids: list, texts: list[str]) -> dict:
            known = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
            w = Windows([t for _, t in known])
            head, size = w.runs()
            if not len(head):
                return {"m": [], "h": [], "doc_id": []}
            at = w.at[head]
            words = _spans(w.words, at, at + size + WINDOW - 1, WORD_BASE)
            return {"m": w.minimiser[head].view(np.int64), "h": words.view(np.int64), "doc_id": np.array([i for i, _ in known], np.int64)[w.doc[head]]}

        return step

    rows = map_texts(docs, make, "m long, h long, doc_id long", limit=TEXT_SLICE)
    strings = rows.groupBy("m", "h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return strings.groupBy("m").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"))


def bit_table(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of 2^bits bits with the low bits of the long column ``key`` set; its size bounds what
    reaches the driver, whatever the number of keys."""
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    cells = keys.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, CAST(key & 63 AS INT))").alias("flag")).groupBy("cell").agg(F.bit_or("flag").alias("flag"))
    got = cells.toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[got.column("cell").to_numpy()] = got.column("flag").to_numpy()
    return out


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(64 * len(table) - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def super_kmers(docs: DataFrame, shared, hot) -> DataFrame:
    """bucket, packed words, doc_id, row key, first word and number of windows, for windows whose
    minimiser may occur in two documents. ``shared`` and ``hot`` are broadcast bit tables."""

    def make():
        def step(ids: list, texts: list[str]) -> dict:
            known = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
            w = Windows([t for _, t in known])
            out: dict = {c: [] for c in ("bucket", "packed", "doc_id", "rid", "start", "n")}
            if not len(w.at):
                return out
            may = in_table(shared.value, w.minimiser)
            often = may & in_table(hot.value, w.minimiser)
            head, size = w.runs(np.flatnonzero(may & ~often))
            alone = np.flatnonzero(often)
            k = np.concatenate([head, alone])
            n = np.concatenate([size, np.ones(len(alone), np.int64)])
            out["bucket"] = np.concatenate([w.minimiser[head], w.own_hash(w.at[alone])]).view(np.int64)
            out["packed"] = [w.packed(a, m) for a, m in zip(w.at[k].tolist(), n.tolist(), strict=True)]
            out["doc_id"] = np.array([i for i, _ in known], np.int64)[w.doc[k]]
            keys = {d: row_key(known[d][1]) for d in np.unique(w.doc[k]).tolist()}
            out["rid"] = [keys[d] for d in w.doc[k].tolist()]
            out["start"], out["n"] = w.start[k], n
            return out

        return step

    return map_texts(docs, make, "bucket long, packed binary, doc_id long, rid long, start long, n long", limit=TEXT_SLICE)


def counted(strings: DataFrame) -> DataFrame:
    """k1, k2 and firsts: for each string, the smallest doc_id of each of its windows, where that is
    smaller than some document with the string. A bucket's windows are sorted in its one task."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("firsts", pa.list_(pa.int64()))])

    def windows(packed: bytes) -> list[bytes]:
        raw = np.frombuffer(packed, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        begin, end = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(raw)]
        return [packed[begin[i] : end[i + WINDOW - 1]] for i in range(len(begin) - WINDOW + 1)]

    def bucket(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) == 1:
            _, packed, first, last, k1, k2 = rows[0]
            if first < last:
                yield k1, k2, [first] * (packed.count(b" ") - WINDOW + 2)
            return
        cut = [windows(r[1]) for r in rows]
        entries = sorted((x, r[2]) for r, ws in zip(rows, cut, strict=True) for x in ws)
        least, before = {}, None
        for x, first in entries:
            if x != before:
                least[x] = first
                before = x
        for r, ws in zip(rows, cut, strict=True):
            firsts = [least[x] for x in ws]
            if min(firsts) < r[3]:
                yield r[4], r[5], firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
            done.clear()
            return out

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "packed", "first", "last", "k1", "k2")), strict=True):
                if held and held[0][0] != row[0]:
                    done.extend(bucket(held))
                    held = []
                held.append(row)
            if len(done) > 2000:
                yield batch()
        if held:
            done.extend(bucket(held))
        if done:
            yield batch()

    return strings.select("bucket", "packed", "first", "last", "k1", "k2").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "k1 long, k2 long, firsts array<long>")


def repeated(docs: DataFrame, hot: int = HOT, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, rid and runs: (first window, windows) that also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    seen = written(minimisers(docs).where("first < last"), "minimisers")
    shared = spark.sparkContext.broadcast(bit_table(seen.select(F.col("m").alias("key")), bits))
    while seen.where(F.col("n") > hot).count() > max(1, 1 << bits >> 4):
        hot *= 2
    often = spark.sparkContext.broadcast(bit_table(seen.where(F.col("n") > hot).select(F.col("m").alias("key")), bits))
    keyed = super_kmers(docs, shared, often).withColumn("k1", F.xxhash64("packed")).withColumn("k2", F.xxhash64(F.lit(7), "packed"))
    rows = written(keyed, "super-kmers")
    strings = rows.groupBy("bucket", "packed", "k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    found = written(counted(strings), "window-firsts")
    hit = rows.select("k1", "k2", "doc_id", "rid", "start", "n").join(found, ["k1", "k2"])
    all_ = F.expr("array_max(firsts) < doc_id")
    each = F.expr("transform(filter(sequence(0, size(firsts) - 1), i -> get(firsts, i) < doc_id), i -> struct(start + i AS s, 1L AS n))")
    ranges = hit.select("doc_id", "rid", F.when(all_, F.array(F.struct(F.col("start").alias("s"), F.col("n").alias("n")))).otherwise(each).alias("r")).where(F.size("r") > 0)
    return ranges.groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("r")).alias("runs"))


def gone_words(n: int, runs: list[dict]) -> np.ndarray:
    """Which of ``n`` words a run of windows covers."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r["s"]] += 1
        edge[r["s"] + r["n"] + WINDOW - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def kept_words(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """Words that no run of windows covers."""
    return [w for w, g in zip(words, gone_words(len(words), runs).tolist(), strict=True) if not g]


_word = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, runs: list[dict]) -> bytes:
    """The text without covered words. Each stretch of them goes with the white space behind it, or with
    that before it at the end of the text; all else stays as it was."""
    spans = [m.span() for m in _word.finditer(text)]
    gone = gone_words(len(spans), runs)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
    out, at = [], 0
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        if last < len(spans):
            out.append(text[at : spans[first][0]])
            at = spans[last][0]
        else:
            out.append(text[at : max(at, spans[first - 1][1])] if first else b"")
            at = spans[-1][1]
    return b"".join([*out, text[at:] if at < len(text) else b""])


def dedup_digests(docs: DataFrame, bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document. Only texts that may lose words
    meet the runs; the others' digests are made where they are read."""
    spark = docs.sparkSession
    runs = written(repeated(docs, hot, bits), "repeated-runs")
    losing = spark.sparkContext.broadcast(bit_table(runs.select(F.col("rid").alias("key")), bits))

    def make():
        def step(ids: list, texts: list[str]) -> dict:
            keys = [row_key(t) for t in texts]
            hit = in_table(losing.value, np.array(keys, np.int64).view(np.uint64)) if keys else []
            n, sha, text = [], [], []
            for t, h in zip(texts, hit, strict=True):
                words = t.encode().split()
                n.append(len(words))
                sha.append(None if h else hashlib.sha256(b" ".join(words)).hexdigest())
                text.append(t if h else None)
            return {"doc_id": ids, "rid": keys, "n_words": n, "sha": sha, "text": text}

        return step

    rows = map_texts(docs, make, "doc_id long, rid long, n_words long, sha string, text string", limit=TEXT_SLICE)
    joined = rows.join(runs, ["doc_id", "rid"], "left")
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for doc_id, n, sha, text, r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_words", "sha", "text", "runs")), strict=True):
                if text is not None:
                    kept = kept_words(text.encode().split(), r or [])
                    out.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                else:
                    out.append((doc_id, n, 0, sha))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "n_words", "sha", "text", "runs").mapInArrow(run, ddl)


def remove_repeats(docs: DataFrame, hot: int = HOT, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` with the words removed that repeat elsewhere, in their own columns.

    A text that loses nothing stays as it is. One that loses words keeps the white space and line feeds
    between the others; n_chars, where there is such a column, follows. A text that loses all its words
    leaves.
    """
    bounded_batches(docs.sparkSession)
    runs = repeated(docs, hot, bits)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    keyed = packed.withColumn("rid", _row_key_udf()("text"))
    joined = keyed.join(runs, ["doc_id", "rid"], "left")
    cleaned = joined.withColumn("kept", F.when(F.col("runs").isNotNull(), _kept_udf()("text", "runs")))
    stay = cleaned.where("kept IS NULL OR kept RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = stay.withColumn("row", F.when(F.col("kept").isNotNull(), F.col("row").withField("text", F.col("kept"))).otherwise(F.col("row")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("row", F.when(F.col("kept").isNotNull(), F.col("row").withField("n_chars", F.length("kept").cast(kind))).otherwise(F.col("row")))
    return new.select("row.*")


def _row_key_udf() -> Callable:


    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([row_key(t) for t in texts], dtype="int64")

    return key.asNondeterministic()  # computed once, not again in a filter


def _kept_udf() -> Callable:


    @F.pandas_udf("string")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else without(t.encode(), r).decode() for t, r in zip(texts, runs, strict=True)])

    return kept.asNondeterministic()
