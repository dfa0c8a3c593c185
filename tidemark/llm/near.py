"""Near-dedup of the corpus: SimHash proposes, exact shingle sets decide.

The general rule holds: texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; a component is what such links connect. Candidates come from the SimHash
operator's generalised pigeonhole search over fingerprints of a text's distinct words, at ``DISTANCE`` bits.
One changed word breaks five shingles but moves one word's vote, so that these fingerprints find what those
of five-word shingles would need twice the distance for. README has the measured recall.

No pairs are emitted. The texts of a probe's key are compared within one task, up to ``GROUP`` of them: first
their fingerprints, which part most, then the shingle sets of those that are left, where texts already
connected are not compared again. A key that more texts share is hot: it is split by further bits until its
parts are small. Which keys are hot reaches the tasks as a bit table of fixed size; a false positive only
splits a key that need not be.

Defined results: words are as in op6; texts with the same shingles are copies, so are null and empty ones;
a text of fewer words than a shingle is one shingle; a component goes by its smallest doc_id, null ones last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, written
from .simhash import BITS, SEED, connected, fingerprint, mask_of, plan, shingle_hashes, signed
from .substrings import bit_table, in_table

SHINGLE, SIMILAR, DISTANCE = 5, 0.8, 7
#: Texts of one key that one task compares with each other, at most; 8 bytes each, and some 4 KB of shingles
#: of those that connect.
GROUP = 1 << 15
#: Bits of the table of hot keys, and open bits below which a hot key is not split further.
HOT_BITS, FEW_BITS = 20, 12


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(words, shingle))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``SIMILAR`` or more."""
    if len(a) < len(b):
        a, b = b, a
    if 5 * len(b) < 4 * len(a):
        return False
    both = int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum())
    return 5 * both >= 4 * (len(a) + len(b) - both)


def components(sets: list[np.ndarray], fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Index of each set's root, the first of its component. Two sets are linked if their fingerprints
    differ in ``distance`` bits at most and they are similar; a set that is connected already is compared
    with those only that are not."""
    root, left = np.arange(len(sets)), np.arange(len(sets))
    while len(left):
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
            near[near] = [similar(sets[i], sets[j]) for j in left[near].tolist()]
            found, left = left[near], left[~near]
            root[found] = first
            queue += found.tolist()
    return root


def connected_prints(fps: np.ndarray, distance: int) -> np.ndarray:
    """Index of each fingerprint's root, the first of its component."""
    root, left = np.arange(len(fps)), np.arange(len(fps))
    while len(left):
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= distance
            found, left = left[near], left[~near]
            root[found] = first
            queue += found.tolist()
    return root


def word_print(words: list[bytes]) -> int:
    """Fingerprint of the distinct words."""
    return fingerprint(shingle_hashes(list(dict.fromkeys(words)), 1))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, Spark's hash of the text, digest of its shingles and fingerprint of its distinct words."""

    def make():
        from xxhash import xxh64_intdigest

        def one(text: str) -> tuple[int, int, int]:
            raw = text.encode()
            words = raw.lower().split()
            return xxh64_intdigest(raw, 42), xxh64_intdigest(shingles(words).tobytes(), SEED), word_print(words)

        def step(ids: list, texts: list[str]) -> dict:
            known = {t: one(t) for t in dict.fromkeys(texts)}
            return {"doc_id": ids} | {c: np.array([known[t][k] for t in texts], np.uint64).view(np.int64) for k, c in enumerate(("h", "digest", "fp"))}

        return step

    return map_texts(docs, make, "doc_id long, h long, digest long, fp long")


def _keyed(classes: DataFrame, masks: list[int], base: int = 0) -> DataFrame:
    """slot, key, fp and digest of each probe."""
    probes = F.explode(F.array(*(F.struct(F.lit(base + k).alias("slot"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks))))
    return classes.select("fp", "digest", probes.alias("x")).select("x.slot", "x.key", "fp", "digest")


def _sharing(rows: DataFrame, distance: int) -> DataFrame:
    """(gid, digest): the texts of each key whose fingerprints connect, two at least; gid is a hash of them,
    so that keys with the same texts give the same rows."""
    schema = pa.schema([("gid", pa.int64()), ("digest", pa.int64())])

    def of_key(fps: np.ndarray, digests: np.ndarray) -> Iterator[np.ndarray]:
        if len(fps) == 2:
            if int(fps[0] ^ fps[1]).bit_count() <= distance:
                yield np.sort(digests)
            return
        root = connected_prints(fps, distance)
        for r in np.unique(root[root != np.arange(len(fps))]).tolist():
            yield np.sort(digests[root == r])

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        gids = np.array([xxh64_intdigest(d.tobytes()) for d in found], np.uint64).view(np.int64)
        sizes = [len(d) for d in found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(gids, sizes)), pa.array(np.concatenate(found))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found = None, []
        for x in batches:
            cols = [x.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "key", "fp", "digest")]
            cols = cols if rest is None else [np.concatenate(y) for y in zip(rest, cols, strict=True)]
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            starts = np.concatenate([[0], new])
            for a, b in zip(starts[:-1].tolist(), new.tolist(), strict=True):
                if b - a > 1:
                    found += of_key(cols[2][a:b].view(np.uint64), cols[3][a:b])
            rest = [c[starts[-1] :] for c in cols]
            if len(found) > 500:
                yield batch(found)
                found = []
        if rest is not None and len(rest[0]) > 1:
            found += of_key(rest[2].view(np.uint64), rest[3])
        if found:
            yield batch(found)

    return rows.repartition("slot", "key").sortWithinPartitions("slot", "key", "fp", "digest").mapInArrow(run, "gid long, digest long")


def candidates(classes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(gid, digest): groups of texts whose fingerprints connect within a key. Every two texts whose
    fingerprints differ in ``distance`` bits at most are in one of them."""
    spark = classes.sparkSession
    bounded_batches(spark)
    masks, rows, out = [agree for agree, _ in plan(classes, distance)], None, None
    rows = _keyed(classes, masks)
    while True:
        counts = rows.groupBy("slot", "key").agg(F.count("*").alias("n")).where(F.col("n") > group)
        hot = written(counts.select("slot", F.xxhash64("slot", "key").alias("key")), "hot-keys")
        slots = [r["slot"] for r in hot.select("slot").distinct().collect()]
        few = [s for s in slots if BITS - masks[s].bit_count() <= FEW_BITS]
        if len(few) == len(slots):
            found = _sharing(rows, distance)
            return (found if out is None else out.unionByName(found)).distinct()
        table = spark.sparkContext.broadcast(bit_table(hot.where(~F.col("slot").isin(few)) if few else hot, HOT_BITS))

        @F.pandas_udf("boolean")
        def is_hot(keys):
            import pandas as pd

            return pd.Series(in_table(table.value, keys.to_numpy().view(np.uint64)))

        marked = written(rows.withColumn("hot", is_hot.asNondeterministic()(F.xxhash64("slot", "key"))), "simhash-keys")
        found = _sharing(marked.where("not hot"), distance)
        out = found if out is None else out.unionByName(found)
        nxt, parts = [], None
        for s in sorted(set(slots) - set(few)):
            open_ = [b for b in range(BITS) if not masks[s] >> b & 1]
            own = [masks[s] | mask_of(open_[i :: distance + 1]) for i in range(distance + 1)]
            more = _keyed(marked.where(F.col("hot") & (F.col("slot") == s)), own, len(nxt))
            parts, nxt = more if parts is None else parts.unionByName(more), nxt + own
        others = marked.where(F.col("hot") & ~F.col("slot").isin(slots))
        out = out.unionByName(_sharing(others, distance))
        masks, rows = nxt, written(parts.distinct(), "simhash-split")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """digest, fingerprint and the bytes of the shingles of each text."""

    def make():
        def step(ids: list, own: list[str]) -> dict:
            words = [t.encode().lower().split() for t in own]
            return {"digest": ids, "fp": np.array([word_print(w) for w in words], np.uint64).view(np.int64), "own": [shingles(w).tobytes() for w in words]}

        return step

    return map_texts(texts, make, "digest long, fp long, own binary", "digest")


def verified(groups: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Stars (a, b) of the components of each group (gid, digest, fp, own)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(names: list[int], fps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        root = components(sets, np.array(fps, np.int64).view(np.uint64), distance)
        own, linked = np.array(names, np.int64), root != np.arange(len(sets))
        return pa.RecordBatch.from_arrays([pa.array(own[root[linked]]), pa.array(own[linked])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, fps, sets = None, [], [], []
        for x in batches:
            for gid, name, fp, own in zip(*(x.column(c).to_pylist() for c in ("gid", "digest", "fp", "own")), strict=True):
                if gid != now and names:
                    yield stars(names, fps, sets)
                    names, fps, sets = [], [], []
                now = gid
                names.append(name)
                fps.append(fp)
                sets.append(np.frombuffer(own, np.uint64))
        if names:
            yield stars(names, fps, sets)

    return groups.select("gid", "digest", "fp", "own").repartition("gid").sortWithinPartitions("gid", "digest").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id, h, digest, component_id (the smallest doc_id that links reach) and first: the digest whose
    document that is. h is XXH64 of the text, digest that of its shingles."""
    found = written(prints(docs), "near-prints")
    classes = written(found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("h").alias("h"), F.first("fp").alias("fp")), "near-classes")
    groups = written(candidates(classes, distance, group), "near-keys")
    again = classes.join(groups.select("digest").distinct(), "digest").select("h", "digest")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(again, "h").dropDuplicates(["h"]).select("digest", "text")
    roots = connected(verified(groups.join(shingle_sets(texts), "digest"), distance))
    rooted = classes.join(roots, classes["digest"] == roots["node"], "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    least = F.min(F.struct(F.col("first").isNull(), F.col("first"), F.col("digest"))).alias("m")
    named = rooted.groupBy("root").agg(least).select("root", F.col("m.first").alias("component_id"), F.col("m.digest").alias("first_digest"))
    of_class = written(rooted.join(named, "root").select("digest", "component_id", "first_digest"), "near-components")
    return found.select("doc_id", "h", "digest").join(of_class, "digest").select("doc_id", "h", "digest", "component_id", "first_digest")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: of the rows with the component's smallest doc_id
    and that document's shingles, the one whose text has the least hash.

    Each row is judged by its own text. Rows that share a doc_id but not their texts are different
    documents; each stays unless its own component has a smaller one, or the same doc_id and another text
    that is a near copy. Components without any doc_id keep one row too.
    """
    groups = near_groups(docs)
    best = groups.where((F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = best.groupBy("digest").agg(F.min("h").alias("h"), F.min("component_id").alias("id")).select("h", F.xxhash64("id").alias("r"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("h"), F.xxhash64(docs["doc_id"].cast("long")).alias("r"))
    chosen = packed.join(best, ["h", "r"], "left_semi")
    return chosen.groupBy("h", "r").agg(F.first("row").alias("row")).select("row.*")
