"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: bit j is set if more than half of a text's shingle hashes have it. Two texts are linked if
their fingerprints differ in ``distance`` bits at most, and a component is what links connect.

Search works on distinct fingerprints. Correlated bits are grouped into partitions. A threshold of -1, 0
or more for each partition, with the sum ``distance - partitions + 1``, still finds every link: a link that
kept above its threshold everywhere would differ in too many bits. Dynamic programming chooses the
thresholds, and the number of partitions, for the fewest estimated candidates; both the estimate and the
correlations come from all fingerprints. Fingerprints that agree on a key are verified exactly.

No pairs are emitted. A key shared by up to ``GROUP`` fingerprints is verified in one task, which emits a
star for each of its components. A key shared by more is split: within it, the open bits are cut into
``distance + 1`` parts, one of which must agree. Where few bits are left open, fingerprints that agree
outside some ``distance`` of them are starred by one aggregation.

Defined results: a null or empty text has the fingerprint zero, which links like any other; a text of fewer
words than a shingle is one shingle; null ids stay and are never the smallest of a component that has
others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, written

SHINGLE, DISTANCE, SEED, BITS = 3, 2, 42, 64
#: Fingerprints of one key that one task compares with each other, at most.
GROUP = 2048
#: Open bits below which a split key is starred by aggregation.
FEW_BITS = 12
#: Numbers of partitions that the plan chooses from, for a small and for a larger distance.
PARTITIONS, WIDE_PARTITIONS, WIDE = (2, 3, 4), (2, 3, 4, 5, 6), 3
#: Comparisons that cost about as much as one key row, which is shuffled and sorted.
ROW_COST = 200


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of unsigned 64-bit hashes; a tie leaves a bit unset."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than a shingle are one shingle."""
    from xxhash import xxh64_intdigest

    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = words if shingle == 1 else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64)


def text_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return fingerprint(shingle_hashes(text.encode().lower().split(), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint of each whole text, as a signed long."""

    def make():
        def step(ids: list, texts: list[str]) -> dict:
            known = {t: text_fingerprint(t, shingle) for t in dict.fromkeys(texts)}
            return {"doc_id": ids, "fp": np.array([known[t] for t in texts], np.uint64).view(np.int64)}

        return step

    return map_texts(docs, make, "doc_id long, fp long", id_col, text_col)


def bit_counts(classes: DataFrame) -> np.ndarray:
    """How often bits i and j are set together, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            bits = np.unpackbits(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        flat = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

    rows = classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


def correlated_groups(counts: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits of about one size: each begins with the bit that has most correlation left
    and takes the bits most correlated with it."""
    n = max(counts[-1], 1)
    both = counts[:-1].reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        own = [max(left, key=lambda b: corr[b, left].sum())]
        while len(own) < size:
            own.append(max((b for b in left if b not in own), key=lambda b: corr[b, own].sum()))
        out.append(sorted(own))
        left = [b for b in left if b not in own]
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on, one for each partition, with this sum and the least cost; ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t1, c in enumerate(own):
                got = (cost + c, [*chosen, t1 - 1])
                if done + t1 - 1 not in nxt or got[0] < nxt[done + t1 - 1][0]:
                    nxt[done + t1 - 1] = got
        best = nxt
    return best[total]


def plan(classes: DataFrame, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(bits that a probe must agree on, bits it leaves open to its threshold) of all probes, as masks."""
    counts = bit_counts(classes)
    n = max(counts[-1], 1)
    p = counts[:-1].reshape(BITS, BITS).diagonal() / n
    differ = np.clip(2 * p * (1 - p), 0, 0.5)
    groups = {m: correlated_groups(counts, m) for m in (WIDE_PARTITIONS if distance > WIDE else PARTITIONS)}
    flat = [(m, i, g) for m, gs in groups.items() for i, g in enumerate(gs)]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _masked(mask_of(g)).alias("v")) for k, (_, _, g) in enumerate(flat))))
    same = classes.select(keys.alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    pairs = {flat[r["k"]][:2]: float(r["pairs"]) for r in same}
    best = None
    for m, gs in groups.items():
        costs = []
        for i, g in enumerate(gs):
            row, grown = [0.0], pairs.get((m, i), 0.0) + 1
            for t in range(distance + 1):
                probes = comb(len(g), t)
                row.append(ROW_COST * n * probes + grown)
                grown *= 1 + sum(differ[b] / (1 - differ[b]) for b in g) / (t + 1)
            costs.append(row)
        cost, chosen = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(gs, chosen, strict=True) if t >= 0])
    return [(mask_of([b for b in g if b not in out]), mask_of(list(out))) for g, t in best[1] for out in combinations(g, t)]


def _masked(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long"))


def components_within(fps: np.ndarray, distance: int) -> np.ndarray:
    """Index of each fingerprint's root among these, by comparing all of them in blocks."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1
        a = find(i)
        for j in near.tolist():
            b = find(j)
            if a != b:
                a, b = min(a, b), max(a, b)
                root[b] = a
    return np.array([find(i) for i in range(n)])


def verified(groups: DataFrame, distance: int) -> DataFrame:
    """Stars (a, b) of the components of each key (slot, key); a key's rows stand together in order."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(fps: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= distance
        a.append(fps[two][near])
        b.append(fps[two + 1][near])
        for s, e in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist(), strict=True):
            own = fps[s:e]
            root = components_within(own.view(np.uint64), distance)
            linked = root != np.arange(len(own))
            a.append(own[root[linked]])
            b.append(own[linked])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for x in batches:
            cols = [x.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "key", "fp")]
            cols = cols if rest is None else [np.concatenate(y) for y in zip(rest, cols, strict=True)]
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            if len(new):
                yield stars(cols[2][: new[-1]], np.concatenate([[0], new]))
            cut = new[-1] if len(new) else 0
            rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]):
            yield stars(rest[2], np.array([0, len(rest[2])]))

    return groups.select("slot", "key", "fp").repartition("slot", "key").sortWithinPartitions("slot", "key", "fp").mapInArrow(run, "a long, b long")


def _split(mask: int, parts: int) -> list[int]:
    """Masks that agree on one more part of the open bits each."""
    open_ = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | mask_of(open_[i::parts]) for i in range(parts)]


def links(classes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Stars (a, b) that connect just what links connect, among distinct fingerprints ``fp``."""
    bounded_batches(classes.sparkSession)
    probes = plan(classes, distance)
    masks = [agree for agree, _ in probes]
    out, rows = None, classes.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), _masked(m).alias("key")) for k, m in enumerate(masks)))).alias("x")).select("x.slot", "x.key", "fp")
    while True:
        counts = rows.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = written(rows.join(counts, ["slot", "key"]), "simhash-keys")
        found = verified(shared.where(F.col("n") <= group), distance)
        out = found if out is None else out.unionByName(found)
        hot = shared.where(F.col("n") > group)
        slots = [r["slot"] for r in hot.select("slot").distinct().collect()]
        if not slots:
            return out
        nxt: list[int] = []
        parts = []
        for s in slots:
            mine = hot.where(F.col("slot") == s)
            open_ = [b for b in range(BITS) if not masks[s] >> b & 1]
            if len(open_) <= FEW_BITS:
                free = [mask_of(list(c)) for c in combinations(open_, min(distance, len(open_)))]
                full = (1 << BITS) - 1
                cells = mine.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _masked(full ^ w).alias("v")) for k, w in enumerate(free)))).alias("x")).select("x.k", "x.v", "fp")
                roots = cells.groupBy("k", "v").agg(F.min("fp").alias("a"), F.count("*").alias("c")).where("c > 1")
                out = out.unionByName(cells.join(roots, ["k", "v"]).where("a <> fp").select("a", F.col("fp").alias("b")))
                continue
            own = _split(masks[s], distance + 1)
            parts.append(mine.select("fp", F.explode(F.array(*(F.struct(F.lit(len(nxt) + k).alias("slot"), _masked(m).alias("key")) for k, m in enumerate(own)))).alias("x")).select("x.slot", "x.key", "fp"))
            nxt += own
        if not parts:
            return out
        masks, rows = nxt, parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large and small stars.

    Every round is a table in the shared folder; a hub's edges are only ever joined with one minimum.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "stars")
        row = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).collect()[0]
        if state == (row["n"], row["h"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (row["n"], row["h"])


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = connected(links(classes, distance, group))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = written(rooted.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
