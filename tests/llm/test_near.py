"""The pipeline's near-dedup stage against brute force over exact shingle similarities."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import _removed, _texts
from tidemark.llm import near, pii, quality, simhash, substrings, tokens
from tidemark.llm.common import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(t):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _kept(texts):
    """Ids that are the smallest of their component, by comparing all texts with each other."""
    sets = [_shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and _jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for k, (i, _) in enumerate(texts):
        first[find(k)] = min(i, first.get(find(k), i))
    return sorted(first.values())


def _cut(texts):
    """Texts without the windows that a document with a smaller id has too; empty ones leave."""
    first, out = {}, []
    for i, t in texts:
        w = WORDS.findall(t)
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    for (i, t), (kept, w) in zip(texts, _removed(texts), strict=True):
        runs = [{"s": k, "n": 1} for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i]
        text = substrings.without(t.encode(), runs).decode() if runs else t
        assert WORDS.findall(text) == kept
        if kept or not w:
            out.append((i, text))
    return out


def _near_copies():
    """Texts, copies with a few changed words at similarities about 0.7 to 0.97, and one large group."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(30_000)}"
    rows, seen = [], []
    for k in range(240):
        own = [word() for _ in range(r.randrange(60, 400))]
        copy = list(own)
        for at in r.sample(range(len(own)), max(1, round(len(own) * r.choice((0.004, 0.01, 0.015, 0.02, 0.022, 0.03))))):
            copy[at] = word()
        rows += [(2 * k, " ".join(own)), (2 * k + 1, "  ".join(copy).upper())]
        seen.append(_jaccard(*(_shingles(t) for _, t in rows[-2:])))
    base = [word() for _ in range(100)]
    for k in range(120):
        own = list(base)
        own[r.randrange(100)] = word()
        rows.append((1000 + k, " ".join(own)))
    rows += [(2000, "four words are one"), (2001, "four  words are ONE"), (2002, "four words are two"), (2003, ""), (2004, " ")]
    return rows, seen


def test_near_copies_are_caught(spark):
    rows, seen = _near_copies()
    assert sum(0.8 <= s <= 0.95 for s in seen) >= 80 and sum(s < 0.8 for s in seen) >= 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    want = set(_kept(rows))
    assert want <= got  # nothing but near copies goes
    assert len(got - want) <= 0.05 * (len(rows) - len(want))


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    word = lambda k, n: " ".join(f"u{k}x{i}" for i in range(n))
    copy = word(99, 80)
    rows = [(1, copy)] + [(i, t) for i in range(2, 22) for t in (word(i, 60), copy)] + [(30, copy), (None, word(57, 70)), (None, word(58, 70)), (None, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert got == Counter([(1, copy)] + [(i, word(i, 60)) for i in range(2, 22)] + [(None, word(57, 70)), (None, word(58, 70))])


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == _kept(rows)


def test_probes_find_every_pair_within_the_distance(spark):
    """All pairs of fingerprints within the distance share a group, against all pairs."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for f in fps]
    classes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "digest long, fp long")
    for group in (1 << 15, 8):
        found = {}
        for r in near.candidates(classes, group=group).collect():
            found.setdefault(r["gid"], set()).add(r["digest"])
        pairs = {(a, b) for g in found.values() for a in g for b in g if a < b}
        assert {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= near.DISTANCE} <= pairs


def test_bridges_connect_components():
    base = np.arange(100, dtype=np.uint64)
    a, c = base[:80], base[20:]
    fps = np.zeros(3, np.uint64)
    assert near.components([a, c], fps[:2]).tolist() == [0, 1]
    assert near.components([a, c, base], fps).tolist() == [0, 0, 0]
    assert near.components([a, c, base], np.array([0, 0, 255], np.uint64)).tolist() == [0, 1, 2]


def test_pipeline_by_the_general_rule(spark):
    """Stage by stage in plain Python, with the verdicts and vote patterns of the operators' own parts."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    texts = sorted((i, t) for i, t in _texts(docs) if i in kept)
    first = set(_kept(texts))
    texts = [(i, t) for i, t in texts if i in first]
    cut = _cut(texts)
    take = pii.accepted(Counter(c[3] for _, t in cut for c in pii.candidates(t)))[0]
    enc = tokens.load(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for i, t in cut:
        ids = np.array([*enc.encode(pii.masked(t, take), add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == want
