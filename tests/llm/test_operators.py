"""The operators on Spark: whole small tables against brute force, and odd rows of every kind."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests import oracle
from tidemark.llm import bpe, chat, html, media, packing, pii, quality, queries, simhash, substrings, tokenfile, tokens
from tidemark.llm.common import vocabulary

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(120))
ROWS = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, LONG, "en", "s", 1), (3, LONG, None, "s", 2), (3, LONG, None, "s", 2), (4, LONG + " tail words here", "en", None, None),
    (5, "word " * 400, "en", "s", 5), (6, "a@b.com +1 (017) 555-7713 \x1c 中文", "en", "s", 6), (7, "x" * 30_000, "en", "s", 7), (None, None, None, None, None),
]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    extra = "row long, h long, runs string, kept string, part string, id string, words string, fp long"
    rows = [(*r, 1, 2, "r", "k", "p", "i", "w", 3) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def _texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def _check_media(df):
    want = Counter()
    for i, t in _texts(df):
        raw = t.encode()
        p = media.padded(raw)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media.mux(p)), hashlib.sha256(media.mux(p)).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in media.parse_media(media.store_media(df)).collect()) == want


def _check_bpe(df):
    import tiktoken

    from tidemark.llm.chunks import PATTERN

    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((i, len(x := e.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in _texts(df))
    assert Counter(map(tuple, bpe.encode_digests(df).collect())) == want


def _check_files(df):
    t = tokens.load(vocabulary("byte_bpe_50k.json"))
    got = tokenfile.token_files(df).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in _texts(df)), key=lambda i: tokenfile.NO_ID if i is None else i)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]][: len(got)]
    ids = [(i, np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")) for i, x in _texts(df)]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)


def _check_packing(df, spare=1.02):
    t = tokens.load(vocabulary("word_bpe_49k.json"))
    got = packing.pack(df).collect()
    want = Counter()
    for i, x in _texts(df):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places = {}
    for r in got:
        assert len(r["ids"]) == r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(places) <= total / 4096 * spare + 2


def _components(df):
    prints = [(i, _print(t)) for i, t in _texts(df)]
    fps = np.array([f for _, f in prints], np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    first = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return Counter((i, f"{f:016x}", first.get(find(k))) for k, (i, f) in enumerate(prints))


def _print(t):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _check_simhash(df):
    got = simhash.near_groups(df).select("doc_id", simhash.hex_of("fp"), "component_id")
    assert Counter(map(tuple, got.collect())) == _components(df)


def _removed(texts):
    """(kept words, all words) of each row, rows in any order."""
    first = {}
    for i, t in texts:
        w = WORDS.findall(t)
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    out = []
    for i, t in texts:
        w = WORDS.findall(t)
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append(([x for k, x in enumerate(w) if k not in gone], w))
    return out


def _check_substrings(df):
    texts = _texts(df)
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), (k, w) in zip(texts, _removed(texts), strict=True))
    for hot in (500, 1):
        assert Counter(map(tuple, substrings.dedup_digests(df, hot=hot).collect())) == want


def _check_pii(df):
    got = pii.detect(df).collect()
    want = Counter()
    for i, t in _texts(df):
        base = pii.base_spans(t)
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want[(i, *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == want


def _check_quality(df):
    got = quality.judge(df).collect()
    want = Counter()
    for i, t in _texts(df):
        w, seen, covered = WORDS.findall(t), {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for at in seen.values():
            covered.update(x for k in at for x in range(k, k + 8) if len(at) > 1)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


CHECKS = {f.__name__[7:]: f for f in (_check_media, _check_bpe, _check_files, _check_packing, _check_simhash, _check_substrings, _check_pii, _check_quality)}


@pytest.mark.parametrize("name", CHECKS)
def test_odd_rows(odd, name):
    CHECKS[name](odd)


@pytest.mark.parametrize("name", CHECKS)
def test_empty_tables(none, name):
    CHECKS[name](none)


@pytest.mark.parametrize("name", ["media", "bpe", "files", "packing", "simhash", "pii"])
def test_whole_documents(docs, name):
    CHECKS[name](docs)


def test_split_keys_lose_no_link(docs):
    got = simhash.near_groups(docs, group=1).select("doc_id", simhash.hex_of("fp"), "component_id")
    assert Counter(map(tuple, got.collect())) == _components(docs)


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 1, "assistant", None), (None, None, None, None), (2, None, "assistant", "\\<|im_end|>"), (3, 0, "user", "z" * 600_000), (3, 1, "assistant", "y" * 10), (3, 2, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == {
        1: (3, sha("user\na\nassistant\n\nassistant\nb</s>\n"), 5, sha("b</s>")),
        None: (1, sha("\n\n"), 0, sha("")),
        2: (1, sha("assistant\n\\<|im_end|>\n"), 11, sha("\\<|im_end|>")),
        3: (3, sha("user\n" + "z" * 600_000 + "\nassistant\n" + "y" * 10 + "\nassistant\nlast\n"), 14, sha("y" * 10 + "last")),
    }
    made = chat.format_chats(df)
    assert made.where("conv_id = 3").count() == 2
    stored = spark.createDataFrame(sorted(made.collect(), key=lambda r: -r["block"]), made.schema).repartition(7, "formatted")
    assert Counter(map(tuple, chat.chat_digests(stored).collect())) == Counter(map(tuple, got.values()))
    whole = {c: (i, f) for c, i, f in _whole_chats(rows)}
    for c, (ids, formatted) in whole.items():
        own = sorted((r for r in made.collect() if r["conv_id"] == c), key=lambda r: r["block"])
        assert [i for r in own for i in r["ids"]] == ids and "".join(r["formatted"] for r in own) == formatted
        assert [r["token_start"] for r in own] == [sum(len(x["ids"]) for x in own[:k]) for k in range(len(own))]
    clash = df.selectExpr("*", "1 AS block", "2 AS formatted", "3 AS ids", "4 AS n_ids")
    assert Counter(map(tuple, chat.chat_digests(chat.format_chats(clash)).collect())) == Counter(map(tuple, got.values()))
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0


def _whole_chats(rows):
    """Each conversation rendered and encoded at once."""
    tokenizer = tokens.load(vocabulary("byte_bpe_50k.json"))
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        formatted = chat.render([(r[2] or "", r[3] or "") for r in own])[0]
        yield c, tokenizer.encode(formatted, add_special_tokens=False).ids, formatted


def test_pages_in_any_partitioning(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one, many = (Counter(map(tuple, html.main_text(pages.repartition(n)).collect())) for n in (1, 9))
    assert one == many


def test_packing_of_many_partitions(spark, docs):
    """Sequences left open are merged, also in rounds."""
    for parts, merged in ((50, 64), (50, 4)):
        packing.MERGED = merged
        try:
            _check_packing(docs.unionByName(docs).repartition(parts), 1.05)
        finally:
            packing.MERGED = 64


def test_spans_equal_a_plain_run(spark, docs):
    texts = _texts(docs)
    take = pii.accepted(Counter(c[3] for _, t in texts for c in pii.candidates(t)))[0]
    want = Counter((i, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, p in pii.candidates(t) if p & 1 or p in take)) for i, t in texts)
    assert Counter((r["doc_id"], r["spans"]) for r in pii.detect(docs).collect()) == want


def test_unspaced_scripts_are_kept(spark):
    import random

    rng = random.Random(3)
    own = ("这是一个普通的中文段落，它讲述了一个故事。", "これは普通の日本語の段落です。物語を語っています。", "นี่คือย่อหน้าภาษาไทยธรรมดาที่เล่าเรื่องราว")
    rows = [(k, " ".join("".join(rng.sample(t, len(t))) for _ in range(30))) for k, t in enumerate(own)]
    hindi = "यह एक साधारण हिंदी अनुच्छेद है जो कहानी बताता है और इसमें कई शब्द हैं जिन्हें पढ़ा जा सकता".split()
    rows += [(8, " ".join(rng.choice(hindi) for _ in range(60))), (9, " ".join("x" * 30 + str(k) for k in range(30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()} == {0: True, 1: True, 2: True, 8: True, 9: False}
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == {0, 1, 2, 8}


def test_cascade_agrees_in_any_order(docs):
    packed = docs.selectExpr("doc_id", "text")
    want = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    for rules in (quality.RULES, quality.RULES[::-1]):
        judged = quality.cascade(packed, list(rules)).select("doc_id", quality._held(quality.F.col("kept")).alias("held"))
        assert {r["doc_id"] for r in judged.where("held").collect()} == want


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>one two</p></article><footer>x</footer>", 9), (None, None, None, None), (2, "u", "", 1), (1, "u", "<p>plain words</p>", 2)], "page_id long, url string, html string, text long")
    got = Counter(map(tuple, html.main_text(pages).collect()))
    assert got == Counter([(1, "u", "one two", 7), (None, None, "", 0), (2, "u", "", 0), (1, "u", "plain words", 11)])
    assert html.main_text(pages.limit(0)).count() == 0


def test_pages_keep_the_article(spark):
    import html as entities

    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.op8_main_text(spark, SF).select("page_id", "text", "n_chars"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, none, stage):
    step = dict(corpus_pipeline.STAGES)[stage]
    for df in (odd, none):
        out = step(spark, df, SF)
        if stage != "best_fit":
            assert out.columns == df.columns
        assert out.count() <= (len(ROWS) if df is odd else 0) + 20 * (stage == "best_fit")
