"""The operators' pure parts, against brute force, exact round trips and the public libraries."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, chat, chunks, html, media, packing, pii, simhash, substrings, tokenfile, tokens
from tidemark.llm.common import vocabulary

ALPHABET = " \n\t\r\xa0a b,.'sS1éÉ中　\x1c\x85’'ll 're_-$Σİ"
TEXTS = st.text(alphabet=ALPHABET, max_size=60)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 176, 12287, 12288, 12289, 150_000])
def test_transport_stream_round_trip(n):
    b = media.padded(os.urandom(n))
    assert len(b) % 192 == 0 and b
    m = media.mux(b)
    d = media.demux(m)
    assert len(m) % 188 == 0 and d["payload"] == b and not d["breaks"] and not d["lost_bytes"] and d["streams"] == {0x100: 6}
    assert d["units"][0][2] and d["units"][0][0] == media.FIRST_PTS
    assert [u[0] for u in d["units"]] == [media.FIRST_PTS + i * media.TICKS for i in range(len(d["units"]))]


def test_damaged_streams_are_counted():
    m = media.mux(media.padded(os.urandom(40_000)))
    assert media.demux(m[: 188 * 9] + m[188 * 10 :])["breaks"] == 1
    d = media.demux(b"xyz" + m + b"tail")
    assert d["lost_bytes"] == 7 and d["payload"] == media.demux(m)["payload"]
    assert media.demux(b"")["payload"] == b"" and media.demux(b"\0" * 500)["packets"] == 0


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    from tidemark.llm.chunks import PATTERN

    return bpe.codec(path), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def _lists(got):
    ids, sizes = got
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


HAN = "的一是不了人我在有他这中大来上个国和说们为子地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日"


def test_bpe_equals_the_library(multi):
    codec, library = multi
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["".join(rng.choice(own) for _ in range(rng.randint(0, 70))) for own in ("aab", "etaoinshr", HAN, "=-") for _ in range(200)]
    texts += ["", "a" * 5000, "ha" * 2500, "x1" * 300, "é" * 300, "".join(rng.choice(HAN) for _ in range(5000)), "".join(map(chr, range(1, 0x800)))]
    got = codec.encode(pa.array(texts))
    assert _lists(got) == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(*got) == [t.encode() for t in texts]


def test_bpe_in_many_queries(multi, monkeypatch):
    """Queries that end after one step hand their rows on."""
    codec, library = multi
    monkeypatch.setattr(bpe, "QUERY_ROWS", 1)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 40)
    words = ["zq" + "".join(random.Random(k).choice("etaoin") for _ in range(k)) for k in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_words(words)] == [library.encode_ordinary(w) for w in words]


def test_bpe_of_ranks_that_do_not_rise():
    """A merge below its parts' ranks: only leftmost pairs of minimum rank are contracted."""
    letters = {bytes([b]): b for b in range(256)}
    ranks = letters | {b"ab": 300, b"abc": 290, b"bc": 310, b"cd": 305}
    assert bpe.last_merge(b"abc", ranks) is None
    table = bpe.merge_table(letters | {b"ab": 300, b"abab": 310, b"ba": 305}).to_pylist()
    assert {(r["pair"] >> 20, r["pair"] & 0xFFFFF): r["merged"] for r in table if r["merged"]} == {(97, 98): 300, (98, 97): 305, (300, 300): 310}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_equals_the_library(name):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "", "<|endoftext|> a", " İ,", "W\u030a x", "\x01 a\x01b", "a\0b \0"]
    want = [e.ids for e in tokens.load(vocabulary(name)).encode_batch_fast(texts, add_special_tokens=False)]
    e = tokens.Encoder(vocabulary(name))
    e.coder.limit = 500
    assert [x for i in range(0, len(texts), 100) for x in _lists(e.encode(pa.array(texts[i : i + 100])))] == want
    assert _lists(tokens.Encoder(vocabulary(name)).encode(pa.array(texts))) == want


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bit_packing(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=50)), "<u4")
    packed = tokenfile.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    skip = data.draw(st.integers(0, len(ids)))
    assert tokenfile.unpack(packed, bits, len(ids) - skip, skip).tolist() == ids[skip:].tolist()


def test_token_file_has_random_access(tmp_path):
    rng = np.random.default_rng(3)
    docs = [(i * 2 - 5, rng.integers(0, 1000, n).astype("<u4")) for i, n in enumerate([0, 1, 7, 8, 9, 300, 64, 1])]
    path = tmp_path / "x.ids"
    with open(path, "wb") as f:
        w = tokenfile.Writer(f, tokenfile.width(1000), block=8)
        for own in (docs[:3], docs[3:4], docs[4:]):
            w.add([d for d, _ in own], np.array([len(x) for _, x in own]), np.concatenate([x for _, x in own]))
        head = w.close()
        f.seek(0)
        f.write(head)
    assert tokenfile.width(1000) == 10 and tokenfile.width(1) == 1
    with open(path, "rb") as f:
        r = tokenfile.Reader(f)
        flat = np.concatenate([x for _, x in docs])
        assert r.total == len(flat) and [(d, x.tolist()) for d, _, x in r.documents()] == [(d, x.tolist()) for d, x in docs]
        assert r.document(5)[1].tolist() == docs[5][1].tolist()
        for a, n in ((0, 0), (3, 20), (17, 300), (len(flat) - 1, 1)):
            assert r.ids(a, n).tolist() == flat[a : a + n].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", ""]), st.one_of(st.text(max_size=20), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "a", "|im_end|>"]), max_size=6).map("".join))), max_size=5))
def test_chat_escaping_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b, _, _ in spans] == [t for r, t in turns if r == "assistant"]
    assert [formatted.encode()[a:b].decode() for _, _, a, b in spans] == [formatted[a:b] for a, b, _, _ in spans]
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def test_chat_masks_lie_on_the_spans():
    turns = [("user", "hi  there é中"), ("assistant", " ok\n\n"), ("assistant", ""), ("user", ""), ("assistant", "</s>[INST] ok")]
    formatted, spans = chat.render(turns)
    enc = tokens.encoder(vocabulary("byte_bpe_50k.json"))
    ids, _ = enc.encode(pa.array([formatted]))
    whole = enc.tokenizer.encode(formatted, add_special_tokens=False)
    assert ids.tolist() == whole.ids
    runs = chat.token_runs(spans, np.cumsum(chat.token_bytes(enc)[ids]))
    assert [chat.unescape(formatted[a:b]) for _, _, a, b in runs] == [" ok\n\n", "</s>[INST] ok"]
    for i, j, a, b in runs:  # the library's own offsets
        assert whole.offsets[i][0] <= a < whole.offsets[i][1] and whole.offsets[j - 1][0] < b <= whole.offsets[j - 1][1]


def test_cutting_words_out_keeps_the_rest():
    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\t") for _ in range(rng.randint(0, 400))).encode()
        n = len(text.split())
        runs = [{"s": rng.randrange(n - 49), "n": 1} for _ in range(rng.randint(1, 3))] if n >= 50 else []
        got = substrings.without(text, runs)
        assert got.split() == substrings.kept_words(text.split(), runs)
        assert got == text if not runs else len(got) < len(text)


def test_windows_against_brute_force():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 49, 50, 51, 120, 400)] + ["x " * 200]
    w = substrings.Windows(texts)
    words = [t.split() for t in texts]
    assert [(d, s) for d, s in zip(w.doc.tolist(), w.start.tolist(), strict=True)] == [(d, s) for d, x in enumerate(words) for s in range(len(x) - 49)]
    same = {}
    for d, s, m in zip(w.doc.tolist(), w.start.tolist(), w.minimiser.tolist(), strict=True):
        assert same.setdefault(tuple(words[d][s : s + 50]), m) == m
    head, size = w.runs()
    assert size.sum() == len(w.at) and size.max() <= substrings.LONGEST
    for k, n in zip(head.tolist(), size.tolist(), strict=True):
        assert w.packed(int(w.at[k]), n).decode().split() == words[w.doc[k]][w.start[k] : w.start[k] + n + 49]


def test_pigeonhole_thresholds_cover_every_pair():
    rng = np.random.default_rng(6)
    counts = np.append(rng.integers(0, 100, (64, 64)).ravel(), 100).astype(float)
    for m in (2, 3, 4):
        groups = simhash.correlated_groups(counts, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, chosen = simhash.allocate([[0.0, 5.0, 9.0, 20.0]] * m, 2 - m + 1)
        assert sum(chosen) == 3 - m
    cost, chosen = simhash.allocate([[0, 1, 100, 1000], [0, 50, 60, 70]], 1)
    assert (cost, chosen) == min(((a + b, [i - 1, j - 1]) for i, a in enumerate([0, 1, 100, 1000]) for j, b in enumerate([0, 50, 60, 70]) if i + j - 2 == 1))


def test_fingerprints():
    from xxhash import xxh64_intdigest

    text = "A b\x1cc  D\te f é"
    words = re.findall(r"[^\x20\x09-\x0D]+", "a b\x1cc  d\te f é")
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.text_fingerprint(text) == want
    assert simhash.text_fingerprint("") == 0 and simhash.text_fingerprint(" x ") == xxh64_intdigest(b"x", 42)


def _pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15))
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@ -+()23b._%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == _pii(t)
    for t in ("1" * 50_000 + "a" * 50_000 + "@", "1." * 50_000, "a@" * 50_000, "+1(" * 30_000):
        pii.candidates(t)  # takes time in proportion to the length


def test_weak_supervision():
    from collections import Counter

    good, bad = pii.pattern_of(pii.SECRET, (0, 1, 1, 1, 1), "a1b" * 14, False), pii.pattern_of(pii.CARD, (-1, -1, 0, -1, 1), "1" * 16, False)
    assert pii.parts_of(good) == (pii.SECRET, (0, 1, 1, 1, 1), 3, 1, False)
    base = pii.pattern_of(pii.EMAIL, (1, 1, 0, 0, 1), "a" * 20, True)
    take, _ = pii.accepted(Counter({good: 100, bad: 100, base: 300}))
    assert take == {good} and pii.accepted(Counter()) == (frozenset(), {})
    t = 'x token = "0123456789abcdef0123456789abcdef01234567" mail a@b.com or +1 (017) 555-7713'
    assert pii.masked(t, take | {c[3] for c in pii.candidates(t)}) == 'x token = "[SECRET]" mail [EMAIL] or [PHONE]'


def test_main_text():
    page = '<html><head><title>T</title><script>a="</p>"</script></head><body><nav><ul><li><a href="/">Menu one</a></li></ul></nav><div class="ad">Buy this</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b> text<br>goes on.<p>Second &lt;one&gt;</p><div class="comments">no</div></article><aside>side</aside><footer>foot'
    weights = html.train([page] * 5)
    assert html.extract(page, weights) == "Head & line\n\nFirst bold text goes on.\n\nSecond <one>"
    for p in (None, "", "<", "<p", "<!-- open", "<script>x", "<p title=\"a>b\">", "a < b", "<" * 5000, "<!--" * 5000):
        html.extract(p, weights)
    assert html.extract("a < b", html.train([])) == "a < b"


ARTICLE = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content has-sidebar"><article><p>{ARTICLE}</p></article></div>', f'<p data-hidden="false">{ARTICLE}</p>', f'<div data-role="search"><p>{ARTICLE}</p></div>',
        f'<p class="share-price">{ARTICLE}</p>', f'<form class="nav"><article><p>{ARTICLE}</p></article><div class=sidebar>no</div></form>', f'<p title="class=ad">{ARTICLE}</p>',
        f'<article><p>{ARTICLE}</p></article><div class="comments"><article class="comment"><p>a reply</p></article></div>', f'<div class="site-footer">foot</div><p>{ARTICLE}</p><div class="comments-section">c</div>',
    ],
)
def test_whole_names_decide_and_the_article_stays(page):
    assert html.extract(page, html.train(["<nav>a b</nav><article><p>c d e f</p></article>"])) == ARTICLE


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=30))
def test_best_run_against_brute_force(scores):
    first, last = html.best_run(scores)
    best = max((sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores))), default=0)
    assert (sum(scores[first : last + 1]) == best) if best > 0 else last < first


def _walk(media_bytes):
    """Payload and access points of a stream by walking its packets, one after the other."""
    payload, points, open_ = b"", [], None
    for k in range(len(media_bytes) // 188):
        p = media_bytes[188 * k : 188 * k + 188]
        assert p[0] == 0x47
        if (p[1] & 31) << 8 | p[2] != 0x100:
            continue
        at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        if p[1] & 0x40:
            open_ = None
            assert p[at : at + 3] == b"\0\0\1"
            length, skip, t = int.from_bytes(p[at + 4 : at + 6], "big"), 9 + p[at + 8], p[at + 9 : at + 14]
            if p[3] & 0x20 and p[4] and p[5] & 0x40:
                points.append(((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1, k, len(payload)))
            open_ = length - (skip - 6)
            at += skip
        own = p[at : at + open_]
        payload, open_ = payload + own, open_ - len(own)
    return payload, points


@pytest.mark.parametrize("n", [0, 5, 12_288, 300_000])
def test_independent_parser_and_seek(n):
    b = media.padded(os.urandom(n))
    m = media.mux(b)
    d = media.demux(m)
    payload, points = _walk(m)
    assert payload == b == d["payload"] and points == [(u[0], u[3], u[4]) for u in d["units"] if u[2]]
    for pts, _, offset in points:
        assert media.seek(m, d["units"], pts + media.TICKS) == b[offset:]
    assert media.seek(m, d["units"], 0) == b


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200), st.integers(1, 5))
def test_best_fit(sizes, limit):
    bins, used = packing.BestFit(32, limit), {}
    for n in sizes:
        b, offset = bins.place(n)
        assert used.get(b, 0) == offset and offset + n <= 32
        used[b] = offset + n
        assert bins.open <= limit
    assert len(used) == bins.made


def test_coder_forgets_rare_pieces_only():
    """A coder's memory is bounded, and pieces that all calls have are encoded once."""
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [np.array([len(p), ord(p[-1])], "<u4").tobytes() for p in pieces]

    coder = chunks.TextCoder(encode, False, 100)
    for k in range(50):
        words = ["the", "of", *(f"w{k}x{i}" for i in range(60)), "y" * 70]
        ids, sizes = coder(pa.array([" ".join(words), "", "of the"]))
        assert ids.tolist() == [x for w in [*words, "of", "the"] for x in (len(w), ord(w[-1]))]
        assert sizes.tolist() == [2 * len(words), 0, 4] and len(coder.known) <= 100 + len(words)
    assert asked.count("the") == asked.count("of") == 1


def test_word_encoder_holds_a_bounded_number_of_words():
    enc = tokens.Encoder(vocabulary("word_bpe_49k.json"))
    enc.encode(pa.array([" ".join(f"w{i}" for i in range(310_000))]))
    got, _ = enc.encode(pa.array(["two words w7"]))
    assert len(enc.coder.known) < 1000 and enc.coder.used < 1 << 16
    assert got.tolist() == enc.tokenizer.encode("two words w7", add_special_tokens=False).ids
