"""Byte-level BPE by recursive queries.

Each worker holds an in-memory DuckDB with the merge table of a rank file. Words that the worker has not
met go to it as token-position rows (word, place, next place, token). A step of the recursive query joins
neighbours with the merge table and contracts each word's leftmost pair of minimum rank, until no pair is
left. With it go the pairs that later steps are bound to contract just so: those whose rank is below that
of any merge that could yet take one of their tokens from outside (columns ``lb`` and ``rb`` of the merge
table, by both neighbours), and every other pair of a run of equal ones. A word's steps then grow with the
depth of its merges and not with its length, and kept rows with them.

Ranks rise along a word's contractions if each merge has a higher rank than its parts. Where a rank file
breaks that, only the leftmost pair of minimum rank is contracted.

A document's ids are decoded by an ordered aggregation over (document, place, token) rows.

Defined results: a null or empty text has no ids, and decodes to no bytes. Memory grows with the longest
match of the split pattern, some 300 bytes a byte of it, as all its tokens are rows of one query.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import Cached, TextCoder, chunk_of, pattern_matches
from .common import bounded_batches, slices, texts_of, vocabulary

#: Bytes of words that one recursive query takes, one word at least, and rows that it keeps of its steps,
#: about: what is not done by then goes to the next query.
QUERY_BYTES, QUERY_ROWS = 1 << 17, 1 << 21
#: Ids that one query decodes.
DECODE_IDS = 1 << 20

ENCODE = """
WITH RECURSIVE steps AS (
  SELECT 0 AS k, w, x, y, t FROM start_rows
  UNION ALL (
    WITH edges AS MATERIALIZED (
      SELECT l.w, l.x, l.y, r.y AS z, m.merged, m.lb, m.rb
      FROM steps l JOIN steps r ON r.x = l.y JOIN merges m ON m.pair = ((l.t << 20) | r.t)
    ), judged AS MATERIALIZED (
      SELECT e.w, e.x, e.y, e.z, e.merged, e.merged < coalesce(a.lb, 1 << 30) AS sure, e.merged <= coalesce(a.lb, 1 << 30) AND e.merged <= coalesce(c.rb, 1 << 30) AS fit,
        coalesce(a.merged = e.merged, false) OR coalesce(c.merged = e.merged, false) AS run
      FROM edges e LEFT JOIN edges a ON a.y = e.x LEFT JOIN edges c ON c.x = e.y WHERE e.merged IS NOT NULL
    ), runs AS (
      SELECT *, row_number() OVER (ORDER BY x) AS n, coalesce(lag(y) OVER (ORDER BY x) = x, false) AS joined FROM judged WHERE fit AND run
    ), headed AS (
      SELECT *, max(CASE WHEN NOT joined THEN 2 * n + sure::INT END) OVER (ORDER BY x) AS head FROM runs
    ), chosen AS MATERIALIZED (
      SELECT x, y, z, merged FROM headed WHERE head % 2 = 1 AND (n - head // 2) % 2 = 0
      UNION SELECT x, y, z, merged FROM judged WHERE fit AND sure AND NOT run
      UNION
      SELECT x, y, z, merged FROM judged JOIN (SELECT min((merged << 40) | x) AS best FROM judged GROUP BY w) b ON b.best = ((merged << 40) | x)
    )
    SELECT s.k + 1, s.w, s.x, coalesce(c.z, s.y), coalesce(c.merged, s.t)
    FROM steps s JOIN (SELECT DISTINCT w FROM judged) live ON live.w = s.w LEFT JOIN chosen c ON c.x = s.x
    WHERE s.k < $steps AND s.x NOT IN (SELECT y FROM chosen)
  )
)
SELECT w, x, y, t, k FROM steps JOIN (SELECT w AS v, max(k) AS last FROM steps GROUP BY w) e ON w = v AND k = last ORDER BY x
"""
DECODE = "SELECT d, string_agg(s, '' ORDER BY p) AS raw FROM id_rows JOIN tokens USING (t) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair that becomes this token: what lower ranks make of its bytes alone. No other pair ever does,
    as the bytes of a token are merged in this order wherever they stand."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < own]
        if not found:
            return None
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """pair (left << 20 | right), merged (null if none), and the lowest ranks of merges that can take the
    right token together with anything that ends in the left one (lb), or the left one with anything that
    begins with the right one (rb); null without such a merge."""
    pairs = {r: p for t, r in ranks.items() if len(t) > 1 and (p := last_merge(t, ranks))}
    level = {t: r if len(t) > 1 else -1 for t, r in ranks.items()}
    rising = all(level[a] < r and level[b] < r for r, (a, b) in pairs.items())
    merged, lb, rb = {}, {}, {}
    for r, (a, b) in pairs.items():
        i, j = ranks[a], ranks[b]
        merged[i << 20 | j] = r
        for k in range(len(a)):
            if (s := ranks.get(a[k:])) is not None:
                lb[s << 20 | j] = min(r, lb.get(s << 20 | j, r))
        for k in range(1, len(b) + 1):
            if (s := ranks.get(b[:k])) is not None:
                rb[i << 20 | s] = min(r, rb.get(i << 20 | s, r))
    keys = list(lb.keys() | rb.keys())
    if not rising:
        lb = rb = dict.fromkeys(keys, -1)
    return pa.table({"pair": pa.array(keys, pa.int64()), "merged": pa.array([merged.get(k) for k in keys], pa.int64()), "lb": pa.array([lb.get(k) for k in keys], pa.int64()), "rb": pa.array([rb.get(k) for k in keys], pa.int64())})


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.db.execute("SET enable_progress_bar = false")
        self.db.register("made", merge_table(self.ranks))
        self.db.register("vocab", pa.table([pa.array(list(self.ranks.values()), pa.int64()), pa.array([x.decode("latin-1") for x in self.ranks])], names=["t", "s"]))
        self.db.execute("CREATE TABLE merges AS FROM made; CREATE TABLE tokens AS FROM vocab; DROP VIEW made; DROP VIEW vocab")
        self.coder = TextCoder(self._of_pieces, True, limit=400_000)
        self.words = Cached(self.encode_words, limit=400_000)

    def _query(self, sql: str, name: str, rows: pa.Table, **parameters: int) -> dict:
        self.db.register(name, rows)
        try:
            return self.db.execute(sql, parameters).fetchnumpy()
        finally:
            self.db.unregister(name)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of matches of the split pattern."""
        raw, out, at = [w.encode() for w in words], [], 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= QUERY_BYTES):
                size += len(raw[end])
                end += 1
            out += self._encode(raw[at:end])
            at = end
        return out

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        sizes = np.array([len(x) for x in raw], np.int64)
        w, t = np.repeat(np.arange(len(raw)), sizes), self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        x = np.arange(len(w))
        y = np.where(np.append(np.diff(w) == 0, False), x + 1, -1)
        out: list[bytes] = [b""] * len(raw)
        while len(w):
            steps = max(1, min(64, QUERY_ROWS // len(w)))
            got = self._query(ENCODE, "start_rows", pa.table([w, x, y, t], names=["w", "x", "y", "t"]), steps=steps)
            w, x, y, t, k = (got[c] for c in ("w", "x", "y", "t", "k"))
            more = k >= steps
            edges = np.flatnonzero(np.diff(w, prepend=-1))
            flat = t.astype("<u4").tobytes()
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(w)).tolist(), strict=True):
                out[int(w[a])] = flat[4 * a : 4 * b]
            w, x, y, t = w[more], x[more], y[more], t[more]
        return out

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        parts = [pattern_matches(chunk_of(p)) for p in pieces]
        return [v[0] if len(v) == 1 else b"".join(v) for v in self.words(parts)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        return self.coder(texts)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of runs of ids, by an ordered aggregation."""
        out, ends, first = [b""] * len(sizes), np.cumsum(sizes), 0
        while first < len(sizes):
            start = int(ends[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, start + DECODE_IDS, "right")))
            own = ids[start : int(ends[last - 1])].astype(np.int64)
            rows = pa.table([np.repeat(np.arange(first, last), sizes[first:last]), np.arange(len(own)), own], names=["d", "p", "t"])
            got = self._query(DECODE, "id_rows", rows)
            for d, raw in zip(got["d"].tolist(), got["raw"].tolist(), strict=True):
                out[d] = raw.encode("latin-1")
            first = last
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and rank file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and decoded bytes of each whole text."""
    return _coded(docs, path, id_col, text_col, False)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of decimal ids and decoded bytes, without shipping the ids."""
    return _coded(docs, path, id_col, text_col, True)


def _coded(docs: DataFrame, path: str | None, id_col: str, text_col: str, digest: bool) -> DataFrame:
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]

    def run(batches):
        own = codec(path)
        for b in slices(batches, "text"):
            ids, sizes = own.encode(b.column("text"))
            decoded = own.decode(ids, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.view("<i4")))
            if digest:
                text = pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string()))
                sha = lambda x: hashlib.sha256(x).hexdigest()
                made = [pa.array([sha(x) for x in pc.binary_join(text.cast(pa.list_(pa.binary())), b",").to_pylist()], pa.string()), pa.array([sha(x) for x in decoded], pa.string())]
            else:
                made = [lists, pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *made], names=names)

    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
