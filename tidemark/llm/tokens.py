"""Encoding with the tokenizers library, each distinct piece of a text once a worker."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .chunks import TextCoder, chunk_of

#: Words that a coder of the word tokenizer knows, at most; some 200 bytes each.
WORDS = 300_000
#: Characters of pieces that go to the library as one text.
JOINED = 1 << 16
#: A line of its own between pieces: the line feed itself, or a character that no piece has.
FEED, MARK = "\n", "\x01"
_one_word = re.compile(r" ?\S+").fullmatch


def load(path: str):
    """A tokenizer that takes strings of special tokens in a text for ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _kind(tokenizer) -> str:
    """Which cuts are exact for this tokenizer: 'bytes', 'words' or 'none'."""
    import json

    parts = json.loads(tokenizer.to_str())
    normal, pre = parts.get("normalizer"), parts.get("pre_tokenizer") or {}
    if parts["model"].get("type") != "BPE" or parts.get("post_processor"):
        return "none"
    if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    names = [x["type"] for x in (normal or {}).get("normalizers", [])]
    steps = [x["type"] for x in pre.get("pretokenizers", [])]
    return "words" if names == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] else "none"


class Encoder:
    """``encode(texts)`` gives the ids of an Arrow column of texts, and how many each text has.

    The cuts keep the library's result: a byte-level tokenizer never merges over a match of its split
    pattern, and the word tokenizer drops white space and never merges over it. Unseen pieces go to the
    library as lines of one text, parted by an id that no piece can have; where the lines that come back
    are not as many as the pieces, each piece is encoded alone.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.kind = _kind(self.tokenizer)
        self.coder = TextCoder(self._of_pieces, True) if self.kind == "bytes" else TextCoder(self._of_pieces, False, WORDS)
        self.between = FEED if self.kind == "bytes" else f"\n{MARK}\n"
        got = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = got[0] if len(got) == 1 else -1

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, texts: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(texts)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(texts) - 1:
            return self._each(texts)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)], strict=True)]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        spaced = self.kind == "bytes"
        texts = list(map(chunk_of, pieces)) if spaced else pieces
        out: list = [None] * len(texts)
        group, size, alone = [], 0, []

        def flush(own: list[int], encode) -> None:
            for k, v in zip(own, encode([texts[j] for j in own]), strict=True):
                out[k] = v

        for i, t in enumerate(texts):
            if _one_word(t) is None if spaced else MARK in t:
                alone.append(i)
                continue
            group.append(i)
            size += len(t)
            if size >= JOINED:
                flush(group, self._together)
                group, size = [], 0
        if group:
            flush(group, self._together)
        if alone:
            flush(alone, self._each)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind != "none":
            return self.coder(texts)
        got = self._each(texts.to_pylist())
        return np.frombuffer(b"".join(got), "<u4"), np.array([len(x) >> 2 for x in got], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with an end id behind each text."""
    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u4", copy=False), sizes + 1
