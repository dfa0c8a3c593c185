"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn and encoded once. Tokens of
a byte-level vocabulary tile the text, so their byte lengths are its offsets. The spans of the assistant's
texts and the token offsets are both sorted, so binary search gives each span's run of tokens; the run and
its characters are the loss mask.

Control strings inside a text get a backslash behind their first character, and one more where
backslashes already stand there, which ``unescape`` reverses exactly.

Turns are streamed in order, never gathered: what is rendered and encoded of a conversation is handed on in
blocks that end with a turn, as soon as they pass ``BLOCK_CHARS``. A turn ends with a line feed before a
mark, where a match of the split pattern ends too, so that the blocks' ids are, one after the other, those
of the whole conversation. Places of tokens and characters count from its start. The digests need its turns
in order, so one task streams a conversation, in the memory of one block.

Defined results: null texts and roles are empty; turns that share a number are ordered by role and text;
rows without a number come first; rows without a conv_id form one conversation of their own; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, vocabulary
from .tokens import Encoder, encoder

#: Control strings of common templates (fixed values).
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK_CHARS = 1 << 18

_tails = "|".join(re.escape(c[1:]) for c in CONTROLS)
_escape = re.compile(rf"([<\[])(\\*)(?={_tails})")
_unescape = re.compile(rf"([<\[])(\\*)\\(?={_tails})")


def escape(text: str) -> str:
    return _escape.sub(r"\1\2\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Formatted text, and the spans of the assistant's texts in it: characters, then UTF-8 bytes."""
    parts, spans, at, byte = [], [], 0, 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        begin, first = at + len(head), byte + len(head.encode())
        at, byte = begin + len(body), first + (len(body) if body.isascii() else len(body.encode()))
        if role == "assistant":
            spans.append((begin, at, first, byte))
        parts += [head, body, CLOSE]
        at, byte = at + len(CLOSE), byte + len(CLOSE)
    return "".join(parts), spans


def token_runs(spans: list[tuple[int, int, int, int]], ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first token, end token, first character, end character) of each span that has bytes, from the
    bytes at which the tokens end."""
    s = np.array([x for x in spans if x[0] < x[1]], np.int64).reshape(-1, 4)
    first = np.searchsorted(ends, s[:, 2], "right")
    last = np.searchsorted(ends, s[:, 3], "left") + 1
    return list(zip(first.tolist(), last.tolist(), s[:, 0].tolist(), s[:, 1].tolist(), strict=True))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` got."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body.removesuffix(CLOSE))))
    return out


BLOCKS = "conv_id long, block int, char_start long, token_start long, formatted string, ids array<int>, loss array<struct<first:long,last:long,begin:long,end:long>>"
RUN = ("first", "last", "begin", "end")


def token_bytes(enc: Encoder) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary, whose tokens are spelt with a character a byte."""
    if enc.kind != "bytes":
        raise ValueError("offsets need a byte-level vocabulary")
    out = np.zeros(enc.tokenizer.get_vocab_size(), np.int64)
    for token, i in enc.tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    return out


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Blocks of formatted conversations with their ids and loss runs, from rows (conv_id, turn, role,
    text). ``char_start`` and ``token_start`` tell where in its conversation a block begins."""
    path = path or vocabulary("byte_bpe_50k.json")
    bounded_batches(turns.sparkSession)
    text = lambda c: F.coalesce(turns[c].cast("string"), F.lit("")).alias(c)
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), text("role"), text("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    loss = pa.list_(pa.struct([(n, pa.int64()) for n in RUN]))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), loss]
    names = ["conv_id", "block", "char_start", "token_start", "formatted", "ids", "loss"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list]]:
        conv, block, held, size, begun = None, 0, [], 0, False
        for b in batches:
            for c, role, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if begun and (c != conv or size > BLOCK_CHARS):
                    yield conv, block, held
                    block, held, size = (block + 1 if c == conv else 0), [], 0
                conv, begun = c, True
                held.append((role, t))
                size += len(t)
        if begun:
            yield conv, block, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chars, tokens = encoder(path), 0, 0
        lengths = token_bytes(enc)

        def encode(group: list[tuple]) -> pa.RecordBatch:
            nonlocal chars, tokens
            made = [render(x[2]) for x in group]
            ids, sizes = enc.encode(pa.array([f for f, _ in made], pa.string()))
            out, at = [], 0
            for (conv, block, _), (formatted, spans), n in zip(group, made, sizes.tolist(), strict=True):
                if not block:
                    chars = tokens = 0
                own = ids[at : at + n]
                runs = [dict(zip(RUN, (i + tokens, j + tokens, a + chars, b + chars), strict=True)) for i, j, a, b in token_runs(spans, np.cumsum(lengths[own]))]
                out.append((conv, block, chars, tokens, formatted, own.view("<i4"), runs))
                at, chars, tokens = at + n, chars + len(formatted), tokens + n
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        group, size = [], 0
        for x in blocks(batches):
            group.append(x)
            size += sum(len(t) for _, t in x[2])
            if size > 4 * BLOCK_CHARS:
                yield encode(group)
                group, size = [], 0
        if group:
            yield encode(group)

    return ordered.mapInArrow(run, BLOCKS)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what reading its blocks back gives. Blocks may be stored and come in any order:
    those of a conversation are brought together and sorted."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")
    kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
    columns = ("conv_id", "block", "char_start", "formatted", "n_ids", "loss")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        state = None
        for b in batches:
            for conv, block, start, text, n_ids, loss in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if block == 0:
                    if state:
                        yield state
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                if state is None or state[0] != conv or state[5] != start:
                    raise ValueError(f"conversation {conv} has no block before {block}")
                for role, t in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{t}\n".encode())
                for r in loss:
                    under = unescape(text[r["begin"] - start : r["end"] - start])
                    state[3] += len(under)
                    state[4].update(under.encode())
                    state[7] += r["last"] - r["first"]
                state[5] += len(text)
                state[6] += n_ids
        if state:
            yield state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for s in digests(batches):
            rows.append([x.hexdigest() if hasattr(x, "hexdigest") else x for x in s])
            if len(rows) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    bounded_batches(formatted.sparkSession)
    blocks = formatted.withColumn("n_ids", F.size("ids").cast("long")).select(*columns)
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, ddl)
