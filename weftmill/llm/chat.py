"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: per turn `<|turn|>role<|says|>text<|end|>`. In roles and texts a backslash is doubled
and `<|` becomes `<\\|`, so neither the marks nor other control strings of that form can occur in them, and removing the
backslashes gives them back. The rendered string is encoded once, with offsets; the marks are added tokens, so no token
lies across a mark. A token is under the loss mask where its span meets an assistant text's span, found by binary search
in the sorted spans.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
_MARKS = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """(the formatted string, spans [n, 2] of the assistant texts in it) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a formatted string holds."""
    return [(unescape(r), unescape(t)) for r, t in _MARKS.findall(formatted)]


def mask_tokens(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token's span [n, 2] meets one of the sorted spans."""
    if not len(spans):
        return np.zeros(len(offsets), dtype=bool)
    k = np.minimum(np.searchsorted(spans[:, 1], offsets[:, 0], "right"), len(spans) - 1)
    return (offsets[:, 0] < spans[k, 1]) & (offsets[:, 1] > spans[k, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All characters under masked tokens, each once, in order, unescaped."""
    out, at = [], 0
    for a, b in offsets[mask].tolist():
        a = max(a, at)
        if b > a:
            out.append(formatted[a:b])
            at = b
    return unescape("".join(out))


def chat_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, SAYS, END)])
    return t


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): conv_id, formatted, ids, starts, ends, mask.

    ids, token spans (code points of `formatted`) and the loss mask are arrays of one length. Turns are in order of turn,
    null first; equal turn numbers by role and text, repeated rows are repeated turns. Null role and text count as empty.
    Rows with a null conv_id form one conversation. Other columns are not looked at; an empty table gives an empty result.
    Rows are dealt out by conv_id and sorted, and each task holds one conversation and a small batch of finished ones.
    """
    schema = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(tokenizer_path)
        done: list[tuple] = []
        key, turns, any_yet, size = None, [], False, 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal done, size
            if not done:
                return
            rendered = [render(t) for _, t in done]
            encoded = tokenizer.encode_batch([r for r, _ in rendered], add_special_tokens=False)
            offsets = [np.array(e.offsets, dtype=np.int32).reshape(-1, 2) for e in encoded]
            masks = [mask_tokens(o, spans) for o, (_, spans) in zip(offsets, rendered)]
            stops = pa.array(np.concatenate([[0], np.cumsum([len(o) for o in offsets])]), pa.int32())
            flat = np.concatenate(offsets)
            columns = [np.concatenate([np.array(e.ids, dtype=np.int32) for e in encoded]), flat[:, 0], flat[:, 1], np.concatenate(masks)]
            arrays = [pa.ListArray.from_arrays(stops, pa.array(c)) for c in columns]
            arrays = [a.cast(out.field(i + 2).type) for i, a in enumerate(arrays)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([r for r, _ in rendered], pa.string()), *arrays], schema=out)
            done, size = [], 0

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv, role, text in zip(*columns):
                if any_yet and conv != key:
                    done.append((key, turns))
                    turns = []
                    if len(done) >= 256 or size > 2 << 20:
                        yield from finish()
                key, any_yet = conv, True
                turns.append((role or "", text or ""))
                size += len(text or "")
        if any_yet:
            done.append((key, turns))
            yield from finish()

    picked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    picked = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return picked.select("conv_id", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_conversations()."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends, mask in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), *(batch.column(c) for c in ("starts", "ends", "mask"))):
                turns = parse(text)
                offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], axis=1)
                loss = masked_text(text, offsets, mask.values.to_numpy(zero_copy_only=False))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, schema)
