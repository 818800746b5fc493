"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, each turn as <s>[INST]role[/INST]text</s>, and encoded once with offsets, the four
marks being tokens of their own.  The spans of the assistant's texts are intersected with the token spans by binary
search.  Inside roles and texts a backslash is doubled, and a mark or any control string of the tokenizer gets one after its
first character, so control tokens of the rendered text are the template's alone and removing escapes gives back every text.

Rows are sorted by conversation inside partitions and pass as a stream; one conversation is held at a time.

Defined cases: null texts and roles are empty; turns sort by turn, role and text (null turns first), repeated rows are
repeated turns; a row with a null conv_id is a conversation of its own, so such rows never gather in one task; texts of any
length pass whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
SCHEMA = "conv_id long, text string, input_ids array<int>, loss_tokens array<struct<lo:int,hi:int>>, loss_spans array<struct<lo:int,hi:int>>"


def controls(strings: tuple[str, ...] = ()) -> re.Pattern:
    """The marks and further control strings, the longest first."""
    return re.compile("|".join(re.escape(x) for x in sorted({*MARKS, *strings} - {""}, key=lambda x: (-len(x), x))))


def escape(text: str, control: re.Pattern = controls()) -> str:
    return control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], control: re.Pattern = controls()) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the code point spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role, control)}[/INST]", escape(text, control)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Token ranges [lo, hi) that lie in each span, by binary search in the sorted token spans."""
    a, b = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    lo = np.searchsorted(starts, a, "left")
    hi = np.searchsorted(ends, b, "right")
    return [(int(x), int(max(x, y))) for x, y in zip(lo, hi, strict=True)]


@cache
def _encoder(path: str):
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    own = controls(tuple(x.content for x in t.get_added_tokens_decoder().values()))
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.encode_special_tokens = False
    t.add_special_tokens(list(MARKS))
    return t, own


def formatted(rows: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: its text, token ids, and the loss mask as token ranges and as code point ranges."""

    def one(conv: int | None, turns: list[tuple[str, str]]) -> tuple:
        encoder, control = _encoder(tokenizer)
        text, spans = render(turns, control)
        found = encoder.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        tokens = mask(spans, offsets[:, 0], offsets[:, 1]) if spans else []
        chars = [(int(offsets[lo, 0]), int(offsets[hi - 1, 1])) for lo, hi in tokens if hi > lo]
        return conv, text, found.ids, [{"lo": x, "hi": y} for x, y in tokens], [{"lo": x, "hi": y} for x, y in chars]

    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    types = [pa.int64(), pa.string(), pa.list_(pa.int32()), span, span]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "text", "input_ids", "loss_tokens", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, done, size = object(), [], [], 0
        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv is None or conv != now:
                    if turns:
                        done.append(one(now, turns))
                        size += len(done[-1][1])
                    now, turns = conv, []
                    if size > 4_000_000:
                        yield batch(done)
                        done, size = [], 0
                turns.append((role or "", text or ""))
        if turns:
            done.append(one(now, turns))
        if done:
            yield batch(done)

    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # rows without an id are dealt by what they hold
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return own.repartition("conv_id", apart).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def digests(done: DataFrame) -> DataFrame:
    """Read back from formatted(): turns and loss text of each conversation as counts and SHA-256 digests."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss_spans")), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["lo"] : s["hi"]]) for s in spans)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(cols)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return done.select("conv_id", "text", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
