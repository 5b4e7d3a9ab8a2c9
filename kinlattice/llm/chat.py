r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as <|im_start|>role<|im_sep|>text<|im_end|> per turn, and encoded once with
offsets; the control strings are tokens of their own, so no token reaches across the border of a text.
The loss mask marks the tokens that meet an assistant's text: both the spans of those texts and the spans of tokens are sorted,
so each span finds its tokens by binary search.

Control strings inside roles and texts are escaped: every "<", any number of backslashes and "|"
gets one backslash more before the "|", and unescaping takes one away. So no control string is left
in a text, and texts that look escaped already come back as they were.

A conversation is the unit of the result, so its turns meet in one task; that task holds one conversation at a time.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text; repeated rows
are turns each; rows with a null conv_id form one conversation; an empty table gives an empty
result; other columns are ignored.
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

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEPARATOR, END)
LOSS_ROLE = "assistant"
TO_ESCAPE, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END), re.DOTALL)
FORMATTED = "conv_id long, formatted string, input_ids array<int>, loss_mask array<boolean>, starts array<int>, ends array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
#: Characters of rendered text encoded at a time.
BATCH_CHARS = 1 << 18


def escape(text: str) -> str:
    return TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the sorted spans of the texts that are trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        parts += [head, body, END]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens meet a span; starts and ends of tokens are in order, and so are spans."""
    edges = np.asarray(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(ends, edges[:, 0], side="right")  # the first token that ends after the span's start
    last = np.searchsorted(starts, edges[:, 1], side="left")  # the first token that starts at or after its end
    steps = np.zeros(len(starts) + 1, np.int64)
    some = last > first
    np.add.at(steps, first[some], 1)
    np.add.at(steps, last[some], -1)
    return np.cumsum(steps[:-1]) > 0


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def read_loss(formatted: str, marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text under the mask, unescaped run by run; tokens that share a character count it once."""
    parts, run, upto = [], [], -1
    for a, b in zip(starts[marked].tolist(), ends[marked].tolist(), strict=True):
        if a > upto and run:
            parts.append(unescape("".join(run)))
            run = []
        if b > max(a, upto):
            run.append(formatted[max(a, upto) : b])
        upto = max(upto, b)
    return "".join([*parts, unescape("".join(run))])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TOKENIZERS: dict = {}


def load(path: str):
    """The public tokenizer with the control strings added as special tokens."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def encode(text: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends of the tokens of a rendered conversation.

    Each character is encoded once. A long conversation goes through the tokenizer in blocks of whole turns, since its
    encodings take some hundred times the memory of their text; no token reaches over a turn's border, so the blocks' tokens are those of
    the whole.
    """
    ids, starts, ends, at = [], [], [], 0
    while at < len(text) or not ids:
        cut = text.find(END, at + BATCH_CHARS)
        upto = len(text) if cut < 0 else cut + len(END)
        e = load(path).encode(text[at:upto], add_special_tokens=False)
        offsets = np.asarray(e.offsets, np.int32).reshape(-1, 2) + np.int32(at)
        ids.append(np.asarray(e.ids, np.int32))
        starts.append(offsets[:, 0])
        ends.append(offsets[:, 1])
        at = upto
    return np.concatenate(ids), np.concatenate(starts), np.concatenate(ends)


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, formatted, input_ids, loss_mask, and the offsets of the tokens in code points."""
    path = tokenizer or default_tokenizer()

    def encoded(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        for conv, text, spans in rows:
            ids, starts, ends = encode(text, path)
            for column, x in zip(out, (conv, text, ids, mask(spans, starts, ends), starts, ends), strict=True):
                column.append(x)
        ints = pa.list_(pa.int32())
        kinds = (pa.int64(), pa.string(), ints, pa.list_(pa.bool_()), ints, ints)
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["conv_id", "formatted", "input_ids", "loss_mask", "starts", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for conv, turns in zip(b.column(0), b.column(1), strict=True):
                text, spans = render([(t["role"], t["text"]) for t in turns.as_py()])
                rows.append((conv.as_py(), text, spans))
                size += len(text)
                if size >= BATCH_CHARS:
                    yield encoded(rows)
                    rows, size = [], 0
        if rows:
            yield encoded(rows)

    empty = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from the formatted rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            c = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                text = c["formatted"][i].as_py()
                marked, starts, ends = (np.asarray(c[n][i].values.to_numpy(zero_copy_only=False)) for n in ("loss_mask", "starts", "ends"))
                turns = read_turns(text)
                loss = read_loss(text, marked.astype(bool), starts, ends)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((c["conv_id"][i].as_py(), len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(marked), int(marked.sum())))
            long, text = pa.int64(), pa.string()
            kinds = (long, long, text, long, text, long, long, long)
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, DIGESTS)
