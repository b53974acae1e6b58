"""Chat transcripts as token ids with an offset-aligned loss mask.

Conversations are rendered in the order of their turns with control strings around each turn; those strings inside texts
are escaped reversibly. The rendered text is encoded once, with the character offsets of its tokens. The spans of the
assistants' texts are kept sorted, and a binary search of the spans in the token offsets gives the tokens to learn.

Control strings are special tokens of the encoder, so no token crosses a span's edge and a text can be encoded in
segments, cut before turns: a conversation of any length is streamed in order through bounded memory (a segment has about
SEGMENT characters, or one turn).

Escaping: in a text, ESC ('\\x1a') becomes ESC 'e' and '<|' becomes '<' ESC '|'. So no '<|' is left in it, and reading
back is exact for every text.

Cases: null texts are empty, a null role is ''; turns that tie are ordered by role and text; null turns come first; a null
conv_id is a conversation of its own; a table without rows gives none; repeated rows are turns of their own; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESC = "\x1a"
START, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (START, BODY, END)
SEGMENT = 1 << 16
ROLE_LEARNED = "assistant"
SCHEMA = "conv_id long, segment long, n_turns int, text string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return text.replace(ESC, ESC + "e").replace("<|", "<" + ESC + "|")


def unescape(text: str) -> str:
    return text.replace("<" + ESC + "|", "<|").replace(ESC + "e", ESC)


def loader(tokenizer_file: str) -> Callable:
    """Opens a vocabulary file on the executor and adds the control strings to it."""

    def load():
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(tokenizer_file)
        made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in CONTROL])
        made.no_truncation()
        made.no_padding()
        return made

    return load


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of some turns, and the sorted spans of what is to be learned in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role)}{BODY}"
        body = escape(text)
        if role == ROLE_LEARNED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def mask(spans: np.ndarray, token_start: np.ndarray, token_end: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span. Spans and tokens are sorted; a token's span is found by binary search."""
    at = np.searchsorted(spans[:, 0], token_start, side="right") - 1
    inside = at >= 0
    inside[inside] = token_end[inside] <= spans[at[inside], 1]
    return inside & (token_end > token_start)


def format_batches(load: Callable, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        state = {"id": None, "any": False, "segment": 0, "turns": [], "size": 0, "held": 0}
        done: list[tuple] = []

        def close() -> None:
            if not state["turns"]:
                return
            text, spans = render(state["turns"])
            coded = encoder.encode(text, add_special_tokens=False)
            offsets = np.fromiter(chain.from_iterable(coded.offsets), np.int64).reshape(-1, 2)
            done.append((state["id"], state["segment"], len(state["turns"]), text, np.array(coded.ids, np.int32), offsets[:, 0].astype(np.int32), offsets[:, 1].astype(np.int32), mask(spans, offsets[:, 0], offsets[:, 1])))
            state.update(segment=state["segment"] + 1, turns=[], size=0, held=state["held"] + len(text))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            names = ["conv_id", "segment", "n_turns", "text", "input_ids", "token_start", "token_end", "loss_mask"]
            made = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*done), kinds)], names=names)
            done.clear()
            state["held"] = 0
            return made

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if not state["any"] or conv_id != state["id"]:
                    close()
                    state.update(id=conv_id, any=True, segment=0)
                elif state["size"] >= segment:
                    close()
                state["turns"].append((role or "", text or ""))
                state["size"] += len(text or "")
                if state["held"] > 4 * segment or len(done) >= 200:
                    yield out()
        close()
        if done:
            yield out()

    return run


def format_conversations(conversations: DataFrame, tokenizer_file: str, segment: int = SEGMENT) -> DataFrame:
    """Segments of conversations(conv_id, turn, role, text), in order within each part: text, ids, offsets and mask."""
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(format_batches(loader(tokenizer_file), segment), SCHEMA)


def masked_text(text: str, start: np.ndarray, end: np.ndarray, learned: np.ndarray) -> list[str]:
    """The stretches of text under the mask, with the gaps between them as breaks. Tokens may share a character."""
    a, b = start[learned], np.maximum.accumulate(end[learned])
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1])) if len(a) else []
    return [text[a[i] : b[j - 1]] for i, j in zip(first, np.append(first[1:], len(a)))]


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations, from the segments alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    state: dict = {}

    def row() -> list:
        return [state["id"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["tokens"], state["learned"]]

    for batch in batches:
        rows = []
        lists = [batch.column(c) for c in ("token_start", "token_end", "loss_mask")]
        flat, edges = [x.values.to_numpy(zero_copy_only=False) for x in lists], lists[0].offsets.to_numpy()
        for i, x in enumerate(batch.select(["conv_id", "segment", "text"]).to_pylist()):
            if not state or x["segment"] == 0:
                if state:
                    rows.append(row())
                state = {"id": x["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "tokens": 0, "learned": 0}
            text = x["text"]
            for turn in text.split(START)[1:]:
                role, _, body = turn.partition(BODY)
                state["turns"] += 1
                state["all"].update(f"{unescape(role)}\n{unescape(body.removesuffix(END))}\n".encode())
            start, end, learned = (f[edges[i] : edges[i + 1]] for f in flat)
            for part in masked_text(text, start, end, learned.astype(bool)):
                plain = unescape(part)
                state["chars"] += len(plain)
                state["loss"].update(plain.encode())
            state["size"] += len(text)
            state["tokens"] += len(start)
            state["learned"] += int(learned.sum())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == "conv_id" else None) for k, v in zip(names, row())], names=names)


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation of format_conversations' result, whose order within parts is kept."""
    return segments.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
