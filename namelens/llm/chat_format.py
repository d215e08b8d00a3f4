"""Operator 7: chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and its assistant
texts' spans are intersected with the tokens' spans by binary search. A turn is

    <s>[INST] role [/INST]text</s>

The four control strings are special tokens, so no token crosses a turn's edge.
Inside roles and texts a backslash is doubled, and a control string gets one
after its first character; both are undone by unescape().

Defined results: null roles and texts are empty; turns come by turn, then role
and text (null turns first), repeated rows stay; rows without conv_id make one
conversation; an empty table gives no rows; other columns are ignored. A
conversation is one training sample and must fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import id_columns, ids_of

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL_RE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_TURN_RE = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
_TOKENIZERS: dict = {}


def escape(text: str) -> str:
    return _CONTROL_RE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of the trained role's texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST] {escape(role)} [/INST]", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + len("</s>")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() was given."""
    return [(unescape(r), unescape(t)) for r, t in _TURN_RE.findall(formatted)]


def tokenizer(path: str):
    """The tokenizer of a file with the control strings as special tokens and untrimmed offsets."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that shares a character with a span; both are sorted."""
    mask = np.zeros(len(starts), np.int8)
    for low, high in spans:
        if low < high:
            mask[np.searchsorted(ends, low, side="right") : np.searchsorted(starts, high, side="left")] = 1
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text under the mask: each character once, though tokens may share one."""
    out, at = [], 0
    for s, e in zip(starts[mask == 1].tolist(), ends[mask == 1].tolist(), strict=True):
        if e > at:
            out.append(formatted[max(s, at) : e])
            at = e
    return unescape("".join(out))


def format_chats(rows: DataFrame, tokenizer_path: str, *, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, input_ids, starts, ends and loss_mask of each conversation."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(tokenizer_path)
        for b in batches:
            out = []
            for turns in b["turns"]:
                text, spans = render([(x["role"], x["text"]) for x in turns], trained)
                e = t.encode(text, add_special_tokens=False)
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                out.append((text, e.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets[:, 0], offsets[:, 1], spans)))
            names = ["formatted", "input_ids", "starts", "ends", "loss_mask"]
            yield pd.DataFrame(out, columns=names, index=b.index).astype({"formatted": object}).assign(conv_id=ids_of(b, "conv"))[["conv_id", *names]]

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")))).alias("turns")
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns)
    return whole.select(*id_columns(F.col("conv_id"), "conv"), "turns").mapInPandas(encode, "conv_id long, formatted string, input_ids array<int>, starts array<long>, ends array<long>, loss_mask array<tinyint>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back of format_chats()'s output, as counts and digests."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, starts, ends, mask in zip(b["formatted"], b["starts"], b["ends"], b["loss_mask"], strict=True):
                turns, loss = parse(text), masked_text(text, np.asarray(starts), np.asarray(ends), np.asarray(mask))
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            x = pd.DataFrame(out, columns=names, index=b.index).astype({"turns_sha256": object, "loss_sha256": object})
            yield x.assign(conv_id=ids_of(b, "conv"))[["conv_id", *names]]

    d = formatted.select(*id_columns(F.col("conv_id"), "conv"), "formatted", "starts", "ends", "loss_mask")
    return d.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
