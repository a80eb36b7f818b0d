"""Texts cut where byte-level BPE can't merge across, and their ids by distinct segment.

A cut stands before a run of white space that begins with a space or a line feed.  The usual pre-tokenizer of byte-level
BPE never puts white space behind another character in one piece and looks at nothing before a piece, so what stands
between two cuts is encoded as it is inside the whole text.  A tokenizer with another pre-tokenizer, with a normaliser or
with an entry that holds a space or a line feed behind another character is refused.

Defined results: an empty text has no segment; white space at the end of a text is a segment of its own.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from tessera.llm import textbatch
from tessera.llm.bitpack import LONG, Encoder

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_JOINED = re.compile(r"[^\s][ \n]")
#: Segments that one string to encode holds.
RUN = 64


def _after_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space of any script ends before each place."""
    x1, x2, x3 = (data[np.maximum(at - i, 0)] for i in (1, 2, 3))
    two = (x2 == 0xC2) & ((x1 == 0x85) | (x1 == 0xA0))
    general = (x3 == 0xE2) & (((x2 == 0x80) & ((x1 <= 0x8A) | (x1 == 0xA8) | (x1 == 0xA9) | (x1 == 0xAF))) | ((x2 == 0x81) & (x1 == 0x9F)))
    other = ((x3 == 0xE1) & (x2 == 0x9A) & (x1 == 0x80)) | ((x3 == 0xE3) & (x2 == 0x80) & (x1 == 0x80))
    return _BLANK[x1] | two | ((x1 >= 0x80) & (general | other))


def cut(w: textbatch.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the segments of the texts in `w`: bytes, and for text i the segments first[i]..first[i+1]-1."""
    data, offsets = w.data, w.offsets
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    inner = np.ones(len(data) + 1, bool)
    inner[offsets] = False
    at = at[inner[at]]
    at = at[~_after_blank(data, at)]
    full = offsets[:-1][np.diff(offsets) > 0]
    start = np.sort(np.concatenate([at, full]))
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(start, offsets)


def byte_lengths(tokenizer) -> np.ndarray:
    """Bytes that each id stands for; byte-level entries have a character for each byte."""
    size = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for entry, i in tokenizer.get_vocab(with_added_tokens=False).items():
        size[i] = len(entry)
    for i, added in tokenizer.get_added_tokens_decoder().items():
        size[i] = len(added.content.encode())
    return size


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level entries: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load(path: str, plain: bool):
    """The tokenizer of a file if texts may be cut for it.  plain: strings of special tokens in a text are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    form = json.loads(tokenizer.to_str())
    pre = form["pre_tokenizer"] or {}
    if form["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError("this tokenizer isn't byte-level BPE with its usual pieces")
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added):
        raise ValueError("this tokenizer has added tokens that take in white space")
    own, special = _byte_of(), {t.content for t in added}
    if any(_JOINED.search(bytes(own[c] for c in entry).decode(errors="replace")) for entry in tokenizer.get_vocab(with_added_tokens=False) if entry not in special):
        raise ValueError("this tokenizer merges across cuts")
    return tokenizer


def encoded(tokenizer, sizes: np.ndarray, segments: list[str]) -> list[np.ndarray]:
    """The ids of each segment.  Segments that stay segments when they are joined are encoded in strings of RUN, whose ids
    are told apart by the bytes they stand for."""
    out: list = [None] * len(segments)
    joins = [x[:1] in (" ", "\n") and not x[-1].isspace() and len(x) < LONG for x in segments]
    order = [i for i, ok in enumerate(joins) if ok]
    runs = [order[i : i + RUN] for i in range(0, len(order), RUN)]
    for run, e in zip(runs, tokenizer.encode_batch_fast(["".join([segments[i] for i in run]) for run in runs], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        ends = np.cumsum([len(segments[i].encode()) for i in run])
        cuts = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
        for i, a, b in zip(run, np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
            out[i] = ids[a:b]
    rest = [i for i, ok in enumerate(joins) if not ok]
    for i, e in zip(rest, tokenizer.encode_batch_fast([segments[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, np.uint32)
    return out


class SegmentEncoder(Encoder):
    """Ids of whole texts by segment: found and told apart as arrays, encoded once in a process, gathered from its pool."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer = load(path, plain=False)
        self.end = np.uint32(end_id)
        self._sizes = byte_lengths(self.tokenizer)
        self._forget()

    def pieces_of(self, w: textbatch.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return cut(w)

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        return encoded(self.tokenizer, self._sizes, words)


_encoders: dict[tuple[str, int], SegmentEncoder] = {}


def encoder(path: str, end_id: int) -> SegmentEncoder:
    """This process's encoder for the file at `path`."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = SegmentEncoder(path, end_id)
    return _encoders[path, end_id]
