"""Exact token counts of every prefix of a text, for a byte-fallback BPE model of the sentencepiece library.

No piece of such a model has a space mark after another character, and none mixes letters with other characters, so a
text falls into segments (space marks and the letters, or the other characters, that follow; a line feed, which no piece
holds, is one by itself) that are encoded independently of each other.  A model with other pieces is refused.
Within a segment a dynamic program over its characters finds the last piece of each prefix's encoding: a piece t ends
the encoding of a prefix exactly if the pair (last piece before t, t) is what the model makes of the two pieces' text.
The count at a prefix is then the count where t begins, plus one.  What is stored is the step from each prefix to the
next, one signed byte a character: their running sum is the token count at every prefix, which answers budget and
truncation questions without encoding anything again.

Segments recur, so each process keeps the steps of up to `CACHE` of them; what is not kept is computed again.

Defined results: null counts as empty, and the empty text and the empty prefix have 0 tokens; prefixes end between code
points; repeated rows are counted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import columns_for

MARK = "▁"
CACHE = 700_000
START = 0xFFFFF
_SEGMENT = re.compile(rf"\n|{MARK}*[^\W\d_¹²³]+|{MARK}*(?:[\d_¹²³]|[^\w{MARK}\n])+|{MARK}+")


class PrefixCounter:
    """Prefix token counts under the model file at `path`."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.pieces = [self.model.id_to_piece(i) for i in usable]
        if any(len(_SEGMENT.findall(p)) != 1 for p in self.pieces):
            raise ValueError("this model has pieces that run across segments")
        self._ends = ahocorasick.Automaton()
        for at, piece in enumerate(self.pieces):
            self._ends.add_word(piece, (len(piece), at))
        self._ends.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._steps: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _encoded(self, piece_text: str) -> list[str]:
        """The pieces of marked text, without the mark that the library puts in front."""
        if piece_text.startswith(MARK):
            return self.model.encode(piece_text[1:].replace(MARK, " "), out_type=str) if len(piece_text) > 1 else [MARK]
        return self.model.encode("\n" + piece_text.replace(MARK, " "), out_type=str)[2:]

    def _joins(self, key: int) -> bool:
        left, right = key >> 20, self.pieces[key & 0xFFFFF]
        want = [right] if left == START else [self.pieces[left], right]
        found = self._encoded("".join(want)) == want
        if len(self._pairs) < 4 * CACHE:
            self._pairs[key] = found
        return found

    def _segment_counts(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment.  The automaton gives the pieces that end at each character, in order."""
        n, done, known = len(segment), 0, self._pairs
        count, last = [0] + [-1] * n, [START] * (n + 1)
        for end, (length, piece) in self._ends.iter(segment):
            end += 1
            if count[end] >= 0:
                continue
            while done < end - 1:  # no piece ends here: a character spelled in bytes, which never merges
                count[done + 1] = count[done] + len(segment[done].encode())
                done += 1
            key = last[end - length] << 20 | piece
            if (ok := known.get(key)) is None:
                ok = self._joins(key)
            if ok:
                count[end], last[end], done = count[end - length] + 1, piece, end
        while done < n:
            count[done + 1] = count[done] + len(segment[done].encode())
            done += 1
        return count

    def _segment_steps(self, segment: str) -> bytes:
        count = self._segment_counts(segment)
        made = bytes([(b - a) & 0xFF for a, b in zip(count, count[1:])])
        if len(self._steps) < CACHE and len(segment) < 64:
            self._steps[segment] = made
        return made

    def _marked_steps(self, marked: str) -> bytes:
        known, make = self._steps, self._segment_steps
        return b"".join([known.get(x) or make(x) for x in _SEGMENT.findall(marked)])

    def _word_steps(self, word: str) -> bytes:
        made = self._marked_steps(MARK + word.replace(" ", MARK))
        if len(self._words) < CACHE and len(word) < 64:
            self._words[word] = made
        return made

    def steps(self, text: str | None) -> bytes:
        """One signed byte for each code point: by how much the token count changes there.  The first also holds the
        mark in front of the text."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or "  " in text or MARK in text:  # marks side by side are one segment
            made = self._marked_steps(MARK + text.replace(" ", MARK))
        else:
            known, make = self._words, self._word_steps
            made = b"".join([known.get(x) or make(x) for x in text.split(" ")])
        first = int(np.frombuffer(made[:2], np.int8).sum())
        return np.int8(first).tobytes() + made[2:]

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., the text."""
        made = np.frombuffer(self.steps(text), np.int8)
        return np.concatenate([[0], np.cumsum(made, dtype=np.int64)])


def longest_within(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This process's counter for the model at `path`."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_steps(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_chars, steps): the stored steps of every prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            for part in _slices(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([own.steps(x) for x in texts], pa.binary())],
                    ["doc_id", "n_bytes", "n_chars", "steps"],
                )

    return columns_for(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, n_chars long, steps binary")


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def budgets(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_within): each text's tokens and the code points of its longest
    prefix of at most `limit` tokens, read off the prefix steps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            for part in _slices(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                stored = [own.steps(x) for x in texts]
                totals = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in stored]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(x.encode()) for x in texts], pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([n > limit for n in totals], pa.bool_()),
                        pa.array([len(x) if n <= limit else longest_within(s, limit) for x, n, s in zip(texts, totals, stored, strict=True)], pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"],
                )

    return columns_for(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")
