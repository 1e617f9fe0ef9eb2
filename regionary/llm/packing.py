"""Packing token ids into fixed windows by concatenate-and-cut.

Pass 1 tokenises every text and writes, per partition, each document's ids with its start
inside the partition. The partition totals (one row per partition) are prefix-summed, which
gives every document a global offset. Pass 2 cuts the concatenation at every multiple of the
window and emits one boundary record per piece; both passes are narrow, nothing is shuffled.

Defined results: a null text is an empty one (only the end id); null ids are carried; repeated
rows are packed once each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, memo

WINDOW = 4096
END_ID = 2
MEMO_WORDS = 400_000
#: About how much text is tokenised at once.
CHUNK = 2 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Token ids of texts through a memo of their chunks between ASCII white space.

    The vocabulary's pre-tokeniser drops white space and never joins across it, nor a run of letters with a run of marks, and lowers
    all letters first; so a text's ids are its chunks' ids in order, blanks may be put between letters and marks, and A-Z may be lowered.
    Arrow splits the texts and numbers the different chunks; those not in the memo are encoded together, parted by a
    character with an id of its own; ids are gathered by number. A text that holds that character or may hold a special
    token is encoded directly. A full memo keeps the chunks met since it was full last.
    """

    MARK = "\x00"
    DIRECT = r"\x00|<\|"
    LETTER_MARK = r"([a-zß-öø-ÿœ])([.,!?;:%&$*#|)])"

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end_id = end_id
        self.mark = self.direct(self.MARK)
        self._reset()

    def _reset(self) -> None:
        """Only the end id, at number 0."""
        self.slot: dict[str, int] = {}
        self.ids = np.array([self.end_id], self.dtype)
        self.first = np.zeros(1, np.int64)
        self.size = np.ones(1, np.int64)
        self.used = np.ones(1, bool)

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of lower-case letter words, which the pre-tokeniser would hand whole to the model."""
        tokenize, ids, size = self.tokenizer.model.tokenize, [], []
        for c in chunks:
            got = [t.id for t in tokenize(c)]
            ids += got
            size.append(len(got))
        return np.array(ids, self.dtype), np.array(size, np.int64)

    def _rest(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.direct(f" {self.MARK} ".join(chunks))
        at = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else ()
        if len(at) == len(chunks) - 1:
            return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        each = [self.direct(c) for c in chunks]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, chunks: list[str]) -> None:
        words, rest = [c for c in chunks if c.isascii() and c.isalpha()], [c for c in chunks if not (c.isascii() and c.isalpha())]
        chunks = words + rest
        parts = [part(c) for part, c in ((self._words, words), (self._rest, rest)) if c]
        ids, size = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        first = len(self.ids) + np.cumsum(size) - size
        self.slot.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.ones(len(chunks), bool)])

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        size = self.size[slots]
        place = np.arange(int(size.sum()))
        place += np.repeat(self.first[slots] - (np.cumsum(size) - size), size)
        return self.ids[place]

    def _forget(self) -> None:
        """Keep what was used since the last time, if that is half of the memo at most."""
        live = np.flatnonzero(self.used[1:]) + 1
        old, ids, first, size = self.slot, self.ids, self.first, self.size
        self._reset()
        if len(live) <= MEMO_WORDS // 2:
            number = np.full(len(size), -1)
            number[live] = np.arange(1, len(live) + 1)
            kept = [(c, int(number[k])) for c, k in old.items() if number[k] > 0]
            self.slot = dict(kept)
            place = np.concatenate([np.arange(first[k], first[k] + size[k]) for k in live]) if len(live) else np.zeros(0, np.int64)
            self.ids = np.concatenate([self.ids, ids[place]])
            self.size = np.concatenate([self.size, size[live]])
            self.first = np.concatenate([[0], 1 + np.cumsum(size[live]) - size[live]])
            self.used = np.zeros(len(self.size), bool)

    def many(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts without nulls, each followed by the end id, and how many each text has."""
        odd = pc.match_substring_regex(texts, self.DIRECT).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), self.LETTER_MARK, r"\1 \2"))
        number = words.flatten().dictionary_encode()
        chunks = number.dictionary.to_pylist()
        if len(self.slot) > MEMO_WORDS:
            self._forget()
        fresh = [c for c in chunks if c not in self.slot]
        if fresh:
            self._learn(fresh)
        of = np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))
        self.used[of] = True
        stop = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        slots = np.insert(of[number.indices.to_numpy()] if len(chunks) else of, stop, 0)
        ids = self._gather(slots)
        ends = np.concatenate([[0], np.cumsum(self.size[slots])])[np.arange(1, len(stop) + 1) + stop]
        n = np.diff(ends, prepend=0)
        if odd.any():
            parts = np.split(ids, ends[:-1])
            for k in np.flatnonzero(odd).tolist():
                parts[k] = np.append(self.direct(texts[k].as_py()), self.ids[:1])
            ids, n = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, n


def _tokens(path: str, end_id: int) -> WordTokens:
    """One memo per Python worker, kept from task to task."""
    return memo(f"tokens {end_id} {path}", lambda: WordTokens(path, end_id))


def _slices(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Consecutive parts of about ``CHUNK`` bytes; a longer text is a part of its own."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // CHUNK
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(texts)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            yield texts.slice(a, b - a)


def _pass_one(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path, end_id)
        width = tokens.dtype.itemsize
        part = TaskContext.get().partitionId()
        at = 0
        for batch in batches:
            docs = batch.column("doc_id").cast(pa.int64())
            row = 0
            for texts in _slices(pc.fill_null(batch.column("text"), "")):
                ids, n = tokens.many(texts)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                edge = np.concatenate([[0], np.cumsum(n)]) * width
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(row, len(n)), packed, pa.array(n, pa.int64()), pa.array(np.full(len(n), part)), pa.array(start, pa.int64()), pa.array(np.full(len(n), width, np.int32))],
                    names=["doc_id", "ids", "n", "part", "start", "width"],
                )
                row += len(n)

    return run


def _pass_two(offsets: dict[int, int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, ids, n, part, start, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "part", "start", "width")), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                first = offsets[part] + start
                at = 0
                while at < n:
                    sequence, offset = divmod(first + at, window)
                    length = min(n - at, window - offset)
                    rows.append((doc, at, length, zlib.crc32(wide[at : at + length].tobytes()), n, sequence, offset))
                    at += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7,
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document and place there, crc32 of its ids, sequence and offset.

    What reaches the driver is one total per partition of the input, as many numbers as there
    were tasks in pass 1. Every sequence but the last is full.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    schema = "doc_id long, ids binary, n long, part long, start long, width int"
    tokens = scratch.save(docs.select("doc_id", "text").mapInArrow(lean(_pass_one(tokenizer_path, end_id), keep=True), schema), keep=True)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()
    offsets: dict[int, int] = {}
    at = 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        offsets[part] = at
        at += n
    return tokens.mapInArrow(lean(_pass_two(offsets, window)), PIECES)
