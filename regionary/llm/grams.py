"""Hashed features of texts by way of a memo of words, and the bounded labelled sample."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import memo

BITS = 18
MEMO_WORDS = 250_000
LABELLED = 4000
#: Lengths of the word beginnings that are features beside the whole word.
STEMS = (5, 7)

_RUNS = re.compile(r"[a-zß-ÿœ]+|[A-ZÀ-ÞŒ]+|[0-9]+|(.)\1*", re.S)


def shape(word: str) -> str:
    """A word with its letters and digits blotted out: case, marks and their repetition stay."""
    out = []
    for m in _RUNS.finditer(word):
        run = m[0]
        c = run[0]
        if c.isalpha():
            out.append("a" if c.islower() else "A" if len(run) > 1 else "I")
        elif c.isdigit():
            out.append("0")
        else:
            out.append(run[:3])
    return "".join(out)


class Words:
    """Numbers words; by number it knows a word's hash, its stems' and its shape's, and whether a sentence ends there."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.plain = np.zeros(1 << 12, np.uint64)
        self.shape = np.zeros(1 << 12, np.uint64)
        self.last = np.zeros(1 << 12, bool)
        self.stems = np.zeros((1 << 12, len(STEMS)), np.uint64)

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        try:
            return np.array([number[w] for w in words], np.int64)
        except KeyError:
            pass
        if len(number) > MEMO_WORDS:
            self.clear()
            number = self.number
        for w in words:
            if w not in number:
                k = len(number)
                if k == len(self.plain):
                    self.plain, self.shape, self.last, self.stems = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.shape, self.last, self.stems))
                number[w] = k
                low = w.lower().strip(".,;:!?\"'()|%&$*#")
                self.plain[k] = xxhash.xxh64_intdigest(low)
                self.stems[k] = [xxhash.xxh64_intdigest(f"{low[:n]}\0{n}") if len(low) > n else 0 for n in STEMS]
                self.shape[k] = xxhash.xxh64_intdigest("\0" + shape(w))
                self.last[k] = w[-1] in ".!?…"
        return np.array([number[w] for w in words], np.int64)


def words_here() -> Words:
    """One memo per Python worker, kept from task to task."""
    return memo("words", Words)


def mod(name: str, m: int) -> Column:
    """crc32 of an id as text, modulo m."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, make: Callable, schema: str, most: int = LABELLED) -> list:
    """Features of a bounded sample of labelled documents: per class the ``most`` ids of least hash, one text each.

    The bound makes the sample safe to broadcast (two longs a row) and to bring to the driver.
    Where an id is labelled more than once, the larger label counts; of several texts of one id, the one of least hash.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rank = F.xxhash64("doc_id", F.lit(17))
    ends = [rows.filter(F.col("label") == k).orderBy(rank, "doc_id").limit(most) for k in (0, 1)]
    chosen = ends[0].unionByName(ends[1])
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    one = found.agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    return one.mapInArrow(make, schema).orderBy("doc_id").collect()
