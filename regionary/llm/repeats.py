"""Exact removal of long repeats through run-length indexes.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else. The work is cut so
that every index is small, and nothing is lost by the cut:

* Anchors. Every window of ``LENGTH`` bytes elects the 64-byte string in it with the least hash, leftmost
  first. Equal windows elect equal strings at equal offsets, so they meet under one anchor. Neighbouring
  windows with one anchor make a segment; equal segments are counted, not multiplied.
* Index. An anchor's different segments go to a shard of about ``SHARD`` bytes. There a run-length
  Burrows-Wheeler transform is built. Match lengths with the neighbours in suffix order are measured at
  sampled run ends only and streamed along the text: inside a run the length falls by one from
  position to position. A position whose match reaches ``LENGTH`` starts a repeated window.
* Hot anchors. An anchor with more than ``SHARD`` bytes of different segments (a line that a third of all
  documents hold) is divided by what its windows share: pieces of ``FINE`` windows are keyed by the
  bytes common to all of them, and at last single windows by all their bytes. So no group grows
  without bound, and none is dropped.

Defined results: texts are UTF-8; null is empty; texts under ``LENGTH`` bytes lose nothing; repeated rows are
repeats of each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .neardup import _groups

LENGTH = 400
GRAM = 64
SHARD = 1 << 20
FINE = 32
CHUNK = 1 << 19
SEPARATOR = 0xFF

_BYTES = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 20) - 1)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hash of every string of ``GRAM`` bytes, by doubling."""
    h = _BYTES[x]
    k = 1
    while k < GRAM:
        h = h[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        h ^= h >> np.uint64(29)
        k *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(x: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, anchor's place, anchor's hash) for runs of windows with one anchor."""
    span = LENGTH - GRAM + 1
    for base in range(0, len(x) - LENGTH + 1, CHUNK):
        part = x[base : base + CHUNK + LENGTH - 1]
        h = gram_hashes(part)
        m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= span:
            m = np.minimum(m[: len(m) - k], m[k:])
            k *= 2
        if k < span:
            m = np.minimum(m[: len(m) - (span - k)], m[span - k :])
        at = (m & _LOW).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(at)]]) - 1
        place = at[first]
        yield from zip((first + base).tolist(), (last + base).tolist(), (place + base).tolist(), h[place].view(np.int64).tolist(), strict=True)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for key, body in zip(batch.column("text_key").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if len(body) >= LENGTH:
                for a, b, p, h in anchors(np.frombuffer(body, np.uint8)):
                    out.append((h, xxhash.xxh3_128_digest(body[a : b + LENGTH], seed=p - a), key, a, b - a + 1, p - a))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "segment", "text_key", "first", "windows", "lead"])


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, parts in zip(batch.column("body").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            out += [(p["anchor"], p["segment"], p["copies"], p["lead"], body[p["first"] : p["first"] + p["windows"] + LENGTH - 1]) for p in parts]
        yield _table(out)


SEGMENT = "anchor long, segment binary, copies long, lead int, body binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "segment", "copies", "lead", "body"])


def suffix_array(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of separated texts by prefix doubling; every separator counts as a letter of its own.

    ``ends`` is the place of each position's next separator. Only groups that are still tied are sorted again.
    """
    n = len(x)
    place = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        inside = place + k < ends
        key = key * 257 + np.where(inside, x[np.minimum(place + k, n - 1)].astype(np.int64) + 1, 0)
    order = np.lexsort((place, key))
    sorted_key = key[order]
    short = (ends - place < 7)[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | short[1:] | short[:-1]
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    h = 7
    while len(slots):
        who = order[slots]
        comp = rank[who] * (n + 1) + rank[np.minimum(who + h, n - 1)] + 1
        by = np.argsort(comp, kind="stable")
        who, comp = who[by], comp[by]
        order[slots] = who
        fresh = np.ones(len(slots), bool)
        fresh[1:] = comp[1:] != comp[:-1]
        start = np.flatnonzero(fresh)
        rank[who] = np.repeat(slots[start], np.diff(np.append(start, len(slots))))
        keep = ~fresh
        keep[:-1] |= ~fresh[1:]
        slots = slots[keep]
        h *= 2
    return order


def match_lengths(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per position the longest match with any other position, streamed from sampled run ends.

    Where the transform's letter is that of the slot before, the pair's match is one shorter than that of
    the pair one position to the left; so only the slots where a run begins are measured.
    """
    n = len(x)
    sa = suffix_array(x, ends)
    bwt = x[sa - 1]
    head = np.ones(n, bool)
    head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == SEPARATOR)
    head[0] = False
    runs = np.flatnonzero(head)
    a, b = sa[runs - 1], sa[runs]
    most = np.minimum(ends[a] - a, ends[b] - b)
    wide = np.concatenate([x, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= wide[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    length = np.zeros(len(runs), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        p, q = a[live] + length[live], b[live] + length[live]
        differ = words[p] ^ words[q]
        same = differ == 0
        # the lowest set byte of the difference ends the match
        low = differ & (~differ + np.uint64(1))
        length[live] += np.where(same, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        live = live[same & (length[live] < most[live])]
    length = np.minimum(length, most)
    out = np.zeros(n, np.int64)
    place = np.arange(n)
    for sample in (a, b):
        value = np.full(n, 0, np.int64)
        np.maximum.at(value, sample, length + sample)
        out = np.maximum(out, np.maximum.accumulate(value) - place)
    return np.minimum(out, ends - place)


def repeated_windows(bodies: list[bytes]) -> list[list[tuple[int, int]]]:
    """Per body the ranges (first, last) of windows that start elsewhere in the bodies too."""
    mark = bytes([SEPARATOR])
    x = np.frombuffer(mark.join(bodies) + mark, np.uint8)
    size = np.array([len(b) for b in bodies])
    stop = np.cumsum(size + 1) - 1
    ends = np.repeat(stop, size + 1)
    hit = match_lengths(x, ends) >= LENGTH
    out = []
    for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True):
        own = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
        out.append([(int(s), int(e) - 1) for s, e in own.reshape(-1, 2)])
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, "shard"):
        found = repeated_windows(t.column("body").to_pylist())
        out = [(k, s, a, b) for k, s, spans in zip(t.column("anchor").to_pylist(), t.column("segment").to_pylist(), found, strict=True) for a, b in spans]
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "segment", "a", "b"])


def _pieces(width: int):
    """Cuts segments into pieces of up to ``width`` windows, keyed by the bytes that all windows of a piece share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, more = [], []
            for anchor, segment, copies, lead, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "copies", "lead", "body")), strict=True):
                last = len(body) - LENGTH
                j = 0
                while j <= last:
                    bucket = (lead - j) // width
                    end = min(last, lead - bucket * width)
                    # what the whole bucket's windows share, also where the segment holds only some of them
                    core = body[lead - bucket * width : lead - (bucket + 1) * width + 1 + LENGTH]
                    key = xxhash.xxh3_64_intdigest(core, seed=xxhash.xxh3_64_intdigest(f"{anchor}:{bucket}".encode()))
                    piece = body[j : end + LENGTH]
                    out.append((key - (1 << 64) if key >> 63 else key, xxhash.xxh3_128_digest(piece, seed=(lead - j) % width), copies, lead - j, piece))
                    more.append((anchor, segment, j))
                    j = end + 1
            t = _table(out)
            cols = list(zip(*more, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*t.columns, *(pa.array(list(c), k) for c, k in zip(cols, [pa.int64(), pa.binary(), pa.int32()], strict=True))], names=[*t.schema.names, "of_anchor", "of_segment", "at"])

    return run


def _marks(scratch: Scratch, segments: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(anchor, segment, a, b): ranges of repeated windows within segments, each of which is there once with its copies."""
    sure = segments.filter("copies > 1").select("anchor", "segment", F.lit(0).alias("a"), (F.length("body") - LENGTH).cast("int").alias("b"))
    single = segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.length("body")).alias("bytes"), F.min("copies").alias("least")).filter("kinds > 1 and least < 2")
    single = scratch.save(single)
    total = single.filter(F.col("bytes") <= SHARD).agg(F.sum("bytes").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD))
    sized = segments.join(single.select("anchor", "bytes"), "anchor")
    light = sized.filter(F.col("bytes") <= SHARD).select("anchor", "segment", "body", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    out = sure.unionByName(light.repartition(F.xxhash64("shard")).sortWithinPartitions("shard").mapInArrow(_shard, "anchor long, segment binary, a int, b int"))
    if not widths or single.filter(F.col("bytes") > SHARD).isEmpty():
        return out
    heavy = sized.filter(F.col("bytes") > SHARD).drop("bytes")
    pieces = scratch.save(heavy.mapInArrow(_pieces(widths[0]), SEGMENT + ", of_anchor long, of_segment binary, at int"))
    kinds = pieces.groupBy("anchor", "segment").agg(F.sum("copies").alias("copies"), F.first("lead").alias("lead"), F.first("body").alias("body"))
    below = _marks(scratch, scratch.save(kinds), widths[1:])
    up = pieces.select("anchor", "segment", "of_anchor", "of_segment", "at").join(below, ["anchor", "segment"])
    return out.unionByName(up.select(F.col("of_anchor").alias("anchor"), F.col("of_segment").alias("segment"), (F.col("a") + F.col("at")).alias("a"), (F.col("b") + F.col("at")).alias("b")))


def kept_bytes(body: bytes, windows: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a body, and the number of maximal removed runs."""
    out, at, runs = [], 0, 0
    end = -1
    for a, b in sorted(windows):
        if a > end:
            out.append(body[at:a] if end < 0 else body[end:a])
            runs += 1
            end = b + LENGTH
        else:
            end = max(end, b + LENGTH)
        at = end
    out.append(body[at:])
    return b"".join(out), runs


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, runs, kept = [], [], [], []
        for body, found in zip(batch.column("body").to_pylist(), batch.column("found").to_pylist(), strict=True):
            left, n = kept_bytes(body, [(w["a"], w["b"]) for w in found or []])
            size.append(len(body))
            gone.append(len(body) - len(left))
            runs.append(n)
            kept.append(left)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that are left."""
    scratch = Scratch(docs.sparkSession, "repeats")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).withColumn("text_key", F.unhex(F.md5("body")))
    with scratch:
        found = scratch.save(rows.select("text_key", "body").mapInArrow(_anchor_rows, "anchor long, segment binary, text_key binary, first int, windows int, lead int"))
        segments = found.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("text_key", "first", "windows", "lead")).alias("at"))
        shared = segments.groupBy("anchor").agg(F.sum("copies").alias("all")).filter(F.col("all") > 1).select("anchor")
        segments = scratch.save(segments.join(shared, "anchor").select("anchor", "segment", "copies", "at.*"))
        where = segments.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "segment", "copies", "lead", "first", "windows")).alias("parts"))
        bodies = rows.filter(F.length("body") >= LENGTH).select("text_key", "body").join(where, "text_key")
        bodies = scratch.save(bodies.mapInArrow(_cut_segments, SEGMENT).dropDuplicates(["anchor", "segment"]))
        marks = scratch.save(_marks(scratch, bodies, (FINE, 1)).distinct())
        at = found.join(marks, ["anchor", "segment"]).select("text_key", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b")).distinct()
        at = scratch.save(at.groupBy("text_key").agg(F.collect_list(F.struct("a", "b")).alias("found")), keep=True)
    return rows.join(at, "text_key", "left").select("doc_id", "body", "found").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
