"""Benchmark decontamination: Wu-Manber search for the windows of many test strings at once.

Words are the symbols. An item's windows are its runs of ``WINDOW`` words; an item with fewer is one window as
a whole, so patterns have up to ``WINDOW`` lengths, each searched on its own. For each length a shift table has, by the
hash of a block of two words, how far the search may jump: to where a block of some window could end next. Where it may not jump,
the block's bucket has the windows that end with it; these are compared with the text, first by the hashes
of all their words, then by their bytes. A slice of texts is cut into strips whose cursors move side by side.

The items pass through the driver in blocks of ``BLOCK_BYTES`` of text, and each block is broadcast; documents pass
all blocks in one stage, without a shuffle, whatever the number of items.

Defined results: a null text has no words; texts of any length are searched whole; equal rows give equal results, rows of one id stay
apart; items that repeat an id are one item with the windows of all of them; items without an id mark words but aren't named;
without an item nothing is hit; other columns are kept by ``search`` if they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import slices, table, text_column
from colligate.llm.shingles import mix
from colligate.llm.words import Words, kinds, words_of

# What isn't a word's byte, once A-Z are lower-cased.
BETWEEN = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
KINDS = kinds(BETWEEN)
#: Words in a window.
WINDOW = 10
#: Bytes of items that are searched for at once.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are searched at once, and words in a strip.
SLICE_BYTES, STRIP = 2 << 20, 64
_BLOCK = np.uint64(0x9E3779B97F4A7C15)


class Patterns(NamedTuple):
    """The different windows of one length: where each starts in the items' words, the shift table, the windows
    sorted by bucket, where each bucket starts, and for each window its items."""

    width: int
    start: np.ndarray
    shift: np.ndarray
    bucket: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    items_at: np.ndarray


class Index(NamedTuple):
    """What is searched for: the items' words as ``Words``, their patterns by length, the items' ids."""

    words: Words
    patterns: list[Patterns]
    ids: list[int | None]


def blocks_of(hashes: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of ``size`` words (1 or 2) that ends with each word of ``end``."""
    return hashes[end] if size == 1 else mix(hashes[end - 1] * _BLOCK + hashes[end])


def index(items: Sequence[tuple[int | None, str]], width: int = WINDOW) -> Index:
    """The shift and bucket tables of items (id, text)."""
    words = words_of(pa.array([t for _, t in items], pa.string()), KINDS)
    ids: list[int | None] = list(dict.fromkeys(i for i, _ in items))
    place = {x: k for k, x in enumerate(ids)}
    number = np.array([place[i] for i, _ in items], np.int64)
    sizes = np.diff(words.texts)
    found = []
    for m in sorted({min(int(n), width) for n in sizes if n}):
        of = np.flatnonzero(sizes == m) if m < width else np.flatnonzero(sizes >= m)
        many = sizes[of] - m + 1
        start = np.repeat(words.texts[of] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        found.append(_patterns(words.hashes, start, np.repeat(number[of], many), m))
    return Index(words, found, ids)


def _patterns(hashes: np.ndarray, start: np.ndarray, item: np.ndarray, m: int) -> Patterns:
    whole = np.zeros(len(start), np.uint64)
    for j in range(m):
        whole = mix(whole * _BLOCK + hashes[start + j])
    _, first, same = np.unique(whole, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([same, item]), axis=1)
    items_at = np.searchsorted(pairs[0], np.arange(len(first) + 1))
    start = start[first]
    size = min(2, m)
    mask = (1 << max(12, (4 * len(start) * m).bit_length())) - 1
    shift = np.full(mask + 1, m - size + 1, np.uint8)
    for j in range(size, m + 1):  # later blocks allow smaller jumps
        shift[blocks_of(hashes, start + j - 1, size) & np.uint64(mask)] = m - j
    key = (blocks_of(hashes, start + m - 1, size) & np.uint64(mask)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    bounds = np.zeros(mask + 2, np.int32)
    np.cumsum(np.bincount(key, minlength=mask + 1), out=bounds[1:])
    return Patterns(m, start, shift, order, bounds, pairs[1], items_at)


def candidates(words: Words, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(last word, pattern): where the shift table stops the search, with each pattern of the bucket there."""
    n, size, mask = len(words.hashes), min(2, p.width), np.uint64(len(p.shift) - 1)
    at = np.maximum(np.arange(0, n, STRIP), p.width - 1)
    stop = np.minimum(np.arange(0, n, STRIP) + STRIP, n)
    ends, keys = [], []
    while True:
        on = at < stop
        at, stop = at[on], stop[on]
        if not len(at):
            break
        key = blocks_of(words.hashes, at, size) & mask
        jump = p.shift[key]
        here = jump == 0
        ends.append(at[here])
        keys.append(key[here].astype(np.int64))
        at = at + np.maximum(jump, 1)
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, key = np.concatenate(ends), np.concatenate(keys)
    inside = words.text[end] == words.text[end - p.width + 1]
    end, key = end[inside], key[inside]
    many = p.bounds[key + 1] - p.bounds[key]
    behind = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(end, many), p.bucket[np.repeat(p.bounds[key], many) + behind]


def occurrences(words: Words, of: Words, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(last word, pattern): the candidates whose words are those of the pattern, hash by hash and byte by byte."""
    end, pattern = candidates(words, p)
    for j in range(p.width):
        same = words.hashes[end - j] == of.hashes[p.start[pattern] + p.width - 1 - j]
        end, pattern = end[same], pattern[same]
    for j in range(p.width):
        same = _same_bytes(words, end - j, of, p.start[pattern] + p.width - 1 - j)
        end, pattern = end[same], pattern[same]
    return end, pattern


def _same_bytes(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether the words ``i`` of ``a`` are the words ``j`` of ``b``."""
    size = a.end[i] - a.at[i]
    same = size == b.end[j] - b.at[j]
    for n in np.unique(size[same]):
        rows = np.flatnonzero(same & (size == n))
        for k in range(0, len(rows), max(1, (1 << 22) // int(n))):
            r = rows[k : k + max(1, (1 << 22) // int(n))]
            span = np.arange(int(n))
            same[r] = (a.data[a.at[i[r]][:, None] + span] == b.data[b.at[j[r]][:, None] + span]).all(axis=1)
    return same


def find(words: Words, index_: Index) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is hit; the different (text, item's number) as the rows of an array."""
    marks = np.zeros(len(words.hashes) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for p in index_.patterns:
        end, pattern = occurrences(words, index_.words, p)
        np.add.at(marks, end - p.width + 1, 1)
        np.add.at(marks, end + 1, -1)
        both = np.unique(np.stack([words.text[end], pattern], axis=1), axis=0)
        many = np.diff(p.items_at)[both[:, 1]]
        behind = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.stack([np.repeat(both[:, 0], many), p.items[np.repeat(p.items_at[both[:, 1]], many) + behind]], axis=1))
    return np.cumsum(marks)[:-1] > 0, np.unique(np.concatenate(pairs), axis=0)


def _spans(hit: np.ndarray, texts: np.ndarray) -> list[list[int]]:
    """For each text its hit words as start, end, start, end and so on, counted in its words."""
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    first = texts[:-1][texts[:-1] < texts[1:]]
    cut = first[(first > 0) & hit[first] & hit[first - 1]]  # spans end with their text
    at = np.sort(np.r_[np.flatnonzero(edge), cut, cut])
    bounds = np.searchsorted(at, texts[1:], side="right")
    out, k = [], 0
    for base, b in zip(texts[:-1].tolist(), bounds.tolist(), strict=True):
        b -= (b - k) % 2  # what starts where this text ends is the next one's
        out.append((at[k:b] - base).tolist())
        k = b
    return out


def _search(index_: Broadcast, last: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index_.value
        for part in slices(batches, "_text", SLICE_BYTES):
            words = words_of(part.column("_text"), KINDS)
            hit, pairs = find(words, own)
            for t, spans in enumerate(part.column("_spans").to_pylist()):
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    hit[words.texts[t] + a : words.texts[t] + b] = True
            named: list[set[int]] = [set(x) for x in part.column("_items").to_pylist()]
            for t, k in pairs.tolist():
                if own.ids[k] is not None:
                    named[t].add(own.ids[k])
            values = {"_n": pa.array(np.diff(words.texts), pa.int64()), "_spans": pa.array(_spans(hit, words.texts), pa.list_(pa.int32())), "_items": pa.array([sorted(x) for x in named], pa.list_(pa.int64()))}
            if last:
                values["_text"] = pa.nulls(part.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([values.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)

    return work


def _in_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items (id, text) in blocks; the driver has one at a time."""
    block, size = [], 0
    for i, t in items.toLocalIterator():
        if block and size + len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ``keep``, n_words, spans, items) of every document: the spans of words that are hit, as (first, end) in its
    words, end exclusive, and the ids of the items (item_id, text) with a window in it, ascending."""
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    indexes = [spark.sparkContext.broadcast(index(b, width)) for b in _in_blocks(named, block_bytes)] or [spark.sparkContext.broadcast(index([], width))]
    kept = [F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("_id"), *kept, text_column(text_col).alias("_text"), F.lit(0).cast("long").alias("_n"), F.array().cast("array<int>").alias("_spans"), F.array().cast("array<long>").alias("_items"))
    kinds_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for k, index_ in enumerate(indexes):
        rows = rows.mapInArrow(_search(index_, k == len(indexes) - 1), kinds_)
    spans = F.transform(F.sequence(F.lit(0), F.size("_spans") - 2, F.lit(2)), lambda i: F.struct(F.get("_spans", i).alias("first"), F.get("_spans", i + 1).alias("end")))
    none = F.array().cast("array<struct<first:int,end:int>>")
    return rows.select(F.col("_id").alias(id_col), *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)), F.col("_n").alias("n_words"), F.when(F.size("_spans") > 0, spans).otherwise(none).alias("spans"), F.col("_items").alias("items"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null
), k as (
  select item_id, ws, least(len(ws), 10) as m from i where len(ws) > 0
), p as (
  select distinct item_id, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda x: array_to_string(ws[x : x + m - 1], ' '))) as win from k
), g as (
  select r, m, unnest(range(1, len(ws) - m + 2)) as x, unnest(list_transform(range(1, len(ws) - m + 2), lambda x: array_to_string(ws[x : x + m - 1], ' '))) as win
  from d, (select distinct m from k) where len(ws) >= m
), f as (
  select g.r, g.m, g.x, p.item_id from g join p using (m, win)
), h as (
  select r, count(distinct x + o) as n_hit from (select distinct r, m, x from f) cross join (select unnest(range(10)) as o) where o < m group by r
), s as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from f where item_id is not null) group by r
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join s using (r)
"""
