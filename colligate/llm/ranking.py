"""Ranked lexical search, reversed: documents stream through an index of the items.

The items' terms are the vocabulary. One pass over the texts counts each document's terms and its occurrences of the vocabulary;
these counts are kept, statistics (documents, lengths, documents of each term) are
sums over them. Then an inverted index from terms to items is broadcast, the documents' counts stream
through it, and each item has a heap of its ``k`` best documents so far; documents that can't
enter a heap are left out at once. The heaps of all tasks are merged, in parts first.

Items pass through the driver in blocks of ``BLOCK_TERMS`` terms, each block broadcast on its own, so that the index is bounded whatever
the number of items. All arithmetic but the logarithm is in 64-bit integers.

Defined results: null, empty and term-less texts count nowhere; texts of any length are counted whole; rows that repeat an id are
documents of their own, equal scores by ascending id; documents without an id count in the statistics but aren't returned; items that
repeat an id are one item with the terms of all of them, items without an id, text or term have no rows; equal 64-bit hashes
stand for equal terms; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colligate.llm.common import slices, stored, table, text_column
from colligate.llm.words import kinds, words_of

# Bytes that are in no term.
BETWEEN = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
KINDS = kinds(BETWEEN)
#: Documents that each item gets.
BEST = 10
#: Terms of items, with repeats among items, in a block.
BLOCK_TERMS = 1 << 20
#: Scores (documents times items) that are held at once, and postings that are added at once.
SCORES, POSTINGS = 1 << 21, 1 << 20
SLICE_BYTES = 2 << 20
#: Parts in which an item's heaps are merged first.
PARTS = 64


class Vocabulary(NamedTuple):
    """Hashes of the items' terms, sorted, and a table that finds most of them at once: by a hash's last bits, a
    place in the sorted hashes, or -1."""

    hashes: np.ndarray
    slots: np.ndarray


def vocabulary(hashes: np.ndarray) -> Vocabulary:
    hashes = np.unique(hashes)
    slots = np.full(1 << max(10, (8 * len(hashes)).bit_length()), -1, np.int32)
    slots[hashes & np.uint64(len(slots) - 1)] = np.arange(len(hashes), dtype=np.int32)
    return Vocabulary(hashes, slots)


def look_up(v: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in ``v``, or -1."""
    if not len(v.hashes):
        return np.full(len(hashes), -1, np.int64)
    at = v.slots[hashes & np.uint64(len(v.slots) - 1)].astype(np.int64)
    rest = np.flatnonzero((at >= 0) & (v.hashes[at] != hashes))  # another term has the slot
    place = np.minimum(np.searchsorted(v.hashes, hashes[rest]), len(v.hashes) - 1)
    at[rest] = np.where(v.hashes[place] == hashes[rest], place, -1)
    return at


def count_terms(docs: DataFrame, known: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: its terms with repeats, and its occurrences of known terms, by
    their hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        for part in slices(batches, "text", SLICE_BYTES):
            words = words_of(part.column("text"), KINDS)
            n = np.diff(words.texts)
            at = look_up(v, words.hashes)
            met = at >= 0
            keys, counts = np.unique(words.text[met] * max(1, len(v.hashes)) + at[met], return_counts=True)
            doc, term = np.divmod(keys, max(1, len(v.hashes)))
            some = np.flatnonzero(n)
            offsets = pa.array(np.r_[np.searchsorted(doc, some), len(doc)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(some)), pa.array(n[some], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(v.hashes[term].view(np.int64), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                names=["id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_column(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, n long, terms array<long>, tfs array<int>")


class Postings(NamedTuple):
    """The inverted index of a block of items: the vocabulary, each term's weight, where its items start in
    ``items`` (and one more), the items' ids, and the numbers of the whole collection."""

    terms: Vocabulary
    weights: np.ndarray
    at: np.ndarray
    items: np.ndarray
    ids: list[int]
    documents: int
    length: int


def contributions(tf: np.ndarray, n: np.ndarray, p: Postings) -> np.ndarray:
    """What occurrences of a term in documents of ``n`` terms count for, before the term's weight."""
    m = 10 + 90 * n * p.documents // p.length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Heaps:
    """For each item its ``k`` best (score, -document), the worst one first."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.ones(n, np.int64)  # lower scores can't enter

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes the scores (documents times items)."""
        doc, item = np.nonzero(scores >= self.least)
        score = scores[doc, item]
        order = np.lexsort((ids[doc], -score, item))
        doc, item, score = doc[order], item[order], score[order]
        first = np.searchsorted(item, np.arange(len(self.heaps)))
        ahead = np.arange(len(item)) - first[item] < self.k
        for d, i, s in zip(ids[doc[ahead]].tolist(), item[ahead].tolist(), score[ahead].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def best_of_tasks(counts: DataFrame, index: Broadcast, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's ``k`` best documents of every item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = index.value
        heaps, step = Heaps(len(p.ids), k), max(1, SCORES // max(1, len(p.ids)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                part = whole.slice(a, step)
                ids, scores = part.column("id").to_numpy(zero_copy_only=False), np.zeros(part.num_rows * len(p.ids), np.int64)
                size = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), size)
                term = look_up(p.terms, part.column("terms").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                met = term >= 0
                doc, term, tf = doc[met], term[met], tf[met]
                n = part.column("n").to_numpy(zero_copy_only=False)
                value = p.weights[term] * contributions(tf, n[doc], p)
                many = p.at[term + 1] - p.at[term]
                upto = np.cumsum(many)
                i = 0
                while i < len(many):  # postings are walked in runs of bounded length, or those of one term
                    j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + POSTINGS, side="right")))
                    own = many[i:j]
                    behind = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                    item = p.items[np.repeat(p.at[term[i:j]], own) + behind]
                    np.add.at(scores, np.repeat(doc[i:j], own) * len(p.ids) + item, np.repeat(value[i:j], own))
                    i = j
                heaps.offer(ids, scores.reshape(part.num_rows, len(p.ids)))
        rows = [(p.ids[i], -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return counts.filter("id is not null and size(terms) > 0").mapInArrow(work, "item_id long, doc_id long, score long")


def _blocks(terms: DataFrame, most: int) -> Iterator[list[tuple[int, list[int]]]]:
    """Items (item_id, terms) in blocks of about ``most`` terms; the driver has one at a time."""
    block, size = [], 0
    for item, own in terms.toLocalIterator():
        if block and size + len(own) > most:
            yield block
            block, size = [], 0
        block.append((item, own))
        size += len(own)
    if block:
        yield block


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the hashes of the different terms of each item (item_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            words = words_of(part.column("text"), KINDS)
            item = part.column("item_id").to_numpy(zero_copy_only=False)[words.text]
            rows = np.unique(np.stack([item, words.hashes.view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64())], names=["item_id", "term"])

    rows = items.filter("item_id is not null").select(F.col("item_id").cast("long"), text_column("text").alias("text"))
    return rows.mapInArrow(work, "item_id long, term long").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item (item_id, text)."""
    spark = docs.sparkSession
    terms = stored(item_terms(items), "item-terms")
    parts = [_ranked_block(docs, block, id_col, text_col, k) for block in _blocks(terms, block_terms)]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for p in parts[1:]:
        best = best.union(p)
    return best


def _ranked_block(docs: DataFrame, block: list[tuple[int, list[int]]], id_col: str, text_col: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    hashes = np.array([h for _, own in block for h in own], np.int64)
    v = vocabulary(hashes.view(np.uint64))
    counts = stored(count_terms(docs, sc.broadcast(v), id_col, text_col), "counts")
    total = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # as many rows as the block has terms
    in_docs = np.zeros(len(v.hashes), np.int64)
    in_docs[look_up(v, np.array([r["term"] for r in df], np.int64).view(np.uint64))] = [r["df"] for r in df]
    weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * d + 1))) for d in in_docs.tolist()], np.int64)
    term = look_up(v, hashes.view(np.uint64))
    item = np.repeat(np.arange(len(block)), [len(own) for _, own in block])
    order = np.lexsort((item, term))
    at = np.searchsorted(term[order], np.arange(len(v.hashes) + 1))
    index = Postings(v, weights, at, item[order], [i for i, _ in block], total["n"], max(1, total["l"]))
    found = best_of_tasks(counts, sc.broadcast(index), k).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    order_by = [F.desc("score"), F.asc("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order_by))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order_by))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), c as (
  select count(*)::bigint as nn, sum(len(ws))::bigint as ll from d where len(ws) > 0
), q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark where item_id is not null
), o as (
  select r, doc_id, n, term, count(*)::bigint as tf from (select r, doc_id, len(ws)::bigint as n, unnest(ws) as term from d) where term in (select term from q) group by all
), t as (
  select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from o, c group by term, nn
), s as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
  from q join o using (term) join t using (term), c where doc_id is not null group by item_id, r, doc_id
), k as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0
)
select item_id, rank::integer as rank, doc_id, score from k where rank <= 10
"""
