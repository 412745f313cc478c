"""Phrase collocation mining with weighted acyclic automata.

A count transducer reads a phrase word by word and gives how often it occurs. Its states are prefixes of
n-grams; a state's weight is the number of n-grams that go through it, so that the count of every
phrase of up to ``LONGEST`` words is the weight of one state, and each word of the corpus adds one n-gram:
itself and the words behind it in its piece.

Tasks sum the n-grams of their shards, a few for each core, and write them sorted. The n-grams of all shards are
dealt to ranges of prefixes and sorted; in each range the transducer is built from them incrementally, in batches: an n-gram
shares the states of the prefix that it has in common with the one before it, and gets new states for the rest; a state is
closed, and its weight final, when the next n-gram leaves it. Closed states that are too light are
dropped; those on the first and last path of a batch, which may go on in its neighbours, are
passed on whatever their weight, and sums unite them. Weights make equal futures rare, so states aren't merged
at their ends. Phrases' parts are looked up by composing: parts are joined with the states that read them.

A phrase can't be more frequent than its words, pairs of words and triples of words. Before n-grams are gathered, words and then
pairs are counted by their hashes, and the frequent ones set bits of a table of fixed size. Triples of frequent pairs are too many for a row
each: their hashes share the cells of a table of counts, which grows with the corpus up to the size of the others, and cells that are heavy
enough set bits. N-grams end where a bit isn't set. The tables never lose a frequent phrase; the more frequent pairs and heavy cells
there are for their size, the more n-grams are gathered for nothing.

Defined results: null texts are empty, a null language is ``und``; texts of any length are read whole (a slice has one at least);
repeated rows count as often; a language without a frequent phrase has no row; other columns are ignored. Inside a shard equal 64-bit hashes
stand for equal n-grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colligate.llm.common import arrow_batches, discard, slices, stored, table, text_column
from colligate.llm.shingles import mix
from colligate.llm.words import Words, joined, kinds, words_of

# What separates words, and what ends a piece.
KINDS = kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
UNDETERMINED = "und"
#: Words of the longest phrase; occurrences of a candidate; phrases of a language.
LONGEST, LEAST, BEST = 5, 100, 2000
#: Bits of a table of frequent hashes (16 MB).
FILTER_BITS = 1 << 27
_ROW_BITS = 1 << 15
#: Words of the corpus for a cell in which triples are counted; rows of cells that a task gives at once.
CELL_WORDS, CELL_ROWS = 16, 64
#: Shards for each core, at most.
SHARDS = 2
#: Bytes of text that are split at once; different keys, and bytes of n-grams, that a task sums before it writes them.
SLICE_BYTES, KEYS, GRAM_BYTES = 1 << 20, 1 << 20, 32 << 20
#: Rows that a task gets, and gives, at once; neither side of a Python worker holds more than these beside its sums.
ROWS_IN, ROWS_OUT = 512, 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Tally:
    """Sums counts by key; ``full`` when it should be emptied."""

    def __init__(self) -> None:
        self.keys, self.counts, self.pending, self.full = [], [], 0, False

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.pending += len(keys)
        if self.pending > 2 * KEYS:
            self._sum()
            self.full = self.pending > KEYS

    def _sum(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)]
        self.keys, self.pending = [keys], len(keys)

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            self._sum()
        out = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return out


class Grams:
    """The different n-grams of a shard with their counts. Each n-gram's text is kept once, whatever number of batches have it."""

    def __init__(self) -> None:
        self.keys, self.at, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.langs: list[pa.Array] = []
        self.phrases: list[pa.Array] = []
        self.nbytes = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds counts of different sorted keys; whether each key is new, so that ``named`` must tell what it is."""
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        self.counts[self.at[place[known]]] += counts[known]
        new = ~known
        self.at = np.insert(self.at, place[new], len(self.counts) + np.arange(int(new.sum())))
        self.keys = np.insert(self.keys, place[new], keys[new])
        self.counts = np.concatenate([self.counts, counts[new]])
        return new

    def named(self, langs: pa.Array, phrases: pa.Array) -> None:
        self.langs.append(langs)
        self.phrases.append(phrases)
        self.nbytes += phrases.nbytes

    def empty(self) -> Iterator[pa.RecordBatch]:
        """(lang, words, n) of all, sorted, ``ROWS_OUT`` at once."""
        if len(self.counts):
            counts, langs, phrases = self.counts, pa.concat_arrays(self.langs), pa.concat_arrays(self.phrases)
            self.__init__()
            order = pc.sort_indices(pa.table([langs, phrases], names=["lang", "phrase"]), sort_keys=[("lang", "ascending"), ("phrase", "ascending")])
            for i in range(0, len(order), ROWS_OUT):
                own = order.slice(i, ROWS_OUT)
                n = pa.array(counts[own.to_numpy()], pa.int64())
                yield pa.RecordBatch.from_arrays([langs.take(own), pc.split_pattern(phrases.take(own), " "), n], names=["lang", "words", "n"])


def _words(part: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """The words of the texts of a batch, and their hashes with those of their languages."""
    words = words_of(part.column("text"), KINDS)
    tongue = part.column("tongue").to_numpy(zero_copy_only=False).view(np.uint64)
    return words, mix(words.hashes ^ tongue[words.text])


def _pairs(words: Words, keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word with the next one, and whether that is in its piece and both are frequent."""
    good = is_set(known, keys)
    good = good[:-1] & good[1:] & (words.piece[:-1] == words.piece[1:]) if len(keys) else good
    return mix(keys[:-1] * _ODD + keys[1:]), good


def is_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _keyed(batches: Iterator[pa.RecordBatch], known: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(lang, key, n): counts of words' keys, or of pairs' of known words; without a key those of all words of a language."""
    tally, totals = Tally(), Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        keys, counts = tally.empty()
        for i in range(0, len(keys), ROWS_OUT):
            own = keys[i : i + ROWS_OUT].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.string()), pa.array(own, pa.int64()), pa.array(counts[i : i + ROWS_OUT], pa.int64())], names=["lang", "key", "n"])

    for part in slices(batches, "text", SLICE_BYTES):
        words, keys = _words(part)
        if known is None:
            for lang, n in zip(part.column("lang").to_pylist(), np.diff(words.texts).tolist(), strict=True):
                totals[lang] += n
            tally.add(keys)
        else:
            pairs, good = _pairs(words, keys, known.value)
            tally.add(pairs[good])
        if tally.full:
            yield from rows()
    yield from rows()
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["lang", "key", "n"])


def _counted(rows: DataFrame, known: Broadcast | None, least: int) -> DataFrame:
    keyed = rows.mapInArrow(lambda batches: _keyed(batches, known), "lang string, key long, n long")
    with arrow_batches(rows.sparkSession, ROWS_IN):
        return stored(keyed.groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("key").isNull() | (F.col("n") >= least)), "counted")


def frequent_bits(counted: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits in which those of the keys of ``counted`` are set."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = counted.filter("key is not null").groupBy(F.floor(place / _ROW_BITS).cast("long").alias("row")).agg(F.bitmap_construct_agg((place % _ROW_BITS).cast("long")).alias("bits"))
    return _table(rows, bits)


def _table(rows: DataFrame, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most bits / 2**15 rows of 4 KB
        out[r["row"] * (_ROW_BITS // 8) :][: _ROW_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _frequent_pairs(words: Words, keys: np.ndarray, words_known: np.ndarray, pairs_known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_pairs``; and the pair is frequent too."""
    pairs, good = _pairs(words, keys, words_known)
    good[good] = is_set(pairs_known, pairs[good])
    return pairs, good


def _triples(keys: np.ndarray, pairs: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word with the next two, and whether both pairs in it are frequent."""
    return mix(pairs[:-1] * _ODD + keys[2:]), good[:-1] & good[1:]


def _shards(rows: DataFrame) -> DataFrame:
    """The rows in so few partitions that what each task sums, and all have in common, doesn't come once for every piece of a file."""
    return rows.coalesce(SHARDS * rows.sparkSession.sparkContext.defaultParallelism)


def frequent_triples(rows: DataFrame, words_known: Broadcast, pairs_known: Broadcast, cells: int, least: int) -> np.ndarray:
    """A table of ``cells`` bits, set where the triples of frequent pairs that have a cell in common occur ``least`` times together.
    A task counts in a table and hands on those of its rows of cells that aren't empty."""
    kind = np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, kind)
        for part in slices(batches, "text", SLICE_BYTES):
            words, keys = _words(part)
            triples, good = _triples(keys, *_frequent_pairs(words, keys, words_known.value, pairs_known.value))
            at, n = np.unique(triples[good] & np.uint64(cells - 1), return_counts=True)
            table[at] = np.minimum(table[at] + n, least)
        table = table.reshape(-1, _ROW_BITS)
        some = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(some), CELL_ROWS):
            own = some[i : i + CELL_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([table[j].tobytes() for j in own], pa.binary())], names=["row", "cells"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, own in zip(batch.column("row").to_pylist(), batch.column("cells"), strict=True):
                n = np.frombuffer(own.as_buffer(), kind)
                sums[row] = np.minimum(sums[row].astype(np.int64) + n, least).astype(kind) if row in sums else n.copy()
        for row, n in sums.items():
            bits = np.packbits(n >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([bits], pa.binary())], names=["row", "bits"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = _shards(rows).mapInArrow(count, "row long, cells binary").repartition(parts, "row")
    with arrow_batches(rows.sparkSession, ROWS_IN):
        return _table(counted.mapInArrow(unite, "row long, bits binary"), cells)


def shard_ngrams(rows: DataFrame, words_known: Broadcast, pairs_known: Broadcast, triples_known: Broadcast, longest: int) -> DataFrame:
    """(lang, words, n): the n-grams of each task's rows, sorted and summed; each starts with a frequent word and goes on
    as long as pairs and triples are frequent."""

    def gather(part: pa.RecordBatch, found: Grams) -> None:
        words, keys = _words(part)
        pairs, good = _frequent_pairs(words, keys, words_known.value, pairs_known.value)
        triples, sure = _triples(keys, pairs, good)
        sure[sure] = is_set(triples_known.value, triples[sure])
        size, whole = np.ones(len(keys), np.int64), keys.copy()
        more = np.ones(len(keys), bool)
        for k in range(1, longest):  # whether the k-th next word goes on with it
            goes = good if k == 1 else sure[k - 2 :]
            reach = np.zeros(len(keys), bool)
            reach[: len(goes)] = goes
            more &= reach
            at = np.flatnonzero(more)
            whole[at] = mix(whole[at] * _ODD + keys[at + k])
            size[at] += 1
        start = np.flatnonzero(is_set(words_known.value, keys))
        keys, first, counts = np.unique(whole[start], return_index=True, return_counts=True)
        at = start[first][found.add(keys, counts)]
        packed, starts = words.packed()
        found.named(part.column("lang").take(pa.array(words.text[at])), joined(packed, starts[at], starts[at + size[at]] - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Grams()
        for part in slices(batches, "text", SLICE_BYTES):
            gather(part, found)
            if found.nbytes > GRAM_BYTES:
                yield from found.empty()
        yield from found.empty()

    return _shards(rows).mapInArrow(work, "lang string, words array<string>, n long")


def states(batch: pa.RecordBatch, longest: int, least: int) -> pa.RecordBatch:
    """(lang, phrase, n): the states that the sorted n-grams (lang, words, n) of a batch add to the transducer: the closed ones with
    a weight of ``least``, and those on its first and last path, closed or not."""
    words, size = batch.column("words"), batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    label = np.full((batch.num_rows, longest + 1), -1, np.int64)
    label[:, 0] = batch.column("lang").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), size)
    label[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.indices.to_numpy(zero_copy_only=False)
    weight = np.r_[0, np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))]
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    new[1:] = label[1:, 0] != label[:-1, 0]
    at, depth, total = [], [], []
    for d in range(1, longest + 1):
        new[1:] |= label[1:, d] != label[:-1, d]
        first = np.flatnonzero(new)
        end = np.r_[first[1:], batch.num_rows]
        sums = weight[end] - weight[first]
        keep = (label[first, d] >= 0) & ((sums >= least) | (first == 0) | (end == batch.num_rows))
        at.append(first[keep])
        depth.append(np.full(int(keep.sum()), d))
        total.append(sums[keep])
    at, depth, total = (np.concatenate(x) for x in (at, depth, total))
    taken = pc.list_slice(words.take(pa.array(at)), 0, longest)
    phrases = [" ".join(w[:d]) for w, d in zip(taken.to_pylist(), depth.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(at)), pa.array(phrases, pa.string()), pa.array(total, pa.int64())], names=["lang", "phrase", "n"])


def transducer(ngrams: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, n): the states with a weight of ``least`` of the united n-grams (lang, words, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield states(batch, longest, least)

    parts = int(ngrams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ngrams.repartitionByRange(parts, "lang", "words").sortWithinPartitions("lang", "words")
    return ranges.mapInArrow(work, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _cells(totals: DataFrame, most: int) -> int:
    """Cells for the triples of a corpus: one for ``CELL_WORDS`` words or more, as a power of 2."""
    total = totals.agg(F.sum("n")).first()[0] or 0
    return min(most, max(_ROW_BITS, 1 << (total // CELL_WORDS).bit_length()))


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """The phrases of up to ``longest`` words with ``least`` occurrences, (lang, phrase, n), and the
    number of words of each language, (lang, n). Both are tables in the shared folder."""
    sc = docs.sparkSession.sparkContext
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("tongue"), text_column(text_col).alias("text"))
    words = _counted(rows, None, least)
    words_known = sc.broadcast(frequent_bits(words, filter_bits))
    pairs = _counted(rows, words_known, least)
    pairs_known = sc.broadcast(frequent_bits(pairs, filter_bits))
    totals = words.filter("key is null").select("lang", "n")
    triples_known = sc.broadcast(frequent_triples(rows, words_known, pairs_known, _cells(totals, filter_bits), least))
    with arrow_batches(docs.sparkSession, ROWS_IN):
        ngrams = stored(shard_ngrams(rows, words_known, pairs_known, triples_known, longest), "ngrams")
    found = stored(transducer(ngrams, longest, least), "phrases")
    discard(ngrams, pairs)
    return found, totals


def _part(first: Column, many: Column) -> Column:
    return F.array_join(F.slice("w", first, many), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, best: int = BEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases, without those that only occur inside a longer one."""
    found, totals = phrase_counts(docs, lang_col, text_col, longest, least, filter_bits)
    own = found.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    cuts = own.select("lang", "phrase", F.col("n").alias("a"), F.size("w").alias("size"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "size", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    # composition with the transducer: each part is followed to the state that reads it
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = stored(cuts, "cuts")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(totals, "lang").withColumns({"num": F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), "den": big("l") * big("r")})
    lowest = scored.withColumn("score", F.expr("num div den")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    # what is contained in a longer candidate as often is contained so in one that is a word longer
    inside = cuts.filter("size > 2").filter("(k = size - 1 and l = a) or (k = 1 and r = a)").select("lang", F.when(F.col("k") == 1, F.col("right")).alias("one"), F.when(F.col("k") == F.col("size") - 1, F.col("left")).alias("other"), "a", "l", "r")
    dropped = inside.select("lang", F.explode(F.array(F.when(F.col("r") == F.col("a"), F.col("one")), F.when(F.col("l") == F.col("a"), F.col("other")))).alias("phrase")).filter("phrase is not null").distinct()
    kept = lowest.join(dropped, ["lang", "phrase"], "left_anti").select("lang", "phrase", "m.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p
), t as (
  select lang, sum(len(ws))::bigint as n from w group by lang
), g as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase
  from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(ws) >= k
), f as (
  select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100
), c as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as ws, unnest(range(1, k)) as cut from f where k > 1
), s as (
  select c.lang, c.k, c.phrase, c.a, c.cut, x.f as l, y.f as r, t.n, ((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f))::bigint as score
  from c join t using (lang)
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1 : c.cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[c.cut + 1 :], ' ')
), m as (
  select *, row_number() over (partition by lang, phrase order by score, cut) as best from s
), d as (
  select * from m where best = 1 and not exists (
    select 1 from f q where q.lang = m.lang and q.f >= m.a and q.k > m.k and contains(' ' || q.phrase || ' ', ' ' || m.phrase || ' '))
), r as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from d
)
select lang, rank, phrase, a, l, r, n, score from r where rank <= 2000
"""
