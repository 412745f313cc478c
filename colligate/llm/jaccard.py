"""N-gram Jaccard join by grouped prefixes.

Documents are sets of hashed word shingles. Sets that are equal become one. The
shingles are ordered: rare ones by hash, then frequent ones (``frequent`` or more
documents have them near the front) by the number of these documents; whatever counts as frequent, two sets
of sufficient similarity share a shingle of their prefixes under one order. A prefix
is as long as the partner's size asks for: shorter against sets of the same size or larger, and of a pair
the first shingle that both share must leave enough of both sets behind it.
Sets with the same size and the same prefix collapse into one group; groups that share
prefix shingles and fit by size and place are pairs of groups; their members
are expanded and verified on their full sets.

The groups that share a much shared shingle aren't paired at once: each is first
verified against the one with the fewest rarer shingles, which is nearest to what they have in common.
What these links have not connected is paired by size and place of the shared shingle first (as groups again),
and only the places that fit are expanded, so that a cluster of near copies costs links in
proportion to its members. A pair is then held against sketches, the parities of both sets' shingles
by hash: sets differ in no fewer shingles than their sketches do in bits. Only rows that can be linked are read a
second time. No link between different sets is lost: every pair that shares a prefix shingle and fits
is ruled out by its sketches, verified or lies in one component.

Defined results: null, empty and blank texts have the empty set and link with
nothing; equal rows are linked; texts of any length are read whole; ids name texts: rows with one id
and equal texts are all returned, different texts under one id may share their classes; a null id is left out; other columns are ignored. Shingles with equal
64-bit hashes count as equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import arrow_batches, discard, slices, stored, table, text_column
from colligate.llm.graph import components, with_first
from colligate.llm.shingles import shingle_sets

#: Documents from which on a shingle counts as frequent, and how many of the most frequent
#: shingles are broadcast (12 bytes each). Others are ordered as rare ones: that changes how
#: many candidates there are, not the result.
FREQUENT, FREQUENT_KEPT = 24, 500_000
DF_BINS = 64
#: Rare shingles that are kept beyond a prefix, in case some of it turn out frequent.
SPARE = 8
#: Bits of a sketch: about as many as the set has shingles, between these.
SKETCH_LEAST, SKETCH_MOST = 256, 4096
#: Rows, texts or pairs of sets, that a Python step is handed at once.
BATCH_ROWS = 512
#: Ids that are broadcast at most; beyond it, texts are joined by shuffling.
BROADCAST_IDS = 1_000_000


def prefix_length(n: int, percent: int) -> int:
    """Shingles in the prefix of a set of ``n``: sets that are similar enough share one of
    their prefixes of this length."""
    return n - (n * percent + 99) // 100 + 1


def _short_length(n: Column, percent: int) -> Column:
    """The same against partners that aren't smaller, with which more must be shared."""
    return n - F.ceil(2 * percent * n / (100 + percent) - 1e-9) + 1


def front(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Of each sorted set its first shingles, until a prefix and ``SPARE`` more of them
    (and an eighth of it) aren't found in three or more different sets of this list."""
    different = list({s.tobytes(): s for s in sets}.values())
    merged, counts = np.unique(np.concatenate(different), return_counts=True) if different else (np.zeros(0, np.int64),) * 2
    common = merged[counts >= 3]
    out = []
    for s in sets:
        if not len(s):
            out.append(s)
            continue
        rare = np.cumsum(~np.isin(s, common, assume_unique=True))
        most = prefix_length(len(s), percent)
        out.append(s[: int(np.searchsorted(rare, most + most // 8 + SPARE)) + 1])
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of how many shingles have each remainder, as the bits of 64-bit numbers. Half
    as many bits are the two halves' exclusive or."""
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << max(0, len(s) - 1).bit_length()))
    odd = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_fronts(df: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, digest, front, sketch) of every row (id, text): the set's size, a 128-bit digest, its first
    shingles, and its sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(_strings(part.column("text")), width)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([f.tobytes() for f in front(sets, percent)], pa.binary()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))],
                names=["id", "n", "digest", "front", "sketch"],
            )

    return df.mapInArrow(work, "id long, n long, digest binary, front binary, sketch array<long>")


def _strings(column: pa.Array) -> pa.Array:
    return column if column.type == pa.string() else pc.cast(column, pa.string())


def full_sets(df: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, shingles as bytes) of the rows (id, text) whose id is in ``ids``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(_strings(part.column("text")), width)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "shingles"])

    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(work, "id long, n long, shingles binary")


def prefixes(sets: DataFrame, column: str, hot: Broadcast, percent: int) -> DataFrame:
    """(id, n, prefix, class, digest, lacking) of rows (id, n, ``column``), the column the bytes of
    sorted shingles. The prefix is the first of them: rare ones by hash, then hot ones by their number and hash;
    sets of compatible sizes are of one size class or of neighbouring ones. A row whose
    known shingles don't decide its prefix is lacking, and has none."""
    # sizes at most 100 / percent apart are at most one class apart
    step = math.log(100 / percent) * (1 + 1e-9)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = hot.value
        for part in slices(batches, "known"):
            found, classes, keys, lacks = [], [], [], []
            for n, data in zip(part.column("n").to_pylist(), part.column("known"), strict=True):
                own, most = np.frombuffer(data.as_buffer(), np.int64), prefix_length(n, percent)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                often = known[at] == own if len(known) else np.zeros(len(own), bool)
                rare = own[~often][:most]
                lacks.append(len(rare) < most and len(own) < n)
                if lacks[-1]:
                    prefix = rare[:0]
                else:
                    rest = own[often]
                    prefix = np.concatenate([rare, rest[np.lexsort((rest, number[at[often]]))[: most - len(rare)]]])
                found.append(prefix)
                classes.append(math.floor(math.log(n) / step) if step else n)
                keys.append(hashlib.blake2b(prefix.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), pa.array(found, pa.list_(pa.int64())), pa.array(classes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lacks, pa.bool_())], names=["id", "n", "prefix", "class", "digest", "lacking"])

    return sets.select("id", "n", F.col(column).alias("known")).mapInArrow(work, "id long, n long, prefix array<long>, class long, digest binary, lacking boolean")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "y"):
            keep = []
            for x, y in zip(part.column("x"), part.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches (id, n, sketch) don't rule out that they are similar enough."""
    one, two = (sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")) for side in ("a", "b"))
    # sizes that fit make one sketch at most twice as long as the other
    halved = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q), {0})"
    both = f"zip_with({halved.format('s_a', 's_b')}, {halved.format('s_b', 's_a')}, (p, q) -> bit_count(p ^ q))"
    differ = F.expr(f"aggregate({both}, 0, (sum, n) -> sum + n)")
    fit = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return pairs.join(one, "a").join(two, "b").filter(fit).select("a", "b")


def _without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``df`` without the rows with these ids, which are broadcast only if they are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_anti")


def _front_tokens(sets: DataFrame) -> DataFrame:
    """(token) of every shingle in ``front``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "front"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(part.column("front").to_pylist()), np.int64))], names=["token"])

    return sets.select("front").mapInArrow(work, "token long")


def _most_frequent(often: DataFrame) -> DataFrame:
    """The rows (token, df) of the highest ``df``, ``FREQUENT_KEPT`` at most: all above the first
    of ``DF_BINS`` steps for each doubling with which there would be more."""
    step = F.floor(F.log2("df") * DF_BINS)
    kept, least = 0, None
    for row in sorted(often.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        kept += row["k"]
        if kept > FREQUENT_KEPT:
            break
        least = row["step"]
    return often.filter(step >= least) if least is not None else often.limit(0)


def _sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, n, pos, up, ...) under the names that pairs of them get."""
    left, right = (rows.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("n", "pos", "up", *more))) for side in ("a", "b"))
    return left, right


def _fits(percent: int) -> Column:
    """Whether two sets could be similar, if the shingle that they share is the first one: their
    sizes, and what lies behind it. Sets of one class also meet under the next one."""
    least = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent) - 1e-9)
    behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return ((F.col("up_a") == 0) | (F.col("up_b") == 0)) & (behind >= least)


def _calm_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of rows (id, n, pos, up, key) that share a key and fit."""
    left, right = _sides(rows, "id")
    return left.join(right, "key").filter((F.col("id_a") < F.col("id_b")) & _fits(percent)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _busy_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The same of rows (..., c) with keys that many share, without pairs in one component ``c``. Rows of
    one key, size and place are a group; pairs of groups that fit are expanded."""
    by = ["key", "n", "pos", "up"]
    left, right = _sides(rows.groupBy(*by).agg(F.min("c").alias("c1"), F.max("c").alias("c2")), "c1", "c2")
    order = F.struct("n_a", "pos_a", "up_a") <= F.struct("n_b", "pos_b", "up_b")
    several = F.least("c1_a", "c1_b") < F.greatest("c2_a", "c2_b")
    groups = left.join(right, "key").filter(order & several & _fits(percent)).select("key", "n_a", "pos_a", "up_a", "n_b", "pos_b", "up_b")
    one, two = _sides(rows, "id", "c")
    met = groups.join(one, ["key", "n_a", "pos_a", "up_a"]).join(two, ["key", "n_b", "pos_b", "up_b"]).filter("c_a <> c_b")
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``df``: the size of its set and the
    smallest id that links lead to."""
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    with arrow_batches(df.sparkSession, BATCH_ROWS):
        return _link(df, id_col, text_col, width, percent, frequent)


def _link(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, frequent: int) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_column(text_col).alias("text")).filter("id is not null")
    fronts = stored(shingle_fronts(docs, width, percent), "fronts")
    sketches = fronts.select("id", "n", "sketch").filter("n > 0")
    one = stored(with_first(fronts.select("id", "n", "digest"), F.struct("n", "digest"), F.col("id"), F.col("n") > 0).select("id", "n", "first"), "copies")
    # one row per different set, and the shingles that many of them have in front
    sets = _without(fronts, one.filter("id <> first").select("id")).filter("n > 0").select("id", "n", "front")
    often = stored(_front_tokens(sets).groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") >= frequent), "often")
    found = _most_frequent(often).toArrow()
    discard(often)
    shingles, numbers = (found.column(c).to_numpy() for c in ("token", "df"))
    by_hash = np.argsort(shingles)
    hot = df.sparkSession.sparkContext.broadcast((shingles[by_hash], numbers[by_hash].astype(np.int32)))
    done = [decided := stored(prefixes(sets, "front", hot, percent), "prefixes")]
    lacking = decided.filter("lacking").select("id")
    known = decided.filter("not lacking").drop("lacking")
    if not lacking.isEmpty():  # sets of which too little is known are read whole
        done.append(whole := stored(full_sets(docs, lacking, width), "whole"))  # so that no task has two Python steps
        done.append(late := stored(prefixes(whole, "shingles", hot, percent).drop("lacking"), "prefixes"))
        known = known.union(late)

    # groups: sets of one size and with one prefix, named by their smallest id
    member = stored(with_first(known.select("id", "n", "digest"), F.struct("n", "digest"), F.col("id"), F.lit(True)).select("id", "n", F.col("first").alias("g")), "members")
    own = member.filter("id <> g").select(F.col("g").alias("a"), F.col("id").alias("b"))
    # a key is a shingle with the set's size class, and with the next one, whose sets are larger
    leaders = _without(known, own.select(F.col("b").alias("id")))
    places = leaders.select("id", "n", "class", F.posexplode("prefix").alias("pos", "token"))
    keyed = places.select("id", "n", "pos", "token", F.posexplode(F.array("class", F.col("class") + 1)).alias("up", "class"))
    keyed = keyed.filter((F.col("up") == 0) | (F.col("pos") < _short_length(F.col("n"), percent))).select("id", "n", "pos", "up", F.xxhash64("token", "class").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1")
    sharing = stored(keyed.join(shared, "key").withColumn("busy", F.col("k") >= frequent).drop("k"), "sharing")
    discard(*done)

    # first: members with their group's first, all groups of a key that few share, and
    # the groups of one that many share with the one that has it nearest to its front
    busy, calm = sharing.filter("busy").drop("busy"), sharing.filter("not busy").drop("busy")
    lead = busy.groupBy("key").agg(F.min(F.struct("pos", "id", "n")).alias("lead")).select("key", F.col("lead.id").alias("lead"), F.col("lead.n").alias("m"))
    near = (F.col("id") != F.col("lead")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    stars = busy.join(lead, "key").filter(near).select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))
    group_pairs = stored(_calm_pairs(calm, percent), "group-pairs")
    first = stored(own.union(group_pairs).union(stars).distinct(), "pairs")
    links, labels = _linked(docs, first, sketches, width, percent, None)

    # then: the members of those groups that these links have not connected
    named = stored(member.join(labels, "id", "left").select("id", "n", "g", F.coalesce("component", "id").alias("c")), "named")
    crowd = busy.withColumnRenamed("id", "g").join(named.select("id", "g", "c"), "g").drop("g")
    apart = crowd.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("key")
    crowd = stored(crowd.join(apart, "key"), "crowd")
    pairs = _busy_pairs(crowd, percent)
    several = own.select("a").distinct()
    if not several.isEmpty():
        # groups of several members, with themselves and with what they were paired with
        whole = several.select("a", F.col("a").alias("b")).union(group_pairs.join(several, "a", "left_semi")).union(group_pairs.join(several.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")).distinct()
        left = whole.join(named.select(F.col("g").alias("a"), F.col("id").alias("x"), F.col("c").alias("cx")), "a")
        spread = left.join(named.select(F.col("g").alias("b"), "id", "c"), "b").filter((F.col("x") != F.col("id")) & (F.col("cx") != F.col("c")))
        pairs = pairs.union(spread.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))).distinct()
    pairs = stored(pairs.join(first, ["a", "b"], "left_anti"), "pairs")
    discard(sharing, member, group_pairs, first, named, crowd)
    if not pairs.isEmpty():
        links, labels = _linked(docs, pairs, sketches, width, percent, links)
    discard(fronts, pairs)
    out = one.join(labels.select(F.col("id").alias("first"), "component"), "first", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "first", "id").alias("component_id"))


def _linked(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, width: int, percent: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The links among ``pairs`` and the known ones, and their components."""
    maybe = stored(plausible(pairs, sketches, percent), "plausible")
    ends = stored(maybe.select(F.col("a").alias("id")).union(maybe.select("b")).distinct(), "ends")
    sets = stored(full_sets(docs, ends, width), "sets")
    links = stored(verified(maybe, sets, percent), "links")
    discard(sets, ends, maybe)
    links = links if known is None else links.union(known)
    return links, components(links)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), width=3, percent=90)


SQL = r"""
with recursive d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null
), s as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g
  from d
), k as materialized (
  select g, any_value(len(g)) as n, min(doc_id) as a from (select doc_id, list_sort(g) as g from s) group by g
), x as materialized (
  select a, n, unnest(g) as g from k where n > 0
), l as materialized (
  select p.a, q.a as b from x p join x q on p.g = q.g and p.a < q.a and 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
  group by p.a, q.a, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))
), e as materialized (
  select a, b from l union all select b, a from l
), r as (
  select a, b from e union select r.a, e.b from r join e on r.b = e.a
), c as (
  select a, least(a, min(b)) as m from r group by a
)
select s.doc_id, cast(len(s.g) as bigint) as n_shingles, cast(case when len(s.g) = 0 then s.doc_id else coalesce(c.m, k.a) end as bigint) as component_id
from s join k on list_sort(s.g) = k.g left join c on c.a = k.a
"""
