"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only the histogram of piece lengths, ``capacity`` numbers at most, reaches the
driver. There bin completion branches and bounds over it: around the largest
remaining length it enumerates undominated fillings, least waste and larger
items first (one dominates another if it holds that one's items in parts that fit into
its own items), applies one to as many sequences as the counts allow, and gives up
a branch when its waste exceeds what the incumbent leaves; the first incumbent
is best-fit decreasing. The search ends when the incumbent reaches ``least_sequences``, a lower
bound, or after ``nodes`` fillings; it first takes few fillings at each branch, then more, then all
(and also one sequence at a time), as long as fillings are left. ``pack_histogram`` logs the gap to the bound. The outcome, a bounded list of slots (length, range of
ranks, first sequence, offset), is applied to the pieces by Spark: a piece's
rank among those of its length is its rank in its part plus the earlier parts'
counts, so no length, however frequent, meets in one task.

Defined results: a null or empty text is the end mark alone; equal rows are
packed each; an empty table gives no row; columns other than id and text are
ignored. Rows with equal ids are kept apart (pieces are ranked as rows). Strings of the vocabulary's added
tokens in a text get their ids, as its ``tokenizers`` file gives them.
"""

from __future__ import annotations

import base64
import functools
import json
import logging
import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colligate.llm.common import slices, stored, table, text_column

CAPACITY = 1024
END_ID = 2
#: Fillings that the search may make before it settles for its incumbent, and how many of them it
#: takes at each branch: in the first pass, in the second, and so on; None is all.
SEARCH_NODES, SEARCH_WIDTHS = 12_000, (4, 16, None)
#: Steps after which the test of dominance gives up and keeps a filling.
DOMINANCE_STEPS = 200
#: Rows of one part, and fewest parts, when pieces are ranked.
PART_ROWS, LEAST_PARTS = 16_384, 128

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...), sequences


@functools.cache
def encoder(vocabulary: str | None = None, added: str | None = None):
    """The byte-level BPE of 50k entries: its vocabulary read as ranks, and the added tokens of its
    ``tokenizers`` file. It gives the ids which that file gives, in a sixth of the CPU time."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(added or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def library_encoder(added: str | None = None):
    """The ``tokenizers`` file itself."""
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(added or public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str, vocabulary: str | None = None) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit numbers, without an end mark. Texts that the fast encoder can't split
    (runs of about a million blanks exhaust its stack) are encoded from the ``tokenizers`` file, which gives the same ids."""
    try:
        ids = encoder(vocabulary).encode(text, allowed_special="all")
    except ValueError:
        ids = library_encoder().encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: (id, piece, start, length, ids_crc32), and
    with ``with_ids`` the ids themselves."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(part.column("_text").to_pylist()):
                own = np.append(token_ids(text, vocabulary), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(own), capacity)):
                    data = own[s : s + n]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data.tobytes()))
                    if with_ids:
                        ids.append(data.astype(np.int64))
            columns = [part.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(tokenise, schema).withColumnRenamed("_id", id_col)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal sequences are filled together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            while left and open_.get(room):
                items, n = open_[room].pop()
                fit = min(room // length, max(1, left // n))
                used = min(n, left // fit)
                if used < n:
                    open_[room].append((items, n - used))
                open_.setdefault(room - fit * length, []).append((items | {length: items.get(length, 0) + fit}, used))
                left -= used * fit
            if not left:
                break
        each = capacity // length
        if left // each:
            open_.setdefault(capacity - each * length, []).append(({length: each}, left // each))
        if left % each:
            open_.setdefault(capacity - left % each * length, []).append(({length: left % each}, 1))
    return [(tuple(sorted(items.items(), reverse=True)), n) for groups in open_.values() for items, n in groups]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by volume, and by dual feasible functions, which count a length as a share of
    1/k wherever that many of its kind fit at most."""
    best = -(-sum(x * c for x, c in counts.items()) // capacity)
    for k in range(1, 64):
        share = sum(c * (x * k if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity) for x, c in counts.items())
        best = max(best, -(-share // (k * capacity)))
    return best


def _dominates(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether the items of ``b`` can be parted into groups that each fit into an item of ``a``. What both
    have is matched with itself, which loses no way."""
    room = {x: c - b.get(x, 0) for x, c in a.items() if c > b.get(x, 0)}
    items = [x for x, c in sorted(b.items(), reverse=True) for _ in range(c - a.get(x, 0))]
    if sum(items) > sum(x * c for x, c in room.items()):
        return False
    steps = DOMINANCE_STEPS

    def place(i: int) -> bool:
        nonlocal steps
        if i == len(items):
            return True
        for x in sorted(r for r, c in room.items() if c and r >= items[i]):
            steps -= 1
            if steps < 0:
                return False
            left = x - items[i]
            room[x] -= 1
            room[left] = room.get(left, 0) + 1
            if place(i + 1):
                return True
            room[x] += 1
            room[left] -= 1
        return False

    return place(0)


class Steps:
    """How many fillings may still be made."""

    def __init__(self, left: int) -> None:
        self.left = left

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(counts: dict[int, int], room: int, steps: Steps) -> Iterator[tuple[int, dict[int, int]]]:
    """The undominated ways to fill ``room``: (waste, items). Least waste first; of equal waste,
    those with larger items first, so that a filling comes before those it dominates.
    Whatever would fit into the waste is in the filling."""
    lengths = sorted((x for x, c in counts.items() if c and x <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    given: list[dict[int, int]] = []

    def reachable(free: list[int]) -> list[int]:
        """For each i the sums, as bits, that free[i:] can make."""
        below = [1] * (len(free) + 1)
        for i in range(len(free) - 1, -1, -1):
            sums, left, step = below[i + 1], min(counts[free[i]], room // free[i]), 1
            while left:
                n = min(step, left)
                sums |= sums << (n * free[i]) & mask
                left, step = left - n, step * 2
            below[i] = sums
        return below

    def exact(free: list[int], below: list[int], i: int, target: int) -> Iterator[dict[int, int]]:
        if not target:
            yield {}
            return
        for k in range(i, len(free)):
            if not below[k] >> target & 1:
                return  # fewer lengths make fewer sums
            x = free[k]
            for times in range(min(counts[x], target // x), 0, -1):
                if below[k + 1] >> (target - times * x) & 1:
                    for rest in exact(free, below, k + 1, target - times * x):
                        yield {x: times} | rest

    free, below = lengths, reachable(lengths)
    for waste in range(room + 1):
        forced = {x: counts[x] for x in lengths if x <= waste}
        target = room - waste - sum(x * c for x, c in forced.items())
        if target < 0:
            return
        if len(free) + len(forced) != len(lengths):
            free = [x for x in lengths if x > waste]
            below = reachable(free)
        if not below[0] >> target & 1:
            continue
        for items in exact(free, below, 0, target):
            if not steps.take():
                return
            whole = items | forced
            if not any(_dominates(a, whole) for a in given):
                given.append(whole)
                yield waste, whole


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES, widths: tuple[int | None, ...] = SEARCH_WIDTHS) -> list[Pattern]:
    """Bin completion over a histogram of lengths; patterns with their numbers of sequences."""
    histogram = {x: c for x, c in histogram.items() if c}
    bound = least_sequences(histogram, capacity)
    best, steps = best_fit(histogram, capacity), Steps(nodes)
    for width in widths:
        if sum(n for _, n in best) <= bound or steps.left <= 0:
            break
        best = _search(histogram, capacity, best, bound, steps, width)
    used = sum(n for _, n in best)
    logging.getLogger(__name__).info("%d sequences; %d is a lower bound; %d of %d fillings left", used, bound, max(0, steps.left), nodes)
    return best


def _search(histogram: dict[int, int], capacity: int, best: list[Pattern], bound: int, steps: Steps, width: int | None) -> list[Pattern]:
    """The best of the incumbent ``best`` and what the search finds."""
    total, best_n, used = sum(x * c for x, c in histogram.items()), sum(n for _, n in best), 0
    counts = dict(histogram)
    path: list[tuple[Pattern, int]] = []  # with the waste so far
    choices: list[Iterator[Pattern]] = []

    def options() -> Iterator[Pattern]:
        largest = max((x for x, c in counts.items() if c), default=0)
        if not largest:
            return
        one = dict(counts)
        one[largest] -= 1
        for _, items in islice(fillings(one, capacity - largest, steps), width):
            full = dict(items)
            full[largest] = full.get(largest, 0) + 1
            most = min(counts[x] // n for x, n in full.items())
            pattern = tuple(sorted(full.items(), reverse=True))
            yield pattern, most
            if width is None and most > 1:
                yield pattern, 1

    def apply(option: Pattern, sign: int) -> None:
        nonlocal used
        items, n = option
        used += sign * n
        for x, times in items:
            counts[x] -= sign * times * n

    choices.append(options())
    while choices and best_n > bound:
        option = next(choices[-1], None)
        if option is None:
            choices.pop()
            if path:
                apply(path.pop()[0], -1)
            continue
        items, n = option
        waste = (path[-1][1] if path else 0) + n * (capacity - sum(x * t for x, t in items))
        if waste > (best_n - 1) * capacity - total:
            continue  # whatever follows, it isn't better than the incumbent
        path.append((option, waste))
        apply(option, 1)
        if any(counts.values()):
            choices.append(options())
            continue
        if used < best_n:
            best_n, best = used, [p for p, _ in path]
        apply(path.pop()[0], -1)
    return best


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: pieces of a length
    with ranks from the first rank on go to sequences from the first one on."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in sorted(patterns, reverse=True):
        offset = 0
        for length, times in items:
            for _ in range(times):
                rows.append((length, ranks.get(length, 0), sequence, offset))
                ranks[length] = ranks.get(length, 0) + n
                offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(len(rows), 4)


def ranked(rows: DataFrame, key: str, order: list[str], n_rows: int) -> DataFrame:
    """Adds ``_rank``: 0, 1, ... among the rows of the same ``key``."""
    parts = max(LEAST_PARTS, math.ceil(n_rows / PART_ROWS))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = dealt.groupBy("_part", key).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)) - 1)
    return own.join(before.drop("_n"), ["_part", key]).withColumn("_rank", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_part", "_own", "_before")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False, nodes: int = SEARCH_NODES) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``."""
    cut_ = stored(pieces(df, id_col, text_col, capacity, end_id, vocabulary, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut_.groupBy("length").count().collect()}
    plan = slots(pack_histogram(histogram, capacity, nodes))
    keys = (plan[:, 0] << 44) | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            slot = plan[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            yield batch.append_column("sequence_id", pa.array(slot[:, 2] + rank - slot[:, 1])).append_column("offset", pa.array(slot[:, 3]))

    rows = ranked(cut_, "length", [id_col, "piece", "ids_crc32"], sum(histogram.values())).withColumn("_rank", F.col("_rank").cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{fields}, sequence_id long, offset long").drop("_rank").select(*cut_.columns, "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
