"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on ordinary text and one on what is
characteristic of toxic text (byte strings significantly
and several times more frequent among toxic documents). The toxic compressor has both, the ordinary one its own alone, so that a
window's two compressed lengths differ only where a characteristic string occurs.
A text is cut into windows, one for each
word or part of a long one. On labelled documents that no dictionary has seen, thresholds for the difference
of a window's two lengths are fitted (those that few windows of ordinary documents reach), and the shares and
numbers of windows that reach them, and their mean and largest difference, are calibrated to a score between 0 and 1 by
logistic regression. Labels and text decide everything.

The classifier is fitted on a bounded sample of labelled rows: ``MAX_TOXIC`` and
``MAX_ORDINARY`` documents, drawn by a hash of their ids, of at most
``MAX_TRAIN_CHARS`` characters each. Scoring reads every row's whole text.

Defined results: a null or empty text, or one without a letter, is scored like a
text without any characteristic string; where the samples of a class are too few to train a dictionary on, their
last bytes are it; without labels of both classes every score is 0; equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import crc32_mod, slices, table, text_column, within_share

MAX_TOXIC, MAX_ORDINARY, MAX_TRAIN_CHARS = 3000, 3000, 20_000
#: Longest window, in bytes; windows whose lengths a task keeps at once.
WINDOW, KEPT_WINDOWS = 32, 300_000
#: Bytes of the dictionaries, and of the strings compared between the classes.
TOXIC_BYTES, ORDINARY_BYTES, GRAM, SAMPLES = 2048, 512, 6, 60_000
#: A string is characteristic if the share of toxic documents with it is so many times
#: that of ordinary ones, and so many standard deviations above chance.
LEAST_RATIO, LEAST_DEVIATIONS = 4.0, 6.0
#: Shares of the windows of ordinary documents that stay under each threshold.
BELOW = (0.97, 0.99, 0.997, 0.999)
#: Differences of lengths that are told apart, from the first to the last.
LEAST_GAIN, MOST_GAIN = -8, 31
#: Makes every window compressible, so that lengths differ by single bytes.
TAIL = bytes(64)
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-cased words with one blank around each, in UTF-8."""
    return b" " + _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace") + b" "


def windows(data: bytes) -> list[bytes]:
    """Each word with a blank at either end; of a word over ``WINDOW`` bytes, overlapping parts."""
    out = []
    for word in data.split():
        if len(word) <= WINDOW:
            out.append(b" " + word + b" ")
        else:
            padded = b" " + word + b" "
            out += [padded[i : i + WINDOW] for i in range(0, len(padded) - WINDOW // 2, WINDOW // 2)]
    return out or [b"  "]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(window_log=13, hash_log=13, chain_log=13, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries | None
    thresholds: np.ndarray
    weights: np.ndarray  # of the standardised features, the last without one
    mean: np.ndarray
    scale: np.ndarray


def _grams(data: bytes) -> np.ndarray:
    """Every string of ``GRAM`` bytes as a number, in order."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n = max(0, len(b) - GRAM + 1)
    out = np.zeros(n, np.int64)
    for i in range(GRAM):
        out = (out << 8) | b[i : i + n]
    return out


def _frequencies(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    grams, n = _frequencies(toxic)
    others, m = _frequencies(ordinary)
    at = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
    rest = np.where(others[at] == grams, m[at], 0) if len(others) else np.zeros(len(grams))
    # both by ratio and by how far the number is from what chance gives
    share = (n + rest) / (len(toxic) + len(ordinary))
    chance = share * len(toxic)
    far = (n - chance) / np.sqrt(np.maximum(chance * (1 - share), 0.3)) >= LEAST_DEVIATIONS
    characteristic = grams[far & (n / len(toxic) >= LEAST_RATIO * (rest + 0.5) / len(ordinary))]
    found: list[bytes] = []
    for text in toxic:
        hit = np.isin(_grams(text), characteristic)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        found += [text[a : b + GRAM - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    rng = np.random.default_rng(7)
    rng.shuffle(found)
    samples = [b""]
    for s in found:  # strings are joined to samples that are long enough to train on
        if len(samples[-1]) >= WINDOW:
            samples.append(b"")
        samples[-1] += s
    parts = [t[i : i + WINDOW] for t in ordinary for i in range(0, len(t), WINDOW)]
    rng.shuffle(parts)
    return Dictionaries(_trained(TOXIC_BYTES, samples), _trained(ORDINARY_BYTES, parts[:SAMPLES]))


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train one, their end."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


class Features:
    """What a text's windows look like to both compressors."""

    def __init__(self, dictionaries: Dictionaries) -> None:
        self.ordinary = _compressor(dictionaries.ordinary)
        self.toxic = _compressor(dictionaries.toxic + dictionaries.ordinary)
        self.known: dict[bytes, int] = {}

    def gain(self, window: bytes) -> int:
        """By how many bytes the toxic dictionary shortens a window."""
        data = window + TAIL
        return len(self.ordinary.compress(data)) - len(self.toxic.compress(data))

    def of(self, text: str) -> np.ndarray:
        """How many windows of a text have each difference of lengths."""
        own = windows(plain(text))
        if len(self.known) > KEPT_WINDOWS:
            self.known.clear()
        for w in set(own).difference(self.known):
            self.known[w] = min(MOST_GAIN, max(LEAST_GAIN, self.gain(w))) - LEAST_GAIN
        return np.bincount(np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)), minlength=MOST_GAIN - LEAST_GAIN + 1)


def fitted_thresholds(counts: np.ndarray) -> np.ndarray:
    """Different positive differences, of which the shares ``BELOW`` of the windows counted stay below."""
    share = np.cumsum(counts) / max(1, counts.sum())
    found = [int(np.searchsorted(share, b)) + 1 + LEAST_GAIN for b in BELOW]
    return np.unique(np.clip(found, 1, MOST_GAIN))


def described(counts: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The features of texts, from their counts of windows by difference, a text a row."""
    gain, n = np.arange(LEAST_GAIN, MOST_GAIN + 1), counts.sum(axis=1)
    over = np.column_stack([counts[:, gain >= k].sum(axis=1) for k in thresholds])
    mean = counts @ gain / n
    most = np.where(counts > 0, gain, LEAST_GAIN).max(axis=1)
    return np.column_stack([np.log1p(100 * over / n[:, None]), np.log1p(over), mean, counts @ np.maximum(gain - 1, 0) / n, most / 8])


def features(df: DataFrame, dictionaries: Dictionaries, text_col: str, keep: dict[str, Column], thresholds: np.ndarray | None = None) -> DataFrame:
    """(k0, k1, ..., features) of each row: the columns ``keep``, and the features of its text, or without
    ``thresholds`` its counts of windows by difference."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(dictionaries)
        for part in slices(batches, "text"):
            found = np.array([own.of(t) for t in part.column("text").to_pylist()])
            found = found if thresholds is None else described(found, thresholds)
            i = part.schema.get_field_index("text")
            yield part.remove_column(i).append_column("features", pa.array(list(found.astype(np.float64)), pa.list_(pa.float64())))

    rows = df.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), text_column(text_col).alias("text"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(work, f"{fields}features array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last column is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + shrink, x.T @ (p - y) + shrink @ w)
    return w


def _first(known: DataFrame, most: int, n: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``n`` with different ids. Those that can't be
    among them are left out before they are ordered, so that few more come to one task."""
    margin = most + 8 * math.isqrt(most) + 64
    return known.filter(within_share(F.col("_h"), margin, n)).orderBy("_h", "_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """A model from ``labels`` (0 or 1) joined with ``docs``. The sampled ids are at most
    ``max_toxic + max_ordinary``, which bounds the broadcast and what the driver gets."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), F.xxhash64(id_col).alias("_h")).filter("_id is not null and _y in (0, 1)")
    different = known.distinct()
    sizes = {r["_y"]: r["n"] for r in different.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    first = [_first(different.filter(F.col("_y") == y), most, sizes.get(y, 0)) for y, most in ((1, max_toxic), (0, max_ordinary))]
    chosen = first[0].union(first[1]).dropDuplicates(["_id"])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter(F.length("_text") <= MAX_TRAIN_CHARS)
    rows = texts.join(F.broadcast(chosen), "_id").select("_y", F.pmod("_h", F.lit(2)).alias("_fold"), "_text", "_h").cache()
    sample = sorted(map(tuple, rows.filter("_fold = 0").select("_h", "_y", "_text").collect()))
    toxic, ordinary = ([plain(t) for _, y, t in sample if y == k] for k in (1, 0))
    if not toxic or not ordinary:
        rows.unpersist()
        return Model(None, *[np.zeros(0)] * 4)
    dictionaries = train_dictionaries(toxic, ordinary)
    fitted = sorted(map(tuple, features(rows.filter("_fold = 1"), dictionaries, "_text", {"_h": F.col("_h"), "_y": F.col("_y")}).collect()))
    rows.unpersist()
    y = np.array([r[1] for r in fitted], np.float64)
    if not 0 < y.sum() < len(y):
        return Model(None, *[np.zeros(0)] * 4)
    counts = np.array([r[2] for r in fitted])
    thresholds = fitted_thresholds(counts[y == 0].sum(axis=0))
    x = described(counts, thresholds)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    # the sample's share of toxic rows is not the corpus's: rows are weighed by the offset of the prior
    weights = logistic(np.column_stack([(x - mean) / scale, np.ones(len(x))]), y)
    share = known.agg(F.avg("_y")).first()[0]
    drawn = y.mean()
    weights[-1] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Model(dictionaries, thresholds, weights, mean, scale)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` of every row, ``score`` and ``predicted``, which replace columns of these names."""
    keep = {name: c for name, c in (keep or {c: F.col(f"`{c}`") for c in docs.columns}).items() if name.lower() not in ("score", "predicted")}
    if model.dictionaries is None:
        return docs.select(*(c.alias(name) for name, c in keep.items()), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    linear = F.lit(float(model.weights[-1]))
    for i, (w, m, s) in enumerate(zip(model.weights, model.mean, model.scale, strict=False)):
        linear = linear + float(w) * (F.get("features", F.lit(i)) - float(m)) / float(s)
    found = features(docs, model.dictionaries, text_col, keep, model.thresholds)
    out = found.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(keep)), (1 / (1 + F.exp(-linear))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_mod(id_col, 5) == 0, F.lit(False))


def learned(spark: SparkSession, sf_dir: str) -> Model:
    """A model from the labels of the documents that are not held out."""
    return train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learned(spark, sf_dir), keep={"doc_id": F.col("doc_id"), "held_out": held_out()})
