"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An
n-gram's vector binds (multiplies) its letters' vectors, each permuted (rotated)
by its place; a text's vector bundles (adds) those of its n-grams, and a
language's prototype bundles its training texts. A document gets the language
whose prototype is nearest by cosine.

Letters are lower-cased; every run of other characters counts as one blank.
The counts of a text's n-grams decide its vector, so a vector is made for each
distinct n-gram only, and training adds up one vector per task and language.

Defined results: a text that is null, empty or without a letter is ``und`` with
score 0, as is every text when there is nothing to learn from; ties go to the
language that sorts first; texts of any length are read whole; training rows with a null language
or no letter are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import crc32_mod, slices, table, text_column

DIMENSIONS = 1024
SEED = 20240229
#: N-grams whose vectors a task keeps at once.
KEPT_NGRAMS = 50_000
UNDETERMINED = "und"
_BITS = 21  # of a code point

_ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, 0 for each run of other characters,
    and a 0 at each end; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    alpha = _ALPHA[codes]
    if not alpha.any():
        return np.zeros(0, np.int64)
    padded = np.zeros(len(codes) + 2, np.int64)
    padded[1:-1] = np.where(alpha, codes, 0)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    return padded[keep]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 3-grams of a text as numbers, and their counts."""
    s = letters(text)
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((s[:-2] << (2 * _BITS)) | (s[1:-1] << _BITS) | s[2:], return_counts=True)


class Vectors:
    """N-gram vectors by number, kept in a table of bounded size."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letter: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.zeros((1024, dimensions), np.float32)

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions)
            self.letter[code] = (2 * bits - 1).astype(np.float32)
        return self.letter[code]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The rows of the table that hold these n-grams."""
        if len(self.place) + len(grams) > max(KEPT_NGRAMS, len(grams)):
            self.place.clear()
        mask, out = (1 << _BITS) - 1, []
        for g in grams.tolist():
            row = self.place.get(g)
            if row is None:
                row = self.place[g] = len(self.place)
                if row >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                a, b, c = g >> (2 * _BITS), (g >> _BITS) & mask, g & mask
                self.rows[row] = np.roll(self.of_letter(a), 2) * np.roll(self.of_letter(b), 1) * self.of_letter(c)
            out.append(row)
        return np.array(out, np.int64)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rows = self.of(grams)
        return counts.astype(np.float32) @ self.rows[rows]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # of length 1, one row per language
    dimensions: int
    seed: int


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes from every row of ``df`` with a language. The driver gets one
    vector per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, int]] = {}
        vectors = Vectors(dimensions, seed)
        sums: dict[str, np.ndarray] = {}

        def flush() -> None:
            for lang, grams in seen.items():
                keys = np.fromiter(grams, np.int64, len(grams))
                counts = np.fromiter(grams.values(), np.int64, len(grams))
                for at in range(0, len(keys), 4096):
                    part = vectors.bundle(keys[at : at + 4096], counts[at : at + 4096])
                    sums[lang] = sums.get(lang, 0) + part.astype(np.float64)
            seen.clear()

        for part in slices(batches, "_text"):
            for lang, texts in _by_language(part):
                own = seen.setdefault(lang, {})
                found = [trigrams(t) for t in texts]
                for g, c in zip(*(x.tolist() for x in _merged(found)), strict=True):
                    own[g] = own.get(g, 0) + c
            if sum(map(len, seen.values())) > 4 * KEPT_NGRAMS:
                flush()
        flush()
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    rows = df.select(F.col(lang_col).cast("string").alias("_lang"), text_column(text_col).alias("_text")).filter("_lang is not null")
    parts = rows.mapInArrow(count, "lang string, v array<double>").select("lang", F.posexplode("v"))
    # sums of whole numbers: exact in any order
    vectors: dict[str, np.ndarray] = {}
    for lang, vector in parts.groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", "v.x").collect():
        if np.linalg.norm(vector):
            vectors[lang] = np.array(vector) / np.linalg.norm(vector)
    names = sorted(vectors)
    return Profiles(names, np.array([vectors[x] for x in names]).reshape(len(names), dimensions), dimensions, seed)


def _by_language(part: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    groups: dict[str, list[str]] = {}
    for lang, text in zip(part.column("_lang").to_pylist(), part.column("_text").to_pylist(), strict=True):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    own, where = np.unique(grams, return_inverse=True)
    return own, np.bincount(where, counts, len(own)).astype(np.int64)


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) and the columns ``keep`` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(profiles.dimensions, profiles.seed)
        for part in slices(batches, "_text"):
            langs, scores = [], []
            for text in part.column("_text").to_pylist():
                grams, counts = trigrams(text)
                if not len(grams) or not profiles.languages:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                v = sum(vectors.bundle(grams[i : i + 8192], counts[i : i + 8192]).astype(np.float64) for i in range(0, len(grams), 8192))
                near = np.round(profiles.prototypes @ (v / max(np.linalg.norm(v), 1e-12)), 12)  # equal prototypes tie
                best = int(near.argmax())
                langs.append(profiles.languages[best])
                scores.append(float(min(1.0, max(0.0, near[best]))))
            rest = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(n for n in part.schema.names if n != "_text"), "_lang", "_score"])

    keep = keep or []
    rows = df.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)), text_column(text_col).alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    out = rows.mapInArrow(work, f"{fields}, _lang string, _score double")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def learned(spark: SparkSession, sf_dir: str) -> Profiles:
    """Prototypes from the documents that are not held out."""
    return train(table(spark, sf_dir, "documents").filter(~held_out("doc_id")))


def held_out(id_col: str) -> Column:
    return F.coalesce(crc32_mod(id_col, 4) == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = learned(spark, sf_dir)
    out = identify(table(spark, sf_dir, "documents"), profiles)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
