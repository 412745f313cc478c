"""Every stage of the corpus pipeline against a plain version, on a small table with all that is odd."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from colligate.llm import packing, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(4)
    plain = {"en": "the river stone window garden morning letter paper bread summer road house".split(), "de": "der Fluss Stein Fenster Garten Morgen Brief Papier Brot Sommer Straße Haus".split()}
    bad = ["worthless", "pathetic", "disgusting"]
    texts = []
    for i in range(150):
        lang = "de" if i % 4 == 0 else "en"
        words = [rng.choice(bad) if i % 3 == 0 and rng.random() < 0.2 else rng.choice(plain[lang]) + rng.choice("abcdefgh") for _ in range(60)]
        texts.append((" ".join(words), lang))
    copy, near = texts[1][0], texts[2][0].split()
    near[30] = "other"
    texts += [(copy, "en"), (copy.upper(), "en"), (" ".join(near), None), (None, "en"), ("", "de"), ("12 % \n", None), ("one", "en")]
    texts += [(f"{texts[4][0][:200]} password = abcdefghijkl{i}", "en") for i in range(2)] + [("long " + "word " * 3000, "en")]
    rows = [(1000 - i, t, lang, f"s{i % 3}", 0 if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [rows[5], (*rows[5][:3], "a-first", 7), (rows[7][0], "quite another text under the same id", "en", "s1", 1), (None, "a text without an id", "en", "s1", 1), (None, texts[1][0], None, None, None)]
    return rows


def brute_language(rows):
    return [r for r in rows if any(map(str.isalpha, r[1] or ""))]


def brute_toxicity(rows, model):
    own = toxicity.Features(model.dictionaries)

    def score(text):
        x = (toxicity.described(own.of(text or "")[None, :], model.thresholds)[0] - model.mean) / model.scale
        return 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))

    return [r for r in rows if score(r[1]) < 0.5]


def brute_near(rows):
    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})

    named = [(r, shingles(r[1])) for r in rows if r[0] is not None]
    first = {i: r[0] for i, (r, _) in enumerate(named)}
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(named):
            for j, (_, b) in enumerate(named):
                least = min(first[i], first[j])
                if a and b and first[i] != first[j] and 100 * len(a & b) >= 80 * len(a | b):
                    first[i] = first[j] = least
                    changed = True
    kept = {}
    for i, (r, _) in enumerate(named):
        if first[i] == r[0]:
            kept[r[:2]] = min(kept.get(r[:2], r), r, key=lambda x: x[2:])
    return [*kept.values(), *(r for r in rows if r[0] is None)]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as score", "3 as text2").write.parquet(f"{top}/documents.parquet")
    labels = [(1000 - i, 1, int(i % 3 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, rows


def test_stages(spark, tables):
    top, rows = tables
    docs, want = spark.read.parquet(f"{top}/documents.parquet"), rows
    model = toxicity.learned(spark, top)
    plain = {
        "language": brute_language, "toxicity": lambda r: brute_toxicity(r, model), "near_duplicates": brute_near,
        "secrets": lambda r: [(d, t and secrets.hide(t), lang, s, t and len(secrets.hide(t))) for d, t, lang, s, _ in r],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, top)
        assert docs.columns == corpus_pipeline.COLUMNS
        before, want = len(want), plain[name](want)
        got = sorted(map(tuple, docs.collect()), key=key)
        assert got == sorted(want, key=key), name
        assert name == "secrets" or len(want) < before  # each stage has something to do
        docs = spark.createDataFrame(got, SCHEMA)
    assert any("[ASSIGN]" in r[1] for r in want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, top).collect()
    lengths, sequences = {}, {}
    for r in packed:
        lengths.setdefault(r["doc_id"], []).append(r["length"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) <= 1024
    ids = {}
    for r in want:
        ids[r[0]] = ids.get(r[0], 0) + len(packing.token_ids(r[1])) + 1
    assert {d: sum(n) for d, n in lengths.items()} == ids


def test_nothing_to_learn_and_nothing_at_all(spark, tmp_path):
    rows = [(1, "a text of some words", None, "s", 1), (2, "12", None, "s", 1), (None, None, None, None, None)]
    for name, own in (("few", rows), ("none", [])):
        top = f"{tmp_path}/{name}"
        spark.createDataFrame(own, SCHEMA).write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        assert [r["doc_id"] for r in corpus_pipeline.run(spark, top).collect()] == [1] * (name == "few")
