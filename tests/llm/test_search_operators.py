"""Ranking, decontamination and collocations against brute force on small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colligate.llm import collocations, decontamination, ranking
from colligate.llm.words import kinds, words_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = ["", None, " .,- ", "a", "A-a_a", "é", "ÉÉ éé ñ", "x" * 70_000 + " y", "\x00a\x00b", "a b\tc\nd\re\x0bf\x0cg", "0 1 2 É", "\U0001f600 ok"]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group(0).lower(), text or "")


def terms(text):
    return TERM.findall(lower(text))


def texts_of(rng, n, words="a b c d e f g the of É ü x1".split(), most=60):
    return [rng.choice([" ", "  ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_of_equal_regular_expressions():
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + texts_of(rng, 30) + ["".join(chr(rng.choice([*range(0, 130), 0xE9, 0x4E00, 0x1F600])) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for kind, want in ((decontamination.KINDS, terms), (collocations.KINDS, lambda t: re.findall(r"[^\x20\x09.,;:!?\x0a-\x0d]+", lower(t)))):
        w = words_of(pa.array(texts), kind)
        got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.at[i:j], w.end[i:j], strict=True)] for i, j in zip(w.texts[:-1], w.texts[1:], strict=True)]
        assert got == [want(t) for t in texts]
        by_word = {}
        for words, i in zip(got, w.texts, strict=False):
            for k, x in enumerate(words):
                assert by_word.setdefault(x, w.hashes[i + k]) == w.hashes[i + k]
        assert len(set(by_word.values())) == len(by_word)
    assert not len(words_of(pa.array([], pa.string()), kinds(b" ")).at)


# Ranked lexical search


def ranked(docs, items, k=10):
    found = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = Counter(x for _, w in found for x in set(w))
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        own = {x for i, t in items if i == item for x in terms(t)}
        rows = []
        for doc, w in found:
            m, tf = 10 + 90 * len(w) * n_docs // max(1, length), Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in own if x in tf)
            if score > 0 and doc is not None:
                rows.append((-score, doc))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return out


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_ranking(spark, monkeypatch, block):
    rng = random.Random(2)
    docs = [(i, t) for i, t in enumerate(ODD + texts_of(rng, 120))]
    docs += [docs[30], docs[31], (None, "a the of"), (900, docs[40][1]), (901, docs[40][1])]
    items = [(1, "the of É"), (2, "a a b"), (2, "zz c"), (3, None), (4, ""), (5, "nowhere"), (None, "a"), (6, "x1 g F"), (7, "É")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(ranking, "SCORES", 40)
    monkeypatch.setattr(ranking, "POSTINGS", 7)
    got = ranking.rank(df, it, block_terms=block).orderBy("item_id", "rank").collect()
    assert [tuple(r) for r in got] == ranked(docs, items)
    assert got[0].__fields__ == ["item_id", "rank", "doc_id", "score"]


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.rank(docs, items).count() == 0
    assert ranking.rank(docs.filter("doc_id > 5"), items).count() == 0
    assert ranking.rank(docs, items.filter("item_id > 5")).count() == 0


def test_lookup_of_terms_that_share_a_slot():
    hashes = np.array([k << 40 for k in range(1, 60)], np.uint64)
    v = ranking.vocabulary(hashes)
    assert ranking.look_up(v, hashes).tolist() == list(range(59))
    assert ranking.look_up(v, np.array([7, 61 << 40, 0], np.uint64)).tolist() == [-1, -1, -1]


# Benchmark decontamination


def hits(docs, items, width=10):
    out = []
    for doc, text in docs:
        w, hit, named = terms(text), set(), set()
        for item, t in items:
            own = terms(t)
            m = min(len(own), width)
            windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    named |= {item} - {None}
        out.append((doc, len(w), sorted(hit), sorted(named)))
    return out


@pytest.mark.parametrize(("block", "width"), [(8 << 20, 10), (30, 10), (8 << 20, 3), (1, 1)])
def test_windows_are_found(spark, block, width):
    rng = random.Random(width)
    items = [(i, t) for i, t in enumerate(texts_of(rng, 12, most=30) + ["a", "The OF", "é", "q r s t u v w x y z aa bb"])] + [(3, "u v w x y z"), (50, None), (51, ""), (None, "q r s t")]
    long = [" ".join(terms(items[k][1])) for k in (0, 3, 5, 15)]
    docs = [(i, t) for i, t in enumerate(ODD + texts_of(rng, 40) + [f"pre {x} post. {x.upper()}" for x in long] + ["word " * 400 + long[3] + " word" * 400])]
    docs += [docs[-1], (None, long[0])]
    df = spark.createDataFrame([(d, t, "k", [1]) for d, t in docs], "doc_id long, text string, items string, spans array<int>").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.search(df, it, width=width, block_bytes=block, keep=["text"]).collect()
    rows = [(r["doc_id"], r["n_words"], [k for s in r["spans"] for k in range(s["first"], s["end"])], r["items"]) for r in got]
    assert sorted(rows, key=repr) == sorted(hits(docs, items, width), key=repr)
    assert all(a["end"] < b["first"] for r in got for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_nothing_to_search_for(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(tuple, decontamination.search(docs, none).collect())) == [(1, 2, [], []), (2, 0, [], [])]
    assert decontamination.search(docs.filter("doc_id > 5"), none).count() == 0


def test_equal_hashes_of_other_words_are_no_occurrence():
    index = decontamination.index([(1, "one two three")])
    words = words_of(pa.array(["one two three one too three"]), decontamination.KINDS)
    forged = words._replace(hashes=np.r_[words.hashes[:3], words.hashes[:3]])
    assert decontamination.find(forged, index)[0].tolist() == [True] * 3 + [False] * 3


# Phrase collocations


def mined(docs, longest, least, best):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {x: n for x, n in counts.items() if n >= least and len(x[1]) > 1}
    rows = []
    for (lang, w), a in found.items():
        inside = any(la == lang and len(q) > len(w) and b >= a and any(q[i : i + len(w)] == w for i in range(len(q))) for (la, q), b in found.items())
        if not inside:
            score, k = min((1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], totals[lang]))
    rows.sort()
    out, last = [], {}
    for lang, s, a, p, le, r, n in rows:
        last[lang] = last.get(lang, 0) + 1
        if last[lang] <= best:
            out.append((lang, last[lang], p.decode(), -a, le, r, n, -s))
    return out


@pytest.mark.parametrize(("bits", "least", "longest"), [(1 << 27, 4, 5), (1 << 15, 3, 5), (1 << 27, 2, 2), (1 << 27, 1, 3)])
def test_collocations(spark, monkeypatch, bits, least, longest):
    rng = random.Random(least)
    docs = [(rng.choice(["en", "de", None, "und"]), t) for t in texts_of(rng, 60) + ODD[:7] + ["new york city hall, Big a\x01 x a\x00 y"] * 5 + ["a a a a a"] * 3]
    df = spark.createDataFrame([(i, la, t, "z", 1) for i, (la, t) in enumerate(docs)], "doc_id long, lang string, text string, phrase string, n int").repartition(4)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    monkeypatch.setattr(collocations, "KEYS", 40)
    monkeypatch.setattr(collocations, "GRAM_BYTES", 400)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # states go on in the next batch
    try:
        got = collocations.collocations(df, longest=longest, least=least, best=40, filter_bits=bits).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(mined(docs, longest, least, 40))


@pytest.mark.parametrize(("kinds", "least"), [(12, 50), (5, 300)])
def test_ngrams_end_where_triples_are_rare(spark, monkeypatch, kinds, least):
    rng = random.Random(kinds)
    docs = [("en", " ".join(f"w{rng.randrange(kinds)}" for _ in range(100))) for _ in range(200)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(40)
    made, stored = [], collocations.stored

    def counted(rows, name):
        out = stored(rows, name)
        if name == "ngrams":
            made.append(out.count())
        return out

    monkeypatch.setattr(collocations, "stored", counted)
    got = collocations.collocations(df, least=least, best=400).collect()
    assert sorted(map(tuple, got)) == sorted(mined(docs, 5, least, 400))
    # all pairs are frequent and no triple is, but for the few that share a cell; and rows don't come once for each of 40 partitions
    assert made[0] <= 1.25 * collocations.SHARDS * spark.sparkContext.defaultParallelism * kinds * (kinds + 1)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    found = spark.createDataFrame([("en", "a", big), ("en", "b", big - 7), ("en", "a b", big - 9)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 5 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (found, totals))
    row = collocations.collocations(found).collect()
    assert [tuple(r) for r in row] == [("en", 1, "a b", big - 9, big, big - 7, 5 * big, 1000 * (big - 9) * 5 * big // (big * (big - 7)))]


def test_no_collocations(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0
