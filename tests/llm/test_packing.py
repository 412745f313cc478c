import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from colligate.llm import packing as P


def counts(patterns):
    out = Counter()
    for items, n in patterns:
        for x, times in items:
            out[x] += times * n
    return out


def fewest(lengths, capacity):
    """The least number of bins, by trying everything."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_the_fewest_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(2, 20, 9).tolist(), reverse=True)
    found = P.pack_histogram(Counter(lengths), 20)
    assert counts(found) == Counter(lengths) and all(sum(x * t for x, t in items) <= 20 for items, _ in found)
    assert sum(n for _, n in found) == fewest(lengths, 20)


@pytest.mark.parametrize("seed", range(6))
def test_search_where_lengths_repeat(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.choice([3, 4, 5, 7, 9], 10).tolist(), reverse=True)
    found = P.pack_histogram(Counter(lengths), 12, nodes=100_000)
    assert counts(found) == Counter(lengths) and sum(n for _, n in found) == fewest(lengths, 12)


def test_undominated_fillings():
    got = list(P.fillings({4: 1, 3: 2, 2: 2, 5: 1}, 9, P.Steps(1000)))
    assert got == [(0, {5: 1, 4: 1})]
    got = [f for _, f in P.fillings({6: 1, 5: 1, 4: 1, 1: 1}, 8, P.Steps(1000))]
    assert got == [{6: 1, 1: 1}]
    assert P._dominates({5: 1, 4: 1}, {5: 1, 2: 2}) and P._dominates({6: 1}, {3: 1, 2: 1}) and not P._dominates({4: 1, 4: 1}, {5: 1})


@pytest.mark.parametrize("seed", range(10))
def test_fillings_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    have, room = Counter(rng.integers(2, 12, 7).tolist()), 15
    every = [dict(Counter(c)) for c in {tuple(sorted(x for x, n in zip(have, k, strict=True) for _ in range(n))) for k in product(*(range(c + 1) for c in have.values()))} if 0 < sum(c) <= room]

    def holds(a, b):  # by trying every way to deal b's items to a's
        own, items = list(Counter(a).elements()), list(Counter(b).elements())
        return any(all(sum(x for x, w in zip(items, where, strict=True) if w == i) <= own[i] for i in range(len(own))) for where in product(range(len(own)), repeat=len(items)))

    want = [f for f in every if not any(f != g and holds(g, f) for g in every)]
    got = [f for _, f in P.fillings(have, room, P.Steps(10_000))]
    key = lambda f: sorted(Counter(f).elements())
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("lengths,bound", [([400] * 9, 5), ([600] * 4, 4), ([300] * 10, 4), ([1024] * 3, 3), ([], 0)])
def test_lower_bound(lengths, bound):
    assert P.least_sequences(Counter(lengths), 1024) == bound == sum(n for _, n in P.pack_histogram(Counter(lengths)))


def test_large_histograms_come_near_the_bound():
    rng = np.random.default_rng(1)
    histogram = Counter(np.minimum(1024, 1 + rng.lognormal(5.5, 1, 200_000).astype(int)).tolist())
    found = P.pack_histogram(histogram)
    assert counts(found) == histogram and all(sum(x * t for x, t in items) <= 1024 for items, _ in found)
    bound = -(-sum(x * c for x, c in histogram.items()) // 1024)
    assert sum(n for _, n in found) <= 1.001 * bound + 1
    assert P.pack_histogram({}) == []


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (17, [(0, 1), (1, 8), (9, 8)])])
def test_cut(n, want):
    assert P.cut(n, 8) == want


def test_ids_are_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a  b\n\n c\t", "Ünï漢字 😀​", "<|endoftext|> x", "a<|endoftext|><|endoftext|>b <|endoftext", " <|endoftext|>\n", "it's I'LL 12345", "\x1c\x85 \xa0", *("".join(p) for p in product(" \n'sa1", repeat=4))]
    for t, e in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert P.token_ids(t).tolist() == e.ids


def test_pack(spark):
    long = "word " * 700
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, "a b c", "x"), (6, long + "end", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = P.pack(df, capacity=128, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 128
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, _ in rows:
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == [*P.token_ids(text or "").tolist(), P.END_ID]
        assert all(r["length"] == 128 for r in own[1:])
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert P.pack(df.limit(0)).count() == 0
