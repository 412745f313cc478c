import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colligate.llm import extraction, neighbours, pieces, warc
from colligate.llm.common import shared_path

# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></ul></nav><!-- x --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>One<b>two</b>
 three.<p>Four<br>five &lt;six&gt; caf&eacute;<div class="comments">no</div><form>no</form><aside>no</aside></article>
<section id="reader-comments">no</section><footer>&copy; foot</footer>"""


def extract(spark, *pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as pivot")
    return [tuple(r) for r in extraction.extract(df).orderBy("page_id").select("text", "n_chars").collect()]


def test_article(spark):
    text = "Head & line Onetwo three. Four five <six> café"
    assert extract(spark, ("http://h/1", PAGE), (None, None), ("x", ""), ("http://h/1", "<p>unclosed")) == [(text, len(text)), ("", 0), ("", 0), ("unclosed", 8)]


@pytest.mark.parametrize("attributes", ["class='site-content sidebar-right'", "class=has-sidebar", "id='page-with-comments'", "class='header-fixed'", "class=no-ads", "class='left-sidebar'", "title='hidden part'", "data-hidden=1 data-id=ad"])
@pytest.mark.parametrize("article", ["article", "div"])
def test_wrappers_of_the_content_stay(attributes, article):
    page = f"<body><div class=ad>Buy</div><div {attributes}><{article}>The main text of this page <math><mi>x</mi></math><xmp><b></xmp></{article}><div class='reader-comments'>no</div></div>"
    assert extraction.main_text(extraction.parse(page), set()).startswith("The main text of this page x <b>")
    assert not {"no", "Buy"} & set(extraction.main_text(extraction.parse(page), set()).split())


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "site-footer", "comment-list", "navMenu", "share-box widget-3"])
def test_named_parts_go(name):
    page = f"<body><form id=all><p>The main text of this page, longer than the rest</p><div class='{name}'>no <article>no</article><article>no</article></div></form>"
    assert extraction.main_text(extraction.parse(page), set()) == "The main text of this page, longer than the rest"


def test_deep_pages_are_matched():
    a, b = (extraction.parse("<div>" * 3000 + x) for x in ("<p>1<i>2</i>", "<p>1<b>2</b>"))
    for r in (a, b):
        extraction.numbered(r)
    assert len(extraction.align(a, b)) == 3002


def test_template_is_what_repeats(spark):
    rng = random.Random(1)
    words = lambda: " ".join(rng.choice("abcdefgh") * 4 for _ in range(9))
    page = lambda body: f"<body><div><span>Site name</span></div><div><p>{body}</p></div><div>Imprint line</div></body>"
    bodies = [words() for _ in range(6)]
    pages = [("http://one/", page(b)) for b in bodies] + [("http://two/", page(bodies[0]))] * 3
    got = extract(spark, *pages)
    assert [t for t, _ in got[:6]] == bodies
    assert all(t == f"Site name {bodies[0]} Imprint line" for t, _ in got[6:])  # equal pages make nothing template


@pytest.mark.parametrize("tag", ["article", "main"])
def test_template_inside_the_content(spark, tag):
    rng = random.Random(2)
    words = lambda: " ".join(rng.choice("abcdefgh") * 4 for _ in range(30))
    bodies = [words() for _ in range(6)]
    page = lambda body: f"<body><{tag}><p><b>Note</b> {body}</p><div>Sign up for our letters</div></{tag}></body>"
    copy = lambda i: f"<body><div>{i}</div><{tag}><p>All of this text is the same</p></{tag}></body>"
    got = extract(spark, *[("http://one/", page(b)) for b in bodies], *[("http://two/", copy(i)) for i in range(4)])
    assert [t for t, _ in got] == [f"Note {b}" for b in bodies] + ["All of this text is the same"] * 4


@pytest.mark.parametrize("tag", ["main", "div"])
def test_cards_are_not_the_main_text(tag):
    text = "The main text of this page is long. " * 9
    cards = "".join(f"<article><a href=/{i}>Story {i}</a></article>" for i in range(3))
    assert "The main text of this page is long." in extraction.main_text(extraction.parse(f"<body><{tag}><p>{text}</p><div>{cards}</div></{tag}></body>"), set())
    assert extraction.main_text(extraction.parse(f"<body><div>x</div><article>{text}</article><article>more</article></body>"), set()) == f"{text}more"


def test_main_around_an_article_is_kept():
    page = "<body><p>Before</p><main><p>Lead</p><article>Body <ul><li><a href=/1>inner</a></ul></article><ul><li><a href=/2>More</a></ul><p>End</p></main><p>After</p></body>"
    assert extraction.main_text(extraction.parse(page), set()) == "Lead Body inner End"
    assert extraction.main_text(extraction.parse("<body><p>Before it</p><article>Body of the page</article></body>"), set()) == "Body of the page"


def test_templates_decide(spark):
    """Two layouts on one host, neither with a tag or name that tells: the text is what varies, and
    would be another one without templates."""
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(2, 5) for _ in range(n))
    one = lambda t: f"<body><div><span>Portal of news</span></div><div><p>{t}</p></div><div><span>Terms apply</span></div></body>"
    two = lambda t: f"<body><table><tr><td>Portal of things</td><td><h2>{t[:9]}</h2>{t[9:]}</td></tr></table><section>All rights are ours</section></body>"
    texts = [words(20) for _ in range(12)]
    pages = [(one if i % 2 else two)(t) for i, t in enumerate(texts)]
    got = [t for t, _ in extract(spark, *[("http://one/x", p) for p in pages])]
    assert [t.replace(" ", "") for t in got] == [t.replace(" ", "") for t in texts]
    withheld = [extraction.main_text(extraction.parse(p), set()) for p in pages]
    assert all(len(w) > len(t) and w != t for w, t in zip(withheld, got, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_induction_against_brute_force(spark, seed):
    """Pages with the shape of their pivot: a node is template if enough pages repeat its text."""
    rng = random.Random(seed)
    kinds = [rng.choice(["constant", "mostly", "half", "rarely", "varying"]) for _ in range(12)]
    share = {"constant": 1.0, "mostly": 0.8, "half": 0.5, "rarely": 0.2, "varying": 0.0}
    cells = [[f"fixed {j}" if rng.random() < share[k] else f"own {i} {j}" for j, k in enumerate(kinds)] for i in range(9)]
    page = lambda row: "<body>" + "".join(f"<div><i>{t}</i></div>" for t in row) + "</body>"
    rows = spark.createDataFrame([(i, "h", page(c), page(cells[0])) for i, c in enumerate(cells)], "page_id long, host string, html string, pivot string")
    numbers = {x.own_text(): i for i, x in enumerate(extraction.numbered(extraction.parse(page(cells[0])))) if x.tag == "i"}
    want = set()
    for j, first in enumerate(cells[0]):
        others = [c[j] for c in cells[1:] if c != cells[0]]
        if others.count(first) >= max(extraction.LEAST_PAGES, extraction.LEAST_SHARE * len(others)):
            want.add(numbers[first])
    assert {r["node"] for r in extraction.induce(rows).collect()} == want


def test_tree_matching():
    a, b = (extraction.parse(x) for x in ("<ul><li>1<li>2</ul><p>x</p>", "<p>y</p><ul><li>1<li>3<li>4</ul><p>x</p>"))
    for r in (a, b):
        extraction.numbered(r)
    pairs = extraction.align(a, b)
    assert len(pairs) == 5 and all(p.tag == q.tag for p, q in pairs)


def brute_match(a, b):
    if a.tag != b.tag:
        return 0
    x, y = a.elements(), b.elements()
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_match(x[i - 1], y[j - 1]))
    return 1 + best[-1][-1]


@pytest.mark.parametrize("seed", range(8))
def test_trimmed_matching_is_optimal(seed):
    rng = random.Random(seed)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "span", "b"], k=rng.randint(0, 4) if depth else 0))

    a, b = (extraction.parse(tree(3)) for _ in range(2))
    for r in (a, b):
        extraction.numbered(r)
    assert len(extraction.align(a, b)) == extraction.match(a, b, {}) == brute_match(a, b)


# WARC


def test_warc(spark):
    big = "x" * 150
    rows = [(1, "http://a\r\nb", big), (2, None, "s"), (3, "u", big), (4, "u", None), (5, "u", "s"), (0, "u", "é" * 60), (7, "u", big), (None, "u", "x"), (None, "v", big), (9, "u", "y" * 120), (9, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    path = shared_path(spark, "test-warc")
    warc.write_bundles(df, path, frame_bytes=300, bundle_bytes=900)
    bundles = spark.read.parquet(path)
    read = warc.read_bundles(bundles).collect()
    # a null id has a record, a repeated one a record for each row
    assert len(read) == len(rows) and sorted((r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in read if r["page_id"] is None) == [("response", 0, 1), ("revisit", 1, 150)]
    assert sorted((r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in read if r["page_id"] == 9) == [("response", 0, 120), ("revisit", 1, 150)]
    got = {r["page_id"]: r for r in read if r["page_id"] not in (None, 9)}
    assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"]) for i, r in got.items()} == {
        0: ("response", None, 120), 1: ("response", None, 150), 2: ("response", None, 1), 3: ("revisit", 1, 150), 4: ("response", None, 0), 5: ("response", None, 1), 7: ("revisit", 1, 150),
    }
    assert bytes(got[0]["payload"]).decode() == "é" * 60 and got[3]["payload_digest"] == got[1]["payload_digest"]
    found = warc.lookup(bundles, spark.createDataFrame([(0,), (3,)], "page_id long")).orderBy("page_id").collect()
    assert [(r["page_id"], r["record_type"], len(r["payload"])) for r in found] == [(0, "response", 120), (3, "revisit", 0)]
    empty = shared_path(spark, "test-warc")
    warc.write_bundles(df.limit(0), empty)
    assert warc.read_bundles(spark.read.schema(warc.BUNDLE_SCHEMA).parquet(empty)).count() == 0


def test_frames_and_record_map():
    b = warc.Bundle(50)
    records = [warc.record(i, "u", b"p" * 40, "d", None) for i in range(4)]
    for i, r in enumerate(records):
        b.add(i, r)
    content = b.finish()
    reader = warc.Reader(content)
    out = b"".join(reader.frame(k) for k in range(len(reader.frames)))
    assert out == b"".join(records) and len(reader.frames) == 4 and reader.where[2] == (2, 0)


# Nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 3), (1080, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as x")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, top=10, block_rows=150).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
        assert r["score"] == pytest.approx(x[r["query_id"]] @ x[r["vec_id"]], rel=1e-12)
    assert set(by) == set(range(0, 900, 20))
    hit = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(900), -s))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(by)
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    few = neighbours.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0, top=10).collect()
    assert len(few) == 2


def test_repeated_ids_of_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.9, 0.1]), (2, [0.2, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") == 0, top=5).orderBy("rank").collect()]
    assert got == [(1, 1, 0.9), (2, 1, 0.5), (3, 2, 0.2)]


def test_copies_of_a_vector(spark):
    """A third of all rows are copies; no piece of work gets more of them than can be ranked."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    kept = neighbours.distinct(neighbours.valid(df, "vec_id", "embedding"), 6)
    copies = {r["vec_id"] for r in kept.collect() if r["vec_id"] % 3 == 0}
    assert copies == {0, 3, 6, 9, 12, 15} and kept.count() == 600 + 6
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, top=5, block_rows=100, miss=1e-9).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 900, 20):
        score = np.round(x @ x[q], 9)
        score[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(900), -score))[:5].tolist()


@pytest.mark.parametrize("seed", range(4))
def test_descent_reaches_every_block_in_range(seed):
    """No block that holds a point within reach is missed, and no cell out of reach is visited."""
    rng = np.random.default_rng(seed)
    points, asked, reach = rng.standard_normal((400, 3)), rng.standard_normal((50, 3)), rng.uniform(0, 3, 50)
    tree = neighbours.Splitter(points, 4)
    block, found = tree.block(points), set(zip(*(x.tolist() for x in tree.reached(asked, reach)), strict=True))
    for i in range(50):
        near = ((points - asked[i]) ** 2).sum(axis=1) <= reach[i]
        assert {(i, b) for b in block[near].tolist()} <= found and (i, int(tree.block(asked[i : i + 1])[0])) in found
    assert len(found) < 50 * 16


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, rel=1e-6)
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507313, rel=1e-6)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), rel=1e-6)


# SentencePiece

ALPHABET = "ab  \n\té漢字😀🦄▁<0x41>​'.,ABCdefgh1234567890    thein²½"


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library():
    s, machine, rng = library(), pieces.transducer(), random.Random(2)
    texts = ["", " ", "  a  ", "▁", "\0", "aaaaaaaaaaaaaaaa", "thethethethe", *("".join(rng.choices(ALPHABET, k=rng.randint(1, 40))) for _ in range(3000))]
    for t, found in zip(texts, machine.encode_all(texts), strict=True):
        assert found.tolist() == s.encode(t), t
        assert machine.decode(found) == s.decode(found.tolist())


def test_normaliser_arcs():
    n = pieces.Normaliser(prefix=True, squeeze=False)
    assert n.compose(" a  b", pieces.START) == "▁▁a▁▁b" and n.compose(" a", pieces.TEXT) == "▁a" and n.compose("", pieces.START) == ""
    n = pieces.Normaliser(prefix=True, squeeze=True)
    assert n.compose("  a   b  ", pieces.START) == "▁a▁b" and n.compose("   ", pieces.START) == ""


def model(scores, fallback, squeeze, kind="UNIGRAM"):
    """A model put together by hand, nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    kinds = proto.SentencePiece.Type
    proto.trainer_spec.model_type = getattr(proto.trainer_spec, kind)
    proto.trainer_spec.byte_fallback = fallback
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, squeeze, True
    for text, kind_ in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL), *[(f"<0x{b:02X}>", kinds.BYTE) for b in range(256) if fallback]):
        proto.pieces.add(piece=text, score=0.0, type=kind_)
    for text, score in scores.items():
        proto.pieces.add(piece=text, score=score, type=kinds.NORMAL)
    return proto.SerializeToString()


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_unigram_equals_the_library(fallback, squeeze, seed):
    import sentencepiece

    rng = random.Random(seed)
    texts = {"▁", *"abcd", *("".join(rng.choices("abcd", k=rng.randint(2, 4))) for _ in range(30)), *("▁" + "".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(20)), "a▁b"}
    scores = {t: -rng.uniform(1, 9) for t in sorted(texts)}
    proto = model(scores, fallback, squeeze)
    s, machine = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Transducer(proto)
    for _ in range(300):
        text = "".join(rng.choices("abcd  é😀", k=rng.randint(0, 14)))
        assert machine.encode(text).tolist() == s.encode(text), text


def test_the_least_weight_wins():
    """Of all ways to cut a word into pieces, the one with the least sum, tried one by one."""
    rng = random.Random(7)
    scores = {"▁": -2.0, "a": -3.0, "b": -2.5, "ab": -4.0, "ba": -3.5, "aab": -5.0, "▁a": -4.2, "bb": -4.9}
    machine = pieces.Transducer(model(scores, True, False))

    def best(word):
        if not word:
            return 0.0
        return min(best(word[n:]) - scores[word[:n]] for n in range(1, 4) if word[:n] in scores)

    for _ in range(60):
        text = "".join(rng.choices("ab ", k=rng.randint(1, 8)))
        ids = machine.encode(text).tolist()
        assert sum(-scores[machine.text[i]] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))


def test_decoding_any_ids():
    s, machine, rng = library(), pieces.transducer(), random.Random(3)
    for _ in range(2000):
        ids = [rng.randint(3, 258) if rng.random() < 0.5 else rng.randint(3, 31999) for _ in range(rng.randint(0, 10))]
        assert machine.decode(ids) == s.decode(ids), ids


def test_encode_and_decode_tables(spark):
    texts = ["Hello  world\n", None, "", "漢字😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    encoded = pieces.encode(df)
    assert Counter(r["round_trip"] for r in encoded.collect()) == {True: 4}
    assert [r["text"] for r in pieces.decode(encoded).orderBy("doc_id").collect()] == ["Hello  world\n", "", "", "漢字😀"]
    assert pieces.encode(df.limit(0)).count() == 0
