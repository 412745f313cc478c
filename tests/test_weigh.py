import math
import random

import pytest

from colligate.errors import OptionError
from colligate.operators import graph
from colligate.operators.pairs import pair
from colligate.plans.config import Config, load_config, override
from colligate.plans.weigh import EDGE_COLUMNS, corpus, corpus_of_units, key_units, raw_pair_stats, weigh, weigh_runs, with_unit_ids
from colligate.sinks import graph as sinks
from colligate.sources.text import parse_edges, parse_units, read_pairs

METHOD_LINES = ["u1 K K A B", "u2 K A B", "u3 A B C", "u4 C D"]
FIELD_LINES = ["u1 A/a/X/g B/b/X/g B/b/X/g C/c/X/g", "u2 A/a/X/g D/d/X/g", "u3 A/a/X/g D/d/X/g D/d/X/g D/d/X/g"]
# What a key ^K$ and field 1 give for A-B and for A-K, by method: cw.
KEYED = {1: (0.48708808986937469, 0.7560731955298291), 7: (0.25338678478740018, 0.39331480293557491), 12: (0.57536414490356169, 0.89309801795232713), 16: (0.6272146010295756, 1.2801431993082784)}


def units(spark, *lines):
    return parse_units(spark.createDataFrame(list(enumerate(lines)), "ord long, value string"))


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "ord long, value string")


@pytest.mark.parametrize("method", [1, 7, 12, 16])
@pytest.mark.parametrize("fused", [False, True])
def test_methods(spark, method, fused):
    u = units(spark, *METHOD_LINES)
    c = corpus_of_units(u, (1,)) if fused else corpus(pair(u), (1,))
    got = {(r["token1"], r["token2"]): r for r in with_unit_ids(weigh(c, "^K$", method), c, "^K$").collect()}
    assert set(got) == {("A", "B"), ("A", "K"), ("B", "K")}
    for pair_, want in zip([("A", "B"), ("A", "K")], KEYED[method], strict=True):
        assert got[pair_]["cw"] == pytest.approx(want, rel=1e-13)
    assert got["A", "B"]["z"] == pytest.approx(-2 / math.sqrt(3), rel=1e-9)
    k = got["A", "K"]
    assert (k["ctf"], k["cdf"], k["df1"], k["fq1"], k["df2"], k["fq2"], k["unit_ids"]) == (2, 2, 3, 2, 2, 3, ["u1", "u2"])


def test_edge_text_of_four_fields(spark):
    c = corpus(pair(units(spark, *FIELD_LINES)))
    edges = sinks.numbered(with_unit_ids(weigh(c, None, 1), c), "pattern1", "pattern2")
    got = [r["line"].split("\t") for r in sinks.edge_lines(edges).orderBy("row").collect()]
    want = [
        "A/a/X/g\tB/b/X/g\t1\t1\t3\t0\t3\t1\t1.09861228867\t2\t0\t-0.5\tu1",
        "A/a/X/g\tC/c/X/g\t1\t1\t3\t0\t3\t1\t1.09861228867\t1\t0\t-0.5\tu1",
        "A/a/X/g\tD/d/X/g\t2\t2\t3\t0\t3\t2\t0.405465108108\t4\t0\t-0.5\tu2\tu3",
        "B/b/X/g\tC/c/X/g\t1\t1\t1\t1.09861228867\t2\t1\t1.09861228867\t1\t1.0986122886681098\t1.5\tu1",
    ]
    # whole numbers and layout as text; logarithms of two libraries differ in the last digit
    for line, text in zip(got, want, strict=True):
        fields = text.split("\t")
        assert line[:5] + line[6:8] + line[9:10] + line[12:] == fields[:5] + fields[6:8] + fields[9:10] + fields[12:]
        assert [float(line[i]) for i in (5, 8, 10, 11)] == pytest.approx([float(fields[i]) for i in (5, 8, 10, 11)], rel=1e-13, abs=1e-15)


@pytest.mark.parametrize("key,method", [(None, 16), ("^(a|b)$", 7), ("c", 12), ("nothing", 7)])
def test_fused_equals_literal(spark, key, method):
    rng = random.Random(5)
    texts = [f"u{i % 37} " + " ".join(rng.choice(["a", "b/x", "c/y/z", "d/x", "e/y/z/q", "ä"]) for _ in range(rng.randint(1, 6))) for i in range(60)]
    u = units(spark, *texts)
    both = [sorted(map(tuple, weigh(c, key, method).select(*EDGE_COLUMNS).collect())) for c in (corpus(pair(u), (2, 3)), corpus_of_units(u, (2, 3)))]
    assert len(both[0]) == len(both[1])
    one_row = units(spark, *(f"r{i} {t.split(' ', 1)[1]}" for i, t in enumerate(texts)))
    both += [sorted(map(tuple, weigh(c, key, method).select(*EDGE_COLUMNS).collect())) for c in (corpus(pair(one_row), (2, 3)), corpus_of_units(one_row, (2, 3), one_row=True))]
    assert len(both[2]) == len(both[3])
    for x, y in [*zip(*both[:2], strict=True), *zip(*both[2:], strict=True)]:
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], rel=1e-9, abs=1e-9)


def test_key_selects_units_by_surviving_pairs(spark):
    c = corpus(pair(units(spark, "u1 x/K y/K", "u2 x/K z/L"), 1), (2,))
    assert [r[0] for r in key_units(c, "K").collect()] == ["u2"]


def test_scores_are_standardized(spark):
    rng = random.Random(1)
    u = units(spark, *[f"u{i} " + " ".join(rng.choices("abcdefgh", k=4)) for i in range(50)])
    z = [r["z"] for r in weigh(corpus_of_units(u, (1,)), None, 16).collect()]
    assert sum(z) / len(z) == pytest.approx(0, abs=1e-9)
    assert math.sqrt(sum(x * x for x in z) / (len(z) - 1)) == pytest.approx(1)


def test_missing_counts(spark, tmp_path):
    p = tmp_path / "pairs.tsv"
    p.write_text("u1\ta\tb\nu2 a c 1 2\n")
    c = corpus(read_pairs(spark, str(p)), (1,))
    got = {r["token2"]: (r["fq1"], r["fq2"]) for r in weigh(c, None, 1).collect()}
    assert got == {"b": (None, None), "c": (None, 2)}
    with pytest.raises(Exception, match="no frequencies"):
        weigh(c, "a", 7).collect()
    assert weigh(c, "nothing", 7).count() == 0


@pytest.mark.parametrize("text", ["u a", "u a b 0 1", "u a b 1 x", "u a b 1"])
def test_invalid_pairs(spark, tmp_path, text):
    p = tmp_path / "pairs.tsv"
    p.write_text(text + "\n")
    with pytest.raises(Exception, match="USER_RAISED"):
        read_pairs(spark, str(p)).collect()


def test_invalid_methods(spark):
    c = corpus(pair(units(spark, *METHOD_LINES)), (1,))
    with pytest.raises(OptionError):
        weigh(c, None, 7)
    with pytest.raises(OptionError):
        weigh(c, None, 2)


def test_raw_pairs(spark):
    got = sorted(map(tuple, raw_pair_stats(pair(units(spark, "u1 a b a", "u2 a b"), ordered=True)).collect()))
    assert got == [("a", "a", 1, 1), ("a", "b", 2, 2), ("b", "a", 1, 1)]


CURRENT = "x\ty\t2\t2\t3\t0.5\t-\t1\t1.5\t4\t0.25\t-1\tu1\tu2"
LEGACY = "x\ty\t1\t1\t3\t0.5\t1\t1.5\t0.75\t2e-1\tu3"


def test_edge_layouts(spark):
    a, b = parse_edges(lines(spark, CURRENT, "", "# no", LEGACY + "\r")).orderBy("ord").collect()
    assert (a["fq1"], a["fq2"], a["z"], a["unit_ids"]) == (None, 4, -1.0, ["u1", "u2"])
    assert (b["fq1"], b["idf2"], b["cw"], b["z"], b["unit_ids"]) == (None, 1.5, 0.75, 0.2, ["u3"])


@pytest.mark.parametrize("bad", ["x\ty", CURRENT.replace("0.25", "inf").replace("1.5", "x"), CURRENT.replace("\t2\t2\t", "\t-2\t2\t").replace("0.5", "1d")])
def test_invalid_edges(spark, bad):
    with pytest.raises(Exception, match="not an edge"):
        parse_edges(lines(spark, bad)).collect()


def test_strict_edges(spark):
    assert parse_edges(lines(spark, CURRENT), strict=True).count() == 1
    with pytest.raises(Exception, match="consistent"):
        parse_edges(lines(spark, CURRENT + "\tu9"), strict=True).collect()


def edges_of_fields(spark):
    c = corpus(pair(units(spark, *FIELD_LINES)))
    return with_unit_ids(weigh(c, None, 1), c)


@pytest.mark.parametrize("by,want", [("fq", [71 / 3, 46 / 3, 7, 32]), ("idf", [7, 32, 32, 16.226756160693945]), ("degree", [32, 19.5, 19.5, 7])])
def test_font_sizes(spark, by, want):
    got = graph.with_font_size(graph.nodes(edges_of_fields(spark)), by).orderBy("id").collect()
    assert [r["font_size"] for r in got] == pytest.approx(want)
    assert [(r["df"], r["fq"], r["degree"]) for r in got] == [(3, 3, 3), (1, 2, 2), (1, 1, 2), (2, 4, 1)]


def test_nodes_that_contradict(spark):
    rows = parse_edges(lines(spark, CURRENT, CURRENT.replace("\t3\t", "\t4\t", 1)))
    with pytest.raises(Exception, match="different numbers"):
        graph.nodes(rows).collect()


def test_structure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("z", "z")], "token1 string, token2 string")
    ends = lambda df: sorted(map(tuple, df.select("token1", "token2").collect()))
    assert dict(map(tuple, graph.components(e).collect())) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    assert ends(graph.k_core(e, 2)) == [("a", "b"), ("a", "c"), ("b", "c"), ("z", "z")]
    assert len(ends(graph.largest_component(e))) == 4
    assert ends(graph.component_of(e, "y")) == [("x", "y")]
    assert len(ends(graph.without_islands(e, 3))) == 4
    assert ends(graph.min_degree(e, 3)) == []


@pytest.mark.parametrize("seed", range(4))
def test_coreness_equals_peeling(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(40)] + [("hub", f"m{k}") for k in range(20)] + [("z", "z")]
    e = spark.createDataFrame(links, "token1 string, token2 string")
    want, left, k = {}, list(links), 0
    while left:
        k += 1
        while True:
            degree = {}
            for a, b in left:
                degree[a] = degree.get(a, 0) + 1
                degree[b] = degree.get(b, 0) + 1
            kept = [(a, b) for a, b in left if degree[a] >= k and degree[b] >= k]
            if len(kept) == len(left):
                break
            left = kept
        want |= {x: k for pair_ in left for x in pair_}
    want = {x: want.get(x, 0) for pair_ in links for x in pair_}
    assert dict(map(tuple, graph.coreness(e).collect())) == want
    assert sorted(map(tuple, graph.k_core(e, 3).select("token1", "token2").collect())) == sorted((a, b) for a, b in links if want[a] >= 3 and want[b] >= 3)
    assert graph.coreness(e.limit(0)).count() == 0


def test_reached(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y"), ("q", "q")], "token1 string, token2 string")
    starts = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert dict(map(tuple, graph.reached(e, starts("a")).collect())) == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert dict(map(tuple, graph.reached(e, starts("b", "e", "q", "none", "e")).collect())) == {"b": 0, "e": 0, "q": 0, "none": 0, "a": 1, "c": 1, "d": 1}
    assert graph.component_of(e, "none").count() == 0 and graph.component_of(e, "e").count() == 5


@pytest.mark.parametrize("bins,few", [(2, 1), (3, 5), (1024, 4096), (7, 0)])
def test_quantiles(spark, bins, few):
    rng = random.Random(bins)
    values = [rng.gauss(0, 1) for _ in range(300)] + [0.25] * 200 + [1e308, -1e308, 5e-324, 1e-300, 2.0]
    shares = [0, 0.001, 0.25, 0.5, 0.7, 0.999, 1]
    s = sorted(values)
    want = [(math.floor(p) + 1 - p) * s[math.floor(p)] + (p - math.floor(p)) * s[math.ceil(p)] for p in (q * (len(s) - 1) for q in shares)]
    df = graph.finite(spark.createDataFrame([(v,) for v in [*values, None, math.inf, math.nan]], "v double"), "v")
    assert graph.quantiles(df, shares, bins, few) == want
    assert graph.quantiles(df.limit(0), [0.5]) == [None]


def test_summary(spark):
    values = [1.0, 2.0, 2.0, 3.0, 9.0]
    r = graph.summary(spark.createDataFrame([(v,) for v in values], "z double"), "z", [0.5, 1.0]).first()
    m, n = sum(values) / 5, 5
    moment = lambda k: sum((v - m) ** k for v in values) / n
    assert (r["n"], r["least"], r["largest"], r["percentiles"]) == (5, 1.0, 9.0, [2.0, 9.0])
    assert [r["mean"], r["sd"], r["skewness"], r["kurtosis"]] == pytest.approx([m, math.sqrt(moment(2) * n / (n - 1)), moment(3) / moment(2) ** 1.5, moment(4) / moment(2) ** 2 - 3])


def test_thresholds(spark):
    e = spark.createDataFrame([("a", "b", 1, 5.0, 2.0), ("a", "c", 2, 5.0, 2.0), ("b", "c", 3, 1.0, 2.0)], "token1 string, token2 string, ctf long, cw double, z double")
    assert [tuple(r)[:2] for r in graph.prune(e, 5.0, 2.0, 2).collect()] == [("a", "c")]
    assert graph.touching(e, "^a$").count() == 2 and graph.exclude(e, "^a$").count() == 1


def test_transitions(spark):
    got = {(r["x"], r["y"]): (r["af"], r["p"]) for r in graph.transitions(units(spark, "u a b", "v a")).collect()}
    assert got == {("<BOS>", "a"): (2, 1.0), ("a", "b"): (1, 0.5), ("a", "<EOS>"): (1, 0.5), ("b", "<EOS>"): (1, 1.0)}


def test_sinks(spark):
    e = sinks.numbered(edges_of_fields(spark), "pattern1", "pattern2")
    md = sinks.render(e, Config(format="md", columns=("token1", "raw_token2", "ctf", "z", "unit_ids"), headers=("a|b",)))
    assert md.split("\n")[:3] == ["| a\\|b | raw_token2 | ctf | z | unit_ids |", "| :--- | :--- | ---: | ---: | :--- |", "| A | B/b/X/g | 1 | -0.5 | u1 |"]
    tex = sinks.render(e, Config(format="tex", columns=("token1", "cw"), caption="A_b", min_z=1.0))
    assert tex == "\\begin{table}[htbp]\n\\centering\n\\begin{tabular}{lr}\n\\hline\ntoken1 & cw \\\\\n\\hline\nB & 1.09861 \\\\\n\\hline\n\\end{tabular}\n\\caption{A\\_b}\n\\end{table}\n"
    page = sinks.render(e, Config(format="html", columns=("token1", "ctf")))
    assert '<thead><tr><th>token1</th><th class="numeric">ctf</th></tr></thead>' in page and page.count("<tr>") == 5
    import json

    read = json.loads(sinks.render(e, Config(format="json", label_fields=(2,))))
    assert [n["label"] for n in read["nodes"]] == ["a", "b", "c", "d"] and read["edges"][2]["unit_ids"] == ["u2", "u3"] and read["nodes"][0]["fields"] == ["A", "a", "X", "g"]
    dot = sinks.render(e, Config(edge_label="cw", tooltip=("ctf", "unit_ids"), edge_length=1.4)).split("\n")
    assert dot[0] == 'graph "G" {' and dot[3] == "  edge [penwidth=1, len=1.3999999999999999];"
    assert '  "A/a/X/g" [label="A", fontsize=23.666666666666664];' in dot and '  "B/b/X/g" -- "C/c/X/g" [label="1.09861", tooltip="ctf: 1\\nunit_ids: u1"];' in dot
    d3 = sinks.render(e, Config(format="d3", directed=True))
    assert '.join("\\n");' in d3 and "src=" not in d3  # one page, nothing to load
    assert '"directed":true' in d3 and "const distance = 78;" in d3 and '"target":"D/d/X/g"' in d3


@pytest.mark.parametrize("together", [True, False])
def test_runs_of_units(spark, together):
    rng = random.Random(7)
    data = [(f"u{rng.randint(1, 6)}", *rng.sample(["A/x", "A/y", "B/x", "C/x", "D/x"], 2)) for _ in range(60)]
    data = sorted(data) if together else data
    rows = spark.createDataFrame([(i, u, a, b, 1, 1) for i, (u, a, b) in enumerate(data)], "ord long, unit_id string, token1 string, token2 string, fq1 long, fq2 long").repartition(3)
    got = {(r["pattern1"], r["pattern2"]): r for r in weigh_runs(rows, (1,), 1).collect()}
    last, df, gdf = {}, {}, {}
    for u, a, b in data:
        p, q = a[0], b[0]
        for counts, node in ((df, p), (df, q), *([(gdf, (min(p, q), max(p, q)))] if p != q else [])):
            if last.get(node) != u:
                counts[node] = counts.get(node, 0) + 1
                last[node] = u
    assert {k: (r["ctf"], r["cdf"]) for k, r in got.items()} == {k: (n, n) for k, n in gdf.items()}
    n = len({u for u, _, _ in data})
    for (p, q), r in got.items():
        assert (r["df1"], r["df2"]) == (df[p], df[q]) and r["idf1"] == pytest.approx(math.log(n / df[p]))
    if together:
        want = {(r["pattern1"], r["pattern2"]): tuple(r)[:12] for r in weigh(corpus(rows, (1,)), None, 1).select(*EDGE_COLUMNS, "pattern1", "pattern2").collect()}
        assert set(want) == set(got)
        for k, row in want.items():
            assert all(a == pytest.approx(b, nan_ok=True) for a, b in zip(tuple(got[k])[:12], row, strict=True))


def test_large_counts_beside_missing_ones(spark):
    big = 2**53 + 1
    rows = [(0, "a", "b", big, big, 1, 0.5, None, 1, 0.5, big, 1.0, 0.0, None), (1, "a", "c", 1, 1, 1, 0.5, 7, 1, 0.5, None, 1.0, 0.0, ["u"])]
    e = spark.createDataFrame(rows, "row long, token1 string, token2 string, ctf long, cdf long, df1 long, idf1 double, fq1 long, df2 long, idf2 double, fq2 long, cw double, z double, unit_ids array<string>")
    assert [r["line"] for r in sinks.edge_lines(e).orderBy("row").collect()] == [f"a\tb\t{big}\t{big}\t1\t0.5\t-\t1\t0.5\t{big}\t1\t0", "a\tc\t1\t1\t1\t0.5\t7\t1\t0.5\t-\t1\t0\tu"]


def test_save(spark, tmp_path):
    e = sinks.numbered(edges_of_fields(spark), "pattern1", "pattern2")
    sinks.save(e, Config(), str(tmp_path / "dot"))
    parts = sorted((tmp_path / "dot").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == sinks.render(e, Config())


def test_config():
    c = load_config('{"format": "markdown", "node": {"label_field": 2, "--x": 1}, "filters": {"min_cw": null, "min_z": 2}, "table": {"columns": ["cw", "cw", "z"], "precision": 3}}')
    assert (c.format, c.label_fields, c.min_cw, c.min_z, c.columns, c.precision) == ("md", (2,), None, 2.0, ("cw", "z"), 3)
    assert override(c, "latex", min_cw=0.0).format == "tex"


@pytest.mark.parametrize(
    "text",
    ["[]", "{", '{"format": "png"}', '{"node": {"min_font_size": 40}}', '{"table": {"columns": ["nope"]}}', '{"table": {"columns": []}}', '{"table": {"precision": 18}}', '{"edge": {"penwidth": 0}}', '{"filters": {"min_cw": NaN}}', '{"dot": {"directed": 1}}', '{"table": {"columns": ["cw"], "headers": ["a", "b"]}}', '{"node": {"label_fields": [5]}}'],
)
def test_invalid_config(text):
    with pytest.raises(OptionError):
        load_config(text)
