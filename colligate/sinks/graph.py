"""Graphs and tables as text.

Each sink is a DataFrame (section, row, line), made of edges and nodes by Spark in
parallel, with expressions that stay in the JVM; ``save`` writes it as text files in order,
``render`` gives one string for a graph that fits the driver. Edges keep the order of their column ``row`` (see
``numbered``), nodes that of their ids.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.errors import OptionError
from colligate.functions import columns as c
from colligate.functions import formats as f
from colligate.functions.tokens import label, label_fields
from colligate.operators.graph import nodes, prune, with_font_size
from colligate.plans.config import Config
from colligate.sinks.store import numbered

FORMAT_NAME, FORMAT_VERSION = "colligate/graph", 1
NODE_NUMBERS = [("idf", 17), ("font_size", 17)]
SCORES = [("cw", 17), ("z", 17)]
NUMERIC = frozenset("ctf cdf df1 idf1 fq1 df2 idf2 fq2 cw z".split())
LINES = "section int, row long, line string"


def _text(*parts: str | Column) -> Column:
    """The parts, strings as they are, in one line."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _lines(df: DataFrame, section: int, order: str, line: Column, numbers: list[tuple[str, int]]) -> DataFrame:
    """The line of each row, in which ``_g`` stands for these columns with these digits."""
    return c.with_g(df, numbers).select(F.lit(section).alias("section"), F.col(order).cast("long").alias("row"), line.alias("line"))


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, i, x) for i, x in enumerate(lines)], LINES)


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _last(df: DataFrame) -> DataFrame:
    """Adds ``last``: whether this is the row with the greatest number."""
    return df.crossJoin(F.broadcast(df.agg(F.max("row").alias("_top")))).withColumn("last", F.col("row") == F.col("_top")).drop("_top")


def sized_nodes(edges: DataFrame, config: Config) -> DataFrame:
    """Nodes with label, fields and font_size, numbered by id."""
    found = with_font_size(nodes(edges), config.font_size_by, config.min_font_size, config.max_font_size)
    named = found.withColumn("label", label(F.col("id"), config.label_fields, config.label_separator)).withColumn("fields", label_fields(F.col("id")))
    return numbered(named, "id")


def _int(column: str, missing: str = "null") -> Column:
    return F.coalesce(F.col(column).cast("bigint").cast("string"), F.lit(missing))


def _g(column: str, digits: int = 17) -> Column:
    return F.coalesce(F.col(f"`{c.g_name(column, digits)}`"), F.lit("null"))


def _units(separator: str) -> Column:
    return F.coalesce(F.array_join("unit_ids", separator), F.lit(""))


def _comma() -> Column:
    """A comma behind all lines but the last."""
    return F.when(F.col("last"), F.lit("")).otherwise(F.lit(","))


def json_lines(edges: DataFrame, config: Config) -> DataFrame:
    spark, s = edges.sparkSession, f.json_string
    head = [
        "{", f'  "format": {s(FORMAT_NAME)},', f'  "version": {FORMAT_VERSION},',
        f'  "emit": {{"config": {s(config.path)}, "output_format": {s(config.format)}, "label_fields": {json.dumps(list(config.label_fields))}, "label_separator": {s(config.label_separator)}, "font_size_by": {s(config.font_size_by)}}},',
        f'  "directed": {json.dumps(config.directed)},', '  "nodes": [',
    ]

    strings = lambda column: F.coalesce(F.array_join(F.transform(column, c.json_string), ", "), F.lit(""))
    text = lambda column: c.json_string(F.col(column))
    node = _text(
        '    {"id": ', text("id"), ', "label": ', text("label"), ', "fields": [', strings("fields"), '], "df": ', _int("df"), ', "idf": ', _g("idf"),
        ', "fq": ', _int("fq"), ', "degree": ', _int("degree"), ', "font_size": ', _g("font_size"), "}", _comma(),
    )
    edge = _text(
        '    {"source": ', text("token1"), ', "target": ', text("token2"), *(x for n in ("ctf", "cdf") for x in (f', "{n}": ', _int(n))),
        *(x for i in (1, 2) for x in (f', "df{i}": ', _int(f"df{i}"), f', "idf{i}": ', _g(f"idf{i}"), f', "fq{i}": ', _int(f"fq{i}"))),
        ', "cw": ', _g("cw"), ', "z": ', _g("z"), ', "unit_ids": [', strings("unit_ids"), "]}", _comma(),
    )
    parts = [_lines(_last(sized_nodes(edges, config)), 1, "row", node, NODE_NUMBERS), _lines(_last(edges), 3, "row", edge, [("idf1", 17), ("idf2", 17), *SCORES])]
    return _union(_fixed(spark, 0, *head), parts[0], _fixed(spark, 2, "  ],", '  "edges": ['), parts[1], _fixed(spark, 4, "  ]", "}"))


def _tooltip(config: Config) -> Column:
    shown = {"ctf": _int, "cdf": _int, "cw": _g, "z": _g, "unit_ids": lambda _: _units(", ")}
    return F.concat_ws("\n", *(_text(f"{name}: ", write(name)) for name, write in shown.items() if name in config.tooltip))


def dot_lines(edges: DataFrame, config: Config) -> DataFrame:
    spark, q = edges.sparkSession, f.dot_string
    text = lambda *named: [f"{k}={q(v)}" for k, v in named if v is not None]
    graph = [*text(("charset", config.charset)), f"overlap={json.dumps(config.overlap)}", *text(("outputorder", config.outputorder), ("fontname", config.graph_fontname), ("sep", config.sep))]
    graph += ([] if config.pack is None else [f"pack={json.dumps(config.pack)}"]) + text(("packmode", config.packmode), ("splines", config.splines))
    edge_ = [f"penwidth={f.g(config.penwidth, 17)}", *([] if config.edge_length is None else [f"len={f.g(config.edge_length, 17)}"]), *text(("fontname", config.edge_fontname))]
    head = [f"{'digraph' if config.directed else 'graph'} {q(config.graph_name)} {{", f"  graph [{', '.join(graph)}];", f"  node [{', '.join(text(('shape', config.node_shape), ('fontname', config.node_fontname)))}];", f"  edge [{', '.join(edge_)}];"]
    joint = " -> " if config.directed else " -- "

    quoted = lambda column: c.dot_string(F.col(column))
    node = _text("  ", quoted("id"), " [label=", quoted("label"), ", fontsize=", _g("font_size"), "];")
    about: list[Column] = []
    numbers = [(n, 17) for n in ("cw", "z") if n in config.tooltip]
    if config.edge_label in ("cw", "z"):
        numbers.append((config.edge_label, 6))
    if config.edge_label != "none":
        about.append(_text('label="', _g(config.edge_label, 6) if config.edge_label in ("cw", "z") else _int(config.edge_label), '"'))
    if config.tooltip:
        about.append(_text("tooltip=", c.dot_string(_tooltip(config))))
    edge = _text("  ", quoted("token1"), joint, quoted("token2"), " [", F.concat_ws(", ", *about), "];")
    return _union(_fixed(spark, 0, *head), _lines(sized_nodes(edges, config), 1, "row", node, [("font_size", 17)]), _lines(edges, 2, "row", edge, numbers), _fixed(spark, 3, "}"))


def cells(config: Config) -> list[Column]:
    """The texts of an edge's table cells, not escaped; labels come with the row."""

    def cell(column: str) -> Column:
        if column in ("token1", "token2"):
            return F.col(f"label{column[-1]}")
        if column.startswith("raw_"):
            return F.col(column[4:])
        if column == "unit_ids":
            return _units(config.unit_separator)
        if column in ("idf1", "idf2", "cw", "z"):
            return _g(column, config.precision)
        return _int(column, "-")

    return [cell(column) for column in config.columns]


def table_lines(edges: DataFrame, config: Config) -> DataFrame:
    """Markdown, TeX or HTML."""
    spark = edges.sparkSession
    named = edges.withColumns({f"label{i}": label(F.col(f"token{i}"), config.table_label_fields, config.table_label_separator) for i in (1, 2)})
    titles = [*config.headers, *config.columns[len(config.headers) :]]
    numeric = [column in NUMERIC for column in config.columns]
    texts = cells(config)
    if config.format == "md":
        line = _text("| ", F.concat_ws(" | ", *map(c.markdown, texts)), " |")
        head, foot = ["| " + " | ".join(map(f.markdown, titles)) + " |", "|" + "".join(" ---: |" if n else " :--- |" for n in numeric)], []
    elif config.format == "html":
        opened = lambda tag, n: f'<{tag} class="numeric">' if n else f"<{tag}>"
        line = _text("    <tr>", *(x for t, n in zip(texts, numeric, strict=True) for x in (opened("td", n), c.html(t), "</td>")), "</tr>")
        top = "".join(f"{opened('th', n)}{f.html(t)}</th>" for t, n in zip(titles, numeric, strict=True))
        head = ["<table>", *([] if config.caption is None else [f"  <caption>{f.html(config.caption)}</caption>"]), f"  <thead><tr>{top}</tr></thead>", "  <tbody>"]
        foot = ["  </tbody>", "</table>"]
    else:
        line = _text(F.concat_ws(" & ", *map(c.tex, texts)), r" \\")
        floats = config.caption is not None or config.table_label is not None
        head = [*[r"\begin{table}[htbp]", r"\centering"] * floats, r"\begin{tabular}{" + "".join("r" if n else "l" for n in numeric) + "}", r"\hline", " & ".join(map(f.tex, titles)) + r" \\", r"\hline"]
        foot = [r"\hline", r"\end{tabular}"]
        foot += [] if config.caption is None else [rf"\caption{{{f.tex(config.caption)}}}"]
        foot += [] if config.table_label is None else [rf"\label{{{f.tex(config.table_label)}}}"]
        foot += [r"\end{table}"] * floats
    parts = [_fixed(spark, 0, *head), _lines(named, 1, "row", line, [(n, config.precision) for n in config.columns if n in ("idf1", "idf2", "cw", "z")])]
    return _union(*parts, *([_fixed(spark, 2, *foot)] if foot else []))


PAGE_HEAD = """<!doctype html>
<meta charset="utf-8">
<title>Graph of co-occurrences</title>
<body style="margin:0">
<canvas id="sheet"></canvas>
<pre id="about" style="position:fixed;left:1em;bottom:1em;margin:0;background:#fffc"></pre>
<script>"""
PAGE_FOOT = """// Nodes start on a spiral; sweeps over the edges then pull or push both ends towards the wanted
// length, and sweeps over a grid of cells push apart nodes that are close.
const at = new Map(graph.nodes.map((n, i) => [n.id, {n, x: 30 * Math.sqrt(i) * Math.cos(2.4 * i), y: 30 * Math.sqrt(i) * Math.sin(2.4 * i)}]));
const spots = [...at.values()], ends = graph.links.map(e => ({e, a: at.get(e.source), b: at.get(e.target)}));
function shift(a, b, want, share) {
  const dx = b.x - a.x, dy = b.y - a.y, far = Math.hypot(dx, dy) || 1e-3, k = share * (far - want) / far / 2;
  a.x += k * dx; a.y += k * dy; b.x -= k * dx; b.y -= k * dy;
}
for (let sweep = 0; sweep < 240; sweep++) {
  const share = 0.5 * (1 - sweep / 240), cells = new Map();
  for (const {a, b} of ends) if (a !== b) shift(a, b, distance, share);
  for (const p of spots) {
    const key = Math.floor(p.x / distance) + " " + Math.floor(p.y / distance);
    if (!cells.has(key)) cells.set(key, []);
    cells.get(key).push(p);
  }
  for (const own of cells.values()) for (let i = 0; i < own.length; i++) for (let j = i + 1; j < own.length; j++)
    if (Math.hypot(own[i].x - own[j].x, own[i].y - own[j].y) < distance) shift(own[i], own[j], distance, share);
}
const sheet = document.getElementById("sheet"), pen = sheet.getContext("2d"), about = document.getElementById("about");
let frame;
function draw() {
  sheet.width = innerWidth; sheet.height = innerHeight;
  const xs = spots.map(p => p.x), ys = spots.map(p => p.y), edge = 50;
  const span = v => { let lo = Infinity, hi = -Infinity; for (const x of v) { lo = Math.min(lo, x); hi = Math.max(hi, x); } return [lo, Math.max(1, hi - lo)]; };
  const [left, wide] = span(xs), [top, high] = span(ys);
  frame = p => [edge + (p.x - left) / wide * (sheet.width - 2 * edge), edge + (p.y - top) / high * (sheet.height - 2 * edge)];
  const heaviest = ends.reduce((m, {e}) => Math.max(m, Math.abs(e.z)), 0) || 1;
  for (const {e, a, b} of ends) {
    const [x, y] = frame(a), [u, v] = frame(b);
    pen.strokeStyle = "#9ab"; pen.lineWidth = 1 + 5 * Math.abs(e.z) / heaviest;
    pen.beginPath(); pen.moveTo(x, y); pen.lineTo(u, v); pen.stroke();
    if (graph.directed) { pen.fillStyle = "#357"; pen.fillRect(x + 0.8 * (u - x) - 3, y + 0.8 * (v - y) - 3, 6, 6); }
  }
  pen.textAlign = "center"; pen.textBaseline = "middle";
  for (const p of spots) {
    const [x, y] = frame(p);
    pen.font = p.n.font_size + "px sans-serif";
    pen.lineWidth = 4; pen.strokeStyle = "#fff"; pen.strokeText(p.n.label, x, y);
    pen.fillStyle = "#123"; pen.fillText(p.n.label, x, y);
  }
}
const told = (o, names) => names.map(k => k + ": " + (Array.isArray(o[k]) ? o[k].join(", ") : o[k])).join("\\n");
onresize = draw;
sheet.onmousemove = m => {
  let best = null, reach = 20;
  for (const p of spots) { const [x, y] = frame(p), d = Math.hypot(m.offsetX - x, m.offsetY - y); if (d < reach) { reach = d; best = told(p.n, ["id", "df", "idf", "fq", "degree"]); } }
  if (!best) for (const {e, a, b} of ends) { const [x, y] = frame(a), [u, v] = frame(b), d = Math.hypot(m.offsetX - (x + u) / 2, m.offsetY - (y + v) / 2); if (d < reach) { reach = d; best = told(e, ["source", "target", "ctf", "cdf", "cw", "z", "unit_ids"]); } }
  about.textContent = best || "";
};
draw();
</script>"""
#: Pixels of an edge for each unit of a configured length, and of one without.
LENGTH_PIXELS, DEFAULT_PIXELS = 55, 78


def page_lines(edges: DataFrame, config: Config) -> DataFrame:
    """An interactive page with the graph in it."""
    spark = edges.sparkSession
    text = lambda column: c.script_string(F.col(column))
    units = F.coalesce(F.array_join(F.transform("unit_ids", c.script_string), ","), F.lit(""))
    node = _text('{"id":', text("id"), ',"label":', text("label"), ',"df":', _int("df"), ',"idf":', _g("idf"), ',"fq":', _int("fq"), ',"degree":', _int("degree"), ',"font_size":', _g("font_size"), "}", _comma())
    edge = _text('{"source":', text("token1"), ',"target":', text("token2"), ',"ctf":', _int("ctf"), ',"cdf":', _int("cdf"), ',"cw":', _g("cw"), ',"z":', _g("z"), ',"unit_ids":[', units, "]}", _comma())
    length = DEFAULT_PIXELS if config.edge_length is None else config.edge_length * LENGTH_PIXELS
    head = [*PAGE_HEAD.split("\n"), f"const distance = {f.g(length, 17)};", f'const graph = {{"directed":{json.dumps(config.directed)},"nodes":[']
    return _union(
        _fixed(spark, 0, *head), _lines(_last(sized_nodes(edges, config)), 1, "row", node, NODE_NUMBERS), _fixed(spark, 2, '],"links":['), _lines(_last(edges), 3, "row", edge, SCORES), _fixed(spark, 4, "]};", *PAGE_FOOT.split("\n"))
    )


def lines(edges: DataFrame, config: Config) -> DataFrame:
    """The lines of a graph in the configured format, of edges with ``row`` and ``unit_ids``."""
    kept = prune(edges, config.min_cw, config.min_z)
    writers = {"json": json_lines, "dot": dot_lines, "d3": page_lines, "md": table_lines, "tex": table_lines, "html": table_lines}
    if config.format not in writers:
        raise OptionError(f"no such format: {config.format}")
    return writers[config.format](kept, config)


def render(edges: DataFrame, config: Config) -> str:
    """The whole text, for graphs that fit the driver."""
    return "".join(r["line"] + "\n" for r in lines(edges, config).orderBy("section", "row").toLocalIterator())


def save(edges: DataFrame, config: Config, path: str) -> None:
    """Text files whose concatenation, in the order of their names, is the whole text."""
    lines(edges, config).orderBy("section", "row").select("line").write.text(path)


def pair_lines(pairs: DataFrame, rejected: str | None = None) -> DataFrame:
    """(line) of pairs, columns separated by tabs. With the condition ``rejected``, also whether it holds for a row; the
    line is the unit's id then."""
    line = F.concat_ws("\t", "unit_id", "token1", "token2", F.col("fq1").cast("string"), F.col("fq2").cast("string"))
    return pairs.select(line.alias("line")) if rejected is None else pairs.select(F.expr(rejected).alias("rejected"), line.alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """(row, line) of edges: idf with 12 digits, cw and z with 17, a hyphen for a missing fq, then the unit ids."""
    ends = [x for i in (1, 2) for x in (_int(f"df{i}"), _g(f"idf{i}", 12), _int(f"fq{i}", "-"))]
    line = F.concat_ws("\t", "token1", "token2", _int("ctf"), _int("cdf"), *ends, _g("cw"), _g("z"), "unit_ids")
    return _lines(edges, 0, "row", line, [("idf1", 12), ("idf2", 12), *SCORES]).select("row", "line")


def edge_pieces(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(row, place, ord, text): the lines of ``edge_lines`` in pieces, whose order is that of these columns: an edge's
    numbers, each of its units (pattern1, pattern2, unit_id, ord), a line feed. No row has more than one unit."""
    kind = units.schema["ord"].dataType.simpleString()
    own = ["row", "pattern1", "pattern2"]
    heads = edge_lines(edges.withColumn("unit_ids", F.lit(None).cast("array<string>"))).select("row", F.lit(0).alias("place"), F.lit(None).cast(kind).alias("ord"), F.col("line").alias("text"))
    tails = edges.select(*own).join(units, ["pattern1", "pattern2"]).select("row", F.lit(1).alias("place"), "ord", F.concat(F.lit("\t"), "unit_id").alias("text"))
    ends = edges.select("row", F.lit(2).alias("place"), F.lit(None).cast(kind).alias("ord"), F.lit("\n").alias("text"))
    return heads.union(tails).union(ends)
