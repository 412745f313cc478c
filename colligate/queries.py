"""The registered queries over the given tables, and their SQL.

Units are orders (tokens: their parts, ``key/name/brand/type``) and users (tokens: their events in
order of time).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.functions import tokens as t
from colligate.operators import graph
from colligate.operators.pairs import ordered_pair_counts, pair, pair_counts, pair_table, pair_types, run_counts
from colligate.plans import weigh as w
from colligate.plans.config import Config
from colligate.sinks import graph as sinks
from colligate.sources.text import units_from_table

Query = Callable[[SparkSession, str], DataFrame]
BRAND, TYPE, BRAND_TYPE = (3,), (4,), (3, 4)
KEY, KEY_SQL = "^Brand#1[1-3]$", "^Brand#1[1-3]$"
METRICS = ["idf1", "idf2", "cw", "z"]
CORE = 8
BLOCK = 48
SHARES = (0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)
STARTS = "%/Brand#11/%"


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    token = F.concat_ws("/", F.col("p_partkey").cast("string"), F.translate("p_name", " ", "_"), "p_brand", F.translate("p_type", " ", "_"))
    return parts.select(F.col("p_partkey").alias("l_partkey"), token.alias("token"))


def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber").join(part_tokens(spark, sf_dir), "l_partkey")
    return units_from_table(items, "l_orderkey", F.col("token"), ["l_linenumber", "l_partkey"])


EVENT_ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each return flag: three units that have all rows."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_suppkey")
    return pair_types(items, "l_returnflag", F.col("l_suppkey").cast("string"), BLOCK)


def event_pairs(window: int, ordered: bool = False) -> Query:
    """Counts of pairs of events that follow each other closely."""
    return lambda spark, sf_dir: pair_counts(pair_table(events(spark, sf_dir), "user_id", F.col("event_type"), EVENT_ORDER, window, ordered, with_counts=False))


def corpus_of_orders(spark: SparkSession, sf_dir: str, fields: Sequence[int]) -> w.Corpus:
    return w.corpus_of_units(order_units(spark, sf_dir), fields, one_row=True)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def edges(fields: Sequence[int], method: int, key: str | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if key is None:
            found = w.weigh_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_partkey", part_tokens(spark, sf_dir), fields, method)
        else:
            found = w.weigh(corpus_of_orders(spark, sf_dir, fields), key, method)
        return rounded(found.select(*w.EDGE_COLUMNS), *METRICS)

    return query


def of_edges(then: Callable[[DataFrame], DataFrame], fields: Sequence[int] = BRAND, method: int = 16) -> Query:
    """A query on the edges of all orders."""
    return lambda spark, sf_dir: then(w.weigh(corpus_of_orders(spark, sf_dir, fields), None, method))


def of_units(units: Callable[[SparkSession, str], DataFrame], then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(units(spark, sf_dir))


def of_corpus(then: Callable[[w.Corpus], DataFrame], fields: Sequence[int] = BRAND) -> Query:
    return lambda spark, sf_dir: then(corpus_of_orders(spark, sf_dir, fields))


def projections(units: DataFrame) -> DataFrame:
    chosen = {"p1": (1,), "p2": (2,), "p3": (3,), "p23": (2, 3), "p14": (1, 4), "all_fields": t.SURFACE_FIELDS, "default_fields": t.DEFAULT_FIELDS}
    tokens = units.select(F.explode("tokens").alias("token")).distinct()
    columns: list[Column] = [t.project(F.col("token"), c).alias(name) for name, c in chosen.items()]
    return tokens.select("token", *columns, t.label(F.col("token"), (4, 3), ":").alias("label43"), t.field(F.col("token"), 2).alias("field2"), t.field_equals(F.col("token"), 3, "Brand#11").alias("is_brand11"))


def local_stats(c: w.Corpus) -> DataFrame:
    return w.token_stats(c, w.key_units(c, KEY)).select("pattern", "token", "df", "fq", "fq_local")


def table_rows(format: str) -> Callable[[DataFrame], DataFrame]:
    config = Config(format=format, columns=("token1", "token2", "raw_token1", "ctf", "df1", "fq2"), table_label_fields=(3, 4), table_label_separator=":")

    def rows(found: DataFrame) -> DataFrame:
        edges_ = sinks.numbered(found.withColumn("unit_ids", F.lit(None).cast("array<string>")), "pattern1", "pattern2")
        return sinks.table_lines(edges_, config).filter("section = 1").select(F.col("line"))

    return rows


def z_summary(found: DataFrame) -> DataFrame:
    about = graph.summary(found, "z", (0.25, 0.5, 0.75)).selectExpr("n", "least", "largest", "skewness", "kurtosis", *(f"percentiles[{i}] as p{p}" for i, p in enumerate((25, 50, 75))))
    return rounded(about, *about.columns[1:])


def reached_from(found: DataFrame) -> DataFrame:
    kept = graph.prune(found, min_z=1.0)
    return graph.reached(kept, graph.nodes(found).filter(F.col("id").like(STARTS)))


QUERIES: dict[str, Query] = {
    "pair_unordered": of_units(order_units, lambda u: pair(u).select("unit_id", "token1", "token2", "fq1", "fq2")),
    "pair_ordered": of_units(events, lambda e: ordered_pair_counts(e, "user_id", F.col("event_type"), EVENT_ORDER)),
    "pair_blocks": supplier_pairs,
    "event_runs": of_units(events, lambda e: run_counts(e, ["event_type"], "user_id", EVENT_ORDER)),
    "pair_window3": event_pairs(3),
    "pair_adjacent": event_pairs(1),
    "pair_adjacent_ordered": event_pairs(1, True),
    "pattern_project": of_units(order_units, projections),
    "pattern_fallback": of_units(events, lambda e: e.select(F.col("event_type").alias("token")).filter("token is not null").distinct().select("token", t.project(F.col("token"), (2, 3)).alias("p23"), t.project(F.col("token"), (1, 2)).alias("p12"))),
    "unit_count": of_corpus(lambda c: c.units),
    "token_stats": of_corpus(lambda c: rounded(w.token_stats(c).select("pattern", "token", "df", "idf", "fq"), "idf")),
    "pair_gdf": of_corpus(lambda c: w.pair_stats(c).select("pattern1", "pattern2", "gdf"), BRAND_TYPE),
    "pair_unit_ids": of_corpus(lambda c: w.edge_units(c).select("pattern1", "pattern2", "unit_id")),
    "key_units": of_corpus(lambda c: w.key_units(c, KEY)),
    "local_stats": of_corpus(local_stats),
    "key_frequency": of_corpus(lambda c: w.key_frequency(w.token_stats(c, w.key_units(c, KEY)), c, KEY)),
    "cw_m1": edges(BRAND, 1),
    "cw_m1_key": edges(BRAND, 1, KEY),
    "cw_m7_key": edges(BRAND, 7, KEY),
    "cw_m12_key": edges(BRAND, 12, KEY),
    "cw_m16": edges(BRAND_TYPE, 16),
    "cw_m16_key": edges(BRAND, 16, KEY),
    "cw_surface": edges(t.SURFACE_FIELDS, 16),
    "edges_min_z": of_edges(lambda e: rounded(graph.prune(e, min_z=0.5).select(*w.EDGE_COLUMNS), *METRICS)),
    "edges_min_cw": of_edges(lambda e: rounded(graph.prune(e, min_cw=0.05).select(*w.EDGE_COLUMNS), *METRICS), TYPE),
    "edges_exclude": of_edges(lambda e: graph.exclude(e, "Brand#1[0-9]").select("token1", "token2", "ctf")),
    "edges_topk_ctf": of_edges(lambda e: graph.top_edges(e, 20, "ctf").select("token1", "token2", "ctf")),
    "nodes_degree": of_edges(lambda e: rounded(graph.nodes(e), "idf")),
    "nodes_font_fq": of_edges(lambda e: rounded(graph.with_font_size(graph.nodes(e), "fq").select("id", "font_size"), "font_size")),
    "nodes_font_idf": of_edges(lambda e: rounded(graph.with_font_size(graph.nodes(e), "idf", 6, 18).select("id", "font_size"), "font_size")),
    "nodes_font_degree": of_edges(lambda e: rounded(graph.with_font_size(graph.nodes(graph.prune(e, min_z=0.5)), "degree").select("id", "degree", "font_size"), "font_size")),
    "table_md_rows": of_edges(table_rows("md")),
    "table_html_rows": of_edges(table_rows("html")),
    "table_tex_rows": of_edges(table_rows("tex")),
    "edges_awk_compound": of_edges(lambda e: rounded(graph.prune(e, min_cw=1.0, min_z=0.5, min_ctf=2).select(*w.EDGE_COLUMNS), *METRICS), BRAND_TYPE),
    "edges_one_endpoint": of_edges(lambda e: graph.touching(e, "Brand#1[0-9]").select("token1", "token2", "ctf")),
    "node_labels": of_edges(lambda e: graph.nodes(e).select("id", t.label(F.col("id"), (4, 2), ":").alias("label"), F.array_join(t.label_fields(F.col("id")), "|").alias("fields"))),
    "transitions": of_units(events, lambda e: rounded(graph.transitions_of_table(e, "user_id", F.col("event_type"), EVENT_ORDER), "p")),
    "graph_components": of_edges(lambda e: graph.components(graph.prune(e, min_z=1.0))),
    "graph_kcore": of_edges(lambda e: graph.k_core(graph.prune(e, min_z=0.0), CORE).select("token1", "token2")),
    "graph_coreness": of_edges(lambda e: graph.coreness(graph.prune(e, min_z=0.0))),
    "graph_reached": of_edges(reached_from),
    "z_quantiles": of_edges(lambda e: rounded(graph.quantile_table(e, "z", SHARES), "value"), BRAND_TYPE),
    "z_distribution": of_edges(lambda e: graph.distribution(e, "z", 8).select("bin", "n"), BRAND_TYPE),
    "z_summary": of_edges(z_summary, BRAND_TYPE),
}


# The same in DuckDB's SQL.
POS = """
tok as (
  select l_orderkey as u, l_linenumber as ln, l_partkey as pk,
         concat_ws('/', cast(p_partkey as varchar), replace(p_name, ' ', '_'), p_brand, replace(p_type, ' ', '_')) as t
  from lineitem join part on l_partkey = p_partkey
), pos as (
  select u, t, ln, pk, count(*) over (partition by u, t) as c from tok
), once as (
  select distinct u, t, c from pos
)"""
EVENTS = """
ev as (
  select user_id as u, event_type as t, row_number() over (partition by user_id order by ts, event_id) as i from events
)"""


def _pattern(fields: Sequence[int], token: str = "t") -> str:
    return "concat_ws('/', " + ", ".join(f"split_part({token}, '/', {n})" for n in fields) + ")"


def stats_sql(fields: Sequence[int], key: str | None = None) -> str:
    """CTEs up to ``st`` (a row per pattern) and ``pr`` (a row per pair)."""
    sel = "select distinct u from te" if key is None else f"select distinct u from pp where regexp_matches(p1, '{key}') or regexp_matches(p2, '{key}')"
    return f"""{POS}, te as materialized (
  select u, t, c, {_pattern(fields)} as p from once where u in (select u from once group by u having count(*) > 1)
), pp as materialized (
  select distinct a.u, least(a.p, b.p) as p1, greatest(a.p, b.p) as p2 from te a join te b on a.u = b.u and a.p <> b.p
), sel as materialized ({sel}
), n as (select count(distinct u) as n from te
), va as (
  select p, t, count(*) as v from te group by p, t
), rp as (
  select p, t from (select p, t, row_number() over (partition by p order by v desc, t) as k from va) where k = 1
), st as materialized (
  select te.p, rp.t, count(distinct te.u) as df, ln((select n from n) / count(distinct te.u)) as idf, sum(te.c) as fq,
         sum(case when sel.u is not null then te.c else 0 end) as lq
  from te join rp on te.p = rp.p left join sel on sel.u = te.u group by te.p, rp.t
), pr as materialized (
  select p1, p2, count(*) as gdf, count(sel.u) as ctf from pp left join sel on sel.u = pp.u group by p1, p2
)"""


def edges_sql(fields: Sequence[int], method: int, key: str | None = None) -> str:
    """CTEs up to ``ed``, edges that are not rounded."""
    kq = "0" if key is None else f"(select sum(lq) from st where regexp_matches(p, '{key}'))"
    weight = {
        1: "(1 + ln(ctf))",
        7: f"(1 + ln(ctf) / ln(10)) / (1 + ln({kq}) / ln(10))",
        12: f"(1 + cast({kq} as bigint) // ctf)",
        16: "(1 + ln((select n from n) / gdf)) * (1 + ln(ctf))",
    }[method]
    return f"""with {stats_sql(fields, key)}, sc as (
  select p1, p2, a.t as token1, b.t as token2, ctf, gdf, a.df as df1, a.idf as idf1, a.lq as fq1, b.df as df2, b.idf as idf2, b.lq as fq2,
         {weight} * sqrt(a.idf * b.idf) as cw
  from pr join st a on a.p = p1 join st b on b.p = p2 where ctf > 0
), sd as materialized (
  select avg(cw) as m, coalesce(stddev_samp(cw), 0) as s from sc
), ed as materialized (
  select p1, p2, token1, token2, cast(ctf as bigint) as ctf, cast(ctf as bigint) as cdf, cast(df1 as bigint) as df1, idf1, cast(fq1 as bigint) as fq1,
         cast(df2 as bigint) as df2, idf2, cast(fq2 as bigint) as fq2, cw, case when s > 0 then (cw - m) / s else 0 end as z
  from sc cross join sd
)
"""


EDGES = "select token1, token2, ctf, cdf, df1, round(idf1, 6) + 0.0 as idf1, fq1, df2, round(idf2, 6) + 0.0 as idf2, fq2, round(cw, 6) + 0.0 as cw, round(z, 6) + 0.0 as z from ed"
NODES = """, nd as (
  select id, min(df) as df, min(idf) as idf, min(fq) as fq, count(*) as degree from (
    select token1 as id, df1 as df, idf1 as idf, fq1 as fq from ed {where} union all select token2, df2, idf2, fq2 from ed {where}) group by id
) """
SIZE = """select id, {more} round(case when (select max({by}) from nd) > (select min({by}) from nd)
  then {a} + ({by} - (select min({by}) from nd)) / cast((select max({by}) from nd) - (select min({by}) from nd) as double) * ({b} - {a}) else ({a} + {b}) / 2.0 end, 6) as font_size from nd"""


def _counts(join: str, first: str, second: str) -> str:
    return f"""with {EVENTS}, pr as (select a.u, {first} as token1, {second} as token2 from ev a join ev b on a.u = b.u and {join})
select token1, token2, count(*) as n, count(distinct u) as n_units from pr group by token1, token2"""


def _edges(fields: Sequence[int], method: int, key: str | None = None, tail: str = "") -> str:
    return edges_sql(fields, method, key) + EDGES + tail


#: Rounds that take away nodes of a low degree; one each suffices for these nodes, of which there are 25.
CORE_ROUNDS = 25


def _peeled(i: int) -> str:
    ends = f"select id from (select token1 as id from k{i} union all select token2 from k{i}) group by id having count(*) >= {CORE}"
    return f""", k{i + 1} as materialized (select token1, token2 from k{i} where token1 in ({ends}) and token2 in ({ends}))"""


def _all_cores() -> str:
    """CTEs from ``c0``: edges of each k, peeled by as many rounds as there may be nodes."""
    first = ", c0 as materialized (select k, token1, token2 from ed, (select unnest(range(1, 60)) as k) where z >= 0)"
    ends = "select k, id from (select k, token1 as id from c{i} union all select k, token2 from c{i}) group by k, id having count(*) >= k"
    rounds = [f", c{i + 1} as materialized (select c{i}.* from c{i} where (k, token1) in ({ends.format(i=i)}) and (k, token2) in ({ends.format(i=i)}))" for i in range(CORE_ROUNDS)]
    return first + "".join(rounds)


def _stats(fields: Sequence[int], select: str, key: str | None = None) -> str:
    return f"with {stats_sql(fields, key)} {select}"


ORACLE_SQL: dict[str, str] = {
    "pair_unordered": f"with {POS} select cast(a.u as varchar) as unit_id, a.t as token1, b.t as token2, a.c as fq1, b.c as fq2 from once a join once b on a.u = b.u and a.t < b.t",
    "pair_ordered": _counts("a.i < b.i", "a.t", "b.t"),
    "pair_blocks": """with tk as (select l_returnflag as u, cast(l_suppkey as varchar) as t, count(*) as c from lineitem group by all)
select a.u as unit_id, a.t as token1, b.t as token2, a.c as fq1, b.c as fq2 from tk a join tk b on a.u = b.u and a.t < b.t""",
    "event_runs": """with la as (select event_type, user_id, lag(user_id) over (partition by event_type order by ts, event_id) as l, row_number() over (partition by event_type order by ts, event_id) as i from events)
select event_type, count_if(i = 1 or l is distinct from user_id)::bigint as runs from la group by event_type""",
    "pair_window3": _counts("b.i - a.i between 1 and 3", "least(a.t, b.t)", "greatest(a.t, b.t)"),
    "pair_adjacent": _counts("b.i - a.i = 1", "least(a.t, b.t)", "greatest(a.t, b.t)"),
    "pair_adjacent_ordered": _counts("b.i - a.i = 1", "a.t", "b.t"),
    "pattern_project": f"""with {POS} select distinct t as token, {_pattern((1,))} as p1, {_pattern((2,))} as p2, {_pattern((3,))} as p3, {_pattern((2, 3))} as p23, {_pattern((1, 4))} as p14,
  t as all_fields, {_pattern((2, 3, 4))} as default_fields, split_part(t, '/', 4) || ':' || split_part(t, '/', 3) as label43, split_part(t, '/', 2) as field2, split_part(t, '/', 3) = 'Brand#11' as is_brand11 from tok""",
    "pattern_fallback": "select distinct event_type as token, event_type as p23, event_type as p12 from events",
    "unit_count": _stats(BRAND, "select n from n"),
    "token_stats": _stats(BRAND, "select p as pattern, t as token, df, round(idf, 6) + 0.0 as idf, cast(fq as bigint) as fq from st"),
    "pair_gdf": _stats(BRAND_TYPE, "select p1 as pattern1, p2 as pattern2, gdf from pr"),
    "pair_unit_ids": _stats(BRAND, "select p1 as pattern1, p2 as pattern2, cast(u as varchar) as unit_id from pp"),
    "key_units": _stats(BRAND, "select cast(u as varchar) as unit_id from sel", KEY_SQL),
    "local_stats": _stats(BRAND, "select p as pattern, t as token, df, cast(fq as bigint) as fq, cast(lq as bigint) as fq_local from st", KEY_SQL),
    "key_frequency": _stats(BRAND, f"select cast(sum(lq) as bigint) as key_fq from st where regexp_matches(p, '{KEY_SQL}')", KEY_SQL),
    "cw_m1": _edges(BRAND, 1),
    "cw_m1_key": _edges(BRAND, 1, KEY_SQL),
    "cw_m7_key": _edges(BRAND, 7, KEY_SQL),
    "cw_m12_key": _edges(BRAND, 12, KEY_SQL),
    "cw_m16": _edges(BRAND_TYPE, 16),
    "cw_m16_key": _edges(BRAND, 16, KEY_SQL),
    "cw_surface": _edges(t.SURFACE_FIELDS, 16),
    "edges_min_z": _edges(BRAND, 16, None, " where ed.z >= 0.5"),
    "edges_min_cw": _edges(TYPE, 16, None, " where ed.cw >= 0.05"),
    "edges_exclude": edges_sql(BRAND, 16) + "select token1, token2, ctf from ed where not regexp_matches(token1, 'Brand#1[0-9]') and not regexp_matches(token2, 'Brand#1[0-9]')",
    "edges_topk_ctf": edges_sql(BRAND, 16) + "select token1, token2, ctf from ed order by ctf desc, token1, token2 limit 20",
    "nodes_degree": edges_sql(BRAND, 16) + NODES.format(where="") + "select id, df, round(idf, 6) + 0.0 as idf, fq, degree from nd",
    "nodes_font_fq": edges_sql(BRAND, 16) + NODES.format(where="") + SIZE.format(by="fq", a="7.0", b="32.0", more=""),
    "nodes_font_idf": edges_sql(BRAND, 16) + NODES.format(where="") + SIZE.format(by="idf", a="6.0", b="18.0", more=""),
    "nodes_font_degree": edges_sql(BRAND, 16) + NODES.format(where="where z >= 0.5") + SIZE.format(by="degree", a="7.0", b="32.0", more="degree,"),
    "table_md_rows": edges_sql(BRAND, 16) + """select '| ' || split_part(token1, '/', 3) || ':' || split_part(token1, '/', 4) || ' | ' || split_part(token2, '/', 3) || ':' || split_part(token2, '/', 4)
  || ' | ' || token1 || ' | ' || ctf || ' | ' || df1 || ' | ' || fq2 || ' |' as line from ed""",
    "table_html_rows": edges_sql(BRAND, 16) + """select '    <tr><td>' || split_part(token1, '/', 3) || ':' || split_part(token1, '/', 4) || '</td><td>' || split_part(token2, '/', 3) || ':' || split_part(token2, '/', 4)
  || '</td><td>' || token1 || '</td><td class="numeric">' || ctf || '</td><td class="numeric">' || df1 || '</td><td class="numeric">' || fq2 || '</td></tr>' as line from ed""",
    "table_tex_rows": edges_sql(BRAND, 16) + r"""select replace(replace(split_part(token1, '/', 3) || ':' || split_part(token1, '/', 4) || ' & ' || split_part(token2, '/', 3) || ':' || split_part(token2, '/', 4)
  || ' & ' || token1, '#', '\#'), '_', '\_') || ' & ' || ctf || ' & ' || df1 || ' & ' || fq2 || ' \\' as line from ed""",
    "edges_awk_compound": _edges(BRAND_TYPE, 16, None, " where ed.ctf >= 2 and ed.cw >= 1.0 and ed.z >= 0.5"),
    "edges_one_endpoint": edges_sql(BRAND, 16) + "select token1, token2, ctf from ed where regexp_matches(token1, 'Brand#1[0-9]') or regexp_matches(token2, 'Brand#1[0-9]')",
    "node_labels": edges_sql(BRAND, 16) + NODES.format(where="") + "select id, split_part(id, '/', 4) || ':' || split_part(id, '/', 2) as label, replace(id, '/', '|') as fields from nd",
    "transitions": f"""with {EVENTS}, fr as (
  select u, i, t from ev union all select distinct u, 0, '<BOS>' from ev union all select u, max(i) + 1, '<EOS>' from ev group by u
), af as (
  select a.t as x, b.t as y, count(*) as af from fr a join fr b on a.u = b.u and b.i = a.i + 1 group by a.t, b.t
) select x, y, af, round(af / sum(af) over (partition by x), 6) + 0.0 as p from af""",
    "graph_components": edges_sql(BRAND, 16).replace("with ", "with recursive ", 1) + """, lk as (
  select token1 as a, token2 as b from ed where z >= 1.0 union select token2, token1 from ed where z >= 1.0
), re as (
  select a as id, a as r from lk union select re.id, lk.b from re join lk on re.r = lk.a
) select id, min(r) as component from re group by id""",
    "graph_kcore": edges_sql(BRAND, 16) + ", k0 as materialized (select token1, token2 from ed where z >= 0)" + "".join(_peeled(i) for i in range(CORE_ROUNDS)) + f" select token1, token2 from k{CORE_ROUNDS}",
    "graph_coreness": edges_sql(BRAND, 16) + _all_cores() + f"""select id, cast(max(k) as bigint) as core from (select token1 as id, 0 as k from ed where z >= 0 union all select token2, 0 from ed where z >= 0
  union all select token1, k from c{CORE_ROUNDS} union all select token2, k from c{CORE_ROUNDS}) group by id""",
    "graph_reached": edges_sql(BRAND, 16).replace("with ", "with recursive ", 1) + f""", lk as (
  select token1 as a, token2 as b from ed where z >= 1.0 union select token2, token1 from ed where z >= 1.0
), re as (
  select id, 0 as steps from (select token1 as id from ed union select token2 from ed) where id like '{STARTS}' union select lk.b, re.steps + 1 from re join lk on re.id = lk.a where re.steps < 30
) select id, min(steps) as steps from re group by id""",
    "z_quantiles": edges_sql(BRAND_TYPE, 16) + " union all ".join(f"select {s!r}::double as share, round(quantile_cont(z, {s!r}), 6) + 0.0 as value from ed" for s in SHARES),
    "z_distribution": edges_sql(BRAND_TYPE, 16) + """, bo as (select min(z) as lo, max(z) as hi from ed)
select cast(case when hi > lo then least(floor((z - lo) / ((hi - lo) / 8)), 7) else 0 end as integer) as bin, count(*) as n from ed cross join bo group by 1""",
    "z_summary": edges_sql(BRAND_TYPE, 16) + """, mo as (select avg(z) as m from ed)
select count(*) as n, round(min(z), 6) + 0.0 as least, round(max(z), 6) + 0.0 as largest,
       round(avg((z - m) ** 3) / avg((z - m) ** 2) ** 1.5, 6) + 0.0 as skewness, round(avg((z - m) ** 4) / avg((z - m) ** 2) ** 2 - 3, 6) + 0.0 as kurtosis,
       round(quantile_cont(z, 0.25), 6) + 0.0 as p25, round(quantile_cont(z, 0.5), 6) + 0.0 as p50, round(quantile_cont(z, 0.75), 6) + 0.0 as p75
from ed cross join mo""",
}
