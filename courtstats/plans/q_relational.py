"""Operator-level queries (scans, projection, filters, joins, ranks,
aggregates, strings) over the driver tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtstats.functions.arith import safe_div
from courtstats.functions.columns import derive, drop_lenient, select_range, select_regex
from courtstats.functions.text import (
    ASCII_FOLD_FROM, ASCII_FOLD_MULTI, ASCII_FOLD_TO, ascii_fold, name_override, nth_word, season_end_year,
    season_slug, title_case, words_range,
)
from courtstats.operators.aggregate import (
    block_sums, exact_median, group_count, group_stat_onto_rows, pivot_counts, unpivot, weighted_mean,
)
from courtstats.operators.filters import qualify_min
from courtstats.operators.joins import (
    anti_join, join_suffix, merge_indicator, natural_join, role_join,
)
from courtstats.operators.rank import drop_leader, group_argmax, prefer_total_row, top_n
from courtstats.plans import oracle_views as O
from courtstats.plans import views as V
from courtstats.plans.registry import r6, register
from courtstats.sources.ingest import clean_names, missing_ids, page_links, union_sources
from courtstats.sources.tables import TABLE_SCHEMAS, read_table, table, write_table

# --- A: scans, unions, backfill, sinks -------------------------------------------------

_SCAN_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
              "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
              "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id",
              "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
              "labels": "doc_id", "conversations": "conv_id"}


@register("scan_parquet", " UNION ALL ".join(
    f"SELECT '{t}' AS source, count(*) AS n_rows, CAST(sum({k}) AS BIGINT) AS key_sum FROM {t}"
    for t, k in _SCAN_KEYS.items()))
def scan_parquet(spark, sf):
    frames = {t: table(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(k).cast("long").alias("key_sum"))
              for t, k in _SCAN_KEYS.items()}
    return union_sources(frames, "source")


@register("multi_source_union", """
SELECT n_name AS name, n_nationkey AS key, 'nation' AS source FROM nation
UNION ALL SELECT r_name, r_regionkey, 'region' FROM region
UNION ALL SELECT s_name, CAST(s_suppkey AS INTEGER), 'supplier' FROM supplier""")
def multi_source_union(spark, sf):
    return union_sources({
        "nation": table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")),
        "region": table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")),
        "supplier": table(spark, sf, "supplier").select(F.col("s_name").alias("name"),
                                                        F.col("s_suppkey").cast("int").alias("key")),
    })


@register("season_slug", """
SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS slug,
  CAST(year(o_orderdate) AS INTEGER) + 1 AS end_year
FROM orders""")
def season_slug_q(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    o = o.withColumn("slug", season_slug("year"))
    return o.withColumn("end_year", season_end_year("slug"))


@register("missing_ids", """
SELECT DISTINCT o_orderkey AS id, 'missing' AS status FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""")
def missing_ids_q(spark, sf):
    """Games that are expected (``orders``) but did not land (``lineitem``)."""
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return missing_ids(table(spark, sf, "lineitem"), expected, "l_orderkey")


@register("csv_roundtrip", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status_na FROM orders""")
def csv_roundtrip(spark, sf, path=None):
    """Write ``orders`` as CSV (NA for missing) to ``path`` (by default a new
    folder under the shared checkpoint folder) and read it back with an
    explicit schema.  The write runs when the query is built."""
    import uuid

    from pyspark.sql import types as T

    from courtstats.session import checkpoint_dir

    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status_na"))
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/csv_roundtrip/{uuid.uuid4().hex}"
    write_table(o, path, fmt="csv")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
                           T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderpriority", T.StringType()),
                           T.StructField("status_na", T.StringType())])
    return read_table(spark, path, schema, fmt="csv")


# Nation keys of the 'West' conference.
WEST = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]


@register("conference_split", """
SELECT CASE WHEN c_nationkey IN (""" + ", ".join(map(str, WEST)) + """) THEN 'West' ELSE 'East' END AS conference,
       count(*) AS customers FROM customer GROUP BY 1""")
def conference_split(spark, sf):
    c = table(spark, sf, "customer")
    conf = F.when(F.col("c_nationkey").isin(WEST), "West").otherwise("East")
    return c.groupBy(conf.alias("conference")).agg(F.count(F.lit(1)).alias("customers"))


@register("page_links", """
SELECT DISTINCT page_id, link FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) x
WHERE regexp_matches(link, '^/')""")
def page_links_q(spark, sf):
    return page_links(table(spark, sf, "pages"), "^/")


@register("clean_names_q", """
SELECT c_custkey AS cust_key, c_name AS name, c_acctbal AS acct_bal_percent, c_mktsegment AS x2021_22,
       c_nationkey AS nation_key FROM customer""")
def clean_names_q(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("Name"),
        F.col("c_acctbal").alias("Acct Bal %"), F.col("c_mktsegment").alias("2021-22"),
        F.col("c_nationkey").alias("NationKey"))
    return clean_names(c)


# --- B: projection and reshaping --------------------------------------------------------

@register("project_basic", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def project_basic(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")


@register("select_range", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_range_q(spark, sf):
    return select_range(table(spark, sf, "lineitem"), "l_quantity", "l_tax", "l_orderkey")


@register("select_regex", "SELECT l_extendedprice, l_discount, l_tax FROM lineitem")
def select_regex_q(spark, sf):
    return select_regex(table(spark, sf, "lineitem"), r"^l_(ext|disc|tax)")


@register("drop_lenient", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_lenient_q(spark, sf):
    o = table(spark, sf, "orders")
    return drop_lenient(o, "o_comment", "o_orderpriority", "o_orderdate")


@register("suffix_join", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice AS o_totalprice_x, round(a.o_totalprice, 6) AS o_totalprice_y
FROM orders o JOIN (SELECT o_custkey, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) a
  ON a.o_custkey = o.o_custkey""")
def suffix_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    per_cust = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("o_totalprice"))
    j = join_suffix(o, per_cust, "o_custkey")
    return j.withColumn("o_totalprice_y", r6("o_totalprice_y"))


@register("derive_after", """
SELECT o_orderkey, o_custkey, round(o_totalprice / 1000, 6) AS price_k, o_orderstatus FROM orders""")
def derive_after(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    d = derive(o, {"price_k": r6(F.col("o_totalprice") / 1000)}, after="o_custkey")
    return d.drop("o_totalprice")


@register("rate_block", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, season, round(pts / mp * 36, 6) AS pts, round(trb / mp * 36, 6) AS trb,
       round(ast / mp * 36, 6) AS ast FROM player_season"""))
def rate_block(spark, sf):
    ps = V.player_season(spark, sf)
    return ps.select("player_id", "season", *[r6(safe_div(c, "mp") * 36).alias(c) for c in ("pts", "trb", "ast")])


@register("per_unit_rate", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, season, round(pf / mp * 36, 6) AS fouls_per_36 FROM player_season"""))
def per_unit_rate(spark, sf):
    ps = V.player_season(spark, sf)
    return ps.select("player_id", "season", r6(safe_div("pf", "mp") * 36).alias("fouls_per_36"))


@register("case_bucket", """
SELECT CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid'
            WHEN o_totalprice IS NULL THEN NULL ELSE 'low' END AS bucket, count(*) AS n
FROM orders GROUP BY 1""")
def case_bucket(spark, sf):
    p = F.col("o_totalprice")
    b = F.when(p >= 300000, "high").when(p >= 100000, "mid").when(p.isNotNull(), "low")
    return table(spark, sf, "orders").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("fill_defaults", """
SELECT o.o_orderkey, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.qty, 0.0) AS qty
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) l
  ON l.l_orderkey = o.o_orderkey""")
def fill_defaults(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left").drop("l_orderkey")
    return j.na.fill({"n_lines": 0, "qty": 0.0})


@register("unpivot_measures", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, season, name, value FROM (UNPIVOT (SELECT player_id, season, pts, trb, ast FROM player_season)
  ON pts, trb, ast INTO NAME name VALUE value)"""))
def unpivot_measures(spark, sf):
    ps = V.player_season(spark, sf).select("player_id", "season", "pts", "trb", "ast")
    return unpivot(ps, ["player_id", "season"], ["pts", "trb", "ast"])


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("pivot_counts", "SELECT o_orderstatus, " + ", ".join(
    f"count_if(o_orderpriority = '{p}') AS \"{p}\"" for p in _PRIOS) + " FROM orders GROUP BY 1")
def pivot_counts_q(spark, sf):
    return pivot_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", _PRIOS)


@register("split_typed", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun,
       TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no FROM part""")
def split_typed(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", nth_word("p_name", 1).alias("adjective"), nth_word("p_name", 2).alias("noun"),
                    nth_word("p_brand", 2, "#").try_cast("int").alias("brand_no"))


@register("with_mean_row", O.with_views(O.TEAM_SEASON, body="""
SELECT tm, season, round(g_total, 6) AS g_total FROM team_season"""))
def with_mean_row_q(spark, sf):
    return V.team_season(spark, sf).select("tm", "season", r6("g_total").alias("g_total"))


@register("distinct_sorted", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct_sorted(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


# --- C: filters ------------------------------------------------------------------------------

@register("filter_arith", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_quantity >= 30 AND l_extendedprice / l_quantity >= 6 * 300 + 200""")
def filter_arith(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter((F.col("l_quantity") >= 30) & (F.col("l_extendedprice") / F.col("l_quantity") >= 6 * 300 + 200)) \
             .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@register("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@register("filter_nulls", """
SELECT o.o_orderkey, o.o_custkey FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE l.l_orderkey IS NULL""")
def filter_nulls(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").filter(F.col("l_orderkey").isNull()) \
            .select("o_orderkey", "o_custkey")


@register("qualify_share", O.with_views(O.BOX_ALL, body="""
SELECT p.player_id, p.season, round(p.g / t.g_total, 6) AS g_percent
FROM player_season p LEFT JOIN team_season t ON t.tm = p.tm AND t.season = p.season
WHERE p.g / t.g_total >= 0.5"""))
def qualify_share_q(spark, sf):
    from courtstats.operators.filters import qualify_share

    pts = V.player_team_season(spark, sf)
    q = qualify_share(V.player_season(spark, sf), V.team_season(spark, sf, pts=pts), ["tm", "season"], "g", "g_total", 0.5)
    return q.select("player_id", "season", r6("g_percent").alias("g_percent"))


@register("qualify_min", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, season, g, mp FROM player_season WHERE g >= 2 AND mp >= 50"""))
def qualify_min_q(spark, sf):
    return qualify_min(V.player_season(spark, sf), {"g": 2, "mp": 50}).select("player_id", "season", "g", "mp")


# --- D: joins ------------------------------------------------------------------------------------

@register("left_join_dim", """
SELECT c.c_custkey, c.c_name, n.n_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def left_join_dim(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", "n_name")


@register("natural_left", O.with_views(O.BOX_ALL, body="""
SELECT p.player_id, p.season, p.tm, t.g_total FROM player_season p
LEFT JOIN team_season t ON t.tm IS NOT DISTINCT FROM p.tm AND t.season IS NOT DISTINCT FROM p.season"""))
def natural_left(spark, sf):
    pts = V.player_team_season(spark, sf)
    ps = V.player_season(spark, sf).select("player_id", "season", "tm")
    ts = V.team_season(spark, sf, pts=pts).select("tm", "season", "g_total")
    return natural_join(ps, ts, "left")


@register("inner_suffix", """
SELECT o.o_orderkey, o.o_totalprice AS o_totalprice_x, round(l.o_totalprice, 6) AS o_totalprice_y
FROM orders o JOIN (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS o_totalprice FROM lineitem GROUP BY 1) l
  ON l.o_orderkey = o.o_orderkey""")
def inner_suffix(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("o_totalprice"))
    return join_suffix(o, li, "o_orderkey").withColumn("o_totalprice_y", r6("o_totalprice_y"))


@register("role_playing_dim", """
SELECT cn.n_regionkey AS cust_region, sn.n_regionkey AS supp_region, count(*) AS n_lines
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey
GROUP BY 1, 2""")
def role_playing_dim(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey) \
          .join(s, F.col("l_suppkey") == s.s_suppkey)
    nat = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    j = role_join(j, nat, {"c_nationkey": "cust_", "s_nationkey": "supp_"}, "n_nationkey")
    return j.groupBy(F.col("cust_n_regionkey").alias("cust_region"), F.col("supp_n_regionkey").alias("supp_region")) \
            .agg(F.count(F.lit(1)).alias("n_lines"))


@register("merge_indicator", """
SELECT CASE WHEN o.k IS NOT NULL AND l.k IS NOT NULL THEN 'both' WHEN o.k IS NOT NULL THEN 'left_only'
            ELSE 'right_only' END AS _merge, count(*) AS n
FROM (SELECT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k
GROUP BY 1""")
def merge_indicator_q(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return merge_indicator(o, li, "k").groupBy("_merge").agg(F.count(F.lit(1)).alias("n"))


@register("anti_join", """
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def anti_join_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return anti_join(o, li, "o_orderkey")


def _fold_sql(expr: str) -> str:
    for src, dst in ASCII_FOLD_MULTI:
        expr = f"replace({expr}, '{src}', '{dst}')"
    return f"translate({expr}, '{ASCII_FOLD_FROM}', '{ASCII_FOLD_TO}')"


@register("ascii_fold", f"SELECT doc_id, md5({_fold_sql('text')}) AS folded_md5 FROM documents")
def ascii_fold_q(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(ascii_fold("text")).alias("folded_md5"))


# Exact names that another source spells differently.
NAME_OVERRIDES = [("customer#000000003", "supplier#000000005"), ("customer#000000004", "supplier#000000002")]


@register("normalised_key_join", f"""
SELECT c.c_nationkey, count(*) AS customers, count(s.k) AS matched FROM (
  SELECT c_nationkey, CASE """ + " ".join(f"WHEN n = '{a}' THEN '{b}'" for a, b in NAME_OVERRIDES) + f"""
    ELSE replace(n, 'customer#', 'supplier#') END AS k
  FROM (SELECT c_nationkey, trim(lower({_fold_sql("c_name")})) AS n FROM customer) x) c
LEFT JOIN (SELECT DISTINCT trim(lower({_fold_sql("s_name")})) AS k FROM supplier) s ON s.k = c.k
GROUP BY c.c_nationkey""")
def normalised_key_join(spark, sf):
    """Join on whole normalised names (transliterated, lower-cased, trimmed), after
    the ordered override table."""
    def plain(c):
        return F.trim(F.lower(ascii_fold(c)))

    c = table(spark, sf, "customer").select("c_nationkey", plain("c_name").alias("n"))
    c = c.withColumn("k", name_override(F.col("n"), NAME_OVERRIDES, F.replace("n", F.lit("customer#"), F.lit("supplier#"))))
    s = table(spark, sf, "supplier").select(plain("s_name").alias("_k")).distinct()
    j = c.join(s, F.col("k") == F.col("_k"), "left")
    return j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.count("_k").alias("matched"))


# --- E: ranks and windows on the driver tables -------------------------------------------------

@register("top_n_ties", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL
QUALIFY rank() OVER (ORDER BY c_acctbal DESC) <= 10""")
def top_n_ties(spark, sf):
    return top_n(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10)


@register("bottom_n_ties", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL
QUALIFY rank() OVER (ORDER BY c_acctbal ASC) <= 10""")
def bottom_n_ties(spark, sf):
    return top_n(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10, descending=False)


@register("group_top_ties", """
SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL
QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) <= 3""")
def group_top_ties(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return top_n(c, "c_acctbal", 3, partition="c_nationkey")


@register("drop_leader", """
SELECT c_nationkey, c_custkey FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) > 1""")
def drop_leader_q(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return drop_leader(c, "c_nationkey", "c_acctbal", tiebreak=["c_custkey"]).select("c_nationkey", "c_custkey")


@register("group_argmax", """
SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1""")
def group_argmax_q(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return group_argmax(c, "c_nationkey", "c_acctbal", tiebreak=["c_custkey"])


@register("prefer_total_row", O.with_views(O.PLAYER_TEAM_SEASON, body="""
SELECT player_id, season, tm FROM player_team_season
QUALIFY row_number() OVER (PARTITION BY player_id, season ORDER BY (tm <> 'TOT'), tm) = 1"""))
def prefer_total_row_q(spark, sf):
    p = V.player_team_season(spark, sf).select("player_id", "season", "tm")
    return prefer_total_row(p, ["player_id", "season"], "tm", "TOT")


@register("group_weighted_mean_col", O.with_views(O.PLAYER_TEAM_SEASON, body="""
SELECT p.player_id, p.season, p.tm, round(a.tm_avg, 6) AS tm_avg FROM player_team_season p
JOIN (SELECT tm, season, sum(net_plus_minus_per_100_poss * (mp / g)) / sum(mp / g) AS tm_avg
      FROM player_team_season WHERE tm <> 'TOT' GROUP BY 1, 2) a ON a.tm = p.tm AND a.season = p.season
WHERE p.tm <> 'TOT'"""))
def group_weighted_mean_col(spark, sf):
    p = V.player_team_season(spark, sf).filter(F.col("tm") != "TOT") \
        .select("player_id", "season", "tm", "net_plus_minus_per_100_poss", (F.col("mp") / F.col("g")).alias("w"))
    out = group_stat_onto_rows(p, ["tm", "season"], {"tm_avg": weighted_mean("net_plus_minus_per_100_poss", "w")})
    return out.select("player_id", "season", "tm", r6("tm_avg").alias("tm_avg"))


# --- F: aggregates -------------------------------------------------------------------------------

@register("group_count", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def group_count_q(spark, sf):
    return group_count(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("group_multi_agg", """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sum_qty, max(l_extendedprice) AS max_price,
       min(l_discount) AS min_disc FROM lineitem GROUP BY 1""")
def group_multi_agg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"),
        F.max("l_extendedprice").alias("max_price"), F.min("l_discount").alias("min_disc"))


@register("block_sums", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, CAST(sum(g) AS BIGINT) AS g, sum(mp) AS mp, CAST(sum(pts) AS BIGINT) AS pts,
       CAST(sum(trb) AS BIGINT) AS trb FROM player_season GROUP BY 1"""))
def block_sums_q(spark, sf):
    return block_sums(V.player_season(spark, sf), "player_id", ["g", "mp", "pts", "trb"])


@register("ratio_of_sums", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, round(sum(mp) / sum(g), 6) AS career_mp_per_g FROM player_season GROUP BY 1"""))
def ratio_of_sums(spark, sf):
    ps = V.player_season(spark, sf)
    return ps.groupBy("player_id").agg(r6(safe_div(F.sum("mp"), F.sum("g"))).alias("career_mp_per_g"))


@register("weighted_mean", O.with_views(O.PLAYER_SEASON, body="""
SELECT season, round(sum(ts_percent * mp) / sum(mp), 6) AS ts_weighted FROM player_season GROUP BY 1"""))
def weighted_mean_q(spark, sf):
    ps = V.player_season(spark, sf)
    return ps.groupBy("season").agg(r6(weighted_mean("ts_percent", "mp")).alias("ts_weighted"))


@register("group_median", O.with_views(O.PLAYER_TEAM_SEASON, body="""
SELECT tm, season, round(median(net_plus_minus_per_100_poss), 6) AS median_npm FROM player_team_season
WHERE tm <> 'TOT' GROUP BY 1, 2"""))
def group_median(spark, sf):
    p = V.box(spark, sf).filter(F.col("tm") != "TOT")
    m = exact_median(p, ["tm", "season"], "net_plus_minus_per_100_poss", "median_npm")
    return m.withColumn("median_npm", r6("median_npm"))


# --- G: sorts, unions ----------------------------------------------------------------------------

@register("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def sort_limit(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")).limit(10)


@register("union_all", """
SELECT o_orderkey, 'open' AS source FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 'final' FROM orders WHERE o_orderstatus = 'F'""")
def union_all(spark, sf):
    o = table(spark, sf, "orders")
    return union_sources({"open": o.filter(F.col("o_orderstatus") == "O").select("o_orderkey"),
                          "final": o.filter(F.col("o_orderstatus") == "F").select("o_orderkey")})


# --- H: scalar functions --------------------------------------------------------------------------

@register("nth_word", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word,
       string_split(p_name, ' ')[-1] AS last_word,
       array_to_string(string_split(p_name, ' ')[-2:], ' ') AS last_two FROM part""")
def nth_word_q(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", nth_word("p_name", 1).alias("first_word"), nth_word("p_name", -1).alias("last_word"),
                    words_range("p_name", -2, -1).alias("last_two"))


@register("substr_parse", """
SELECT o_orderkey, TRY_CAST(substr(lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), 8, 2) AS INTEGER) AS code
FROM orders""")
def substr_parse(spark, sf):
    o = table(spark, sf, "orders")
    txt = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    return o.select("o_orderkey", F.substring(txt, 8, 2).try_cast("int").alias("code"))


@register("title_case", """
SELECT DISTINCT c_mktsegment, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment
FROM customer""")
def title_case_q(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_mktsegment", title_case(F.lower("c_mktsegment")).alias("segment")).distinct()


@register("trim_concat", "SELECT c_custkey, trim(' ' || c_name || ' ') || ' Jr.' AS name_jr FROM customer")
def trim_concat(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.concat(F.trim(F.concat(F.lit(" "), "c_name", F.lit(" "))), F.lit(" Jr.")).alias("name_jr"))


@register("abs_round", """
SELECT o_orderkey, round_even(o_totalprice / 1000, 0) AS price_k, abs(o_totalprice - 250000) AS dist
FROM orders""")
def abs_round(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.bround(F.col("o_totalprice") / 1000, 0).alias("price_k"),
                    F.abs(F.col("o_totalprice") - 250000).alias("dist"))


@register("format_columns", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, season, format('{:,.1f}', x3p_ar * 100) || '%' AS x3p_ar_pct,
       '$' || format('{:,.0f}', mp * 1000) AS salary_fmt, format('{:,.4f}', vorp) AS vorp_fmt FROM player_season"""))
def format_columns(spark, sf):
    """Display formatting as projections (percent, currency, fixed decimals)."""
    ps = V.player_season(spark, sf)
    return ps.select("player_id", "season",
                     F.concat(F.format_number(F.col("x3p_ar") * 100, 1), F.lit("%")).alias("x3p_ar_pct"),
                     F.concat(F.lit("$"), F.format_number(F.col("mp") * 1000, 0)).alias("salary_fmt"),
                     F.format_number("vorp", 4).alias("vorp_fmt"))


# --- awards on joined dimensions -------------------------------------------------------------

def _bio(spark, sf):
    """Player heights (inches) derived from ``customer``."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("PLAYER_ID"),
                    (F.lit(66) + F.col("c_custkey") % 23).cast("double").alias("PLAYER_HEIGHT_INCHES"))


_BIO_SQL = "bio AS (SELECT c_custkey AS PLAYER_ID, CAST(66 + c_custkey % 23 AS DOUBLE) AS PLAYER_HEIGHT_INCHES FROM customer)"

_GAP_SQL = O.PBP + ",\n" + _BIO_SQL + """,
blk_h AS (
  SELECT b.PLAYER3_NAME, x.PLAYER_HEIGHT_INCHES - y.PLAYER_HEIGHT_INCHES AS height_difference
  FROM pbp b JOIN bio x ON x.PLAYER_ID = b.PLAYER1_ID JOIN bio y ON y.PLAYER_ID = b.PLAYER3_ID
  WHERE coalesce(regexp_matches(b.HOMEDESCRIPTION, 'BLOCK'), false) OR coalesce(regexp_matches(b.VISITORDESCRIPTION, 'BLOCK'), false)
)"""


def _size_gap(spark, sf):
    from courtstats.functions.predicates import text_any

    log = V.log(spark, sf).filter(text_any(["HOMEDESCRIPTION", "VISITORDESCRIPTION"], "BLOCK"))
    # counts per pair of players first: the joins see one row per pair
    log = log.filter(F.col("PLAYER1_ID").isNotNull() & F.col("PLAYER3_ID").isNotNull()).groupBy(
        "PLAYER1_ID", "PLAYER3_ID", "PLAYER3_NAME").agg(F.count(F.lit(1)).alias("n"))
    j = role_join(log, _bio(spark, sf), {"PLAYER1_ID": "blockee_", "PLAYER3_ID": "blocker_"}, "PLAYER_ID")
    return j.withColumn("height_difference",
                        F.col("blockee_PLAYER_HEIGHT_INCHES") - F.col("blocker_PLAYER_HEIGHT_INCHES"))


@register("award_size_gap_pos", O.with_views(_GAP_SQL, body="""
SELECT PLAYER3_NAME, count(*) AS count FROM blk_h WHERE height_difference >= 5 GROUP BY 1
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_size_gap_pos(spark, sf):
    g = _size_gap(spark, sf).filter(F.col("height_difference") >= 5)
    return top_n(g.groupBy("PLAYER3_NAME").agg(F.sum("n").alias("count")), "count", 10)


@register("award_size_gap_neg", O.with_views(_GAP_SQL, body="""
SELECT PLAYER3_NAME, count(*) AS count FROM blk_h WHERE height_difference <= -5 GROUP BY 1
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_size_gap_neg(spark, sf):
    g = _size_gap(spark, sf).filter(F.col("height_difference") <= -5)
    return top_n(g.groupBy("PLAYER3_NAME").agg(F.sum("n").alias("count")), "count", 10)


_REB_SQL = O.BOX_ALL + ",\n" + _BIO_SQL + """,
reb AS (
  SELECT p.season, p.player_id, p.player, p.stl / p.trb AS c_reb_pct, b.PLAYER_HEIGHT_INCHES AS height
  FROM player_season p JOIN team_season t ON t.tm = p.tm AND t.season = p.season
  JOIN bio b ON b.PLAYER_ID = p.player_id
  WHERE p.g / t.g_total >= 0.5 AND p.trb > 0
)"""


def _reb(spark, sf):
    from courtstats.operators.filters import qualify_share

    pts = V.player_team_season(spark, sf)
    q = qualify_share(V.player_season(spark, sf), V.team_season(spark, sf, pts=pts), ["tm", "season"], "g", "g_total", 0.5)
    q = q.filter(F.col("trb") > 0).withColumn("c_reb_pct", safe_div("stl", "trb"))
    b = _bio(spark, sf).withColumnsRenamed({"PLAYER_ID": "player_id", "PLAYER_HEIGHT_INCHES": "height"})
    return q.join(b, "player_id").select("season", "player_id", "player", "c_reb_pct", "height")


@register("award_share_low", O.with_views(_REB_SQL, body="""
SELECT season, player, round(c_reb_pct, 6) AS c_reb_pct FROM reb WHERE height > 78
QUALIFY rank() OVER (PARTITION BY season ORDER BY c_reb_pct ASC) <= 10"""))
def award_share_low(spark, sf):
    r = top_n(_reb(spark, sf).filter(F.col("height") > 6 * 12 + 6), "c_reb_pct", 10, descending=False, partition="season")
    return r.select("season", "player", r6("c_reb_pct").alias("c_reb_pct"))


@register("award_share_high", O.with_views(_REB_SQL, body="""
SELECT season, player, round(c_reb_pct, 6) AS c_reb_pct FROM reb WHERE height < 79
QUALIFY rank() OVER (PARTITION BY season ORDER BY c_reb_pct DESC) <= 10"""))
def award_share_high(spark, sf):
    r = top_n(_reb(spark, sf).filter(F.col("height") < 6 * 12 + 7), "c_reb_pct", 10, partition="season")
    return r.select("season", "player", r6("c_reb_pct").alias("c_reb_pct"))
