"""DuckDB-runnable SQL equivalents of the registered queries.

Each oracle is assembled from named CTEs; ``sql(final, *needs)`` emits the
WITH clause with every transitive dependency in definition order.  The
tables ``lineitem orders events`` are the driver's pre-registered views.

The expressions mirror the Spark side: casts that truncate in Spark
truncate here too, CASE results are cast to DOUBLE (bare literals are
DECIMAL in both engines), sums are cast back to BIGINT, and aggregated
doubles are reported through the quantization rule ``Q`` (see
``shelfcast.functions.columns.quantize``).
"""

from __future__ import annotations

from collections.abc import Sequence

CTES: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}
ORACLES: dict[str, str] = {}


def Q(expr: str) -> str:
    """Quantization of compared doubles, same rule as ``shelfcast.functions.columns.quantize``."""
    return f"floor(({expr}) * 10000 + 0.3183) / 10000"


def cte(name: str, body: str, needs: Sequence[str] = ()) -> None:
    CTES[name] = body
    DEPS[name] = tuple(needs)


def _closure(names: Sequence[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in DEPS[n]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(final: str, *needs: str) -> str:
    names = _closure(needs)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + final) if names else final


def oracle(name: str, final: str, *needs: str) -> None:
    ORACLES[name] = sql(final, *needs)


def cols(names: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in names)


# --------------------------------------------------------------------------- summaries

cte("os", """
SELECT CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE 'P' || CAST(l_partkey % 110 AS VARCHAR) END AS productid,
       CASE WHEN l_orderkey % 31 = 0 THEN '' ELSE 'S' || CAST(l_suppkey % 4 AS VARCHAR) END AS sellerid,
       CASE WHEN l_orderkey % 5 <> 0 THEN 'M' || CAST(l_suppkey % 2 AS VARCHAR) END AS merchantid,
       CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
       CAST(day(o_orderdate) AS INTEGER) AS day,
       CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 11 = 0 THEN NULL
            ELSE o_orderpriority END AS attrs,
       CASE WHEN l_orderkey % 29 = 0 THEN '' WHEN l_returnflag = 'R' THEN 'mobile_web' WHEN l_returnflag = 'A' THEN 'mobile'
            ELSE 'web' END AS channel,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS price,
       l_extendedprice / l_quantity * (1 - l_discount) AS disprice,
       l_extendedprice / l_quantity * (1 - l_discount) * (1 + l_tax) AS finalprice,
       CAST(trunc(l_quantity) AS BIGINT) AS productcount,
       CAST(l_linenumber AS INTEGER) AS eventcount,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_linenumber AS INTEGER) END AS stock
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

cte("vs", """
SELECT 'P' || CAST(k AS VARCHAR) AS productid,
       'S' || CAST(user_id % 4 AS VARCHAR) AS sellerid,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'M' || CAST(user_id % 2 AS VARCHAR) END AS merchantid,
       CAST(year(view_day) AS INTEGER) AS year,
       CAST(month(view_day) AS INTEGER) AS month,
       CAST(weekofyear(view_day) AS INTEGER) AS week,
       CAST(day(view_day) AS INTEGER) AS day,
       CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN '' ELSE 'Brand#' || CAST(k % 25 AS VARCHAR) END AS brand,
       CASE WHEN user_id % 3 = 0 THEN 'mobile_web' WHEN user_id % 3 = 1 THEN 'mobile'
            ELSE 'web' END AS channel,
       CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'yes' ELSE 'no' END AS fastseller,
       value AS price,
       value AS disprice,
       CAST(1 AS INTEGER) AS eventcount,
       CAST(event_id % 4 AS INTEGER) AS productcount,
       CAST(event_id % 11 AS INTEGER) AS scorefive,
       CAST(event_id % 7 AS INTEGER) AS scorefour,
       CAST(event_id % 5 AS INTEGER) AS scorethree,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 3 AS INTEGER) END AS scoretwo,
       CAST(event_id % 2 AS INTEGER) AS scoreone,
       CAST(user_id % 10 AS INTEGER) AS sellergrade
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             DATE '1995-01-01' + CAST(event_id * 37 % 2400 AS INTEGER) AS view_day FROM events)""")

# --------------------------------------------------------------------------- product features

VIEW_STAT_AGGS = ("count(merchantid) AS numberofviews, avg(scorefive) AS scorefive, "
                  "avg(scorefour) AS scorefour, avg(scorethree) AS scorethree, "
                  "avg(scoretwo) AS scoretwo, avg(scoreone) AS scoreone, "
                  "avg(sellergrade) AS sellergrade")
ORDER_KEEP = ("productid", "year", "month", "week", "day", "attrs", "channel", "disprice",
              "eventcount", "finalprice", "price", "productcount", "sellerid", "stock")
STAT_KEEP = ("scorefive", "scorefour", "scorethree", "scoretwo", "scoreone", "sellergrade",
             "numberofviews", "brand")
INT_COLS = {"year", "month", "week", "day", "eventcount", "stock", "productcount", "numberofviews"}
DOUBLE_COLS = {"disprice", "finalprice", "price", "scorefive", "scorefour", "scorethree",
               "scoretwo", "scoreone", "sellergrade"}
FEATURE_COLS = ("productid", "sellerid", "year", "month", "week", "day", "disprice", "brand",
                "finalprice", "price", "scorefive", "scorefour", "scorethree", "scoretwo",
                "scoreone", "sellergrade", "numberofviews", "productcount")
SCORES = "scorefive * 5 + scorefour * 4 + scorethree * 3 + scoretwo * 2 + scoreone"
RELATIVE_PRICE = ("CAST(CASE WHEN price > 3000 THEN 3.0 WHEN price > 2000 THEN 2.0 "
                  "WHEN price > 1000 THEN 1.0 ELSE 0 END AS DOUBLE)")
STOCK_FLAG = "CAST(CASE WHEN stock > 3 THEN 1.0 ELSE 0 END AS DOUBLE)"
PRODUCT_ORDER = ("productid", "year", "month", "week", "day", "brandindexed", "disprice",
                 "finalprice", "numberofviews", "price", "productcount", "relativebrand",
                 "relativeprice", "scores", "sellergrade", "sellerid", "stock")
MONTHLY_EXTRA = ("fastsellerindexed", "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone")


def fill_expr(c: str, numeric: bool = True, string: bool = True) -> str:
    if c in INT_COLS and numeric:
        return f"coalesce({c}, -999) AS {c}"
    if c in DOUBLE_COLS and numeric:
        return f"coalesce({c}, -999.0) AS {c}"
    if c not in INT_COLS and c not in DOUBLE_COLS and string:
        return f"coalesce({c}, 'NULL') AS {c}"
    return c


def rank_dict(source: str, col: str, out: str) -> str:
    """Frequency-descending rank, ties by label string (StringIndexer frequencyDesc)."""
    return (f"SELECT _lbl, CAST(row_number() OVER (ORDER BY cnt DESC, _lbl) - 1 AS DOUBLE) AS {out} "
            f"FROM (SELECT CAST({col} AS VARCHAR) AS _lbl, count(*) AS cnt FROM {source} "
            f"WHERE {col} IS NOT NULL GROUP BY 1)")


def product_ctes(sfx: str, fastseller: bool) -> None:
    keys = "productid, brand, fastseller" if fastseller else "productid, brand"
    stat_keep = STAT_KEEP + (("fastseller",) if fastseller else ())
    cte(f"a1{sfx}", f"SELECT {keys}, {VIEW_STAT_AGGS} FROM vs GROUP BY {keys}", ["vs"])
    cte(f"j1{sfx}", f"SELECT {cols(ORDER_KEEP, 'o.')}, {cols(stat_keep, 'v.')} "
                    f"FROM os o LEFT JOIN a1{sfx} v ON o.productid = v.productid", ["os", f"a1{sfx}"])
    cte(f"j1{sfx}_filled", "SELECT " + ", ".join(fill_expr(c) for c in ORDER_KEEP + stat_keep)
        + f" FROM j1{sfx}", [f"j1{sfx}"])
    cte(f"brand_dict{sfx}", rank_dict(f"j1{sfx}_filled", "brand", "brandindexed"), [f"j1{sfx}_filled"])
    extra_sel, extra_join, extra_need = "", "", []
    if fastseller:
        cte(f"fast_dict{sfx}", rank_dict(f"j1{sfx}_filled", "fastseller", "fastsellerindexed"),
            [f"j1{sfx}_filled"])
        extra_sel = ", e.fastsellerindexed"
        extra_join = f" LEFT JOIN fast_dict{sfx} e ON f.fastseller = e._lbl"
        extra_need = [f"fast_dict{sfx}"]
    cte(f"feats{sfx}", f"SELECT {cols(FEATURE_COLS, 'f.')}, d.brandindexed{extra_sel}, "
                       f"{SCORES} AS scores, {RELATIVE_PRICE} AS relativeprice, {STOCK_FLAG} AS stock "
                       f"FROM j1{sfx}_filled f LEFT JOIN brand_dict{sfx} d ON f.brand = d._lbl{extra_join}",
        [f"j1{sfx}_filled", f"brand_dict{sfx}"] + extra_need)
    cte(f"a3{sfx}", f"SELECT relativeprice, brand, count(productid) AS relativebrand FROM feats{sfx} "
                    "GROUP BY relativeprice, brand", [f"feats{sfx}"])
    cte(f"j2{sfx}", f"SELECT f.*, c.relativebrand FROM feats{sfx} f LEFT JOIN a3{sfx} c "
                    "ON f.relativeprice = c.relativeprice AND f.brand = c.brand", [f"feats{sfx}", f"a3{sfx}"])
    contract = PRODUCT_ORDER + (MONTHLY_EXTRA if fastseller else ())
    cte(f"x1{sfx}", f"SELECT {cols(contract)} FROM j2{sfx}", [f"j2{sfx}"])


product_ctes("", fastseller=False)
product_ctes("m", fastseller=True)

# --------------------------------------------------------------------------- rollups (A4, A5)

WEEKLY_MEANS = ("brandindexed", "disprice", "finalprice", "price", "scores", "relativebrand",
                "sellergrade", "stock", "relativeprice")
MONTHLY_MEANS = ("brandindexed", "disprice", "fastsellerindexed", "finalprice", "price",
                 "scorefive", "scorefour", "scoreone", "scorethree", "scoretwo", "sellergrade",
                 "stock", "relativeprice")
WEEKLY_KEYS = "productid, sellerid, year, month, week"
MONTHLY_KEYS = "productid, sellerid, year, month"

cte("weekly_raw", f"SELECT {WEEKLY_KEYS}, " + ", ".join(f"avg({c}) AS {c}" for c in WEEKLY_MEANS)
    + ", CAST(sum(numberofviews) AS BIGINT) AS numberofviews, "
      f"CAST(sum(productcount) AS BIGINT) AS label FROM x1 GROUP BY {WEEKLY_KEYS}", ["x1"])
cte("weekly", "SELECT * FROM weekly_raw WHERE label < 20", ["weekly_raw"])
cte("monthly_raw", f"SELECT {MONTHLY_KEYS}, " + ", ".join(f"avg({c}) AS {c}" for c in MONTHLY_MEANS)
    + ", CAST(sum(numberofviews) AS BIGINT) AS numberofviews, "
      f"CAST(sum(productcount) AS BIGINT) AS productcount FROM x1m GROUP BY {MONTHLY_KEYS}", ["x1m"])


def rounded(source: str, means: Sequence[str], rule=Q, rest: str = "*") -> str:
    repl = ", ".join(f"{rule(c)} AS {c}" for c in means)
    return f"SELECT {rest} REPLACE ({repl}) FROM {source}"


# --------------------------------------------------------------------------- merchant level

MERCHANT_KEYS = ("merchantid", "productid", "brand", "channel", "fastseller", "sellerid")
MERCHANT_MEANS = ("year", "month", "week", "day", "disprice", "eventcount", "price", "productcount",
                  "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone")
MERCHANT_ORDER = (
    ("productid", "o.productid"), ("sellerid", "o.sellerid"), ("channel", "o.channel"),
    ("year", "o.year"), ("month", "o.month"), ("week", "o.week"), ("day", "o.day"),
    ("attrs", "o.attrs"), ("brand", "v.brand1"), ("disprice", "o.disprice"),
    ("eventcount", "o.eventcount"), ("fastseller", "v.fastseller1"), ("finalprice", "o.finalprice"),
    ("numberofviews", "v.numberofviews1"), ("price", "v.price1"), ("productcount", "o.productcount"),
    ("scorefive", "v.scorefive1"), ("scorefour", "v.scorefour1"), ("scoreone", "v.scoreone1"),
    ("scorethree", "v.scorethree1"), ("scoretwo", "v.scoretwo1"), ("stock", "o.stock"))
MERCHANT_ROUND = ("price", "scorefive", "scorefour", "scoreone", "scorethree", "scoretwo")

cte("a2", f"SELECT {cols(MERCHANT_KEYS)}, count(channel) AS numberofviews1, "
          + ", ".join(f"avg({c}) AS {c}1" for c in MERCHANT_MEANS)
          + f" FROM vs GROUP BY {cols(MERCHANT_KEYS)}", ["vs"])
cte("a2s", "SELECT " + ", ".join(f"{k} AS {k}1" for k in MERCHANT_KEYS) + ", "
    + "numberofviews1, " + ", ".join(f"{c}1" for c in MERCHANT_MEANS) + " FROM a2", ["a2"])
cte("j3", "SELECT * FROM os o LEFT JOIN a2s v ON o.merchantid = v.merchantid1 AND "
          "o.productid = v.productid1 AND o.channel = v.channel1 AND o.sellerid = v.sellerid1",
    ["os", "a2s"])
cte("x2", "SELECT " + ", ".join(f"{src} AS {dst}" for dst, src in MERCHANT_ORDER)
    + " FROM os o LEFT JOIN a2s v ON o.merchantid = v.merchantid1 AND o.productid = v.productid1 "
      "AND o.channel = v.channel1 AND o.sellerid = v.sellerid1", ["os", "a2s"])

# Stock dataset (X5 input): blank replacement, fills, 7 indexes.
X2_INT = {"year", "month", "week", "day", "eventcount", "stock", "productcount", "numberofviews"}
X2_DOUBLE = {"disprice", "finalprice", "price", "scorefive", "scorefour", "scoreone", "scorethree",
             "scoretwo"}
X2_STRING = ("productid", "sellerid", "channel", "attrs", "brand", "fastseller")
X2_COLS = tuple(dst for dst, _ in MERCHANT_ORDER)


def _clean_expr(c: str) -> str:
    if c in ("channel", "attrs", "brand", "fastseller"):
        return f"coalesce(CASE WHEN {c} = '' THEN 'NULL' ELSE {c} END, 'NULL') AS {c}"
    if c in ("productid", "sellerid"):
        return f"coalesce(CASE WHEN {c} = '' THEN '-999' ELSE {c} END, 'NULL') AS {c}"
    if c in X2_INT:
        return f"coalesce({c}, -999) AS {c}"
    return f"coalesce({c}, -999.0) AS {c}"


STOCK_INDEXED = (("channel", "channelindexed"), ("year", "yearindexed"), ("month", "monthindexed"),
                 ("week", "weekindexed"), ("brand", "brandindexed"), ("fastseller", "fastsellerindexed"),
                 ("stock", "stockindexed"))
cte("x2_clean", "SELECT " + ", ".join(_clean_expr(c) for c in X2_COLS) + " FROM x2", ["x2"])
for _c, _o in STOCK_INDEXED:
    cte(f"dict_{_c}", rank_dict("x2_clean", _c, _o), ["x2_clean"])
cte("x2_indexed", "SELECT x.*, " + ", ".join(f"d_{c}.{o}" for c, o in STOCK_INDEXED) + " FROM x2_clean x "
    + " ".join(f"LEFT JOIN dict_{c} d_{c} ON CAST(x.{c} AS VARCHAR) = d_{c}._lbl" for c, _ in STOCK_INDEXED),
    ["x2_clean"] + [f"dict_{c}" for c, _ in STOCK_INDEXED])

STOCK_FEATURES = ("disprice", "eventcount", "finalprice", "numberofviews", "price", "productcount",
                  "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone", "channelindexed",
                  "yearindexed", "fastsellerindexed")
WEEKLY_FEATURES = ("brandindexed", "disprice", "finalprice", "numberofviews", "price",
                   "relativebrand", "relativeprice", "scores", "sellergrade", "stock")
MONTHLY_FEATURES = ("brandindexed", "disprice", "fastsellerindexed", "finalprice", "numberofviews",
                    "price", "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone",
                    "sellergrade", "stock", "relativeprice")


def feature_columns(exprs: Sequence[str], prefix: str = "f") -> str:
    return ", ".join(f"CAST({e} AS DOUBLE) AS {prefix}{i:02d}" for i, e in enumerate(exprs))


# --------------------------------------------------------------------------- splits and learners

def md5_bucket(keys: Sequence[str], buckets: int = 100, seed: int | None = None) -> str:
    parts = [f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys]
    if seed is not None:
        parts = [f"'{seed}'"] + parts
    key = " || '|' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS UBIGINT) % {buckets})"


X1_KEY = ("productid", "year", "month", "week", "day")
cte("x1_split", f"SELECT *, CAST(productcount AS DOUBLE) AS label, {md5_bucket(X1_KEY)} AS bucket FROM x1",
    ["x1"])
cte("x1_split11", f"SELECT *, {md5_bucket(X1_KEY, seed=11)} AS bucket FROM x1", ["x1"])
cte("x1_train", "SELECT * FROM x1_split WHERE bucket < 70", ["x1_split"])
cte("x1_test", "SELECT * FROM x1_split WHERE bucket >= 70", ["x1_split"])
cte("tree_means", "SELECT relativeprice, avg(label) AS prediction FROM x1_train GROUP BY relativeprice",
    ["x1_train"])
cte("tree_pred", "SELECT t.productid, t.year, t.month, t.week, t.day, t.relativeprice, t.label, "
                 "m.prediction FROM x1_test t JOIN tree_means m ON t.relativeprice = m.relativeprice",
    ["x1_test", "tree_means"])

# --------------------------------------------------------------------------- registered oracles

oracle("s1_order_summary", "SELECT * FROM os", "os")
oracle("s1_view_summary", "SELECT * FROM vs", "vs")
oracle("s2_projected_view_scan",
       "SELECT merchantid, productid, year, month, week, day, brand, channel, disprice, eventcount, "
       "fastseller, price, productcount, scorefive, scorefour, scoreone, scoretwo, scorethree, sellerid "
       "FROM vs", "vs")
oracle("a1_view_stats", "SELECT * FROM a1", "a1")
oracle("j1_join_view_stats", "SELECT * FROM j1", "j1")
oracle("p8_fill_numeric", "SELECT " + ", ".join(fill_expr(c, string=False) for c in ORDER_KEEP + STAT_KEEP)
       + " FROM j1", "j1")
oracle("p9_fill_string", "SELECT " + ", ".join(fill_expr(c, numeric=False) for c in ORDER_KEEP + STAT_KEEP)
       + " FROM j1", "j1")
oracle("f1_index_category", "SELECT f.*, d.brandindexed FROM j1_filled f LEFT JOIN brand_dict d "
       "ON f.brand = d._lbl", "j1_filled", "brand_dict")
oracle("p4_scores", f"SELECT *, {SCORES} AS scores FROM j1_filled", "j1_filled")
oracle("p5_relative_price", f"SELECT *, {RELATIVE_PRICE} AS relativeprice FROM j1_filled", "j1_filled")
oracle("p6_stock_flag", f"SELECT * REPLACE ({STOCK_FLAG} AS stock) FROM j1_filled", "j1_filled")
oracle("a3_brand_price_counts", "SELECT * FROM a3", "a3")
oracle("j2_relative_brand", "SELECT * FROM j2", "j2")
oracle("x1_product_features", "SELECT * FROM x1", "x1")
oracle("x1_product_features_monthly", "SELECT * FROM x1m", "x1m")
oracle("a8_row_count", "SELECT count(*) AS n FROM x1", "x1")
oracle("l1_preview", "SELECT * FROM x1 ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in PRODUCT_ORDER)
       + " LIMIT 20", "x1")
def collapsed(source: str, columns: Sequence[str], keys: Sequence[str]) -> str:
    """One row per key, the greatest other columns first: what a save leaves."""
    rest = [c for c in columns if c not in keys]
    return (f"SELECT {cols(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY {cols(keys)} ORDER BY "
            + ", ".join(f"{c} DESC NULLS LAST" for c in rest) + f") AS _rn FROM {source}) WHERE _rn = 1")


oracle("a5_weekly_rollup", rounded("weekly_raw", WEEKLY_MEANS), "weekly_raw")
oracle("p3_having", rounded("weekly", WEEKLY_MEANS), "weekly")
oracle("p12_having_count", "SELECT count(*) AS n FROM weekly_raw WHERE label < 10", "weekly_raw")
oracle("p7_cast_label", f"SELECT {WEEKLY_KEYS}, CAST(label AS DOUBLE) AS label FROM weekly", "weekly")
oracle("p11_log_label", f"SELECT {WEEKLY_KEYS}, label, {Q('ln(label)')} AS loglabel, "
       f"{Q('exp(ln(label))')} AS expprediction FROM weekly", "weekly")
oracle("a4_monthly_rollup", rounded("monthly_raw", MONTHLY_MEANS), "monthly_raw")
oracle("a2_view_stats_by_merchant", rounded("a2", [f"{c}1" for c in MERCHANT_MEANS]), "a2")
oracle("p2_suffix_columns", rounded("a2s", [f"{c}1" for c in MERCHANT_MEANS]), "a2s")
oracle("a7_grouped_means",
       f"SELECT {cols(MERCHANT_KEYS)}, "
       + ", ".join(f'{Q(f"avg({c})")} AS "avg({c})"' for c in MERCHANT_MEANS)
       + f" FROM vs GROUP BY {cols(MERCHANT_KEYS)}", "vs")
oracle("j3_join_view_stats_by_merchant", rounded("j3", [f"{c}1" for c in MERCHANT_MEANS]), "j3")
oracle("x2_merchant_features", rounded("x2", MERCHANT_ROUND), "x2")
cte("a1_day", "SELECT merchantid, productid, year, month, week, day, count(channel) AS numberofviews, "
              "avg(scorefive) AS scorefive, avg(scorefour) AS scorefour, avg(scorethree) AS scorethree, "
              "avg(scoretwo) AS scoretwo, avg(scoreone) AS scoreone, avg(sellergrade) AS sellergrade1 "
              "FROM vs GROUP BY merchantid, productid, year, month, week, day", ["vs"])
oracle("j4_join_null_safe",
       "SELECT o.*, v.numberofviews, " + ", ".join(
           f"{Q('v.' + c)} AS {c}" for c in ("scorefive", "scorefour", "scorethree", "scoretwo", "scoreone",
                                             "sellergrade1"))
       + " FROM os o LEFT JOIN a1_day v ON o.merchantid IS NOT DISTINCT FROM v.merchantid "
       "AND o.productid IS NOT DISTINCT FROM v.productid AND o.year IS NOT DISTINCT FROM v.year "
       "AND o.month IS NOT DISTINCT FROM v.month AND o.week IS NOT DISTINCT FROM v.week "
       "AND o.day IS NOT DISTINCT FROM v.day", "os", "a1_day")
oracle("j5_pair_join_counts",
       "SELECT o.merchantid, o.productid, count(*) AS pairs FROM os o JOIN vs v "
       "ON o.merchantid = v.merchantid AND o.productid = v.productid GROUP BY o.merchantid, o.productid",
       "os", "vs")
oracle("p10_replace_blank",
       "SELECT * REPLACE (" + ", ".join(
           f"CASE WHEN {c} = '' THEN '{r}' ELSE {c} END AS {c}"
           for c, r in (("channel", "NULL"), ("attrs", "NULL"), ("brand", "NULL"), ("fastseller", "NULL"),
                        ("productid", "-999"), ("sellerid", "-999")))
       + ", " + ", ".join(f"{Q(c)} AS {c}" for c in MERCHANT_ROUND) + ") FROM x2", "x2")
oracle("f2_index_categories", rounded("x2_indexed", MERCHANT_ROUND), "x2_indexed")
oracle("x5_stock_dataset", "SELECT CAST(stock AS DOUBLE) AS label, "
       + feature_columns([Q(c) if c in MERCHANT_ROUND else c for c in STOCK_FEATURES]) + " FROM x2_indexed",
       "x2_indexed")
oracle("f3_assemble_weekly", "SELECT CAST(label AS DOUBLE) AS label, "
       + feature_columns([Q(c) if c in WEEKLY_MEANS else c for c in WEEKLY_FEATURES]) + " FROM weekly",
       "weekly")
oracle("x4_monthly_dataset", "SELECT CAST(productcount AS DOUBLE) AS label, "
       + feature_columns([Q(c) if c in MONTHLY_MEANS else c for c in MONTHLY_FEATURES]) + " FROM monthly_raw",
       "monthly_raw")
oracle("f5_split", "SELECT productid, year, month, week, day, "
       "CASE WHEN bucket < 70 THEN 'train' ELSE 'test' END AS split, count(*) AS n "
       "FROM x1_split GROUP BY ALL", "x1_split")
oracle("f6_split_40_60", "SELECT productid, year, month, week, day, "
       "CASE WHEN bucket < 40 THEN 'train' ELSE 'test' END AS split, count(*) AS n "
       "FROM x1_split11 GROUP BY ALL", "x1_split11")

# --------------------------------------------------------------------------- learners (degenerate cases)

ONE_FEATURE_PRED = ("SELECT productid, year, month, week, day, relativeprice, label, "
                    f"{Q('prediction')} AS prediction FROM tree_pred")
oracle("m1_tree_regressor", ONE_FEATURE_PRED, "tree_pred")
oracle("m2_forest_regressor", ONE_FEATURE_PRED, "tree_pred")
oracle("m3_gbt_regressor", ONE_FEATURE_PRED, "tree_pred")
oracle("m10_regression_metrics",
       f"SELECT count(*) AS n, {Q('sqrt(avg((prediction - label) * (prediction - label)))')} AS rmse, "
       f"{Q('avg((prediction - label) * (prediction - label))')} AS mse, "
       f"{Q('avg(abs(prediction - label))')} AS mae, "
       f"{Q('1.0 - avg((prediction - label) * (prediction - label)) / nullif(var_pop(label), 0.0)')} AS r2 "
       "FROM tree_pred", "tree_pred")
oracle("m12_nrmse",
       f"SELECT {Q('sqrt(avg((prediction - label) * (prediction - label))) / nullif(max(prediction) - min(prediction), 0.0)')}"
       " AS nrmse FROM tree_pred", "tree_pred")
oracle("a6_prediction_range",
       f"SELECT {Q('max(prediction)')} AS max_prediction, {Q('min(prediction)')} AS min_prediction FROM tree_pred",
       "tree_pred")

cte("lin_moments", "SELECT count(*) AS n, avg(label) AS my, avg(relativeprice) AS mx, "
                   "stddev_samp(label) AS sy, stddev_samp(relativeprice) AS sx, corr(relativeprice, label) AS r "
                   "FROM x1_train", ["x1_train"])
# Elastic net on one standardised feature (sample deviations, as the L-BFGS path):
# c = (n-1)/n, l = reg/sd(y), w = soft(r·c, l·mix) / (c + l·(1-mix)), slope = w·sd(y)/sd(x).
cte("lin_fit", "SELECT *, sign(r * c) * greatest(abs(r * c) - l * 0.8, 0.0) / (c + l * (1 - 0.8)) * sy / sx AS slope "
               "FROM (SELECT *, (n - 1.0) / n AS c, 0.3 / sy AS l FROM lin_moments)", ["lin_moments"])
oracle("m4_linear_regression", f"SELECT {Q('slope')} AS coefficient, {Q('my - slope * mx')} AS intercept FROM lin_fit",
       "lin_fit")

# Cross-validation with a fold column: each fold is predicted by the means of the other three.
cte("cv_base", f"SELECT CAST(productcount AS DOUBLE) AS label, relativeprice, "
               f"CAST({md5_bucket(X1_KEY, 4)} AS INTEGER) AS fold FROM x1", ["x1"])
cte("cv_fold", "SELECT fold, relativeprice, sum(label) AS s, count(*) AS c FROM cv_base GROUP BY fold, relativeprice",
    ["cv_base"])
cte("cv_total", "SELECT relativeprice, sum(label) AS s, count(*) AS c FROM cv_base GROUP BY relativeprice",
    ["cv_base"])
cte("cv_rmse", "SELECT b.fold, sqrt(avg(((t.s - f.s) / (t.c - f.c) - b.label) * ((t.s - f.s) / (t.c - f.c) - b.label))) "
               "AS rmse FROM cv_base b JOIN cv_fold f ON b.fold = f.fold AND b.relativeprice = f.relativeprice "
               "JOIN cv_total t ON b.relativeprice = t.relativeprice GROUP BY b.fold",
    ["cv_base", "cv_fold", "cv_total"])
oracle("m8_cross_validate", " UNION ALL ".join(
    f"SELECT {i} AS grid_point, 'maxDepth' AS param, CAST({v} AS DOUBLE) AS value, {Q('avg(rmse)')} AS avg_metric "
    "FROM cv_rmse" for i, v in enumerate((4, 8, 10))), "cv_rmse")

# Classification tree on the one categorical feature channelindexed: predicts the train mode
# of stockindexed per channel (ties to the lowest class index).
STOCK_CLASS_KEYS = ("productid", "sellerid", "channel", "year", "month", "week", "day")
cte("cls_split", f"SELECT *, {md5_bucket(STOCK_CLASS_KEYS)} AS bucket FROM x2_indexed", ["x2_indexed"])
cte("cls_mode", "SELECT channelindexed, stockindexed AS prediction FROM ("
                "SELECT channelindexed, stockindexed, row_number() OVER (PARTITION BY channelindexed "
                "ORDER BY count(*) DESC, stockindexed) AS rn FROM cls_split WHERE bucket < 70 "
                "GROUP BY channelindexed, stockindexed) WHERE rn = 1", ["cls_split"])
cte("cls_pred", f"SELECT {cols(STOCK_CLASS_KEYS, 't.')}, t.channelindexed, t.stockindexed AS label, m.prediction "
                "FROM cls_split t JOIN cls_mode m ON t.channelindexed = m.channelindexed WHERE t.bucket >= 70",
    ["cls_split", "cls_mode"])
oracle("m5_tree_classifier", "SELECT * FROM cls_pred", "cls_pred")
oracle("m13_classification_metrics",
       f"SELECT count(*) AS n, {Q('avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)')} AS accuracy, "
       f"{Q('1.0 - avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)')} AS test_error FROM cls_pred",
       "cls_pred")

# Vector indexer: a feature is categorical when it has at most 40 distinct values.
WEEKLY_FEATURE_SQL = ("brandindexed", "disprice", "finalprice", "CAST(numberofviews AS DOUBLE)", "price",
                      "relativebrand", "relativeprice", "scores", "sellergrade", "stock")
oracle("f4_index_vector", " UNION ALL ".join(
    f"SELECT {i} AS feature, count(DISTINCT {e}) <= 40 AS is_categorical, "
    f"CAST(CASE WHEN count(DISTINCT {e}) <= 40 THEN count(DISTINCT {e}) ELSE 0 END AS INTEGER) AS num_categories "
    "FROM weekly" for i, e in enumerate(WEEKLY_FEATURE_SQL)), "weekly")
oracle("s3_read_libsvm", ORACLES["f3_assemble_weekly"])
oracle("p13_named_prediction", f"SELECT {Q('prediction')} AS pdecisiontree FROM tree_pred", "tree_pred")

# --------------------------------------------------------------------------- jobs over the saved tables

cte("x1_saved", collapsed("x1", PRODUCT_ORDER, PRODUCT_ORDER[:5]), ["x1"])
cte("x1m_saved", collapsed("x1m", PRODUCT_ORDER + MONTHLY_EXTRA, PRODUCT_ORDER[:5]), ["x1m"])
cte("weekly_saved", CTES["weekly_raw"].replace(" FROM x1 ", " FROM x1_saved "), ["x1_saved"])
cte("monthly_saved", CTES["monthly_raw"].replace(" FROM x1m ", " FROM x1m_saved "), ["x1m_saved"])
oracle("a5_weekly_rollup_saved", rounded("weekly_saved", WEEKLY_MEANS), "weekly_saved")
oracle("a4_monthly_rollup_saved", rounded("monthly_saved", MONTHLY_MEANS), "monthly_saved")

cte("x2_saved", collapsed("x2", X2_COLS, STOCK_CLASS_KEYS), ["x2"])
cte("x2_saved_clean", CTES["x2_clean"].replace(" FROM x2", " FROM x2_saved"), ["x2_saved"])
_VECTOR_INDEXES = [(c, o) for c, o in STOCK_INDEXED if o in STOCK_FEATURES]
for _c, _o in _VECTOR_INDEXES:
    cte(f"dict_saved_{_c}", rank_dict("x2_saved_clean", _c, _o), ["x2_saved_clean"])
cte("x2_saved_indexed", "SELECT x.*, " + ", ".join(f"d_{c}.{o}" for c, o in _VECTOR_INDEXES) + " FROM x2_saved_clean x "
    + " ".join(f"LEFT JOIN dict_saved_{c} d_{c} ON CAST(x.{c} AS VARCHAR) = d_{c}._lbl" for c, _ in _VECTOR_INDEXES),
    ["x2_saved_clean"] + [f"dict_saved_{c}" for c, _ in _VECTOR_INDEXES])
oracle("x5_stock_dataset_saved", "SELECT CAST(stock AS DOUBLE) AS label, "
       + feature_columns([Q(c) if c in MERCHANT_ROUND else c for c in STOCK_FEATURES]) + " FROM x2_saved_indexed",
       "x2_saved_indexed")


def holdout(source: str, label: str, keys: str) -> str:
    """Rows and label moments of the test part of a job."""
    bucket = md5_bucket(keys.split(", "))
    return (f"SELECT count(*) AS n, sum(label) AS sum_label, sum(label * label) AS sum_label2, min(label) AS min_label, "
            f"max(label) AS max_label, count(*) AS n_predicted FROM (SELECT CAST({label} AS DOUBLE) AS label "
            f"FROM {source} WHERE {bucket} >= 70)")


cte("weekly_saved_small", "SELECT * FROM weekly_saved WHERE label < 20", ["weekly_saved"])
oracle("x3_weekly_holdout", holdout("weekly_saved_small", "label", WEEKLY_KEYS), "weekly_saved_small")
oracle("x4_monthly_holdout", holdout("monthly_saved", "productcount", MONTHLY_KEYS), "monthly_saved")

# --------------------------------------------------------------------------- pipelines, scoring, model reports

oracle("m6_pipeline", ONE_FEATURE_PRED, "tree_pred")
oracle("m9_score", ONE_FEATURE_PRED, "tree_pred")
# A tree over k separable values has k leaves.  Of up to four values the first split is the one that
# lowers the squared error most; a middle split of four gives depth 2, an outer one depth 3.
cte("tree_values", "SELECT row_number() OVER (ORDER BY relativeprice) AS i, count(*) OVER () AS k, sum(label) AS s, "
                   "count(*) AS n FROM x1_train GROUP BY relativeprice", ["x1_train"])
cte("tree_splits", "SELECT a.i, any_value(a.k) AS k, sum(b.s) FILTER (b.i <= a.i) ** 2 / sum(b.n) FILTER (b.i <= a.i) "
                   "+ sum(b.s) FILTER (b.i > a.i) ** 2 / sum(b.n) FILTER (b.i > a.i) AS gain "
                   "FROM tree_values a, tree_values b WHERE a.i < a.k GROUP BY a.i", ["tree_values"])
oracle("m14_tree_report", "SELECT 0 AS tree_id, CAST(CASE WHEN k <= 3 THEN k - 1 WHEN arg_max(i, gain) = 2 THEN 2 ELSE 3 END "
       "AS INTEGER) AS depth, CAST(2 * k - 1 AS INTEGER) AS num_nodes, 1.0::DOUBLE AS weight, 0 AS feature, "
       "1.0::DOUBLE AS importance FROM tree_splits GROUP BY k", "tree_splits")

cte("lin_residuals", "SELECT label, label - (my - slope * mx + slope * relativeprice) AS e FROM x1_train, lin_fit",
    ["x1_train", "lin_fit"])
oracle("m4_linear_summary", f"SELECT {Q('sqrt(avg(e * e))')} AS rmse, "
       f"{Q('1.0 - sum(e * e) / (count(*) * var_pop(label))')} AS r2 FROM lin_residuals", "lin_residuals")
oracle("m4_linear_residuals", f"SELECT {Q('e')} AS residual, count(*) AS n FROM lin_residuals GROUP BY 1", "lin_residuals")


def indexed_values(limit: int) -> str:
    """Vector indexing: a feature of at most ``limit`` values becomes the rank of its value, zero first."""
    names = [f"f{i:02d}" for i in range(len(WEEKLY_FEATURE_SQL))]
    base = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in zip(names, WEEKLY_FEATURE_SQL))
    counts = ", ".join(f"count(DISTINCT {n}) AS k_{n}" for n in names)
    ranks = ", ".join(f"dense_rank() OVER (ORDER BY {n} <> 0.0, {n}) - 1 AS r_{n}" for n in names)
    picked = ", ".join(f"{Q(f'CASE WHEN k_{n} <= {limit} THEN CAST(r_{n} AS DOUBLE) ELSE {n} END')} AS {n}" for n in names)
    return (f"SELECT label, {picked} FROM (SELECT *, {ranks} FROM (SELECT CAST(label AS DOUBLE) AS label, {base} "
            f"FROM weekly)), (SELECT {counts} FROM (SELECT {base} FROM weekly))")


for _n in (4, 20):
    oracle(f"f4_indexed_values_{_n}", indexed_values(_n), "weekly")

# --------------------------------------------------------------------------- product-level model

PRODUCT_FEATURES = ("channelindexed", "disprice", "eventcount", "finalprice", "price", "stock",
                    "fastsellerindexed", "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone",
                    "sellergrade", "numberofviews", "brandindexed")
cte("channel_dictm", rank_dict("j1m_filled", "channel", "channelindexed"), ["j1m_filled"])
cte("product_rows", f"SELECT f.* REPLACE ({STOCK_FLAG} AS stock), b.brandindexed, s.fastsellerindexed, c.channelindexed "
                    "FROM j1m_filled f LEFT JOIN brand_dictm b ON f.brand = b._lbl "
                    "LEFT JOIN fast_dictm s ON f.fastseller = s._lbl LEFT JOIN channel_dictm c ON f.channel = c._lbl",
    ["j1m_filled", "brand_dictm", "fast_dictm", "channel_dictm"])
oracle("x7_product_dataset", "SELECT CAST(productcount AS DOUBLE) AS label, "
       + feature_columns([Q(c) for c in PRODUCT_FEATURES]) + " FROM product_rows", "product_rows")

# --------------------------------------------------------------------------- upsert

# Keys of bucket 40 and above come (again) with the second batch, whose stock values are changed.
cte("x1_upserted", "SELECT * REPLACE (CASE WHEN bucket >= 40 THEN stock + 10.0 ELSE stock END AS stock) FROM x1_split",
    ["x1_split"])
oracle("s4_upsert_features", collapsed("x1_upserted", PRODUCT_ORDER, PRODUCT_ORDER[:5]), "x1_upserted")

# --------------------------------------------------------------------------- named tables, row-preserving pair join

oracle("s1_bucketed_rollup", ORACLES["a5_weekly_rollup"])
oracle("s1_bucketed_join", ORACLES["j1_join_view_stats"])
oracle("j5_pair_join_rows",
       "SELECT o.*, p.partners FROM os o JOIN (SELECT merchantid, productid, count(*) AS partners FROM vs "
       "GROUP BY merchantid, productid) p ON o.merchantid = p.merchantid AND o.productid = p.productid", "os", "vs")

# --------------------------------------------------------------------------- random splits by rank

ORDER_COLUMNS = ("productid", "sellerid", "merchantid", "year", "month", "week", "day", "attrs", "channel", "price",
                 "disprice", "finalprice", "productcount", "eventcount", "stock")


def random_parts(train: int, seed: int) -> str:
    """A row's draw is a hash of its rank under the order of all columns, nulls first."""
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in ORDER_COLUMNS)
    draw = f"CAST('0x' || substr(md5('{seed}|' || CAST(rank AS VARCHAR)), 1, 8) AS BIGINT) % 1000000"
    return (f"SELECT CAST(CASE WHEN {draw} < {train} THEN 0 ELSE 1 END AS INTEGER) AS part, count(*) AS n, "
            "CAST(sum(productcount) AS BIGINT) AS units, CAST(sum(eventcount) AS BIGINT) AS events, "
            f"max(price) AS max_price FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rank FROM os) GROUP BY 1")


oracle("f5_random_split", random_parts(700000, 5), "os")
oracle("f6_random_split_40_60", random_parts(400000, 11), "os")

# --------------------------------------------------------------------------- model checks


NOTHING_WRONG = ", ".join(f"CAST(0 AS BIGINT) AS wrong_{c}" for c in ("trees", "counts", "gains", "importances"))


def checked(source: str, keys: str, trees: int) -> str:
    """What must hold of a model: all test rows score alike, better than the mean, and nothing is wrong."""
    return (f"SELECT count(*) AS n_test, count(*) AS n_equal, true AS better, CAST({trees} AS BIGINT) AS trees, "
            f"{NOTHING_WRONG} FROM {source} WHERE {md5_bucket(keys.split(', '))} >= 70")


def checked_whole(source: str, trees: int, rest: str = "") -> str:
    """The same where the split cannot be told in SQL: rows of both parts."""
    return (f"SELECT count(*) AS n_rows, true AS all_equal, CAST({trees} AS BIGINT) AS trees, {NOTHING_WRONG}{rest} "
            f"FROM {source}")


ONE_TREE = ", true AS same_sum, CAST(0 AS BIGINT) AS wrong_leaves"
oracle("x3_weekly_check", checked("weekly_saved_small", WEEKLY_KEYS, 20), "weekly_saved_small")
oracle("x4_monthly_check", checked("monthly_saved", MONTHLY_KEYS, 20), "monthly_saved")
oracle("x5_stock_check", checked_whole("x2_saved_indexed", 1, ONE_TREE), "x2_saved_indexed")
oracle("x6_libsvm_check", checked_whole("monthly_raw", 20), "monthly_raw")
oracle("x7_product_check", checked_whole("product_rows", 1, ONE_TREE), "product_rows")
oracle("m9_score_by_nodes", ONE_FEATURE_PRED, "tree_pred")
oracle("m8_weekly_folds",
       f"SELECT fold, depth, count(*) AS n, true AS same_error, true AS same_mean, true AS chose_least FROM "
       f"(SELECT CAST({md5_bucket(WEEKLY_KEYS.split(', '), 4, 7)} AS INTEGER) AS fold FROM weekly_saved_small "
       f"WHERE {md5_bucket(WEEKLY_KEYS.split(', '))} < 70), (SELECT CAST(unnest([4, 8, 10]) AS INTEGER) AS depth) "
       "GROUP BY fold, depth", "weekly_saved_small")

# --------------------------------------------------------------------------- elastic net on ten features

# Coordinate descent on the standardised second moments, one coordinate a step, as a recursive query.
LINEAR_SWEEPS = 600
_K = len(WEEKLY_FEATURE_SQL)
_NAMES = [f"f{i}" for i in range(_K)]
cte("lm_rows", "SELECT CAST(label AS DOUBLE) AS y, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(WEEKLY_FEATURE_SQL, _NAMES))
    + f" FROM weekly WHERE {md5_bucket(WEEKLY_KEYS.split(', '))} < 70", ["weekly"])
cte("lm_means", "SELECT count(*) AS n, avg(y) AS my, " + ", ".join(f"avg({n}) AS m_{n}" for n in _NAMES)
    + ", stddev_samp(y) AS sy, " + ", ".join(f"coalesce(nullif(stddev_samp({n}), 0), 1) AS s_{n}" for n in _NAMES)
    + " FROM lm_rows", ["lm_rows"])
cte("lm_standard", "SELECT n, (y - my) / sy AS y, " + ", ".join(f"({n} - m_{n}) / s_{n} AS {n}" for n in _NAMES)
    + " FROM lm_rows, lm_means", ["lm_rows", "lm_means"])
cte("lm_system", "SELECT [" + ", ".join("[" + ", ".join(f"sum({a} * {b}) / any_value(n)" for b in _NAMES) + "]"
                                        for a in _NAMES) + "] AS a, ["
    + ", ".join(f"sum({a} * y) / any_value(n)" for a in _NAMES) + "] AS b FROM lm_standard", ["lm_standard"])
cte("lm_steps", f"SELECT 0 AS step, [{', '.join(['0.0::DOUBLE'] * _K)}] AS w UNION ALL "
    f"SELECT step + 1, list_concat(w[:step % {_K}], [new], w[step % {_K} + 2:]) FROM (SELECT step, w, "
    "CASE WHEN d = 0 THEN 0.0 ELSE sign(rho) * greatest(abs(rho) - 0.3 * 0.8 / sy, 0.0) / (d + 0.3 * (1 - 0.8) / sy) END AS new "
    f"FROM (SELECT step, w, sy, a[step % {_K} + 1][step % {_K} + 1] AS d, b[step % {_K} + 1] - "
    f"(list_dot_product(a[step % {_K} + 1], w) - a[step % {_K} + 1][step % {_K} + 1] * w[step % {_K} + 1]) AS rho "
    f"FROM lm_steps, lm_system, lm_means WHERE step < {_K * LINEAR_SWEEPS}))", ["lm_system", "lm_means"])
cte("lm_fit", "SELECT [" + ", ".join(f"w[{i + 1}] * sy / s_{n}" for i, n in enumerate(_NAMES)) + "] AS c, ["
    + ", ".join(f"w[{i + 1}] * sy" for i in range(_K)) + "] AS e, my, ["
    + ", ".join(f"m_{n}" for n in _NAMES) + f"] AS m FROM lm_steps, lm_means WHERE step = {_K * LINEAR_SWEEPS}",
    ["lm_steps", "lm_means"])
oracle("m4_weekly_linear", " UNION ALL ".join(
    f"SELECT {i} AS feature, {Q(f'c[{i + 1}]')} AS coefficient, {Q(f'e[{i + 1}]')} AS effect, true AS optimal FROM lm_fit"
    for i in range(_K)) + f" UNION ALL SELECT {_K}, {Q('my - list_dot_product(c, m)')}, NULL, true FROM lm_fit", "lm_fit")
ORACLES["m4_weekly_linear"] = (ORACLES["m4_weekly_linear"].replace("WITH ", "WITH RECURSIVE ", 1)
                               .replace("lm_means AS (", "lm_means AS MATERIALIZED (")
                               .replace("lm_system AS (", "lm_system AS MATERIALIZED ("))
