"""DuckDB SQL twins of every registered query (the correctness oracle).

These follow the original definitions literally -- naive joins with their
fan-out, ``dense_rank`` windows for the surrogate keys, chained null-safe
lookups followed by DISTINCT for the fact -- so they check the Spark plans'
rewrites rather than repeat them.  Money is summed as DECIMAL(20,6) and
leaves as DOUBLE in cents; quotients are rounded to 6 places; integer sums are cast to
BIGINT (DuckDB would return HUGEINT).
"""

from __future__ import annotations

from starlane.plans.registry import REPORTS as REPORTS_OF

FLAT = r"""
flat0 AS (
  SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS row_id,
         CAST(o.o_orderkey AS VARCHAR) AS order_id,
         strftime(o.o_orderdate, '%d/%m/%Y') AS order_date_s,
         strftime(l.l_shipdate, '%d/%m/%Y') AS ship_date_s,
         o.o_orderpriority AS ship_mode,
         CAST(c.c_custkey AS VARCHAR) AS customer_id,
         c.c_name AS customer_name,
         c.c_mktsegment AS segment,
         'WORLD' AS country,
         n.n_name || '_' || CAST(c.c_custkey % 20 AS VARCHAR) AS city,
         n.n_name AS state,
         r.r_name AS region,
         CASE WHEN c.c_custkey % 97 = 0 THEN NULL
              ELSE CAST(c.c_nationkey * 10 + c.c_custkey % 10 AS DOUBLE) END AS postal_code,
         CAST(p.p_partkey AS VARCHAR) AS product_id,
         p.p_type AS category,
         p.p_type || '/' || p.p_brand AS sub_category,
         p.p_name AS product_name,
         CAST(l.l_extendedprice AS DOUBLE) AS sales,
         o.o_orderkey AS _ok
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
flat AS (
  -- every line once, lines of every 100th order twice (planted exact
  -- duplicates on top of the whole table; nothing is left out)
  SELECT * EXCLUDE (_ok, _copy) FROM (
    SELECT *, unnest(range(CASE WHEN _ok % 100 = 0 THEN 2 ELSE 1 END)) AS _copy FROM flat0
  )
)
"""

# flat -> cleaned lines -> dimensions and fact (reads a view/CTE named flat).
STAR = r"""
pc_mode AS (
  SELECT postal_code AS m FROM flat WHERE postal_code IS NOT NULL
  GROUP BY postal_code ORDER BY count(*) DESC, postal_code LIMIT 1
),
imputed AS (
  SELECT * REPLACE (coalesce(postal_code, (SELECT m FROM pc_mode)) AS postal_code) FROM flat
),
deduped AS (SELECT DISTINCT * FROM imputed),
parsed AS (
  SELECT * EXCLUDE (order_date_s, ship_date_s),
         CAST(strptime(order_date_s, '%d/%m/%Y') AS DATE) AS order_date,
         CAST(strptime(ship_date_s, '%d/%m/%Y') AS DATE) AS ship_date
  FROM deduped
),
clean AS (SELECT * EXCLUDE (row_id) FROM parsed),
dim_orders AS (
  SELECT order_id, order_date,
         CAST(CASE WHEN order_id IS NULL THEN -1
              ELSE dense_rank() OVER (ORDER BY order_id NULLS LAST) - 1 END AS BIGINT) AS order_key
  FROM (SELECT DISTINCT order_id, order_date FROM clean)
),
dim_shipping AS (
  SELECT ship_date, ship_mode,
         CAST(CASE WHEN ship_date IS NULL THEN -1
              ELSE dense_rank() OVER (ORDER BY ship_date NULLS LAST) - 1 END AS BIGINT) AS ship_key
  FROM (SELECT DISTINCT ship_date, ship_mode FROM clean)
),
dim_customers AS (
  SELECT customer_id, customer_name, segment,
         CAST(CASE WHEN customer_id IS NULL THEN -1
              ELSE dense_rank() OVER (ORDER BY customer_id NULLS LAST) - 1 END AS BIGINT) AS customer_key
  FROM (SELECT DISTINCT customer_id, customer_name, segment FROM clean)
),
dim_regions AS (
  SELECT country, city, state, region, postal_code,
         CAST(CASE WHEN postal_code IS NULL THEN -1
              ELSE dense_rank() OVER (ORDER BY postal_code NULLS LAST) - 1 END AS BIGINT) AS region_key
  FROM (SELECT DISTINCT country, city, state, region, postal_code FROM clean)
),
dim_products AS (
  SELECT product_id, category, sub_category, product_name,
         CAST(CASE WHEN product_id IS NULL THEN -1
              ELSE dense_rank() OVER (ORDER BY product_id NULLS LAST) - 1 END AS BIGINT) AS product_key
  FROM (SELECT DISTINCT product_id, category, sub_category, product_name FROM clean)
),
fact_sales AS (
  SELECT DISTINCT c.sales, o.order_key, s.ship_key, cu.customer_key, r.region_key, p.product_key
  FROM clean c
  LEFT JOIN (SELECT order_id, order_key FROM dim_orders) o
         ON c.order_id IS NOT DISTINCT FROM o.order_id
  LEFT JOIN (SELECT ship_date, ship_key FROM dim_shipping) s
         ON c.ship_date IS NOT DISTINCT FROM s.ship_date
  LEFT JOIN (SELECT customer_id, customer_key FROM dim_customers) cu
         ON c.customer_id IS NOT DISTINCT FROM cu.customer_id
  LEFT JOIN (SELECT postal_code, region_key FROM dim_regions) r
         ON c.postal_code IS NOT DISTINCT FROM r.postal_code
  LEFT JOIN (SELECT product_id, product_key FROM dim_products) p
         ON c.product_id IS NOT DISTINCT FROM p.product_id
)
"""

# star tables -> reports (reads fact_sales and dim_* views/CTEs).
REPORTS = r"""
a1 AS (
  SELECT CAST(year(d.order_date) AS BIGINT) AS order_year,
         CAST(month(d.order_date) AS BIGINT) AS order_month,
         SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales,
         COUNT(DISTINCT f.order_key) AS total_orders
  FROM fact_sales f LEFT JOIN dim_orders d ON f.order_key = d.order_key
  GROUP BY 1, 2
),
a2 AS (
  SELECT f.product_key, p.product_name, p.category, p.sub_category,
         SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales,
         COUNT(DISTINCT f.order_key) AS total_orders
  FROM fact_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY f.product_key, p.product_name, p.category, p.sub_category
),
a3 AS (
  SELECT p.category, SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales,
         COUNT(DISTINCT f.order_key) AS total_orders
  FROM fact_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY p.category
),
a4 AS (
  SELECT p.sub_category AS subcategory, SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales,
         COUNT(DISTINCT f.order_key) AS total_orders
  FROM fact_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY p.sub_category
),
a5 AS (
  SELECT r.state AS region, SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_revenue,
         COUNT(DISTINCT f.order_key) AS total_orders
  FROM fact_sales f LEFT JOIN dim_regions r ON f.region_key = r.region_key
  GROUP BY r.state
),
k1 AS (
  SELECT f.order_key, d.order_id, p.product_id,
         CAST(date_diff('day', MIN(d.order_date), MAX(s.ship_date)) AS BIGINT) AS lead_time_days
  FROM fact_sales f
  LEFT JOIN dim_orders d ON f.order_key = d.order_key
  LEFT JOIN dim_shipping s ON f.ship_key = s.ship_key
  LEFT JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY f.order_key, d.order_id, p.product_id
),
k2 AS (
  SELECT p.category, COUNT(f.product_key) AS total_sales,
         SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_revenue,
         round(CAST(SUM(CAST(f.sales AS DECIMAL(20,6))) AS DOUBLE) / NULLIF(COUNT(f.sales), 0), 6)
           AS avg_revenue_per_sale
  FROM fact_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY p.category
),
k3 AS (
  SELECT p.category, p.sub_category, COUNT(f.product_key) AS total_sales,
         SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_revenue,
         round(CAST(SUM(CAST(f.sales AS DECIMAL(20,6))) AS DOUBLE) / NULLIF(COUNT(f.sales), 0), 6)
           AS avg_revenue_per_sale
  FROM fact_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY p.category, p.sub_category
),
k4 AS (
  SELECT p.category,
         round(CAST(SUM(CAST(f.sales AS DECIMAL(20,6))) AS DOUBLE) / NULLIF(COUNT(f.sales), 0), 6)
           AS avg_order_value
  FROM fact_sales f LEFT JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY p.category
),
k5raw AS (
  SELECT c.customer_name,
         COUNT(DISTINCT f.order_key) / NULLIF(COUNT(DISTINCT d.order_date), 0) AS avg_order_frequency
  FROM fact_sales f
  LEFT JOIN dim_orders d ON f.order_key = d.order_key
  LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
  GROUP BY c.customer_name
),
k5 AS (SELECT customer_name, round(avg_order_frequency, 6) AS avg_order_frequency FROM k5raw),
m1 AS (
  SELECT p.product_key, p.product_name, p.category, p.sub_category,
         COUNT(DISTINCT f.order_key) AS total_orders,
         SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales_revenue
  FROM fact_sales f JOIN dim_products p ON f.product_key = p.product_key
  GROUP BY p.product_key, p.product_name, p.category, p.sub_category
),
m2 AS (
  SELECT f.order_key, d.order_id, c.customer_id, c.customer_name, p.product_name,
         r.region AS region_name,
         SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales,
         COUNT(f.order_key) AS total_orders
  FROM fact_sales f
  LEFT JOIN dim_orders d ON f.order_key = d.order_key
  LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
  LEFT JOIN dim_products p ON f.product_key = p.product_key
  LEFT JOIN dim_regions r ON f.region_key = r.region_key
  GROUP BY 1, 2, 3, 4, 5, 6
),
m3 AS (
  SELECT f.order_key, d.order_id, c.customer_id, c.customer_name,
         r.region AS region_name, s.ship_mode,
         SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales,
         COUNT(f.order_key) AS total_orders,
         CAST(round(AVG(date_diff('day', d.order_date, s.ship_date))) AS BIGINT) AS avg_shipping_days
  FROM fact_sales f
  LEFT JOIN dim_orders d ON f.order_key = d.order_key
  LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
  LEFT JOIN dim_regions r ON f.region_key = r.region_key
  LEFT JOIN dim_shipping s ON f.ship_key = s.ship_key
  GROUP BY 1, 2, 3, 4, 5, 6
),
x1 AS (
  SELECT c.segment, SUM(CAST(f.sales AS DECIMAL(20,6))) AS total_sales,
         COUNT(DISTINCT f.order_key) AS total_orders
  FROM fact_sales f LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
  GROUP BY c.segment
)
"""

BASE = ",\n".join(b.strip() for b in (FLAT, STAR, REPORTS))


# Report CTE -> its money columns (cast to DOUBLE on output).
_MONEY_COLS = {
    "a1": ["total_sales"], "a2": ["total_sales"], "a3": ["total_sales"], "a4": ["total_sales"],
    "a5": ["total_revenue"], "k1": [], "k2": ["total_revenue"], "k3": ["total_revenue"],
    "k4": [], "k5": [], "m1": ["total_sales_revenue"], "m2": ["total_sales"],
    "m3": ["total_sales"], "x1": ["total_sales"],
}


def _out(cte: str) -> str:
    cols = _MONEY_COLS[cte]
    if not cols:
        return f"SELECT * FROM {cte}"
    repl = ", ".join(f"CAST(round({c}, 2) AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM {cte}"


def _share(value: str, within: str = "") -> str:
    over = f"OVER (PARTITION BY {within})" if within else "OVER ()"
    return f"round(CAST({value} AS DOUBLE) / NULLIF(CAST(SUM({value}) {over} AS DOUBLE), 0), 6)"


_GRAIN_MD5 = (
    "md5(concat_ws('|', CAST(order_key AS VARCHAR), coalesce(order_id, ''), "
    "coalesce(customer_id, ''), coalesce(customer_name, ''), coalesce(region_name, ''), "
    "coalesce(ship_mode, '')))"
)

_FREQ_BUCKET = (
    "CASE WHEN avg_order_frequency IS NULL THEN '3+' "
    "WHEN avg_order_frequency = 1 THEN '1' "
    "WHEN avg_order_frequency <= 2 THEN '1-2' "
    "WHEN avg_order_frequency <= 3 THEN '2-3' ELSE '3+' END"
)

_CTE_OF = dict(zip((n for group in REPORTS_OF.values() for n in group), "a1 a2 a3 a4 a5 k1 k2 k3 k4 k5 m1 m2 m3".split(), strict=True))
_REPORT_CTES = [(g, n, t, _CTE_OF[n]) for g, group in REPORTS_OF.items() for n, (t, _) in group.items()]

# Columns of each report table.
_WIDTH = dict(zip("a1 a2 a3 a4 a5 k1 k2 k3 k4 k5 m1 m2 m3".split(), (4, 6, 3, 3, 3, 4, 4, 5, 2, 2, 6, 8, 9), strict=True))

FINAL: dict[str, str] = {
    "flat_scan": "SELECT * FROM flat",
    "table_roundtrip": "SELECT * FROM fact_sales",
    "fact_partitioned": (
        "SELECT f.*, d.order_date FROM fact_sales f LEFT JOIN dim_orders d ON f.order_key = d.order_key"
    ),
    "fact_clustered": (
        "SELECT f.*, d.order_date FROM fact_sales f JOIN dim_orders d ON f.order_key = d.order_key"
    ),
    "mart_preview": (
        "SELECT * REPLACE (CAST(round(total_sales_revenue, 2) AS DOUBLE) AS total_sales_revenue) FROM m1 "
        "ORDER BY product_key, product_name, category, sub_category LIMIT 10"
    ),
    "impute_postal_code": "SELECT * FROM imputed",
    "dedupe_rows": "SELECT * FROM deduped",
    "dedupe_report": (
        "SELECT rows_in, rows_out, rows_in - rows_out AS rows_removed FROM "
        "(SELECT (SELECT count(*) FROM imputed) AS rows_in, (SELECT count(*) FROM deduped) AS rows_out)"
    ),
    "parse_dates": "SELECT * FROM parsed",
    "invalid_date_rows": "SELECT * FROM parsed WHERE ship_date < order_date",
    "invalid_date_count": "SELECT count(*) FILTER (WHERE ship_date < order_date) AS invalid_rows FROM parsed",
    "clean_flat": "SELECT * FROM clean",
    "dim_orders": "SELECT * FROM dim_orders",
    "dim_shipping": "SELECT * FROM dim_shipping",
    "dim_customers": "SELECT * FROM dim_customers",
    "dim_regions": "SELECT * FROM dim_regions",
    "dim_products": "SELECT * FROM dim_products",
    "surrogate_keys": (
        "SELECT DISTINCT 'order_key' AS key_name, order_id AS natural_key, order_key AS surrogate_key "
        "FROM dim_orders WHERE order_id IS NOT NULL UNION ALL "
        "SELECT DISTINCT 'ship_key', CAST(ship_date AS VARCHAR), ship_key FROM dim_shipping "
        "WHERE ship_date IS NOT NULL UNION ALL "
        "SELECT DISTINCT 'customer_key', customer_id, customer_key FROM dim_customers "
        "WHERE customer_id IS NOT NULL UNION ALL "
        "SELECT DISTINCT 'region_key', CAST(postal_code AS VARCHAR), region_key FROM dim_regions "
        "WHERE postal_code IS NOT NULL UNION ALL "
        "SELECT DISTINCT 'product_key', product_id, product_key FROM dim_products "
        "WHERE product_id IS NOT NULL"
    ),
    "fact_sales": "SELECT * FROM fact_sales",
    "sales_by_month": _out("a1"),
    "sales_by_product": _out("a2"),
    "sales_by_category": _out("a3"),
    "sales_by_subcategory": _out("a4"),
    "revenue_by_state": _out("a5"),
    "lead_time": _out("k1"),
    "category_performance": _out("k2"),
    "subcategory_performance": _out("k3"),
    "avg_order_value_by_category": _out("k4"),
    "order_frequency_by_customer": _out("k5"),
    "mart_inventory": _out("m1"),
    "mart_fulfillment": _out("m2"),
    "mart_shipping": _out("m3"),
    "sales_by_segment": _out("x1"),
    "headline_kpis": (
        "SELECT CAST(round(SUM(CAST(sales AS DECIMAL(20,6))), 2) AS DOUBLE) AS total_sales, "
        "COUNT(DISTINCT order_key) AS total_orders, "
        "round(CAST(SUM(CAST(sales AS DECIMAL(20,6))) AS DOUBLE) / "
        "NULLIF(COUNT(DISTINCT order_key), 0), 6) AS avg_order_value FROM fact_sales"
    ),
    "top_products": (
        _out("a2") + " ORDER BY total_sales DESC, product_key, product_name, category, sub_category LIMIT 10"
    ),
    "category_revenue_share": (
        "SELECT category, CAST(round(s, 2) AS DOUBLE) AS total_sales_revenue, " + _share("s") + " AS revenue_share "
        "FROM (SELECT category, SUM(total_sales_revenue) AS s FROM m1 GROUP BY category)"
    ),
    "top_subcategories_by_orders": (
        "SELECT sub_category, CAST(SUM(total_orders) AS BIGINT) AS total_orders FROM m1 "
        "WHERE sub_category IS NOT NULL GROUP BY sub_category "
        "ORDER BY total_orders DESC, sub_category LIMIT 10"
    ),
    "sales_by_region": (
        "SELECT region_name, CAST(round(SUM(total_sales), 2) AS DOUBLE) AS total_sales FROM m2 GROUP BY region_name"
    ),
    "top_customers_share": (
        "SELECT customer_name, CAST(round(s, 2) AS DOUBLE) AS total_sales, " + _share("s") + " AS sales_share FROM "
        "(SELECT customer_name, SUM(total_sales) AS s FROM m2 WHERE customer_name IS NOT NULL "
        "GROUP BY customer_name ORDER BY s DESC, customer_name LIMIT 5)"
    ),
    "shipping_sample": (
        "SELECT * EXCLUDE (_h) FROM (SELECT * REPLACE (CAST(round(total_sales, 2) AS DOUBLE) AS total_sales), "
        + _GRAIN_MD5 + " AS _h FROM m3 ORDER BY _h LIMIT 100) ORDER BY CAST(order_id AS VARCHAR), _h"
    ),
    "shipping_days_by_mode": (
        "SELECT ship_mode, CAST(SUM(avg_shipping_days) AS BIGINT) AS sum_shipping_days, "
        "round(AVG(avg_shipping_days), 6) AS avg_shipping_days FROM m3 GROUP BY ship_mode"
    ),
    "region_sales_share": (
        "SELECT region_name, CAST(round(s, 2) AS DOUBLE) AS total_sales, " + _share("s") + " AS sales_share "
        "FROM (SELECT region_name, SUM(total_sales) AS s FROM m3 GROUP BY region_name)"
    ),
    "category_line_count": (
        "SELECT 'category_performance' AS source, category, CAST(SUM(total_sales) AS BIGINT) AS total_sales "
        "FROM k2 GROUP BY category UNION ALL "
        "SELECT 'subcategory_performance', category, CAST(SUM(total_sales) AS BIGINT) "
        "FROM k3 GROUP BY category"
    ),
    "category_performance_share": (
        "SELECT source, category, CAST(round(s, 2) AS DOUBLE) AS total_revenue, "
        + _share("s", "source") + " AS revenue_share FROM ("
        "SELECT 'category_performance' AS source, category, SUM(total_revenue) AS s FROM k2 GROUP BY category "
        "UNION ALL SELECT 'subcategory_performance', category, SUM(total_revenue) FROM k3 GROUP BY category)"
    ),
    "lead_time_histogram": (
        "SELECT bin, lo + CAST(bin - 1 AS DOUBLE) * width / 20.0 AS bin_start, "
        "lo + CAST(bin AS DOUBLE) * width / 20.0 AS bin_end, count(*) AS lead_time_count FROM ("
        "SELECT CASE WHEN hi = lo THEN CAST(1 AS BIGINT) ELSE least(CAST(floor("
        "(CAST(x AS DOUBLE) - CAST(lo AS DOUBLE)) * CAST(20.0 AS DOUBLE) / "
        "(CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE))) AS BIGINT) + 1, CAST(20 AS BIGINT)) END AS bin, "
        "CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE) AS width FROM ("
        "SELECT lead_time_days AS x, min(lead_time_days) OVER () AS lo, "
        "max(lead_time_days) OVER () AS hi FROM k1 WHERE lead_time_days IS NOT NULL)"
        ") GROUP BY bin, lo, width"
    ),
    "frequency_buckets": (
        "SELECT " + _FREQ_BUCKET + " AS frequency_range, count(*) AS customers FROM k5raw "
        "GROUP BY 1 ORDER BY customers DESC, frequency_range"
    ),
    "sales_by_year": (
        "SELECT order_year, CAST(round(SUM(total_sales), 2) AS DOUBLE) AS total_sales FROM a1 GROUP BY order_year"
    ),
    "orders_by_year": (
        "SELECT order_year, CAST(SUM(total_orders) AS BIGINT) AS total_orders FROM a1 GROUP BY order_year"
    ),
    "state_revenue_share": (
        "SELECT region, CAST(round(total_revenue, 2) AS DOUBLE) AS total_revenue, total_orders, "
        + _share("total_revenue") + " AS revenue_share FROM a5"
    ),
    "stored_reports": " UNION ALL ".join(
        f"SELECT '{n}' AS report, count(*) AS row_count, CAST({_WIDTH[c]} AS BIGINT) AS columns FROM {c}"
        for _, n, _, c in _REPORT_CTES
    ),
    "written_layouts": " UNION ALL ".join(
        f"SELECT '{name}' AS layout, count(*) AS row_count, count(DISTINCT d.order_date) AS days, "
        "CAST(round(SUM(CAST(f.sales AS DECIMAL(20,6))), 2) AS DOUBLE) AS total_sales "
        f"FROM fact_sales f {how} JOIN dim_orders d ON f.order_key = d.order_key"
        for name, how in (("fact_sales_partitioned", "LEFT"), ("fact_sales_partitioned_clustered", ""))
    ),
    "star_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST(SUM({k}) AS BIGINT) AS key_sum FROM {t}"
        for t, k in (("fact_sales", "order_key"), ("dim_orders", "order_key"), ("dim_shipping", "ship_key"),
                     ("dim_customers", "customer_key"), ("dim_regions", "region_key"), ("dim_products", "product_key"))
    ),
    "raw_preview": "SELECT * FROM flat ORDER BY row_id, product_id, ship_date_s, sales LIMIT 10",
    "quarantined_rows": (
        "SELECT row_id, order_id, '31/02/1995' AS order_date_s, "
        "CAST(strptime(ship_date_s, '%d/%m/%Y') AS DATE) AS ship_date, sales "
        "FROM (SELECT DISTINCT * REPLACE ('31/02/1995' AS order_date_s) FROM imputed WHERE CAST(order_id AS BIGINT) % 50 = 0)"
    ),
    "batch_summary": (
        "SELECT (SELECT count(*) FROM flat) AS rows_in, (SELECT count(*) FROM flat) - b.n - g.n AS duplicates_removed, "
        "b.n AS quarantined, b.n AS quarantine_rows, g.n AS lines, g.late AS invalid_dates, f.n AS fact_rows, "
        "CAST(13 AS BIGINT) AS reports, CAST(0 AS BIGINT) AS failed, CAST(2 AS BIGINT) AS layouts FROM "
        "(SELECT count(*) AS n FROM (SELECT DISTINCT * REPLACE ('31/02/1995' AS order_date_s) FROM imputed WHERE CAST(order_id AS BIGINT) % 50 = 0)) b, "
        "(SELECT count(*) AS n, count(*) FILTER (WHERE ship_date < order_date) AS late FROM parsed WHERE CAST(order_id AS BIGINT) % 50 <> 0) g, "
        "(SELECT count(*) AS n FROM (SELECT DISTINCT sales, order_id, ship_date, customer_id, postal_code, product_id "
        "FROM parsed WHERE CAST(order_id AS BIGINT) % 50 <> 0)) f"
    ),
    "report_row_counts": " UNION ALL ".join(
        f"SELECT '{g}' AS report_group, '{n}' AS report, '{t}' AS output_table, "
        f"count(*) AS row_count FROM {c}"
        for g, n, t, c in _REPORT_CTES
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {BASE}\n{final}" for name, final in FINAL.items()}


def over_flat(name: str) -> str:
    """The query ``name`` reading a ``flat`` view instead of the test tables."""
    return f"WITH {STAR.strip()},\n{REPORTS.strip()}\n{FINAL[name]}"


def over_star(name: str) -> str:
    """The query ``name`` reading star-table views (fact_sales, dim_*)."""
    return f"WITH {REPORTS.strip()}\n{FINAL[name]}"
