"""Report catalogue and runs.

R1 is a plain dict: group -> report name -> (output table, plan function).
``run`` builds one report, optionally writes it as its output table and
reads it back; ``run_all`` runs a group and returns the results together
with the reports that failed and why (a failure never stops the group).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.operators.star import Star
from starlane.plans import lattice
from starlane.plans import reports as R
from starlane.session import brief_shuffles, file_content, input_bytes, input_state, remove_path, replace_file, scratch_path, shuffle_partitions, size_shuffles
from starlane.sources.tables import keyed_name, open_keyed, read_table, write_keyed, write_tables, write_version

Plan = Callable[[Star], DataFrame]

# Report names and their output tables.
REPORTS: dict[str, dict[str, tuple[str, Plan]]] = {
    "aggregations": {
        "aggregate_sales_by_month": ("agg_sales_monthly", R.sales_by_month),
        "aggregate_sales_by_product": ("agg_sales_product", R.sales_by_product),
        "aggregate_sales_by_category": ("agg_sales_category", R.sales_by_category),
        "aggregate_sales_by_subcategory": ("agg_sales_subcategory", R.sales_by_subcategory),
        "aggregate_revenue_by_region": ("agg_revenue_region", R.revenue_by_state),
    },
    "kpis": {
        "calculate_lead_time": ("kpi_lead_time", R.lead_time),
        "product_category_performance": ("kpi_product_category_performance", R.category_performance),
        "product_subcategory_performance": ("kpi_product_subcategory_performance", R.subcategory_performance),
        "avg_order_value_per_category": ("kpi_avg_order_value_per_category", R.avg_order_value_by_category),
        "avg_order_frequency_by_customer": ("kpi_avg_order_frequency_by_customer", R.order_frequency_by_customer),
    },
    "marts": {
        "mart_inventory_analysis": ("mart_inventory_analysis", R.mart_inventory),
        "mart_order_fulfillment": ("mart_order_fulfillment", R.mart_fulfillment),
        "mart_shipping_logistics": ("mart_shipping_logistics", R.mart_shipping),
    },
}


# Advisory display order of the original report definitions (ORDER BY inside
# a create-table is not kept by the table), completed with a unique
# tie-break.  A leading "-" means descending.
ORDER: dict[str, list[str]] = {
    "aggregate_sales_by_month": ["order_year", "order_month"],
    "aggregate_sales_by_product": ["-total_sales", "product_key", "product_name",
                                   "category", "sub_category"],
    "aggregate_sales_by_category": ["-total_sales", "category"],
    "aggregate_sales_by_subcategory": ["-total_sales", "subcategory"],
    "aggregate_revenue_by_region": ["-total_revenue", "region"],
}


#: Reports that are rolled up from a stored aggregate, and which.  Those of products alone
#: (K2-K4) use it where it is stored, but need no order: a sum of the
#: fact per product takes less than storing the aggregate for it.
AGGREGATE = {
    "aggregate_sales_by_month": "order_parties",
    "aggregate_sales_by_product": "order_products",
    "aggregate_sales_by_category": "order_products",
    "aggregate_sales_by_subcategory": "order_products",
    "aggregate_revenue_by_region": "order_parties",
    "avg_order_frequency_by_customer": "order_parties",
    "mart_inventory_analysis": "order_products",
}
ROLLED_UP = set(AGGREGATE)


def _sort_cols(spec: list[str]):
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in spec]


def _find(name: str) -> tuple[str, Plan]:
    for group in REPORTS.values():
        if name in group:
            return group[name]
    raise KeyError(f"unknown report {name!r}")


def run(star: Star, name: str, base: str | None = None, ordered: bool = False) -> DataFrame:
    """R2: build one report.  With ``base`` the result is written as its
    output table (replacing it) and the table is read back.  ``ordered``
    applies the report's display order on the way out (a global sort, so
    only asked for when a person will read the rows)."""
    table, plan = _find(name)
    df = R.finalize(plan(star))
    if base is not None:
        where = write_tables({table: df}, base)
        df = read_table(df.sparkSession, where[table])
    if ordered and name in ORDER:
        df = df.orderBy(*_sort_cols(ORDER[name]))
    return df


def run_all(star: Star, group: str, base: str | None = None
            ) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run every report of a group; return (results, errors).

    Every report is executed here, so one that fails while it runs counts as
    failed: results are written as tables below ``base``, or below the reliable
    scratch folder when there is none."""
    base = base or scratch_path(star.fact_sales.sparkSession, f"reports-{uuid.uuid4().hex[:12]}")
    results, errors = {}, {}
    for name in REPORTS[group]:
        try:
            if name in ROLLED_UP:
                lattice.store(star, AGGREGATE[name])  # once: the fact is not read again for these reports
            with brief_shuffles(star.fact_sales.sparkSession):
                results[name] = run(star, name, base)
        except Exception as exc:  # keep going, like the original batch
            errors[name] = f"{type(exc).__name__}: {exc}"
    return results, errors


_BUILT: "weakref.WeakKeyDictionary[Star, dict[str, tuple[str, DataFrame]]]" = weakref.WeakKeyDictionary()


def report_frame(star: Star, name: str) -> DataFrame:
    """A report built once per star and kept for reuse -- the dashboard's
    memoised fetch, so several charts over one report do not rebuild it.

    The report is written as a table below the reliable checkpoint folder, so
    it outlives any executor and fact-sized reports fill no executor disks.
    Money keeps its exact decimal type, so charts can re-aggregate it exactly.
    ``release`` deletes the tables."""
    memo = _BUILT.setdefault(star, {})
    if name not in memo:
        _, plan = _find(name)
        if name in ROLLED_UP:
            lattice.store(star, AGGREGATE[name])
        df = plan(star)
        path = scratch_path(df.sparkSession, f"report-{name}-{uuid.uuid4().hex[:12]}")
        with brief_shuffles(df.sparkSession):
            df.write.parquet(path)
        memo[name] = path, df.sparkSession.read.schema(df.schema).parquet(path)
    return memo[name][1]


def fetch_mart(star: Star, name: str) -> DataFrame:
    """A data mart in output form, built once per star and then served
    from the stored report (the dashboard's memoised fetch)."""
    return R.finalize(report_frame(star, name))


def release(star: Star) -> None:
    """Delete every report kept for ``star``, and the aggregates they are rolled up
    from (e.g. once a dashboard session ends)."""
    forget_reports(star)
    lattice.release(star)


def forget_reports(star: Star) -> None:
    for path, df in _BUILT.pop(star, {}).values():
        remove_path(df.sparkSession, path)


def rebuild_marts(star: Star) -> dict[str, DataFrame]:
    """Drop the memoised reports of ``star`` and build the three marts again."""
    forget_reports(star)
    return {name: fetch_mart(star, name) for name in REPORTS["marts"]}


def batch_state(flat: DataFrame, strict: bool = True) -> str:
    """What a batch's results depend on: the plan that makes the flat lines and a
    listing of the files that it reads.  Lines that come from no file have
    a state of their own every time, so a batch over them is never resumed."""
    folders = sorted({f.rsplit("/", 1)[0] for f in flat.inputFiles()})
    if not folders:
        return uuid.uuid4().hex
    plan = flat._jdf.queryExecution().analyzed().canonicalized().toString()
    said = json.dumps([plan, strict, list(map(str, input_state(flat.sparkSession, folders)))])
    return hashlib.sha256(said.encode()).hexdigest()


class Steps:
    """The finished steps of a batch, in a small file that each step replaces
    when it is done.  A run over the same input skips them."""

    def __init__(self, spark: SparkSession, root: str, state: str):
        self.spark, self.path, self.state = spark, f"{root}/_steps", state
        held = json.loads(file_content(spark, self.path) or "{}")
        self.done = held["steps"] if held.get("state") == state else {}

    def run(self, name: str, work: Callable[[], object]) -> object:
        if name not in self.done:
            self.done[name] = work()
            replace_file(self.spark, self.path, json.dumps({"state": self.state, "steps": self.done}).encode())
        return self.done[name]


def _load_star(flat: DataFrame, root: str, strict: bool) -> dict[str, object]:
    """Clean the lines, write what they set aside and the star below ``root``,
    the fact and the order dimension in buckets of the order key."""
    from starlane.operators.clean import clean_parts
    from starlane.operators.star import ORDER_KEYED, build_star

    cleaned = clean_parts(flat, strict=strict)
    quarantine = write_tables({"quarantine": cleaned.quarantined}, root)["quarantine"]
    tables = build_star(cleaned.lines, stored=True).tables()
    keyed = {name: tables.pop(name) for name in ORDER_KEYED}
    where = write_tables(tables, f"{root}/star")
    for name, df in keyed.items():
        write = lambda path, df=df: write_keyed(df, keyed_name(path), path, "order_key")
        where[name] = write_version(flat.sparkSession, f"{root}/star/{name}", write)
    cleaned.release()
    buckets = shuffle_partitions(flat.sparkSession)
    return {"rows": cleaned.report(), "quarantine": quarantine, "tables": where, "buckets": buckets}


def _open_star(spark: SparkSession, loaded: dict[str, object]) -> Star:
    from starlane.operators.star import ORDER_KEYED

    where = loaded["tables"]
    tables = {n: open_keyed(spark, p, "order_key", loaded["buckets"]) if n in ORDER_KEYED else read_table(spark, p) for n, p in where.items()}
    return Star(**tables, keyed=True)


def run_batch(flat: DataFrame, base: str, strict: bool = True) -> dict[str, object]:
    """The whole batch -- clean, model, load the star, run every report
    group into its tables, write both fact layouts.  Returns where things
    went, which reports failed, and the row counts of the cleaning: rows read
    are duplicates removed, quarantined rows and lines.  Rows whose dates do
    not parse (lenient reading only) are written to ``quarantine``.

    Every step is written down when it is done (``Steps``): a batch that
    failed or was stopped goes on where it was when it is run again on the same
    input, and a changed input starts it anew."""
    from starlane.plans import layout

    root, spark = base.rstrip("/"), flat.sparkSession
    size_shuffles(spark, input_bytes(spark, flat.inputFiles()))
    steps = Steps(spark, root, batch_state(flat, strict))
    with brief_shuffles(spark):
        loaded = steps.run("star", lambda: _load_star(flat, root, strict))
    star = _open_star(spark, loaded)
    errors: dict[str, str] = {}
    reports: dict[str, list[str]] = {}

    def report(name: str) -> str:
        if name in ROLLED_UP:
            lattice.store(star, AGGREGATE[name])
        table, plan = _find(name)
        return write_tables({table: R.finalize(plan(star))}, f"{root}/reports")[table]

    try:
        with brief_shuffles(spark):
            for group, names in REPORTS.items():
                reports[group] = []
                for name in sorted(names):
                    try:
                        steps.run(f"report {name}", lambda name=name: report(name))
                        reports[group].append(name)
                    except Exception as exc:  # keep going, like the original batch
                        errors[name] = f"{type(exc).__name__}: {exc}"
            layouts = {
                name: steps.run(f"layout {name}", lambda name=name, write=write: write(star, f"{root}/layouts/{name}"))
                for name, write in layout.layouts().items()
            }
    finally:
        lattice.release(star)
    return {**{k: loaded[k] for k in ("rows", "quarantine", "tables")}, "reports": reports, "errors": errors, "layouts": layouts}


def report_row_counts(star: Star) -> DataFrame:
    """R3 summary: rows produced by every report, one row per report.

    Counts the reports as built once per star (``report_frame``),
    so running the whole catalogue builds each report at most once."""
    parts = []
    for group, reports in REPORTS.items():
        for name, (table, _) in reports.items():
            parts.append(
                report_frame(star, name).agg(F.count(F.lit(1)).alias("row_count")).select(
                    F.lit(group).alias("report_group"),
                    F.lit(name).alias("report"),
                    F.lit(table).alias("output_table"),
                    "row_count",
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
