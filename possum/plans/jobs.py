"""The reference's three entry points as Spark jobs.

* ``run_etl``: the four CSV extracts to typed Parquet tables, rejects kept
  aside, the initial price history, the cached view, and the key checks. Every
  table is published: a new version folder, then the pointer.
* ``run_export``: the four document sets built from the tables and published
  atomically (``export_json.sh`` + ``sync.sh``): a new version per run, the
  pointer switched last.
* ``run_reports``: the six document queries over the published collections,
  written as JSON (``run_queries.sh``).
* ``run_stream``: the order-line change stream applied to the order lines
  and the cached view (triggers + replication), drained once (``availableNow``,
  for any scheduler) or every N minutes (the reference's 15-minute cron).

Each job reads and writes a folder that all executors share; nothing passes
through the driver. A job holds a lease on the folder it publishes into, so a
second run of it is refused until the first ends or its lease expires
(``possum.sources.lease``). Run with ``python -m possum.plans.jobs <job> ...``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from possum import fixed, schemas
from possum.operators import checks
from possum.plans import documents as D
from possum.plans import catalog, etl, reports, views
from possum.session import shuffles_removed
from possum.sources import csv as csv_source
from possum.sources import sinks
from possum.sources.lease import Lease
from possum.sources.testdata import PosTables

LEASE_SECONDS = 3600.0  # without a renewal; every published table renews it

TABLES = ("customer", "city", "order", "orderline", "product", "price_history")


def run_etl(spark: SparkSession, extract_dir: str, out_dir: str, escape: str = "\\",
            as_of: dt.datetime | None = None, line_breaks: str = "split", lease_seconds: float = LEASE_SECONDS) -> dict[str, int]:
    """CSV extracts -> typed tables. Returns the number of rejects per extract."""
    with Lease(spark, out_dir, lease_seconds) as lease:
        return _etl(spark, extract_dir, out_dir, escape, as_of, line_breaks, lease)


def _etl(spark: SparkSession, extract_dir: str, out_dir: str, escape: str, as_of: dt.datetime | None, line_breaks: str,
         lease: Lease) -> dict[str, int]:
    # each run stages into a folder of its own: nothing of an earlier run is read
    stage = f"{out_dir}/_stage/{uuid.uuid4().hex}"
    raw = {k: csv_source.read_extract(spark, f"{extract_dir}/{k}.csv", k, escape=escape, line_breaks=line_breaks,
                                      stage=f"{stage}/records/{k}") for k in schemas.RAW}
    cleaned = {
        "customer": etl.clean_customers(raw["customers"], with_city=True),
        "order": etl.clean_orders(raw["orders"]),
        "product": etl.clean_products(raw["products"]),
        "orderline_units": etl.clean_orderline_units(raw["orderlines"]),
    }
    good, rejects = {}, {}
    for name, df in cleaned.items():
        df.write.parquet(f"{stage}/{name}")
        kept, bad = etl.split_rejects(spark.read.parquet(f"{stage}/{name}"))
        sinks.publish(spark, bad, f"{out_dir}/_rejects/{name}", lease=lease)
        good[name], rejects[name] = kept, bad.count()
    tables = {
        "customer": good["customer"].drop("rawCity", "rawState"),
        "city": etl.cities_of(good["customer"]),
        "order": good["order"],
        "orderline": etl.order_lines_from_units(good["orderline_units"].drop("units")).drop("n_rows"),
        "product": good["product"],
    }
    tables["price_history"] = etl.price_history_initial(tables["product"], as_of)
    for name, df in tables.items():
        sinks.publish(spark, df, f"{out_dir}/{name}", lease=lease)
    t = read_tables(spark, out_dir)
    sinks.publish(spark, views.product_buyers(t.product, t.customer, t.order, t.orderline), f"{out_dir}/mv_ProductBuyers",
                  lease=lease)
    sinks.publish(spark, check_tables(t), f"{out_dir}/_violations", lease=lease)
    sinks.remove(spark, stage)
    return rejects


def read_tables(spark: SparkSession, table_dir: str) -> PosTables:
    """The published version of each table, or a plain Parquet folder of its name."""
    def one(name: str) -> DataFrame:
        path = f"{table_dir}/{name}"
        if sinks.current_version(spark, path) is None:
            return spark.read.parquet(path)
        return sinks.read_published(spark, path)

    return PosTables(**{n: one(n) for n in ("customer", "city", "order", "orderline", "product")})


def check_tables(t: PosTables) -> DataFrame:
    """CHK1 + CHK2 over the typed tables: one DataFrame of violations."""
    named = {"customer": t.customer, "city": t.city, "order": t.order, "orderline": t.orderline,
             "product": t.product}
    pk = [checks.pk_violations(df, schemas.PRIMARY_KEYS[n], n).selectExpr(
        "table AS source", "kind", "key", "n") for n, df in named.items()]
    fk = [checks.fk_violations(named[c], cc, named[p], pc, f"{c}.{'_'.join(cc)}").selectExpr(
        "constraint AS source", "'missing parent' AS kind", "key", "n")
        for c, cc, p, pc in schemas.FOREIGN_KEYS if c in named and p in named]
    out = pk[0]
    for df in pk[1:] + fk:
        out = out.unionByName(df)
    return out


def build_documents(t: PosTables, in_order: bool = False) -> dict[str, DataFrame]:
    """The four document sets; with ``in_order`` those of ``EXPORT_ORDER`` by ranges of their id."""
    zf = D.zip_product_facts(t.customer, t.order, t.orderline, t.product)
    mf = D.zip_month_product_facts(t.customer, t.order, t.orderline, t.product)
    return {
        "prod": D.prod_documents(t.product, t.customer, t.order, t.orderline, in_order=in_order),
        "cust": D.cust_documents(t.customer, t.city, t.order, t.orderline, t.product, in_order=in_order),
        "custom1": D.zip_documents(zf, t.city),
        "custom2": D.state_month_documents(mf, t.city),
    }


# SRT1: the exports that come in order of their id, over all part files of a version
EXPORT_ORDER = {"prod": "ProductID", "cust": "CustomerID"}


def run_export(spark: SparkSession, table_dir: str, out_root: str, version: str | None = None,
               fmt: str = "json", lease_seconds: float = LEASE_SECONDS, compression: str = "none") -> dict[str, str]:
    """Build and publish the four collections; returns the published versions.
    A run whose version is already published is skipped collection by
    collection, so a failed run can simply be started again. ``compression``
    is that of JSON part files; plain lines are the default.

    Shuffle files of a collection are removed when it is written, so the disk
    holds those of one collection at a time."""
    out = {}
    with Lease(spark, out_root, lease_seconds) as lease, shuffles_removed(spark):
        for name, docs in build_documents(read_tables(spark, table_dir), in_order=True).items():
            if name in EXPORT_ORDER:
                docs = docs.orderBy(EXPORT_ORDER[name])
            out[name] = sinks.publish(spark, docs, f"{out_root}/{name}", version=version, fmt=fmt,
                                      fields=D.DOC_FIELDS[name], lease=lease, compression=compression)
    return out


def read_documents(spark: SparkSession, publish_root: str, fmt: str = "json") -> dict[str, DataFrame]:
    """The current version of each published collection, with its schema."""
    return {k: sinks.read_published(spark, f"{publish_root}/{k}", fmt, schema=schemas.DOCS[k])
            for k in schemas.DOCS}


def register_views(spark: SparkSession, table_dir: str | None = None, publish_root: str | None = None,
                   fmt: str = "json") -> list[str]:
    """Temp views for SQL users: the POS tables (Customer, City, `Order`,
    Orderline, Product) and the published collections (prod, cust, custom1,
    custom2), e.g. ``SELECT * FROM cust WHERE exists(Orders, o -> o.OrderTotal > 20000)``."""
    names = []
    if table_dir:
        t = read_tables(spark, table_dir)
        for name, df in {"Customer": t.customer, "City": t.city, "Order": t.order, "Orderline": t.orderline,
                         "Product": t.product}.items():
            df.createOrReplaceTempView(name)
            names.append(name)
    if publish_root:
        for name, df in read_documents(spark, publish_root, fmt).items():
            df.createOrReplaceTempView(name)
            names.append(name)
    return names


def run_reports(spark: SparkSession, publish_root: str, out_dir: str, state: str, month: int, product_id: int,
                total_over: float, quantity_over: int, top_k: int = fixed.REPORT_TOP_K, fmt: str = "json") -> None:
    """SNK8: q1..q6 over the published collections, written as JSON files."""
    docs = read_documents(spark, publish_root, fmt)
    cust_fields = D.DOC_FIELDS["cust"]
    results = {
        "q1": reports.customers_in_state(docs["cust"], state, cust_fields),
        "q2": reports.vip_customers(docs["cust"]),
        "q3": reports.product_recall(docs["prod"], product_id, buyers_as_text=False),
        "q4": reports.order_anomalies(docs["cust"], cust_fields, total_over, quantity_over),
        "q5": reports.state_top_products_from_docs(docs["custom1"], state, top_k),
        "q6": reports.state_month_products_from_docs(docs["custom2"], state, month),
    }
    for name, df in results.items():
        if "doc" in df.columns:  # whole documents: one JSON document per line
            df.select(F.col("doc").alias("value")).write.mode("overwrite").text(f"{out_dir}/{name}")
        else:
            df.write.mode("overwrite").json(f"{out_dir}/{name}")


def run_stream(spark: SparkSession, table_dir: str, state_root: str, log_path: str,
               every: str | None = None, max_files: int | None = None, lease_seconds: float = LEASE_SECONDS) -> None:
    """CHG5/CHG7: keep the order lines and the view under ``state_root`` from
    the change files in ``log_path``. The first run starts from the tables in
    ``table_dir``; later runs continue from the stream checkpoint."""
    from possum.streaming.refresh import BuyerViewMaintainer

    with Lease(spark, state_root, lease_seconds) as lease:
        m = BuyerViewMaintainer(spark, state_root, lambda: read_tables(spark, table_dir), lease=lease)
        if m.version() is None:
            m.bootstrap(read_tables(spark, table_dir).orderline)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        m.start(log_path, trigger=trigger, max_files_per_trigger=max_files).awaitTermination()


def materialize_view(spark: SparkSession, table_dir: str, out_dir: str) -> None:
    """mv_ProductBuyers as Parquet for lookups by product id (``catalog.write_lookup``)."""
    t = read_tables(spark, table_dir)
    mv = views.product_buyers(t.product, t.customer, t.order, t.orderline)
    catalog.write_lookup(mv, "productID", out_dir)


def main(argv: list[str] | None = None) -> None:
    from possum.session import job_session

    ap = argparse.ArgumentParser(prog="possum.plans.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    e = sub.add_parser("etl")
    e.add_argument("extract_dir")
    e.add_argument("out_dir")
    e.add_argument("--line-breaks", choices=csv_source.LINE_BREAKS, default="split",
                   help="quoted line breaks: found over the splits of a file (default), none in the files, or one task a file")
    x = sub.add_parser("export")
    x.add_argument("table_dir")
    x.add_argument("out_root")
    x.add_argument("--compression", default="none", help="of the JSON part files, e.g. gzip (default: plain lines)")
    q = sub.add_parser("reports")
    q.add_argument("publish_root")
    q.add_argument("out_dir")
    q.add_argument("--state", default=fixed.REPORT_STATE)
    q.add_argument("--month", type=int, default=fixed.REPORT_MONTH)
    q.add_argument("--product-id", type=int, default=fixed.REPORT_PRODUCT_ID)
    q.add_argument("--total-over", type=float, default=fixed.REPORT_TOTAL_OVER)
    q.add_argument("--quantity-over", type=int, default=fixed.REPORT_QUANTITY_OVER)
    ck = sub.add_parser("check")
    ck.add_argument("table_dir")
    ck.add_argument("out_dir")
    st = sub.add_parser("stream")
    st.add_argument("table_dir")
    st.add_argument("state_root")
    st.add_argument("log_path")
    st.add_argument("--every", default=None,
                    help=f"e.g. '{fixed.REFRESH_EVERY}' (the reference's cadence); default: drain once and stop")
    st.add_argument("--max-files", type=int, default=None, help="files a micro-batch takes at most (default: all there are)")
    mv = sub.add_parser("view")
    mv.add_argument("table_dir")
    mv.add_argument("out_dir")
    for p in (e, x, st):
        p.add_argument("--lease-seconds", type=float, default=LEASE_SECONDS,
                       help="how long a run that died keeps others out; it must outlast the longest step between two published tables")
    args = ap.parse_args(argv)
    spark = job_session()
    if args.job == "etl":
        print(run_etl(spark, args.extract_dir, args.out_dir, line_breaks=args.line_breaks, lease_seconds=args.lease_seconds))
    elif args.job == "export":
        print(run_export(spark, args.table_dir, args.out_root, lease_seconds=args.lease_seconds, compression=args.compression))
    elif args.job == "check":
        check_tables(read_tables(spark, args.table_dir)).write.mode("overwrite").json(args.out_dir)
    elif args.job == "view":
        materialize_view(spark, args.table_dir, args.out_dir)
    elif args.job == "stream":
        run_stream(spark, args.table_dir, args.state_root, args.log_path, args.every, args.max_files, args.lease_seconds)
    else:
        run_reports(spark, args.publish_root, args.out_dir, args.state, args.month, args.product_id,
                    args.total_over, args.quantity_over)


if __name__ == "__main__":
    main()
