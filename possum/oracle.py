"""Independent DuckDB SQL for every registered query (the correctness oracle).

The driver pre-registers the parquet tables as views (``part``, ``customer``,
``orders``, ``lineitem``, ``nation``, ``region``, ...). ``POS`` restates the
mapping of ``possum.sources.testdata`` in SQL; the bodies below restate each
query. Column names match the Spark side one for one. Where the Spark side
reads raw order lines (buyer lists, hot-order bounds) the SQL uses
``pos_lines``; the sales facts are summed from ``pos_orderline`` here and from
raw lines in Spark, which must agree.
"""

from __future__ import annotations

POS = """
pos_product AS (
  SELECT p_partkey AS id, p_name AS name,
         TRY_CAST(p_retailprice AS DECIMAL(6,2)) AS currentPrice,
         CAST(p_size AS INTEGER) AS availableQuantity
  FROM part),
pos_customer AS (
  SELECT c_custkey AS id,
         regexp_extract(c_name, '^([^#]*)', 1) AS firstName,
         regexp_extract(c_name, '#(.*)$', 1) AS lastName,
         'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         c_mktsegment AS address1,
         CASE WHEN c_acctbal < 0 THEN NULL
              ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS address2,
         CAST(NULL AS VARCHAR) AS phone,
         make_date(CAST(1940 + c_custkey % 60 AS INTEGER), CAST(1 + c_custkey % 12 AS INTEGER),
                   CAST(1 + c_custkey % 28 AS INTEGER)) AS birthdate,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip
  FROM customer),
pos_city AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS zip, n_name AS city, r_name AS state
  FROM nation JOIN region ON n_regionkey = r_regionkey),
pos_order AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS datePlaced,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE CAST(o_orderdate AS DATE) + TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END
           AS dateShipped,
         o_custkey AS customer_id
  FROM orders),
pos_lines AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem),
pos_orderline AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         CAST(SUM(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity,
         COUNT(*) AS n_rows
  FROM lineitem GROUP BY l_orderkey, l_partkey)
"""


def with_pos(*ctes: str, body: str) -> str:
    parts = [POS.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def product_buyers_sql(*ctes: str, orderline: str = "pos_orderline") -> str:
    return with_pos(*ctes,
    f"""pairs AS (SELECT DISTINCT ol.product_id, o.customer_id
                 FROM {orderline} ol JOIN pos_order o ON o.id = ol.order_id)""",
    """named AS (SELECT pr.product_id, pr.customer_id,
                        CAST(c.id AS VARCHAR) || ' ' || c.firstName || ' ' || c.lastName AS buyer
                 FROM pairs pr JOIN pos_customer c ON c.id = pr.customer_id)""",
    """lists AS (SELECT product_id, NULLIF(string_agg(buyer, ',' ORDER BY customer_id), '') AS customers
                 FROM named GROUP BY product_id)""",
    body="""SELECT p.id AS productID, p.name AS productName, l.customers
            FROM pos_product p LEFT JOIN lists l ON l.product_id = p.id""",
    )


PRODUCT_BUYERS = product_buyers_sql(orderline="pos_lines")



STATE = "AMERICA"
MONTH = 5
PRODUCT_ID = 1
TOTAL_OVER = 400000
QUANTITY_OVER = 50
TOP_K = 20
AS_OF = "2024-01-01 00:00:00"

ORDER_LINES = with_pos(body="SELECT order_id, product_id, quantity, n_rows FROM pos_orderline")

CLEAN_CUSTOMERS = with_pos(body="""
SELECT id, firstName, lastName, email, address1, address2, phone,
       strftime(birthdate, '%Y-%m-%d') AS birthdate, zip
FROM pos_customer""")

CITIES = with_pos(body="""
SELECT lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS zip,
       min({'c': n.n_name, 's': r.r_name}).c AS city,
       min({'c': n.n_name, 's': r.r_name}).s AS state
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
     LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
GROUP BY 1""")

CLEAN_ORDERS = with_pos(body="""
SELECT id, strftime(datePlaced, '%Y-%m-%d') AS datePlaced,
       strftime(dateShipped, '%Y-%m-%d') AS dateShipped, customer_id
FROM pos_order""")

CSV_ORDER_LINES = with_pos(body="""
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(COUNT(*) AS INTEGER) AS quantity
FROM lineitem GROUP BY l_orderkey, l_partkey""")

CLEAN_PRODUCTS = with_pos(body="""
SELECT id, name, CAST(currentPrice AS DOUBLE) AS currentPrice, availableQuantity FROM pos_product""")

PRICE_HISTORY_INITIAL = with_pos(body=f"""
SELECT id AS product_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS oldPrice,
       CAST(currentPrice AS DOUBLE) AS newPrice, '{AS_OF}' AS ts
FROM pos_product""")

# --- documents ----------------------------------------------------------------

PROD_CTES = (
    """pairs AS (SELECT DISTINCT ol.product_id, o.customer_id
                 FROM pos_lines ol JOIN pos_order o ON o.id = ol.order_id)""",
    """buyers AS (SELECT pr.product_id, pr.customer_id, c.firstName || ' ' || c.lastName AS CustomerName
                  FROM pairs pr JOIN pos_customer c ON c.id = pr.customer_id)""",
    """parr AS (SELECT product_id, list({'CustomerID': customer_id, 'CustomerName': CustomerName} ORDER BY customer_id)
                    AS ProductBuyers
                FROM buyers GROUP BY product_id)""",
    """prod AS (SELECT a.product_id AS ProductID, p.name AS ProductName, a.ProductBuyers
                FROM parr a JOIN pos_product p ON p.id = a.product_id)""",
)

PROD_DOCS = with_pos(*PROD_CTES, body="""
SELECT ProductID,
       to_json({'ProductID': ProductID, 'ProductName': ProductName, 'ProductBuyers': ProductBuyers}) AS doc
FROM prod""")

PRODUCT_RECALL = with_pos(*PROD_CTES, body=f"""
SELECT ProductID, ProductName, to_json(ProductBuyers) AS ProductBuyers
FROM prod WHERE ProductID = {PRODUCT_ID}""")


def cust_ctes(customer_filter: str = "TRUE", orderline: str = "pos_orderline") -> tuple[str, ...]:
    return (
        f"""lines AS (SELECT ol.order_id, ol.product_id, ol.quantity, p.name AS ProductName,
                           p.currentPrice * ol.quantity AS amount
                    FROM {orderline} ol JOIN pos_product p ON p.id = ol.product_id)""",
        """oitems AS (SELECT order_id, SUM(amount) AS total,
                             list({'ProductID': product_id, 'Quantity': quantity, 'ProductName': ProductName}
                                  ORDER BY product_id) AS Items
                      FROM lines GROUP BY order_id)""",
        """elems AS (SELECT o.customer_id, i.order_id AS OrderID,
                           {'OrderID': i.order_id,
                            'OrderTotal': CAST(ROUND(i.total, 2) AS DECIMAL(18,2)),
                            'OrderDate': o.datePlaced, 'ShippingDate': o.dateShipped,
                            'Items': i.Items} AS element
                    FROM oitems i JOIN pos_order o ON o.id = i.order_id)""",
        """carr AS (SELECT customer_id, list(element ORDER BY OrderID) AS Orders FROM elems GROUP BY customer_id)""",
        f"""cbase AS (SELECT cu.id AS customer_id, cu.firstName || ' ' || cu.lastName AS CustomerName,
                            cu.address1 || CASE WHEN cu.address2 IS NOT NULL THEN ' #' || cu.address2 ELSE '' END
                              AS PrintedAddress1,
                            ci.city || ', ' || ci.state || '   ' || cu.zip AS PrintedAddress2, ci.state
                     FROM pos_customer cu JOIN pos_city ci ON ci.zip = cu.zip
                     WHERE {customer_filter})""",
        """cust AS (SELECT b.customer_id AS CustomerID, b.state, b.CustomerName,
                          b.PrintedAddress1, b.PrintedAddress2, COALESCE(a.Orders, []) AS Orders
                   FROM cbase b LEFT JOIN carr a USING (customer_id))""",
    )


CUST_JSON = """to_json({'CustomerID': CustomerID, 'CustomerName': CustomerName,
                        'PrintedAddress1': PrintedAddress1, 'PrintedAddress2': PrintedAddress2,
                        'Orders': Orders})"""

CUST_DOCS = with_pos(*cust_ctes(), body=f"SELECT CustomerID, {CUST_JSON} AS doc FROM cust")

WEEK_LINES = """week_lines AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(SUM(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_shipdate < TIMESTAMP '1998-06-08' GROUP BY 1, 2)"""

PRODUCT_BUYERS_WEEK = product_buyers_sql(WEEK_LINES, orderline="week_lines")

CUST_DOCS_WEEK = with_pos(WEEK_LINES, *cust_ctes(orderline="week_lines"), body=f"SELECT CustomerID, {CUST_JSON} AS doc FROM cust")

CSV_REJECTS = """
SELECT reason, COUNT(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 40 IN (1, 2) THEN 'malformed row' WHEN c_custkey % 40 = 3 THEN 'bad or missing id'
              WHEN c_custkey % 40 = 4 THEN 'bad zip' WHEN c_custkey % 40 = 5 THEN 'no email' END AS reason
  FROM customer) WHERE reason IS NOT NULL GROUP BY reason"""

CUSTOMERS_IN_STATE = with_pos(*cust_ctes(f"ci.state = '{STATE}'"), body=f"""
SELECT CustomerID, {CUST_JSON} AS doc FROM cust
WHERE regexp_matches(PrintedAddress2, '.* {STATE}   .*')""")

VIP_CUSTOMERS = with_pos(*cust_ctes(), """tot AS (
  SELECT CustomerID, CustomerName,
         CAST(SUM(COALESCE(list_sum(list_transform(Orders, lambda o: o.OrderTotal)), 0)) AS DECIMAL(28,2))
           AS totalOrderCost
  FROM cust GROUP BY CustomerID, CustomerName)""", body="""
SELECT CustomerID, CustomerName, CAST(totalOrderCost AS DOUBLE) AS totalOrderCost FROM tot
WHERE totalOrderCost = (SELECT MAX(totalOrderCost) FROM tot)""")

ORDER_ANOMALIES = with_pos(*cust_ctes(), body=f"""
SELECT CustomerID, {CUST_JSON} AS doc FROM cust
WHERE len(list_filter(Orders, lambda o: o.OrderTotal > {TOTAL_OVER}
          OR len(list_filter(o.Items, lambda i: i.Quantity > {QUANTITY_OVER})) > 0)) > 0""")


def sales_ctes(with_month: bool, orderline: str = "pos_orderline", product: str = "pos_product") -> tuple[str, ...]:
    month = "CAST(month(o.datePlaced) AS INTEGER) AS OrderMonth," if with_month else ""
    mkey = "zl.OrderMonth," if with_month else ""
    qty = "zl.quantity" if with_month else "COALESCE(zl.quantity, 0)"
    return (
        f"""zl AS (SELECT c.zip, {month} ol.product_id, ol.quantity
                  FROM {orderline} ol JOIN pos_order o ON o.id = ol.order_id
                       JOIN pos_customer c ON c.id = o.customer_id)""",
        f"""facts AS (SELECT zl.zip, {mkey} p.id AS ProductID, p.name AS ProductName,
                            CAST(SUM({qty}) AS BIGINT) AS TotalPurchases,
                            CAST(ROUND(SUM({qty} * p.currentPrice), 2) AS DECIMAL(18,2)) AS TotalSales
                     FROM zl JOIN {product} p ON p.id = zl.product_id
                     GROUP BY zl.zip, {mkey} p.id, p.name)""",
    )


POPULAR = """{'TotalPurchases': TotalPurchases, 'TotalSales': TotalSales,
              'ProductID': ProductID, 'ProductName': ProductName}"""

ZIP_POPULARITY = with_pos(*sales_ctes(False), f"""zarr AS (
  SELECT zip, list({POPULAR} ORDER BY ProductID) AS PopularProducts
  FROM facts GROUP BY zip)""", body="""
SELECT a.zip AS ZIP,
       to_json({'ZIP': a.zip, 'State': ci.state, 'City': ci.city, 'PopularProducts': a.PopularProducts}) AS doc
FROM zarr a JOIN pos_city ci ON ci.zip = a.zip""")

STATE_MONTH_POPULARITY = with_pos(*sales_ctes(True), """keyed AS (
  SELECT f.*, ci.state FROM facts f JOIN pos_city ci ON ci.zip = f.zip)""", f"""smarr AS (
  SELECT state, OrderMonth, list({POPULAR} ORDER BY ProductID, zip) AS PopularProducts
  FROM keyed GROUP BY state, OrderMonth)""", body="""
SELECT OrderMonth, state AS State,
       to_json({'OrderMonth': OrderMonth, 'State': state, 'PopularProducts': PopularProducts}) AS doc
FROM smarr""")

STATE_TOP_PRODUCTS = with_pos(*sales_ctes(False), body=f"""
SELECT f.ProductID, min(f.ProductName) AS ProductName, CAST(SUM(f.TotalPurchases) AS BIGINT) AS TotalStatePurchases
FROM facts f JOIN pos_city ci ON ci.zip = f.zip
WHERE ci.state = '{STATE}'
GROUP BY f.ProductID
ORDER BY TotalStatePurchases DESC, f.ProductID
LIMIT {TOP_K}""")

STATE_MONTH_PRODUCTS = with_pos(*sales_ctes(True), body=f"""
SELECT f.ProductID, min(f.ProductName) AS ProductName, CAST(SUM(f.TotalPurchases) AS BIGINT) AS TotalStatePurchases,
       row_number() OVER (ORDER BY SUM(f.TotalPurchases) DESC, f.ProductID) AS rank
FROM facts f JOIN pos_city ci ON ci.zip = f.zip
WHERE ci.state = '{STATE}' AND f.OrderMonth = {MONTH}
GROUP BY f.ProductID""")


# --- changes ------------------------------------------------------------------------

CUTOFF = "2000-01-01"
SEQ = ("(CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 100000000000000"
       " + l_orderkey * 100 + l_linenumber)")

CHANGE_CTES = (
    f"""ol_base AS (SELECT l_orderkey AS order_id, l_partkey AS product_id,
                          CAST(SUM(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity
                   FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF}' GROUP BY 1, 2)""",
    f"""ol_log AS (SELECT {SEQ} AS seq, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'I' END AS op,
                         l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity
                  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUTOFF}')""",
    """ol_last AS (SELECT * FROM (
                    SELECT *, row_number() OVER (PARTITION BY order_id, product_id
                                                 ORDER BY seq DESC, quantity DESC, op DESC) AS rn
                    FROM ol_log) WHERE rn = 1)""",
    """ol_final AS (SELECT b.order_id, b.product_id, b.quantity FROM ol_base b
                   WHERE NOT EXISTS (SELECT 1 FROM ol_last l
                                     WHERE l.order_id = b.order_id AND l.product_id = b.product_id)
                   UNION ALL
                   SELECT order_id, product_id, quantity FROM ol_last WHERE op <> 'D')""",
)

APPLY_CHANGES = with_pos(*CHANGE_CTES, body="SELECT order_id, product_id, quantity FROM ol_final")

BUYERS_REFRESH = product_buyers_sql(*CHANGE_CTES, orderline="ol_final")

TABLE_DIFF = with_pos(*CHANGE_CTES, body="""
SELECT order_id, product_id, quantity, 'missing' AS side
FROM (SELECT * FROM ol_base EXCEPT ALL SELECT * FROM ol_final)
UNION ALL
SELECT order_id, product_id, quantity, 'extra' AS side
FROM (SELECT * FROM ol_final EXCEPT ALL SELECT * FROM ol_base)""")

PRICE_HISTORY_CHANGES = with_pos(f"""obs AS (
  SELECT l_partkey AS product_id, {SEQ} AS seq,
         TRY_CAST(ROUND(TRY_CAST(p_retailprice AS DECIMAL(6,2)) * (1 - TRY_CAST(l_discount AS DECIMAL(3,2))), 2)
                  AS DECIMAL(6,2)) AS newPrice,
         l_shipdate AS ts
  FROM lineitem JOIN part ON p_partkey = l_partkey)""", """w AS (
  SELECT *, lag(newPrice) OVER win AS prev, row_number() OVER win AS rn
  FROM obs WINDOW win AS (PARTITION BY product_id ORDER BY seq, newPrice))""", """h AS (
  SELECT w.product_id, w.seq, CASE WHEN w.rn = 1 THEN p.currentPrice ELSE w.prev END AS oldPrice,
         w.newPrice, w.ts
  FROM w LEFT JOIN pos_product p ON p.id = w.product_id)""", body="""
SELECT product_id, seq, CAST(oldPrice AS DOUBLE) AS oldPrice, CAST(newPrice AS DOUBLE) AS newPrice,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM h WHERE oldPrice <> newPrice""")

STREAM_PRODUCT_REPLICA = with_pos(f"""plog AS (
  SELECT {SEQ} AS seq, p_partkey AS id, p_name AS name,
         TRY_CAST(ROUND(TRY_CAST(p_retailprice AS DECIMAL(6,2)) * (1 - TRY_CAST(l_discount AS DECIMAL(3,2))), 2)
                  AS DECIMAL(6,2)) AS currentPrice,
         CAST(p_size AS INTEGER) AS availableQuantity
  FROM lineitem JOIN part ON p_partkey = l_partkey)""", """plast AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, currentPrice DESC) AS rn
                 FROM plog) WHERE rn = 1)""", body="""
SELECT p.id, COALESCE(l.name, p.name) AS name,
       CAST(CASE WHEN l.id IS NULL THEN p.currentPrice ELSE l.currentPrice END AS DOUBLE) AS currentPrice,
       COALESCE(l.availableQuantity, p.availableQuantity) AS availableQuantity
FROM pos_product p LEFT JOIN plast l ON l.id = p.id""")

# --- checks --------------------------------------------------------------------------


def _pk(table: str, source: str, cols: list[str]) -> str:
    key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
    nonnull = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    anynull = " OR ".join(f"{c} IS NULL" for c in cols)
    group = ", ".join(cols)
    return f"""
SELECT '{table}' AS "table", 'duplicate' AS kind, {key} AS key, COUNT(*) AS n
FROM {source} WHERE {nonnull} GROUP BY {group} HAVING COUNT(*) > 1
UNION ALL
SELECT '{table}', 'null key', '', COUNT(*) FROM {source} WHERE {anynull} HAVING COUNT(*) > 0"""


PK_VIOLATIONS = with_pos(body=" UNION ALL ".join([
    _pk("customer", "pos_customer", ["id"]),
    _pk("city", "pos_city", ["zip"]),
    _pk("order", "pos_order", ["id"]),
    _pk("orderline", "pos_orderline", ["order_id", "product_id"]),
    _pk("product", "pos_product", ["id"]),
    _pk("lineitem", "lineitem", ["l_orderkey", "l_linenumber"]),
]))


def _fk(name: str, child: str, ccols: list[str], parent: str, pcols: list[str]) -> str:
    key = "concat_ws('|', " + ", ".join(f"CAST(c.{c} AS VARCHAR)" for c in ccols) + ")"
    match = " AND ".join(f"p.{p} = c.{c}" for c, p in zip(ccols, pcols))
    nonnull = " AND ".join(f"c.{c} IS NOT NULL" for c in ccols)
    group = ", ".join(f"c.{c}" for c in ccols)
    return f"""
SELECT '{name}' AS "constraint", {key} AS key, COUNT(*) AS n
FROM {child} c WHERE {nonnull} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {match})
GROUP BY {group}"""


FK_VIOLATIONS = with_pos(body=" UNION ALL ".join([
    _fk("customer.zip", "pos_customer", ["zip"], "pos_city", ["zip"]),
    _fk("order.customer_id", "pos_order", ["customer_id"], "pos_customer", ["id"]),
    _fk("orderline.order_id", "pos_orderline", ["order_id"], "pos_order", ["id"]),
    _fk("orderline.product_id", "pos_orderline", ["product_id"], "pos_product", ["id"]),
]))


def _len(table: str, source: str, key: str, limits: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{col}' AS "column", CAST({key} AS VARCHAR) AS key,
                   CAST(length({col}) AS INTEGER) AS length, {limit} AS max
            FROM {source} WHERE length({col}) > {limit}"""
        for col, limit in limits.items())


FK_VIOLATIONS_INJECTED = with_pos("""broken AS (
  SELECT CASE WHEN order_id % 50 = 1 THEN -order_id ELSE order_id END AS order_id,
         CASE WHEN product_id % 40 = 1 THEN -product_id ELSE product_id END AS product_id FROM pos_orderline)""",
    body=_fk("orderline.order_id", "broken", ["order_id"], "pos_order", ["id"]) + " UNION ALL "
    + _fk("orderline.product_id", "broken", ["product_id"], "pos_product", ["id"]))


LENGTH_VIOLATIONS = with_pos(body=" UNION ALL ".join([
    _len("customer", "pos_customer", "id",
         {"firstName": 32, "lastName": 30, "email": 128, "address1": 100, "address2": 50, "phone": 32}),
    _len("city", "pos_city", "zip", {"city": 32, "state": 4}),
    _len("product", "pos_product", "id", {"name": 128}),
]))

COPY_COUNTS = with_pos(*CHANGE_CTES, body="""
SELECT 'expected' AS side, COUNT(*) AS rows FROM ol_base
UNION ALL
SELECT 'actual' AS side, COUNT(*) AS rows FROM ol_final""")


PRICE_UPDATE_DEMO = with_pos(body="""
SELECT id AS product_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS oldPrice,
       CAST(currentPrice AS DOUBLE) AS newPrice
FROM pos_product WHERE id = 3
UNION ALL
SELECT id, CAST(1 AS BIGINT), CAST(currentPrice AS DOUBLE), CAST(currentPrice + 10.00 AS DOUBLE)
FROM pos_product WHERE id = 3 AND currentPrice IS NOT NULL""")

VIEW_INSERT_DEMO = "SELECT * FROM (" + product_buyers_sql(
    """ol_demo AS (SELECT order_id, product_id, quantity FROM pos_orderline
                   WHERE NOT (order_id = 1 AND product_id = 3)
                   UNION ALL SELECT CAST(1 AS BIGINT), CAST(3 AS BIGINT), 1)""",
    orderline="ol_demo") + ") WHERE productID = 3"


CSV_LINE_BREAKS = with_pos(body="""
SELECT id, address1 || chr(10) || chr(10) || 'floor ' || CAST(id % 9 AS VARCHAR) || ', "rear"' || chr(10) AS address1, zip, 'good' AS kind
FROM pos_customer""")

BUYER_PAIRS = with_pos(body="""
SELECT DISTINCT ol.product_id, o.customer_id FROM pos_lines ol JOIN pos_order o ON o.id = ol.order_id""")

ORDER_TOTALS = with_pos(body="""
SELECT ol.order_id, any_value(o.customer_id) AS customer_id, CAST(ROUND(SUM(p.currentPrice * ol.quantity), 2) AS DOUBLE) AS OrderTotal,
       max(ol.quantity) AS most
FROM pos_orderline ol JOIN pos_product p ON p.id = ol.product_id JOIN pos_order o ON o.id = ol.order_id
GROUP BY ol.order_id""")

ZIP_FACTS = with_pos(*sales_ctes(False), body="SELECT * REPLACE (CAST(TotalSales AS DOUBLE) AS TotalSales) FROM facts")
ZIP_MONTH_FACTS = with_pos(*sales_ctes(True), body="SELECT * REPLACE (CAST(TotalSales AS DOUBLE) AS TotalSales) FROM facts")

PRICE_LOG = f"""plog AS (
  SELECT {SEQ} AS seq, p_partkey AS id, CAST(l_shipdate AS DATE) AS day,
         TRY_CAST(ROUND(TRY_CAST(p_retailprice AS DECIMAL(6,2)) * (1 - TRY_CAST(l_discount AS DECIMAL(3,2))), 2)
                  AS DECIMAL(6,2)) AS price
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

ORDER_TOTALS_AS_OF = with_pos(PRICE_LOG, """daily AS (
  SELECT id, day, arg_max(price, {'s': seq, 'p': price}) AS price FROM plog WHERE price IS NOT NULL GROUP BY id, day)""", """priced AS (
  SELECT l.order_id, l.customer_id, l.quantity * COALESCE(d.price, p.currentPrice) AS amount
  FROM (SELECT ol.*, o.customer_id, o.datePlaced FROM pos_orderline ol JOIN pos_order o ON o.id = ol.order_id) l
       JOIN pos_product p ON p.id = l.product_id
       ASOF LEFT JOIN daily d ON d.id = l.product_id AND l.datePlaced >= d.day)""", body="""
SELECT order_id, any_value(customer_id) AS customer_id, CAST(ROUND(SUM(amount), 2) AS DOUBLE) AS OrderTotal
FROM priced GROUP BY order_id""")

LAST_PRICES = """new_product AS (
  SELECT p.id, p.name, COALESCE(l.price, p.currentPrice) AS currentPrice
  FROM pos_product p LEFT JOIN (SELECT id, arg_max(price, {'s': seq, 'p': price}) AS price FROM plog GROUP BY id) l ON l.id = p.id)"""


def facts_after_sql(with_month: bool) -> str:
    return with_pos(*CHANGE_CTES, PRICE_LOG, LAST_PRICES, *sales_ctes(with_month, "ol_final", "new_product"),
                    body="SELECT * REPLACE (CAST(TotalSales AS DOUBLE) AS TotalSales) FROM facts")


FK_VIOLATIONS_AFTER_LOG = with_pos(
    *(c.replace("l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity",
                "CASE WHEN l_partkey % 37 = 5 THEN -l_partkey ELSE l_partkey END AS product_id, CAST(l_quantity AS INTEGER) AS quantity")
      for c in CHANGE_CTES),
    """new_product AS (SELECT id FROM pos_product WHERE id % 40 <> 1 UNION ALL SELECT -id FROM pos_product WHERE id % 74 = 5)""",
    body=_fk("orderline.product_id", "ol_final", ["product_id"], "new_product", ["id"]))


ETL_TABLES = f"""
WITH c AS ({CLEAN_CUSTOMERS}), z AS ({CITIES}), o AS ({CLEAN_ORDERS}), l AS ({CSV_ORDER_LINES}),
     p AS ({CLEAN_PRODUCTS}), h AS ({PRICE_HISTORY_INITIAL}), v AS ({PRODUCT_BUYERS})
SELECT 'customer' AS source, CAST(id AS VARCHAR) AS key,
       concat_ws('|', firstName, lastName, email, address1, address2, phone, birthdate, zip) AS value FROM c
UNION ALL SELECT 'city', zip, concat_ws('|', city, state) FROM z
UNION ALL SELECT 'order', CAST(id AS VARCHAR), concat_ws('|', datePlaced, dateShipped, customer_id) FROM o
UNION ALL SELECT 'orderline', concat_ws(':', order_id, product_id), CAST(quantity AS VARCHAR) FROM l
UNION ALL SELECT 'product', CAST(id AS VARCHAR),
       concat_ws('|', name, CAST(round(currentPrice * 100) AS BIGINT), availableQuantity) FROM p
UNION ALL SELECT 'price_history', CAST(product_id AS VARCHAR),
       concat_ws('|', CAST(round(oldPrice * 100) AS BIGINT), CAST(round(newPrice * 100) AS BIGINT)) FROM h
UNION ALL SELECT 'mv_ProductBuyers', CAST(productID AS VARCHAR), concat_ws('|', productName, customers) FROM v
"""

REPORT_FILES = f"""
SELECT 'q1' AS report, CAST(CustomerID AS VARCHAR) AS key, CAST(doc AS VARCHAR) AS value FROM ({CUSTOMERS_IN_STATE})
UNION ALL SELECT 'q2', CAST(CustomerID AS VARCHAR),
       concat_ws('|', CustomerName, CAST(round(totalOrderCost * 100) AS BIGINT)) FROM ({VIP_CUSTOMERS})
UNION ALL SELECT 'q3', CAST(ProductID AS VARCHAR), concat_ws('|', ProductName, CAST(ProductBuyers AS VARCHAR)) FROM ({PRODUCT_RECALL})
UNION ALL SELECT 'q4', CAST(CustomerID AS VARCHAR), CAST(doc AS VARCHAR) FROM ({ORDER_ANOMALIES})
UNION ALL SELECT 'q5', CAST(ProductID AS VARCHAR), concat_ws('|', ProductName, TotalStatePurchases) FROM ({STATE_TOP_PRODUCTS})
UNION ALL SELECT 'q6', CAST(ProductID AS VARCHAR), concat_ws('|', ProductName, TotalStatePurchases, "rank") FROM ({STATE_MONTH_PRODUCTS})
"""

SQL: dict[str, str] = {
    "csv_one_file": CSV_ORDER_LINES,
    "csv_line_breaks": CSV_LINE_BREAKS,
    "buyer_pairs": BUYER_PAIRS,
    "order_totals": ORDER_TOTALS,
    "order_totals_as_of": ORDER_TOTALS_AS_OF,
    "zip_facts": ZIP_FACTS,
    "zip_month_facts": ZIP_MONTH_FACTS,
    "buyers_by_counts": BUYERS_REFRESH,
    "price_history_stream": PRICE_HISTORY_CHANGES,
    "zip_facts_after_log": facts_after_sql(False),
    "zip_month_facts_after_log": facts_after_sql(True),
    "fk_violations_after_log": FK_VIOLATIONS_AFTER_LOG,
    "product_buyers": PRODUCT_BUYERS,
    "product_buyers_sql": product_buyers_sql(),
    "order_lines": ORDER_LINES,
    "clean_customers": CLEAN_CUSTOMERS,
    "clean_orders": CLEAN_ORDERS,
    "clean_products": CLEAN_PRODUCTS,
    "cities": CITIES,
    "csv_customers": CLEAN_CUSTOMERS,
    "csv_orders": CLEAN_ORDERS,
    "csv_rejects": CSV_REJECTS,
    "csv_products": CLEAN_PRODUCTS,
    "product_buyers_week": PRODUCT_BUYERS_WEEK,
    "cust_docs_week": CUST_DOCS_WEEK,
    "report_files": REPORT_FILES,
    "published_customers_in_state": CUSTOMERS_IN_STATE,
    "published_vip_customers": VIP_CUSTOMERS,
    "published_product_recall": PRODUCT_RECALL,
    "published_order_anomalies": ORDER_ANOMALIES,
    "published_state_top_products": STATE_TOP_PRODUCTS,
    "published_state_month_products": STATE_MONTH_PRODUCTS,
    "fk_violations_injected": FK_VIOLATIONS_INJECTED,
    "csv_order_lines": CSV_ORDER_LINES,
    "etl_tables": ETL_TABLES,
    "price_history_initial": PRICE_HISTORY_INITIAL,
    "prod_docs": PROD_DOCS,
    "cust_docs": CUST_DOCS,
    "zip_popularity": ZIP_POPULARITY,
    "state_month_popularity": STATE_MONTH_POPULARITY,
    "customers_in_state": CUSTOMERS_IN_STATE,
    "vip_customers": VIP_CUSTOMERS,
    "product_recall": PRODUCT_RECALL,
    "order_anomalies": ORDER_ANOMALIES,
    "state_top_products": STATE_TOP_PRODUCTS,
    "state_month_products": STATE_MONTH_PRODUCTS,
    "state_top_products_docs": STATE_TOP_PRODUCTS,
    "state_month_products_docs": STATE_MONTH_PRODUCTS,
    "apply_changes": APPLY_CHANGES,
    "price_history_changes": PRICE_HISTORY_CHANGES,
    "buyers_refresh": BUYERS_REFRESH,
    "stream_refresh": BUYERS_REFRESH,
    "stream_product_replica": STREAM_PRODUCT_REPLICA,
    "pk_violations": PK_VIOLATIONS,
    "fk_violations": FK_VIOLATIONS,
    "table_diff": TABLE_DIFF,
    "table_diff_digests": TABLE_DIFF,
    "length_violations": LENGTH_VIOLATIONS,
    "copy_counts": COPY_COUNTS,
    "price_update_demo": PRICE_UPDATE_DEMO,
    "view_insert_demo": VIEW_INSERT_DEMO,
}
