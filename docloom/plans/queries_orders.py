"""Queries over rendered purchase orders and exports, with their oracles: the rows that the texts were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import safe_cell, stem_with, thousands
from ..sinks import base64_text, number_text, quoted_csv_line, tsv_body, utf8_with_mark
from ..sources.derived import ORDER_LINES_SQL, order_texts
from . import orders as O

_WITH = f"""
WITH lines AS ({ORDER_LINES_SQL}), counts AS (
  SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id
), heads AS (
  SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS number, c_name AS buyer, n AS n_lines,
    CASE WHEN o_orderkey % 7 = 3 THEN NULL WHEN o_orderkey % 11 = 0 THEN n + 1 ELSE n END AS declared,
    CASE WHEN o_orderkey % 3 <> 0 THEN NULL WHEN o_orderkey % 2 = 0 AND contains(upper(c_mktsegment || ' c/o Acme Avionics plant'), 'ACME AVIONICS') THEN 'Acme Avionics Ltd' ELSE 'Acme Ltd' END AS customer
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN counts ON doc_id = o_orderkey
), filled AS (
  SELECT doc_id, line_ord, sku, qty, CASE WHEN line_ord < max(line_ord) OVER (PARTITION BY doc_id) THEN revision ELSE
    coalesce(revision, first_value(revision IGNORE NULLS) OVER (PARTITION BY doc_id, sku ORDER BY line_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS revision
  FROM lines
), sums AS (
  SELECT doc_id, sku, coalesce(revision, '') AS revision, sum(qty) AS qty, min(line_ord) AS f FROM filled GROUP BY ALL
), final AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS no, sku, qty, revision, number, coalesce(customer, '') AS customer, buyer
  FROM sums JOIN heads USING (doc_id) WHERE coalesce(declared, n_lines) = n_lines
)
"""


def _rows(spark, sf):
    return O.orders(order_texts(spark, sf))[0]


def purchase_orders(spark, sf):
    """The whole pipeline: seven columns per order line."""
    return _rows(spark, sf)


def blm_chunks(spark, sf):
    return O.chunks(order_texts(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("line_ord").cast("long").alias("last"))


def blm_fields(spark, sf):
    return O.line_items(order_texts(spark, sf)).select("doc_id", F.col("line_ord").cast("long").alias("line_ord"), "sku", "qty", "revision")


def blm_headers(spark, sf):
    return O.headers(order_texts(spark, sf)).select("doc_id", "number", "buyer", F.coalesce("declared", F.lit(0)).alias("declared"))


def blm_recognised(spark, sf):
    texts = order_texts(spark, sf)
    return O.recognised(O.headers(texts), O.line_items(texts)).select("doc_id", "n_lines", "needs_fallback")


def blm_inherit_revision(spark, sf):
    items = O.inherit_last_revision(O.line_items(order_texts(spark, sf)))
    return items.select("doc_id", F.col("line_ord").cast("long").alias("line_ord"), "revision")


def blm_aggregate(spark, sf):
    return O.summed(O.line_items(order_texts(spark, sf)))


def blm_customer(spark, sf):
    return O.headers(order_texts(spark, sf)).select("doc_id", "customer")


def blm_thousands(spark, sf):
    """Totals with thousands commas, every fifth with a comma where none may be."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").cast("double").alias("price"))
    text = F.format_number("price", 2)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit(",1"))).otherwise(text)
    return orders.select("doc_id", thousands(text).alias("value"))


def tsv_body_query(spark, sf):
    rows = _rows(spark, sf).withColumn("qty_text", number_text(F.col("qty")))
    return tsv_body(rows, "doc_id", "no", {"no": "No", "sku": "Item", "qty_text": "Quantity", "revision": "Rev", "number": "Order", "customer": "Customer", "buyer": "  To"})


def csv_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/conversations.parquet")
    docs = docs.withColumn("said", F.concat(F.lit('"'), F.col("role"), F.lit('", ')))
    return docs.select("conv_id", "turn", quoted_csv_line(["turn", "said", "text"]).alias("line"))


def tsv_cells_safe(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mark = F.element_at(F.array(*[F.lit(x) for x in ("=", " +", "@", "", "-", "\t")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select("doc_id", safe_cell(F.concat(mark, F.col("text"))).alias("cell"))


def export_payload(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", base64_text(utf8_with_mark(F.col("html"))).alias("payload"))


def export_names(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    name = F.when(F.col("page_id") % 9 == 0, F.lit(None).cast("string")).otherwise(F.regexp_extract("url", "([^/]*)$", 1))
    return pages.select("page_id", stem_with(name, "_fai.csv", "drawing").alias("name"))


def order_json(spark, sf):
    rows = _rows(spark, sf)
    return rows.select("doc_id", "no", F.to_json(F.struct("sku", "revision", "buyer")).alias("json"))


QUERIES = {
    "purchase_orders": purchase_orders, "blm_chunks": blm_chunks, "blm_fields": blm_fields, "blm_headers": blm_headers, "blm_thousands": blm_thousands,
    "blm_recognised": blm_recognised, "blm_inherit_revision": blm_inherit_revision, "blm_aggregate": blm_aggregate, "blm_customer": blm_customer,
    "tsv_body": tsv_body_query, "csv_lines": csv_lines, "tsv_cells_safe": tsv_cells_safe, "export_payload": export_payload, "export_names": export_names, "order_json": order_json,
}

ORACLES = {
    "purchase_orders": _WITH + "SELECT * FROM final",
    "blm_chunks": _WITH + "SELECT doc_id, n AS n_chunks, n AS last FROM counts JOIN heads USING (doc_id)",
    "blm_fields": _WITH + "SELECT doc_id, line_ord::BIGINT AS line_ord, sku, qty, revision FROM lines JOIN heads USING (doc_id)",
    "blm_headers": _WITH + "SELECT doc_id, number, buyer, coalesce(declared, 0) AS declared FROM heads",
    "blm_recognised": _WITH + "SELECT doc_id, n_lines, coalesce(declared, n_lines) <> n_lines AS needs_fallback FROM heads",
    "blm_inherit_revision": _WITH + "SELECT doc_id, line_ord::BIGINT AS line_ord, revision FROM filled JOIN heads USING (doc_id)",
    "blm_aggregate": _WITH + """, plain AS (SELECT doc_id, sku, coalesce(revision, '') AS revision, sum(qty) AS qty, min(line_ord) AS f FROM lines JOIN heads USING (doc_id) GROUP BY ALL)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS no, sku, qty, revision FROM plain""",
    "blm_customer": _WITH + "SELECT doc_id, customer FROM heads",
    "blm_thousands": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice)::DOUBLE END AS value FROM orders",
    "tsv_body": _WITH + r"""SELECT doc_id, 'No' || chr(9) || 'Item' || chr(9) || 'Quantity' || chr(9) || 'Rev' || chr(9) || 'Order' || chr(9) || 'Customer' || chr(9) || '  To' || chr(13) || chr(10) ||
        string_agg(concat_ws(chr(9), no, sku, qty, revision, number, customer, buyer) || chr(13) || chr(10), '' ORDER BY no) AS body FROM final GROUP BY doc_id""",
    "csv_lines": r"""SELECT conv_id, turn, concat(chr(34), turn, chr(34), ',', chr(34), chr(34), chr(34), role, chr(34), chr(34), ', ', chr(34), ',', chr(34), replace(text, chr(34), chr(34) || chr(34)), chr(34), chr(13), chr(10)) AS line FROM conversations""",
    "tsv_cells_safe": """WITH c AS (SELECT doc_id, translate((['=', ' +', '@', '', '-', chr(9)])[doc_id % 6 + 1] || text, chr(9) || chr(13) || chr(10), '   ') AS cell FROM documents)
        SELECT doc_id, CASE WHEN ltrim(cell)[1] IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM c""",
    "export_payload": "SELECT page_id, base64(encode(chr(65279) || html)) AS payload FROM pages",
    "export_names": r"SELECT page_id, regexp_replace(CASE WHEN page_id % 9 = 0 OR url LIKE '%/' THEN 'drawing' ELSE string_split(url, '/')[-1] END, '\.[^.]*$', '') || '_fai.csv' AS name FROM pages",
    "order_json": _WITH + """SELECT doc_id, no, '{"sku":"' || sku || '","revision":"' || revision || '","buyer":"' || buyer || '"}' AS json FROM final""",
}
