"""Document relations rendered from the star-schema tables, so that every pipeline runs on data of any size.

The *_SQL texts are plain SQL that Spark and other engines read alike; placeholders are table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kept import kept

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Line items with an ordinal inside their order: line numbers repeat, whole rows don't.
LINES_SQL = """
SELECT l_orderkey AS doc_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS ord,
       l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS INT) AS q, CAST(l_linenumber AS INT) AS line
FROM lineitem
"""

#: What the rendered purchase orders hold: the truth that parsing must give back.
ORDER_LINES_SQL = f"""
SELECT doc_id, ord AS line_ord, concat('S-', CAST(part % 17 AS VARCHAR(10)), '/', CAST(supp % 3 AS VARCHAR(10))) AS sku,
       CAST(q * (1 + part % 97) AS DOUBLE) AS qty,
       CASE WHEN (part + ord) % 3 = 0 THEN NULL ELSE concat('R', CAST(part % 2 AS VARCHAR(10))) END AS revision
FROM ({LINES_SQL}) AS lines
"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of LINES_SQL, dealt by doc_id under that name, so that what is grouped by documents and more moves no more."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "doc_id")
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    columns = {"ord": F.row_number().over(order), "part": F.col("l_partkey"), "supp": F.col("l_suppkey"), "q": F.col("l_quantity").cast("int"), "line": F.col("l_linenumber").cast("int")}
    return lines.select("doc_id", *[c.alias(name) for name, c in columns.items()])


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables of a data folder. Lines that it reads several times are numbered once and written in the shared folder."""
    if sql == LINES_SQL:
        return numbered_lines(spark, sf_dir)
    lines, uses = {}, sql.count(f"({LINES_SQL})")
    if uses:
        once = numbered_lines(spark, sf_dir)
        lines["lines_once"] = kept(once, "lines") if uses > 1 else once
        sql = sql.replace(f"({LINES_SQL})", "{lines_once}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}\n" in sql + "\n" or f" {t} " in sql}
    for name, df in frames.items():
        sql = sql.replace(f"FROM {name}\n", f"FROM {{{name}}}\n").replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **frames, **lines)


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: one purchase order per order, each value followed by its label.

    Every eleventh order declares a line too many, some declare none; a third have terms with the customer's block.
    """
    lines = relation(spark, sf_dir, ORDER_LINES_SQL)
    line = F.concat(
        F.col("line_ord"), F.lit(" line no\n"), F.col("sku"), F.lit(" supplier item\n"), F.format_number("qty", 2), F.lit(" required quantity\n"),
        F.when(F.col("revision").isNotNull(), F.concat("revision", F.lit(":revision\n"))).otherwise(""),
    )
    body = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_ord", line.alias("t")))).alias("lines"))
    body = body.select("doc_id", F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["t"]), "").alias("body"))
    heads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("cust"))
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("cust"), "c_name", "c_mktsegment")
    full = heads.join(names, "cust").join(body, "doc_id")
    declared = F.when(F.col("doc_id") % 7 == 3, "").otherwise(F.concat((F.col("n") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("string"), F.lit(" declared lines\n")))
    block = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("general terms\n\n  "), F.col("c_mktsegment"), F.lit("\nc/o Acme\n"), F.when(F.col("doc_id") % 2 == 0, "Avionics plant\n").otherwise("x\n"))).otherwise("")
    text = F.concat(F.col("doc_id"), F.lit(" order no\n"), F.col("c_name"), F.lit(" buyer name\n"), declared, F.col("body"), block)
    return full.select("doc_id", text.alias("text"))
