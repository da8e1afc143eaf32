"""Sinks: tab and comma separated bodies, charsets, base64, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import safe_cell


def number_text(value: Column) -> Column:
    """A double as text the way Python writes it for quantities: 36.0, 1495.25, 10000000.0."""
    whole = value == F.floor(value)
    return F.when(whole, F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(
        F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", "")
    )


def tsv_line(cells: list[Column]) -> Column:
    """A line of tab-separated cells without quoting, CRLF behind it, NULL as an empty cell."""
    return F.concat(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit("\r\n"))


def tsv_body(rows: DataFrame, key: str, order: str, columns: dict[str, str], safe: bool = False) -> DataFrame:
    """One text body per key: a header of the column labels, rows in order, tabs, CRLF after every line, no quoting.

    Rows of a key are gathered in one cell: a key is one document, whose size is bounded.
    """
    cells = [safe_cell(F.col(c).cast("string")) if safe else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    lines = rows.select(key, F.struct(F.col(order).alias("o"), F.concat_ws("\t", *cells).alias("line")).alias("row"))
    gathered = lines.groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head = "\t".join(columns.values())
    return gathered.select(key, F.concat(F.lit(head + "\r\n"), F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit("\r\n"))), "")).alias("body"))


def quoted_csv_line(columns: list[str]) -> Column:
    """A comma-separated line with every field in quotes, quotes doubled, NULL as an empty field."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat(F.concat_ws(",", *quoted), F.lit("\r\n"))


def base64_text(raw: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(raw), r"[\r\n]", "")


def utf8_with_mark(text: Column) -> Column:
    """UTF-8 bytes with a byte order mark."""
    return F.encode(F.concat(F.lit("﻿"), text), "utf-8")


def use_legacy_charsets(spark: SparkSession) -> None:
    """Lets ``encode`` and the CSV writer take windows-1255, with ? for what it doesn't have."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def write_tsv(rows: DataFrame, path: str, charset: str = "windows-1255") -> None:
    """Rows of strings as files without quoting, tab-separated, CRLF, with a header line in each."""
    use_legacy_charsets(rows.sparkSession)
    options = {"sep": "\t", "quote": "", "lineSep": "\r\n", "header": True, "emptyValue": "", "nullValue": "", "encoding": charset}
    rows.write.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as files with every field quoted."""
    rows.write.options(quoteAll=True, escape='"', lineSep="\r\n", header=True, emptyValue="", nullValue="").csv(path)


def csv_body(rows: DataFrame, key: str, order: str, columns: dict[str, str]) -> DataFrame:
    """One text body per key: a header of the column labels and rows in order, every field in quotes, CRLF after every line.

    A label without a column of that name in ``rows`` stays empty in all rows. A key is one document, whose size is bounded.
    """
    cells = rows.select(key, F.col(order).alias("_o"), *[F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])
    lines = cells.select(key, F.struct(F.col("_o").alias("o"), quoted_csv_line(list(columns)).alias("line")).alias("row"))
    gathered = lines.groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head = ",".join('"' + label.replace('"', '""') + '"' for label in columns.values()) + "\r\n"
    return gathered.select(key, F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "")).alias("body"))


def write_documents(lines: DataFrame, path: str, key: str, order: list[str], line: str = "line", charset: str = "utf-8", mark: bool = False) -> None:
    """One file per key below ``path``, in a folder ``key=value``: its lines in order, each ended by CRLF.

    Lines are dealt by key and sorted, so a file is written as it streams by and no document is gathered in one
    cell. A line may hold line feeds of its own. ``mark`` puts a byte order mark before the first line; a ``charset``
    other than UTF-8 writes ? for what it doesn't have.
    """
    use_legacy_charsets(lines.sparkSession)
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    text = F.concat(F.when(first & F.lit(mark), "\ufeff").otherwise(""), F.coalesce(F.col(line), F.lit("")))
    raw = F.encode(text, charset).cast("string")  # the bytes as they are: the text writer passes them on
    # By a hash of our own: Spark drops a shuffle by the key that a union or join below has been dealt by, and may split that one.
    dealt = lines.repartition(F.xxhash64(key)).select(key, *order, raw.alias("value")).sortWithinPartitions(key, *order)
    dealt.select(key, "value").write.partitionBy(key).option("lineSep", "\r\n").text(path)
