"""Purchase orders: text to line items, summed per item and revision in order of first appearance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchored_name, blank_sentinel, capture, number_before, strip
from ..sinks import number_text


@dataclass(frozen=True)
class Labels:
    """The words that stand after the values in a text (before them for ``anchor``); patterns may be used."""

    number: str = "order no"
    buyer: str = "buyer name"
    lines: str = "declared lines"
    line: str = "line no"
    sku: str = "supplier item"
    quantity: str = "required quantity"
    revision: str = ":revision"
    anchor: str = "general terms"
    customers: list[tuple[str, str]] = field(default_factory=lambda: [("ACME AVIONICS", "Acme Avionics Ltd"), ("ACME", "Acme Ltd"), ("NORTHWIND", "Northwind Traders")])


#: What a value that stands before a label is made of.
SHAPES = {
    "count": "[0-9]+",
    "item": r"[\w./-]+",  # a supplier's item number
    "code": "[0-9A-Za-z-]+",  # a revision
    "line": "[^\n]+?",  # all of a line up to the label
}


def value_before(text: Column, label: str, shape: str, gap: str = " ") -> Column:
    """The first value of a shape that stands right before a label, NULL without one."""
    return capture(text, f"(?U)({SHAPES[shape]}){gap}{label}")


def chunks(texts: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """doc_id, line_ord, chunk: the text after each line label, from 1; what stands before the first is the header."""
    parts = texts.select("doc_id", F.posexplode(F.split("text", labels.line, -1)).alias("line_ord", "chunk"))
    return parts.where("line_ord > 0")


def line_items(texts: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """doc_id, line_ord, sku, qty, revision (NULL if missing) of chunks that have both an item and a quantity."""
    parts = chunks(texts, labels).select(
        "doc_id",
        "line_ord",
        value_before(F.col("chunk"), labels.sku, "item").alias("sku"),
        number_before(F.col("chunk"), labels.quantity).alias("qty"),
        value_before(F.col("chunk"), labels.revision, "code", gap="").alias("revision"),
    )
    return parts.where("sku IS NOT NULL AND qty IS NOT NULL")


def headers(texts: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """doc_id, number, buyer, declared, customer; NULL where missing."""
    text = F.col("text")
    return texts.select(
        "doc_id",
        value_before(text, labels.number, "count").alias("number"),
        strip(value_before(text, labels.buyer, "line")).alias("buyer"),
        value_before(text, labels.lines, "count").cast("long").alias("declared"),
        anchored_name(text, labels.anchor, labels.customers).alias("customer"),
    )


def recognised(heads: DataFrame, items: DataFrame) -> DataFrame:
    """``heads`` with n_lines and needs_fallback: without a number, buyer or line, or with another count of lines than declared."""
    counts = items.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    joined = heads.join(counts, "doc_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    good = F.col("number").isNotNull() & F.col("buyer").isNotNull() & (F.col("n_lines") > 0) & (F.col("n_lines") == F.coalesce("declared", "n_lines"))
    return joined.withColumn("needs_fallback", ~good)


def inherit_last_revision(items: DataFrame) -> DataFrame:
    """A document's last item without a revision takes the first one that an earlier item of its sku has."""
    last = F.max("line_ord").over(Window.partitionBy("doc_id"))
    earlier = Window.partitionBy("doc_id", "sku").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, -1)
    inherited = F.first("revision", ignorenulls=True).over(earlier)
    return items.withColumn("revision", F.when(F.col("line_ord") == last, F.coalesce("revision", inherited)).otherwise(F.col("revision")))


def summed(items: DataFrame) -> DataFrame:
    """doc_id, no, sku, qty, revision ('' if missing): sums per sku and revision, numbered by first appearance."""
    groups = items.groupBy("doc_id", "sku", F.coalesce("revision", F.lit("")).alias("revision")).agg(F.sum("qty").alias("qty"), F.min("line_ord").alias("first"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long")
    return groups.select("doc_id", number.alias("no"), "sku", "qty", "revision")


def orders(texts: DataFrame, labels: Labels = Labels(), fallback=None) -> tuple[DataFrame, DataFrame]:
    """(rows, rest): the seven columns per order, and the headers of texts that weren't recognised.

    ``fallback`` may turn texts (doc_id, text) into (heads, items) of the same columns as ``headers`` and ``line_items``.
    """
    heads, items = recognised(headers(texts, labels), found := line_items(texts, labels)), found
    good = heads.where("NOT needs_fallback")
    rest = heads.where("needs_fallback")
    if fallback is not None:
        more_heads, more_items = fallback(texts.join(rest.select("doc_id"), "doc_id", "left_semi"))
        good = good.select("doc_id", "number", "buyer", "customer").unionByName(more_heads.select("doc_id", "number", "buyer", "customer"))
        items = items.join(rest.select("doc_id"), "doc_id", "left_anti").unionByName(more_items)
    rows = summed(inherit_last_revision(items))
    named = rows.join(good.select("doc_id", "number", F.coalesce("customer", F.lit("")).alias("customer"), "buyer"), "doc_id")
    return named.select("doc_id", "no", "sku", "qty", "revision", "number", "customer", "buyer"), rest


#: Labels of the three lines above an exported order, and of its columns.
EXPORT_HEAD = {"number": "order no", "customer": "customer", "buyer": "to"}
EXPORT_COLUMNS = {"sku": "supplier item", "qty": "required quantity", "revision": "revision"}


def export_lines(heads: DataFrame, items: DataFrame, sentinel: str = "-", head: dict[str, str] = EXPORT_HEAD, columns: dict[str, str] = EXPORT_COLUMNS) -> DataFrame:
    """doc_id, line_no, line: the text of each order for ``write_documents``: labelled head, empty line, columns, one line per item as it was read.

    The head's lines end with line feeds, the others as the writer ends them. A revision that is missing, or the ``sentinel``
    for a missing one, is left empty. Orders without items have no lines.
    """
    labelled = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c, label in head.items()])
    top = heads.join(items.select("doc_id").distinct(), "doc_id", "left_semi")
    top = top.select("doc_id", F.lit(0).alias("line_no"), F.concat(labelled, F.lit("\n\n" + "\t".join(columns.values()))).alias("line"))
    shown = items.withColumn("qty", number_text(F.col("qty"))).withColumn("revision", F.coalesce(blank_sentinel(F.col("revision"), sentinel), F.lit("")))
    cells = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return top.unionByName(shown.select("doc_id", F.col("line_ord").cast("int").alias("line_no"), cells.alias("line")))
