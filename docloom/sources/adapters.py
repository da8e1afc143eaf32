"""The boundary to decoders of file formats: bytes to pages, characters or cells, by a lateral join with a table function.

A decoder is a function from bytes to rows (tuples); which library it calls is its own business, so none
is needed here. It runs where the bytes are, once for each file; a file that it refuses is a row with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

#: What the decoders of pages, of positioned characters and of sheets give for each row.
PAGES = "page int, text string"
CHARS = "page int, ord int, text string, x0 double, top double, size double"
CELLS = "row_idx int, cells array<string>"

Decoder = Callable[[bytes], Iterable[tuple]]


def decoded(files: DataFrame, decoder: Decoder, schema: str, content: str = "content") -> DataFrame:
    """``files`` without ``content``, with the rows of ``schema`` that ``decoder`` gives for it, and decode_error.

    All rows of a file or none: where the decoder raises, the file has one row with its message. A file without rows,
    like one without content (NULL), has one row of NULLs, so that no file is lost.
    """
    width = len(StructType.fromDDL(schema))

    @udtf(returnType=f"{schema}, decode_error string")
    class Rows:
        def eval(self, raw: bytes):
            nothing = (None,) * width
            try:
                found = [tuple(row) for row in decoder(bytes(raw))] if raw is not None else []
            except Exception as error:  # a bad file never fails the job
                yield (*nothing, str(error) or type(error).__name__)
                return
            if not found:
                yield (*nothing, None)
            for row in found:
                yield (*row, None)

    joined = files.lateralJoin(Rows(F.col(content).outer()))
    return joined.drop(content)


def page_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): a file's pages in order, each under a line that numbers it from 1, blank lines between."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("page"))
    marked = F.concat(F.lit("--- Page "), number, F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    gathered = pages.select(key, number.alias("no"), marked.alias("t")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "t"))).alias("p"))
    return gathered.select(key, F.array_join(F.transform("p", lambda p: p["t"]), "\n\n").alias("text"))


def separated_cells(separator: str = "\t", charset: str = "utf-8") -> Decoder:
    """A decoder of plain tables: lines of cells; ValueError for other bytes."""

    def rows(raw: bytes) -> list[tuple]:
        try:
            text = raw.decode(charset)
        except UnicodeDecodeError as error:
            raise ValueError("unreadable sheet") from error
        return [(i, line.split(separator)) for i, line in enumerate(text.splitlines())]

    return rows


def form_feed_pages(charset: str = "utf-8") -> Decoder:
    """A decoder of plain text whose pages end with form feeds; ValueError for other bytes."""

    def rows(raw: bytes) -> list[tuple]:
        try:
            return list(enumerate(raw.decode(charset).split("\f")))
        except UnicodeDecodeError as error:
            raise ValueError("unreadable text") from error

    return rows


def grid_chars(width: float = 5.0, height: float = 10.0, charset: str = "utf-8") -> Decoder:
    """A decoder of plain text to positioned characters, in a grid of ``width`` by ``height``; pages end with form feeds."""

    def rows(raw: bytes) -> list[tuple]:
        out = []
        for page, text in form_feed_pages(charset)(raw):
            places = [(c, x, y) for y, line in enumerate(text.split("\n")) for x, c in enumerate(line) if not c.isspace()]
            out += [(page, i, c, x * width, y * height, height) for i, (c, x, y) in enumerate(places)]
        return out

    return rows
