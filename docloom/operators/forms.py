"""Whole documents of quotation forms, read a batch at once: words, characters of fonts without Unicode, font maps.

The batches are what a task holds of documents that lie next to one another (``pages.in_order``), so a document's pages, its
deliveries, cells, buyer and date need no shuffle, no join and no written table. What is found is what ``bands``, ``glyphs`` and
``plans.quotations`` find by joins of tables of words and characters.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import SPACES
from .formpages import END, Sorted, bisected, said_by

_CLEAN = r"\A[\x20-\x7E\x{2212}]+" + END
DATE = re.compile(r"\d{2}/\d{2}/\d{4}", re.ASCII)
_SPACE = re.compile(f"[{re.escape(SPACES)}]+")


def _floats(array: pa.Array) -> np.ndarray:
    return array.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _take(array: pa.Array, at: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    return array.take(pa.array(at, pa.int64(), mask=missing))


def clean(words: pa.RecordBatch) -> pa.RecordBatch:
    """``bands.clean_words`` of a batch."""
    words = words.filter(pc.greater(words.column("size"), 0))
    return words.filter(pc.match_substring_regex(words.column("text"), _CLEAN))


def _expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): all places of ranges, and the range of each."""
    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) + np.repeat(start - (np.cumsum(count) - count), count)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by the keys begin another run."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _joined(texts: pa.Array, starts: np.ndarray) -> pa.Array:
    """The texts of each run as one, NULL with a NULL."""
    runs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(texts)), pa.int32()), texts)
    return pc.binary_join(runs, "")


class _Fonts:
    """Font maps of numbered pages, by page, code, font and glyph."""

    def __init__(self, page: np.ndarray, maps: pa.RecordBatch):
        code, font = (maps.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("code", "font_id"))
        order = pc.sort_indices(pa.table([pa.array(page), pa.array(code), pa.array(font), maps.column("glyph")], list("pcfg")), sort_keys=[(k, "ascending") for k in "pcfg"]).to_numpy()
        self.page, self.font, self.glyph = page[order], font[order], maps.column("glyph").take(pa.array(order))
        self.key = (self.page << 32) + code[order]

    def letters(self, page: np.ndarray, code: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(character, entry) for each entry of a character's page with its code; a character without a code has none."""
        key = (page << 32) + pc.fill_null(code, 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        start = np.searchsorted(self.key, key)
        count = np.where(code.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(self.key, key, "right") - start, 0)
        return _expanded(start, count)


class Forms:
    """What the documents of a batch of ``words`` say. doc_ids: all of them; doc and number of each page with clean words; rows: a row per part and delivery.

    Columns of the rows, in the documents' order (pages, then parts, then quantities): page (its place in the batch), part_ord, part_no, qty_ord, quantity, qty_top, weeks, has_marker, choice.
    """

    def __init__(self, words: pa.RecordBatch, domain: str, form, prefix: str = "FAI "):
        self.form = form
        self.doc_ids = np.unique(words.column("doc_id").to_numpy())
        words = clean(words)
        pages = words.column("page").to_numpy().astype(np.int64)
        self._least, self._span = (int(pages.min()), int(pages.max() - pages.min()) + 1) if len(pages) else (0, 1)
        self._keys, page = np.unique(self._key(words)[0], return_inverse=True)
        self.doc, self.page = self._keys // self._span, self._keys % self._span + self._least
        columns = ["ord", "text", "x0", "x1", "top"]
        words = pa.StructArray.from_arrays([words.column(c) for c in columns], columns)
        self.parts, self.numbers, self.mails, _ = said_by(words, page, len(self._keys), domain, form)

        parts, of_part = self.parts.flatten(), np.repeat(np.arange(len(self._keys)), pc.list_value_length(self.parts).to_numpy())
        self.part_page, self.part_no, lists = of_part, parts.field("part_no"), parts.field("deliveries")
        found, owner = lists.flatten(), np.repeat(np.arange(len(parts)), pc.list_value_length(lists).to_numpy())
        self.sold = np.zeros(len(parts), bool)
        self.sold[owner] = True
        order = np.lexsort((found.field("qty_ord").to_numpy(zero_copy_only=False), found.field("qty_top").to_numpy(zero_copy_only=False), owner))
        owner, found = owner[order], found.take(pa.array(order))
        digit = found.field("digit")
        choice = pc.if_else(pc.is_in(digit, pa.array(["1", "2", "3"])), pc.binary_join_element_wise(prefix, digit, ""), None)
        self.rows = pa.RecordBatch.from_arrays(
            [pa.array(of_part[owner], pa.int64()), _take(parts.field("part_ord"), owner), _take(self.part_no, owner), *[found.field(c) for c in ("qty_ord", "quantity", "qty_top", "weeks", "has_marker")], choice],
            ["page", "part_ord", "part_no", "qty_ord", "quantity", "qty_top", "weeks", "has_marker", "choice"],
        )

    def _key(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The key of each row's page, and which rows' documents and pages may have one."""
        doc_id, page = batch.column("doc_id").to_numpy(), batch.column("page").to_numpy().astype(np.int64) - self._least
        doc = np.minimum(np.searchsorted(self.doc_ids, doc_id), max(0, len(self.doc_ids) - 1))
        known = (self.doc_ids[doc] == doc_id if len(self.doc_ids) else np.zeros(len(doc), bool)) & (page >= 0) & (page < self._span)
        return doc * self._span + page, known

    def on_pages(self, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
        """The rows of ``batch`` on the pages of the words, and the place of each one's page."""
        key, known = self._key(batch)
        page = np.minimum(np.searchsorted(self._keys, key), max(0, len(self._keys) - 1))
        known &= self._keys[page] == key if len(self._keys) else False
        return page[known], batch.filter(pa.array(known))

    def with_characters(self, chars: pa.RecordBatch, maps: pa.RecordBatch, word: str) -> None:
        """Takes characters without a size and font maps of the pages; cells that read ``word`` under a font get it as choice, see ``bands.cell_choice``."""
        fonts_of = maps.filter(pc.equal(maps.column("page"), 0)).column("doc_id").to_numpy()
        self.has_fonts = np.isin(self.doc_ids, fonts_of)
        self.char_page, self.chars = self.on_pages(chars.filter(pc.equal(pc.fill_null(chars.column("size"), 0), 0)))
        self.fonts = _Fonts(*self.on_pages(maps))
        lacking = np.flatnonzero(~self.rows.column("has_marker").to_numpy(zero_copy_only=False) & self.rows.column("choice").is_null().to_numpy(zero_copy_only=False))
        reads = lacking[self._cells(lacking, word)]
        choice = np.zeros(len(self.rows), bool)
        choice[reads] = True
        self.rows = self.rows.set_column(self.rows.schema.get_field_index("choice"), "choice", pc.if_else(pa.array(choice), word, self.rows.column("choice")))

    def _cells(self, rows: np.ndarray, word: str) -> np.ndarray:
        """Which of the rows have a cell that reads ``word``: in lines from right to left, without spaces, under one font."""
        x0, top = _floats(self.chars.column("x0")), _floats(self.chars.column("top"))
        (x_lo, x_hi), (lo, hi), tolerance = self.form.cell_x, self.form.cell_below, 2.0
        inside = np.flatnonzero((x0 >= x_lo) & (x0 <= x_hi) & ~np.isnan(top))
        ord_ = self.chars.column("ord").to_numpy()
        inside = inside[np.lexsort((ord_[inside], x0[inside], top[inside], self.char_page[inside]))]
        by_top = Sorted(self.char_page, top, inside, len(self._keys))
        page, row_top = self.rows.column("page").to_numpy()[rows], self.rows.column("qty_top").to_numpy()[rows]
        start = by_top.first(page, lambda t: t >= row_top + lo)
        count = np.maximum(by_top.first(page, lambda t: t > row_top + hi) - start, 0)
        row, place = _expanded(start, count)
        if not len(row):
            return np.zeros(len(rows), bool)
        at, tops = by_top.at[place], by_top.top[place]

        # A line begins with each character more than the tolerance below its line's first: the next lines of all cells at once.
        end = np.cumsum(count)
        new, line, end = np.zeros(len(row), np.int64), (end - count)[count > 0], end[count > 0]
        while len(line):
            first = tops[line]
            line = bisected(tops, line, end, lambda t: (t > first + tolerance) & (t - first > tolerance))  # noqa: B023
            line, end = line[line < end], end[line < end]
            new[line] = 1
        order = np.lexsort((ord_[at], x0[at], -np.cumsum(new), row))
        row, at = row[order], at[order]

        char, entry = self.fonts.letters(self.char_page[at], _take(self.chars.column("code"), at))
        order = np.lexsort((self.fonts.font[entry], row[char]))  # stable: the last line's characters stay first
        char, entry = char[order], entry[order]
        row_of, font = row[char], self.fonts.font[entry]
        starts = _runs(row_of, font)
        if not len(starts):
            return np.zeros(len(rows), bool)
        another = np.append(True, (char[1:] != char[:-1]) | (font[1:] != font[:-1]) | (row_of[1:] != row_of[:-1]))
        whole = np.add.reduceat(another, starts, dtype=np.int64) == count[row_of[starts]]
        text = pc.replace_substring_regex(_joined(self.fonts.glyph.take(pa.array(entry)), starts), "[" + "".join(rf"\x{{{ord(c):x}}}" for c in SPACES) + "]+", "")
        reads = pc.fill_null(pc.equal(text, _SPACE.sub("", word)[::-1]), False).to_numpy(zero_copy_only=False)
        out = np.zeros(len(rows), bool)
        out[row_of[starts[whole & reads]]] = True
        return out

    def words_in(self, box, gap: float) -> tuple[np.ndarray, list[str]]:
        """(document, word): what stands in the box of each first page with a mail address under each of its fonts, see ``glyphs.decoded``.

        ``box`` gives x0, x1, y0, y1 of the addresses' x0, x1 and top.
        """
        first = (self.page == 0) & self.mails.is_valid().to_numpy(zero_copy_only=False)
        b0, b1, c0, c1 = (np.broadcast_to(v, len(first)) for v in box(*[_floats(self.mails.field(c)) for c in ("x0", "x1", "top")]))
        x0, top, page = _floats(self.chars.column("x0")), _floats(self.chars.column("top")), self.char_page
        at = np.flatnonzero(first[page] & (x0 >= b0[page]) & (x0 <= b1[page]) & (top >= c0[page]) & (top <= c1[page]))
        at = at[np.lexsort((self.chars.column("ord").to_numpy()[at], x0[at], page[at]))]
        page, x0 = page[at], x0[at]
        apart = np.append(False, (page[1:] == page[:-1]) & (x0[1:] - x0[:-1] >= gap)) if len(at) else np.zeros(0, bool)
        char, entry = self.fonts.letters(page, _take(self.chars.column("code"), at))
        order = np.lexsort((self.fonts.font[entry], page[char]))
        char, entry = char[order], entry[order]
        page_of, font = page[char], self.fonts.font[entry]
        starts = _runs(page_of, font)
        if not len(starts):
            return np.zeros(0, np.int64), []
        another = np.append(True, (char[1:] != char[:-1]) | (font[1:] != font[:-1]))
        n_chars = np.bincount(page, minlength=len(self._keys))
        whole = np.add.reduceat(another, starts, dtype=np.int64) == n_chars[page_of[starts]]
        glyph = self.fonts.glyph.take(pa.array(entry))
        text = _joined(pc.if_else(pa.array(apart[char]), pc.binary_join_element_wise(" ", glyph, ""), glyph), starts)
        keep = whole & text.is_valid().to_numpy(zero_copy_only=False)
        return self.doc[page_of[starts[keep]]], text.filter(pa.array(keep)).to_pylist()

    def first_number(self) -> pa.Array:
        """The first form number of each document."""
        at = np.flatnonzero(self.numbers.is_valid().to_numpy(zero_copy_only=False))
        doc, first = np.unique(self.doc[at], return_index=True)
        place = np.full(len(self.doc_ids), -1)
        place[doc] = at[first]
        return _take(self.numbers.field("text"), place, place < 0)

    def least(self, doc: np.ndarray, texts: pa.Array) -> pa.Array:
        """The least text of each document, NULL without one."""
        order = pc.sort_indices(pa.table([pa.array(doc), texts], ["d", "t"]), sort_keys=[("d", "ascending"), ("t", "ascending")]).to_numpy()
        found, first = np.unique(doc[order], return_index=True)
        place = np.full(len(self.doc_ids), -1)
        place[found] = order[first]
        return _take(texts, place, place < 0)

    def row_errors(self) -> pa.Array:
        """For each row what it lacks, NULL if nothing."""
        said = lambda what: pc.binary_join_element_wise(what, self.rows.column("part_no"), "")
        return pc.if_else(self.rows.column("weeks").is_null(), said("no weeks for "), pc.if_else(self.rows.column("choice").is_null(), said("no FAI value for "), None))

    def row_docs(self) -> np.ndarray:
        return self.doc[self.rows.column("page").to_numpy()]

    def nested(self, good: np.ndarray) -> pa.ListArray:
        """For each document its rows as part_no, quantity, weeks_aro, fai; none for those that aren't good."""
        doc = self.row_docs()
        keep = good[doc]
        kept = self.rows.filter(pa.array(keep))
        rows = pa.StructArray.from_arrays([kept.column(c) for c in ("part_no", "quantity", "weeks", "choice")], ["part_no", "quantity", "weeks_aro", "fai"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc[keep], minlength=len(good)))), pa.int32()), rows)


def in_logical_order(text: str) -> str:
    """``functions.text.logical_order`` of one text."""
    return " ".join(w[::-1] for w in reversed(_SPACE.split(text.strip(SPACES))))


@lru_cache(1 << 16)
def is_date(text: str) -> bool:
    """dd/mm/yyyy that is a day of the calendar."""
    day, month, year = (int(x) for x in text.split("/"))
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= month <= 12 and 1 <= day <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def only(n: int, doc: np.ndarray, values: list[str]) -> tuple[list[str | None], list[str | None]]:
    """(value, error) of each of n documents: the one distinct value; none without any, more are ambiguous."""
    out, error = [None] * n, [None] * n
    for d, value in zip(doc.tolist(), values, strict=True):
        if error[d] is None and out[d] != value:
            if out[d] is None:
                out[d] = value
            else:
                out[d], error[d] = None, "ambiguous"
    return out, error
