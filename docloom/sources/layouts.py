"""Quotation forms laid out from batches of line items in Arrow: the words, characters and font maps that SQL describes in ``plans.queries_quotations``.

A batch has doc_id, ord, part and q. A page has five lines. Where SQL gives a word without a text or without a place for a NULL,
which no form says anything by, there is none here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SHIFTED = str.maketrans("0123456789", "cdefghijkl")


class _Lines:
    def __init__(self, lines: pa.RecordBatch):
        self.doc, self.ord, self.part, self.q = (pc.fill_null(lines.column(c), 0).to_numpy().astype(np.int64) for c in ("doc_id", "ord", "part", "q"))
        self.has_part, self.has_q = (lines.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("part", "q"))
        self.page = (self.ord - 1) // 5
        self.top = 150.0 + 60 * np.fmod(self.ord - 1, 5)


def _text(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers).cast(pa.string())


def words(batch: pa.RecordBatch, marked: Callable[[np.ndarray], np.ndarray] = lambda doc: np.ones(len(doc), bool)) -> pa.RecordBatch:
    """doc_id, page, ord, text, x0, x1, top, size of WORDS_SQL; ``marked`` tells which documents have markers."""
    li, found = _Lines(batch), []
    every = np.arange(len(li.doc))

    def put(n: int, text, x0: float, x1, top, at: np.ndarray = every, size: float = 8.0) -> None:
        text = pa.repeat(text, len(at)) if isinstance(text, str) else text
        spread = lambda v: np.broadcast_to(np.asarray(v, float), len(at))
        found.append((at, li.ord[at] * 20 + n, text, *[spread(v) for v in (x0, x1, top, size)]))

    join = lambda *texts: pc.binary_join_element_wise(*texts, "")
    at = np.flatnonzero(li.has_part)
    put(0, join("P", _text(10000 + li.part[at])), 735, 775, li.top[at], at)
    put(4, join("u", _text(li.ord[at]), "@example.com"), 100, 180 + np.fmod(li.part[at], 50), 92 + np.fmod(li.part[at], 15), at)
    at = np.flatnonzero(li.has_part & (np.fmod(li.part, 13) != 0))
    put(1, "Each", 500, 520, li.top[at] + 1.25, at)
    at = np.flatnonzero(li.has_part & (np.fmod(li.part, 5) == 0))
    put(2, "XPOTDP01", 735, 775, li.top[at] + 30, at)
    both = li.doc + li.ord
    put(3, join(_text(100000 + np.fmod(both, 900000)), pc.if_else(pa.array(np.fmod(both, 3) == 0), "7", "")), 130, 160, 55)
    put(5, "é", 260, 280, li.top, size=0.0)
    with_marker = marked(li.doc)
    for d in (0, 1):
        two, down = li.has_q & (np.fmod(li.q, 2) >= d), li.top + 20 * d
        at = np.flatnonzero(two)
        put(6 + d, join(_text(li.q[at] + d), ".50"), 260, 280, down[at] + 0.5, at)
        at = np.flatnonzero(two & li.has_part)
        put(12 + d, _text(np.fmod(np.fmod(li.part[at] + d, 31), 3) + 1 + 5 * (np.fmod(li.part[at], 37) == 0)), 35, 40, down[at] + 8.5, at)
        at = np.flatnonzero(two & li.has_part & (np.fmod(li.part + d, 29) != 0))
        put(8 + d, _text(np.fmod(li.part[at], 20) + d), 360, 370, down[at] + 2.5, at)
        at = np.flatnonzero(two & with_marker)
        put(10 + d, "FAI-", 30, 45, down[at] - 0.5, at)
    at, ord_, text, *place = zip(*found, strict=True)
    at = np.concatenate(at)
    columns = [li.doc[at], li.page[at].astype(np.int32), np.concatenate(ord_).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.concat_arrays(text), *[pa.array(np.concatenate(v)) for v in place]], ["doc_id", "page", "ord", "text", "x0", "x1", "top", "size"])


def characters(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """doc_id, page, ord, code, x0, top, size of the characters of GLYPHS_SQL, and their letters as code points."""
    li, found = _Lines(batch), []

    def put(doc: np.ndarray, page: np.ndarray, base: np.ndarray, texts: np.ndarray, x: float, step: float, top: np.ndarray) -> None:
        letters = np.ascontiguousarray(texts).view(np.uint32).reshape(len(texts), -1) if len(texts) else np.zeros((0, 1), np.uint32)
        t, i = np.nonzero((letters != 0) & (letters != ord(" ")))
        found.append((doc[t], page[t], base[t] + i, letters[t, i], x + i * step, top[t]))

    docs = np.unique(li.doc)
    once = lambda doc, value: np.full(len(doc), value)
    names = [str(d).translate(_SHIFTED)[::-1] + " ba" for d in docs.tolist()]
    put(docs, once(docs, 0), once(docs, 0), np.array(names, np.str_), 100.0, 5.0, once(docs, 79.0))
    dated = docs[np.fmod(docs, 13) != 0]
    # Parts of negative numbers are cut to two signs as lpad does.
    dates = [f"{str(d).rjust(2, '0')[:2]}/{str(m).rjust(2, '0')[:2]}/2024" for d, m in zip((1 + np.fmod(dated, 31)).tolist(), (1 + np.fmod(dated, 12)).tolist(), strict=True)]
    put(dated, once(dated, 0), once(dated, 100), np.array(dates, np.str_), 284.0, 4.0, once(dated, 179.0))
    for d in (0, 1):
        at = np.flatnonzero(li.has_q & (np.fmod(li.q, 2) >= d) & (np.fmod(li.doc, 3) == 0) & (np.fmod(li.doc, 9) != 0))
        for text, more, down in (("ton", 0, 3), ("deriuqer", 20, 10)):
            put(li.doc[at], li.page[at], 1000 + li.ord[at] * 100 + d * 40 + more, np.full(len(at), text), 29.0, 2.0, li.top[at] + 20 * d + down)
    doc, page, ord_, letter, x0, top = (np.concatenate(v) for v in zip(*found, strict=True))
    columns = [doc, page.astype(np.int32), ord_.astype(np.int32), (letter + 100).astype(np.int32), x0, top, np.zeros(len(doc))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "page", "ord", "code", "x0", "top", "size"]), letter


def font_maps(chars: pa.RecordBatch, letter: np.ndarray) -> pa.RecordBatch:
    """doc_id, page, font_id, code, glyph of the pages' characters: the second font lacks a, 2 and o; the third, of some, has z for b."""
    doc, page = chars.column("doc_id").to_numpy(), chars.column("page").to_numpy()
    order = np.lexsort((letter, page, doc))
    doc, page, letter = doc[order], page[order], letter[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1]) | (letter[1:] != letter[:-1]))[: len(doc)]
    doc, page, letter = doc[new], page[new], letter[new]
    fonts = [(0, (np.fmod(doc, 17) != 0) | (page > 0), letter), (1, ~np.isin(letter, [ord(c) for c in "a2o"]), letter), (2, np.fmod(doc, 11) == 0, np.where(letter == ord("b"), ord("z"), letter))]
    glyph = pa.array([chr(i) for i in range(128)]).take(pa.array(np.concatenate([g[has] for _, has, g in fonts])))
    columns = [np.concatenate([v[has] for _, has, _ in fonts]) for v in (doc, page, letter + 100)]
    font = np.concatenate([np.full(int(has.sum()), n, np.int32) for n, has, _ in fonts])
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(font), pa.array(columns[2].astype(np.int32)), glyph], ["doc_id", "page", "font_id", "code", "glyph"])


def forms(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch, pa.RecordBatch]:
    """Words of FORMS_SQL (a third of the documents without markers), characters and font maps of whole quotations."""
    chars, letter = characters(batch)
    return words(batch, lambda doc: np.fmod(doc, 3) != 0), chars, font_maps(chars, letter)
