"""What batches of whole pages say: roles of words, and what belongs together by position, in numpy over all pages of a batch.

Words of a page that belong together are found by bisection among the page's words, sorted by their tops, with the very
comparisons that ``bands`` makes; the first of a range is the least of its ranks. So time is n log n in a page's words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where Java's $ matches: at the end, or before a line end there.
END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"
PART, DIGITS, QUANTITY, NUMBER = r"\A[A-Z][A-Z0-9]{4,12}" + END, r"\A\d+" + END, r"\A\d+\.\d{1,3}" + END, r"\A\d{6}" + END


def _matches(text: pa.Array, at: np.ndarray, *patterns: str) -> np.ndarray:
    """Those of the words ``at`` whose text all patterns find."""
    for pattern in patterns:
        at = at[pc.match_substring_regex(text.take(pa.array(at)), pattern).to_numpy(zero_copy_only=False)]
    return at


def _doubles(text: pa.Array) -> pa.Array:
    """Digits with a dot as doubles; what overflows is infinite."""
    if len(text) and pc.max(pc.binary_length(text)).as_py() > 300:
        return pa.array([float(t) for t in text.to_pylist()], pa.float64())
    return pc.utf8_trim_whitespace(text).cast(pa.float64())


def _ints(text: pa.Array) -> pa.Array:
    """Digits as 32-bit numbers, NULL beyond."""
    if len(text) and pc.max(pc.binary_length(text)).as_py() > 18:
        return pa.array([n if n < 1 << 31 else None for n in (int(t.strip().lstrip("0")[:11] or "0") for t in text.to_pylist())], pa.int32())
    value = pc.utf8_trim_whitespace(text).cast(pa.int64())
    return pc.if_else(pc.less(value, 1 << 31), value, None).cast(pa.int32())


def bisected(top: np.ndarray, lo: np.ndarray, hi: np.ndarray, holds) -> np.ndarray:
    """The first place of each range lo to hi at whose top ``holds`` is true, hi without one."""
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        yes = holds(top[np.minimum(mid, len(top) - 1)])
        hi = np.where(open_ & yes, mid, hi)
        lo = np.where(open_ & ~yes, mid + 1, lo)
    return lo


class Sorted:
    """Words of one role by page and top, with the range of each page and the rank of each word."""

    def __init__(self, page: np.ndarray, top: np.ndarray, at: np.ndarray, n_pages: int, rank: np.ndarray | None = None):
        order = np.lexsort((top[at], page[at]))
        self.at, self.top = at[order], top[at][order]
        self.cuts = np.searchsorted(page[self.at], np.arange(n_pages + 1))
        self.rank = None if rank is None else rank[order]

    def first(self, page: np.ndarray, holds) -> np.ndarray:
        """The first place in each page at whose top ``holds`` is true: it is false before, and true after that."""
        return bisected(self.top, self.cuts[page], self.cuts[page + 1], holds)

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of the least rank in each range, -1 in empty ones: minima of ranges of powers of two, of which two cover any."""
        out = np.full(len(start), -1)
        length, level, width = end - start, self.rank, 1
        by_rank = np.empty(len(self.rank), np.int64)
        by_rank[self.rank] = np.arange(len(self.rank))
        while (length >= width).any():
            now = np.flatnonzero((length >= width) & (length < 2 * width))
            out[now] = by_rank[np.minimum(level[start[now]], level[end[now] - width])]
            level, width = np.minimum(level[:-width], level[width:]), 2 * width
        return out


def _rank(*keys: pa.Array) -> np.ndarray:
    """The rank of each row by the keys, NULL first."""
    names = [str(i) for i in range(len(keys))]
    order = pc.sort_indices(pa.table(list(keys), names), sort_keys=[(n, "ascending") for n in names], null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _first_of_page(page: np.ndarray, at: np.ndarray, n_pages: int, *keys: pa.Array) -> pa.Array:
    """For each page the word among ``at`` (by pages) that is least by the keys, NULL without one."""
    out = np.full(n_pages, -1)
    rank = _rank(*[k.take(pa.array(at)) for k in keys])
    down = np.argsort(-rank)
    out[page[at[down]]] = at[down]  # the least is written last
    return pa.array(out, mask=out < 0)


def read(batch: pa.RecordBatch, domain: str, form) -> pa.RecordBatch:
    """doc_id, page, parts, number, mail of a batch of pages (doc_id, page, words), see ``bands.read_pages``."""
    lists, n = batch.column("words"), len(batch)
    page = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    *found, said = said_by(lists.flatten(), page, n, domain, form)
    out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), *found], ["doc_id", "page", "parts", "number", "mail"])
    return out.filter(pa.array(said))


def said_by(words: pa.StructArray, page: np.ndarray, n: int, domain: str, form) -> tuple[pa.ListArray, pa.StructArray, pa.StructArray, np.ndarray]:
    """(parts, number, mail, said) of n pages from their words and the page of each: said tells of pages with a word that is read."""
    text, ords = words.field("text"), words.field("ord")
    x0, x1, top = (words.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1", "top"))
    with np.errstate(invalid="ignore"):
        center = (x0 + x1) / 2
    some = np.flatnonzero
    known = words.field("top").is_valid().to_numpy(zero_copy_only=False)
    inside = lambda band: (center >= band[0]) & (center <= band[1])

    part = _matches(text, some(inside(form.part) & known & ~(top <= form.header)), PART, r"\d")
    each = some(inside(form.each) & known)
    each = each[pc.equal(text.take(pa.array(each)), "Each").to_numpy(zero_copy_only=False)]
    quantity = _matches(text, some(inside(form.quantity)), QUANTITY)
    weeks = _matches(text, some(inside(form.weeks)), DIGITS)
    marker = some(inside(form.marker))
    marker = marker[pc.starts_with(text.take(pa.array(marker)), "FAI").to_numpy(zero_copy_only=False)]
    digit = _matches(text, some(inside(form.digit)), DIGITS)
    number = _matches(text, some(inside(form.number_x) & (top >= form.number_y[0]) & (top <= form.number_y[1])), NUMBER)
    mail = some((center <= form.mail_x_max) & (top >= form.mail_y[0]) & (top <= form.mail_y[1]))
    mail = mail[pc.ends_with(text.take(pa.array(mail)), "@" + domain).to_numpy(zero_copy_only=False)]
    take = lambda array, at: array.take(pa.array(at))

    def near(words_: Sorted, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of those within a row of each word."""
        with np.errstate(invalid="ignore"):
            return words_.first(page[at], lambda t: t - top[at] >= -form.row), words_.first(page[at], lambda t: t - top[at] > form.row)

    said = np.zeros(n, bool)
    for role in (part, each, quantity, weeks, marker, digit, number, mail):
        said[page[role]] = True
    placed = ~np.isnan(top)  # nothing is near to what has no place
    part, each, quantity, weeks, marker, digit = (role[placed[role]] for role in (part, each, quantity, weeks, marker, digit))

    # Parts with an Each on their row, each up to the next one's row.
    start, end = near(Sorted(page, top, each, n), part)
    part = part[end > start]
    part = part[np.argsort(_rank(pa.array(page[part]), pa.array(top[part]), take(ords, part), take(text, part)))]
    following = np.append(np.where(page[part[1:]] == page[part[:-1]], top[part[1:]], form.end), form.end)[: len(part)]
    low, high = top[part] - form.row, following - form.row

    # Quantities with the first weeks and marker on their row, and the first digit below that marker.
    q = Sorted(page, top, quantity, n)
    week_values = _ints(take(text, weeks))
    w = Sorted(page, top, weeks, n, _rank(take(ords, weeks), week_values))
    week = w.least(*near(w, q.at))
    m = Sorted(page, top, marker, n, _rank(take(ords, marker), pa.array(top[marker])))
    mark = m.least(*near(m, q.at))
    has = mark >= 0
    m_top = np.where(has, m.top[mark] if len(m.top) else np.nan, np.nan)[has]
    d = Sorted(page, top, digit, n, _rank(take(ords, digit), take(text, digit)))
    found = np.full(len(q.at), -1)
    found[has] = d.least(d.first(page[q.at[has]], lambda t: t > m_top), d.first(page[q.at[has]], lambda t: t > m_top + form.digit_below))

    # Each part's quantities: ranges in their order.
    start = q.first(page[part], lambda t: t >= low)
    count = np.maximum(q.first(page[part], lambda t: t > high) - start, 0)
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)
    optional = lambda array, index: array.take(pa.array(index, pa.int64(), mask=index < 0))
    words_of = lambda s, index: np.where(index >= 0, s.at[index] if len(s.at) else -1, -1)
    value_of = np.zeros(len(text), np.int64)
    value_of[weeks] = np.arange(len(weeks))
    week_word = words_of(w, week)[at]
    deliveries = pa.StructArray.from_arrays(
        [take(ords, q.at[at]), take(_doubles(take(text, q.at)), at), pa.array(q.top[at]), optional(week_values, np.where(week_word >= 0, value_of[week_word] if len(value_of) else -1, -1)), pa.array(has[at]), optional(text, words_of(d, found)[at])],
        ["qty_ord", "quantity", "qty_top", "weeks", "has_marker", "digit"],
    )
    offsets = lambda counts: pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    parts = pa.StructArray.from_arrays([take(ords, part), take(text, part), pa.array(top[part]), pa.ListArray.from_arrays(offsets(count), deliveries)], ["part_ord", "part_no", "part_top", "deliveries"])
    parts = pa.ListArray.from_arrays(offsets(np.bincount(page[part], minlength=n)), parts)

    numbers = pa.StructArray.from_arrays([ords, text], ["ord", "text"]).take(_first_of_page(page, number, n, ords, text))
    away = pa.array(np.abs(top - form.mail_top))
    box = [pa.array(x0), pa.array(x1), pa.array(top)]
    mails = pa.StructArray.from_arrays([away, ords, text, *box], ["away", "ord", "text", "x0", "x1", "top"]).take(_first_of_page(page, mail, n, away, ords, text, *box))
    return parts, numbers, mails, said


def read_all(batches, domain: str, form, at_once: int = 500_000):
    """``read`` over batches, of at most so many words at once, or one page."""
    for batch in batches:
        ends, start = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy()), 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, "right")))
            yield read(batch.slice(start, end - start), domain, form)
            start = end
