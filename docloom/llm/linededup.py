"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

An index knows which lines the documents put into it hold. Its exact tables count references: ``holders`` has a row for
each (line, document), ``counts`` for each line how many rows hold it and the first and last doc_id of them. Lines
are 128-bit hashes of their keys, dealt to shards; among 10^12 different lines an equal pair is expected with
probability 2 x 10^-15. Each shard has two cuckoo filters: ``present`` for its lines, ``shared`` for those of two
documents or more. They say which lines need the exact tables at all:

* a batch that is inserted probes ``present``; only what may be known is joined with earlier counts;
* documents that are cleaned probe ``shared``; only what may be shared is joined with the counts, which takes false
  positives out.

The reference counts in turn decide when a line enters a filter (its first reference, its second document) and
when it leaves, so that deleting documents takes back all that inserting them did.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import stored, table, trimmed, unused
from .textarrays import mix

#: Lines of fewer code points (after stripping) are never dropped.
LEAST_CHARS = 10
#: Different lines for each shard of a new index, and buckets of four slots in its filters.
SHARD_LINES, BUCKETS = 150_000, 1 << 16
#: Lines with more than this share of all references, at most its inverse in number, are broadcast and not shuffled.
HOT_SHARE = 1 / 20_000
#: A row without a doc_id counts as the document with this one, after all others.
NO_ID = (1 << 63) - 1

_SPACE = " \t\n\x0b\x0c\r"
_LINE = ["k1", "k2"]
_LINES = "holder long, text_hash long, k1 long, k2 long"
_ROWS = "slot int, kind int, k1 long, k2 long, holder long, text_hash long, filter binary"
#: Kinds of rows of a filter pass, in the order in which a shard meets them.
FILTER, REMOVE, ADD, PROBE = range(4)
#: The filters of shard s are slots 2s and 2s + 1.
PRESENT, SHARED = range(2)


class Cuckoo:
    """16-bit fingerprints in buckets of four slots or a multiple; every operation takes an array of 64-bit hashes.

    A fingerprint stands in one of two buckets that follow from each other and from it. Where no place is left, buckets get four more
    slots: equal fingerprints of the same buckets stay interchangeable, so a removal never hits another key.
    """

    ROUNDS = 60

    def __init__(self, slots: np.ndarray | None = None):
        self.slots = np.zeros((BUCKETS, 4), np.uint16) if slots is None else slots

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").reshape(BUCKETS, -1).copy())

    def dump(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.slots))

    @staticmethod
    def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16), (h % np.uint64(BUCKETS)).astype(np.int64)

    @staticmethod
    def _other(bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may have been added; never False for one that was."""
        print_, bucket = self._places(keys)
        return ((self.slots[bucket] == print_[:, None]) | (self.slots[self._other(bucket, print_)] == print_[:, None])).any(1)

    def add(self, keys: np.ndarray) -> None:
        """Adds each key once more."""
        print_, bucket = self._places(keys)
        for turn in range(1 << 62):
            if not len(print_):
                return
            if turn % self.ROUNDS == self.ROUNDS - 1:
                self.slots = np.concatenate((self.slots, np.zeros((BUCKETS, 4), np.uint16)), 1)
            order = np.argsort(bucket, kind="stable")
            print_, bucket = print_[order], bucket[order]
            start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
            taken = self.slots[bucket] != 0
            free = (~taken).sum(1)
            fits = rank < free
            by_use = np.argsort(taken, axis=1, kind="stable")  # free slots first
            self.slots[bucket[fits], by_use[fits, rank[fits]]] = print_[fits]
            print_, bucket, late = print_[~fits], bucket[~fits], (rank == free)[~fits]
            if turn:  # the first in each full bucket takes the place of another
                at = bucket[late], np.full(int(late.sum()), turn % self.slots.shape[1])
                print_[late], self.slots[at] = self.slots[at], print_[late]
            bucket = self._other(bucket, print_)

    def remove(self, keys: np.ndarray) -> None:
        """Takes each key, which must have been added, out once."""
        print_, first = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (first, self._other(first, print_)):
            while len(left):
                match = self.slots[bucket[left]] == print_[left][:, None]
                here = match.any(1)
                if not here.any():
                    break
                at = bucket[left[here]] * self.slots.shape[1] + match[here].argmax(1)
                _, one = np.unique(at, return_index=True)  # equal fingerprints go one after another
                self.slots.reshape(-1)[at[one]] = 0
                left = np.delete(left, np.flatnonzero(here)[one])


def line_hashes(text: str | None) -> list[bytes | None]:
    """The hash of the key of each line; None for lines that are too short to be dropped."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(_SPACE)
        # Only A-Z change case in UTF-8 bytes.
        out.append(hashlib.blake2b(key.encode("utf-8", "replace").lower(), digest_size=16).digest() if len(key) >= LEAST_CHARS else None)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, of = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = {h for h in line_hashes(text) if h} if text else ()
            keys += own
            of += [i] * len(own)
        both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        of = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("holder").take(of), batch.column("text_hash").take(of), pa.array(both[:, 0]), pa.array(both[:, 1])], ["holder", "text_hash", *_LINE])


def _named(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(docs["text"].cast("string"))


def lines_of(docs: DataFrame) -> DataFrame:
    """holder, text_hash, k1, k2: the different lines of each row of ``docs`` that are long enough."""
    holder, text_hash = _named(docs)
    return docs.select(holder.alias("holder"), text_hash.alias("text_hash"), docs["text"].cast("string").alias("text")).mapInArrow(trimmed(_hashed), _LINES)


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot and kind: removals and additions change each slot's filter, probes that it doesn't contain go."""
    slot, cuckoo, names = None, Cuckoo(), ["slot", "kind", *_LINE, "holder", "text_hash", "filter"]

    def closed() -> pa.RecordBatch:
        none = [pa.nulls(1, pa.int64())] * 4
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([FILTER], pa.int32()), *none, pa.array([cuckoo.dump()], pa.binary())], names)

    for batch in batches:
        slots, kinds = batch.column("slot").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((slots[1:] != slots[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(slots)), strict=True):
            if a == b:
                continue
            if slots[a] != slot:
                if slot is not None:
                    yield closed()
                slot, cuckoo = int(slots[a]), Cuckoo()
            if kinds[a] == FILTER:
                cuckoo = Cuckoo.load(batch.column("filter")[int(a)].as_py())
                continue
            keys = batch.column("k2").slice(a, b - a).to_numpy()
            if kinds[a] == REMOVE:
                cuckoo.remove(keys)
            elif kinds[a] == ADD:
                cuckoo.add(keys)
            else:
                hits = batch.take(pa.array(a + np.flatnonzero(cuckoo.contains(keys))))
                yield pa.RecordBatch.from_arrays(hits.columns, names)
    if slot is not None:
        yield closed()


def _rows(df: DataFrame, shards: int, filter_: int, kind: int) -> DataFrame:
    place = [F.col(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in ("holder", "text_hash")]
    slot = (F.pmod(F.col("k1"), F.lit(shards)) * 2 + filter_).cast("int")
    return df.select(slot.alias("slot"), F.lit(kind).alias("kind"), *_LINE, *place, F.lit(None).cast("binary").alias("filter"))


def _filter_pass(parts: list[DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """The filters after the changes, and the probes that they may contain."""
    rows = reduce(DataFrame.unionByName, parts).repartition("slot").sortWithinPartitions("slot", "kind")
    out = stored(rows.mapInArrow(trimmed(_passed), _ROWS), name)
    return out.where(F.col("kind") == FILTER), out.where(F.col("kind") == PROBE).select("slot", *_LINE, "holder", "text_hash")


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*_LINE).agg(F.count("*").alias("refs"), F.min("holder").alias("first"), F.max("holder").alias("last"))


@dataclass
class LineIndex:
    """Tables of an index, all stored; ``counts`` has a part for each insertion, which add up."""

    shards: int
    holders: list[DataFrame]
    counts: list[DataFrame]
    filters: DataFrame

    def references(self) -> DataFrame:
        """k1, k2, refs, first, last of every line."""
        if len(self.counts) == 1:
            return self.counts[0]
        parts = reduce(DataFrame.unionByName, self.counts)
        return parts.groupBy(*_LINE).agg(F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"))


def build_index(docs: DataFrame) -> LineIndex:
    """An index of ``docs``, with a shard for each SHARD_LINES different lines; insertions widen its filters."""
    lines = stored(lines_of(docs), "lines")
    counts = stored(_counted(lines), "line-counts")
    shards = counts.count() // SHARD_LINES + 1
    filters, _ = _filter_pass([_rows(counts, shards, PRESENT, ADD), _rows(counts.where("first < last"), shards, SHARED, ADD)], "line-filters")
    return LineIndex(shards, [lines], [counts], filters)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """``index`` with ``docs`` put in; what only the new documents hold meets no earlier count."""
    lines = stored(lines_of(docs), "lines")
    counts = stored(_counted(lines), "line-counts")
    present, hits = _filter_pass([index.filters.where(F.col("slot") % 2 == PRESENT), _rows(counts, index.shards, PRESENT, PROBE)], "line-probes")
    known = index.references().join(hits.select(*_LINE), _LINE, "left_semi").select(*_LINE, F.col("first").alias("old_first"), F.col("last").alias("old_last"))
    merged = stored(counts.join(known, _LINE, "left"), "line-merged")
    new = merged.where("old_first IS NULL")
    shared = merged.where("NOT coalesce(old_first < old_last, false) AND least(first, old_first) < greatest(last, old_last)")
    old = index.filters.where(F.col("slot") % 2 == SHARED).unionByName(present)
    filters, _ = _filter_pass([old, _rows(new, index.shards, PRESENT, ADD), _rows(shared, index.shards, SHARED, ADD)], "line-filters")
    return LineIndex(index.shards, [*index.holders, lines], [*index.counts, counts], filters)


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """``index`` without ``docs``, given with their texts; rows that aren't in it change nothing.

    The references of the lines that they hold are counted anew; all others stay. Equal rows (doc_id and text) go together.
    """
    gone = stored(lines_of(docs).distinct(), "lines-gone")
    holders = reduce(DataFrame.unionByName, index.holders)
    rest = stored(holders.join(gone, ["holder", "text_hash", *_LINE], "left_anti"), "lines")
    touched = stored(gone.select(*_LINE).distinct(), "lines-touched")
    before = index.references().join(touched, _LINE, "left_semi").select(*_LINE, F.col("first").alias("old_first"), F.col("last").alias("old_last"))
    after = _counted(rest.join(touched, _LINE, "left_semi"))
    changed = stored(before.join(after, _LINE, "left"), "lines-changed")
    gone_now = changed.where("refs IS NULL")
    alone = changed.where("old_first < old_last AND NOT coalesce(first < last, false)")
    filters, _ = _filter_pass([index.filters, _rows(gone_now, index.shards, PRESENT, REMOVE), _rows(alone, index.shards, SHARED, REMOVE)], "line-filters")
    kept = index.references().join(touched, _LINE, "left_anti").unionByName(changed.where("refs IS NOT NULL").select(*_LINE, "refs", "first", "last"))
    return LineIndex(index.shards, [rest], [stored(kept, "line-counts")], filters)


def repeated_lines(index: LineIndex, lines: DataFrame) -> DataFrame:
    """holder, text_hash, k1, k2 of those of ``lines`` that a document of the index with a lesser doc_id holds."""
    counts = index.references()
    total = counts.agg(F.sum("refs")).first()[0] or 0
    hot = counts.where((F.col("refs") > total * HOT_SHARE) & (F.col("refs") > 1)).select(*_LINE, "first", "last")
    hot = F.broadcast(stored(hot, "hot-lines"))  # fewer than 1 / HOT_SHARE rows
    probes = _rows(lines.join(hot, _LINE, "left_anti"), index.shards, SHARED, PROBE)
    _, hits = _filter_pass([index.filters.where(F.col("slot") % 2 == SHARED), probes], "line-hits")
    exact = hits.join(counts.where("first < last"), _LINE).where("holder > first")
    frequent = lines.join(hot, _LINE).where("holder > first")
    columns = ["holder", "text_hash", *_LINE]
    return exact.select(*columns).unionByName(frequent.select(*columns))


def drop_repeated_lines(docs: DataFrame, index: LineIndex, lines: DataFrame | None = None) -> DataFrame:
    """``docs`` without the lines that a document of ``index`` with a lesser doc_id holds, and n_lines and n_dropped.

    Lines end at line feeds; a null or empty text is one empty line. Keys are lines without white space at either end,
    A-Z in lower case; lines with keys of fewer than LEAST_CHARS code points stay. All lines of a key go from a
    document that isn't the first to hold it. Rows with the same doc_id are one document, rows without one too, after all
    others. Null texts stay null. Repeated rows stay, each cleaned alike; other columns are carried along, also those
    named n_lines (the new ones then begin with underscores); an empty table gives an empty result. ``lines`` are the lines of
    ``docs`` where they are known already.
    """
    found = repeated_lines(index, stored(lines_of(docs), "lines") if lines is None else lines)
    # A row's own list: rows without a doc_id don't share one.
    lists = found.groupBy("holder", "text_hash").agg(F.collect_set(F.struct(*_LINE)).alias("gone"))
    text, holder, text_hash, gone, n_lines, n_dropped = (unused(docs, c) for c in ("text", "holder", "text_hash", "gone", "n_lines", "n_dropped"))
    text = next(c for c in docs.columns if c.lower() == "text")
    lists = lists.toDF(holder, text_hash, gone)
    whole = docs.withColumn(text, F.col(text).cast("string"))
    own_holder, own_hash = _named(whole)
    joined = whole.join(lists, (own_holder == lists[holder]) & own_hash.eqNullSafe(lists[text_hash]), "left").drop(holder, text_hash)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes, dropped = [], [], []
            lists_ = batch.column(gone)
            entries = lists_.flatten()
            keys = np.stack([entries.field(c).to_numpy(zero_copy_only=False) for c in _LINE], 1).astype("<i8").tobytes() if len(entries) else b""
            sizes_of = lists_.value_lengths().fill_null(0).to_pylist()
            at = 0
            for content, n in zip(batch.column(text).to_pylist(), sizes_of, strict=True):
                own = {keys[16 * i : 16 * i + 16] for i in range(at, at + n)}
                at += n
                rows = (content or "").count("\n") + 1
                lost = 0
                if own:
                    stay = [line for line, h in zip(content.split("\n"), line_hashes(content), strict=True) if h not in own]
                    lost, content = rows - len(stay), "\n".join(stay)
                out.append(content)
                sizes.append(rows)
                dropped.append(lost)
            batch = batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string())).drop_columns([gone])
            yield batch.append_column(n_lines, pa.array(sizes, pa.int64())).append_column(n_dropped, pa.array(dropped, pa.int64()))

    schema = whole.withColumns({n_lines: F.lit(0).cast("long"), n_dropped: F.lit(0).cast("long")}).schema
    return joined.mapInArrow(trimmed(cleaned), schema)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that one with a lesser doc_id holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = build_index(docs)
    kept = drop_repeated_lines(docs, index, index.holders[0])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (
  SELECT r, doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)),
k AS MATERIALIZED (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.r, l.doc_id, l.line, l.i, coalesce(l.doc_id > k.first, false) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
