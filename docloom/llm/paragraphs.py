"""Repeated paragraphs: MinHash banding, exact Jaccard verification, removals clustered by components.

Texts are cut into two kinds of units. Lines of ``min_words`` words or more are the paragraphs that authors made.
Blocks of BLOCK_WORDS words lie over line breaks and begin where the words say so: a block begins at the
least hash of each ANCHOR_WORDS consecutive five-word runs, so two texts with the same run of
BLOCK_WORDS + ANCHOR_WORDS - 1 words, wherever their lines break, have a block in common in it. Both kinds are signed by
MinHash over their five-word shingles: lines in 8 bands of 3 samples, which meet with probability 0.997 at
similarity 0.8, and blocks, of which a passage has several and one is enough, in a single band of 4, in which equal ones
always meet. Exact Jaccard similarity takes what collides by chance out again. Of each class of similar units the first occurrence (least doc_id, then
place) stays. Blocks that follow each other in both places are one span; words between two blocks are in it only
where they are the same in both, which the hashes of these words tell. Blocks are seeds: a removed span then grows word by
word, at both ends, while the words are the same as those around the place that stays, or loses the words at an end that differ
there. So each removed word is in a verified block or compared, and a repeated passage goes from its first word to its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import BROADCAST_KEYS, discard, documents, few, small, stored, table, trimmed
from .neardup import BAND_ROWS, BANDS, SIMILARITY, Check, classes
from .textarrays import chunks, code_points, mix, run_hashes, span_hashes, words

#: Shorter lines (headings, list items, licence lines) repeat in clean text too; runs of them are in blocks.
MIN_WORDS = 20
#: Words of a block, and five-word runs of which the least begins one: any run of 51 words has a block in it.
BLOCK_WORDS, ANCHOR_WORDS = 20, 32
BLOCK_BANDS, BLOCK_ROWS = 1, 4
#: Words that a common run can have before its first block or after its last one, and spans grow at an end.
GROWTH = ANCHOR_WORDS - 1
#: Words at an end of a span that it can lose where they differ: similar blocks can begin or end with one or, in a chain of links, a few.
TRIM = 4

_SCHEMA = "doc_id long, text_hash long, paragraph int, at int, start long, end long, n_words int, step int, gap long, node long, keys array<long>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def block_starts(five: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words at which blocks begin, of texts whose words begin at ``at``; ``five`` hashes the five words from each one on."""
    span = BLOCK_WORDS + ANCHOR_WORDS - 1
    room = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    begin = np.flatnonzero(room >= span)
    if not len(begin):
        return begin
    seen = np.lib.stride_tricks.sliding_window_view(five, ANCHOR_WORDS)
    parts = np.array_split(begin, len(begin) // 50_000 + 1)
    return np.unique(np.concatenate([x + ANCHOR_WORDS - 1 - seen[x][:, ::-1].argmin(1) for x in parts]))  # the last of equals


def _without_overlaps(start: np.ndarray, name: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which blocks stay if of equal ones in a text that overlap each other, one after another, the first stays."""
    order = np.lexsort((start, name, text))
    s, n, t = start[order], name[order], text[order]
    again = np.concatenate(([False], (n[1:] == n[:-1]) & (t[1:] == t[:-1]) & (s[1:] - s[:-1] < BLOCK_WORDS)))[: len(s)]
    return np.sort(order[~again])


def _signed(min_words: int):
    """The units of texts: lines with their number as paragraph and blocks without one, node and band keys."""

    def of_texts(texts: list):
        """Arrays by unit: text, paragraph (-1: block), first word in its text, start, end, words, step, gap, node; keys and how many each has.

        step is how many words after a block the next one of the text begins (0: more than ANCHOR_WORDS, or none), gap a hash of the words between.
        """
        word, at, first, end = words(texts)
        points, starts = code_points(texts)
        stop = np.flatnonzero(points == 10)
        begin = np.append(0, stop[:-1] + 1)
        a, b = np.searchsorted(first, begin), np.searchsorted(first, stop)
        line = np.flatnonzero(b - a >= min_words)
        five = run_hashes(word, 5)
        padded = np.append(five, np.zeros(4, np.uint64))
        block = block_starts(five, at)
        owner = np.searchsorted(at, block, "right") - 1
        run = span_hashes(word, block, block + BLOCK_WORDS)
        stay = _without_overlaps(block, run, owner)
        block, owner, run = block[stay], owner[stay], run[stay]
        step = np.append(block[1:], -1)[: len(block)] - block
        step[(np.append(owner[1:], -1)[: len(block)] != owner) | (step > ANCHOR_WORDS)] = 0
        gap = span_hashes(word, block + BLOCK_WORDS, block + np.maximum(step, BLOCK_WORDS))
        # Least samples of the shingles of each unit: of pairs (first, end) reduceat gives the first ones' spans.
        spans = [np.stack((x, np.minimum(y, len(padded) - 1)), 1).ravel() for x, y in ((a[line], b[line] - 4), (block, block + BLOCK_WORDS - 4))]
        keys = [np.zeros((len(x) // 2, n), np.uint64) for x, n in zip(spans, (BANDS, BLOCK_BANDS), strict=True)]
        for k in range(BANDS * BAND_ROWS):
            if not len(padded) > 4:
                break
            draw = mix(padded ^ np.uint64(((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64)))
            for kind, (n, rows) in enumerate(((BANDS, BAND_ROWS), (BLOCK_BANDS, BLOCK_ROWS))):
                band = k // rows
                if band < n and len(spans[kind]):
                    sample = np.minimum.reduceat(draw, spans[kind])[::2]
                    keys[kind][:, band] = mix(keys[kind][:, band] * np.uint64(31) + sample + np.uint64(band + 1 + 100 * kind))
        text = np.searchsorted(starts, begin[line], "right") - 1
        number = line - np.searchsorted(begin, starts[:-1])[text]
        last = block + BLOCK_WORDS - 1
        return (
            np.concatenate((text, owner)),
            np.concatenate((number, np.full(len(block), -1))),
            np.concatenate((a[line] - at[text], block - at[owner])),
            np.concatenate((begin[line] - starts[text], first[block] - starts[owner])),
            np.concatenate((stop[line] - starts[text], end[last] - starts[owner] if len(block) else last)),
            np.concatenate(((b - a)[line], np.full(len(block), BLOCK_WORDS))),
            np.concatenate((np.zeros(len(line), np.int64), step)),
            np.concatenate((np.zeros(len(line), np.uint64), gap)),
            np.concatenate((span_hashes(word, a[line], b[line]), mix(run + _STEP))),
            np.concatenate((keys[0].ravel(), keys[1].ravel())),
            np.concatenate((np.full(len(line), BANDS), np.full(len(block), BLOCK_BANDS))),
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in chunks(texts):
                text, number, at, start, end, n, step, gap, node, keys, count = of_texts(texts[i:j])
                own = pa.array(i + text)
                columns = [batch.column("doc_id").take(own), batch.column("text_hash").take(own)]
                columns += [pa.array(number, pa.int32(), mask=number < 0), pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int32()), pa.array(step, pa.int32()), pa.array(gap.astype(np.int64)), pa.array(node.astype(np.int64))]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(keys.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "paragraph", "at", "start", "end", "n_words", "step", "gap", "node", "keys"])

    return rows


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each span (at, n_words) of a text its first TRIM words and GROWTH before it, going back, and its last ones and those after it: short hashes, where the former start and the latter end."""
    reach = np.arange(-TRIM, GROWTH)
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        for i, j in chunks(texts):
            word, at, first, end = words(texts[i:j])
            short = (word >> np.uint64(32)).astype(np.uint32).view(np.int32)
            zero = np.cumsum([0, *(len(x or "") + 1 for x in texts[i:j])])
            text = np.repeat(np.arange(j - i), [len(x) for x in spans[i:j]])
            begin = np.array([x["at"] for own in spans[i:j] for x in own], np.int64)
            size = np.array([x["n_words"] for own in spans[i:j] for x in own], np.int64)
            a, b = begin + at[text], begin + at[text] + size
            columns = [batch.column("text_hash").take(pa.array(i + text)), pa.array(begin, pa.int32()), pa.array(size, pa.int32())]
            for index, inside, edge in (
                (a[:, None] - 1 - reach, reach < begin[:, None], first),
                (b[:, None] + reach, reach < (at[text + 1] - b)[:, None], end),
            ):
                near = index[inside]
                offsets = pa.array(np.append(0, np.cumsum(inside.sum(1))), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(short[near])))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(edge[near] - np.repeat(zero[text], inside.sum(1)), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["text_hash", "at", "n_words", "before", "starts", "after", "ends"])


def _grown(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (stored; of runs of blocks) whose removed ones take in the words around them that are the same around what stays.

    If there is none at an end, up to TRIM - 1 words of the span that differ there are left out.
    Where both places are in one text the place that stays is left whole. Equal texts are looked at once.
    """
    same = F.expr("doc_id <=> keep_doc_id AND text_hash = _hash").alias("_same")
    asked = spans.where("removed").select("text_hash", "at", "n_words", "_hash", "_ahead", same).distinct()
    asked = stored(asked, "span-ends")
    # Keepers are often asked for: their places are made distinct before texts meet them.
    places = asked.select("text_hash", "at", "n_words").unionByName(asked.select(F.col("_hash").alias("text_hash"), F.expr("at - _ahead AS at"), "n_words")).distinct()
    places = places.groupBy("text_hash").agg(F.collect_list(F.struct("at", "n_words")).alias("spans"))
    held = spans.select("text_hash", "doc_id").unionByName(spans.select(F.col("_hash").alias("text_hash"), F.col("keep_doc_id").alias("doc_id"))).groupBy("text_hash").agg(F.min("doc_id").alias("_doc"))
    wanted = stored(places.join(held, "text_hash").withColumnRenamed("text_hash", "_wanted"), "span-places")
    one = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_doc"]) & (docs["text_hash"] == wanted["_wanted"])).select("text_hash", "text", "spans")
    schema = "text_hash long, at int, n_words int, before array<int>, starts array<long>, after array<int>, ends array<long>"
    ends = stored(one.mapInArrow(trimmed(_ends), schema), "ends").dropDuplicates(["text_hash", "at", "n_words"])
    kept = ends.select(F.col("text_hash").alias("_hash"), F.col("at").alias("_at"), "n_words", F.col("before").alias("_before"), F.col("starts").alias("_starts"), F.col("after").alias("_after"))
    met = asked.withColumn("_at", F.expr("at - _ahead")).join(ends, ["text_hash", "at", "n_words"]).join(kept, ["_hash", "_at", "n_words"])

    def change(a: str, b: str):
        """Words to take in at an end: the same ones before the first that isn't; or, negative, those to leave out."""
        equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        outer = F.slice(equal, TRIM + 1, GROWTH)
        stop, inner = F.array_position(outer, F.lit(False)), F.array_position(F.reverse(F.slice(equal, 1, TRIM)), F.lit(True))
        more = F.when(stop == 0, F.size(outer)).otherwise(stop - 1)
        return F.when((more > 0) | (inner == 0), more).otherwise(1 - inner).cast("int")

    met = met.withColumns({"_back": change("before", "_before"), "_on": change("after", "_after")})
    met = met.withColumn("_back", F.expr("if(_same, least(_back, greatest(_ahead - n_words, 0)), _back)"))
    met = met.withColumn("_on", F.expr("if(_same, least(_on, greatest(_ahead - n_words - _back, 0)), _on)")).where("_back != 0 OR _on != 0")
    # The end of a span as it is stands at TRIM - 1 of each list.
    ends = [F.expr(f"{x}[{TRIM - 1} + {n}] AS {name}") for x, n, name in (("starts", "_back", "_start"), ("ends", "_on", "_end"), ("_starts", "_back", "_keep_start"))]
    more = met.select("text_hash", "at", "n_words", "_hash", "_ahead", "_same", F.lit(True).alias("removed"), "_back", "_on", *ends)
    by = ["text_hash", "at", "n_words", "_hash", "_ahead", "_same", "removed"]
    out = spans.withColumn("_same", same).join(few(stored(more, "grown")), by, "left")
    out = out.withColumns({"start": F.coalesce("_start", "start"), "end": F.coalesce("_end", "end"), "keep_start": F.coalesce("_keep_start", "keep_start")})
    return out.withColumns({"n_words": F.expr("n_words + coalesce(_back + _on, 0)"), "at": F.expr("at - coalesce(_back, 0)")})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) of the units of each text."""
    for batch in batches:
        node, text = [], []
        for x, units in zip(batch.column("text").to_pylist(), batch.column("units").to_pylist(), strict=True):
            node += [u["node"] for u in units]
            text += [x[u["start"] : u["end"]] for u in units]
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(text, pa.string())], ["node", "text"])


def _classes(docs: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """The units of ``docs`` that occur more than once, and keep: the first occurrence of their class."""
    signs = stored(docs.mapInArrow(trimmed(_signed(min_words)), _SCHEMA), "units")
    shared = stored(signs.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    shared = small(shared, BROADCAST_KEYS)
    lines, blocks = signs.where("paragraph IS NOT NULL"), signs.where("paragraph IS NULL")
    hit = lines.select("node", F.explode("keys").alias("key")).join(shared, "key", "left_semi").select("node").distinct()
    lines = lines.join(small(stored(hit, "hit-lines"), BROADCAST_KEYS), "node", "left_semi")
    blocks = blocks.withColumn("key", F.element_at("keys", 1)).join(shared, "key", "left_semi")
    found = stored(lines.select(*signs.columns).unionByName(blocks.select(*signs.columns)), "survivors")
    discard(signs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "text_hash", "paragraph", "start", "end", "step", "gap")
    nodes = stored(found.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("keys").alias("keys")), "nodes")

    def texts_of(met: DataFrame) -> DataFrame:
        wanted = nodes.select("node", "first.*").join(met, "node", "left_semi").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
        wanted = stored(wanted.agg(F.collect_list(F.struct("node", "start", "end")).alias("units")), "met")
        one = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_doc"]) & (docs["text_hash"] == wanted["_hash"]))
        return one.select("text", "units").mapInArrow(_cut, "node long, text string").dropDuplicates(["node"])

    labels = classes(nodes.select("node", "keys"), Check(texts_of, lambda: None, threshold))
    own = nodes.select("node", "n", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = own.groupBy("label").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1").select("label", "keep")
    named = stored(own.select("node", "label").join(few(stored(groups, "groups")), "label").select("node", "keep"), "classes")
    return stored(found.join(few(named), "node").withColumn("removed", place != F.col("keep")), "repeated-units")


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = SIMILARITY, blocks: bool = True) -> DataFrame:
    """Every paragraph and every run of blocks that occurs more than once, up to similarity ``threshold``.

    Returns doc_id, paragraph (line from 0; null for a run of blocks), start and end (code points), n_words, keep_doc_id,
    keep_paragraph and keep_start (the first occurrence; rows without a doc_id come last), removed (false for that one).
    Links are verified Jaccard similarities of shingle sets; classes are components of links. Null and empty texts have
    no unit; texts of fewer than 51 words have no block. A paragraph that occurs twice in one text counts twice; blocks
    that overlap the one they repeat don't. Repeated rows of a document are occurrences too, and the
    rows of an occurrence that is kept are all kept; their runs of blocks are given once. Removed runs reach from the first
    to the last word that is the same around the kept place; rows that aren't removed give the blocks alone. An empty table
    gives an empty result; other columns of ``docs`` are left out. Without ``blocks`` only lines are given.
    """
    docs = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    found = _classes(docs, min_words, threshold)
    columns = ["doc_id", "paragraph", "start", "end", "n_words", "keep_doc_id", "keep_paragraph", "keep_start", "removed"]
    kept = [F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.paragraph").alias("keep_paragraph"), F.col("keep.start").alias("keep_start")]
    lines = found.where("paragraph IS NOT NULL").select("doc_id", "paragraph", "start", "end", "n_words", *kept, "removed")
    if not blocks:
        return lines.select(*columns)
    # Blocks that follow each other in both places are one span if they meet or the words between are the same there.
    apart = f"NOT (removed AND doc_id <=> keep.doc_id AND text_hash = keep.text_hash AND at < keep.at + {BLOCK_WORDS})"
    parts = found.where("paragraph IS NULL").where(apart).withColumn("_joins", F.expr("step = keep.step AND gap = keep.gap")).select("doc_id", "text_hash", "at", "start", "end", "step", "_joins", *kept, F.col("keep.text_hash").alias("_hash"), (F.col("at") - F.col("keep.at")).alias("_ahead"), "removed").distinct()
    run = ["doc_id", "text_hash", "keep_doc_id", "_hash", "_ahead", "removed"]
    order = Window.partitionBy(*run).orderBy("at")
    ahead = F.col("at") - F.lag("at").over(order)
    joined = (ahead <= BLOCK_WORDS) | (F.lag("_joins").over(order) & (F.lag("step").over(order) == ahead))
    new = (~F.coalesce(joined, F.lit(False))).cast("int")
    runs = parts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy(*run, "_run")
    size = (F.max("at") - F.min("at") + BLOCK_WORDS).cast("int").alias("n_words")
    spans = stored(runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), size, F.min("keep_start").alias("keep_start"), F.min("at").alias("at")).drop("_run"), "runs")
    # Spans that meet now they have grown are one.
    before = F.max(F.expr("at + n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = _grown(docs, spans).withColumn("_run", F.sum((~F.coalesce(F.col("at") <= before, F.lit(False))).cast("int")).over(order))
    spans = spans.groupBy(*run, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.expr("max(at + n_words) - min(at) AS n_words"), F.min("keep_start").alias("keep_start"))
    spans = spans.withColumns({"paragraph": F.lit(None).cast("int"), "keep_paragraph": F.lit(None).cast("int")})
    return lines.select(*columns).unionByName(spans.select(*columns))


def remove_paragraphs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the ``removed`` lines and spans of ``found`` taken out of ``text``; all other columns stay.

    A line goes with its line feed. Documents without a removal, null texts among them, stay as they are; so do
    rows without a doc_id if none of ``found`` has a null one. Rows with the same doc_id (or none) all lose what ``found`` has
    for it. Equal rows all stay. An empty table gives an empty result.
    """
    gone = found.where("removed").groupBy(F.col("doc_id").alias("__doc"))
    gone = gone.agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("end") + F.col("paragraph").isNotNull().cast("long")).alias("b")))).alias("__gone"))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                if text is not None and spans:
                    parts, at = [], 0
                    for span in spans:
                        parts.append(text[at : max(at, span["a"])])
                        at = max(at, span["b"])
                    last = at > len(text)  # the last line: the line feed before it goes
                    text = "".join([*parts, text[at:]])
                    text = text.removesuffix("\n") if last else text
                out.append(text)
            table_ = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))
            yield table_.drop_columns(["__doc", "__gone"])

    return joined.withColumn("text", F.col("text").cast("string")).mapInArrow(cut, docs.withColumn("text", F.col("text").cast("string")).schema)


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated paragraph and passage of all documents, and whether it is removed."""
    return repeated_paragraphs(table(spark, sf_dir, "documents"))
