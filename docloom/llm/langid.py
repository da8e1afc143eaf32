"""Language ID: script ranges narrow the candidates, word scores and a Viterbi path label spans of mixed texts.

A word (a run of letters) is scored for every language by its letter trigrams, ends included. Languages
that aren't written in the word's script aren't candidates for it. Over the words of a text the best path
pays a penalty for each change of language; its spans are the labels, and the language with most letters
is the text's.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, trimmed
from .textarrays import chunks, code_points

#: First and last code point of the scripts that are told apart; all other letters are script 0.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(x[0] for x in SCRIPTS))
BUCKETS = 1 << 18
#: Documents of a language, about and at most in the mean, that the model is fitted on.
TRAINING_DOCS = 3000
#: What a change of language costs, in nats: about what three or four words of another language weigh.
SWITCH = 25.0
#: A language is a candidate for a script that has this share of its training letters.
SCRIPT_SHARE = 0.01
_OUT = -30.0
VITERBI_CHARS = 1_000_000


@functools.lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, its lower case (one character), its script's number."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    lower[~letter] = 0
    script = np.zeros(0x110000, np.int8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


def _trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams; each word's first trigram and letters; its first code point; each text's first word.

    A word of n letters has n trigrams: each letter with its neighbours, where an end counts as 0.
    """
    letter, lower, _ = _letters()
    points, starts = code_points(texts)
    inside = letter[points]
    low = lower[points].astype(np.uint32)
    at = np.flatnonzero(inside)  # the last character of all is a line feed
    left = np.where(at > 0, low[at - 1], 0)
    bucket = (left * np.uint32(0x9E3779B1)) ^ (low[at] * np.uint32(0x85EBCA77)) ^ (low[np.minimum(at + 1, len(low) - 1)] * np.uint32(0xC2B2AE3D))
    bucket ^= bucket >> np.uint32(15)
    bucket *= np.uint32(0x2C1B3C6D)
    bucket >>= np.uint32(14)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1))) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(at)))
    begin = at[first] if len(at) else at
    return bucket, first, count, begin, np.searchsorted(begin, starts)


@dataclass
class Model:
    """languages; scores [BUCKETS, languages]; scripts [scripts, languages]: who is a candidate."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def fit(rows: DataFrame, n_docs: int = TRAINING_DOCS) -> Model:
    """A model from ``rows`` (text, lang, and doc_id to choose by); rows without text or lang teach nothing.

    At most about ``n_docs`` documents of each language are taken, by a hash of their ids. Their trigrams
    are counted on the executors; what reaches the driver is bounded by languages times BUCKETS.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > n_docs:
            share = F.when(F.col("lang") == lang, F.lit(n_docs / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.ceil(share * (1 << 40)))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, script = _letters()
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                texts = own["text"].tolist()
                for a, b in chunks(texts):
                    bucket, *_ = _trigrams(texts[a:b])
                    points, _ = code_points(texts[a:b])
                    scripts = np.bincount(script[points[_letters()[0][points]]], minlength=len(SCRIPT_NAMES))
                    n = np.bincount(bucket, minlength=BUCKETS)
                    seen = np.flatnonzero(n)
                    yield pd.DataFrame({"lang": lang, "bucket": np.append(seen, BUCKETS + np.arange(len(scripts))), "n": np.append(n[seen], scripts)})

    found = sample.mapInPandas(trimmed(counts), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table_ = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    table_[found["bucket"].to_numpy(np.int64), [languages.index(x) for x in found["lang"]]] = found["n"]
    n, scripts = table_[:BUCKETS], table_[BUCKETS:]
    used = max(1, int((n.sum(1) > 0).sum()))
    scores = np.log((n + 0.5) / (n.sum(0) + 0.5 * used))
    scores -= scores.mean(1, keepdims=True) if len(languages) else 0
    return Model(languages, scores.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def word_scores(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores [words, languages]; letters and first code point (in its text) of each word; each text's first word."""
    _, _, script = _letters()
    parts, counts, begins, firsts, done = [], [], [], [0], 0
    for a, b in chunks(texts):
        bucket, first, count, begin, at = _trigrams(texts[a:b])
        own = np.add.reduceat(model.scores[bucket], first, axis=0) if len(first) else np.zeros((0, len(model.languages)), np.float32)
        points, starts = code_points(texts[a:b])
        allowed = model.scripts[script[points[begin]]]
        known = allowed.any(1, keepdims=True)
        parts.append(np.where(known, np.where(allowed, own, own + _OUT), 0).astype(np.float32))
        counts.append(count)
        begins.append(begin - np.repeat(starts[:-1], np.diff(at)))
        firsts += (done + at[1:]).tolist()
        done += len(first)
    return np.concatenate(parts), np.concatenate(counts), np.concatenate(begins), np.array(firsts, np.int64)


def _no_change(scores: np.ndarray, at: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's best single language, and whether no path with a change can beat it.

    It can't if no stretch of words favours another language over it by ``switch``: each stretch that a path
    gives to another language costs one change at least.
    """
    n = len(at) - 1
    total = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores, axis=0, dtype=np.float64, out=total[1:])
    best = (total[at[1:]] - total[at[:-1]]).argmax(1)
    text = np.repeat(np.arange(n), np.diff(at))
    own = np.take_along_axis(scores, best[text][:, None], 1)[:, 0] if len(scores) else np.zeros(0)
    fixed = np.ones(n, bool)
    for k in range(scores.shape[1]):
        ahead = np.cumsum(scores[:, k] - own, dtype=np.float64)
        drop = (np.abs(scores[:, k] - own).sum() + 1.0) * text  # a running minimum begins anew with each text
        before = ahead - (scores[:, k] - own)
        rise = ahead - drop - np.minimum.accumulate(before - drop)
        if len(rise):
            fixed[np.unique(text[rise >= switch])] = False
    return best, fixed


def paths(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path of its text; texts go side by side, longest first."""
    best, fixed = _no_change(scores, at, switch)
    out = np.repeat(best, np.diff(at)).astype(np.int16)
    size = np.diff(at)
    mixed = np.flatnonzero(~fixed)
    mixed = mixed[np.argsort(-size[mixed], kind="stable")]
    if not len(mixed):
        return out
    size, start = size[mixed], at[:-1][mixed]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t words
    value = np.zeros((len(mixed), scores.shape[1]), np.float32)
    switched, source = [], []
    for t in range(size[0]):
        n = int(active[t])
        now = value[:n]
        top = now.argmax(1)
        least = now[np.arange(n), top] - np.float32(switch)
        change = now < least[:, None]
        switched.append(change)
        source.append(top.astype(np.int16))
        value[:n] = np.where(change, least[:, None], now) + scores[start[:n] + t]
    label = value.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        n = int(active[t])
        own = label[:n]
        out[start[:n] + t] = own
        if t:
            label[:n] = np.where(switched[t][np.arange(n), own], source[t], own)
    return out


def predict(model: Model, texts: list, switch: float = SWITCH) -> list[tuple[str, float, str]]:
    """(language, score, spans) of each text.

    The language is the one with most letters on the path (the first by name of equals), the score its share
    of all letters, and spans are ``language:start:end`` in code points, comma-joined. Null, empty and
    letterless texts, and a model without languages, give ``und``, 0 and no span.
    """
    out: list[tuple[str, float, str]] = []
    for a, b in chunks(texts, VITERBI_CHARS):
        if not model.languages:
            out += [("und", 0.0, "")] * (b - a)
            continue
        scores, letters, begin, at = word_scores(model, texts[a:b])
        label = paths(scores, at, switch)
        text = np.repeat(np.arange(b - a), np.diff(at))
        share = np.zeros((b - a, len(model.languages)))
        np.add.at(share, (text, label), letters)
        total = share.sum(1)
        best = share.argmax(1)
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(label) != 0) | (np.diff(text) != 0)))) if len(label) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(label))[: len(edge)] - 1
        ends = begin[last] + letters[last] if len(label) else last
        spans: list[list[str]] = [[] for _ in range(b - a)]
        for i, lang, x, y in zip(text[edge].tolist(), label[edge].tolist(), begin[edge].tolist(), ends.tolist(), strict=True):
            spans[i].append(f"{model.languages[lang]}:{x}:{y}")
        for i in range(b - a):
            out.append((model.languages[best[i]], float(share[i, best[i]] / total[i]), ",".join(spans[i])) if total[i] else ("und", 0.0, ""))
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def label_documents(docs: DataFrame, model: Model, switch: float = SWITCH, name: str = "_language") -> DataFrame:
    """``docs`` with lang_pred, score and spans in a struct column ``name``; all other columns stay as they are.

    Null, empty and letterless texts get ``und``, 0 and no span; of languages with the same share of letters the first by
    name counts. Repeated rows all stay. An empty table gives an empty result, a column called ``name`` before is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(predict(shared.value, texts.tolist(), switch), columns=["lang_pred", "score", "spans"])

    @F.pandas_udf("lang_pred string, score double, spans string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from trimmed(rows)(batches)

    # Called nondeterministic, it is run once: else Spark runs it in a filter on its fields and once more for the rows kept.
    return docs.withColumn(name, label.asNondeterministic()(F.col("text").cast("string")))


def trained_on(docs: DataFrame) -> Model:
    """The model of the documents that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return fit(rows.where(~held_out(F.col("doc_id"))))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = trained_on(docs)
    labelled = label_documents(docs.select("doc_id", "text"), model)
    return labelled.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "_language.lang_pred", "_language.score", "_language.spans")
