import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from docloom.llm import decontaminate, minhash, neardup, paragraphs
from docloom.llm.decontaminate import contaminated
from docloom.llm.registry import oracle_sql, queries

from .conftest import sentence


def brute_pairs(items):
    """Pairs of items (Counters of shingles) that share one, with their weighted Jaccard similarity."""
    where = defaultdict(list)
    for i, own in enumerate(items):
        for x in own:
            where[x].append(i)
    common = Counter()
    for x, own in where.items():
        for i, j in combinations(own, 2):
            common[i, j] += min(items[i][x], items[j][x])
    total = [sum(x.values()) for x in items]
    for (i, j), c in common.items():
        yield i, j, c / (total[i] + total[j] - c)


def brute_classes(items, threshold=0.8):
    """Least index of each component of weighted Jaccard links; items are Counters of shingles."""
    up = list(range(len(items)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j, similarity in brute_pairs(items):
        if similarity >= threshold:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return [find(i) for i in range(len(items))]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_documents_by_brute_force(spark, sf):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    frequency = Counter(w for _, t in docs for w in set(words(t)))
    n = len(docs)
    idf = {w: round(1000 * (1 + np.log(n / max(f, 1)))) for w, f in frequency.items()}
    items = []
    for _, text in docs:
        own = Counter(shingles(text))
        items.append(Counter({s: k * (sum(idf[w] for w in s) // len(s)) for s, k in own.items()}))
    want = {docs[i][0]: docs[c][0] for i, c in enumerate(brute_classes(items))}
    assert {r.doc_id: r.class_id for r in queries()["op4_near_duplicates"](spark, sf).collect()} == want
    assert len(set(want.values())) < n


def test_paragraphs_by_brute_force(spark, sf):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    lines = [(d, k, x) for d, t in docs for k, x in enumerate(t.split("\n")) if len(words(x)) >= paragraphs.MIN_WORDS]
    found = brute_classes([Counter(set(shingles(x))) for _, _, x in lines])
    size = Counter(found)
    want = {(*lines[i][:2], *lines[c][:2], i != c) for i, c in enumerate(found) if size[c] > 1}
    got = queries()["op2_paragraphs"](spark, sf).where("paragraph IS NOT NULL").collect()
    assert {(r.doc_id, r.paragraph, r.keep_doc_id, r.keep_paragraph, r.removed) for r in got} == want and len(got) == len(want)
    texts = dict(docs)
    assert all(texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[r.paragraph] for r in got)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_repeated_passages_by_brute_force(spark, size):
    """Each run of 51 words that another document has too overlaps a row, a removed one but where it occurs first; runs of blocks repeat what they say."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    texts = dict(sorted(map(tuple, docs.select("doc_id", "text").where("text IS NOT NULL").collect())))
    where, at = defaultdict(list), {}
    for d, text in texts.items():
        found = list(re.finditer(r"[^\W_]+", text.lower()))
        at[d] = [m.span() for m in found]
        for i in range(len(found) - 50):
            where[hash(tuple(m.group() for m in found[i : i + 51]))].append((d, i))
    spans, removed = defaultdict(set), defaultdict(set)
    rows = queries()["op2_paragraphs"](spark, f"/root/testdata/{size}").collect()
    for r in rows:
        own = {i for i, (a, b) in enumerate(at[r.doc_id]) if r.start <= a and b <= r.end}
        spans[r.doc_id] |= own
        removed[r.doc_id] |= own if r.removed else set()
    seen = 0
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                seen += 1
                assert not (removed if d != places[0][0] else spans)[d].isdisjoint(range(i, i + 51)), (d, i)
    assert seen > 1000
    for r in rows:
        if r.paragraph is None:
            a, b = set(shingles(" ".join(words(texts[r.doc_id][r.start :])[:20]))), set(shingles(" ".join(words(texts[r.keep_doc_id][r.keep_start :])[:20])))
            assert min(len(a), len(b)) < 10 or len(a & b) >= 0.5 * len(a | b), (r, a, b)  # chains of links may lie between, of words that repeat themselves long ones
            assert r.removed == ((r.doc_id, r.start) != (r.keep_doc_id, r.keep_start))


def test_near_copies_by_similarity(spark):
    """Of all pairs with a similarity of 0.8 or more, by tenths, those of one class: at sf0.01, against all rows."""
    path = "/root/testdata/sf0.01"
    docs = sorted(map(tuple, spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()))
    frequency = Counter(w for _, t in docs for w in set(words(t)))
    idf = {w: round(1000 * (1 + np.log(len(docs) / max(f, 1)))) for w, f in frequency.items()}
    items = [Counter({s: k * (sum(idf[w] for w in s) // len(s)) for s, k in Counter(shingles(t)).items()}) for _, t in docs]
    got = {r.doc_id: r.class_id for r in queries()["op4_near_duplicates"](spark, path).collect()}
    hit, total = Counter(), Counter()
    for i, j, x in brute_pairs(items):
        if x >= 0.8:
            total[int(x * 10)] += 1
            hit[int(x * 10)] += got[docs[i][0]] == got[docs[j][0]]
    assert all(hit[k] >= 0.99 * total[k] for k in total) and total[8] and total[10]
    linked = {docs[c][0] for c in brute_classes(items)}
    assert len(set(got.values()) ^ linked) <= 2


def test_decontamination_by_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, item_id, similarity FROM ({oracle_sql()['op3_decontamination']})").fetchall())
    got = queries()["op3_decontamination"](spark, sf).select("doc_id", "item_id", "similarity").collect()
    assert sorted(map(tuple, got)) == want and want


def test_large_groups_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CLOSE", 4)
    base = sentence(3, 200).split()
    rows = []
    for i in range(60):
        own = list(base)
        own[(3 * i) % 200] = f"new{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base)) for i in range(40)] + [(200 + i, sentence(50 + i, 80)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert {got[i] for i in [*range(60), *range(100, 140)]} == {0}
    assert [got[200 + i] for i in range(5)] == [200 + i for i in range(5)]


def test_no_link_of_a_bucket_is_lost(spark, monkeypatch):
    """Numbers within 2 are similar; all are in one bucket, and no pivot is similar to all."""
    monkeypatch.setattr(neardup, "CLOSE", 3)
    numbers = [1, 2, 4, 6, 20, 21, 40, 60, 62, 64, 66, 68]
    nodes = spark.createDataFrame([(x, [7] * 8) for x in numbers], "node long, keys array<long>")

    class Numbers:
        threshold = 0.2

        def bind(self, met):
            pass

        def links(self, pairs):
            return pairs.where("abs(a - b) <= 2")

        def prefixes(self, nodes):
            return nodes.selectExpr("node", "3L AS total", "posexplode(array(node - 1, node, node + 1)) AS (before, key)")

    got = {r.node: r.label for r in neardup.classes(nodes, Numbers()).collect()}
    assert {x: got.get(x, x) for x in numbers} == {1: 1, 2: 1, 4: 1, 6: 1, 20: 20, 21: 20, 40: 40, 60: 60, 62: 60, 64: 60, 66: 60, 68: 60}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100) if i != 50] + [(3, 3)], "a long, b long")
    assert {r.node: r.label for r in neardup.components(edges).collect()} == {i: 0 if i <= 50 else 51 for i in range(101)}


def test_weighted_sampling_follows_similarity():
    random = np.random.default_rng(2)
    hashes = np.sort(random.integers(0, 1 << 63, 400).astype(np.uint64))
    hit = total = 0
    for _ in range(60):
        a, b = random.integers(1, 9, 400), random.integers(1, 9, 400)
        h = np.sort(random.integers(0, 1 << 63, 400).astype(np.uint64))
        keys = neardup.signatures(np.concatenate((h, h)), np.concatenate((a, b)), np.array([0, 400, 800]), True)[1]
        hit += (keys[0] == keys[1]).sum()
        total += neardup.BANDS * (np.minimum(a, b).sum() / np.maximum(a, b).sum()) ** neardup.BAND_ROWS
    assert abs(hit - total) < 4 * total**0.5 and len(hashes)


def test_odd_rows(spark, odd_docs):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.class_id) for r in minhash.near_duplicates(odd_docs).collect())
    assert [(b, c) for _, b, c in got] == [(0, 9), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (10, 10)]
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0
    found = paragraphs.repeated_paragraphs(odd_docs)
    rows = found.where("paragraph IS NOT NULL").collect()
    assert {(r.doc_id, r.paragraph, r.removed) for r in rows if r.keep_doc_id == 1} == {(1, 0, False), (2, 0, True), (10, 1, True)}
    assert {(r.doc_id, r.removed) for r in found.where("paragraph IS NULL").collect()} >= {(1, False), (2, True), (10, True), (9, False), (None, True)}
    left = paragraphs.remove_paragraphs(odd_docs, found)
    assert left.columns == odd_docs.columns and left.count() == 12
    assert {r.doc_id: r.text for r in left.collect()}[10] == sentence(9, 40)
    assert paragraphs.repeated_paragraphs(odd_docs.limit(0)).count() == 0


def test_odd_items(spark, odd_docs):
    items = spark.createDataFrame([(1, sentence(2, 60)), (1, sentence(2, 60)), (2, None), (3, ""), (4, "one two"), (5, sentence(1, 30)), (6, sentence(7, 300))], "item_id long, text string").withColumnRenamed("x", "s")
    rows = {(r.doc_id, r.item_id, r.similarity, r.word) for r in contaminated(odd_docs, items).collect()}
    assert rows == {(None, 1, 1.0, 0), (9, 1, 1.0, 0), (1, 5, 1.0, 0), (2, 5, 1.0, 0), (10, 5, 1.0, 40), (6, 5, 1.0, 50)}
    assert contaminated(odd_docs.limit(0), items).count() == 0 and contaminated(odd_docs, items.limit(0)).count() == 0
    long_doc = spark.createDataFrame([(1, sentence(1, 20) + " " + sentence(7, 300))], "doc_id long, text string")
    assert [(r.item_id, r.similarity, r.word) for r in contaminated(long_doc, items.where("item_id = 6")).collect()] == [(6, 1.0, 20)]


def test_an_edited_item_is_found(spark):
    item = sentence(4, 80)
    edited = item.split()
    edited[37] = "changed"
    docs = spark.createDataFrame([(1, "Before. " + " ".join(edited) + " after it"), (2, sentence(5, 90))], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.word) for r in got] == [(1, 9, 1)] and got[0].similarity == round(71 / 81, 6)


def test_paragraphs_of_rows_without_a_doc_id(spark, monkeypatch):
    """A row without a doc_id, first of all, in a group of near copies of its line, and several such rows."""
    monkeypatch.setattr(neardup, "CLOSE", 4)
    base = sentence(21, 200).split()

    def edited(i):
        return " ".join("new" if k == 3 * i + 20 else w for k, w in enumerate(base))

    rows = [(None, " ".join(base)), (None, edited(50)), *((i, edited(i)) for i in range(1, 12)), (90, sentence(22, 60)), (None, sentence(23, 60)), (91, sentence(23, 60) + " more")]
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("paragraph IS NOT NULL").collect()
    want = {(None, 0, 1, True), (1, 0, 1, False), *((i, 0, 1, True) for i in range(2, 12)), (91, 0, 91, False), (None, 0, 91, True)}
    assert {(r.doc_id, r.paragraph, r.keep_doc_id, r.removed) for r in got} == want and len(got) == 15


def test_links_beside_a_large_pivot(spark, monkeypatch):
    """All band keys equal, the pivot the largest node: texts with little and with much outside it, and excerpts of the pivot."""
    monkeypatch.setattr(neardup, "CLOSE", 3)
    pivot = sentence(40, 1000).split()
    start, own = " ".join(pivot[:300]), sentence(41, 190)
    texts = {
        1: f"{start} {own}", 2: f"{start} {own} {sentence(42, 16)}",  # 0.39 and 0.41 outside
        3: " ".join(pivot[500:700]), 4: " ".join(pivot[500:690]),  # nothing outside
        5: " ".join(pivot[750:950]) + " " + sentence(43, 5), 6: sentence(44, 5) + " " + " ".join(pivot[750:950]),  # nothing in common outside
        1000: " ".join(pivot),
    } | {10 + i: sentence(50 + i, 100) for i in range(6)}
    nodes = spark.createDataFrame([(x, [7] * 8) for x in texts], "node long, keys array<long>")
    held = spark.createDataFrame(list(texts.items()), "node long, text string")
    got = {r.node: r.label for r in neardup.classes(nodes, neardup.Check(lambda met: held, lambda: None, 0.8)).collect()}
    assert {x: got.get(x, x) for x in texts} == {x: {2: 1, 4: 3, 6: 5}.get(x, x) for x in texts}


def test_items_longer_than_the_short_counters(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHORT_ITEM", 200)
    item = sentence(31, 700)
    edited = item.split()
    edited[350] = "changed"
    docs = spark.createDataFrame([(1, "x y z " + " ".join(edited) + " end"), (2, sentence(32, 900)), (3, item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, sentence(33, 40))], "item_id long, text string")
    got = sorted(tuple(r) for r in contaminated(docs, items).collect())
    assert got == [(1, 1, round(691 / 701, 6), 3), (3, 1, 1.0, 0)]


def test_only_compared_words_are_removed(spark):
    """Copies of a long text with words of their own put in: none of these goes, and words of the text go where they were compared."""
    base = sentence(41, 1200).split()
    lines = lambda words_, n: "\n".join(" ".join(words_[i : i + n]) for i in range(0, len(words_), n))  # noqa: E731  (all too short to count as lines)
    rows, own = [(0, lines(base, 13))], {}
    for d, (step, kind) in enumerate([(23, "in"), (40, "in"), (57, "in"), (40, "for"), (90, "for"), (400, "for")], 1):
        new = [f"own{d}x{k}" for k in range(len(base))]
        text = [w for k, x in enumerate(base) for w in ([x] if k % step else [new[k]] if kind == "for" else [new[k], x])]
        own[d] = set(new)
        rows.append((d, lines(text, 11 + d)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = [set(shingles(" ".join(base[i : i + 20]))) for i in range(len(base) - 19)]

    def verified(block):
        """Whether 20 words are as similar to a block of the text as links are."""
        x = set(shingles(" ".join(block)))
        return any(len(x & y) >= 0.8 * len(x | y) for y in blocks)

    gone = {d: 0 for d in own}
    for r in paragraphs.repeated_paragraphs(docs).where("removed").collect():
        taken = dict(rows)[r.doc_id][r.start : r.end].split()
        gone[r.doc_id] += len(taken)
        for p in (p for p, w in enumerate(taken) if w in own[r.doc_id]):  # only at the end of a block that was verified as a whole
            assert any(verified(taken[i : i + 20]) for i in range(max(0, p - 19), min(p, len(taken) - 20) + 1)), (r, taken[p])
    assert gone[6] > 1000 and gone[5] > 600 and gone[3] > 300, gone
    left = {r.doc_id: r.text for r in paragraphs.remove_paragraphs(docs, paragraphs.repeated_paragraphs(docs)).collect()}
    assert left[0] == rows[0][1]
    for d in own:
        before, after = dict(rows)[d].split(), left[d].split()
        assert len(after) >= len(before) - gone[d] and len(own[d] & set(after)) >= 0.8 * len(own[d] & set(before))


@pytest.mark.parametrize("n", [51, 60, 100, 200])
def test_passages_go_whole_and_nothing_else(spark, n):
    """Exact passages of n words in mid-line, and one twice in a text: all their words go but where they stand first, and no other word."""
    rows, want = [], {}
    for k in range(30):
        passage = sentence(1000 + k, n)
        for d in (2 * k, 2 * k + 1):
            rows.append((d, f"{sentence(2000 + d, 90)} {passage} {sentence(3000 + d, 80)}"))
        want[2 * k + 1] = passage
    twice = sentence(900, n)
    rows += [(100, f"{twice} {twice} {sentence(901, 70)}"), (101, sentence(902, 60) + " " + sentence(903, n).upper()), (None, sentence(903, n) + ". " + sentence(904, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {d: t.lower() for d, t in rows}
    expected = {(d, p, n, d - 1, texts[d - 1].index(p)) for d, p in want.items()} | {(None, sentence(903, n), n, 101, texts[101].index(sentence(903, n)))}
    got, gone = set(), defaultdict(set)
    for r in paragraphs.repeated_paragraphs(docs).where("removed AND paragraph IS NULL").collect():
        got.add((r.doc_id, texts[r.doc_id][r.start : r.end], r.n_words, r.keep_doc_id, r.keep_start))
        gone[r.doc_id] |= set(range(r.start, r.end))
    assert expected <= got  # blocks that are similar one word further along are rows too
    spans = {d: set(range(texts[d].index(p), texts[d].index(p) + len(p))) for d, p in {**want, None: sentence(903, n)}.items()}
    assert dict(gone) == {**spans, 100: set(range(len(twice) + 1, 2 * len(twice) + 1))}


def test_share_of_repeated_words_that_go(spark):
    """Of the words at sf0.01 in runs of 51 that an earlier document has too: what stays, over all and over documents that are half such words at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(sorted(map(tuple, docs.select("doc_id", "text").where("text IS NOT NULL").collect())))
    at, first, repeated = {}, {}, defaultdict(set)
    for d, text in texts.items():
        found = list(re.finditer(r"[^\W_]+", text.lower()))
        at[d] = [m.span() for m in found]
        for i in range(len(found) - 50):
            if first.setdefault(hash(tuple(m.group() for m in found[i : i + 51])), d) != d:
                repeated[d].update(range(i, i + 51))
    gone = defaultdict(set)
    for r in queries()["op2_paragraphs"](spark, "/root/testdata/sf0.01").where("removed").collect():
        gone[r.doc_id] |= {i for i, (a, b) in enumerate(at[r.doc_id]) if r.start <= a and b <= r.end}
    share = lambda ids: sum(len(repeated[d] & gone[d]) for d in ids) / sum(len(repeated[d]) for d in ids)
    partial = [d for d, own in repeated.items() if 2 * len(own) <= len(at[d])]
    assert partial and (share(list(repeated)), share(partial)) >= (0.98, 0.95) and share(partial) >= 0.95
