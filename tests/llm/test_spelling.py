import re
import zlib
from collections import Counter, defaultdict

from docloom.llm import spelling
from docloom.llm.registry import queries
from docloom.llm.spelling import near_words, spelling_variants, words_of


def plain_words(docs):
    """The contract, run by run."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_pairs(words):
    """Pairs one edit apart, by all words with one letter left out at each place."""
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :], i].add(w)
    near = defaultdict(set)
    for (rest, _), group in holes.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    return near


def plain(words):
    near, form = plain_pairs(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(rows, key=str)


def test_words_and_forms_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries()["op13_spelling"](spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == plain(plain_words(docs)) and sum(r[1] is not None for r in got) > 1000


def test_edits_of_every_kind(spark):
    base = "conveyance"
    words = {base: 50}
    for i in range(len(base)):
        words |= {base[:i] + base[i + 1 :]: 2 * i + 3, base[:i] + "é" + base[i:]: 9, base[:i] + "z" + base[i + 1 :]: 30}
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaab": 24, "baaaa": 24, "abcde": 3, "abdce": 9}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling_variants(rows).collect()), key=str) == plain(words)


def test_crowded_signatures_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CROWD", 3)
    letters = "abcdefgh"
    words = {"stem" + x + y + z: 3 + (ord(x) * 7 + ord(y) + ord(z)) % 40 for x in letters for y in letters for z in letters} | {"stem" + x + y: 7 for x in letters for y in letters}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.a, r.b) for r in near_words(rows).collect()}
    near = plain_pairs(words)
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in near for b in near[a]} and len(got) == sum(map(len, near.values())) // 2


def test_odd_documents(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert dict(map(tuple, words_of(odd_docs).collect())) == plain_words(rows)
    assert spelling_variants(words_of(odd_docs.limit(0))).collect() == []
