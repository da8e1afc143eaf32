import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from docloom.llm import langid, pii
from docloom.llm.registry import queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op1_language"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 150 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_paths_are_the_best(spark):
    random = np.random.default_rng(3)
    sizes = random.integers(0, 40, 60)
    at = np.concatenate(([0], np.cumsum(sizes)))
    scores = random.normal(0, 3, (at[-1], 3)).astype(np.float32)
    scores[at[5] : at[9]] += [9, 0, 0]  # some texts of one language
    label = langid.paths(scores, at, 4.0)
    for a, b in zip(at[:-1], at[1:], strict=True):
        own, way = scores[a:b].astype(float), label[a:b]
        best = np.zeros(3)
        for x in own:
            best = (best[:, None] - 4.0 * (1 - np.eye(3))).max(0) + x
        value = own[np.arange(b - a), way].sum() - 4.0 * (np.diff(way) != 0).sum()
        assert abs(value - best.max()) < 1e-3


def test_mixed_text_and_scripts(spark):
    english, french, russian = "the whole thing was there with them ", "les choses qui étaient là avec elles ", "это было очень хорошо для всех "
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([(english, "en"), (french, "fr"), (russian, "ru")] * 5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    text = english * 2 + french * 2 + russian
    (best, share, spans), *rest = langid.predict(model, [text, None, "", "12 !!", "日本語", "и"])
    assert [x.split(":")[0] for x in spans.split(",")] == ["en", "fr", "ru"]
    begins = [int(x.split(":")[1]) for x in spans.split(",")]
    assert begins == [0, len(english * 2), len(english * 2 + french * 2)]
    assert rest[:3] == [("und", 0.0, "")] * 3 and rest[3][0] in model.languages and rest[4][0] == "ru"
    assert langid.predict(langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")), ["a"]) == [("und", 0.0, "")]


def test_language_of_odd_rows(spark, odd_docs):
    model = langid.trained_on(odd_docs.drop("_language"))
    out = langid.label_documents(odd_docs.drop("_language"), model).collect()
    assert len(out) == 12
    assert {r["_language"].lang_pred for r in out if r.doc_id in (3, 4, 5)} == {"und"}


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= sum(c.isdigit() for c in s) <= 19 and luhn(s)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def plain(text):
    return [(kind, m.start(), m.end()) for kind, (p, good) in PATTERNS.items() for m in re.finditer(p, text) if good(m.group())]


def test_base_spans_by_plain_patterns():
    random = np.random.default_rng(1)
    parts = list("aZ0192..@@+- ()\n%_é") + ["a@b.c", "1.2.3.4", "4111111111111111", "+1 (269) 555-0123", " ", "4111 1111-1111 1111", "300.1.1.1"]
    for _ in range(4000):
        text = "".join(random.choice(parts, random.integers(1, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_pii_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = queries()["op10_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    added = 0
    for r in got:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        counts = defaultdict(int)
        for kind, _, _ in base:
            counts[kind] += 1
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PATTERNS)
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        added += r.n_added
    assert 0 < added < 0.2 * sum(len(plain(t)) for t in texts.values())


def test_crf_learns_and_decodes_the_best_path(spark):
    crf = pii.train(spark.createDataFrame([], "doc_id long, text string"))
    for text, spans in pii._labelled_rows():
        base, found = pii.all_spans(crf, [text])[0]
        assert set(found) - set(base) == set(spans) - set(base), text
    features, lengths = np.random.default_rng(0).integers(0, 50, (6, 4, 10)), np.array([4, 3, 1, 2, 4, 4])
    crf.emit[:50] = np.random.default_rng(1).normal(size=(50, len(pii.LABELS)))
    labels = crf.viterbi(features, lengths)
    size = len(pii.LABELS)
    for row, n, found in zip(features, lengths, labels, strict=True):
        score = crf.emit[row].sum(1)
        ways = np.array(np.meshgrid(*[range(size)] * n, indexing="ij")).reshape(n, -1)
        value = sum(score[i, ways[i]] for i in range(n)) + sum((crf.move[ways[i], ways[i + 1]] for i in range(n - 1)), 0)
        assert (ways[:, value.argmax()] == found[:n]).all()


def test_pii_of_odd_rows(spark, odd_docs):
    out = pii.find_pii(odd_docs).collect()
    assert len(out) == 12 and {r.spans for r in out} == {""}
    masked = pii.mask_pii(odd_docs).collect()
    assert [r.asDict() for r in masked] == [r.asDict() for r in odd_docs.collect()]
    rows = spark.createDataFrame([(1, "mail a.b@c.de or +1 (269) 555-0123 4111111111111111, 1.2.3.4."), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.mask_pii(rows).collect()] == ["mail <EMAIL> or <PHONE> <CARD>, <IP>.", None]
    assert pii.find_pii(odd_docs.limit(0)).count() == 0
