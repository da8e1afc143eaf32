import duckdb
import numpy as np
import pytest
from docloom.llm import linededup
from docloom.llm.linededup import Cuckoo, build_index, delete_documents, drop_repeated_lines, insert_documents
from docloom.llm.registry import oracle_sql, queries
from pyspark.sql import functions as F


def plain(rows):
    """(doc_id, text) rows after dropping, by the contract."""
    holders = {}

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(linededup.NO_ID if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (key(x) in holders and min(holders[key(x)]) < (linededup.NO_ID if doc_id is None else doc_id))]
        out.append((doc_id, None if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def cleaned(docs, index):
    return sorted(map(tuple, drop_repeated_lines(docs, index).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_result_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(oracle_sql()["op12_lines"]).fetchall())
    assert sorted(map(tuple, queries()["op12_lines"](spark, sf).collect())) == want and sum(r[2] for r in want) > 50


LINES = ["First shared line", "  FIRST shared LINE\t", "Second shared line", "short", "", "Ünïcode Änd spaces", "ünïcode Änd spaces", "ÜNïcode Änd spaces", "only here, number %d"]


def some_docs(n, start=0):
    return [(start + i, "\n".join(x % i if "%" in x else x for j, x in enumerate(LINES) if (i * 7 + j * 3) % 5 < 3)) for i in range(n)]


def test_odd_documents(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()] + some_docs(20) + [(None, LINES[0]), (None, LINES[0] + "\n" + LINES[2]), (-5, LINES[2]), (-5, LINES[2] + "\n" + LINES[2])]
    docs = spark.createDataFrame([(*r, 1, "h", 2, None) for r in rows], "doc_id long, text string, n_lines int, holder string, k1 int, gone string")
    assert cleaned(docs.select("doc_id", "text"), build_index(docs)) == plain(rows)
    out = drop_repeated_lines(docs, build_index(docs))
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"] and out.count() == len(rows)
    assert out.agg(F.sum("n_lines"), F.count("gone")).first() == (len(rows), 0)
    assert cleaned(docs.limit(0), build_index(docs.limit(0))) == []


def test_insertions_and_deletions_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_LINES", 5)
    monkeypatch.setattr(linededup, "HOT_SHARE", 0.2)
    a, b, c = some_docs(6, 10), some_docs(9, 0), [(100 + i, f"line of many number {j}\n{LINES[2]}") for i in range(3) for j in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = build_index(frame(a))
    index = insert_documents(index, frame(b))
    assert cleaned(frame(a + b), index) == plain(a + b)
    fuller = insert_documents(index, frame(c))
    assert cleaned(frame(a + b + c), fuller) == plain(a + b + c)
    again = delete_documents(fuller, frame(c))
    assert cleaned(frame(a + b), again) == plain(a + b)
    state = lambda x: sorted(map(tuple, x.references().collect()))
    assert state(again) == state(index)
    slots = lambda x: {r.slot: len(Cuckoo.load(r["filter"])) for r in x.filters.collect() if len(Cuckoo.load(r["filter"]))}
    assert slots(again) == slots(index)
    first_gone = delete_documents(again, frame(b[:3]))
    assert cleaned(frame(a + b[3:]), first_gone) == plain(a + b[3:])
    assert state(delete_documents(first_gone, frame(a + b[3:]))) == []


def test_cuckoo_filter(monkeypatch):
    monkeypatch.setattr(linededup, "BUCKETS", 1 << 8)
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    cuckoo = Cuckoo()
    cuckoo.add(keys[:700])
    assert cuckoo.slots.shape[1] == 4 and cuckoo.contains(keys[:700]).all() and len(cuckoo) == 700
    assert cuckoo.contains(keys[700:]).mean() < 0.01
    cuckoo.add(keys[700:3000])
    cuckoo.add(keys[:700])  # once more each
    assert cuckoo.slots.shape[1] > 4 and len(cuckoo) == 3700
    cuckoo = Cuckoo.load(cuckoo.dump())
    cuckoo.remove(keys[:1500])
    assert cuckoo.contains(keys[:700]).all() and cuckoo.contains(keys[1500:3000]).all() and len(cuckoo) == 2200
    cuckoo.remove(keys[:700])
    cuckoo.remove(keys[1500:3000])
    assert len(cuckoo) == 0
    cuckoo.add(np.zeros(9, np.int64))  # more than two buckets hold
    assert len(cuckoo) == 9
