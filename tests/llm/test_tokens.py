import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from docloom.llm import piececache
from docloom.llm.idpacking import PieceEncoder, pack, read_ids, read_text_ids, unpack, write_ids
from docloom.llm.registry import queries
from docloom.llm.spm import Transducer, encode_decode
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a\n b", "x\n  foo \t\n", "a\x1c b  ", "é  ü\r\n\n ok", " a", "a ", "a  b c\u3000 d", "\u2581x y", "ﬁ é Ａ \U0001f600 中文 дом", "a" * 300, "\n\n", "<s> </s> <|endoftext|>", "1234 99 3.14", None]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    payload = pack(ids, width)
    assert len(payload) == (1000 * width + 7) // 8
    for a, b in ((0, 1000), (3, 4), (17, 900), (1000, 1000)):
        assert (unpack(payload, width, a, b) == ids[a:b]).all()


def test_pieces_give_the_library_s_ids(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    encoder = PieceEncoder(BPE)
    want = [x.ids for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for a in range(0, len(texts), 50):
        ids, at = encoder(texts[a : a + 50])
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == want[a : a + 50]


def test_forgetting_changes_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(piececache, "KEPT_PIECES", 500)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    encoder, model = PieceEncoder(BPE), Transducer(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in texts:
        assert encoder([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert model([text])[0].tolist() == library.encode(text)


def test_files_hold_every_text(spark, sf):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    start = 0
    got = sorted(queries()["op5_token_ids"](spark, sf).collect())
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    for row, (doc_id, text) in zip(got, docs, strict=True):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_odd_rows(spark, odd_docs):
    blocks = write_ids(odd_docs, BPE, 0)
    got = read_ids(blocks).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r.n_tokens for r in got if r.doc_id in (3, 4)] == [1, 1]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert read_text_ids(blocks, [7]).collect()[0].ids == Tokenizer.from_file(BPE).encode("one two").ids + [0]
    assert read_ids(write_ids(odd_docs.limit(0), BPE)).count() == 0


def test_transducer_gives_the_library_s_ids(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = Transducer(MODEL)
    texts = [x for x in ODD if x] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    ids, at = model(texts)
    want = library.encode(texts)
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == want
    assert model.decode(ids, at) == [library.decode(x) for x in want]


def test_transducer_on_random_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = Transducer(MODEL)
    random = np.random.default_rng(5)
    letters = list("aaabeinorst  \n\tzéß中0123.,\u2581\U0001f600")
    texts = ["".join(random.choice(letters, random.integers(1, 40))) for _ in range(3000)]
    ids, at = model(texts)
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == library.encode(texts)


def test_encode_decode_of_odd_rows(spark, odd_docs):
    rows = encode_decode(odd_docs, MODEL).collect()
    assert len(rows) == 12 and all(r.round_trip for r in rows)
    assert [r.ids for r in rows if r.doc_id in (3, 4)] == [[], []]
    assert encode_decode(odd_docs.limit(0), MODEL).count() == 0


def test_sentencepiece_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    for row in queries()["op8_sentencepiece"](spark, sf).collect():
        want = library.encode(texts[row.doc_id])
        assert row.ids == want and row.n_tokens == len(want) and row.round_trip
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
