import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tidemark.llm import registry, sentencepiece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a  b ", "\tx\n\n", "x\u0000y", "héllo ﬁ ① 😀", "<s> <0x41> ▁▁a", "ab" * 20_000, " " * 300 + "x" + " " * 77]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoder_equals_library():
    lib, rng = library(), random.Random(5)
    own = sentencepiece_bpe.Encoder(lib.serialized_model_proto())
    for _ in range(5000):
        text = "".join(rng.choice("  \tab\n▁éｱ😀theing0x<>s.\x00\xa0 ") for _ in range(rng.randrange(40)))
        assert own.encode(text) == lib.encode(text)


def test_small_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_PAIRS", 3)
    lib = library()
    own = sentencepiece_bpe.Encoder(lib.serialized_model_proto())
    text = "the things that were here and there " * 3
    assert own.encode(text) == lib.encode(text)


def test_encode_documents(spark, make_docs, sf_dir):
    lib = library()
    odd = make_docs([*enumerate(TEXTS), (None, "a"), (3, "a  b ")]).selectExpr("*", "'z' as ids_", "1 as c0")
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = sentencepiece_bpe.encode(docs, PATH)
        assert got.columns == [*docs.columns, "ids", "decoded"]
        for r in got.collect():
            assert r.ids == lib.encode(r.text or "") and r.decoded == lib.decode(r.ids)
    assert sentencepiece_bpe.encode(make_docs([]), PATH).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    lib, docs = library(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = Counter()
    for i, t in docs.items():
        ids = lib.encode(t)
        expect[i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))] += 1
    assert Counter(map(tuple, registry.QUERIES["op2_sentencepiece"](spark, sf_dir).collect())) == expect
