"""Byte-level BPE: ids against the library, the queue against repeated scans, digests, odd input."""

import hashlib
import random

import numpy as np
import pytest

from gaugeweave.llm import bpe, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "  ", "\n\n", "\t", "a", "x" * 5_000, "né \u0000漢字 😀", "a  b \n\tc\t\nd  ", "<|endoftext|>", "a <|endoftext|>  <|endoftext|>b<|endoft", "it's they'LL we'll 12 345 a1 '  's", "▁  x　y\u0085z", "é՘x ՘՘ ΀a \U000323b0b ࢏1", "abc <s> </s> <0x0A> <unk>", "\r\n};\r\n\t\r x", "ก็ " * 40]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def library(plain):
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = plain
    return lambda text: t.encode(text, add_special_tokens=False).ids, t


def some_texts(seed, n, alphabet="ab  \n\t'sé漢1!՘▁\r "):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(spark, sf, plain):
    encode, _ = library(plain)
    texts = ODD + some_texts(1, 300) + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.ids for r in bpe.encoded(docs(spark, texts).repartition(3), plain=plain).collect()}
    assert got == {i: None if t is None else encode(t) for i, t in enumerate(texts)}


def test_queue_equals_repeated_scans():
    v = bpe.Vocabulary.from_json()

    def scanned(symbols):
        while True:
            found = [(v.ranks[k], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (k := a << v.bits | b) in v.ranks]
            if not found:
                return symbols
            rank, i = min(found)
            symbols = [*symbols[:i], v.made[rank], *symbols[i + 2 :]]

    r = random.Random(2)
    for _ in range(300):
        s = [v.first[b] for b in "".join(r.choice("theanrs ") for _ in range(r.randrange(1, 60))).encode()]
        assert bpe.merged(list(s), v.ranks, v.made, v.bits) == scanned(s)


def test_digests_and_decoding(spark, sf):
    encode, t = library(False)
    texts = ODD * 2
    d = docs(spark, texts).withColumnRenamed("n_chars", "n_tokens").selectExpr("*", "1 as IDS", "2 as _text")
    for r in bpe.digests(d).collect():
        ids = encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs(spark, texts))).collect()}
    assert back == dict(enumerate(texts))
    assert bpe.digests(docs(spark, ["a"]).limit(0)).count() == 0
    rows = queries.QUERIES["op12_bpe"](spark, sf).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(text) and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in rows)


def test_small_tables_of_known_words_change_nothing(spark, monkeypatch):
    encode, _ = library(False)
    monkeypatch.setattr(bpe, "KNOWN", 3)
    monkeypatch.setattr(bpe, "LONG", 4)
    e = bpe.Encoder(bpe.Vocabulary.from_json(), bpe.unassigned())
    texts = some_texts(3, 200)
    assert [np.frombuffer(e(t), "<u4").tolist() for t in texts * 2] == [encode(t) for t in texts * 2]


def test_other_vocabularies_are_refused(tmp_path):
    (tmp_path / "v.json").write_text('{"model": {"type": "WordPiece"}, "added_tokens": [], "pre_tokenizer": null, "normalizer": null}')
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary.from_json(str(tmp_path / "v.json"))
