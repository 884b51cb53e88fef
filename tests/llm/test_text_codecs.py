"""SentencePiece BPE, token files and WARC against the libraries, round trips and damage."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from orrery.llm import sentencepiece_bpe, tokenfile, warc
from orrery.llm.common import shared_dir

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

HARD = [
    None, "", " ", "  ", " a", "a ", "a  b", "▁", "▁▁a", "a▁b", "\0", "\n\n", "日本語 текст 😀😀", "a" * 15, "ab" * 400, "    " * 300, "1234567890", "<s> </s> <unk> <0x41>", "é" * 1000,
    "x" * 3000 + " " * 700, "a⁇ b", "It's. I'LL, 'RE!", "<|endoftext|>", "ΣΑΣ. İ", "a\x1cb", "é.", "\t\tx\r\n",
]


def random_texts(alphabet: str, n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 50))) for _ in range(n)]


def test_sentencepiece_equals_the_library():
    path = sentencepiece_bpe.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = HARD + random_texts("abcdeth naio  ▁\n<0x1>é12.,", 2000, 1) + random_texts("inthe ", 2000, 2)
    ids, bounds = sentencepiece_bpe.encode(texts, path)
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        want = sp.encode(t or "")
        assert ids[a:b].tolist() == want and sentencepiece_bpe.decode(want, path) == sp.decode(want)


def test_sentencepiece_store_is_bounded():
    model, _ = sentencepiece_bpe._loaded(sentencepiece_bpe.model_path())
    store = sentencepiece_bpe.WordIds(model.encode_words, limit=50)
    for i in range(5):
        words = [f"w{i}x{j}" for j in range(40)]
        ids, _ = store.ids([words])
        assert len(store) <= 90 and len(ids)


def test_sentencepiece_rows(spark):
    df = spark.createDataFrame([(1, "the cat", "clash"), (1, None, "x"), (None, "the cat", "y"), (2, "", "z")], "doc_id long, text string, ids string")
    got = sentencepiece_bpe.encode_decode(df, sentencepiece_bpe.model_path()).collect()
    assert sorted((str(r["doc_id"]), r["decoded"], len(r["ids"])) for r in got) == [("1", "", 0), ("1", "the cat", 2), ("2", "", 0), ("None", "the cat", 2)]
    assert sentencepiece_bpe.encode_decode(df.limit(0), sentencepiece_bpe.model_path()).count() == 0


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = HARD + random_texts("abCDéèßÿÉ'st1.,!é́ß İΣ  \n\t\x1c <|endoftext|>日ก", 3000, 3)
    ids, bounds = tokenfile.encode_words_of(texts, path)
    for e, a, b in zip(tok.encode_batch([t or "" for t in texts], add_special_tokens=False), bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == e.ids


@pytest.mark.parametrize("bits", [False, True])
def test_token_file_round_trip(bits):
    rnd = np.random.default_rng(1)
    docs = [(k, rnd.integers(0, top, n, dtype=np.uint32)) for k, n, top in ((5, 0, 2), (None, 3, 2**32), (7, 1000, 2**16), (7, 257, 300), (-1, 64, 2))]
    for block in (64, 1000, 1 << 16):
        r = tokenfile.TokenReader(io.BytesIO(tokenfile.dumps(docs, bits, block)))
        got = list(r.documents())
        assert [k for k, _ in got] == [k for k, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(got, docs, strict=True))
        flat = np.concatenate([x for _, x in docs])
        assert (r.read_block(0) == flat[:block]).all() and (r.read_block(r.blocks - 1) == flat[(r.blocks - 1) * block :]).all()
    assert list(tokenfile.TokenReader(io.BytesIO(tokenfile.dumps([], bits))).documents()) == []
    with pytest.raises(ValueError, match="not a token file"):
        tokenfile.TokenReader(io.BytesIO(b"short"))


def test_token_files_on_spark(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, f"word{i} and more words", "x") for i in range(30)] + [(3, None, "x"), (None, "", "x"), (4, "word4 and more words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    out = shared_dir(spark, "t")
    files = tokenfile.write_token_files(df, path, 1, out, file_ids=20)
    got = tokenfile.read_token_files(files, out).collect()
    assert len(got) == len(rows) and files.count() > 4 and files.groupBy().max("ids").first()[0] < 40
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in order), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in order:
        ids = tokenfile.ids_of(r["ids_le"])
        assert r["start"] == at and ids[-1] == 1
        at += len(ids)
    out = shared_dir(spark, "t")
    assert tokenfile.read_token_files(tokenfile.write_token_files(df.limit(0), path, 1, out), out).count() == 0


def archive(n: int, zipped: bool) -> tuple[bytes, list[int]]:
    parts, starts = [], []
    for i in range(n):
        raw = warc.record(i, f"http://h/{i}", f"<p>page {i} {'x' * 50 * i}</p>".encode())
        starts.append(sum(map(len, parts)))
        parts.append(gzip.compress(raw) if zipped else raw)
    return b"".join(parts), starts


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_goes_on_after_damage(zipped):
    data, at = archive(6, zipped)
    ends = [*at[1:], len(data)]
    broken = bytearray(data)
    broken[at[1] + 40 : at[1] + 60] = b"\x00" * 20  # inside record 1
    del broken[at[3] + 10 : at[3] + 30]  # bytes lost in record 3
    broken += data[at[0] : at[0] + 100]  # cut off at the end
    seen = list(warc.SalvageReader(io.BytesIO(bytes(broken))))
    good = [x[3]["record_id"] for x in seen if x[0] == "record"]
    assert good == [f"<urn:page:{i}>" for i in (0, 2, 4, 5)]
    gaps = [(a, b) for k, a, b, _ in seen if k == "gap"]
    assert gaps == [(at[1], at[2]), (at[3], ends[3] - 20), (ends[5] - 20, len(broken))]
    assert sum(b - a for _, a, b, _ in seen) == len(broken)
    for junk in (b"", b"\x1f\x8b\x08", b"WARC/1.1", b"WARC/1.1\r\n\r\n", b"nothing here" * 1000):
        assert [x[0] for x in warc.SalvageReader(io.BytesIO(junk))] == (["gap"] if junk else [])
        assert [x[0] for x in warc.SalvageReader(io.BytesIO(junk + data))][-6:] == ["record"] * 6
    assert all(x[0] == "record" for x in warc.SalvageReader(io.BytesIO(data)))


def test_long_headers_are_read_whole():
    for n in (70_000, 300_000):
        raw = warc.record(1, "http://a/" + "x" * n, b"one") + warc.record(2, "http://b/", b"two")
        seen = list(warc.SalvageReader(io.BytesIO(raw)))
        assert [x[0] for x in seen] == ["record"] * 2 and seen[0][3]["target_uri"] == "http://a/" + "x" * n
    cut_off = warc.record(1, "http://a/" + "x" * 70_000, b"one")[:69_000]
    assert [x[0] for x in warc.SalvageReader(io.BytesIO(cut_off))] == ["gap"]


def test_digest_differs_is_damage():
    raw = warc.record(1, None, b"payload").replace(b"payload", b"paYload")
    assert [x[0] for x in warc.SalvageReader(io.BytesIO(raw))] == ["gap"]
    assert [x[0] for x in warc.SalvageReader(io.BytesIO(zlib.compress(raw)))] == ["gap"]


def test_warc_on_spark(spark):
    rows = [(3, "http://a/\r\nb c", "same"), (1, "http://b/", "same"), (2, None, "other"), (None, "http://n/", "same"), (1, "http://b/", "same"), (9, "u", None), (8, "u", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    out = shared_dir(spark, "w")
    files = warc.write_warc(df, out, file_bytes=600)
    got = warc.read_warc(files, out).collect()
    key = lambda r: (str(r["record_id"]), r["type"], str(r["refers_to"]), r["payload_bytes"])
    assert not any(r["gap"] for r in got)
    assert sorted(map(key, got)) == sorted(
        [("<urn:page:1>", "response", "None", 4)] * 2 + [("<urn:page:3>", "revisit", "<urn:page:1>", 4), ("<urn:page:None>", "revisit", "<urn:page:1>", 4), ("<urn:page:2>", "response", "None", 5), ("<urn:page:8>", "response", "None", 0), ("<urn:page:9>", "revisit", "<urn:page:8>", 0)]
    )
    import base64

    assert {r["payload_digest"] for r in got if r["payload_bytes"] == 4} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    out = shared_dir(spark, "w")
    assert {r["type"] for r in warc.read_warc(warc.write_warc(df, out, least_bytes=5), out).collect()} == {"response"}
    out = shared_dir(spark, "w")
    assert warc.read_warc(warc.write_warc(df.limit(0), out), out).count() == 0
