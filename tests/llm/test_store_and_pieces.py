import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarryframe.llm import pieces as pc
from quarryframe.llm import token_store as ts
from tests.llm.helpers import prose

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = ["", " ", "  a", "a  b", "a \n b", "a\n\n b", "don't stop\t now ", "x  y", "日本語 テキスト", "é😀 ok", "a<|endoftext|> b", "\n", " lead", "tail  ", "1 2  33", "''s 's"]


@pytest.fixture(scope="module")
def model():
    return pc.Model(PIECES)


def test_piecewise_ids_equal_whole_text_ids():
    encoder = ts.PieceEncoder(BPE, 1000)
    plain = Tokenizer.from_file(BPE)
    assert 50256 in plain.encode("a<|endoftext|> b", add_special_tokens=False).ids
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("ab é'1 \n\t.") for _ in range(rng.randrange(60))) for _ in range(300)]
    for _ in range(2):
        for text, got in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_cuts_depend_on_content_only():
    cfg = ts.StoreConfig(BPE, cut_bits=5, min_chunk=4, max_chunk=64)
    rng = np.random.RandomState(1)
    shared = rng.randint(0, 50_000, 3000).astype(np.uint32)
    powers = (ts._powers(ts._BASE, 1 << 14), ts._powers(ts._INVERSE, 1 << 14))

    def chunks(ids):
        (ends,) = ts.cut_points(ids, [len(ids)], cfg, powers)
        streams = [ids[:5], ids[:0], ids, ids[7:900]]
        assert ts.cut_points(np.concatenate(streams), list(map(len, streams)), cfg, powers) == [ts.cut_points(x, [len(x)], cfg, powers)[0] if len(x) else [] for x in streams]
        assert ends[-1] == len(ids) and all(b - a <= 64 for a, b in zip([0, *ends], ends, strict=False))
        return {ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    a, b = chunks(shared), chunks(np.concatenate([rng.randint(0, 50_000, 777).astype(np.uint32), shared]))
    assert len(a & b) > 0.9 * len(a)


def test_crc_of_parts_combines():
    data = bytes(random.Random(2).randrange(256) for _ in range(5000))
    parts = [data[:7], data[7:7], data[7:4000], data[4000:]]
    after = np.array([len(data) - sum(map(len, parts[: i + 1])) for i in range(4)])
    moved = ts._shift(np.array([zlib.crc32(p) for p in parts], np.int64), after)
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(data)


def test_store_round_trip(spark, odd_docs, no_docs, tmp_path):
    cfg = ts.StoreConfig(BPE, docs_per_file=3)
    path = f"file://{tmp_path}/store"
    ts.write_store(odd_docs, path, cfg)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in ts.read_documents(spark, path).collect())
    plain = Tokenizer.from_file(BPE)
    want = {(r.doc_id, zlib.crc32(np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in odd_docs.collect()}
    assert {(d, c) for _, d, _, c in got} == want and len(got) == 11
    ids = [g[1] for g in got]
    assert ids == sorted(ids, key=lambda v: -1 if v is None else v)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
    whole = {r.doc_id: r.ids for r in ts.read_ids(spark, path).collect()}
    assert whole[6][-1] == 2 and zlib.crc32(np.array(whole[6], "<u4").tobytes()) == {d: c for _, d, _, c in got}[6]
    hashes = [r[0] for r in spark.read.parquet(f"{path}/chunks").select("digest").collect()]
    assert len(hashes) == len(set(map(bytes, hashes)))
    assert ts.token_digests(no_docs, cfg).count() == 0


def test_damaged_store_is_refused(spark, tmp_path):
    cfg = ts.StoreConfig(BPE)
    path = f"file://{tmp_path}/store"
    ts.write_store(spark.createDataFrame([(1, prose(1, 300)), (2, prose(2, 300))], "doc_id long, text string"), path, cfg)
    chunks = spark.read.parquet(f"{path}/chunks")
    chunks.selectExpr("digest", "n", "reverse(ids) AS ids" if False else "cast(concat(substring(ids, 3), substring(ids, 1, 2)) AS binary) AS ids").write.parquet(f"{path}/other")
    ts.drop_path(spark, f"{path}/chunks")
    spark.read.parquet(f"{path}/other").write.parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="does not match its digest"):
        ts.read_documents(spark, path).collect()


def test_words_and_scan_equal_the_library(model):
    rng = random.Random(3)
    texts = ODD_TEXTS + ["▁ ▁x", "日本語のテキスト" * 12, "a" * 200, "=-" * 90] + ["".join(rng.choice("abcde éß 日.") for _ in range(rng.randrange(1, 150))) for _ in range(60)]
    encoder = pc.WordEncoder(model, 10_000)
    for text, packed in zip(texts, encoder(texts), strict=True):
        want = model.library.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want, repr(text)
        for size in (5, 17, 64):
            if "▁" not in text:
                assert pc.encode_scan(model, text, size) == want, (size, repr(text))
        assert pc.decode(model, np.array(want)) == text.replace("▁", " ")


def test_transfer_matrices_combine_associatively(model):
    text = pc.spaced("unbelievablyantidisestablishmentarianism" * 4)
    cuts = [0, 31, 70, 112, len(text)]
    parts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        entries = pc.states_at(model, text, a)
        exits, bits, _ = pc.transfer(model, text, a, b, entries, b == len(text))
        if b < len(text):
            found = dict(zip(exits, bits, strict=True))
            bits = [found.get(s, 0) for s in pc.states_at(model, text, b)]
        else:
            bits = [pc._either(bits)]
        parts.append(bits)
    left = pc.combine(pc.combine(pc.combine(parts[0], parts[1]), parts[2]), parts[3])
    right = pc.combine(parts[0], pc.combine(parts[1], pc.combine(parts[2], parts[3])))
    assert left == right == [1]


def test_giants_are_cut_anywhere_and_have_matrices(spark, model):
    cfg = pc.PieceConfig(PIECES, chunk_chars=500)
    texts = [prose(k, 900) for k in range(3)] + ["x" * 1700, "antidisestablishment" * 90, "a  b   c " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    matrices = pc.chunk_matrices(pc.cut_giants(docs, cfg), cfg).collect()
    assert len(matrices) == sum(-(-(len(t) + 1) // 500) for t in texts) and sum(r.n_entries > 1 for r in matrices) > len(matrices) / 2
    got = {r.row: r.ids for r in pc.encode_documents(docs, cfg).collect()}
    assert got == {k: model.library.encode(t) for k, t in enumerate(texts)}


def test_documents_small_and_giant(spark, odd_docs, no_docs, model):
    cfg = pc.PieceConfig(PIECES, chunk_chars=3000)
    rows = pc.encode_documents(odd_docs, cfg).collect()
    assert len(rows) == 11
    for r in rows:
        assert r.ids == model.library.encode(r.text or "") and r.n_ids == len(r.ids)
        assert r.round_trip and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    back = pc.decode_documents(pc.encode_documents(odd_docs, cfg).drop("text"), PIECES)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    assert pc.encode_documents(no_docs, cfg).count() == 0
