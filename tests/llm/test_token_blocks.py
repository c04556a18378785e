import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from simloom.llm import queries
from simloom.llm.token_blocks import Encoder, pack_ids, read_segment, read_tokens, unpack_blocks, write_segment, write_tokens

VOCABULARY = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def brute(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(VOCABULARY)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32])
def test_codec_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = top - 1
    docs, lengths, back = read_segment(write_segment([7, None], [n, 0], ids))
    assert docs == [7, None] and lengths.tolist() == [n, 0] and (back == ids).all()


def test_blocks_are_read_alone_and_outliers_are_exceptions():
    ids = np.random.default_rng(1).integers(100, 116, 4096).astype(np.uint32)
    ids[::50] = 50000
    starts, data = pack_ids(ids, 256, 0.9)
    assert len(data) < len(ids)
    assert (unpack_blocks(starts, data, len(ids), 256, 3, 5) == ids[3 * 256 : 5 * 256]).all()


def test_encoder_equals_whole_text_encoding():
    encoder = Encoder(VOCABULARY)
    rng = random.Random(1)
    texts = ["", " ", "\n", "<|endoftext|> a<|endoftext|>b", "we're've ''s a'll .'s a.'s a.b-c_d é.ñ 3a a3 a½b", " a  b\n\n c 's"]
    texts += ["".join(rng.choice(" \n\t.'s,tab12½é́　ß中-_<|\x1c\x85\xa0re  ÿÀ") for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    for text in texts:
        assert encoder.encode(text) == encoder.whole(text), repr(text)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(x) for x in queries.queries()["op1_token_blocks"](spark, sf).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_nulls_ties_long_texts_and_empty_tables(spark, tmp_path):
    rows = [(3, "a b", 1), (None, "zz", 2), (1, None, 3), (2, "", 4), (3, "a b", 5), (5, "word " * 200_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    write_tokens(docs, str(tmp_path / "a"), VOCABULARY, 2, segment_ids=10)
    got = read_tokens(spark, str(tmp_path / "a"), with_ids=True).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert [tuple(x)[:4] for x in sorted(got, key=key)] == brute([x[:2] for x in rows])
    assert all(zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 for x in got)
    write_tokens(docs.limit(0), str(tmp_path / "b"), VOCABULARY, 2)
    assert read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_a_word_is_cached_once():
    encoder = Encoder(VOCABULARY)
    text = "first alpha beta alpha gamma, delta beta. alpha"
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
    assert {"alpha", "beta", "delta"} <= set(encoder.words) and not {" alpha", " delta"} & set(encoder.parts)
