"""SentencePiece, token files and the coder: round trips and the libraries themselves."""

import hashlib
import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tensorfold.llm import sentencepiece_codec as sc
from tensorfold.llm import token_coder, token_files

TEXTS = ["", " ", "  a \n\n b", "▁x ▁", "a▁▁ b", "é😀́ \x00z", "<s> </s><unk>", "\t\t x\r\n", "Ünder the 漢字 wörd " * 50, "x" * 5000, None]


@pytest.fixture(scope="module")
def codec():
    return sc.SentencePieceCodec(public_tokenizers.path("piece_bpe_32k.model"), cache_words=20)


@pytest.mark.parametrize("text", TEXTS)
def test_codec_is_the_library(codec, text):
    enc = codec.encode(text)
    assert enc.ids == codec.original.encode(text or "")
    proto = codec.original.encode(text or "", return_type="proto")
    assert [(x.begin, x.end) for x in proto.pieces] == list(zip(enc.begin, enc.end))
    assert codec.decode(enc.ids) == codec.original.decode(enc.ids)
    assert enc.joined == ",".join(map(str, enc.ids))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_codec_on_any_text(text):
    own = sc.codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert own.encode(text).ids == own.original.encode(text)


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_both_ways_to_normalise(codec, text):
    """The short way for models without a character map, and the walk along the text."""
    own = codec.normalize
    assert own.simple
    (plain, a), (mapped, b) = own._plain(text), own._mapped(text.encode())
    assert plain == mapped and a.tolist() == b.tolist()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity", "nmt_nfkc_cf"])
def test_character_maps(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    own = sc.Normalizer(sc.ModelFile.parse(library.serialized_model_proto()))
    for text in ["  Ｈｅｌｌｏ　　ﬁ ①  x  ", "a", "ﾊﾟ́ê \t\n z ", "", "   ", "ÅΩ Straße"]:
        norm, align = own(text)
        assert norm == library.normalize(text)
        assert len(align) == len(norm.encode()) + 1 and (np.diff(align) >= 0).all()


def test_encode_documents(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (2, None, "y"), (None, "long " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    full = sc.encode_documents(docs, model).collect()
    assert len(full) == 4 and all(r.decoded == (t or "") for r, t in zip(sorted(full, key=lambda r: (r.doc_id is None, r.doc_id or 0)), ["a b", None, None, "long " * 3000]))
    digest = sc.encode_documents(docs, model, emit=sc.digest_row, schema=sc.DIGEST).where("doc_id = 2").first()
    assert digest.n_tokens == 0 and digest.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert sc.encode_documents(docs.limit(0), model).count() == 0


def unpacked(packed):
    data = b"".join(packed)
    return np.concatenate([np.zeros(0, np.uint32), *token_coder.unpack(io.BytesIO(data), len(data))])


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 30001])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "constant", "wide", "turns"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "uniform": rng.integers(0, 65536, n),
        "skewed": np.minimum(rng.pareto(0.6, n) * 5, 65535),
        "constant": np.full(n, 7),
        "wide": rng.choice([0, 1, 2**31, 2**32 - 1], n),
        "turns": np.arange(n) % 5 * 100,
    }[kind].astype(np.uint32)
    packed = list(token_coder.pack(ids))
    assert (unpacked(packed) == ids).all()
    if n > 30000:
        assert sum(map(len, packed)) * 8 / n < {"uniform": 20, "skewed": 8.5, "constant": 0.2, "wide": 2.8, "turns": 0.3}[kind]
        block = [zlib.compress(ids[i : i + token_coder.BLOCK].tobytes(), 9) for i in range(0, n, token_coder.BLOCK)]
        assert kind == "uniform" or sum(map(len, packed)) < 1.05 * sum(map(len, block)) + 200


def test_coder_beats_deflate(tiny):
    own = token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids, _ = own.encode_batch(pq.read_table(f"{tiny}/documents.parquet")["text"].to_pylist())
    size = sum(map(len, token_coder.pack(ids)))
    blocks = [ids[i : i + token_coder.BLOCK] for i in range(0, len(ids), token_coder.BLOCK)]
    assert size < 0.85 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_coder_finds_damage():
    packed = next(token_coder.pack(np.arange(9000, dtype=np.uint32) % 700))
    for at in (len(packed) // 2, len(packed) - 300, 30):
        broken = bytearray(packed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            unpacked([bytes(broken)])
    with pytest.raises(ValueError):
        unpacked([packed[:-4]])


def test_word_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    quotes = "it's 's 'll 've've 're'd 'r 'l ''s .'s x'tis 'S 'Ré '\n't '' 1's 'm' ' 't" + "'"
    texts = [*TEXTS, "\x1c\u3000 á A'S don't <|endoftext|> x <|endoftext|>y", "É ﬁ Σ ΑΣ ΑΣ\nΑΣ. 'll 12a\t\tb\r\n\x85z  ́x  q H̱ ẖ", quotes, "", None, " \n", "it'", "s", "'", "re", "ª²³µº¼×÷ß ÀÿŸ".replace("Ÿ", "þ"), "\xa0a\x85b\xad­c", "a" * 300]
    for words in (10, 1000):
        own = token_files.WordTokenizer(path, words=words)
        assert own.by_word and own.latin
        for _ in range(2):
            ids, counts = own.encode_batch(texts)
            expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_token_files(spark, tmp_path):
    rows = [(3, "c d"), (1, "a"), (2, None), (None, "n"), (1, "a"), (4, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("text", "body").withColumnRenamed("body", "text")
    path, library = f"file://{tmp_path}/t", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    found = {(r.doc_id, r.start): r for r in token_files.read_tokens(spark, path).collect()}
    start = 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[i, start]
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = f"file://{tmp_path}/e"
    token_files.write_tokens(docs.limit(0), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, empty).count() == 0
