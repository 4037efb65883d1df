import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from mergescope.llm import pieces
from mergescope.llm.queries import model_file
from tests.llm.samples import documents, texts, with_odd_columns

MODEL = model_file("piece_bpe_32k.model")


def written(values: dict[int, int | bytes]) -> bytes:
    """A message in wire format."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    parts = []
    for number, value in values.items():
        kind = 0 if isinstance(value, int) else 5 if isinstance(value, float) else 2
        body = varint(value) if kind == 0 else struct.pack("<f", value) if kind == 5 else varint(len(value)) + value
        parts.append(varint(number * 8 + kind) + body)
    return b"".join(parts)


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    letters = [*"abc defgh  \n\t.,'éüñ日本語😀▁<>0x\x00 s½ﬁ①Å＋　​ ", "<s>", "</s>", "<unk>", "<0x41>", "▁▁", "   ", "the ", " and", "é"]
    some = ["", " ", "  ", "\n", "▁", "a", "<s>", " a", "a ", "  a  b  ", "the own own", "ownown", "the　", "½", "▁▁▁ "]
    some += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 140))) for _ in range(n)]
    planes = ((1, 0x300), (0x4E00, 0x4F00), (0x10000, 0x10400))
    return some + ["".join(chr(rng.randrange(*rng.choice(planes))) for _ in range(40)) for _ in range(n // 5)]


def library_spans(library, text: str) -> list[tuple[int, int]]:
    proto = library.encode(text, out_type="serialized_proto")
    return [(p.get(4, 0), p.get(5, 0)) for n, v in pieces.fields(proto) if n == 2 for p in [dict(pieces.fields(v))]]


def without_bytes() -> bytes:
    """The public model with its byte pieces as ordinary ones."""
    out = []
    for number, value in pieces.fields(MODEL):
        piece = dict(pieces.fields(value)) if number == 1 else {}
        if piece.get(3) == pieces.BYTE:
            value = written({1: piece[1], 2: -1e6, 3: pieces.NORMAL})
        out.append(written({number: value}))
    return b"".join(out)


def models() -> dict[str, bytes]:
    """The public model, and it with other rules for normalisation, other pieces and other fallbacks."""

    def rules(name: str, **how) -> bytes:
        return sentencepiece.SentencePieceNormalizer(rule_name=name, **how).serialized_model_proto()

    def piece(text: str, score: float, kind: int) -> bytes:
        return written({1: written({1: text.encode(), 2: score, 3: kind})})

    return {
        "as it is": MODEL,
        "mapped": MODEL + rules("nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True),
        "mapped and trimmed": MODEL + rules("nfkc_cf", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True),
        "trimmed without prefix": MODEL + rules("identity", add_dummy_prefix=False, remove_extra_whitespaces=True, escape_whitespaces=True),
        "own pieces": MODEL + piece("ownown", 0.0, pieces.USER_DEFINED) + piece("é日", 0.0, pieces.USER_DEFINED),
        "unused piece": MODEL + piece("xqz", -1.5, pieces.UNUSED) + piece("qz", -1.0, pieces.NORMAL),
        "no byte fallback": without_bytes() + written({2: written({35: 0})}),
    }


@pytest.mark.parametrize("name", models())
def test_ids_spans_and_texts_equal_the_library(name):
    model = models()[name]
    codec, library = pieces.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in [*odd_texts(1500), *[t for t in texts() if t], "xqz axqzq own ownownown sé日", "xq" * 300 + "z"]:
        ids, spans = codec.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert list(map(tuple, spans.tolist())) == library_spans(library, text), repr(text)
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)
    together = pieces.PieceCodec(model).encode_many(odd_texts(1500))
    for text, (ids, spans) in zip(odd_texts(1500), together, strict=True):
        assert ids.tolist() == library.encode(text) and list(map(tuple, spans.tolist())) == library_spans(library, text), repr(text)


def test_any_ids_decode_as_in_the_library():
    codec, library, rng = pieces.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL), random.Random(2)
    for _ in range(4000):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_long_words_take_no_more_than_their_share():
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    codec, library = pieces.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    assert codec.encode(word)[0].tolist() == library.encode(word)


def test_tables_are_encoded_and_decoded_row_by_row(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = with_odd_columns(documents(spark)).unionByName(with_odd_columns(documents(spark)).where("doc_id = 4"))
    encoded = pieces.encode(docs, MODEL).collect()
    assert len(encoded) == len(texts()) + 1
    for r in encoded:
        text = texts()[r.doc_id] or ""
        assert r.ids == library.encode(text)
        assert list(zip(r.begins, r.ends, strict=True)) == library_spans(library, text)
    decoded = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()}
    assert decoded == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts())}
    digests = pieces.round_trip_digests(docs, MODEL).collect()
    assert len(digests) == len(texts()) + 1
    for r in digests:
        text = texts()[r.doc_id] or ""
        ids = library.encode(text)
        spans = np.array(library_spans(library, text), "<i8")
        assert (r.n_tokens, r.spans_crc32) == (len(ids), zlib.crc32(spans.tobytes()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_tables_null_ids_and_other_kinds_of_models(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(none, MODEL).collect() == pieces.round_trip_digests(none, MODEL).collect() == []
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()[0].text == ""
    assert pieces.encode(spark.createDataFrame([(None, None)], "doc_id long, text string"), MODEL).collect()[0].ids == []
    with pytest.raises(ValueError):
        pieces.PieceCodec(MODEL + written({2: written({3: 1})}))
