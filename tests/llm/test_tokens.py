import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mergescope.llm import bpe, packing
from mergescope.llm.queries import vocabulary
from tests.llm.samples import documents, texts, with_odd_columns

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_pieces_hold_every_token_once_in_gapless_sequences(spark):
    docs = documents(spark)
    rows = packing.op1_packing(with_odd_columns(docs), WORD).collect()
    expected = {i: [*library("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts())}
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        ids = expected[r.doc_id]
        piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(piece))
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(seen) == {i: len(ids) for i, ids in expected.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_the_tightest_window_is_taken():
    packer = packing.Packer(10)
    placed = [packer.place(n) for n in (7, 6, 4, 3, 2, 1)]
    assert placed == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0), (2, 2)]
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 2049, 3000).tolist(), reverse=True)
    packer, left = packing.Packer(2048), []
    for n in lengths:  # against a scan over all windows
        fits = sorted((c, w) for w, c in enumerate(left) if c >= n)
        window, offset = packer.place(n)
        if fits:
            assert left[window] == fits[0][0] and offset == 2048 - left[window]
            left[window] -= n
        else:
            assert window == len(left)
            left.append(2048 - n)


def test_real_pieces_carry_their_ids(spark):
    rows = packing.pack_documents(documents(spark), WORD).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_bpe_equals_the_library_and_decodes(spark):
    tokenizer = library("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in bpe.round_trip_digests(with_odd_columns(documents(spark)), BYTE).collect()}
    for i, t in enumerate(texts()):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_columns_and_cut_ids(spark):
    encoded = bpe.encode(documents(spark), BYTE)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}
    codec, tokenizer = bpe.BpeCodec(BYTE), library("byte_bpe_50k.json")
    ids = codec.encode("日本語 ü")
    assert codec.decode(ids[1:-1]) == tokenizer.decode(ids[1:-1], skip_special_tokens=False)


def test_white_space_between_pieces():
    codec, tokenizer = bpe.BpeCodec(BYTE), library("byte_bpe_50k.json")
    for t in ("a  b", "a \n b", " a", "a ", "\ta b\n", "a\x1c b", "a b \n\n\n c  ", "it's  we'll", "a  b", "1 2  3"):
        assert codec.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_empty_tables(spark):
    none = documents(spark).where("false")
    assert packing.op1_packing(none, WORD).count() == 0
    assert bpe.round_trip_digests(none, BYTE).count() == 0
