"""Token files: exact round trips, and the library's own ids."""

import zlib

import numpy as np
import pytest
from fixtures import awkward, empty
from marketlake.llm import queries, token_files
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def content():
    return queries.byte_tokenizer()


@pytest.fixture(scope="module")
def library(content):
    return Tokenizer.from_str(content)


def plain_rows(docs, library):
    """(doc_id, start, n_tokens, crc) for (doc_id, text) in order."""
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for width in range(33):
        rows = rng.integers(0, 1 << width, (3, token_files.BLOCK), dtype=np.uint64).astype(np.uint32)
        packed = token_files.pack(rows, width)
        assert packed.shape == (3, token_files.BLOCK * width // 8)
        assert (token_files.unpack(packed, width) == rows).all()


@pytest.mark.parametrize("highest", [1, 2, 100, 50_257, 1 << 32])
def test_segments_round_trip(highest):
    rng = np.random.default_rng(highest)
    for n_docs in (0, 1, 2, 40):
        lengths = rng.integers(0, 900, n_docs)
        ids = rng.integers(0, highest, int(lengths.sum()), dtype=np.uint64).astype(np.uint32)
        ids[rng.random(len(ids)) < 0.02] = (1 << 32) - 1
        names = [None if rng.random() < 0.2 else int(x) for x in rng.integers(-(1 << 62), 1 << 62, n_docs)]
        data = (token_files.write_segment(names, lengths, ids) + b"\n") * 2
        found = list(token_files.segments(data))
        assert len(found) == 2
        for s in found:
            assert s.ids().tolist() == ids.tolist() and s.lengths.tolist() == lengths.tolist()
            assert [None if z else int(i) for i, z in zip(s.doc_ids, s.nulls, strict=True)] == names
            for a, b in rng.integers(0, len(ids) + 2, (10, 2)):
                assert s.ids(int(a), int(b)).tolist() == ids[a:b].tolist()


def test_widths_are_chosen_by_percentile_and_outliers_are_exceptions():
    ids = np.full(token_files.BLOCK, 1000, np.uint32)
    ids[::2] = 1007
    ids[5] = 1 << 31
    segment = next(token_files.segments(token_files.write_segment([1], np.array([len(ids)]), ids) + b"\n"))
    assert (segment.least.tolist(), segment.width.tolist(), segment.odd.tolist()) == ([1000], [3], [1])
    assert len(segment.data) == token_files.BLOCK * 3 // 8 + 6
    assert segment.ids().tolist() == ids.tolist()
    with pytest.raises(ValueError):
        list(token_files.segments(b"something that is no file of this format"))


def test_word_by_word_equals_the_library(content, library):
    rng = np.random.default_rng(3)
    letters = [*"ab c'sd  \n\t\r\x0b\x1c\x1f\x85\xa0 　 éßſЖ1²٣\U0001f600_-,.;!中ก́​﻿'", "'ll", "<|endoftext|>", "<|end"]
    encoder = token_files.Encoder(content, kept_words=50)
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(0, 25)))
        assert np.frombuffer(encoder.of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark, tmp_path, content, library):
    docs = awkward(spark)
    token_files.write_ids(docs, f"{tmp_path}/ids", content, segment_ids=500)
    rows = token_files.with_starts(token_files.read_ids(spark, f"{tmp_path}/ids"), group=2).orderBy("start").collect()
    in_order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    # rows of one id follow each other in any order
    assert [r.doc_id for r in rows] == [d[0] for d in in_order]
    plain = lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted((str(i), plain(t)) for i, t in in_order)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    token_files.write_ids(empty(spark), f"{tmp_path}/none", content)
    assert token_files.with_starts(token_files.read_ids(spark, f"{tmp_path}/none")).count() == 0


def test_other_tokenizers_are_refused(spark, tmp_path):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        token_files.write_ids(empty(spark), f"{tmp_path}/x", file.read())


def test_query_equals_the_library(spark, sf, documents, library):
    rows = [tuple(r) for r in queries.op13_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(rows) == plain_rows(sorted((d[0], d[1]) for d in documents), library)
