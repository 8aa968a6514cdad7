import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from loamgrid.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return P.codec(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the\n▁é日🎉.<s>0x\t")), max_size=40))
def test_ids_are_the_library_s_and_spans_cover_the_source(text):
    codec = P.codec(MODEL)
    e = codec.encode(text)
    assert e.ids == codec.library.encode(text, add_eos=True)
    assert P.covered(e) == len(text.encode())
    assert (e.begin[1:] >= e.begin[:-1]).all() and (e.end >= e.begin).all()


def test_spans_hold_the_pieces(codec):
    text = "Hello  wörld"
    raw = text.encode()
    e = codec.encode(text, end=False)
    said = "".join(raw[a:b].decode(errors="ignore") for a, b in zip(e.begin, e.end, strict=True))
    assert said == text


def plain_spans(library, text):
    """Source bytes of each piece, from the library's pieces alone: each stands for its text, an escape for a space, the first for nothing."""
    out, at, first = [], 0, True
    for i in library.encode(text):
        piece = library.id_to_piece(i)
        n = 1 if library.is_byte(i) else len(piece.replace("▁", " ").encode()) - (first and piece.startswith("▁"))
        out.append((at, at + n))
        at, first = at + n, False
    return [*out, (at, at)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the\né日🎉.<s>0x\t")), min_size=1, max_size=60))
def test_spans_are_those_of_the_pieces(text):
    e = P.codec(MODEL).encode(text)
    assert list(zip(e.begin.tolist(), e.end.tolist(), strict=True)) == plain_spans(P.codec(MODEL).library, text)


def test_the_spans_digest_is_of_the_spans(spark):
    text = "Hello  wörld\n日本 the end"
    row = P.digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).first()
    raw = b"".join(n.to_bytes(8, "little") for span in plain_spans(P.codec(MODEL).library, text) for n in span)
    assert row["spans_sha256"] == hashlib.sha256(raw).hexdigest()


def test_normaliser_agrees_with_the_library_where_the_map_replaces():
    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(own.serialized_model_proto())
    mine = P.Normalizer(proto.normalizer_spec)
    for text in ["ﬁne ①②  Ｆｕｌｌ　ｗｉｄｔｈ ", "é ㌔ ½", "", "  ", "plain", "a\tb\n c"]:
        norm, align = mine(text.encode())
        want, offsets = own.normalize(text, with_offsets=True)
        assert norm.decode() == want
        chars = [len(text.encode()[:a].decode(errors="ignore")) for a in align]
        starts = np.cumsum([0, *[len(c.encode()) for c in want]])
        assert [chars[i] for i in starts] == list(offsets)


def test_digests_of_awkward_rows(awkward, codec):
    rows = {}
    for r in P.digests(awkward, MODEL).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == awkward.count()
    for r in awkward.collect():
        ids = codec.library.encode(r["text"] or "", add_eos=True)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest())
        assert want in [(x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in rows[r["doc_id"]]]


def test_a_full_cache_changes_nothing(codec, monkeypatch):
    fresh = P.PieceCodec(MODEL)
    monkeypatch.setattr(P, "MAX_CACHED", 3)
    text = "some words and some more words and others"
    assert fresh.segment(text) == fresh.segment(text) == codec.segment(text)


def test_encode_and_empty_table(awkward, nothing):
    rows = P.encode(awkward, MODEL).collect()
    assert all(len(r["ids"]) == len(r["begins"]) == len(r["ends"]) for r in rows)
    assert P.encode(nothing, MODEL).count() == 0 and P.digests(nothing, MODEL).count() == 0
