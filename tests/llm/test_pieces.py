import hashlib

import public_tokenizers
import pytest
import sentencepiece

from innsight.llm.pieces import Vocabulary, encode_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "  a", "a  b", "a\n", "\na", "a \nb", "a\n b", "a\n\nb",
    "a,b", "a.b.", "_, x", "²., ².", "a , b", "..", "...,,", "e.g. x,y.\nz", ",", "▁", "▁a b▁c",
    "日本語 x <s> </s> <0x0A> <unk>", "a\x00b", "😀 x", "\t\ttabs", " ", "ﬁ ǅ İ", "A" * 300,
    "ab" * 2000, "x" + " " * 500 + "y",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("text", ODD)
def test_agenda_equals_library(library, text):
    v = Vocabulary(MODEL)
    ids = v.encode(text)
    assert ids == library.encode(text)
    assert v.decode(ids) == (library.decode(ids) if ids else "")
    assert not v.disputed


def test_heap_and_list_agendas_agree(library, documents):
    v = Vocabulary(MODEL)
    for _, text in documents[:40]:
        for word in text.split()[:60]:
            assert [x for x in v._merged(word) if x] == v._merged_by_list(word)
        marked = "▁" + text[:3000].replace(" ", "▁")
        assert v.merge(marked) == library.encode(text[:3000])


def test_ids_are_the_agendas(library, monkeypatch):
    """An agenda that merges wrongly shows in the ids, and is reported."""
    v = Vocabulary(MODEL)
    right = v._merged_by_list
    monkeypatch.setattr(v, "_merged_by_list", lambda text: list(text) if "cat" in text else right(text))
    (ids, agreed), (others, fine) = v.encode_all(["the cat sat", "the dog sat"])
    assert not agreed and ids != library.encode("the cat sat")
    assert fine and others == library.encode("the dog sat")
    assert v.decode(ids) == "the cat sat"


def test_broken_bytes_decode_like_the_library(library):
    v = Vocabulary(MODEL)
    for ids in ([200], [3 + 0xE2, 3 + 0x82], [29871, 3 + 0xC3, 3 + 0xA9], [1, 263, 2], [0]):
        assert v.decode(ids) == library.decode(ids)


def test_query_equals_library_on_every_document(spark, contract, library, documents):
    df = contract.queries()["op3_sentencepiece"](spark, "/root/testdata/sf0.001")
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(documents)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in documents:
        ids = library.encode(text or "")
        row = got[doc_id]
        assert row["n_tokens"] == len(ids) and row["agrees"]
        assert row["ids_sha256"] == sha(",".join(map(str, ids)))
        assert row["decoded_sha256"] == sha(library.decode(ids))


def test_awkward_rows(frame, awkward):
    docs = frame(awkward, clash=("n_tokens", "ids", "classes"))
    rows = encode_texts(docs, MODEL).collect()
    assert len(rows) == len(awkward) and all(r["agrees"] for r in rows)
    none = [r for r in rows if r["text"] in (None, "")]
    assert len(none) == 3 and all(r["ids"] == [] and r["decoded"] == "" for r in none)
    assert all(r["classes"] == "x" for r in rows)
    assert all(r["decoded"] == r["text"] for r in rows if r["text"])
    assert encode_texts(frame([]), MODEL).count() == 0
