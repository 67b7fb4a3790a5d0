import os
import random

import pyarrow as pa
import pytest
import sentencepiece

from rowsmith.llm import pieces
from tests.llm.common import ODD_TEXTS, docs_table

PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")
ALPHABETS = ["abcde ", "the in er on ing tion ", " ▁\n\t.", "éàü漢字😀ab ", "".join(map(chr, range(32, 127))), "ABCDEF xyz  01"]
SPECIAL = ["", " ", "   ", " " * 40 + "x" + " " * 7, "a" * 300, "\x00a\x00", "▁▁a", "<0x41>", "<s>", "⁇", "    def f(x):\n        return x\n", "don't ==== ----"]


@pytest.fixture(scope="module")
def matcher():
    return pieces.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, seed=1):
    r = random.Random(seed)
    return SPECIAL + ["".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randint(0, 150))) for _ in range(n)]


def encoded(matcher, given):
    flat, offsets = matcher.encode(pa.array(given, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_merges_are_those_of_the_library(matcher, library):
    given = texts(4000)
    assert encoded(matcher, given) == [library.encode(t) for t in given]


def test_pieces_side_by_side(matcher, library):
    r = random.Random(2)
    names = [library.id_to_piece(i) for i in range(259, 32000)]
    given = ["".join(r.choice(names).replace("▁", r.choice([" ", "", "▁"])) for _ in range(r.randint(1, 12))) for _ in range(8000)]
    assert encoded(matcher, given) == [library.encode(t) for t in given]


def test_small_indexes_give_the_same(matcher, library, monkeypatch):
    monkeypatch.setattr(pieces, "INDEXED", 50)
    given = texts(60, 3)
    assert encoded(matcher, given) == [library.encode(t) for t in given]


def as_unigram(path):
    """The same vocabulary as a unigram model: the field of the model type is set to 1."""
    with open(path, "rb") as f:
        data = f.read()
    out = b""
    for number, value in pieces._fields(data):
        if number == 2:
            value = value.replace(b"\x18\x02", b"\x18\x01", 1)
        out += bytes([number << 3 | 2]) + length(len(value)) + value
    return out


def length(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_segmentations_score_as_high_as_the_library(tmp_path):
    data = as_unigram(PATH)
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    matcher = pieces.Model.parse(data).matcher()
    assert matcher.model.kind == pieces.UNIGRAM
    given = ["hello world", "the inner tension", "banana bandana ", "information in formation"] + ["".join(random.Random(i).choice("the inrosa ") for _ in range(40)) for i in range(200)]
    for text, ids in zip(given, encoded(matcher, given)):
        theirs = other.encode(text)
        assert matcher.decode(ids) == text
        score = lambda x: sum(other.get_score(i) for i in x)
        assert score(ids) >= score(theirs) - 1e-3 * abs(score(theirs))


def test_round_trip_of_odd_rows(spark, matcher, library):
    given = ODD_TEXTS + list(enumerate(texts(50, 4)))
    rows = pieces.encode(docs_table(spark, given), matcher).select("row.doc_id", "row.text", "ids", "row")
    back = pieces.decode(rows, matcher).collect()
    assert len(back) == len(given)
    both = pieces.encode_and_decode(docs_table(spark, given), matcher).collect()
    assert {(str(x["row"]["doc_id"]), str(x["ids"]), x["decoded"]) for x in both} == {(str(x["row"]["row"]["doc_id"]), str(x["row"]["ids"]), x["decoded"]) for x in back}
    for x in back:
        text, ids = x["row"]["text"], x["row"]["ids"]
        assert ids == (None if text is None else library.encode(text))
        assert x["decoded"] == (None if text is None else text.replace("▁", " "))


def test_empty_table_and_bad_input(spark, matcher):
    assert pieces.encode(docs_table(spark, []), matcher).count() == 0
    for ids in ([-1], [32000]):
        with pytest.raises(pieces.UnsuitableModel):
            matcher.decode(ids)
    with open(PATH, "rb") as f:
        data = f.read()
    with pytest.raises(pieces.UnsuitableModel):
        pieces.Model.parse(b"nmt_nfkc".join(data.rsplit(b"identity", 1)))
