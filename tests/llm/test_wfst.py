import hashlib
import itertools
import random
import struct

import pytest
import sentencepiece
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixture import no_documents, odd_documents, odd_texts
from possum.llm import wfst

T = wfst.transducer(wfst.MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)


def weight(ids):
    out = 0
    for i in ids:
        s = SP.get_score(i)
        out += wfst.BYTE_COST if SP.is_byte(i) else wfst.PIECE_COST + (int(-s) if s > -wfst.PIECE_COST else 0)
    return out


def all_paths(text):
    """Every segmentation of a short chunk into pieces, or bytes where a character has no piece."""
    if not text:
        yield []
        return
    for n in range(1, min(len(text), 16) + 1):
        i = SP.piece_to_id(text[:n])
        if i != SP.unk_id() and not SP.is_control(i) and not SP.is_byte(i):
            yield from ([i, *rest] for rest in all_paths(text[n:]))
    if SP.piece_to_id(text[0]) == SP.unk_id():
        yield from ([*(SP.piece_to_id(f"<0x{b:02X}>") for b in text[0].encode()), *rest] for rest in all_paths(text[1:]))


def test_shortest_path_against_all_paths():
    r = random.Random(2)
    for _ in range(150):
        chunk = "▁" * r.randint(0, 3) + "".join(r.choice("theinaérs①") for _ in range(r.randint(1, 8)))
        assert weight(T.shortest_path(chunk)) == min(map(weight, all_paths(chunk)))


def test_cut_into_chunks_loses_nothing():
    for text in ("a  b   c", "  lead", "trail  ", "x y z " * 20, "①② ③"):
        normal = T.normalise(text)
        assert weight(T.encode(text).tolist()) == weight(T.shortest_path(normal))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_round_trip(text):
    ids = T.encode(text).tolist()
    assert T.decode(ids) == text.replace("▁", " ") if text else ids == []
    assert all(0 <= i < SP.get_piece_size() for i in ids)


def test_library_decodes_the_same():
    for text in ("hello  world", "für die Größe", "a①b\n\tc", " lead"):
        assert SP.decode(T.encode(text).tolist()) == text


def test_odd_documents(spark):
    rows = wfst.encode_documents(odd_documents(spark)).collect()
    by = {(r.doc_id, r.text_sha256) for r in rows}
    assert len(rows) == len(odd_texts()) and all(r.round_trip for r in rows)
    assert by == {(i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in odd_texts()}
    assert all((r.ids is None) == (r.text_sha256 is None) and r.n_tokens == len(r.ids or []) for r in rows)
    assert wfst.encode_documents(no_documents(spark)).count() == 0


def test_table_decodes_back(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    back = wfst.decode_documents(wfst.encode_documents(docs))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def _message(parts):
    """A protocol buffer message from (number, value) pairs; floats as 4 bytes."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for n, v in parts:
        if isinstance(v, float):
            out += varint(n << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


def _with_normaliser(rule, **flags):
    """The vocabulary file with another normaliser: a rule of the library and changed fields."""
    own = dict(wfst.fields(dict(wfst.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]))
    own |= {{"prefix": 3, "folds": 4, "marks": 5}[k]: v for k, v in flags.items()}
    with open(wfst.MODEL, "rb") as f:
        parts = wfst.fields(f.read())
    return _message([(n, _message(sorted(own.items())) if n == 3 else v) for n, v in parts])


ODD = ["", " ", "ﬁ a", "  two  spaces ", "①②  ½ Ａｂｃ", "\u00a0x\u3000y\t\n", "e\u0301 é が ｶﾞ", "▁ mark", "한국 ㎏ ™ …", "\u200b\u00ad z", "ǅ ŒÆ İ"]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [{}, {"prefix": 0}, {"folds": 0}])
def test_normaliser_is_the_files(rule, flags):
    model = _with_normaliser(rule, **flags)
    t, sp, r = wfst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(1)
    points = [c for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000] + list(range(0xF900, 0xFFFE))
    texts = ODD + ["".join(r.choice([" ", "a", chr(r.choice(points))]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    for text in texts:
        assert t.normalise(text) == sp.normalize(text), (rule, flags, text)
        back = t.decode(t.encode(text).tolist())
        assert wfst._same(t, text, back)


def test_unigram_scores_decide():
    r = random.Random(3)
    pieces = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3)] + [(f"<0x{b:02X}>".encode(), 0.0, 6) for b in range(256)]
    words = sorted({"".join(r.choices("▁abcdé", k=r.randint(1, 4))) for _ in range(150)} | set("▁abcd"))
    pieces += [(w.encode(), -r.uniform(0.5, 9.0), 1) for w in words]
    parts = [(1, _message([(1, p), (2, s), (3, k)])) for p, s, k in pieces]
    trainer = _message([(3, wfst.UNIGRAM), (35, 1), (40, 0), (41, 1), (42, 2)])  # byte fallback, ids of the marks
    model = _message([*parts, (2, trainer), (3, _message([(1, b"identity"), (4, 0)]))])
    t, sp = wfst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    score = lambda ids: sum(-sp.get_score(i) for i in ids)
    for _ in range(300):
        text = "".join(r.choice("abcdé  z") for _ in range(r.randint(1, 25)))
        got, want = t.encode(text).tolist(), sp.encode(text)
        assert got == want or abs(score(got) - score(want)) < 1e-3, text


def test_files_of_other_kinds_are_refused():
    with open(wfst.MODEL, "rb") as f:
        parts = wfst.fields(f.read())
    word = [(n, _message([(a, 3 if a == 3 else b) for a, b in wfst.fields(v)]) if n == 2 else v) for n, v in parts]
    user = [(n, _message([(1, b"<own>"), (2, 0.0), (3, 4)]) if i == 1000 else v) for i, (n, v) in enumerate(parts)]
    for broken in (_message(word), _message(user), _with_normaliser("identity", marks=0)):
        with pytest.raises((ValueError, RuntimeError)):
            wfst.Transducer(broken)


def test_ids_are_close_in_number_to_the_library():
    text = " ".join(itertools.islice(itertools.cycle(["the", "and", "nothing", "window"]), 100))
    assert len(T.encode(text)) <= len(SP.encode(text))
