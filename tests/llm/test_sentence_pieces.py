import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import documents, prose, seeded

from sensorloom.llm import sentence_pieces as S

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PIECES = S.PieceModel().load()
ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b", "▁", "a▁b", "▁▁ a", "\n", "\t\n\r\x00\x7f", "<s>x</s><unk><0x41>", "été", "é", "日本語のテキスト", "😀👍🏽", " x　y", "ﬁ"]


def encoded(text):
    ids, ends = PIECES.ids([text])
    assert ends.tolist() == [0, len(ids)]
    return ids.tolist()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  ▁\n.,thearnigsoé中日�😀\x00")), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_and_texts_equal_the_library(text):
    ids = encoded(text)
    assert ids == LIBRARY.encode(text) and PIECES.text(np.array(ids, np.int32)) == LIBRARY.decode(ids)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 258), st.integers(0, 31999), st.sampled_from([259, 29871, 29973])), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert PIECES.text(np.array(ids, np.int32)) == LIBRARY.decode(ids)


def test_odd_and_long_texts_in_one_batch():
    rng = seeded(3)
    letters = "etaoinshrdlu中国日本a"
    long = ["x" * 5000, " " * 70_000 + "a", "".join(rng.choice(letters) for _ in range(20_000)), "ab" * 999 + "😀" * 200, prose(rng, 50_000), "the " * 3000]
    texts = ODD + long + ODD + [prose(rng, 40) for _ in range(50)]
    ids, ends = PIECES.ids(texts)
    decoded = PIECES.all_texts(ids, ends)
    for k, text in enumerate(texts):
        own = ids[ends[k] : ends[k + 1]].tolist()
        assert own == LIBRARY.encode(text or "") and decoded[k] == LIBRARY.decode(own)
    assert all(PIECES.agree(texts, ids, ends, decoded))


def test_both_forms_of_the_agenda_give_the_same(monkeypatch):
    rng = seeded(4)
    texts = [prose(rng, 30), "unbelievablyextraordinarilylongcompoundword antidisestablishmentarianism", "日本語 中文"]
    together = PIECES.ids(texts)
    monkeypatch.setattr(S, "ROW", 1)
    alone = PIECES.ids(texts)
    assert together[0].tolist() == alone[0].tolist() and together[1].tolist() == alone[1].tolist()


def test_disagreement_and_parts_are_told(monkeypatch):
    texts = ["some words here", "other words there and more of them", None]
    ids, ends = PIECES.ids(texts)
    decoded = PIECES.all_texts(ids, ends)
    monkeypatch.setattr(S, "PART", 5)
    assert PIECES.agree(texts, ids, ends, decoded) == [True, True, True]
    wrong = ids.copy()
    wrong[0] += 1
    assert PIECES.agree(texts, wrong, ends, decoded) == [False, True, True]
    monkeypatch.undo()
    assert PIECES.agree(texts, ids, ends, ["some word", *decoded[1:]]) == [False, True, True]


BROKEN = [lambda d: d, lambda d: "#" + d[1:], lambda d: d[:-1] + "#", lambda d: d + " ", lambda d: d[:-1], lambda d: ""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("   ▁▁\nthe, ané中�😀\x00")), max_size=40), st.sampled_from(BROKEN), st.integers(1, 12))
def test_sizes_of_parts_and_rows_change_nothing(text, broken, size):
    ids, ends = PIECES.ids([text])
    decoded = broken(LIBRARY.decode(LIBRARY.encode(text)))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(S, "PART", size)
        assert PIECES.agree([text], ids, ends, [decoded]) == [decoded == LIBRARY.decode(LIBRARY.encode(text))]
        if len(ids):
            assert PIECES.agree([text], ids[:-1], ends - [0, 1], [decoded]) == PIECES.agree([text], ids + 1, ends, [decoded]) == [False]
        patch.setattr(S, "ROW", size)
        assert PIECES.ids([text])[0].tolist() == LIBRARY.encode(text)


def test_texts_of_more_than_a_part_are_compared_both_ways():
    words = "word " * (S.PART // 5)
    texts = [words + "and more", words[:-1] + "xx ", words[:-2] + " ▁ ▁x" * 9 + " end", "é" * (S.PART + 5)]
    ids, ends = PIECES.ids(texts)
    decoded = PIECES.all_texts(ids, ends)
    for k, text in enumerate(texts):
        own = LIBRARY.encode(text)
        assert ids[ends[k] : ends[k + 1]].tolist() == own and decoded[k] == LIBRARY.decode(own)
    assert PIECES.agree(texts, ids, ends, decoded) == [True] * 4
    for broken in BROKEN[1:]:
        assert PIECES.agree(texts, ids, ends, [broken(d) for d in decoded]) == [False] * 4


def test_pieces_over_two_words_raise(tmp_path):
    rng = seeded(6)
    own = {"model_type": "bpe", "byte_fallback": True, "normalization_rule_name": "identity", "remove_extra_whitespaces": False, "minloglevel": 2}
    for name, split in (("words", True), ("lines", False)):
        lines = [rng.choice(("of the", "in a day")) + rng.choice(" ,.") for _ in range(300)]
        sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_prefix=str(tmp_path / name), vocab_size=285, hard_vocab_limit=False, split_by_whitespace=split, **own)
    assert S.PieceModel(str(tmp_path / "words.model")).load().ids(["of the"])[1].tolist()[1] > 0
    with pytest.raises(ValueError, match="at their start"):
        S.PieceModel(str(tmp_path / "lines.model")).load()


def test_other_vocabularies_raise(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        S.PieceModel(str(tmp_path / "none.model")).load()


def test_tables(spark):
    rng = seeded(5)
    texts = ODD + ["twice the same", "twice the same", prose(rng, 4000)]
    docs = documents(spark, texts).withColumnRenamed("node", "pieces").withColumnRenamed("n_words", "a.b")
    added = S.encoding_column(docs)
    rows = S.encoded(docs).collect()
    assert added == "pieces_" and rows[0].asDict().keys() == {"doc_id", "text", "lang", "pieces", "a.b", "pieces_"}
    for r in rows:
        expected = LIBRARY.encode(r["text"] or "")
        assert r[added]["ids"] == expected and r[added]["decoded"] == LIBRARY.decode(expected) and r[added]["agrees"]
    back = S.decoded(S.encoded(docs).select("doc_id", f"{added}.ids"))
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)} | {k: LIBRARY.decode(LIBRARY.encode(t)) for k, t in enumerate(texts) if t}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in S.digests(docs).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)), True)
    assert S.digests(documents(spark, [])).count() == 0 and S.encoded(documents(spark, [])).count() == 0
