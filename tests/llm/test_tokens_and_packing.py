import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import documents, prose, seeded
from tokenizers import Tokenizer

from sensorloom.llm import packing as P
from sensorloom.llm import token_counts as C
from sensorloom.llm.tokens import Vocabulary

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = Vocabulary().encoder()
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


def plain(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t aZ9é'.,!|中\r　")), max_size=40))
def test_ids_equal_the_tokenizer(text):
    assert ENCODER.ids(text).tolist() == plain(text)


def test_odd_texts():
    for blank in BLANKS:
        for form in ("a{0}b", "a {0} b", "a{0} {0}b", "{0}{0}a", "a{0}{0}", "a \xa0{0} \xa0 b"):
            assert ENCODER.ids(form.format(blank)).tolist() == plain(form.format(blank))
    for text in ("we're it's  'll x", "a<|endoftext|>b  c", "tail ", " lead", "a\n b", "a \n\n  b", "word " * 500, "x" * 3000, "<|endoftext|>"):
        assert ENCODER.ids(text).tolist() == plain(text)


def test_runs_too_long_for_the_pattern():
    for run in (" " * 12_000, " \n" * 6000, "\u3000" * 10_000, "\n" * 300_000):
        for form in ("a{}b", "{}a", "a{}", "a{}<|endoftext|> b", "a {}!"):
            assert ENCODER.ids(form.format(run)).tolist() == plain(form.format(run))
    assert ENCODER.count(" " * 3_000_000) > 0


def test_limits_equal_brute_force(spark):
    rng = seeded(5)
    texts = [None, "", "one", "one", *[prose(rng, rng.randrange(1, 300)) for _ in range(40)]]
    lengths = [len(plain(t or "")) for t in texts]
    histogram = C.length_histogram(documents(spark, texts)).cache()
    limits = C.context_limits(histogram)
    got = limits.collect()
    assert sorted(r["context_limit"] for r in got) == sorted(set(lengths))
    for r in got:
        at = r["context_limit"]
        assert r["n_longer"] == sum(n > at for n in lengths) and r["tokens_kept"] == sum(min(n, at) for n in lengths)
        assert r["tokens_total"] == sum(lengths) and abs(r["share_within"] - sum(n <= at for n in lengths) / len(lengths)) < 1e-12
    assert tuple(C.totals_at(histogram, 50).first()) == (len(texts), sum(n > 50 for n in lengths), sum(lengths), sum(min(n, 50) for n in lengths))
    assert C.quantile(limits, 0.5).first()[0] == sorted(lengths)[len(lengths) // 2 - 1]
    assert C.length_histogram(documents(spark, [])).count() == 0


def test_packing_is_gapless_whole_and_tight(spark):
    rng = seeded(6)
    texts = [None, "", *[prose(rng, rng.randrange(1, 120)) for _ in range(150)], prose(rng, 4000), "same text", "same text"]
    docs = documents(spark, texts).union(documents(spark, ["same text"], first=len(texts) - 1))
    rows = P.pack(docs, capacity=128).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(texts[:-1]):
        ids = plain(text or "") + [2]
        at = 0
        for n, r in enumerate(by_doc[k]):
            assert (r["piece"], r["start"]) == (n, at) and r["length"] <= 128 and (n == 0 or r["length"] == 128)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len(by_doc[len(texts) - 1]) == 2  # a repeated row is packed for itself
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 128
    assert len(placed) <= 1.03 * -(-sum(r["length"] for r in rows) // 128) + 1
    assert P.pack(docs.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_plan_uses_up_the_histogram(histogram):
    used = {}
    for pattern, n in P.plan(histogram, 40):
        assert sum(pattern) <= 40 and n > 0
        for v in pattern:
            used[v] = used.get(v, 0) + n
    assert used == histogram
