import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from texts import documents, prose, seeded
from tokenizers import Tokenizer

from sensorloom.llm import token_alignment as A
from sensorloom.plans.scratch import written

FIRST = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
#: Bytes that stand for themselves in the first file; all others are moved to U+0100 and after, in order.
OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in OWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in OWN)}
ODD = [None, "", " ", "  ", "a", "▁", "a ▁ b", "<|endoftext|>", "a <|endoftext|>b <s>", "é日本語 😀", "\n\n\t x\r\n", "the  theater, the  end.", "ＡＢ １２", "x" * 3000, "日本" * 300]


def naive_tokens(text):
    """Ids and bytes of both, or none."""
    if not text:
        return [], [], [], []
    a = FIRST.encode(f" {text}", add_special_tokens=False).ids
    a_bytes = [bytes(BYTE[c] for c in FIRST.id_to_token(i)) for i in a]
    b = SECOND.encode(text)
    b_bytes = [bytes([int(p[1:-1], 16)]) if SECOND.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [SECOND.id_to_piece(i)]]
    whole = f" {text}".encode()
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else ([], [], [], [])


def naive(texts):
    """Groups, links and results of each text, token by token."""
    groups, links = [], []
    for text in texts:
        a, a_bytes, b, b_bytes = naive_tokens(text)
        a_ends, b_ends, own, own_links = {}, {}, [], []
        for ids, sizes, ends in ((a, a_bytes, a_ends), (b, b_bytes, b_ends)):
            at = 0
            for i, x in zip(ids, sizes, strict=True):
                at += len(x)
                ends[at] = i
        start = 0
        for end in sorted(a_ends.keys() & b_ends.keys()):
            own.append(([i for e, i in a_ends.items() if start < e <= end], [i for e, i in b_ends.items() if start < e <= end]))
            own_links.append((a_ends[end], b_ends[end]))
            start = end
        groups.append(own)
        links.append(own_links)
    count = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for text, own, own_links in zip(texts, groups, links, strict=True):
        a, _, b, _ = naive_tokens(text)
        spelt = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        sha = hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""
        out.append((len(a), len(b), len(own), len(own_links), sum(count[x] == most[x[1]] for x in own_links), sum(count[x] for x in own_links), sha))
    return groups, count, out


def results(rows):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def texts():
    rng = seeded(11)
    alphabet = list("  \n.,'aeorntéñ中日1٣😀ß")
    return ODD + [prose(rng, rng.randrange(1, 60)) for _ in range(25)] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(60)] + ["twice the same"] * 2


def test_equal_to_brute_force(spark):
    own = texts()
    groups, count, expected = naive(own)
    docs = documents(spark, own)
    links = written(A.document_links(docs))
    counts = A.count_links(links)
    assert {(r["a_id"], r["b_id"]): r["n_links"] for r in counts.table().collect()} == dict(count)
    assert results(A.scored_links(links, counts).collect()) == expected
    assert expected[0] == expected[1] == expected[5] == (0, 0, 0, 0, 0, 0, "")
    found = A.with_groups(docs.withColumnRenamed("node", "groups").withColumnRenamed("n_words", "a.b"))
    assert found.columns == ["doc_id", "text", "lang", "groups", "a.b", "groups_"]
    assert {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups_"]] for r in found.collect()} == dict(enumerate(groups))


def test_no_pair_or_every_pair_in_each_task(spark, monkeypatch):
    own = texts()[::2] + ["a ﬁ b ﬁ c"] * 30
    expected = naive(own)[2]
    links = written(A.document_links(documents(spark, own).repartition(3)))
    counts = A.count_links(links)
    for heavy in (0, 3, 10**9):
        monkeypatch.setattr(A, "HEAVY", heavy)
        assert results(A.scored_links(links, counts).collect()) == expected


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, None), (4, "some text"), (4, "some text")], "doc_id long, text string")
    links = written(A.document_links(docs))
    rows = A.scored_links(links, A.count_links(links)).collect()
    one = naive(["some text"] * 3)[2][0]
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in rows) == [(0, 0, 0), (0, one[0], one[5]), (4, one[0], one[5]), (4, one[0], one[5])]
    empty = written(A.document_links(docs.limit(0)))
    assert A.scored_links(empty, A.count_links(empty)).count() == 0
