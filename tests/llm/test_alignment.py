"""The alignment of two tokenizers against the libraries and plain loops, on the given and on odd rows."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from heddlework.llm import alignment
from heddlework.llm.common import prepare, staging
from heddlework.llm.queries import BYTE_VOCABULARY, QUERIES, TOKENIZERS, VOCABULARY

DOCS = "doc_id bigint, text string, key binary, copies string, n_a bigint"
FILES = f"{TOKENIZERS}/{BYTE_VOCABULARY}", f"{TOKENIZERS}/{VOCABULARY}"


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(*FILES)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = alignment.byte_letters()
    a_bytes = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def groups_of(text, libraries):
    a, b, a_bytes, b_bytes = libraries
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    wanted = (" " + text).encode()
    if b"".join(map(a_bytes, ids_a)) != wanted or b"".join(map(b_bytes, ids_b)) != wanted:
        return []
    out, left, right, at_a, at_b = [], [], [], 0, 0
    ids_a, ids_b = ids_a[:], ids_b[:]
    while ids_a or ids_b:
        if at_a <= at_b:
            left.append(ids_a.pop(0))
            at_a += len(a_bytes(left[-1]))
        else:
            right.append(ids_b.pop(0))
            at_b += len(b_bytes(right[-1]))
        if at_a == at_b:
            out.append((left, right))
            left, right = [], []
    return out


def brute(rows, libraries):
    groups = [(doc_id, groups_of(text, libraries)) for doc_id, text in rows]
    counts = Counter(p for _, gs in groups for p in {(x, y) for l, r in gs for x in l for y in r})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, gs in groups:
        links = [(x, y) for l, r in gs for x in l for y in r]
        text = ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in gs)
        out.append((
            doc_id, sum(len(l) for l, _ in gs), sum(len(r) for _, r in gs), len(gs), len(links),
            sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if gs else "",
        ))
    return sorted(out, key=repr)


def collected(df):
    fields = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted([tuple(r[f] for f in fields) for r in df.collect()], key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (3, " "), (4, "a <|endoftext|> b </s><s> <unk> ▁x"), (5, "plain words"), (5, "plain words"), (None, "plain words"),
    (6, "漢字かな交じり文 \U0001f600\U0001f600 é́ \x00\x01"), (7, "  two  spaces\n\n\tand tabs  "), (8, "x" * 300 + "$" * 700), (9, "1234567890 3.14159"),
    (10, "the plain words of the"), (11, "ﬁ ½ Ⅷ   ﻿"),
]


def test_the_whole_query(spark, libraries):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert collected(QUERIES["op11_alignment"](spark, folder)) == brute(docs, libraries)


@pytest.mark.parametrize("block_bytes", [1, 60, alignment.BLOCK_BYTES])
def test_odd_rows(spark, both, libraries, block_bytes):
    prepare(spark)
    docs = spark.createDataFrame([(*r, None, "x", 7) for r in ODD], DOCS)
    assert collected(alignment.align_documents(docs, both, staging(spark, "odd"), block_bytes)) == brute(ODD, libraries)


def test_empty_table(spark, both):
    prepare(spark)
    assert collected(alignment.align_documents(spark.createDataFrame([], DOCS), both, staging(spark, "none"))) == []


def test_groups_with_many_links_are_counted_by_distinct_ids(both, libraries, monkeypatch):
    texts = [t for _, t in ODD if t]
    plain = both.aligner().align(texts)
    monkeypatch.setattr(alignment, "WIDE", 0)
    again = both.aligner().align(texts)
    for name in ("measures", "text", "pair", "times"):
        assert getattr(plain, name).tolist() == getattr(again, name).tolist()


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "$" * 1_000_000, "漢字" * 200_000, "aB3+" * 200_000])
def test_long_runs_end(both, text):
    n_a, n_b, n_groups, n_links = both.aligner().align([text]).measures[0].tolist()
    assert n_a and n_b and n_links >= max(n_a, n_b) >= n_groups > 0


def test_spans_of_the_groups(both):
    text = "Hello tokenizers 漢字"
    spans = both.aligner().groups(text)
    assert [s for *_, s, _ in spans] == [0] + [e for *_, e in spans][:-1] and spans[-1][3] == len(text.encode()) + 1
    assert both.aligner().groups("▁") == [] and both.aligner().groups("") == []
