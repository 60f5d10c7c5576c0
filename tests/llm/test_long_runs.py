"""Texts without borders: rows of signs, runs without spaces, thousands of notices end within seconds and give right results."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from heddlework.llm import licenses, pieces, toxicity
from heddlework.llm.common import prepare
from heddlework.llm.queries import TOKENIZERS, VOCABULARY

MODEL = f"{TOKENIZERS}/{VOCABULARY}"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tokenizer():
    return pieces.Tokenizer(pieces.Vocabulary.load(MODEL))


def seconds(fn):
    start = time.time()
    fn()
    return time.time() - start


def test_a_row_of_signs_is_read_once():
    lexicon = toxicity.Lexicon(["idiot", "stupid"], ["moron"])
    for text in ("$" * 1_000_000, "@$" * 500_000 + "tupid", "a$" * 500_000, "$ " * 500_000):
        assert seconds(lambda: toxicity.hits(text, lexicon)) < 10
    assert toxicity.hits("$tupid @$$hole $$ idiot", lexicon)[0] + toxicity.hits("$tupid", lexicon)[0] >= 2


def test_words_are_those_of_the_plain_pattern():
    import re

    plain = re.compile(r"[@$]*\w+(?:(?:[@$]+|[!*'’])\w+)*[@$]*")
    r = np.random.default_rng(3)
    for _ in range(20_000):
        text = "".join(r.choice(list("ab@$!*' ."), size=12))
        assert plain.findall(text) == toxicity.WORDS.findall(text)


def random_run(seed, n, letters):
    r = np.random.default_rng(seed)
    return "".join(r.choice(list(letters), size=n))


@pytest.mark.parametrize("letters", ["abcdefgh", "ACGT", "0123456789abcdef", "漢字仮名ab", "a", "etaoinshrdlu"])
@pytest.mark.parametrize("n", [301, 1000, 5000])
def test_long_units_equal_the_library(library, tokenizer, letters, n):
    text = "short words " + random_run(n, n, letters) + " and more"
    assert tokenizer.matcher().encode([text])[0].tolist() == library.encode(text)


def test_a_million_letters_without_a_space(library, tokenizer):
    text = random_run(1, 1_000_000, "abcdefghijklmnop")
    out = []
    assert seconds(lambda: out.append(tokenizer.matcher().encode([text])[0].tolist())) < 60
    assert out[0] == library.encode(text)


def test_the_query_function_equals_the_library(spark, library, tokenizer):
    prepare(spark)
    texts = [None, "", " ", "plain words", "plain words", "漢字 \U0001f600 ▁x", "x" * 700, "  two  spaces\n", random_run(5, 2000, "ab") + " end"]
    rows = [(k if k != 3 else None, t, 1, "n", True) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_pieces int, ids_crc32 string, round_trip boolean")
    got = Counter((r.doc_id, r.n_pieces, r.n_chars, r.ids_crc32, r.round_trip) for r in pieces.encode_documents(df, tokenizer).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        want[doc_id, len(ids), len(text or ""), zlib.crc32(np.array(ids, dtype="<i4").tobytes()), "▁" not in (text or "")] += 1
    assert got == want
    assert pieces.encode_documents(df.limit(0), tokenizer).collect() == []


def test_what_is_remembered_is_bounded(tokenizer, monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 50_000)
    matcher = pieces.Matcher(tokenizer.vocabulary)
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(400))
        assert matcher.encode([text])[0].tolist() == library.encode(text)
        assert matcher.held < 50_000 + 400 * 400 and len(matcher.remembered) <= 1000


def test_thousands_of_notices():
    name, text = next(iter(licenses.TEMPLATES.items()))
    found = []
    run = (f"{text} filler words between notices " * 16_000).encode()
    assert seconds(lambda: found.append(licenses.scan_text(run))) < 90
    assert sum(s["label"] == name for s in found[0][-1]) == 16_000
