"""The ten operators against SQL, brute force, round trips and held-out labels, and on odd rows."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from compare import connect, spark_rows, sql_rows

from heddlework.llm import chat, licenses, mixing, ngram_join, pieces, quality_classifier, quality_rules, sharding, topk, toxicity
from heddlework.llm.common import prepare, staging
from heddlework.llm.queries import QUERIES, SQL, TOKENIZERS, VOCABULARY

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", None, 4), (4, LONG, "en", "a", len(LONG)),
    (5, "same words here again today", "de", "b", 5), (6, "same words here again today", None, "b", 5),
    (6, "same words here again today", None, "b", 5), (6, "other text", None, None, None), (None, "no id CC BY text", "en", "a", 1),
    (7, "\x00 é漢字 ▁ \U0001f600 you idiot! \"idiot\"", "fr", "é", 9), (8, "All rights reserved. all RIGHTS reserved", "en", "a", 9),
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, None, None), (7, 0, 1), (None, 1, 1)], LABELS)


def documents(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(con, SQL[name])


# 1


def base_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [
        (k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    return len(words), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licences_by_brute_force(spark, odd):
    docs = documents(spark).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in licenses.license_scan(docs).collect():
        got = r.license
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == base_phrases(r.text)
        assert set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(",")) and 0 <= got.score <= 1


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_by_brute_force(seed):
    r = np.random.default_rng(seed)
    words = [bytes([97 + k]) for k in range(4)]
    templates = {str(t): [words[k] for k in r.integers(0, 4, 12)] for t in range(3)}
    text = [words[k] if k < 4 else b"zz" for k in r.integers(0, 5, 60)]
    runs = {tuple(t[a:b]) for t in templates.values() for a in range(12) for b in range(a + 1, 13)}
    longest = [max((n for n in range(1, k + 2) if tuple(text[k + 1 - n : k + 1]) in runs), default=0) for k in range(60)]
    want = {(k + 1 - n, k) for k, n in enumerate(longest) if n >= licenses.MIN_RUN and (k == 59 or longest[k + 1] != n + 1)}
    assert {(a, b) for a, b, _ in licenses.Automaton(templates, {}).scan(text)[1]} == want


def test_a_licence_with_changes_is_one_span():
    words = licenses.TEMPLATES["mit"].split()
    text = " ".join(["x"] * 5 + words[:20] + ["changed"] + words[21:] + ["y"] * 5).encode()
    out = licenses.scan_text(text)
    assert out[5] == "mit" and len(out[7]) == 1 and (out[7][0]["first_word"], out[7][0]["last_word"]) == (5, len(words) + 4)


# 2


def edit_distance(a, b):
    """Optimal string alignment: edits and swaps."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_by_brute_force():
    lexicon = toxicity.Lexicon(["idiot", "moron", "scum"], ["stup"])
    letters = "idotmrncsup"
    r = np.random.default_rng(1)
    words = [*("".join(r.choice(list(letters), n)) for n in r.integers(3, 7, 500))]
    for term in ("idiot", "moron", "scum"):
        for k, c in itertools.product(range(1, len(term)), letters):
            words += [term[:k] + c + term[k:], term[:k] + c + term[k + 1 :], term[:k] + term[k + 1 :], term + c]
            words.append(term[: k] + term[k : k + 2][::-1] + term[k + 2 :])
    for word in words:
        best = [edit_distance(word, t) for t in ("idiot", "moron", "scum") if word[0] == t[0] and edit_distance(word, t) <= toxicity.edits_for(t)]
        want = toxicity.EXACT if word.startswith("stup") or 0 in best else toxicity.FUZZY if best else toxicity.NONE
        assert lexicon.find(word) == want, word


def test_automaton_edits_first_letters_too():
    terms = ["idiot", "moron", "scum", "worthless"]
    lexicon = toxicity.Lexicon(terms, ["stup"])
    r = np.random.default_rng(2)
    words = ["ldiot", "diot", "omron", "xidiot", "orthles", "wthless", "worthle", "owrthlses"]
    for term in terms:
        for _ in range(400):
            word = list(term)
            for _ in range(r.integers(0, 4)):
                k, c = int(r.integers(0, len(word))), str(r.choice(list("idotmrncsupwhle")))
                word[k : k + int(r.integers(0, 2))] = [[c], [], [c, word[k]], word[k : k + 2][::-1]][r.integers(0, 4)]
            words.append("".join(word) or "x")
    kinds = set()
    for word in words:
        found = [edit_distance(word, t) for t in terms if edit_distance(word, t) <= toxicity.edits_for(t)]
        want = toxicity.EXACT if word.startswith("stup") or 0 in found else toxicity.FUZZY if found else toxicity.NONE
        assert lexicon.find(word) == want, word
        kinds.add(want)
    assert len(kinds) == 3


def test_signs_that_look_like_letters():
    lexicon = toxicity.Lexicon(["stupid", "asshole", "idiot"])
    assert toxicity.hits("$tupid @sshole a$$hole @idiot stupid$ id!ot", lexicon) == (5, 1, 0)
    assert toxicity.hits("$100 100$ a@b.c $ @ $$", lexicon) == (0, 0, 0)


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon(["idiot"])
    assert toxicity.hits("You idiot, you idoit.", lexicon) == (1, 1, 0)
    assert toxicity.hits('They said "what an idiot" to me', lexicon) == (0, 0, 1)
    assert toxicity.hits("", lexicon) == (0, 0, 0)


def test_quotations_are_paired_over_the_whole_text():
    lexicon = toxicity.Lexicon(["idiot"])
    long = "then " * 60
    for text in (f'"{long} idiot {long}"', f"„{long} idiot {long}“", f"«{long} idiot {long}»", "so 'you idiot' it read", "> you idiot\nno"):
        assert toxicity.hits(text, lexicon) == (0, 0, 1), text
    for text in (
        '"Hi" you idiot "bye"', f'"{long}" you idiot "{long}"', "don't be an idiot, it's bad", '5" idiot 6"', "“ you idiot", "a > idiot",
        "the dogs' idiot and the cats' bowl", "'tis an idiot\nof the dogs' own",
    ):
        assert toxicity.hits(text, lexicon) == (1, 0, 0), text


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.95 and hit / sum(r.toxic for r in rows) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_lexicon_takes_all_precise_terms(spark):
    """More candidates than any cap on their number, the rare ones the precise ones."""
    prepare(spark)
    noise = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}noise" for k in range(j, 21_000, 4)) for j in range(4)]
    rare = "zzrare zzyrare " + " ".join(f"z{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}term" for k in range(2_500))
    rows = [(f"{text} t{i} {rare if i < 6 else ''}", 1) for i in range(8) for text in noise] + [(f"{text} c{i}", 0) for i in range(8) for text in noise]
    words, stems = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), staging(spark, "t"))
    assert set(rare.split()) <= set(words) and not any(w.endswith("noise") for w in words)
    assert all(any(w.startswith(s) for s in stems) for w in rare.split())


def test_support_is_chosen_on_training_rows(spark):
    counts = "unit string, t0 int, c0 int, t1 int, c1 int"
    chance = [(f"u{k}", 4, 0, 0, 40) for k in range(20)]
    assert toxicity.choose_support(spark.createDataFrame([("good", 9, 0, 9, 0), *chance], counts)) == 5
    assert toxicity.choose_support(spark.createDataFrame([("rare", 4, 0, 4, 0)], counts)) == toxicity.MIN_SUPPORT
    assert toxicity.choose_support(spark.createDataFrame([], counts)) == toxicity.MIN_SUPPORT


# 3


def test_quality_counts_on_odd_texts():
    assert quality_rules.count_text(b"") == (0, 0, 0, 0, 0, 0, 0)
    assert quality_rules.count_text("é a b a b a b\n é#\n é#\n".encode()) == (9, 11, 2, 1, 6, 3, 0)


def test_quality_filter_agrees_with_the_table(spark, odd):
    docs = documents(spark).where("doc_id > 10").unionByName(odd.where("doc_id != 6"))
    table = {r.doc_id: r.kept for r in quality_rules.quality_table(docs, staging(spark, "t")).collect()}
    kept = quality_rules.quality_filter(docs.selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS counts"), staging(spark, "t"))
    assert kept.columns == [*docs.columns, "n_words", "kept", "counts"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in table.items() if v)


def test_bad_shares_of_hot_and_small_groups_go(spark):
    text = " ".join(f"w{k}" for k in range(80))
    spam = text + " ## ## ## ##" * 10
    shout = " ".join(f"w{k}!" if k % 3 else f"w{k}" for k in range(80))
    rows = [(k, text, "en", f"s{k % 4}", 1) for k in range(120)]
    rows += [(200 + k, spam if k % 10 < 4 else text, "en", "hot", 1) for k in range(80)]
    rows += [(400 + k, shout, "de", "small", 1) for k in range(2)]
    docs = spark.createDataFrame(rows, DOCS)
    bad = {r[0] for r in rows if r[1] != text}
    for kept in (
        {r.doc_id for r in quality_rules.quality_filter(docs, staging(spark, "t")).collect()},
        {r.doc_id for r in quality_rules.quality_table(docs, staging(spark, "t")).where("kept").collect()},
    ):
        assert kept == {r[0] for r in rows} - bad


# 4


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op4_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_discriminant_is_the_gaussian_posterior():
    r = np.random.default_rng(0)
    x = [r.normal(size=(4000, 2)) * [1, 3] + [0, 1], r.normal(size=(4000, 2)) + [2, 0]]
    model = quality_classifier.Discriminant([4000, 4000], [v.sum(0) for v in x], [v.T @ v for v in x])
    at = np.array([[1.0, 0.5], [0.0, 4.0]])
    logs = [-0.5 * (at[:, 0] ** 2 + ((at[:, 1] - 1) / 3) ** 2) - math.log(3), -0.5 * ((at[:, 0] - 2) ** 2 + at[:, 1] ** 2)]
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(logs[0] - logs[1])), atol=0.12)
    assert quality_classifier.Discriminant([0, 0], [0, 0], [0, 0]).scores(at).tolist() == [0.5, 0.5]


# 5


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    network = sharding.Feistel(n)
    places = network.place(np.arange(n))
    assert sorted(places) == list(range(n)) and (network.number(places) == np.arange(n)).all()


def test_shards_by_brute_force(spark, odd):
    rows = sharding.shard_rows(documents(spark).unionByName(odd), staging(spark, "t")).collect()
    keys = sorted(((r.doc_id is not None, r.doc_id or 0), r.text_crc32, r.size, r.row_number) for r in rows)
    assert [k[3] for k in keys] == list(range(len(rows)))
    assert all(r.shard + 8 * r.slot == sharding.Feistel(len(rows)).place(np.array([r.row_number]))[0] for r in rows)
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1


# 6


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (1, [0.5, -0.25, 9.0]), (2, None), (3, [nan]), (4, [inf]), (5, [None]), (6, []), (None, [1.0]), (1, [0.5, -0.25, 9.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS score", "2 AS ids")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, staging(spark, "t")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 20480), (0, 2, 8, 20480), (0, 3, 20, 4096), (0, 4, 1, 0), (0, 5, 1, 0), (20, 1, 0, 4096), (20, 2, 7, 4096), (20, 3, 8, 4096), (20, 4, 1, 2048), (20, 5, 1, 2048)]
    assert topk.top_k(df.limit(0), staging(spark, "t")).count() == 0


def test_rows_of_one_vec_id_are_candidates_of_each_other(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [-1.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, staging(spark, "t")).collect())
    one, two = [(3, 4096), (20, 0), (3, -4096)], [(3, 32768), (3, 8192), (20, 0)]
    assert got == sorted((20, k + 1, *x) for part in (one, two) for k, x in enumerate(part))


# 7


def test_chat_round_trip_on_odd_turns(spark):
    texts = ["", None, "\\", "\\\\[", "[INST]", "<<<SYS>>", "a < b [c]", "</s>[INST] ok [/INST]", " x ", "é\n[/INST]"]
    roles = ["user", "assistant", "system", "to ol>>", "", None]
    rows = [(k % 3 if k % 7 else None, k // 2, r, t, 1) for k, (r, t) in enumerate(itertools.product(roles, texts))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for key in {r[0] for r in rows}:
        want = sorted((t, r or "", x or "") for c, t, r, x, _ in rows if c == key)
        assert [(t.role, t.text) for t in out[key].turns] == [(r, x) for _, r, x in want]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_control_strings_of_a_text_do_not_survive(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]")], "conv_id int, turn int, role string, text string")
    formatted = chat.format_conversations(df).first().formatted
    assert len(re.findall(chat.CONTROL, formatted)) == 2


# 8


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        level = rest / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * weight[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mixing_meets_its_targets(spark, odd):
    docs = documents(spark, "/root/testdata/sf0.01").unionByName(odd)
    rows = mixing.mix(docs, staging(spark, "t")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size <= 2 * r.size
    targets = brute_targets({s: sum(r.size for r in own) for s, own in by.items()})
    for source, own in by.items():
        assert own[0].target == pytest.approx(targets[source])
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    again = mixing.mix(docs.repartition(7), staging(spark, "t")).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def brute_draw(own, target):
    """Copies of (doc_id, size) rows of one source, document by document in Pareto order."""
    total = sum(size for _, size in own)
    if not total:
        return [1] * len(own)
    certain = int(target // total)
    left = target - certain * total
    out = left > 0.5 * total
    left = total - left if out else left
    step = lambda n: (n >> max(n.bit_length() - 5, 0)) << max(n.bit_length() - 5, 0)
    part = sorted((k for k, (_, n) in enumerate(own) if 0 < n <= left), key=lambda k: -step(own[k][1]))
    words = sum(own[k][1] for k in part)
    want, sure = (words - left if out else left), set()
    scale = 1.0 if want >= words else 0.0
    while 0 < want < words:
        rest = [k for k in part if k not in sure]
        scale = (want - sum(own[k][1] for k in sure)) / sum(step(own[k][1]) * own[k][1] for k in rest)
        over = {k for k in rest if scale * step(own[k][1]) > 1}
        if not over:
            break
        sure |= over
    ranks = []
    for k in part:
        doc_id, n = own[k]
        p = min(1.0, scale * step(n))
        digest = hashlib.md5(f"{'' if doc_id is None else doc_id}:{n}:{mixing.SEED}".encode()).hexdigest()
        u = (int(digest[:12], 16) + 0.5) / (1 << 48)
        p, u = (1 - p, 1 - u) if out else (p, u)
        if p > 0:
            ranks.append((u * (1 - p) / ((1 - u) * p), k))
    extra, ranks = set(), sorted(ranks)
    while ranks:
        for at, (_, k) in enumerate(ranks):
            if own[k][1] > left:
                break
            extra.add(k)
            left -= own[k][1]
        else:
            break
        ranks = [(r, k) for r, k in ranks[at + 1 :] if own[k][1] <= left]
    return [certain + ((k in extra) != out) for k in range(len(own))]


@pytest.mark.parametrize("seed", range(3))
def test_mixing_against_a_draw_one_by_one(spark, seed):
    random = np.random.default_rng(seed)
    sizes = np.concatenate([random.integers(0, 40, 150), random.integers(100, 4000, 25)])
    rows = [(int(k), [None, "a", "b", "c"][random.integers(4)], int(n)) for k, n in enumerate(sizes)]
    rows += [(1000, "tiny", 1), (1001, "tiny", 3), (1002, "one", 900), (1003, "empty", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = {r.doc_id: r for r in mixing.draw(sized, staging(spark, "t")).collect()}
    assert len(got) == len(rows)
    targets = brute_targets({s: sum(n for _, t, n in rows if t == s) for s in {s for _, s, _ in rows}})
    for source in targets:
        own = [(k, n) for k, s, n in rows if s == source]
        assert [got[k].copies for k, _ in own] == brute_draw(own, got[own[0][0]].target), source


def test_inclusion_grows_with_size_and_meets_the_words(spark):
    """Over many seeds a document is drawn about as often as its probability says."""
    rows = [(k, "a", 10 if k % 2 else 40) for k in range(60)] + [(100 + k, "b", 50) for k in range(10)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").coalesce(1)
    seen = [mixing.draw(sized, staging(spark, "t"), f"s{k}").where("source = 'a'").collect() for k in range(3)]
    often = lambda n: np.mean([r.copies - min(x.copies for x in draw) for draw in seen for r in draw if r.size == n])
    assert often(40) > 2.5 * often(10)


def test_mixed_documents_are_as_many_as_decided(spark, odd):
    stage = staging(spark, "t")
    want = sorted((r.doc_id or 0, r.taken) for r in mixing.mix(odd, stage).collect() if r.copies and r.size)
    got = mixing.mixed_documents(odd.selectExpr("*", "1 AS size", "2 AS copies"), staging(spark, "t"))
    assert got.columns == [*odd.columns, "size", "copies"]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got.collect())
    assert words == sum(t for _, t in want)


# 9


@pytest.fixture(scope="module")
def tokenizer():
    return pieces.Tokenizer(pieces.Vocabulary.load(f"{TOKENIZERS}/{VOCABULARY}"))


def test_pieces_equal_the_library(spark, odd, tokenizer):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{VOCABULARY}")
    docs = documents(spark).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    encoded = pieces.with_ids(docs, tokenizer)
    for r in pieces.with_text(encoded, tokenizer, into="back").collect():
        assert r.ids == model.encode(r.text or "")
        assert r.back == (r.text or "").replace("▁", " ")


def test_a_unigram_model_takes_the_best_path():
    r = np.random.default_rng(2)
    words = ["a", "b", "c", "▁", *{"".join(r.choice(list("abc"), n)) for n in r.integers(2, 5, 30)}]
    v = pieces.Vocabulary(["<unk>", *words], [0, *(-r.random(len(words)) * 9)], range(1, len(words) + 1), [], 0, "unigram")
    matcher, score = pieces.Matcher(v), dict(zip(words, v.scores[1:], strict=True))
    for text in ["".join(r.choice(list("abc"), n)) for n in range(1, 12)]:
        best = {0: 0.0}
        for end in range(1, len(text) + 2):
            full = "▁" + text
            best[end] = max((best[k] + score[full[k:end]] for k in range(end) if full[k:end] in score), default=-math.inf)
        ids = matcher.encode([text])[0]
        assert "".join(v.pieces[i] for i in ids) == "▁" + text
        assert sum(v.scores[i] for i in ids) == pytest.approx(best[len(text) + 1])


# 10


def brute_components(rows):
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set())

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        return k if up[k] == k else top(up[k])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(k)
    ids = {k: min((rows[m][0] for m in g if rows[m][0] is not None), default=None) for g in groups.values() for k in g}
    return sorted((repr(rows[k][0]), len(sets[k]), repr(ids[k])) for k in range(len(rows)))


def near_copies(seed):
    r = np.random.default_rng(seed)
    bases = [[f"w{k}" for k in r.integers(0, 200, 60)] for _ in range(3)]
    out = []
    for k in range(90):
        words = list(bases[k % 3])
        for at in r.integers(0, 60, r.integers(0, 4)):
            words[at] = f"v{r.integers(0, 30)}"
        out.append((k, " ".join(words[: r.integers(50, 61)])))
    return out


@pytest.mark.parametrize("part", [400, 2_000_000])
def test_components_by_brute_force(spark, odd, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "PART_TOKENS", part)
    rows = [(r[0], r[1]) for r in ODD] + [(100 + k, t) for k, t in near_copies(1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.jaccard_join(df, staging(spark, "t")).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_components(rows)


def test_classes_of_one_name_lose_no_link(spark, odd, monkeypatch):
    """Names of two bits: every set shares its name with many others."""
    monkeypatch.setattr(ngram_join, "node_of", lambda digest: None if digest is None else digest[0] % 4)
    rows = [(r[0], r[1]) for r in ODD] + [(100 + k, t) for k, t in near_copies(2)] + [(500, "a b c d e"), (501, "A b  c d e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.jaccard_join(df, staging(spark, "t")).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_components(rows)


def test_rows_that_repeat_reach_a_search_once_a_task(spark):
    rows = [(1, "one two three four five six seven")] * 300 + [(2, "one two three four five six seven eight")] * 300
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id bigint, text string").repartition(3)
    got = ngram_join.jaccard_join(df, staging(spark, "t"), percent=80).collect()
    assert len(got) == 601 and {r.component_id for r in got} == {1}


@pytest.mark.parametrize("seed", range(15))
def test_trie_by_brute_force(seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CELLS", [50, 5000, 10**7][seed % 3])
    monkeypatch.setattr(ngram_join, "FIRST_BLOCK", [1, 5, 64][seed % 3])
    sets = [ngram_join.shingles(t.encode()) for _, t in near_copies(seed)]
    sets = [np.array(s, dtype=np.uint64) for s in {tuple(s.tolist()) for s in sets}]
    n = len(sets)
    links = {(i, j) for i, j in itertools.combinations(range(n), 2) for x in [len(np.intersect1d(sets[i], sets[j]))] if 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x)}
    got = ngram_join.Trie(sets).forest()
    assert {tuple(sorted(p)) for p in got} <= links

    def roots(pairs):
        up = list(range(n))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    assert roots(got) == roots(links)


def test_one_document_of_each_component_stays(spark, odd):
    kept = ngram_join.one_of_each(odd.selectExpr("*", "1 AS row", "2 AS root"), staging(spark, "t"))
    assert kept.columns == [*odd.columns, "row", "root"]
    assert sorted((r.doc_id or 0, r.text or "")[0] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


# all


def test_odd_and_empty_tables(spark, odd, none, labels):
    for docs, n in ((odd, len(ODD)), (none, 0)):
        stage = lambda: staging(spark, "t")
        extra = docs.selectExpr("*", "1 AS score", "2 AS size", "3 AS x", "4 AS row", "5 AS token")
        for some in (labels, labels.limit(0)):
            assert toxicity.score_documents(extra, some, stage()).count() == n
            assert quality_classifier.classify(extra, some, stage()).count() == n
        assert toxicity.reject_toxic(extra, labels, stage()).columns == extra.columns
        assert quality_rules.quality_table(extra, stage()).count() == n
        assert sharding.shard_rows(extra, stage()).count() == n
        assert mixing.mix(extra, stage()).count() == n
        assert ngram_join.jaccard_join(extra, stage()).count() == n
        assert licenses.license_scan(extra).count() == n


def test_pipeline_keeps_columns_and_counts(spark):
    import corpus_pipeline

    docs = documents(spark)
    stage = staging(spark, "t")
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES):
        out = stage.put(fn(spark, docs, FOLDER), f"s{k}")
        if k < 4:
            assert out.columns == docs.columns and out.count() > 0
        docs = out
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, corpus_pipeline.run(spark, FOLDER).collect()))


def test_pipeline_drops_copies_by_five_words_and_80_percent(spark):
    import corpus_pipeline

    def similarity(a, b, n):
        x, y = (set(zip(*(t.split()[k:] for k in range(n)), strict=False)) for t in (a, b))
        return len(x & y) / len(x | y)

    rows, near = [], 0
    for k in range(12):
        words = [f"d{k}w{i}" for i in range(100)]
        other = words.copy()
        for at in range(10, 10 + 2 * 40, 40):
            other[at] = f"x{at}"
        if k % 2:
            other[70] = "y"  # a third word: below 80 percent
        rows += [(10 * k, " ".join(words), "en", "a", 1), (10 * k + 1, " ".join(other), "en", "a", 1)]
        near += 0.8 <= similarity(rows[-2][1], rows[-1][1], 5) < 0.85 and similarity(rows[-2][1], rows[-1][1], 4) < 0.85
    assert near == 6
    left = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, DOCS), FOLDER)
    want = [r[0] for r in rows if r[0] % 10 == 0 or similarity(r[1], next(x[1] for x in rows if x[0] == r[0] - 1), 5) < 0.8]
    assert sorted(r.doc_id for r in left.collect()) == sorted(want)
