"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is a trie of terms (whole words, and stems that any ending may follow). A word
runs through the product of the trie with the Levenshtein automaton of its edits: a state is
a set of (trie node, edits so far), built when first met and then looked up. Substitutions,
insertions, deletions and swaps count, at the first letter too; short terms and stems allow
none. Only words run that begin with a stem or have a form in common with a term after as many
letters are left out of both as edits may be: all words within the edits have one. Signs that
look like letters belong to a word, in a row and at its ends too; at its ends they are read
both ways.

Each hit is weighed by its context: between quotation marks, paired over the whole text, in a
quoted line, or right behind a word that reports speech, it is a quotation, else abuse. A document's score is a logistic model of
its numbers of exact, misspelled and quoted hits.

The lexicon starts from ``SEEDS`` and takes all words and stems that occur in enough toxic
training documents and, of all that hold them, at least ``MIN_PRECISION`` are toxic. Enough is
``MIN_SUPPORT`` or, where chance terms of so few documents fail on the other half of the
training documents, the least number that holds there. Lexicon and weights are fitted on at most ``SAMPLE`` labelled training documents,
chosen by a hash of their id. Labels, language, source and id are never inputs of a score.

Null and empty texts have no hits and get the score of none. Null labels count for nothing;
labels of a repeated id count as the largest. Without training rows the prior is even.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.llm.common import map_rows, per_row, resident

# Terms known without any label.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "imbecile", "asshole", "bastard")

SAMPLE = 20_000
MIN_SUPPORT, MIN_PRECISION = 4, 0.9
MAX_SUPPORT = 16
STEM = (4, 5, 6)
WINDOW = 60
COUNTED = 8
PREDICT_FROM = 0.7
TRAIN_MOD, HELD_OUT = 3, 1

#: Words; one does not begin inside a row of signs, so a long row of them is tried once.
WORDS = re.compile(r"(?<![@$])[@$]*\w+(?:(?:[@$]+|[!*'’])\w+)*[@$]*")
#: Letters that are often written as digits or signs (fixed values).
LOOKS_LIKE = str.maketrans("01345@$", "oieasas")
#: Words that report what somebody said (fixed values).
REPORTS = re.compile(r"\b(said|says|called|wrote|quoted?|quoting|word|term|insult|slur)\W*(?:\w+\W+){0,2}$")
#: Quotation marks with what may close them (fixed values).
CLOSED_BY = {'"': '"', "“": "”\"", "„": "“”\"", "«": "»", "»": "«", "‹": "›", "›": "‹", "'": "'’", "‘": "'’"}
#: Marks in the order of a text: double ones, single ones at the edge of a word, line ends.
MARKS = re.compile(r"[\"“”„«»‹›]|(?<!\w)['‘](?=\w)|(?<=[\w.,;!?])['’](?!\w)|\n")
BLOCK = re.compile(r"^[ \t]*>.*$", re.M)

NONE, FUZZY, EXACT = 0, 1, 2


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms and stems with its product automaton, built state by state."""

    #: What a worker keeps from batch to batch: tens of MB of states and words.
    MAX_STATES, MAX_SEEN = 60_000, 100_000

    def __init__(self, words: list[str], stems: list[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # edits that a whole term ending here allows
        self.most: list[int] = [-1]  # edits that a term ending here or below allows
        self.stem: list[bool] = [False]
        for word in words:
            self.ends[self._add(word, edits_for(word))] = edits_for(word)
        for stem in stems:
            self.stem[self._add(stem, 0)] = True
        self._start()

    def _add(self, term: str, edits: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], edits)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.ends.append(-1)
                self.most.append(-1)
                self.stem.append(False)
            node = self.children[node][c]
            self.most[node] = max(self.most[node], edits)
        return node

    def _start(self) -> None:
        first = self._closed({(0, ""): 0})
        self.states: dict[frozenset, int] = {frozenset(): 0, first: 1}
        self.members = [frozenset(), first]
        self.moves: list[dict[str, int]] = [{}, {}]
        self.accepts = [NONE, NONE]
        self._forget()

    def _forget(self) -> None:
        self.seen: set[str] = set()
        self.bad: dict[str, int] = {}

    def find(self, word: str) -> int:
        """Whether the word is in the lexicon exactly, with edits, or not."""
        if word not in self.seen:
            found = max(map(self._run, readings(word)))
            self.seen.add(word)
            if found:
                self.bad[word] = found
        return self.bad.get(word, NONE)

    def any_of(self, words: set[str]) -> bool:
        """Whether one of the words is in the lexicon; words met before cost no walk."""
        if len(self.states) > self.MAX_STATES:
            self._start()
        if len(self.seen) > self.MAX_SEEN:
            self._forget()
        for word in words.difference(self.seen):
            self.find(word)
        return not words.isdisjoint(self.bad)

    def _run(self, word: str) -> int:
        state, moves = 1, self.moves
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = moves[state][c] = self._move(state, c)
            if not to:
                return NONE
            if self.accepts[to] == EXACT + 1:  # past a stem, whatever follows
                return EXACT
            state = to
        return self.accepts[state]

    def _closed(self, members: dict[tuple[int, str], int]) -> frozenset:
        """With the nodes reached by term letters that the word lacks; the fewest edits of each."""
        todo = list(members)
        while todo:
            node, owed = todo.pop()
            edits = members[node, owed] + 1
            if owed:
                continue
            for below in self.children[node].values():
                if edits <= self.most[below] and edits < members.get((below, ""), 3):
                    members[below, ""] = edits
                    todo.append((below, ""))
        return frozenset((node, edits, owed) for (node, owed), edits in members.items())

    def _move(self, state: int, c: str) -> int:
        """The state after ``c``. A member is (node, edits, letter still owed by a swap)."""
        out: dict[tuple[int, str], int] = {}

        def reach(node, edits, owed=""):
            if edits <= self.most[node] and edits < out.get((node, owed), 3):
                out[node, owed] = edits

        for node, edits, owed in self.members[state]:
            if owed:
                if c == owed:
                    reach(node, edits)
                continue
            child = self.children[node]
            if c in child:
                reach(child[c], edits)
            if edits < self.most[node]:
                reach(node, edits + 1)
                for a, below in child.items():
                    if a != c:
                        reach(below, edits + 1)
                        if c in self.children[below]:
                            reach(self.children[below][c], edits + 1, a)
        key = self._closed(out)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            self.accepts.append(self._accept(key))
        return self.states[key]

    def _accept(self, members: frozenset) -> int:
        best = NONE
        for node, edits, owed in members:
            if owed:
                continue
            if not edits and self.stem[node]:
                return EXACT + 1
            if self.ends[node] >= edits:
                best = max(best, FUZZY if edits else EXACT)
        return best


def plain(word: str) -> str:
    if word.isascii() and word.isalpha():
        return word
    return word.translate(LOOKS_LIKE) if not word.strip("@$").isdigit() else word


def readings(word: str) -> set[str]:
    """A word in plain letters; signs at its ends may be letters or not."""
    return {plain(word), plain(word.strip("@$"))}


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between marks that belong together, in one pass, and lines that begin with >.

    A mark inside a quotation of another kind says nothing, an opening one that nothing closes
    neither. A straight mark right behind a digit opens none; single quotes end with their line.
    """
    marks = [(m.start(), m.group()) for m in MARKS.finditer(text)]
    spans, at = [], 0
    vain: dict[str, int] = {}  # up to this mark nothing closes the opening one
    while at < len(marks):
        start, mark = marks[at]
        at += 1
        if mark not in CLOSED_BY or at <= vain.get(mark, 0) or (mark == '"' and text[start - 1 : start].isdigit()):
            continue
        if mark in "'‘" and start and text[start - 1].isalnum():
            continue
        end = at
        while end < len(marks) and marks[end][1] not in CLOSED_BY[mark] and not (mark in "'‘" and marks[end][1] == "\n"):
            end += 1
        if end < len(marks) and marks[end][1] in CLOSED_BY[mark]:
            spans.append((start, marks[end][0]))
            at = end + 1
        else:
            vain[mark] = end
    return sorted(spans + [m.span() for m in BLOCK.finditer(text)])


def hits(text: str, lexicon: Lexicon) -> tuple[int, int, int]:
    """Numbers of exact, misspelled and quoted hits."""
    low, find = text.lower(), lexicon.find
    if not lexicon.any_of(set(WORDS.findall(low))):
        return 0, 0, 0
    exact = fuzzy = quoted = 0
    spans, k, upto = quotations(low), 0, 0
    for m in WORDS.finditer(low):
        kind = find(m.group())
        if kind:
            while k < len(spans) and spans[k][0] <= m.start():
                upto, k = max(upto, spans[k][1]), k + 1
            if m.start() < upto or REPORTS.search(low[max(0, m.start() - WINDOW) : m.start()]):
                quoted += 1
            elif kind == EXACT:
                exact += 1
            else:
                fuzzy += 1
    return exact, fuzzy, quoted


def features(counts: np.ndarray) -> np.ndarray:
    counts = np.minimum(np.asarray(counts, dtype=float).reshape(-1, 3), COUNTED)
    return np.column_stack([np.ones(len(counts)), np.log1p(counts)])


def fit_weights(table: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Ridge logistic regression on rows of (exact, misspelled, quoted, toxic, documents)."""
    weights = np.array([0.0, 1.0, 0.7, 0.1])
    if not table:
        return weights
    data = np.array(table, dtype=float)
    x, y, n = features(data[:, :3]), data[:, 3], data[:, 4]
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
    weights = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge @ weights
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, slope)
        weights = weights + np.clip(step, -2, 2)
    return weights


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TRAIN_MOD == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, stage) -> DataFrame:
    """(text, toxic) of at most ``SAMPLE`` labelled training documents; the ids are few enough to broadcast."""
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~is_held_out(F.col("doc_id")))
    labelled = labelled.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = stage.put(labelled, "labelled")
    total = labelled.count()
    order = F.xxhash64("doc_id", F.lit("sample"))
    share = min(1.0, 2 * SAMPLE / max(total, 1))
    near = labelled.where(order <= int(-(1 << 63) + share * ((1 << 64) - 1) // 1)) if share < 1 else labelled
    chosen = stage.put(near.orderBy(order, "doc_id").limit(SAMPLE), "chosen").withColumnRenamed("doc_id", "chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    return stage.put(rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic"), "training")


def units(text: str):
    """Distinct words and stems (marked by a star) of a text."""
    words = set().union(*map(readings, WORDS.findall(text.lower())))
    out = {w for w in words if len(w) >= 4}
    for n in STEM:
        out |= {w[:n] + "*" for w in words if len(w) >= n}
    return out


def unit_counts(training: DataFrame) -> DataFrame:
    """(unit, toxic, clean, halves): documents that hold each unit; counts add up before the shuffle.

    ``halves`` has the toxic and clean documents of each half, in which equal texts fall together.
    """
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")

    def count(rows):
        seen: dict[str, list[int]] = {}
        for row in rows:
            at = 2 * row["half"] + (0 if row["toxic"] else 1)
            for unit in units(row["text"]):
                seen.setdefault(unit, [0, 0, 0, 0])[at] += 1
            if len(seen) > 500_000:
                yield from ((u, *n) for u, n in seen.items())
                seen.clear()
        yield from ((u, *n) for u, n in seen.items())

    pairs = map_rows(training.select("text", "toxic", half.alias("half")), count, "unit string, t0 bigint, c0 bigint, t1 bigint, c1 bigint")
    total = pairs.groupBy("unit").agg(*[F.sum(n).alias(n) for n in ("t0", "c0", "t1", "c1")])
    return total.withColumns({"toxic": F.col("t0") + F.col("t1"), "clean": F.col("c0") + F.col("c1")})


def precise(toxic, clean):
    return toxic >= MIN_PRECISION * (toxic + clean)


def choose_support(counts: DataFrame) -> int:
    """The least support, from ``MIN_SUPPORT``, whose units stay precise in the half they were not taken from.

    A unit of one half counts for the supports s with s <= its toxic documents < 2 s. Without
    units that the other half holds too, it is ``MIN_SUPPORT``.
    """
    sums = []
    for s in range(MIN_SUPPORT, MAX_SUPPORT + 1):
        for n in "tc":
            both = [
                F.when((F.col(f"t{a}") >= s) & (F.col(f"t{a}") < 2 * s) & precise(F.col(f"t{a}"), F.col(f"c{a}")), F.col(f"{n}{b}"))
                for a, b in ((0, 1), (1, 0))
            ]
            sums.append(F.sum(sum(F.coalesce(x, F.lit(0)) for x in both)).alias(f"{n}{s}"))
    found = counts.agg(*sums).first()
    known = [s for s in range(MIN_SUPPORT, MAX_SUPPORT + 1) if found[f"t{s}"] or found[f"c{s}"]]
    good = [s for s in known if precise(found[f"t{s}"], found[f"c{s}"])]
    return good[0] if good else known[-1] if known else MIN_SUPPORT


def learn_lexicon(training: DataFrame, stage) -> tuple[list[str], list[str]]:
    """Terms and stems of the training documents. Only those that pass support and precision reach the driver."""
    counts = stage.put(unit_counts(training), "units")
    support = choose_support(counts)
    good = (F.col("toxic") >= support) & precise(F.col("toxic"), F.col("clean"))
    rows = counts.where(good | F.col("unit").isin(*SEEDS)).select("unit", "toxic", "clean", good.alias("good")).collect()
    words = {r["unit"] for r in rows if r["good"] and not r["unit"].endswith("*")}
    met = {r["unit"] for r in rows if r["toxic"] >= support or r["clean"]}
    words.update(s for s in SEEDS if s not in met)
    stems: set[str] = set()
    for stem in sorted((r["unit"][:-1] for r in rows if r["good"] and r["unit"].endswith("*")), key=lambda u: (len(u), u)):
        if not any(stem[:n] in stems for n in STEM):
            stems.add(stem)
    return sorted(words), sorted(stems)


class Model:
    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray | None = None):
        self.words, self.stems, self.weights = words, stems, weights

    def lexicon(self) -> Lexicon:
        """The automaton of this process; it is not sent along with the model."""
        key = (tuple(self.words), tuple(self.stems))
        return resident("toxicity", key, lambda: Lexicon(self.words, self.stems))

    def count(self, texts: list[str | None]):
        lexicon = self.lexicon()
        return [hits(t, lexicon) if t else (0, 0, 0) for t in texts]

    def score(self, texts: list[str | None]):
        counts = self.count(texts)
        margin = features(np.array(counts).reshape(-1, 3)) @ self.weights
        for (e, f, q), m in zip(counts, margin, strict=True):
            yield round(1 / (1 + math.exp(-max(-30.0, min(30.0, m)))), 9), e, f, q


def train(docs: DataFrame, labels: DataFrame, stage) -> Model:
    training = training_rows(docs, labels, stage)
    model = Model(*learn_lexicon(training, stage))
    counted = per_row(model.count, "exact int, fuzzy int, quoted int")
    found = training.select(counted("text").alias("c"), "toxic").select(
        *[F.least(F.col(f"c.{n}"), F.lit(COUNTED)).alias(n) for n in ("exact", "fuzzy", "quoted")], "toxic"
    )
    table = found.groupBy("exact", "fuzzy", "quoted", "toxic").count().collect()  # at most 2 * 9^3 rows
    model.weights = fit_weights(sorted(tuple(r) for r in table))
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    return docs.withColumn(into, per_row(model.score, "score double, exact int, fuzzy int, quoted int")(F.col(text)))


def score_documents(docs: DataFrame, labels: DataFrame, stage) -> DataFrame:
    """doc_id, held_out, score, predicted and the hits, one row for each document."""
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels, stage))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "toxicity.score",
        (F.col("toxicity.score") >= PREDICT_FROM).cast("int").alias("predicted"),
        "toxicity.exact", "toxicity.fuzzy", "toxicity.quoted",
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, stage) -> DataFrame:
    """The documents with a score below ``PREDICT_FROM``, with their own columns."""
    row = docs.select(F.struct("*").alias("row")).withColumn("text", F.col("row.text"))
    scored = with_scores(row, train(docs, labels, stage))
    return scored.where(F.col("toxicity.score") < PREDICT_FROM).select("row.*")
