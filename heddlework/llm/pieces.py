"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces and what follows up to the next space) are
laid end to end and a suffix array of the text is sorted to the length of the longest piece.
Every piece of the vocabulary finds its occurrences as one range by binary search. The
occurrences are the edges of the segmentation graph; they are sorted by position into a table
of (position, length), and a relaxation over that table gives the segmentation:

* a ``unigram`` model takes the path of the largest sum of scores;
* a ``bpe`` model takes, again and again, the edge of the best score that joins two
  neighbouring pieces, the leftmost of equals, until none is left.

Characters no piece covers become byte pieces, or the unknown piece if there are none. No
piece of a vocabulary may hold a space behind another character; where one does, units are
whole texts. Spaces are written as U+2581 and a text gets one in front.

Null texts are empty and give no pieces.
"""

from __future__ import annotations

import re
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.llm.common import per_row, resident

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
CHUNK = 400_000
"""Characters indexed at a time."""
REMEMBERED = 80_000_000
"""Bytes of units and their pieces that a worker keeps from batch to batch."""
ENTRY = 240
"""Bytes of a remembered unit beside its characters and pieces."""
LONG = 300
"""Longer units are joined by a queue of edges, shorter ones side by side."""


class Vocabulary:
    """Pieces, scores and kinds, read from a model file on the driver and sent to the tasks."""

    def __init__(self, pieces, scores, normal, byte_ids, unknown, kind):
        self.pieces, self.scores, self.kind = pieces, np.asarray(scores, dtype=np.float64), kind
        self.byte_ids, self.unknown = byte_ids, unknown
        self.normal = [i for i in normal if pieces[i]]
        self.longest = max(len(pieces[i]) for i in self.normal)
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in self.normal)

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        special = [i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(model.is_byte, ids)) else []
        normal = sorted(set(ids) - set(special) - set(byte_ids))
        return cls(pieces, [model.get_score(i) for i in ids], normal, byte_ids, model.unk_id(), kind)


class Matcher:
    """Segments batches of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.ids = np.array(v.normal)
        chars = sorted({c for i in v.normal for c in v.pieces[i]})
        # Letters of the vocabulary as 1, 2, ...; 0 is anything else and the end of a unit.
        self.letter = np.zeros(0x110000, dtype=np.uint16)
        self.letter[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = -(-v.longest // 4)
        self.lengths = np.array([len(v.pieces[i]) for i in v.normal])
        codes = np.zeros((len(v.normal), self.width * 4), dtype=np.uint64)
        for row, i in enumerate(v.normal):
            codes[row, : self.lengths[row]] = [self.letter[ord(c)] for c in v.pieces[i]]
        self.low = _pack(codes, self.width)
        # The first text behind all that begin with the piece.
        above = codes.copy()
        for row, n in enumerate(self.lengths):
            above[row, n:] = 0xFFFF
        self.high = _pack(above, self.width)
        order = np.argsort(-v.scores[self.ids], kind="stable")
        self.rank = np.empty(len(self.ids), dtype=np.int32)
        self.rank[order] = np.arange(len(order))
        # Pieces of equal score rank alike.
        ordered = v.scores[self.ids][order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
        self.rank[order] = np.repeat(first, np.diff(np.append(first, len(order))))
        self.remembered: dict[str, bytes] = {}
        self.held = 0
        # For decoding: a byte piece is its byte, a control piece nothing.
        self.bytes = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for i in set(range(len(v.pieces))) - set(v.normal):
            self.bytes[i] = b""
        for b, i in enumerate(v.byte_ids):
            self.bytes[i] = bytes([b])
        self.bytes[v.unknown] = b" \xe2\x81\x87 "

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of pieces in a text of letters: (position, row of the piece)."""
        padded = np.concatenate([text, np.zeros(self.width * 4, dtype=np.uint16)]).astype(np.uint64)
        n = len(text)
        four = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
        keys = [four[4 * k : 4 * k + n] for k in range(self.width)]
        array = np.lexsort(keys[::-1])
        first = _search(keys, array, self.low, strict=False)
        last = _search(keys, array, self.high, strict=True)
        times = last - first
        starts = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        return array[starts + np.arange(times.sum())], np.repeat(np.arange(len(times)), times)

    def table(self, text: np.ndarray) -> np.ndarray:
        """Rows of pieces by (position, length), -1 for none."""
        at, piece = self.edges(text)
        out = np.full((len(text), self.v.longest + 1), -1, dtype=np.int32)
        out[at, self.lengths[piece]] = piece
        return out

    def segment(self, units: list[str]) -> list[bytes]:
        """Piece ids of each unit, as bytes of 32-bit numbers."""
        joined = "\0".join(units) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        text = self.letter[codes]
        table = self.table(text)
        ends = np.flatnonzero(codes == 0) if "\0" not in "".join(units) else np.cumsum([len(u) + 1 for u in units]) - 1
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        unit_of = np.cumsum(~inside) - ~inside
        starts, sizes = (self._merge if self.v.kind == "bpe" else self._best_path)(table, inside, unit_of)
        return self._emit(table, codes, starts, sizes, unit_of, len(units))

    def _merge(self, table, inside, unit_of):
        """Join neighbours by the best edge of each unit until no unit has one."""
        at = np.flatnonzero(inside)
        done_at, done_size = [], []
        lengths = np.bincount(unit_of[at]) if len(at) else np.zeros(0, dtype=np.int64)
        for unit in np.flatnonzero(lengths > LONG).tolist():
            starts, taken = self._merge_long(table, at[np.searchsorted(unit_of[at], unit) :][: lengths[unit]])
            done_at.append(starts)
            done_size.append(taken)
        at = at[lengths[unit_of[at]] <= LONG]
        size = np.ones(len(at), dtype=np.int64)
        longest = self.v.longest
        while len(at):
            unit = unit_of[at]
            both = size[:-1] + size[1:]
            fits = (unit[:-1] == unit[1:]) & (both <= longest)
            piece = np.where(fits, table[at[:-1], np.where(fits, both, 0)], -1)
            best = np.full(len(at), np.iinfo(np.int64).max)
            found = piece >= 0
            best[:-1][found] = self.rank[piece[found]].astype(np.int64) * len(at) + np.flatnonzero(found)
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            least = np.minimum.reduceat(best, heads)
            open_ = least < np.iinfo(np.int64).max
            live = np.repeat(open_, np.diff(np.append(heads, len(at))))
            done_at.append(at[~live])
            done_size.append(size[~live])
            join = least[open_] % len(at)
            size[join] += size[join + 1]
            live[join + 1] = False
            at, size = at[live], size[live]
        at, size = np.concatenate(done_at or [at]), np.concatenate(done_size or [size])
        order = np.argsort(at, kind="stable")
        return at[order], size[order]

    def _merge_long(self, table, at):
        """As ``_merge`` for one unit: its edges wait in a queue by score and place, so a long unit takes n log n steps."""
        first, n, longest = int(at[0]), len(at), self.v.longest
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank

        def edge(k):
            """Offers the edge from place k over itself and the next."""
            to = after[k]
            if to < n and size[k] + size[to] <= longest:
                piece = table[first + k, size[k] + size[to]]
                if piece >= 0:
                    heappush(queue, (int(rank[piece]), k, size[k], size[to]))

        pair = table[at[:-1], 2] if longest > 1 else np.full(n - 1, -1)
        found = np.flatnonzero(pair >= 0)
        queue = list(zip(rank[pair[found]].tolist(), found.tolist(), [1] * len(found), [1] * len(found), strict=True))
        heapify(queue)
        while queue:
            _, k, left, right = heappop(queue)
            to = after[k]
            if size[k] != left or to >= n or size[to] != right:
                continue
            size[k], size[to] = left + right, 0
            after[k] = after[to]
            if after[k] < n:
                before[after[k]] = k
            edge(k)
            if before[k] >= 0:
                edge(before[k])
        size = np.array(size, dtype=np.int64)
        kept = np.flatnonzero(size)
        return at[kept], size[kept]

    def _best_path(self, table, inside, unit_of):
        """Relax the edges in order of position, all units side by side."""
        n = len(inside)
        score = np.full(n + 1, -np.inf)
        back = np.zeros(n + 1, dtype=np.int64)
        heads = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        score[heads] = 0.0
        worst = self.v.scores[self.ids].min() - 10
        front = heads
        while len(front):
            for size in range(1, self.v.longest + 1):
                piece = table[front, size]
                gain = np.where(piece >= 0, self.v.scores[self.ids[piece]], worst if size == 1 else -np.inf)
                to = np.minimum(front + size, n)
                better = score[front] + gain > score[to]
                score[to[better]] = (score[front] + gain)[better]
                back[to[better]] = size
            front = front + 1
            front = front[(front < n) & inside[np.minimum(front, n - 1)]]
        starts, sizes = [], []
        at = np.flatnonzero(~inside)
        first = np.zeros(n + 1, dtype=bool)
        first[heads] = True
        at = at[(at > 0) & inside[np.maximum(at - 1, 0)]]
        while len(at):
            starts.append(at - back[at])
            sizes.append(back[at])
            at = at - back[at]
            at = at[~first[at]]
        starts, sizes = np.concatenate(starts or [heads]), np.concatenate(sizes or [heads])
        order = np.argsort(starts, kind="stable")
        return starts[order], sizes[order]

    def _emit(self, table, codes, starts, sizes, unit_of, n_units):
        piece = table[starts, sizes]
        out = np.where(piece >= 0, self.ids[piece], self.v.unknown).astype(np.int32)
        count = np.ones(len(out), dtype=np.int64)
        lost = np.flatnonzero(piece < 0)
        if len(lost) and self.v.byte_ids:
            spelled = {}
            for k in lost.tolist():
                code = int(codes[starts[k]])
                if code not in spelled:
                    spelled[code] = [self.v.byte_ids[b] for b in chr(code).encode()]
                count[k] = len(spelled[code])
            long = np.repeat(out, count)
            places = np.cumsum(count) - count
            for k in lost.tolist():
                row = spelled[int(codes[starts[k]])]
                long[places[k] : places[k] + len(row)] = row
            out = long
        per_unit = np.bincount(unit_of[starts], weights=count, minlength=n_units).astype(np.int64)
        flat, ends = out.tobytes(), (4 * np.cumsum(per_unit)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def units(self, text: str) -> list[str]:
        written = SPACE + text.replace(" ", SPACE)
        return UNIT.findall(written) if self.v.splits else [written]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.units(t) if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.remembered.clear()
            self.held = 0
        known = self.remembered
        fresh = list({u for units in split for u in units if u not in known})
        low = 0
        while low < len(fresh):
            high, chars = low, 0
            while high < len(fresh) and (high == low or chars + len(fresh[high]) < CHUNK):
                chars += len(fresh[high]) + 1
                high += 1
            for unit, ids in zip(fresh[low:high], self.segment(fresh[low:high]), strict=True):
                known[unit] = ids
                self.held += len(unit) + len(ids) + ENTRY
            low = high
        return [np.frombuffer(b"".join([known[u] for u in units]), dtype=np.int32) for units in split]

    def decode(self, ids) -> str:
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _pack(codes: np.ndarray, width: int) -> list[np.ndarray]:
    u = np.uint64
    return [
        codes[:, 4 * k] << u(48) | codes[:, 4 * k + 1] << u(32) | codes[:, 4 * k + 2] << u(16) | codes[:, 4 * k + 3]
        for k in range(width)
    ]


def _search(keys, array, wanted, strict: bool) -> np.ndarray:
    """For each wanted key the number of suffixes before it (or, if strict, up to it)."""
    low = np.zeros(len(wanted[0]), dtype=np.int64)
    high = np.full(len(wanted[0]), len(array), dtype=np.int64)
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high) // 2, 0)
        suffix = array[middle]
        before = np.full(len(low), strict)
        for key, want in zip(reversed(keys), reversed(wanted), strict=True):
            mine = key[suffix]
            before = np.where(mine == want, before, mine < want)
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


class Tokenizer:
    """A vocabulary that tasks turn into a matcher once for each worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.token = f"{vocabulary.kind}:{zlib.crc32(repr((vocabulary.pieces, vocabulary.scores.tolist())).encode()):08x}"

    def matcher(self) -> Matcher:
        return resident("pieces", self.token, lambda: Matcher(self.vocabulary))


def with_ids(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of ``text``."""
    encode = per_row(lambda texts: ((ids,) for ids in tokenizer.matcher().encode(texts)), "ids array<int>")
    return docs.withColumn(into, encode(F.col(text))["ids"])


def with_text(docs: DataFrame, tokenizer: Tokenizer, ids: str = "ids", into: str = "text") -> DataFrame:
    """``docs`` with the text that piece ids stand for; null ids give an empty text."""
    decode = per_row(lambda rows: ((tokenizer.matcher().decode(r or []),) for r in rows), "text string")
    return docs.withColumn(into, decode(F.col(ids))["text"])


def encode_documents(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_pieces, n_chars, ids_crc32 (of little-endian 32-bit ids), round_trip, one row for each document."""

    def run(texts):
        matcher = tokenizer.matcher()
        for text, ids in zip(texts, matcher.encode(texts), strict=True):
            text = text or ""
            yield len(ids), len(text), zlib.crc32(ids.astype("<i4").tobytes()), matcher.decode(ids.tolist()) == text

    column = per_row(run, "n_pieces bigint, n_chars bigint, ids_crc32 bigint, round_trip boolean")
    return docs.select("doc_id", column("text").alias("e")).select("doc_id", "e.*")


def tokenized(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, source, lang, n_pieces and ids, one row for each document."""
    out = with_ids(docs.select("doc_id", "source", "lang", "text"), tokenizer, into="ids")
    return out.select("doc_id", "source", "lang", F.size("ids").cast("bigint").alias("n_pieces"), "ids")
