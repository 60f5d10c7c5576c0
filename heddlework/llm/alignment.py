"""Alignment of two tokenizers over a corpus, each distinct text once.

A text is encoded by a byte-level BPE (A, behind a space) and by a SentencePiece model (B, which
puts the space in front itself). Byte places where a token of both ends cut the tokens into
groups; every A token of a group is linked with every B token of it. A pair of ids counts once
for each document that links it somewhere, and a document is measured by the counts of its links.

Copies are found by a shuffle by full text with a count that combines before it. Each distinct
text is tokenised and aligned once. Texts are taken in blocks: a block lists its distinct id pairs
once, with counts weighted by copies, and its texts refer to places in that list. So pairs are
added up, and their counts come back, as one row for each block and pair and not for each link. The
measures are joined to the documents by a digest of the text.

Texts that are null or empty, and those whose tokens do not spell space + text, have no tokens: all
their numbers are 0 and the groups are ''. A text is the smallest unit of memory; a block
holds about ``BLOCK_BYTES`` or one longer text. Extra columns are ignored, equal rows are documents of
their own, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 16_000_000
"""Text of a block of pairs."""
STEP_BYTES = 1_000_000
"""Text that is tokenised and aligned at a time."""
WIDE = 256
"""Groups with more links than this are counted by distinct ids before they are paired."""

#: The pre-tokenizer of byte-level BPE (a fixed value of the vocabulary's format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Tokenizers:
    """The two vocabularies as file contents, read on the driver and sent to the tasks."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.byte_bpe, self.pieces = Path(byte_bpe).read_bytes(), Path(pieces).read_bytes()
        self.token = hashlib.sha256(self.byte_bpe + self.pieces).hexdigest()

    def aligner(self) -> Aligner:
        _LOADED[self.token] = self
        return _aligner(self.token)


_LOADED: dict[str, Tokenizers] = {}


@lru_cache(1)
def _aligner(token: str) -> Aligner:
    return Aligner(_LOADED[token])


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, then 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_vocabulary(content: bytes) -> dict[bytes, int]:
    """Tokens as bytes. Ids must be in the order of the merges, as ranks are."""
    model = json.loads(content)
    vocab, letters = model["model"]["vocab"], byte_letters()
    special = {t["content"] for t in model["added_tokens"]}
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("the ids of the byte-level vocabulary are not in the order of its merges")
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}


class Aligned:
    """Texts of one step: measures by text, and their distinct links (text, pair, times) in order."""

    def __init__(self, measures: np.ndarray, digests: list[str], text: np.ndarray, pair: np.ndarray, times: np.ndarray):
        self.measures, self.digests, self.text, self.pair, self.times = measures, digests, text, pair, times


class Aligner:
    def __init__(self, tokenizers: Tokenizers):
        import sentencepiece
        import tiktoken

        self.content, self.slow = tokenizers.byte_bpe, None
        ranks = byte_vocabulary(tokenizers.byte_bpe)
        self.a = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = model = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.pieces)
        self.a_sizes = np.ones(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.a_sizes[i] = len(token)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(model.id_to_piece(i) for i in range(model.get_piece_size()))
        ]
        self.b_sizes = np.array([len(p) for p in self.b_bytes], dtype=np.int64)
        # Decimal ids in rows of equal width; the letter behind the digits is a separator.
        most = max(len(self.a_sizes), len(self.b_sizes))
        self.digits = np.zeros((most, len(str(most)) + 1), dtype=np.uint8)
        self.width = np.zeros(most, dtype=np.int64)
        for i in range(most):
            text = str(i).encode()
            self.digits[i, : len(text)], self.width[i] = list(text), len(text)

    def byte_ids(self, text: str) -> np.ndarray:
        """A's ids. Very long runs of white space are beyond the fast library's patterns; the other one takes them."""
        try:
            return self.a.encode_to_numpy(text)
        except ValueError:
            from tokenizers import Tokenizer

            if self.slow is None:
                self.slow = Tokenizer.from_str(self.content.decode())
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def align(self, texts: list[str]) -> Aligned:
        """All numbers of a few texts; those without tokens have zeros and no links."""
        ids_b = self.b.encode(texts, num_threads=1)
        a_parts, b_parts, good = [], [], []
        for k, text in enumerate(texts):
            wanted = b" " + text.encode()
            spelled = b"".join(map(self.b_bytes.__getitem__, ids_b[k]))
            if not text or spelled != wanted:
                continue
            ids = self.byte_ids(" " + text)
            if self.a_sizes[ids].sum() == len(wanted):  # byte-level tokens cannot spell anything else
                a_parts.append(ids.astype(np.int64))
                b_parts.append(np.array(ids_b[k], dtype=np.int64))
                good.append(k)
        measures, digests = np.zeros((len(texts), len(MEASURES)), dtype=np.int64), [""] * len(texts)
        if not good:
            none = np.zeros(0, dtype=np.int64)
            return Aligned(measures, digests, none, none, none)

        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        n_a, n_b = np.array([len(p) for p in a_parts]), np.array([len(p) for p in b_parts])
        # Both sides spell the same bytes, so ends can be compared across all texts at once.
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        marked = np.zeros(end_a[-1] + 1, dtype=np.int8)
        marked[end_a] += 1
        marked[end_b] += 1
        last_a, last_b = marked[end_a] == 2, marked[end_b] == 2
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        links = size_a * size_b
        upto = group_a[np.cumsum(n_a) - 1] + 1  # groups up to the end of each text
        n_groups = np.diff(upto, prepend=0)
        text_of = np.repeat(np.arange(len(good)), n_groups)
        sums = np.add.reduceat(links, upto - n_groups)
        measures[good] = np.stack([n_a, n_b, n_groups, sums], axis=1)

        text, pair, times = self._links(a, b, size_a, size_b, links, text_of)
        for k, digest in zip(good, self._digests(a, b, group_a, group_b, last_a, last_b, n_a, n_b), strict=True):
            digests[k] = digest
        return Aligned(measures, digests, np.array(good)[text], pair, times)

    def _links(self, a, b, size_a, size_b, links, text_of):
        """(text, pair, times): the distinct id pairs of each text and how many links each has."""
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        few = links <= WIDE
        again = np.where(few, size_b, 0)
        repeat = np.repeat(again, size_a)
        left = np.repeat(np.arange(len(a)), repeat)
        nth = np.arange(len(left)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        right = np.repeat(np.repeat(start_b, size_a), repeat) + nth
        in_text = np.repeat(np.repeat(text_of, size_a), repeat)
        keys = [in_text << 32 | a[left] << 16 | b[right]]
        keys[0], times = np.unique(keys[0], return_counts=True)
        times = [times]
        for g in np.flatnonzero(~few).tolist():
            ids_a, of_a = np.unique(a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
            ids_b, of_b = np.unique(b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
            keys.append((text_of[g] << 32 | ids_a[:, None] << 16 | ids_b[None, :]).ravel())
            times.append((of_a[:, None] * of_b[None, :]).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        if not few.all():
            keys, place = np.unique(keys, return_inverse=True)
            summed = np.zeros(len(keys), dtype=np.int64)
            np.add.at(summed, place, times)
            times = summed
        return keys >> 32, keys & 0xFFFFFFFF, times

    def _digests(self, a, b, group_a, group_b, last_a, last_b, n_a, n_b) -> Iterator[str]:
        """The digest of each text's groups, written ``a1,a2|b1;a3|b2``."""
        before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])[group_a]
        upto_a = (np.flatnonzero(last_a) + 1)[group_b]
        n = len(a) + len(b)
        ids, sign = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + upto_a
        ids[place_a], ids[place_b] = a, b
        sign[place_a[last_a]], sign[place_b[last_b]] = ord("|"), ord(";")
        width = self.width[ids]
        rows = self.digits[ids]
        rows[np.arange(len(ids)), width] = sign
        flat = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
        ends = np.cumsum(width + 1)[np.cumsum(n_a + n_b) - 1].tolist()
        for start, end in zip([0, *ends], ends, strict=False):
            yield hashlib.sha256(flat[start : end - 1]).hexdigest()

    def groups(self, text: str) -> list[tuple[list[int], list[int], int, int]]:
        """The groups of one text: A ids, B ids, first byte and end in space + text."""
        ids_a, ids_b = self.byte_ids(" " + text).tolist(), self.b.encode(text)
        if not text or b"".join(self.b_bytes[i] for i in ids_b) != b" " + text.encode():
            return []
        end_a, end_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        cuts = np.intersect1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, cuts) + 1, np.searchsorted(end_b, cuts) + 1
        starts = zip([0, *at_a], [0, *at_b], [0, *cuts], strict=False)
        return [
            (ids_a[i:i2], ids_b[j:j2], int(c), int(c2)) for (i, j, c), i2, j2, c2 in zip(starts, at_a, at_b, cuts, strict=False)
        ]


# --- blocks ----------------------------------------------------------------------

BLOCK_SCHEMA = (
    "block bigint, key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "links binary, pairs array<bigint>, weights array<bigint>"
)


def _steps(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows of about ``size`` bytes of text together; a longer text comes alone."""
    held, total = [], 0
    for row in rows:
        if held and total + len(row[0]) > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[0])
    if held:
        yield held


def _links_blob(places: np.ndarray, times: np.ndarray) -> bytes:
    """Places in the block's list, as steps from one to the next, and times, as one binary value."""
    plain = np.concatenate([np.diff(places, prepend=0), times]).astype("<u4").tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _blob_links(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    plain = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), dtype="<u4").astype(np.int64)
    half = len(plain) // 2
    return np.cumsum(plain[:half]), plain[half:]


def _blocks(tokenizers: Tokenizers, block_bytes: int):
    kind = T.StructType.fromDDL(BLOCK_SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def one(block: int, rows: list[tuple], aligner: Aligner) -> Iterator[pa.RecordBatch]:
        """The rows of one block: its texts, then its list of pairs."""
        done, base, texts = [], 0, []
        for step in _steps(rows, STEP_BYTES):
            aligned = aligner.align([r[0] for r in step])
            done.append((aligned, base))
            base += len(step)
            texts += [(r[1], r[2]) for r in step]
        text = np.concatenate([d.text + at for d, at in done])
        pairs, place = np.unique(np.concatenate([d.pair for d, _ in done]), return_inverse=True)
        times = np.concatenate([d.times for d, _ in done])
        copies = np.array([c for _, c in texts], dtype=np.int64)
        weights = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(weights, place, copies[text])
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        blobs = [_links_blob(place[i:j], times[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        measures = np.concatenate([d.measures for d, _ in done]).T
        n = len(texts)
        columns = [
            pa.array([block] * n, pa.int64()), pa.array([k for k, _ in texts], pa.binary()), *map(pa.array, measures),
            pa.array([g for d, _ in done for g in d.digests]), pa.array(blobs, pa.binary()), pa.nulls(n, arrow.field("pairs").type),
            pa.nulls(n, arrow.field("weights").type),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        values = {"block": [block], "pairs": [pairs], "weights": [weights]}
        yield pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None]), f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, first = tokenizers.aligner(), TaskContext.get().partitionId() << 32
        rows = (tuple(r.values()) for batch in batches for r in batch.to_pylist())
        for k, block in enumerate(_steps(rows, block_bytes)):
            yield from one(first + k, block, aligner)

    return run, kind


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text, key and copies of each distinct text that can have tokens."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select("text", text_key().alias("key"), "copies")


def text_key():
    return F.when(F.col("text") != "", F.unhex(F.sha2("text", 256)))


def align_texts(docs: DataFrame, tokenizers: Tokenizers, stage, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned texts and their lists of pairs, as a written table."""
    run, kind = _blocks(tokenizers, block_bytes)
    return stage.put(distinct_texts(docs).mapInArrow(run, kind), "aligned")


def pair_counts(blocks: DataFrame, stage) -> DataFrame:
    """pair (A id times 65,536 plus B id), count, and whether the count is the highest of the A id."""
    each = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
    counts = stage.put(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("count")), "pair-counts")
    by_a = F.shiftright("pair", 16)
    most = counts.groupBy(by_a.alias("a")).agg(F.max("count").alias("most"))
    joined = counts.join(most, by_a == F.col("a"))
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _measure(left: pa.Table, right: pa.Table) -> pa.Table:
    """Texts of one block with the counts of its list of pairs."""
    place = right["place"].to_numpy()
    count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    count[place] = right["count"].to_numpy()
    best[place] = right["best"].to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for blob in left["links"].to_pylist():
        at, times = _blob_links(blob)
        n_best.append(int((best[at] * times).sum()))
        count_sum.append(int((count[at] * times).sum()))
    kept = left.select(["key", *MEASURES, "groups_sha256"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def measure_texts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Every number of each distinct text, by key."""
    listed = blocks.where("pairs is not null").select(
        F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")
    )
    known = listed.join(counts, "pair").select("of", "place", "count", "best")
    texts = blocks.where("key is not null").select("block", "key", *MEASURES, "groups_sha256", "links")
    schema = "key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_measure, schema)


def align_documents(docs: DataFrame, tokenizers: Tokenizers, stage, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id with its token, group and link numbers, one row for each document."""
    blocks = align_texts(docs, tokenizers, stage, block_bytes)
    measured = stage.put(measure_texts(blocks, pair_counts(blocks, stage)), "measured")
    numbers = [*MEASURES, "n_best", "count_sum"]
    out = docs.select("doc_id", text_key().alias("key")).join(measured, "key", "left")
    return out.select(
        "doc_id", *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
