"""N-gram Jaccard join with a prefix tree: all links of similarity ``PERCENT`` or more.

A document is the set of its distinct word n-grams as 64-bit hashes. Documents of equal sets
are one class (equal 128-bit digests). All sets are put in one global order, n-grams seen in
many documents last. With p = n - ceil(PERCENT n / 100) + 1, two sets that link share at least
l n-grams of the first p + l - 1 of each; l is about half of p. So a class stays in the search
only while enough n-grams of its head are in other heads too, which drops documents that have
nothing but a passage in common. Of its n-grams that are left, those of the fewest classes first, a
class then goes by all but the last l - 1: classes that link still meet in the first n-gram that they share.
Each n-gram forms a group, groups of the same classes are one. Groups that
hang together by members are one family, which is searched as one or group by group, whichever
sends fewer copies of its sets.

In this a class goes by 48 bits of its digest, and an n-gram of a head by its bucket and 32 bits of
its hash. Classes that share theirs are searched together, and n-grams that do are one, which counts as
often as a class has it; so a clash costs a search and loses no link; links and components go by the whole digest. What
travels to a search is the text of one document of each class, which is packed better than its n-grams.

In a search the sets are stored in a trie, in an order that puts what they share first, without
what only one of them has and without sets that have too much of that. The trie is walked once for a block of sets: sets under one node share the overlap counted so far,
and a subtree is left as soon as what remains of its sets and of the block's cannot bring the
overlap up to the threshold.

The order needs only to be the same for all documents, so the table of frequent n-grams may
have a fixed size (``FREQUENT``): it is broadcast, and it changes cost, never a result. More
than ``PART_TOKENS`` n-grams are dealt out as pairs of parts over many tasks. Each task gives
a spanning forest of the links it found, never all pairs; components of these links are the
components of all links.

Null texts are empty; documents without words have an empty set and link with nothing. Rows
that repeat are copies of one class. Null ids take part; a component's id is its smallest
known id.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddlework.llm.common import map_rows, text_bytes
from heddlework.llm.components import components

N = 4
PERCENT = 85
FREQUENT = 262_144
COUNTED_TOKENS = 4_000_000
"""n-grams that a task counts together."""
AT_LEAST = 3
PART_TOKENS = 2_000_000
BUCKET_TOKENS = 250_000
BLOCK_CELLS, BLOCK_SETS = 32_000_000, 512
FIRST_BLOCK = 64
FILTER_BITS = 24
NODE_BYTES = 6
SALTS = 32
"""Tasks over which the classes of one family are spread where they meet what is known of it."""

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the others, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


PIECE, LONG_WORD = 1 << 18, 1 << 16
"""Bytes hashed at a time, and the longest word of the polynomial hash; longer ones take xxh3."""

_OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_POWERS = np.full(PIECE + LONG_WORD + 1, 0xD6E8FEB86659FD93, dtype=np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each data[start:end], from running sums over all of ``data``."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = _OF_BYTE.take(data)
    terms *= _POWERS[: len(data)]
    np.cumsum(terms, out=sums[1:])
    words = sums.take(ends)
    words -= sums.take(starts)
    words *= _POWERS.take(len(_POWERS) - 1 - starts)
    return _mix(words)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word in order; a word has one hash wherever it stands."""
    data = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD.take(data)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(data) <= LONG_WORD:
        return _hash_words(data, starts, ends)
    out = np.empty(len(starts), dtype=np.uint64)
    long = ends - starts > LONG_WORD
    for k in np.flatnonzero(long):
        out[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]])
    at, starts, ends = np.flatnonzero(~long), starts[~long], ends[~long]
    cuts = np.searchsorted(starts, np.arange(0, len(data) + PIECE, PIECE))
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            first = starts[i]
            out[at[i:j]] = _hash_words(data[first : ends[j - 1]], starts[i:j] - first, ends[i:j] - first)
    return out


def shingles(text: bytes, n: int = N) -> np.ndarray:
    """Distinct n-grams of lower-cased words as sorted 64-bit hashes."""
    text = text.lower()
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(text.split()), len(hashes))], dtype=np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= _MULTIPLIER
        out += hashes[k : size + k]
    out = _mix(out)
    out.sort()
    fresh = np.ones(size, dtype=bool)
    np.not_equal(out[1:], out[:-1], out=fresh[1:])
    return out[fresh]


def needed(n: int, percent: int = PERCENT) -> int:
    """l, the number of n-grams that heads of linked sets share at least; never smaller for a larger set."""
    return 1 + (n + (-percent * n // 100) + 1) // 2


def head_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n + (-percent * n // 100) + needed(n, percent))


def first_of(tokens: np.ndarray, known: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The head in global order: n-grams that are not in ``known`` by hash, then those by rank."""
    want = head_length(len(tokens), percent) if len(tokens) else 0
    if not len(known):
        return tokens[:want]
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    frequent = known[at] == tokens
    rare = tokens[~frequent]
    if len(rare) >= want:
        return rare[:want]
    rest = tokens[frequent][np.argsort(rank[at[frequent]], kind="stable")]
    return np.concatenate([rare, rest])[:want]


OUTLINE = "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, node bigint, token bigint, times bigint"


def outlines(source: DataFrame, n: int = N) -> DataFrame:
    """A row for each document, and rows (token, times) of what a task met several times."""

    def often(sets):
        # Sorted in place: one copy of the n-grams, whatever their number.
        tokens = np.concatenate(sets)
        sets.clear()
        tokens.sort()
        starts = np.flatnonzero(tokens[AT_LEAST - 1 :] == tokens[: 1 - AT_LEAST])
        starts = starts[(starts == 0) | (tokens[starts - 1] != tokens[starts])]
        found = tokens[starts]
        times = np.searchsorted(tokens, found, side="right") - starts
        for token, n in zip(found.view(np.int64).tolist(), times.tolist(), strict=True):
            yield None, None, None, None, None, token, n

    def run(rows):
        sets, held = [], 0
        for row in rows:
            tokens = shingles(row["bytes"], n)
            digest = set_digest(tokens) if len(tokens) else None
            yield row["doc_id"], row["text_hash"], len(tokens), digest, node_of(digest), None, None
            sets.append(tokens)
            held += len(tokens)
            if held > COUNTED_TOKENS:
                yield from often(sets)
                sets, held = [], 0
        if sets:
            yield from often(sets)

    return map_rows(source, run, OUTLINE)


def frequent_ngrams(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that tasks met most often, sorted, with their ranks: at most ``FREQUENT``."""
    total = counts.groupBy("token").agg(F.sum("times").alias("n"))
    top = total.orderBy(F.col("n").desc(), "token").limit(FREQUENT).toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.argsort(np.argsort(top["n"].to_numpy()[order], kind="stable"), kind="stable")


def shared_heads(source: DataFrame, known, rank, buckets: int, n: int, percent: int) -> DataFrame:
    """(token, node): n-grams of heads that at least two classes have, as numbers of their own.

    Heads travel as packed arrays, one for each task and bucket of n-grams: 32 bits of each n-gram in ascending order, byte
    by byte, as the higher ones hardly differ, and the bytes of the classes. A task packs each class once.
    """

    def deal(batches):
        tokens, nodes, seen, held = [], [], set(), 0

        def packed():
            token, node = np.concatenate(tokens), np.concatenate(nodes)
            place = ((token % np.uint64(buckets)) << np.uint64(32)) | (token >> np.uint64(32))
            order = np.lexsort((node, place))
            place, node = place[order], node[order]
            bucket, prints = (place >> np.uint64(32)).astype(np.int64), place.astype(np.uint32)
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(heads[1:], len(bucket))
            cut = lambda pack, x: pa.array([pack(x[a:b]) for a, b in zip(heads, ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[heads]), cut(lambda x: x.view(np.uint8).reshape(-1, 4).T.tobytes(), prints), cut(pack_nodes, node)],
                names=["bucket", "tokens", "nodes"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingles(text, n)
                digest = set_digest(found)
                if len(found) and digest not in seen:
                    seen.add(digest)
                    head = first_of(found, known, rank, percent)
                    tokens.append(head)
                    nodes.append(np.full(len(head), node_of(digest)))
                    held += len(head)
            if held > COUNTED_TOKENS // 4:
                yield packed()
                tokens, nodes, seen, held = [], [], set(), 0
        if held:
            yield packed()

    def meet(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        for bucket, group in groupby(rows, key=lambda r: r["bucket"]):
            token, node, nth = [], [], []
            for row in group:
                token.append(np.ascontiguousarray(np.frombuffer(row["tokens"], dtype=np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0])
                node.append(unpack_nodes(row["nodes"]))
                # A class has an n-gram more than once where several share their 32 bits.
                first = np.concatenate([[True], (token[-1][1:] != token[-1][:-1]) | (node[-1][1:] != node[-1][:-1])])
                at = np.arange(len(first), dtype=np.int32)
                nth.append(at - np.maximum.accumulate(np.where(first, at, 0)))
            token, node, nth = np.concatenate(token), np.concatenate(node), np.concatenate(nth)
            order = np.lexsort((nth, node, token))
            token, node, nth = token[order], node[order], nth[order]
            same = token[1:] == token[:-1]
            fresh = np.concatenate([[True], ~(same & (node[1:] == node[:-1]) & (nth[1:] == nth[:-1]))])  # copies of a class
            token, node = token[fresh], node[fresh]
            same = token[1:] == token[:-1]
            several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            number = np.cumsum(np.concatenate([[0], token[several][1:] != token[several][:-1]])[: several.sum()])
            yield pa.RecordBatch.from_arrays([pa.array((bucket << 32) + number), pa.array(node[several])], names=["token", "node"])

    blocks = source.select("bytes").mapInArrow(deal, "bucket bigint, tokens binary, nodes binary")
    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "token bigint, node bigint")


def peel(members: DataFrame, needs: DataFrame, stage) -> DataFrame:
    """Members without classes that share too little, until a round would drop less than a tenth.

    ``needs``: node, need, and the classes of the node and their n-grams. Rows (token, node, least, classes, tokens):
    beside its smallest node each row of an n-gram holds how many classes it has, and how many n-grams these have.
    """
    rows, k = members.select("token", "node"), 0
    while True:
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("has"))
        enough = F.col("has") >= F.col("need")
        counts = counts.join(needs, "node").select("node", "has", "classes", "tokens", enough.alias("enough"))
        counts, seen = stage.put_measured(counts, f"counts-{k}", all=F.sum("has"), kept=F.sum(F.when(F.col("enough"), F.col("has"))))
        if k and seen["kept"] >= 0.9 * seen["all"]:
            return rows
        k += 1
        left = rows.select("token", "node").join(counts.where("enough").select("node", "classes", "tokens"), "node")
        several = left.groupBy("token").agg(
            F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.sum("classes").alias("classes"), F.sum("tokens").alias("tokens")
        )
        rows = left.select("token", "node").join(several.where("n > 1").drop("n"), "token")
        rows = stage.put(rows.select("token", "node", "least", "classes", "tokens"), f"members-{k}")


def thin(members: DataFrame, needs: DataFrame, stage) -> DataFrame:
    """Members of as few groups as find every link: (token, node, least, classes, tokens), each row once.

    In one order of the n-grams, by how many classes have them, a class keeps all but the last need - 1 of its own. Two that
    share ``need`` have the first of these before the last need - 1 of either. One n-gram stays for all that have the same nodes.
    """
    of_node = Window.partitionBy("node")
    own = needs.select("node", "need", F.col("classes").alias("of_classes"), F.col("tokens").alias("of_tokens"))
    rows = members.join(own, "node").withColumns({
        "place": F.row_number().over(of_node.orderBy("classes", "token")), "has": F.count(F.lit(1)).over(of_node),
    })
    rows = rows.where(F.col("place") <= F.col("has") - F.col("need") + 1).select("token", "node", "of_classes", "of_tokens").distinct()
    rows = stage.put(rows, "first")
    groups = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.sum("of_classes").alias("classes"), F.sum("of_tokens").alias("tokens"),
        F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("mark_2"),
    )
    groups = groups.where("n > 1").groupBy("n", "least", "mark", "mark_2").agg(
        F.min("token").alias("token"), F.first("classes").alias("classes"), F.first("tokens").alias("tokens")
    )
    rows = rows.select("token", "node").join(groups.select("token", "least", "classes", "tokens"), "token")
    return stage.put(rows, "thinned")


def set_digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def node_of(digest: bytes | None) -> int | None:
    return None if digest is None else int.from_bytes(digest[:NODE_BYTES], "little")


def pack_nodes(nodes: np.ndarray) -> bytes:
    return nodes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :NODE_BYTES].tobytes()


def unpack_nodes(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // NODE_BYTES, 8), dtype=np.uint8)
    out[:, :NODE_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, NODE_BYTES)
    return out.view("<i8")[:, 0]


class Trie:
    """Sets of local token numbers in lexicographic order; a node is a range of them at a depth."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        found, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        of = np.repeat(np.arange(len(sets)), sizes)
        # An n-gram of one set only adds to no overlap; a set with too few others has no link.
        alive = np.ones(len(sets), dtype=bool)
        while True:
            times = np.bincount(inverse[alive[of]], minlength=len(found))
            shared = np.bincount(of[times[inverse] > 1], minlength=len(sets))
            still = alive & (100 * shared >= percent * sizes)
            if (still == alive).all():
                break
            alive = still
        rank = np.empty(len(found), dtype=np.int64)
        rank[np.lexsort((found, -times))] = np.arange(len(found))
        use = alive[of] & (times[inverse] > 1)
        cuts = np.cumsum(np.bincount(of[use], minlength=len(sets)))[:-1]
        local = [np.sort(s) for s in np.split(rank[inverse[use]], cuts)]
        self.at = sorted(np.flatnonzero(alive).tolist(), key=lambda i: local[i].astype(">i8").tobytes())
        self.sets = [local[i] for i in self.at]
        self.sizes = sizes[self.at]
        self.shared = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.n_tokens, self.percent = int((times > 1).sum()), percent

    def forest(self) -> list[tuple[int, int]]:
        """Links (i, j) of given positions that join all that link, and no more than that needs.

        Blocks of sets walk the trie. Sets of the largest component so far need no walk of their
        own: what may still join it walks itself.
        """
        n = len(self.sets)
        label, members, out = np.arange(n), {k: [k] for k in range(n)}, []
        if n < 2:
            return out
        walked = np.zeros(n, dtype=bool)
        block = self._cut(np.unique(np.linspace(0, n - 1, min(n, FIRST_BLOCK)).astype(np.int64)))
        while len(block):
            for i, j in self._walk(block, label):
                if label[i] != label[j]:
                    small, large = sorted((int(label[i]), int(label[j])), key=lambda k: len(members[k]))
                    label[members[small]] = large
                    members[large] += members.pop(small)
                    out.append((self.at[i], self.at[j]))
            walked[block] = True
            largest = np.bincount(label, minlength=n).argmax()
            block = self._cut(np.flatnonzero(~walked & (label != largest))[:BLOCK_SETS])
        return out

    def _cut(self, block: np.ndarray) -> np.ndarray:
        """As much of a block as keeps its table of n-grams by sets within ``BLOCK_CELLS``."""
        cells = np.cumsum(self.sizes[block]) * np.arange(1, len(block) + 1)
        return block[: max(1, int((cells <= BLOCK_CELLS).sum()))]

    def _walk(self, block: np.ndarray, label: np.ndarray):
        """Pairs of a set of the block and another that link and are not one component yet."""
        sizes, shared, percent = self.sizes[block], self.shared[block], self.percent
        # A row for each n-gram of the block; others add to no overlap.
        tokens = np.unique(np.concatenate([self.sets[i] for i in block]))
        row_of = np.full(self.n_tokens, -1, dtype=np.int32)
        row_of[tokens] = np.arange(len(tokens))
        has = np.zeros((len(tokens), len(block)), dtype=np.uint8)
        for k, i in enumerate(block):
            has[row_of[self.sets[i]], k] = 1
        own_label, all_labels = label[block], label.copy()
        changes = np.concatenate([[0], np.cumsum(all_labels[1:] != all_labels[:-1])])
        stack = [(0, len(self.sets), 0, np.arange(len(block)), np.zeros(len(block), dtype=np.int64))]
        while stack:
            a, b, depth, alive, overlap = stack.pop()
            if changes[a] == changes[b - 1]:  # one component: its own members look elsewhere
                other = own_label[alive] != all_labels[a]
                alive, overlap = alive[other], overlap[other]
            if not len(alive):
                continue
            first, last = self.sets[a], self.sets[b - 1]
            until = _common(first, last, depth) if b - a > 1 else len(first)
            rows = row_of[first[depth:until]]
            rows = rows[rows >= 0]
            if len(rows):
                overlap = overlap + has[np.ix_(rows, alive)].sum(axis=0, dtype=np.int64)
            own = sizes[alive]
            small, large = self.sizes[a:b].min(), self.shared[a:b].max()
            most = overlap + np.minimum(large - until, shared[alive] - overlap)
            keep = (100 + percent) * most >= percent * (own + small)
            alive, overlap = alive[keep], overlap[keep]
            if not len(alive):
                continue
            if b - a == 1:
                union = sizes[alive] + self.sizes[a] - overlap
                for k in alive[100 * overlap >= percent * union]:
                    yield int(block[k]), a
                continue
            start = a
            while start < b and len(self.sets[start]) == until:  # the shortest of the range end at this node
                stack.append((start, start + 1, until, alive, overlap))
                start += 1
            if start == b:
                continue
            heads = np.array([self.sets[i][until] for i in range(start, b)])
            edges = [start, *(start + 1 + np.flatnonzero(heads[1:] != heads[:-1])), b]
            stack += [(x, y, until, alive, overlap) for x, y in zip(edges, edges[1:], strict=False)]


def _common(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[depth:n] != y[depth:n])
    return depth + int(differ[0]) if len(differ) else n


def bit_of(ids: pa.Array) -> np.ndarray:
    values = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
    return ((values * _MULTIPLIER) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def bit_map(ids: DataFrame) -> np.ndarray:
    """Which of 2^``FILTER_BITS`` places the ids fall on; a few packed maps reach the driver."""

    def mark(batches):
        out = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            out[bit_of(batch.column(0))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()])], names=["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in ids.coalesce(4).mapInArrow(mark, "bits binary").collect():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return np.unpackbits(out).astype(bool)


def places(members: DataFrame, nodes: DataFrame, stage) -> DataFrame:
    """(of, key, x, y, node): the searches that each class takes part in.

    A family, and a group, of more than ``PART_TOKENS`` n-grams is cut into parts by a hash, and
    every pair of parts is a search. A family is searched as one or group by group, whichever
    sends fewer copies of its sets.
    """
    tokens = F.sum("n_shingles").alias("tokens")
    # All nodes of an n-gram are of one family, so that of its smallest is its own, and the n-gram alone names a group.
    of_node = nodes.select(F.col("node").alias("least"), "family").distinct()
    groups = members.where("node = least").join(of_node, "least").select("family", "token", "tokens", F.col("classes").alias("n"))
    groups = stage.put(groups.select("family", "token", F.expr(f"1 + tokens DIV {PART_TOKENS}").alias("parts"), "n"), "groups")
    apart = groups.groupBy("family").agg(F.sum(F.col("n") * F.col("parts")).alias("sent_apart"))
    families = nodes.groupBy("family").agg(tokens, F.count(F.lit(1)).alias("n"))
    families = families.withColumn("parts", F.expr(f"1 + tokens DIV {PART_TOKENS}")).join(apart, "family", "left")
    at_once = F.coalesce(F.col("n") * F.col("parts") <= F.col("sent_apart"), F.lit(True))
    families = families.withColumn("at_once", at_once).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = lambda column: F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")
    # Spark sizes salted rows as one of each, so these are not for a broadcast.
    salted = families.where("at_once").select("family", "salt", "parts").hint("merge")
    one = nodes.withColumn("salt", salt("node")).join(salted, ["family", "salt"])
    one = one.select(F.lit("family").alias("of"), F.col("family").alias("key"), "parts", "node")
    salted = families.where("NOT at_once").select("family", "salt").hint("merge")
    split = groups.withColumn("salt", salt("token")).join(salted, ["family", "salt"])
    many = members.select("token", "node").join(split.select("token", "parts"), "token")
    many = many.select(F.lit("group").alias("of"), F.col("token").alias("key"), "parts", "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, part).alias("x"), F.greatest(k, part).alias("y")),
    )
    dealt = one.distinct().unionByName(many).withColumn("place", F.explode(pairs))
    return dealt.select("of", "key", "place.x", "place.y", "node")


def jaccard_classes(docs: DataFrame, stage, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest, root: one row for each document.

    Documents of one ``root`` are one component; it is null for empty sets.
    """
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_bytes("text").alias("bytes"))
    seen = stage.put(outlines(source, n), "outlines")
    rows = seen.where("n_shingles IS NOT NULL").drop("token", "times")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.first("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "text_hash")).alias("shown")
    )
    classes, size = stage.put_measured(classes, "classes", tokens=F.sum("n_shingles"))
    known, rank = frequent_ngrams(seen.where("token IS NOT NULL").select("token", "times"))
    buckets = 1 + int(size["tokens"]) * head_length(1000, percent) // 1000 // BUCKET_TOKENS
    members = stage.put(shared_heads(source, known, rank, buckets, n, percent), "shared")
    smallest = F.ceil(F.col("n_shingles") * percent / 100)  # of what may link with the class
    needs = classes.select("node", "n_shingles", smallest.alias("k")).select(
        "node", "n_shingles", (1 + F.floor((F.col("k") - F.ceil(F.col("k") * percent / 100) + 1) / 2)).alias("need")
    ).groupBy("node").agg(F.min("need").alias("need"), F.count(F.lit(1)).alias("classes"), F.sum("n_shingles").alias("tokens"))
    needs = stage.put(needs, "needs")
    members = thin(peel(members, needs, stage), needs, stage)
    families = components(members.select("least", "node"), stage, "least", "node", "-family")
    families = families.select("node", F.col("root").alias("family"))
    clashes = classes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    alone = clashes.join(families, "node", "left_anti").select("node", F.col("node").alias("family"))
    nodes = classes.join(families.unionByName(alone), "node").select("node", "shown", "n_shingles", "family")
    nodes = stage.put(nodes, "nodes")
    # The places of a class meet its text as one array, so that no text is joined more than once.
    placed = places(members, nodes, stage).groupBy("node").agg(F.collect_list(F.struct("of", "key", "x", "y")).alias("places"))
    placed = nodes.select("node", "shown.*").join(placed, "node")
    placed = stage.put(placed.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "places"), "placed")

    # A bit map of fixed size drops most texts that no search asks for; the join drops the rest.
    wanted = bit_map(placed.select("p_hash"))

    def asked(batches):
        seen = set()  # rows that repeat leave a task once
        for batch in batches:
            keep = wanted[bit_of(batch.column(1))]
            for k in np.flatnonzero(keep).tolist():
                name = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                keep[k] = name not in seen
                seen.add(name)
            batch = batch.filter(pa.array(keep))
            tight = pa.array([zlib.compress(text) for text in batch.column(2).to_pylist()], batch.schema.field(2).type)
            yield batch.set_column(2, batch.schema.field(2), tight)

    texts = source.mapInArrow(asked, source.schema)
    # The arrays take far more memory than their files tell, so they are not for a broadcast.
    placed = texts.join(placed.hint("merge"), F.col("text_hash").eqNullSafe(F.col("p_hash")) & F.col("doc_id").eqNullSafe(F.col("p_id")))
    placed = placed.select("bytes", F.inline("places"))
    search_key = ["of", "key", "x", "y"]
    dealt = placed.repartition(*search_key).sortWithinPartitions(*search_key)

    def search(rows):
        for _, group in groupby(rows, key=lambda r: (r["of"], r["key"], r["x"], r["y"])):
            found = {}
            for row in group:
                tokens = shingles(zlib.decompress(row["bytes"]), n)
                found[set_digest(tokens)] = tokens
            if len(found) > 1:
                names = list(found)
                yield from ((names[i], names[j]) for i, j in Trie(list(found.values()), percent).forest())

    links = map_rows(dealt, search, "a binary, b binary")
    roots = components(links, stage, name="-link").select(F.col("node").alias("linked"), "root")
    named = classes.join(roots, F.col("digest") == F.col("linked"), "left")
    named = stage.put(named.select(F.col("digest").alias("of"), F.coalesce("root", "digest").alias("root")), "named")
    return rows.join(named, F.col("digest") == F.col("of"), "left").select("doc_id", "text_hash", "n_shingles", "digest", "root")


def jaccard_join(docs: DataFrame, stage, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each document."""
    rows = stage.put(jaccard_classes(docs, stage, n, percent).select("doc_id", "n_shingles", "root"), "components")
    names = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = names.withColumnRenamed("root", "named")
    out = rows.join(names, F.col("root") == F.col("named"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, stage, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents with one kept of each component, the one of the smallest id.

    Rows of equal id and text are copies too; one of them stays. Empty texts all stay.
    """
    rows = stage.put(jaccard_classes(docs, stage, n, percent).select("doc_id", "text_hash", "n_shingles", "root"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("kept")
    linked = rows.where("root IS NOT NULL").groupBy("root").agg(first).select("kept.doc_id", "kept.text_hash")
    empty = rows.where("root IS NULL").select("doc_id", "text_hash")
    keys = linked.withColumn("single", F.lit(True)).unionByName(empty.distinct().withColumn("single", F.lit(False)))
    keys = stage.put(keys.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "single"), "kept")
    row = docs.select(F.struct("*").alias("row")).withColumns({"id": F.col("row.doc_id"), "hash": F.xxhash64("row.text")})
    kept = row.join(keys, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
    many = rows.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
    repeated = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash"))
    many = stage.put(many, "repeated")
    alone = kept.join(many, repeated, "left_anti").select("row")
    copies = kept.join(many, repeated, "left_semi")
    singles = copies.where("single").groupBy("id", "hash").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(singles).unionByName(copies.where("NOT single").select("row")).select("row.*")
