"""Language-model scoring by context-tree weighting over bytes.

A text's symbols are its bytes, A-Z lower-cased unless `lower` is off, and one end mark (255, which UTF-8 never uses); a symbol is eight binary decisions, and each
decision is predicted in the contexts of the last 0 to DEPTH bytes (zeros before the text). Every context has a
Krichevsky-Trofimov estimate of each decision, and context-tree weighting mixes the depths by how well they coded the
training texts: P_w = 1/2 KT + 1/2 product of the children's P_w. The result is a proper probability of the whole text.

How it runs: documents are put together in chunks of about CHUNK_BYTES. One scan counts (context of DEPTH bytes, symbol) in
each chunk, with count 0 for those that only texts outside the training set have, so that every symbol to be scored has its
row. Rows are dealt to shards by their last three context bytes, as compressed arrays, one a chunk and shard; there are at most
SHARDS, so that these arrays grow in number with the chunks alone. Chunks form groups of about GROUP_CHUNKS: a task sums the rows of
one shard and group and cuts the sums into as many parts as there must be for a part of all groups to fit a task; another one sums
a part over all groups. So a common context never brings the rows of all chunks to one task. A part weights its
subtrees; what they add up to per context of two bytes and decision goes to PARTS parts by decision, each of which weights the
depths below three for its decisions and sends every shard the results that it needs. The values go back the way the counts came:
to each group those of its own keys, and from there to each chunk those of its own rows; a last pass looks them up. So no task ever holds more of the
model than its chunk, shard or part uses, nothing of it goes to the driver, and work and shuffle grow with the text.

Values travel in whole multiples of 1 / SCALE nats: a symbol's log probability is off by 1 / (2 * SCALE) at most.

The same scans count words for a unigram base line (lower-cased words and one end token, add-half smoothing).

Null text: empty, scored as its end mark alone. Null doc_id: a training document. Repeated rows count and are scored each.
An empty table gives an empty result. Other columns do not pass; the operator's columns start with `lm_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import fold
from .runtime import materialize
from .textbytes import LOWER, SLICE_BYTES, Texts, mix, slices

DEPTH, TOP = 6, 3
CHUNK_BYTES = 16 << 20
END = 255
END_WORD = np.int64(-1)
GROUP_CHUNKS, PARTS, SHARDS = 64, 64, 512
SCALE = 1 << 14
#: Rows that are weighted at a time within a shard (a subtree is never split).
PART = 50_000
NGRAM, WORD = 0, 1
_LN2 = float(np.log(2))
_STIRLING_FROM = 10.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after shifting x to 10 and more."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(int(_STIRLING_FROM)):
        low = x < _STIRLING_FROM
        if not low.any():
            break
        shift[low] += np.log(x[low])
        x[low] += 1
    inverse = 1 / x
    square = inverse * inverse
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680))) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def symbol_keys(t: Texts, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of all symbols of a slice: the context, last byte first, and below it the symbol."""
    lengths = np.diff(t.offsets)
    symbols = np.zeros(len(t.data) + t.n * (depth + 1), np.int64)
    shift = (np.arange(t.n) + 1) * depth + np.arange(t.n)
    symbols[np.arange(len(t.data)) + np.repeat(shift, lengths)] = t.data
    ends = t.offsets[1:] + shift
    symbols[ends] = END
    rows = np.repeat(np.arange(t.n), lengths + 1)
    at = np.arange(len(rows)) + (rows + 1) * depth
    keys = symbols[at]
    for d in range(1, depth + 1):
        keys |= symbols[at - d] << (8 * (depth + 1 - d))
    return keys, rows


def word_keys(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, rows) of the lower-cased words and end tokens of a slice."""
    low = t.lowered()
    starts, ends, first = low.words()
    h = low.span_hashes(starts, ends).view(np.int64)
    rows = np.repeat(np.arange(t.n), np.diff(first))
    return np.concatenate([h, np.full(t.n, END_WORD)]), np.concatenate([rows, np.arange(t.n)])


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class _Tally:
    """Counts of keys, folded together whenever they have grown to LIMIT."""

    LIMIT = 1_500_000

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, train: np.ndarray, keep_unseen: bool) -> None:
        found = [np.unique(keys[train], return_counts=True)]
        if keep_unseen and not train.all():
            other = np.unique(keys[~train])
            found.append((other, np.zeros(len(other), np.int64)))
        self.parts += found
        self.size += sum(len(k) for k, _ in found)
        if self.size > self.LIMIT:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts = [_sum_by(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
        self.size = len(self.parts[0][0]) // 2
        return self.parts[0]


def _packed(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed; ascending keys (int64) as differences."""
    a = np.diff(a, prepend=np.int64(0)) if a.dtype == np.int64 else a
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpacked(raw: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(a) if kind == np.int64 else a


def chunked(docs: DataFrame, key: str, text: str, train: Column, chunk_bytes: int = CHUNK_BYTES, lower: bool = True) -> DataFrame:
    """Rows of about chunk_bytes of text: lm_chunk, lm_ids, and as bytes lm_train (a flag a row), lm_ends (int64), lm_text (compressed)."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, ends, data, size = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            whole = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            blobs = [np.concatenate(flags).tobytes(), np.concatenate(ends).tobytes(), zstandard.compress(np.concatenate(data).tobytes(), 3)]
            return pa.RecordBatch.from_arrays([listed, *(pa.array([x], pa.binary()) for x in blobs)], ["lm_ids", "lm_train", "lm_ends", "lm_text"])

        for b in batches:
            train_flags = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for t in slices(b.column(2)):
                ids.append(b.column(0).slice(t.row, t.n))
                flags.append(train_flags[t.row : t.row + t.n])
                ends.append(t.offsets[1:] + size)
                data.append(LOWER[t.data] if lower else t.data.copy())
                size += len(t.data)
                if size >= chunk_bytes:
                    yield row()
                    ids, flags, ends, data, size = [], [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(key, train.alias("lm_train"), F.col(text).alias("lm_text")).mapInArrow(run, f"lm_ids array<{kind}>, lm_train binary, lm_ends binary, lm_text binary")
    return materialize(rows.withColumn("lm_chunk", F.monotonically_increasing_id()))


def _texts(train: bytes, ends: bytes, text: bytes) -> Iterator[tuple[Texts, np.ndarray]]:
    """The slices of a chunk with their training flags."""
    data, ends, flags = np.frombuffer(zstandard.decompress(text), np.uint8), np.frombuffer(ends, np.int64), np.frombuffer(train, bool)
    offsets = np.concatenate([[0], ends])
    at = 0
    while at < len(flags):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, flags[at:to]), flags[at:to]
        at = to


def _spot(keys: np.ndarray, kind: int, depth: int) -> np.ndarray:
    """A hash by which keys are dealt: keys of one context of TOP bytes stay together."""
    return mix((keys >> (8 * (depth + 1 - TOP)) if kind == NGRAM else keys).view(np.uint64))


def count(chunks: DataFrame, shards: int, depth: int = DEPTH) -> DataFrame:
    """(lm_kind, lm_shard, lm_chunk, lm_keys, lm_n): each chunk's training counts of symbols in context and of words, a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tallies = _Tally(), _Tally()
                for t, flags in _texts(*blobs):
                    for tally, of in zip(tallies, (lambda t: symbol_keys(t, depth), word_keys), strict=True):
                        keys, rows = of(t)
                        tally.add(keys, flags[rows], True)
                for kind, tally in enumerate(tallies):
                    keys, n = tally.fold()
                    shard = (_spot(keys, kind, depth) % np.uint64(shards)).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                    parts = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    some = [s for s, p in enumerate(parts) if len(p)]
                    pa.default_memory_pool().release_unused()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), kind, np.int8)), pa.array(np.array(some, np.int32)), pa.array(np.full(len(some), chunk)), pa.array([_packed(keys[parts[s]]) for s in some], pa.binary()), pa.array([_packed(n[parts[s]].astype(np.uint64)) for s in some], pa.binary())],
                        ["lm_kind", "lm_shard", "lm_chunk", "lm_keys", "lm_n"],
                    )

    return chunks.select("lm_chunk", "lm_train", "lm_ends", "lm_text").mapInArrow(run, "lm_kind tinyint, lm_shard int, lm_chunk long, lm_keys binary, lm_n binary")


class Subtree:
    """The decisions of rows (key, count) in contexts of TOP to depth bytes, weighted bottom-up."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        symbol = keys & 255
        level = np.arange(8)
        prefix = (1 << level) | (symbol[:, None] >> (8 - level))
        self.bit = ((symbol[:, None] >> (7 - level)) & 1).astype(bool)
        weight = np.repeat(n.astype(float), 8)
        ones = np.where(self.bit.ravel(), weight, 0.0)
        self.levels = []
        below = None
        for d in range(depth, TOP - 1, -1):
            node = ((keys >> (8 * (depth + 1 - d)))[:, None] << 8 | prefix).ravel()
            names, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            b = np.bincount(inverse, weights=ones, minlength=len(names))
            a = np.bincount(inverse, weights=weight, minlength=len(names)) - b
            kt = log_kt(a, b)
            if below is None:
                log_pw, own = kt, np.ones(len(names))
            else:
                children = np.bincount(inverse[below[0]], weights=below[1], minlength=len(names))
                log_pw = np.logaddexp(kt, children) - _LN2
                own = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
            self.levels.append((inverse, own, (b + 0.5) / (a + b + 1)))
            below = first, log_pw
        self.names, self.log_pw, self.a, self.b = names, log_pw, a, b

    def probability_of_one(self) -> np.ndarray:
        """Of each row's eight decisions, mixed over the depths of the subtree."""
        p = None
        for inverse, own, kt in self.levels:
            p = kt[inverse] if p is None else own[inverse] * kt[inverse] + (1 - own[inverse]) * p
        return p.reshape(-1, 8)


def _subtrees(keys: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[slice, Subtree]]:
    """A shard's rows (ascending) in parts of whole subtrees."""
    top = keys >> (8 * (depth + 1 - TOP))
    firsts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(keys) else np.zeros(0, np.int64)
    at = 0
    while at < len(keys):
        to = int(firsts[np.searchsorted(firsts, at + PART, side="right") - 1]) if at + PART < len(keys) else len(keys)
        if to <= at:
            after = np.searchsorted(firsts, at, side="right")
            to = int(firsts[after]) if after < len(firsts) else len(keys)
        yield slice(at, to), Subtree(keys[at:to], n[at:to], depth)
        at = to


def _summed(table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The key arrays of a table's rows, and the distinct keys with their counts over all rows."""
    each = [_unpacked(x) for x in table.column("lm_keys").to_pylist()]
    n = [_unpacked(x, np.uint64).astype(np.int64) for x in table.column("lm_n").to_pylist()]
    return each, *_sum_by(np.concatenate(each), np.concatenate(n))


def partial_sums(rows: DataFrame, kind: int, groups: int, shards: int, fine: int, depth: int = DEPTH) -> DataFrame:
    """(lm_shard, lm_group, lm_fine, lm_keys, lm_n): counts summed over the chunks of a group, a row a shard, group and part."""
    if groups == 1 and fine == 1:
        return rows.select("lm_shard", "lm_group", F.lit(0).alias("lm_fine"), "lm_keys", "lm_n")

    def run(key, table):
        _, keys, n = _summed(table)
        part = (_spot(keys, kind, depth) // np.uint64(shards) % np.uint64(fine)).astype(np.int64)
        some = np.unique(part)
        blobs = [[_packed(x[part == p]) for p in some] for x in (keys, n.astype(np.uint64))]
        ids = [pa.array([k.as_py()] * len(some), pa.int32()) for k in key]
        return pa.table([*ids, pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["lm_shard", "lm_group", "lm_fine", "lm_keys", "lm_n"])

    return materialize(rows.groupBy("lm_shard", "lm_group").applyInArrow(run, "lm_shard int, lm_group int, lm_fine int, lm_keys binary, lm_n binary"))


def top_weights(node: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths 0 to 2 of decisions whose nodes are all given: per node (two bytes, decision) A and B such that the mixed probability of a one is A + B * that of depth 3."""
    parents = np.arange(len(node))
    low, high = np.zeros(len(node)), np.ones(len(node))
    names = node
    stack = []
    for d in (2, 1, 0):
        if d < 2:
            up = ((names >> 16) << 8) | (names & 255)
            names, inverse = np.unique(up, return_inverse=True)
            a, b, children = (np.bincount(inverse, weights=x, minlength=len(names)) for x in (a, b, log_pw))
            parents = inverse[parents]
        kt = log_kt(a, b)
        log_pw = np.logaddexp(kt, children) - _LN2
        own = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
        stack.append((own[parents], ((b + 0.5) / (a + b + 1))[parents]))
    for own, kt in stack:
        low, high = own * kt + (1 - own) * low, (1 - own) * high
    return low, high


def _totals(names: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    names, inverse = np.unique(names, return_inverse=True)
    return names, [np.bincount(inverse, weights=x, minlength=len(names)) for x in values]


_TOP = "lm_shard int, lm_fine int, lm_node binary, lm_low binary, lm_high binary"


def top_of_shards(sums: DataFrame, depth: int = DEPTH) -> DataFrame:
    """_TOP: the A and B of top_weights for the nodes that each part of a shard needs, a row a part and decisions' part."""

    def upward(key, table):
        _, keys, n = _summed(table)
        names, values = np.zeros(0, np.int64), [np.zeros(0)] * 3
        for _, tree in _subtrees(keys, n, depth):
            more, (a, b, w) = _totals(((tree.names >> 16) << 8) | (tree.names & 255), [tree.a, tree.b, tree.log_pw])
            names, values = _totals(np.concatenate([names, more]), [np.concatenate(x) for x in zip(values, (a, b, w), strict=True)])
        part = names % PARTS
        some = np.unique(part).tolist()
        columns = [[_packed(x[part == p]) for p in some] for x in (names, *values)]
        ids = [pa.array([k.as_py()] * len(some), pa.int32()) for k in key]
        return pa.table([*ids, pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["lm_shard", "lm_fine", "lm_part", "lm_node", "lm_a", "lm_b", "lm_w"])

    def weigh(table):
        nodes = [_unpacked(x) for x in table.column("lm_node").to_pylist()]
        names, values = _totals(np.concatenate(nodes), [np.concatenate([_unpacked(x, np.float64) for x in table.column(c).to_pylist()]) for c in ("lm_a", "lm_b", "lm_w")])
        low, high = top_weights(names, *values)
        at = [np.searchsorted(names, x) for x in nodes]
        return pa.table([table.column("lm_shard"), table.column("lm_fine"), table.column("lm_node"), *(pa.array([_packed(x[i]) for i in at], pa.binary()) for x in (low, high))], names=["lm_shard", "lm_fine", "lm_node", "lm_low", "lm_high"])

    up = sums.groupBy("lm_shard", "lm_fine").applyInArrow(upward, "lm_shard int, lm_fine int, lm_part int, lm_node binary, lm_a binary, lm_b binary, lm_w binary")
    return up.groupBy("lm_part").applyInArrow(weigh, _TOP)


_KINDS = {NGRAM: np.uint32, WORD: np.uint64}
_VALUES = "lm_kind tinyint, lm_chunk long, lm_keys binary, lm_values binary"


def _per_chunk(kind: int, table, each: list[np.ndarray], keys: np.ndarray, values: np.ndarray):
    """The values of each chunk's own keys, as rows of _VALUES."""
    blobs = [_packed(values[np.searchsorted(keys, k)]) for k in each]
    return pa.table({"lm_kind": pa.array(np.full(len(each), kind, np.int8)), "lm_chunk": table.column("lm_chunk"), "lm_keys": table.column("lm_keys"), "lm_values": pa.array(blobs, pa.binary())})


def _no_values():
    return pa.table({"lm_kind": pa.array([], pa.int8()), "lm_chunk": pa.array([], pa.int64()), "lm_keys": pa.array([], pa.binary()), "lm_values": pa.array([], pa.binary())})


def spread(kind: int, rows: DataFrame, sums: DataFrame, groups: int, fine: int, values, beside: DataFrame) -> DataFrame:
    """_VALUES of each chunk and shard. values(keys, counts, beside's rows of the part): what to give each key, as _KINDS[kind]."""
    if groups == 1 and fine == 1:

        def at_once(left, right):
            if not left.num_rows:
                return _no_values()
            each, keys, n = _summed(left)
            return _per_chunk(kind, left, each, keys, values(keys, n, right))

        return rows.groupBy("lm_shard").cogroup(beside.groupBy("lm_shard")).applyInArrow(at_once, _VALUES)

    def back(left, right):
        """To each group the values of the keys that it has brought."""
        if not left.num_rows:
            return pa.table({"lm_shard": pa.array([], pa.int32()), "lm_group": pa.array([], pa.int32()), "lm_k": pa.array([], pa.binary()), "lm_v": pa.array([], pa.binary())})
        each, keys, n = _summed(left)
        found = values(keys, n, right)
        blobs = [_packed(found[np.searchsorted(keys, k)]) for k in each]
        return pa.table({"lm_shard": left.column("lm_shard"), "lm_group": left.column("lm_group"), "lm_k": left.column("lm_keys"), "lm_v": pa.array(blobs, pa.binary())})

    def pick(left, right):
        if not left.num_rows:
            return _no_values()
        each = [_unpacked(x) for x in left.column("lm_keys").to_pylist()]
        keys = np.concatenate([_unpacked(x) for x in right.column("lm_k").to_pylist()])
        found = np.concatenate([_unpacked(x, _KINDS[kind]) for x in right.column("lm_v").to_pylist()])
        order = np.argsort(keys)
        return _per_chunk(kind, left, each, keys[order], found[order])

    part = ["lm_shard", "lm_fine"]
    held = sums.groupBy(*part).cogroup(beside.groupBy(*part)).applyInArrow(back, "lm_shard int, lm_group int, lm_k binary, lm_v binary")
    return rows.groupBy("lm_shard", "lm_group").cogroup(held.groupBy("lm_shard", "lm_group")).applyInArrow(pick, _VALUES)


def symbol_values(counts: DataFrame, groups: int, shards: int, fine: int, depth: int = DEPTH) -> DataFrame:
    """Per chunk and shard minus the natural log of each symbol's probability in its context, times SCALE (_VALUES)."""
    rows = counts.filter(F.col("lm_kind") == NGRAM)
    sums = partial_sums(rows, NGRAM, groups, shards, fine, depth)

    def values(keys, n, top):
        node = np.concatenate([_unpacked(x) for x in top.column("lm_node").to_pylist()])
        order = np.argsort(node)
        node, low, high = node[order], *(np.concatenate([_unpacked(x, np.float64) for x in top.column(c).to_pylist()])[order] for c in ("lm_low", "lm_high"))
        level = np.arange(8)
        out = np.empty(len(keys), np.uint32)
        for part, tree in _subtrees(keys, n, depth):
            k = keys[part]
            prefix = (1 << level) | ((k & 255)[:, None] >> (8 - level))
            at = np.searchsorted(node, (k >> (8 * (depth - 1)))[:, None] << 8 | prefix)
            p = low[at] + high[at] * tree.probability_of_one()
            out[part] = np.rint(-SCALE * np.log(np.where(tree.bit, p, 1 - p)).sum(axis=1))
        return out

    return spread(NGRAM, rows, sums, groups, fine, values, top_of_shards(sums, depth))


def word_values(counts: DataFrame, groups: int, shards: int, fine: int) -> tuple[DataFrame, int, int]:
    """Per chunk and shard the count of each word (_VALUES); distinct and all training tokens."""
    rows = counts.filter(F.col("lm_kind") == WORD)
    sums = partial_sums(rows, WORD, groups, shards, fine)

    def totals(table):
        _, _, n = _summed(table)
        return pa.table({"v": pa.array([int((n > 0).sum())]), "n": pa.array([int(n.sum())])})

    v, n = sums.groupBy("lm_shard", "lm_fine").applyInArrow(totals, "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    nothing = sums.select("lm_shard", "lm_fine").filter(F.lit(False))
    return spread(WORD, rows, sums, groups, fine, lambda keys, n, _: n.astype(np.uint64), nothing), v, n


class Lookup:
    """An open-addressing table from 64-bit keys to numbers, read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys, self.values, full = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, values.dtype), np.zeros(1 << self.bits, bool)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~full[slot[left]]]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            full[slot[put]] = True
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are in the table."""
        slot = self._slot(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, lower: bool = True) -> DataFrame:
    """(key, lm_train, lm_tokens, lm_known, lm_train_tokens, lm_base, lm_score, lm_bits_per_byte) of every row; scores are log10."""
    kind = dict(docs.dtypes)[key]
    chunks = chunked(docs, key, text, train, chunk_bytes, lower)
    n_chunks = chunks.count()
    groups = max(1, -(-n_chunks // GROUP_CHUNKS))
    parts = max(32, 2 * n_chunks)
    shards = min(parts, SHARDS)
    fine = -(-parts // shards)
    counts = materialize(count(chunks, shards, depth).withColumn("lm_group", F.pmod(F.xxhash64("lm_chunk"), F.lit(groups)).cast("int")))
    words, n_words, n_tokens = word_values(counts, groups, shards, fine)
    values = symbol_values(counts, groups, shards, fine, depth).unionByName(words)

    def run(left, right):
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, types, strict=True)})
        found = {NGRAM: [], WORD: []}
        for k, keys, v in zip(*(right.column(c) for c in ("lm_kind", "lm_keys", "lm_values")), strict=True):
            found[k.as_py()].append((_unpacked(keys.as_py()), _unpacked(v.as_py(), _KINDS[k.as_py()])))
        del right
        grams, spoken = (Lookup(np.concatenate([k for k, _ in x]), np.concatenate([v for _, v in x])) for x in found.values())
        out = []
        for t, flags in _texts(*(left.column(c)[0].as_py() for c in ("lm_train", "lm_ends", "lm_text"))):
            keys, rows = symbol_keys(t, depth)
            ln_p = -np.bincount(rows, weights=grams.get(keys), minlength=t.n) / SCALE
            hashes, word_rows = word_keys(t)
            value = spoken.get(hashes)
            known = np.bincount(word_rows, weights=value > 0, minlength=t.n).astype(np.int64)
            out.append([flags, np.bincount(word_rows, minlength=t.n), known, np.bincount(word_rows, weights=np.log10(value + 0.5), minlength=t.n), ln_p, np.diff(t.offsets)])
        ids = left.column("lm_ids").combine_chunks().flatten()
        pa.default_memory_pool().release_unused()
        return pa.table([ids, *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], names=names)

    names = [key, "lm_train", "lm_tokens", "lm_known", "lm_word_log10", "lm_ln_p", "lm_bytes"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    schema = f"`{key}` {kind}, lm_train boolean, lm_tokens long, lm_known long, lm_word_log10 double, lm_ln_p double, lm_bytes long"
    out = chunks.groupBy("lm_chunk").cogroup(values.groupBy("lm_chunk")).applyInArrow(run, schema)
    base = F.col("lm_word_log10") - F.col("lm_tokens") * float(np.log10(n_tokens + 0.5 * (n_words + 1)))
    bits = -F.col("lm_ln_p") / _LN2
    return out.select(key, "lm_train", "lm_tokens", "lm_known", F.lit(n_tokens).cast("long").alias("lm_train_tokens"), base.alias("lm_base"), (F.col("lm_ln_p") / float(np.log(10))).alias("lm_score"), (bits / F.greatest(F.col("lm_bytes"), F.lit(1))).alias("lm_bits_per_byte"))


def op6_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~fold(F.col("doc_id"), 5, 1))
    renamed = {"lm_tokens": "n_tokens", "lm_known": "n_known", "lm_train_tokens": "train_tokens", "lm_base": "base_score", "lm_score": "score", "lm_bits_per_byte": "bits_per_byte"}
    return out.select("doc_id", (~F.col("lm_train")).alias("held_out"), *[F.col(a).alias(b) for a, b in renamed.items()])
