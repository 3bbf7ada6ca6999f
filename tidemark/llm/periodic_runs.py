"""Runs of repetition in word sequences, found by Crochemore's partition refinement, and texts without their repeats.

A run is a stretch of words with smallest period q, at least max(MIN_WORDS, EXPONENT * q) long, that no neighbouring word extends
with the same period. Positions of a text are classed by equal factors of length 1, 2, 3, ...: from one length to the next a class
is split by the classes of the positions that follow its members. Where a class was split, only its smaller parts split others
(the largest part need not, as what follows it stays together), so a position takes part O(log n) times.
Each class is a list in order of position. If neighbours i and i + p share a class of length p, the text has a square of period p
at i, and p is its smallest period, since no member stands between. Such starts in a row are one run. Neighbours only move apart
as lengths grow, so a pair is looked at when it ends: it revealed a square if its distance was among the lengths it lived through.
Refinement stops at the greatest period that a text in the slice can have.

A task refines all texts of a slice of about SLICE_BYTES together, length by length, with one numpy operation for all of them; classes
never span texts. One text is one task's work; its memory grows with its words, about 100 bytes each.

Null and empty texts have no words and no runs; words are `[^\\x20\\x09-\\x0D]+`. Repeated rows are treated alike; an empty table gives
an empty result. Other columns pass through; columns of the input that start with `pr_` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Texts, slices

MIN_WORDS, EXPONENT = 6, 4
SLICE_BYTES = 4 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, code): the words' spans, each text's first word and equal numbers for equal words."""
    starts, ends, first = texts.words()
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(texts.data[at].tobytes())])
    return starts, ends, first, words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


class Partition:
    """Classes of equal factors of all texts' positions, refined a length at a time.

    Members of a class fill a stretch of `order`, in any order; `after` and `before` link them by position. Each text is followed
    by a position of its own class, so that no factor reaches into the next text.
    """

    def __init__(self, code: np.ndarray, first: np.ndarray):
        texts = len(first) - 1
        counts = np.diff(first)
        self.n = n = len(code) + texts
        text = np.repeat(np.arange(texts), counts + 1)
        symbol = np.full(n, -1, np.int64)
        self.place = np.arange(len(code)) + np.repeat(np.arange(texts), counts)
        symbol[self.place] = code
        key = text * (int(code.max(initial=0)) + 2) + symbol + 1
        self.order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[self.order][1:] != key[self.order][:-1]])
        self.begin, self.size, self.cls = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.cls[self.order] = np.cumsum(new) - 1
        self.classes = int(new.sum())
        self.begin[: self.classes] = np.flatnonzero(new)
        self.size[: self.classes] = np.diff(np.append(self.begin[: self.classes], n))
        self.slot = np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        together = ~new[1:]
        self.after[self.order[:-1][together]] = self.order[1:][together]
        self.before[self.order[1:][together]] = self.order[:-1][together]
        self.since = np.ones(n, np.int64)
        self.moved = np.zeros(n, bool)
        self.length = 1
        #: Members of the classes that split others at the next length.
        self.splitters = np.arange(n)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _ended(self, i: np.ndarray) -> None:
        """Neighbours i and after[i] part with the length that begins now: they may have revealed a square before."""
        p = self.after[i] - i
        square = (self.after[i] >= 0) & (self.since[i] <= p) & (p < self.length)
        self.squares.append((i[square], p[square]))
        self.since[i] = self.length

    def refine(self) -> None:
        """Classes by factors of one word more."""
        self.length += 1
        s = self.splitters
        s = s[s > 0]
        i = s - 1
        i, s = (a[self.size[self.cls[i]] > 1] for a in (i, s))
        old, by = self.cls[i], self.cls[s]
        sort = np.lexsort((i, by, old))
        i, old, by = i[sort], old[sort], by[sort]
        # Groups of equal (old class, class that follows); of a class that moves as a whole the largest group stays.
        edge = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (by[1:] != by[:-1])])) if len(i) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(i)))
        of = old[edge]
        block = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        whole = np.add.reduceat(count, block) == self.size[of[block]] if len(block) else np.zeros(0, bool)
        per = np.diff(np.append(block, len(of)))
        largest = np.zeros(len(of), bool)
        if len(of):
            by_size = np.lexsort((-count, np.repeat(np.arange(len(block)), per)))
            largest[by_size[block]] = True
        stay = largest & np.repeat(whole, per)
        keep = np.repeat(~stay, count)
        i, old = i[keep], old[keep]
        count, of, largest = count[~stay], of[~stay], largest[~stay]
        if not len(i):
            self.splitters = i
            return
        self._move(i, old, count, of)
        # The largest part of each class splits nothing: either a group that moved or what is left.
        fresh = np.arange(self.classes - len(count), self.classes)
        left = self.size[of]
        splits = np.concatenate([fresh[(left >= count) | ~largest], np.unique(of[largest & (left < count)])])
        lengths = self.size[splits]
        ends = np.cumsum(lengths)
        self.splitters = self.order[np.repeat(self.begin[splits] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _move(self, i: np.ndarray, old: np.ndarray, count: np.ndarray, of: np.ndarray) -> None:
        """Groups of positions i, in order, leave their classes for new ones."""
        self.moved[i] = True
        # Leaving the old lists: chains of neighbours that go are bridged.
        a = i[np.lexsort((i, old))]
        head, tail = self.before[a], self.after[a]
        head = head[(head < 0) | ~self.moved[head]]
        tail = tail[(tail < 0) | ~self.moved[tail]]
        bridged = head >= 0
        self._ended(head[bridged])
        self._ended(i)
        self.after[head[bridged]] = tail[bridged]
        self.before[tail[tail >= 0]] = head[tail >= 0]
        # New lists.
        ends = np.cumsum(count)
        last, start = np.zeros(len(i), bool), np.zeros(len(i), bool)
        last[ends - 1] = True
        start[ends - count] = True
        self.after[i] = np.where(last, -1, np.append(i[1:], -1))
        self.before[i] = np.where(start, -1, np.append(-1, i[:-1]))
        # The last places of each class's stretch become the groups'; what stood there takes the places left.
        block = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        classes = of[block]
        going = np.add.reduceat(count, block)
        zone = self.begin[classes] + self.size[classes] - going
        sums = np.cumsum(going)
        places = np.repeat(zone - sums + going, going) + np.arange(sums[-1])
        there = self.order[places]
        there = there[~self.moved[there]]
        free = self.slot[i][self.slot[i] < np.repeat(zone, going)]
        self.order[free] = there
        self.slot[there] = free
        self.order[places] = i
        self.slot[i] = places
        new = np.arange(self.classes, self.classes + len(count))
        self.begin[new] = places[ends - count]
        self.size[new] = count
        self.size[classes] -= going
        self.cls[i] = np.repeat(new, count)
        self.classes += len(count)
        self.moved[i] = False

    def all_squares(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of all squares with periods of at most `longest` words."""
        while self.length < longest and len(self.splitters):
            self.refine()
        self.length += 1
        self._ended(np.flatnonzero(self.after >= 0))
        return np.concatenate([i for i, _ in self.squares]), np.concatenate([p for _, p in self.squares])


def runs(code: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; first: where each text's words begin in code."""
    longest = int(np.diff(first).max(initial=0)) // exponent
    if longest < 1:
        return (np.zeros(0, np.int64),) * 4
    partition = Partition(code, first)
    start, period = partition.all_squares(longest)
    sort = np.lexsort((start, period))
    start, period = start[sort], period[sort]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(period) != 0)])) if len(start) else np.zeros(0, np.int64)
    start, period, length = start[edge], period[edge], np.diff(np.append(edge, len(start))) - 1 + 2 * period[edge]
    kept = length >= np.maximum(min_words, exponent * period)
    start, period, length = start[kept], period[kept], length[kept]
    # Places count the position after each text; the text is told by them.
    text = np.searchsorted(first[1:] + np.arange(1, len(first)), start, side="right")
    start = start - text - first[text]
    sort = np.lexsort((period, start, text))
    return text[sort], start[sort], length[sort], period[sort]


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus pr_words (how many), pr_runs (by start, then period) and pr_text: the words that no run repeats, joined by a space."""
    rest = [c for c in docs.columns if not c.startswith("pr_") or c == text]
    own = [c for c in rest if not c.startswith("pr_")]
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(rest.index(text))
            for t in slices(column, SLICE_BYTES):
                starts, ends, first, code = word_codes(t)
                which, start, length, period = runs(code, first)
                # Repeats of all runs, as +1 and -1 at their ends.
                change = np.zeros(len(code) + 1, np.int64)
                np.add.at(change, first[which] + start + period, 1)
                np.add.at(change, first[which] + start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                before = np.concatenate([[0], np.cumsum(kept)])
                starts, ends, of = starts[kept], ends[kept], before[first]
                # Each kept word with a space after it, then without each text's last space.
                width = ends - starts + 1
                offsets = np.concatenate([[0], np.cumsum(width)])
                at = np.repeat(starts - offsets[:-1], width) + np.arange(offsets[-1])
                data = np.append(t.data, np.uint8(32))[np.minimum(at, len(t.data))]
                data[offsets[1:] - 1] = 32
                bounds = offsets[of]
                texts = [data[a : max(a, b - 1)].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(t.n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(runs_type.value_type)))
                part = batch.slice(t.row, t.n)
                yield pa.RecordBatch.from_arrays([*(part.column(rest.index(c)) for c in own), pa.array(np.diff(first), pa.int64()), lists, pa.array(texts, pa.string())], names=[*own, "pr_words", "pr_runs", "pr_text"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), f"pr_words bigint, pr_runs {RUNS}, pr_text string"])
    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def plant(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as the query takes them: from a place on, those with crc32(key) divisible by 10 repeat a stretch of words. A null key plants nothing."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.withColumns({"_g": F.floor(h / 10), "_words": F.when(h % 10 == 0, words)}).withColumn("_n", F.size("_words").cast("long"))
    a = F.col("_g") % F.col("_n")
    some = some.withColumn("_a", F.when(F.col("_n") > 0, a)).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", place(i))), " ")
    return some.withColumn(text, F.when(F.col("_a").isNotNull(), made).otherwise(F.col(text))).drop("_g", "_words", "_n", "_a", "_p")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = plant(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = collapse(docs)
    order = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))
    best = found.withColumn("best", F.array_min(F.transform("pr_runs", order)))
    length = -F.col("best.l")
    written = F.array_join(F.transform("pr_runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    written = F.when(F.size("pr_runs") > 0, F.concat(written, F.lit("\n"))).otherwise("")
    return best.select(
        "doc_id", F.size("pr_runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("pr_text", 256).alias("collapsed_sha256"),
    )
