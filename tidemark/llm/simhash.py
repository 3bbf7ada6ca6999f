"""SimHash near-duplicate detection through a byte-position inverted index with count filtering.

Fingerprints that differ in at most MAX_BITS bits share at least 8 - MAX_BITS of their 8 positional bytes: the guaranteed
minimum. Two such prints share all but MAX_BITS of any fixed positions too, so the index is entered by `entry` positions
only: each distinct fingerprint is posted under every choice of entry - MAX_BITS of them with their bytes. (Lists of one byte
would hold N / 256 prints, and pairs over them would grow with N squared.) The lists in which a pair meets are counted; the
count gives the bytes shared at the entry positions, the postings carry the other bytes, and the tally of both is held against
the minimum. Pairs that reach it are verified bit by bit. `entry` follows from the number of prints, so that random prints
share a list with few others; results don't depend on it. Exact copies share a fingerprint and enter the index once. A list
that many prints share is split over tasks by the skew join.

Null text and texts without words: fingerprint zero, linked like any other. Null doc_id: kept, never a component's id unless
all its documents have none. Repeated rows share a fingerprint. An empty table gives an empty result. Very long texts are
hashed whole. Other columns pass through `fingerprints`; columns that start with `nd_` are replaced.

That is the contract of op2 (`near_prints`). `near_duplicates` and `keep_one`, which the pipeline uses, link by similarity
instead: all texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more. A simhash of such a pair
differs in 10 of 64 bits on average, too many for posting lists, so candidates come from MinHash: BANDS keys of BAND_ROWS
least hashes each, of which a pair of similarity 0.8 shares none with a probability of 5e-6. Equal sets are one node. The
members of a list are first linked to its hub, the one that meets most others in all its lists. Where components still meet in a
list, count filtering follows: a set's signature is the low byte of each of its BANDS * BAND_ROWS least hashes, the bytes that
two members share at the same position are tallied within the task that holds their list (lists longer than BLOCK in pairs of
blocks), and only members of pairs that reach LEAST_SHARED, which a pair of 0.8 misses with a probability of 5e-8, stay, each pair in one
list only. What is retained is verified, again in its list, by the sets of 64-bit hashes; links leave the task, pairs never do. nd_print is there the hash of the set (zero: no words).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import gives_back, materialize
from .textbytes import mix, slices

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SIMILAR, SIMILAR_SHINGLE = 0.8, 5
BANDS, BAND_ROWS = 40, 6
LEAST_SHARED = 158
#: Members of a list that meet in a task are those of two blocks at most; small lists share tasks of about TASK_ROWS members.
BLOCK, TASK_ROWS = 256, 20_000
#: Shingles hashed at a time by all MinHash functions.
TILE = 256
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `shingle` lower-cased words (of all words, where there are fewer), joined by single spaces."""
    plain = b" ".join(text.lower().split())
    if not plain:
        return []
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32).tolist()
    starts, ends = [0, *(x + 1 for x in spaces)], [*spaces, len(plain)]
    digest = xxhash.xxh64_intdigest
    return [digest(plain[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :] or ends[-1:], strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row the bits set in over half of its hashes; counts: hashes of each row, in order; no hashes: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """docs (or its columns in keep) plus nd_print, the 64-bit fingerprint as a signed long."""
    names = [c for c in (docs.columns if keep is None else keep) if not c.startswith("nd_")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = []
            for t in slices(b.column(b.num_columns - 1)):
                each = [shingle_hashes(t.text(i), shingle) for i in range(t.n)]
                counts = np.array([len(h) for h in each], np.int64)
                prints.append(majority(np.array([x for h in each for x in h], np.uint64), counts))
            made = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made)], [*names, "nd_print"])

    return docs.select(*names, F.col(text).alias("nd_text")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), "nd_print long"]))


def entry_positions(n: int, max_bits: int = MAX_BITS) -> int:
    """Positions by which the index is entered: the fewest (two over max_bits at least) whose lists hold under 2 ** 4 of n random prints."""
    return next((e for e in range(max_bits + 2, 8) if n < 1 << (8 * (e - max_bits) + 4)), 8)


def tallied(distinct: DataFrame, max_bits: int = MAX_BITS, entry: int = 6) -> DataFrame:
    """(u, v, shared) of all pairs u < v that meet in the index: how many of the 8 positional bytes they share."""
    chosen = list(combinations(range(entry), entry - max_bits))
    masks = [sum(0xFF << 8 * i for i in kept) for kept in chosen]
    keys = F.array(*[F.struct(F.lit(i).alias("at"), F.col("nd_print").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bytes")) for i, m in enumerate(masks)])
    posted = distinct.select("nd_print", F.explode(keys).alias("k")).select("k.at", "k.bytes", "nd_print")
    one = posted.select("at", "bytes", F.col("nd_print").alias("u"))
    two = posted.select("at", "bytes", F.col("nd_print").alias("v"))
    met = one.join(two, ["at", "bytes"]).filter("u < v").groupBy("u", "v").agg(F.count("*").alias("lists"))
    # Pairs with m bytes in common at the entry positions meet in (m choose entry - max_bits) lists.
    by_lists = F.create_map(*[F.lit(x) for m in range(entry - max_bits, entry + 1) for x in (comb(m, entry - max_bits), m)])
    differing = F.col("u").bitwiseXOR(F.col("v"))
    others = sum((F.when(F.shiftrightunsigned(differing, 8 * i).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for i in range(entry, 8)), F.lit(0))
    return met.select("u", "v", (F.element_at(by_lists, F.col("lists").cast("int")) + others).alias("shared"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, entry: int | None = None) -> DataFrame:
    """Distinct fingerprints (nd_print) -> all links (u, v) with u < v, at most max_bits bits apart."""
    retained = tallied(distinct, max_bits, entry or entry_positions(distinct.count(), max_bits)).filter(F.col("shared") >= 8 - max_bits)
    return retained.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")


def _named(printed: DataFrame, distinct: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    found = components(linked)
    rooted = distinct.join(found, distinct["nd_print"] == found["node"], "left").select("nd_print", "nd_first", F.coalesce("root", "nd_print").alias("nd_root"))
    least = rooted.groupBy("nd_root").agg(F.min("nd_first").alias("nd_component"))
    named = materialize(rooted.join(least, "nd_root").select(F.col("nd_print").alias("nd_p"), "nd_component"))
    return printed.select(key, "nd_print").join(named, F.col("nd_print") == F.col("nd_p")).drop("nd_p")


def near_prints(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(key, nd_print, nd_component) by fingerprints at most max_bits apart: the component's id is the smallest key in it."""
    printed = materialize(fingerprints(docs, text, [key], shingle))
    distinct = materialize(printed.groupBy("nd_print").agg(F.min(key).alias("nd_first")))
    return _named(printed, distinct, links(distinct, max_bits), key)


def band_keys(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The BANDS keys of a set of 64-bit hashes, as signed longs, and its signature."""
    low, least = found.astype(np.uint32), np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), TILE):
        np.minimum(least, (low[at : at + TILE, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix(keys + row)
    return keys.view(np.int64), least.astype(np.uint8).tobytes()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate(parts)))


def _set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64).view(np.int64))


def shingle_prints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(key, nd_text, nd_print, nd_bands, nd_marks): the hash of each text's set of shingles, the set's band keys and its signature."""
    kind = dict(docs.dtypes)[key]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(1)):
                sets = [_set(t.text(i), shingle) for i in range(t.n)]
                prints = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                made = [band_keys(x.view(np.uint64)) if len(x) else (x, b"") for x in sets]
                columns = [pa.array(prints), _lists([x for x, _ in made]), pa.array([x for _, x in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(t.row, t.n) for c in b.columns), *columns], [key, "nd_text", "nd_print", "nd_bands", "nd_marks"])

    return docs.select(key, F.col(text).alias("nd_text")).mapInArrow(run, f"`{key}` {kind}, nd_text string, nd_print long, nd_bands array<long>, nd_marks binary")


_LIST = ["band", "one", "two", "block", "nd_print", "root"]


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.lexsort([table.column(c).to_numpy() for c in ("block", "two", "one", "band")])))


def _passing(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered rows of whole lists (_LIST, nd_bands, nd_marks) -> rows (i, j) of pairs of different roots that pass the count filter.

    A list is a band and two blocks of its members. A pair passes in the first band that both have only.
    """
    if not table.num_rows:
        return
    band, one, two, block, _, roots = (table.column(c).to_numpy() for c in _LIST)
    keys = pc.list_flatten(table.column("nd_bands").combine_chunks()).to_numpy().reshape(-1, BANDS)
    marks = np.frombuffer(b"".join(table.column("nd_marks").to_pylist()), np.uint8).reshape(-1, BANDS * BAND_ROWS)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(band) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)]))
    for start, end in zip(starts, [*starts[1:], len(band)], strict=True):
        rows = np.arange(start, end)
        left, right = rows[block[rows] == one[start]], rows[block[rows] == two[start]]
        for at in range(0, len(left), 32):
            some = left[at : at + 32]
            i, j = np.nonzero(roots[some][:, None] != roots[right])
            i, j = some[i], right[j]
            if one[start] == two[start]:
                i, j = i[j > i], j[j > i]
            fits = np.zeros(len(i), bool)
            for k in range(0, len(i), 8192):
                x, y = i[k : k + 8192], j[k : k + 8192]
                first = keys[x, np.argmax(keys[x] == keys[y], axis=1)] == band[start]
                fits[k : k + 8192] = first & ((marks[x] == marks[y]).sum(axis=1) >= LEAST_SHARED)
            if fits.any():
                yield i[fits], j[fits]


def list_members(table: pa.Table) -> pa.Table:
    """The rows (_LIST, nd_bands, nd_marks) that stand in a pair that passes the count filter."""
    table = _ordered(table)
    wanted = np.zeros(table.num_rows, bool)
    for i, j in _passing(table):
        wanted[i] = wanted[j] = True
    return table.select([*_LIST, "nd_bands", "nd_marks"]).filter(pa.array(wanted))


def list_links(table: pa.Table, similar: float) -> pa.Table:
    """Rows (_LIST, nd_bands, nd_marks, nd_set) -> verified links (u, v) that join all similar pairs of these lists."""
    table = _ordered(table)
    prints, roots = table.column("nd_print").to_numpy(), table.column("root").to_numpy()
    sets = table.column("nd_set").combine_chunks()
    flat, at = pc.list_flatten(sets).to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(sets).to_numpy())]) if len(sets) else np.zeros(1, np.int64)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    found = []
    for i, j in _passing(table):
        n, m = at[i + 1] - at[i], at[j + 1] - at[j]
        sized = np.minimum(n, m) >= similar * np.maximum(n, m)
        for x, y in zip(i[sized].tolist(), j[sized].tolist(), strict=True):
            a, b = top(int(roots[x])), top(int(roots[y]))
            if a != b:
                one, two = flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both >= similar * (len(one) + len(two) - both):
                    parent[max(a, b)] = min(a, b)
                    found.append(sorted((int(prints[x]), int(prints[y]))))
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def similar_links(printed: DataFrame, distinct: DataFrame, similar: float = SIMILAR, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """Links (u, v) of prints that join all sets of at least this Jaccard similarity.

    printed: nd_row, nd_print, nd_text, nd_bands, nd_marks; distinct: each nd_print with one of its rows.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.row, t.n), _lists([_set(t.text(i), shingle) for i in range(t.n)])], ["nd_print", "nd_set"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct())
        asked = pairs.select(F.col("u").alias("nd_print")).union(pairs.select(F.col("v").alias("nd_print"))).distinct()
        rows = distinct.join(asked, "nd_print", "left_semi").select("nd_row")
        held = materialize(printed.join(rows, "nd_row", "left_semi").select("nd_print", "nd_text").mapInArrow(sets, "nd_print long, nd_set array<long>"))
        one, two = held.toDF("u", "one"), held.toDF("v", "two")
        a, b = F.size("one"), F.size("two")
        sized = pairs.join(one, "u").join(two, "v").filter(F.least(a, b) >= similar * F.greatest(a, b))
        both = F.size(F.array_intersect("one", "two"))
        return materialize(sized.select("u", "v", both.alias("both"), (a + b).alias("all")).filter(F.col("both") >= similar * (F.col("all") - F.col("both"))).select("u", "v"))

    firsts = printed.join(distinct.select("nd_row"), "nd_row", "left_semi")
    posts = firsts.select("nd_print", F.explode("nd_bands").alias("band"))
    sizes = posts.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    posts = materialize(posts.join(sizes, "band"))
    degree = posts.groupBy("nd_print").agg(F.sum("n").alias("degree"))
    hubs = posts.join(degree, "nd_print").groupBy("band").agg(F.max(F.struct("degree", "nd_print")).alias("hub")).select("band", F.col("hub.nd_print").alias("v"))
    stars = verified(posts.join(hubs, "band").filter("nd_print <> v").select(F.least("nd_print", "v").alias("u"), F.greatest("nd_print", "v").alias("v")))
    roots = components(stars).withColumnRenamed("node", "nd_print")
    rooted = materialize(posts.join(roots, "nd_print", "left").select("band", "n", "nd_print", F.coalesce("root", "nd_print").alias("root")))
    still = rooted.groupBy("band").agg(F.min("root").alias("v"), F.max("root").alias("w")).filter("v < w").select("band")
    meet = materialize(rooted.join(still, "band"))
    signed = materialize(firsts.join(meet.select("nd_print").distinct(), "nd_print", "left_semi").select("nd_print", "nd_bands", "nd_marks"))
    # Each member goes to the pairs of its block and every other one; a list of up to BLOCK members is one block.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = meet.withColumn("block", F.pmod(F.xxhash64("nd_print", "band"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "nd_print", "root").join(signed, "nd_print")
    task = F.pmod(F.xxhash64("band", "one", "two"), F.lit(max(1, -(-meet.count() // TASK_ROWS)))).alias("task")
    members = materialize(dealt.groupBy(task).applyInArrow(lambda t: list_members(t), "band long, one int, two int, block int, nd_print long, root long, nd_bands array<long>, nd_marks binary"))
    asked = distinct.join(members.select("nd_print").distinct(), "nd_print", "left_semi").select("nd_row")
    held = materialize(printed.join(asked, "nd_row", "left_semi").select("nd_print", "nd_text").mapInArrow(sets, "nd_print long, nd_set array<long>"))
    return stars.union(members.join(held, "nd_print").groupBy(task).applyInArrow(lambda t: list_links(t, similar), "u long, v long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(key, nd_print, nd_component) by similar sets of shingles: the component's id is the smallest key in it."""
    printed = materialize(shingle_prints(docs, key, text, shingle).withColumn("nd_row", F.monotonically_increasing_id()))
    distinct = materialize(printed.groupBy("nd_print").agg(F.min(key).alias("nd_first"), F.min("nd_row").alias("nd_row")))
    return _named(printed, distinct, similar_links(printed, distinct, similar, shingle), key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """docs with one document of each component, that with the smallest key; repeated rows of that key all stay."""
    first = near_duplicates(docs, key, text, similar, shingle).filter(F.col(key).eqNullSafe(F.col("nd_component"))).select(F.col(key).alias("nd_key")).distinct()
    return docs.join(first, F.col(key).eqNullSafe(F.col("nd_key")), "left_semi")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("nd_print"), 16, "0")).alias("fingerprint"), F.col("nd_component").alias("component_id"))
