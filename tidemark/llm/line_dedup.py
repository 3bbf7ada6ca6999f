"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

State (`State`) is a table of references (line hash, document), from which the exact counts follow, and a cuckoo filter for
each shard of the hash space with the lines that min_docs documents or more hold. `insert_documents` and `delete_documents`
change both: the lines whose exact count thereby reaches or leaves min_docs are inserted into or deleted from the filters of
their shards; other shards' filters stay as they are. Deleting what was inserted restores the former state. Once the lines
outgrow the shards (twice their intended load), filters are dealt anew over more shards.

A document's lines probe the filter of their shard, and only positives are verified in the exact table. References of a shard
are dealt over as many groups as keep each under GROUP_REFS, so neither a shard nor a line that a third of all documents hold
fills a task; what a document loses is gathered by document and text, which its own number of lines bounds.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys are compared by their 128-bit XXH3 hash.
Null or empty text: one empty line, kept. Null doc_id: all such rows are one document, smaller than all others. Repeated rows of
one doc_id count as one document and lose the same lines. An empty table gives an empty result. Columns of the input pass through
`dedup_lines` (text replaced); its own columns start with `dl_`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import gives_back, materialize

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Lines a shard's filter is sized for; the number of shards follows the number of lines.
SHARD_LINES = 1 << 15
#: References that are probed in one group, about.
GROUP_REFS = 250_000
NO_ID = -(1 << 63)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four a bucket; a line that cannot be placed goes to an exact overflow set."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.8))))
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.overflow: list[int] = []

    @staticmethod
    def _spread(x):
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def _places(self, h: np.ndarray):
        h = np.atleast_1d(h).astype(np.uint64)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        mask = np.uint64(self.buckets - 1)
        one = (self._spread(h)) & mask
        return mark, one, (one ^ self._spread(mark.astype(np.uint64))) & mask

    def insert(self, h: int) -> None:
        mark, one, two = (int(x[0]) for x in self._places(np.array([h], np.uint64)))
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        at = one
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = (at ^ int(self._spread(np.array([mark], np.uint64))[0])) & (self.buckets - 1)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        self.overflow.append(at << 16 | mark)

    def delete(self, h: int) -> bool:
        """Remove one inserted line; False if it isn't there."""
        mark, one, two = (int(x[0]) for x in self._places(np.array([h], np.uint64)))
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
            if (at << 16 | mark) in self.overflow:
                self.overflow.remove(at << 16 | mark)
                return True
        return False

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h)
        found = (self.table[one.astype(np.int64)] == mark[:, None]).any(axis=1) | (self.table[two.astype(np.int64)] == mark[:, None]).any(axis=1)
        if self.overflow:
            spilled = np.array(self.overflow, np.uint64)
            m = mark.astype(np.uint64)
            found |= np.isin(one << np.uint64(16) | m, spilled) | np.isin(two << np.uint64(16) | m, spilled)
        return found

    def content(self) -> list[tuple[int, int]]:
        """What is in the filter wherever it stands: (smaller of its two buckets, fingerprint) of each line, in order."""
        at, _ = np.nonzero(self.table)
        marks = self.table[self.table > 0].astype(np.uint64)
        held = [(int(x), int(m)) for x, m in zip(at, marks, strict=True)] + [(x >> 16, x & 0xFFFF) for x in self.overflow]
        return sorted((min(x, (x ^ int(self._spread(np.array([m], np.uint64))[0])) & (self.buckets - 1)), m) for x, m in held)

    def to_bytes(self) -> bytes:
        head = np.array([self.buckets, len(self.overflow), *self.overflow], np.uint64)
        return head.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cuckoo:
        out = cls(1)
        out.buckets, n = (int(x) for x in np.frombuffer(raw, np.uint64, 2))
        out.overflow = [int(x) for x in np.frombuffer(raw, np.uint64, n, 16)]
        out.table = np.frombuffer(raw, np.uint16, offset=16 + 8 * n).reshape(out.buckets, cls.SLOTS).copy()
        return out


def long_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key if it has at least min_chars code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()


def _halves(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def line_refs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """References (dl_h1, dl_h2, dl_doc, dl_text): each long line of each document once; dl_text: a hash of the text it stands in."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, ids, whole = [], [], [], []
            for doc, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                t = t.as_py() or ""
                keys = {k for line in t.encode().split(b"\n") if len(line) >= min_chars and (k := long_key(line, min_chars))}
                for k in keys:
                    x, y = _halves(k)
                    one.append(x)
                    two.append(y)
                    ids.append(NO_ID if doc is None else doc)
                    whole.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (one, two, ids, whole)], ["dl_h1", "dl_h2", "dl_doc", "dl_text"])

    return docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text)).mapInArrow(run, "dl_h1 long, dl_h2 long, dl_doc long, dl_text long")


def insert(state: DataFrame | None, refs: DataFrame) -> DataFrame:
    """The references after inserting documents; one that is there already is not counted twice."""
    names = ["dl_h1", "dl_h2", "dl_doc"]
    both = refs.select(*names) if state is None else state.select(*names).unionByName(refs.select(*names))
    return both.groupBy(*names).agg(F.lit(1).alias("_")).drop("_")


def delete(state: DataFrame, ids: DataFrame) -> DataFrame:
    """The references after deleting the documents in ids (column dl_doc)."""
    return state.join(ids.select("dl_doc").distinct(), "dl_doc", "left_anti").select("dl_h1", "dl_h2", "dl_doc")


def counts(state: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The exact reference-count table of lines found in at least min_docs documents: dl_n and the last document holding each."""
    return state.groupBy("dl_h1", "dl_h2").agg(F.count("*").alias("dl_n"), F.max("dl_doc").alias("dl_last")).filter(F.col("dl_n") >= min_docs)


def _shard(n: int):
    return F.pmod(F.xxhash64("dl_h2"), F.lit(n)).cast("int")


@dataclass
class State:
    """references: dl_h1, dl_h2, dl_doc; counted: see `counts`; filters: dl_shard, dl_filter; all written tables. lines: how many are counted."""

    references: DataFrame
    counted: DataFrame
    filters: DataFrame
    shards: int
    lines: int
    min_docs: int


_FILTERS = "dl_shard int, dl_filter binary"


def _apply(key, held, changes):
    """A shard's filter after its lines' insertions (dl_in) and deletions."""
    changed = changes.num_rows
    if not held.num_rows and not changed:
        return pa.table({"dl_shard": pa.array([], pa.int32()), "dl_filter": pa.array([], pa.binary())})
    h, added = changes.column("dl_h1").to_numpy().view(np.uint64), changes.column("dl_in").to_numpy(zero_copy_only=False)
    f = Cuckoo.from_bytes(held.column("dl_filter")[0].as_py()) if held.num_rows else Cuckoo(max(SHARD_LINES, changed))
    for x in h[~added]:
        f.delete(int(x))
    for x in h[added]:
        f.insert(int(x))
    return pa.table({"dl_shard": pa.array([key[0].as_py()], pa.int32()), "dl_filter": pa.array([f.to_bytes()], pa.binary())})


def _moved(state: State | None, references: DataFrame, min_docs: int, spark) -> State:
    """The state that follows from these references; the former filters take the lines that came and went."""
    references = materialize(references)
    counted = materialize(counts(references, min_docs))
    lines = counted.count()
    if state is None or lines > 2 * SHARD_LINES * state.shards:
        shards, changes = max(1, -(-lines // SHARD_LINES)), counted.select("dl_h1", "dl_h2", F.lit(True).alias("dl_in"))
        held = spark.createDataFrame([], _FILTERS)
    else:
        shards, held = state.shards, state.filters
        names = ["dl_h1", "dl_h2"]
        came, went = (a.select(*names).join(b.select(*names), names, "left_anti").select(*names, F.lit(x).alias("dl_in")) for a, b, x in ((counted, state.counted, True), (state.counted, counted, False)))
        changes = came.unionByName(went)
    changes = changes.select(_shard(shards).alias("dl_shard"), "dl_h1", "dl_in")
    filters = held.groupBy("dl_shard").cogroup(changes.groupBy("dl_shard")).applyInArrow(_apply, _FILTERS)
    return State(references, counted, materialize(filters), shards, lines, min_docs)


def insert_documents(state: State | None, refs: DataFrame, min_docs: int = MIN_DOCS) -> State:
    """The state after inserting documents, given by their references (`line_refs`); state None: nothing was there."""
    return _moved(state, insert(state and state.references, refs), state.min_docs if state else min_docs, refs.sparkSession)


def delete_documents(state: State, ids: DataFrame) -> State:
    """The state after deleting the documents in ids (column dl_doc)."""
    return _moved(state, delete(state.references, ids), state.min_docs, ids.sparkSession)


def probe(refs: DataFrame, state: State) -> DataFrame:
    """The references whose line may repeat, by their shard's filter, in groups of about GROUP_REFS."""
    names = ["dl_h1", "dl_h2", "dl_doc", "dl_text"]

    def run(left, right):
        if not right.num_rows or not left.num_rows:
            return left.slice(0, 0).select(names)
        hit = Cuckoo.from_bytes(right.column("dl_filter")[0].as_py()).contains(left.column("dl_h1").to_numpy().view(np.uint64))
        return left.select(names).filter(pa.array(hit))

    sharded = refs.withColumn("dl_shard", _shard(state.shards))
    # A row a shard; each filter is copied to its shard's groups.
    salts = sharded.groupBy("dl_shard").agg(F.ceil(F.count("*") / GROUP_REFS).cast("int").alias("dl_salts"))
    held = materialize(state.filters.join(salts, "dl_shard"))
    salted = sharded.join(held.select("dl_shard", "dl_salts"), "dl_shard").withColumn("dl_salt", F.pmod(F.xxhash64("dl_doc", "dl_text"), "dl_salts").cast("int"))
    copies = held.withColumn("dl_salt", F.explode(F.sequence(F.lit(0), F.col("dl_salts") - 1))).select("dl_shard", "dl_salt", "dl_filter")
    return salted.select("dl_shard", "dl_salt", *names).groupBy("dl_shard", "dl_salt").cogroup(copies.groupBy("dl_shard", "dl_salt")).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def drops(refs: DataFrame, state: State) -> DataFrame:
    """Per document and text the hashes of the lines that it loses: (dl_doc, dl_text, dl_drop array of hashes)."""
    lost = probe(refs, state).join(state.counted, ["dl_h1", "dl_h2"]).filter(F.col("dl_doc") < F.col("dl_last"))
    return lost.groupBy("dl_doc", "dl_text").agg(F.collect_set(F.struct("dl_h1", "dl_h2")).alias("dl_drop"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, state: State | None = None, digest: bool = False) -> DataFrame:
    """docs with repeated lines taken out of text, plus dl_lines and dl_dropped; with `digest`, dl_sha256 stands instead of the text.

    `state`: that of other documents, which docs are inserted into; default: nothing was there.
    """
    refs = materialize(line_refs(docs, key, text, min_chars))
    lost = drops(refs, insert_documents(state, refs, min_docs)).withColumnRenamed("dl_text", "dl_whole")
    kept = [c for c in docs.columns if not c.startswith("dl_") and (c != text) and not (digest and c != key)]
    left = docs.select(*[F.col(c) for c in kept], F.col(text).alias("dl_text"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("dl_doc"), F.xxhash64(text).alias("dl_whole"))
    joined = left.join(lost.hint("shuffle_hash"), ["dl_doc", "dl_whole"], "left").drop("dl_doc", "dl_whole")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [c for c in docs.columns if c in kept or (c == text and not digest)]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "dl_lines long", "dl_dropped long", *(["dl_sha256 string"] if digest else [])])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, gone, sums = [], [], [], []
            listed = b.column("dl_drop")
            has = listed.is_valid()
            for i, t in enumerate(b.column("dl_text")):
                raw = (t.as_py() or "").encode()
                n, d = raw.count(b"\n") + 1, 0
                if has[i].as_py():
                    bad = {(x["dl_h1"], x["dl_h2"]) for x in listed[i].as_py()}
                    out = []
                    for line in raw.split(b"\n"):
                        if len(line) >= min_chars and (k := long_key(line, min_chars)) and _halves(k) in bad:
                            d += 1
                        else:
                            out.append(line)
                    raw = b"\n".join(out)
                lines.append(n)
                gone.append(d)
                if digest:
                    sums.append(hashlib.sha256(raw).hexdigest())
                else:
                    texts.append(raw.decode() if t.is_valid else None)
            columns = {c: b.column(c) for c in kept}
            if not digest:
                columns[text] = pa.array(texts, pa.string())
            arrays = [*(columns[c] for c in names), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), *([pa.array(sums, pa.string())] if digest else [])]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "dl_lines", "dl_dropped", *(["dl_sha256"] if digest else [])])

    return joined.mapInArrow(run, schema)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
    return out.select("doc_id", F.col("dl_lines").alias("n_lines"), F.col("dl_dropped").alias("n_dropped"), F.col("dl_sha256").alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, pos, line, c.last IS NOT NULL AND k.doc_id < c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
