"""Best-fit packing with certified bin counts and repacking.

Whole documents become token ids, each followed by id 0; only those longer than a sequence are cut. Pieces are dealt to
groups of bounded size; each group packs its own best-fit decreasing, and lower bounds by dual feasible functions certify
its number of sequences. A group that meets its bound is closed: no packing of its pieces has fewer sequences. Groups with a
gap give the pieces of their least filled sequences to an exchange, where pieces of several groups meet in new groups and are
packed again. Rounds end when no group has a gap, when all that is left was in one group, or when a round saved less than a
sequence a group. Sequences that stay closed are never touched again. bp_bins and bp_bound give what a piece's last group
needed and its bound.

Null or empty text: one piece, id 0 alone. Repeated rows are packed each; their pieces share doc_id and number. An empty table
gives an empty result. The result has the key and the operator's own columns, which start with `bp_`; other columns don't pass.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import gives_back, materialize

LENGTH = 2048
GROUP_PIECES = 16384
#: Words whose ids a Python worker keeps; others are encoded each time.
CACHE_WORDS = 200_000
_SEPARATOR = "\x01"
#: The normaliser and splitter for which words can be encoded one by one; texts of other tokenizers are encoded whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_SPLITTER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Words of visible ASCII and of Latin letters whose lower case is one letter; no normal form changes them.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: The characters that byte-level vocabularies write for bytes: visible ones stand for themselves, the others count up from 256.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


@lru_cache(1)
def _encoder(path: str):
    return WordEncoder(path)


class WordEncoder:
    """Token ids of texts. A tokenizer of the known normaliser and splitter never joins across white space, so words are encoded once each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = (spec["normalizer"], spec["pre_tokenizer"]) == (_NORMALIZER, _SPLITTER)
        self.kind, self.letter = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.separator = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids[0]
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _plain_ids(self, word: str) -> bytes:
        """A _PLAIN word's ids by the tokenizer's own model: its normaliser only lower-cases such words, and its splitter's pattern is _PARTS."""
        out = []
        for part in _PARTS.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                found = [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS))]
                ids = struct.pack(f"<{len(found)}{self.letter}", *found)
                if len(self.parts) < CACHE_WORDS:
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def _encode_new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """ids as little-endian numbers of self.kind; other than plain words go to the tokenizer many at a time, with a separator word between them."""
        out: dict[bytes, bytes] = {}
        rest = []
        for w in words:
            text = w.decode()
            if _PLAIN(text) and "<|" not in text:
                out[w] = self._plain_ids(text)
            else:
                rest.append(w)
        words = rest
        plain = [w for w in words if _SEPARATOR.encode() not in w]
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_SEPARATOR} ".join(w.decode() for w in some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) == len(some) - 1:
                raw = ids.tobytes()
                wide = ids.itemsize
                ends = [0, *((cuts + 1) * wide).tolist(), len(raw) + wide]
                out.update((w, raw[ends[i] : ends[i + 1] - wide]) for i, w in enumerate(some))
        for w in words:
            if w not in out:
                out[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        known = self.known
        for text in texts:
            if not self.by_word:
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind)
                continue
            words = text.split()
            found = list(map(known.get, words))
            if None in found:
                fresh = self._encode_new(list({w for w, f in zip(words, found, strict=True) if f is None}))
                if len(known) + len(fresh) <= CACHE_WORDS:
                    known.update(fresh)
                found = [fresh[w] if f is None else f for w, f in zip(words, found, strict=True)]
            yield np.frombuffer(b"".join(found), self.kind)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """(key, bp_piece, bp_start, bp_length, bp_crc32) of every whole document; tokenizer: the file's path on every machine."""
    kind = dict(docs.dtypes)[key]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            rows, numbers, starts, sizes, sums = [], [], [], [], []
            texts = ((t.as_py() or "").encode() for t in b.column(1))
            for i, ids in enumerate(encoder.encode(texts)):
                ids = np.append(ids, end_id).astype("<u4")
                for n, s in enumerate(range(0, len(ids), length)):
                    piece = ids[s : s + length]
                    rows.append(i)
                    numbers.append(n)
                    starts.append(s)
                    sizes.append(len(piece))
                    sums.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))], [key, "bp_piece", "bp_start", "bp_length", "bp_crc32"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, bp_piece int, bp_start long, bp_length long, bp_crc32 long")


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """Fewest sequences by dual feasible functions: the sum itself, sizes rounded by thresholds, and sizes in multiples of length / k."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=length + 1).astype(np.int64)
    value = np.arange(length + 1)
    best = -(-int((n * value).sum()) // length)
    # Threshold functions: sizes over length - t count as length, sizes below t as nothing.
    count, total = np.cumsum(n), np.cumsum(n * value)
    for t in range(1, length // 2 + 1):
        large = int(count[-1] - count[length - t])
        middle = int(total[length - t] - total[t - 1])
        best = max(best, large + -(-middle // length))
    for k in range(1, 21):
        scaled = np.where((k + 1) * value % length == 0, value * k, ((k + 1) * value // length) * length)
        best = max(best, -(-int((n * scaled).sum()) // (k * length)))
    return best


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bin of each piece: largest first, each into the fullest bin that it fits."""
    bins = np.empty(len(sizes), np.int64)
    rooms: list[int] = []  # the rooms that open bins have, ascending
    by_room: dict[int, list[int]] = {}
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = opened, length
            opened += 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        bins[i] = b
        room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append(b)
    return bins


def _packer(length: int, number: int):
    """Packs a group; the least filled sequences of a group with a gap to its bound stay open (bp_open)."""

    def run(key, table):
        table = table.take(pa.array(np.argsort(table.column("bp_row").to_numpy(), kind="stable")))
        sizes = table.column("bp_length").to_numpy()
        bins = best_fit_decreasing(sizes, length)
        n = int(bins.max()) + 1
        bound = lower_bound(sizes, length)
        filled = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        is_open = np.zeros(n, bool)
        if n > bound:
            # Those that would have to be emptied, and partners.
            is_open[np.argsort(filled, kind="stable")[: max(8 * (n - bound), n // 16)]] = True
            is_open &= filled < length
        by_bin = np.argsort(bins, kind="stable")
        offsets = np.zeros(len(sizes), np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes[by_bin])[:-1]])
        first = np.searchsorted(bins[by_bin], np.arange(n))
        offsets[by_bin] = sums - sums[first][bins[by_bin]]
        base = (number << 56) | (int(key[0].as_py()) << 24)
        columns = [bins + base, offsets, np.full(len(sizes), n), np.full(len(sizes), bound), is_open[bins]]
        return pa.table([table.column("bp_row"), table.column("bp_length"), *map(pa.array, columns)], names=["bp_row", "bp_length", "bp_sequence", "bp_offset", "bp_bins", "bp_bound", "bp_open"])

    return run


_PACKED = "bp_row long, bp_length long, bp_sequence long, bp_offset long, bp_bins long, bp_bound long, bp_open boolean"


def pack(cut: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows with bp_row (unique long) and bp_length -> (bp_row, bp_sequence, bp_offset, bp_bins, bp_bound)."""
    out = ["bp_row", "bp_sequence", "bp_offset", "bp_bins", "bp_bound"]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    done = cut.filter(F.col("bp_length") >= length).select("bp_row", F.col("bp_row").alias("bp_sequence"), none.alias("bp_offset"), one.alias("bp_bins"), one.alias("bp_bound"))
    small = cut.filter(F.col("bp_length") < length).select("bp_row", "bp_length")
    n, number, before = small.count(), 0, None
    while n:
        number += 1
        groups = -(-n // group_pieces)
        dealt = small.withColumn("bp_group", F.pmod(F.xxhash64("bp_row", F.lit(number)), F.lit(groups)))
        packed = materialize(dealt.groupBy("bp_group").applyInArrow(_packer(length, number), _PACKED))
        starts = F.col("bp_offset") == 0  # one piece of each sequence
        now, still, n = packed.agg(F.count_if(starts), F.count_if(starts & F.col("bp_open")), F.count_if("bp_open")).first()
        if groups == 1 or (before is not None and before - now < groups):
            done = done.unionByName(packed.select(*out))
            break
        done = done.unionByName(packed.filter(~F.col("bp_open")).select(*out))
        small, before = packed.filter("bp_open").select("bp_row", "bp_length"), still
    return done


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, bp_piece, bp_start, bp_length, bp_crc32, bp_sequence, bp_offset, bp_bins, bp_bound)."""
    cut = materialize(pieces(docs, tokenizer, key, text, length).withColumn("bp_row", F.monotonically_increasing_id()))
    placed = pack(cut, length).withColumnRenamed("bp_row", "bp_r")
    return cut.join(placed, F.col("bp_row") == F.col("bp_r")).drop("bp_row", "bp_r")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    renamed = {"bp_piece": "piece", "bp_start": "start", "bp_length": "length", "bp_crc32": "ids_crc32", "bp_sequence": "sequence_id", "bp_offset": "offset"}
    return out.select("doc_id", *[F.col(a).alias(b) for a, b in renamed.items()])
