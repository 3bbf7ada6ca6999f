"""Fill-in-middle, periodic runs and I-Match: against brute force, and awkward input by value."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import imatch, importance, infill, periodic_runs
from tidemark.llm.queries import QUERIES
from tidemark.llm.textbytes import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The grammars as patterns of a unit, matched from left to right.
GRAMMARS = {"char": r"[\s\S]", "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", "line": r"[^\n]*\n|[^\n]+"}
HARD = ["", "a", " a  b c ", "x😀y é 12ab,.\n\nq", "😀" * 9000 + "a b" * 3000, "ab12 cd\n" * 5000, "𐐀𐐀a 1 ", "\n", " " * 600 + "b", "é" * 511 + "\n" + "x" * 700, None]


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def texts(data: str) -> dict[int, str]:
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from read_parquet('{data}/documents.parquet')").fetchall()}


def numbers(key) -> list[int]:
    x = sha(f"1:{'' if key is None else key}")
    return [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_infill_cuts_at_units(spark, unit):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    rows = infill.rearrange(df, unit=unit, plain_percent=0).withColumn("back", infill.restore(F.col("fm_output"), F.col("fm_form"))).collect()
    assert len(rows) == len(HARD)
    for r in rows:
        units = re.findall(GRAMMARS[unit], r.text or "")
        assert r.fm_units == len(units) and r.back == (r.text or "")
        h = numbers(r.doc_id)
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        if r.text:
            assert (r.fm_prefix, r.fm_middle, r.fm_suffix) == ("".join(units[:a]), "".join(units[a:b]), "".join(units[b:]))
            assert r.fm_form == ("spm" if h[3] % 100 < 20 else "psm")
        else:
            assert r.fm_form == "plain" and r.fm_output == "" and r.fm_prefix is None


def test_infill_token_pieces(spark):
    df = spark.createDataFrame([("x😀y é 12ab,.\n\nq",), ("𐐀𐐀a 1 ",), ("",)], "text string")
    found = [r.p for r in df.select(infill.pieces(F.col("text"), infill.UNITS["token"]).alias("p")).collect()]
    assert found == [["x", "😀", "y", " ", "é", " ", "12", "ab", ",", ".", "\n\n", "q"], ["𐐀𐐀a", " ", "1", " "], []]


def test_infill_of_a_text_above_a_megabyte(spark):
    text = "wörd 😀 and more\n" * 90_000
    [r] = infill.rearrange(spark.createDataFrame([(7, text)], "doc_id long, text string"), plain_percent=0).collect()
    a, b = sorted(h % (len(text) + 1) for h in numbers(7)[:2])
    assert len(text.encode()) > 1 << 20 and (r.fm_units, r.fm_prefix, r.fm_middle) == (len(text), text[:a], text[a:b])


def test_infill_keeps_texts_with_marks_plain(spark, odd):
    df = spark.createDataFrame([(1, "a<P>b", "x"), (2, "a<S>", "x"), (3, "<M>", "x"), (4, "<P <S", "x"), (None, "no id", "x"), (4, "<P <S", "x")], "doc_id long, text string, fm_output string")
    rows = infill.rearrange(df, plain_percent=0).collect()
    assert [r.fm_form == "plain" for r in rows] == [True] * 3 + [False] * 3
    assert rows[3] == rows[5] and [r.fm_output for r in rows[:3]] == ["a<P>b", "a<S>", "<M>"]
    back = infill.rearrange(odd, plain_percent=0).select("text", infill.restore(F.col("fm_output"), F.col("fm_form")).alias("back")).collect()
    assert [(r.text or "") for r in back] == [r.back for r in back]
    assert infill.rearrange(odd.limit(0)).count() == 0


def brute_runs(w: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period): every maximal stretch of each period whose period is the smallest."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list, found: list[tuple[int, int, int]]) -> list:
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [x for i, x in enumerate(w) if i not in gone]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=9), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=6)), max_size=5), st.sampled_from([(6, 4), (2, 2), (3, 3)]))
def test_runs_equal_brute_force(parts, rule):
    docs = [root * times + tail + root * 4 for root, times, tail in parts]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    t, s, n, p = periodic_runs.runs(np.array([x for d in docs for x in d], np.int64), first, *rule)
    assert list(zip(t.tolist(), s.tolist(), n.tolist(), p.tolist(), strict=True)) == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d, *rule)]


def test_refinement_moves_smaller_parts_only():
    n = 4096
    partition = periodic_runs.Partition(np.arange(n) % 7, np.array([0, n]))
    touched = 0
    while len(partition.splitters):
        partition.refine()
        touched += len(partition.splitters)
    assert partition.length >= n - 7 and touched < n * 12  # not positions times lengths
    assert partition.classes == partition.n


def planted(key: int, w: list[str]) -> list[str]:
    h = zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_op12(spark, data):
    docs = texts(data)
    rows = QUERIES["op12_periodic_runs"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert sum(r.n_runs > 0 for r in rows) > len(docs) // 30
    for r in rows:
        w = planted(r.doc_id, WORD.findall(docs[r.doc_id]))
        found = brute_runs(w) if len(w) < 4000 else None
        if found is None:
            continue
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(collapsed(w, found)))


def test_runs_of_awkward_texts(spark, odd):
    rows = periodic_runs.collapse(odd.withColumn("pr_text", F.lit(3))).collect()
    assert len(rows) == odd.count() and rows[0].mix_size == "x"
    for r in rows:
        w = WORD.findall(r.text or "")
        found = brute_runs(w) if len(w) < 100 else [(0, len(w), 1)]
        assert r.pr_words == len(w) and [(x.start, x.length, x.period) for x in r.pr_runs] == found and r.pr_text == " ".join(collapsed(w, found))
    assert periodic_runs.collapse(odd.limit(0)).count() == 0
    keyless = spark.createDataFrame([(None, "a b " * 9), (None, None)], "doc_id long, text string")
    assert [r.text for r in periodic_runs.plant(keyless).collect()] == ["a b " * 9, None]


def test_runs_of_a_text_above_a_slice(spark):
    rng = random.Random(4)
    root = [f"w{rng.randrange(50)}" for _ in range(997)]
    w = [f"x{i}" for i in range(500_000)] + root * 5 + ["é"] * 7 + [f"y{i}" for i in range(300_000)]
    df = spark.createDataFrame([(1, "b"), (2, " ".join(w)), (3, "z z z z z z")], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs.collapse(df).collect()}
    assert len(" ".join(w)) > periodic_runs.SLICE_BYTES
    assert [tuple(x) for x in rows[2].pr_runs] == [(500_000, 997 * 5, 997), (500_000 + 997 * 5, 7, 1)] and rows[3].pr_text == "z"
    assert rows[2].pr_text == " ".join(w[:500_997] + ["é"] + w[500_000 + 997 * 5 + 7 :])


def word_hashes(t: str) -> set[int]:
    return {xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}


def chained(hashes: list[int]) -> int:
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def brute_print(t: str, lexicon: set[int]) -> list[int]:
    every = sorted(word_hashes(t), key=signed)
    kept = [h for h in every if h % (1 << imatch.TERM_BITS) in lexicon] or every
    out, at = [], imatch.TERM_BITS
    for width in imatch.LEVELS:
        for j in range(imatch.SUBSETS):
            held = [h for h in kept if (h >> at) % (1 << width) == j]
            out.append(chained(held) % 65535 + 1 if held else 0)
        at += width
    return out


def brute_likeness(a: list[int], b: list[int]) -> float:
    if a == b:
        return 1.0
    for level in reversed(range(len(imatch.LEVELS))):
        pairs = [(x, y) for x, y in zip(a, b, strict=True)][level * imatch.SUBSETS : (level + 1) * imatch.SUBSETS]
        some = [p for p in pairs if any(p)]
        if len(some) >= imatch.SUBSETS // 2 or level == 0:
            return sum(x == y for x, y in some) / max(len(some), 1)
    raise AssertionError


def brute_lexicon(docs: list[str]) -> set[int]:
    df = Counter(h % (1 << imatch.TERM_BITS) for t in docs for h in word_hashes(t))
    return {h for h, n in df.items() if imatch.LEAST <= n <= max(imatch.LEAST, imatch.MOST * len(docs))}


def test_op13(spark, data):
    docs = sorted(texts(data).items())
    rows = {r.doc_id: r for r in QUERIES["op13_imatch"](spark, data).collect()}
    assert sorted(rows) == [i for i, _ in docs]
    lexicon = brute_lexicon([t for _, t in docs])
    prints = {i: brute_print(t, lexicon) for i, t in docs}
    for at, (i, t) in enumerate(docs):
        j, following = docs[(at + 1) % len(docs)]
        m = len(t) // 2
        edited = t[: len(t) - m] + following[:m]
        other = brute_print(edited, lexicon)
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:04x}" for x in p) for p in (prints[i], other))
        assert (r.near_edited, r.near_next) == (brute_likeness(prints[i], other), brute_likeness(prints[i], prints[j]))
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.9


def test_imatch_of_awkward_tables(spark, odd):
    odd = odd.withColumn("im_block", F.lit("y"))
    rows = imatch.compare_with_next(odd).collect()
    assert len(rows) == odd.count() and "im_block" not in rows[0] and rows[0].mix_size == "x"
    # Keys 1 to 10 with 8 twice, then the one without a key; the first follows it.
    ordered = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id))
    for r, after in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, m = r.text or "", len(r.text or "") // 2
        assert r.im_edited == t[: len(t) - m] + (after.text or "")[:m] and r.im_next_print == after.im_print
    blank = [r.im_print for r in rows if not (r.text or "").split()]
    assert len(blank) == 3 and all(x == 0 for p in blank for x in p)
    assert imatch.compare_with_next(odd.limit(0)).count() == 0
    [alone] = imatch.compare_with_next(odd.filter("doc_id = 4")).collect()
    assert alone.im_edited == alone.text[: len(alone.text) - len(alone.text) // 2] + alone.text[: len(alone.text) // 2]


@pytest.mark.parametrize("ids", ["dense", "one key", "clusters", "wide"])
def test_next_document_across_blocks(spark, ids):
    rng = random.Random(5)
    key = {"dense": lambda i: i, "one key": lambda i: 7 if i % 3 else i, "clusters": lambda i: i % 2 * 10**15 + i, "wide": lambda i: rng.randrange(-(2**63), 2**63 - 5)}[ids]
    docs = [(key(i), f"text {i}") for i in range(700)] + [(None, "none a"), (None, "none b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = imatch.with_next(df, "doc_id", {"next_id": "doc_id", "next_text": "text"}, rows=16).collect()
    ordered = sorted(docs, key=lambda d: (d[0] if d[0] is not None else imatch.LAST, signed(xxhash.xxh64_intdigest(d[1].encode(), 42))))
    want = {(*d, *after) for d, after in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    assert len(found) == len(docs) and {tuple(r) for r in found} == want
    placed = imatch._place(df.select(F.coalesce("doc_id", F.lit(imatch.LAST)).alias("im_id"), F.xxhash64("text").alias("im_tie")), 16)
    assert placed.groupBy("im_block").count().agg(F.max("count")).first()[0] <= 64


def test_equal_texts_have_equal_fingerprints(spark):
    base = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([base, base, base.upper(), base + " more", "other words here", None])], "doc_id long, text string")
    lexicon = imatch.learn_lexicon(df, least=1, most=1.0)
    prints = [r.p for r in imatch.fingerprint(df, lexicon, name="p").orderBy("doc_id").collect()]
    assert prints[0] == prints[1] == prints[2] != prints[3]
    near = spark.createDataFrame([(prints[0], prints[i]) for i in range(6)], "a array<int>, b array<int>").select(imatch.likeness(F.col("a"), F.col("b")).alias("x"))
    found = [r.x for r in near.collect()]
    assert found[:3] == [1.0] * 3 and found[3] > 0.8 and found[4:] == [0.0, 0.0]


def test_imatch_runs_no_python(spark, data):
    plan = QUERIES["op13_imatch"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan


def test_rows_without_an_id_draw_apart(spark):
    rows = [(i if i < 300 else None if i < 500 else 7, f"some words number {i % 2 if i >= 300 else 0}", "qc") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, qc_key string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    for seed in range(3):
        kept = importance.resample(df, labels, seed=seed).filter("qc_kept").collect()
        counts = [sum(r.doc_id is None for r in kept), sum(r.doc_id == 7 for r in kept)]
        assert len(kept) == 300 and 50 < counts[0] < 150 and 20 < counts[1] < 80, counts
        keys = importance.resample(df, labels, seed=seed).select("qc_key").collect()
        assert len({r.qc_key for r in keys}) == 600 and isinstance(keys[0].qc_key, float)


M64 = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def plain_mix(h: int) -> int:
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


def plain_features(text: str) -> list[int]:
    """Hashed words, pairs of words and triples of word shapes, one at a time."""
    words = [w.encode() for w in WORD.findall(text)]
    h = [plain_mix((sum((b + 1) * pow(GOLDEN, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & M64) for w in words]

    def kind(b: int) -> int:
        c = chr(b)
        return 7 if b >= 128 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in ".,;:?'\"()-" else 4 if c == "!" else 5 if c in "#*$%&|<>@^~_=+/\\{}[]" else 6

    def shape(i: int) -> int:
        kinds = [kind(b) for b in words[i]]
        loud = kinds.count(1) > 1 and kinds.count(0) == 0
        return kinds[0] | kinds[-1] << 3 | loud << 6 | (i > 0 and words[i] == words[i - 1]) << 7 | (len(words[i]) == 1) << 8

    n = importance.BUCKETS
    out = [x % n for x in h]
    out += [plain_mix((h[i] * 3 + plain_mix(h[i + 1])) & M64) % n + n for i in range(len(h) - 1)]
    return out + [plain_mix(shape(i) | shape(i + 1) << 9 | shape(i + 2) << 18) % n + 2 * n for i in range(len(h) - 2)]


def test_features_equal_a_plain_version():
    texts_ = ["The the the DOG, the dog!! a a 12", "", "x", "É ß 日本 abc ABC", "one two", None, "#$% *** $$$ $$$ {x} A-B c_d", " lead  and trail\n\n"]
    found = [[] for _ in texts_]
    for t in slices(pa.array(texts_), 24):
        ids, rows = importance.features(t)
        for i, r in zip(ids.tolist(), rows.tolist(), strict=True):
            found[t.row + r].append(i)
    assert [sorted(f) for f in found] == [sorted(plain_features(t or "")) for t in texts_]
