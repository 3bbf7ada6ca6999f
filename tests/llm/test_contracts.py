"""The numbered queries: against SQL where there is any, else against brute force over the same rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np
import pytest
import xxhash

from tests.compare import assert_same, connect
from tidemark.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(data):
    return dict(duckdb.sql(f"select doc_id, text from read_parquet('{data}/documents.parquet')").fetchall())


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), connect(data), SQL[name])


def test_op1(spark, data, docs):
    rows = QUERIES["op1_importance"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{data}/labels.parquet')").fetchall()
    kept = {r.doc_id: r.kept for r in rows}
    good, bad = ([kept[i] for i, q in labels if q == x] for x in (1, 0))
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.5
    keys = sorted((r.key for r in rows), reverse=True)
    k = sum(r.kept for r in rows)
    assert all(r.kept == (r.key >= keys[k - 1]) for r in rows)
    assert k == round(len(docs) * np.mean([q for _, q in labels]))


def test_op2(spark, data, docs):
    rows = {r.doc_id: r for r in QUERIES["op2_simhash"](spark, data).collect()}
    prints = {}
    for i, t in docs.items():
        w = WORD.findall(lower(t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: r.component_id for i, r in rows.items()} == {i: root(i) for i in ids}


def test_op4_shares(spark, data):
    by = defaultdict(list)
    for r in QUERIES["op4_mix"](spark, data).collect():
        by[(r.source_size, r.target)].append(r)
    total = sum(s for s, _ in by)
    assert abs(sum(t for _, t in by) - total) < 1e-6 * total
    for (size, target), rows in by.items():
        assert target <= 3 * size + 1e-6 and all(r.taken <= 3 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)


def test_op5(spark, data, docs):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import default_tokenizer, lower_bound

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = QUERIES["op5_packing"](spark, data).collect()
    by_doc, by_sequence = defaultdict(dict), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id][r.piece] = r
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for i, t in docs.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert len(by_doc[i]) == -(-len(ids) // 2048)
        for n, r in by_doc[i].items():
            part = ids[2048 * n : 2048 * (n + 1)]
            assert (r.start, r.length, r.ids_crc32) == (2048 * n, len(part), zlib.crc32(part.tobytes()))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= lower_bound(np.array([r.length for r in rows])) + 1


def test_op6_base(spark, data, docs):
    rows = QUERIES["op6_context_tree"](spark, data).collect()
    tokens = {i: [*WORD.findall(lower(t or "")), 0] for i, t in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    count = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in rows:
        ws = tokens[r.doc_id]
        base = sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0


def test_op9_base(spark, data, docs):
    for r in QUERIES["op9_weak_supervision"](spark, data).collect():
        t = docs[r.doc_id] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_op9_verdict(spark, data, docs):
    """Votes and posteriors from features counted word by word."""
    from tidemark.llm import weak_supervision

    def vote(bad, good):
        return "-" if bad else "+" if good else "0"

    patterns, rows = {}, QUERIES["op9_weak_supervision"](spark, data).collect()
    for i, t in docs.items():
        t = t or ""
        w, lines = WORD.findall(t), t.split("\n")
        if not w:
            continue
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        seen = Counter(windows)
        n, covered = len(w), {j for k, x in enumerate(windows) if seen[x] > 1 for j in range(k, k + 5)}
        full = [x for x in lines if WORD.search(x)]
        share = lambda test: sum(map(test, w)) / n  # noqa: B023, E731
        dups, size, kinds = (len(full) - len(set(full))) / len(lines), sum(map(len, w)) / n, sum(len(set(w[j : j + 500])) for j in range(0, n, 500)) / n
        letters = sum(c.isascii() and c.isalpha() for c in t)
        caps = sum("A" <= c <= "Z" for c in t) / letters if letters else None
        symbols, repeats, bangs = sum(c in "#*$%&|<>" for c in t) / n, len(covered) / n, t.count("!") / n
        bars, stops, marked = share(lambda x: x == "|"), share(lambda x: x[-1] in ".!?"), share(lambda x: len(x.encode()) > 1 and x[-1] in "#*$%&|<>")
        patterns[i] = "".join([
            vote(symbols > 0.1, symbols < 0.02), vote(size < 2 or size > 15, 3 <= size <= 10), "0" if caps is None else vote(caps > 0.4, caps < 0.15), vote(repeats > 0.15, repeats < 0.02), vote(dups > 0.3, dups == 0),
            vote(kinds < 0.25, kinds > 0.35), vote(bangs > 0.2, bangs < 0.05), vote(bars > 0.1, bars == 0), vote(marked > 0.2, marked < 0.02), vote((stops * n + 0.5) / n < 0.01, stops > 0.01),
        ])
    counts = Counter(patterns.values()) + Counter(r.votes for r in rows if r.doc_id not in patterns)
    posterior = weak_supervision.fit(dict(sorted(counts.items())))
    for r in rows:
        if r.doc_id in patterns:
            assert r.votes == patterns[r.doc_id], r
            assert r.kept == (not r.base_failed and posterior[r.votes] >= 0.5)


def test_op9_agrees_with_labels(spark):
    where = "/root/testdata/sf0.01"
    kept = {r.doc_id: (r.kept, r.base_failed) for r in QUERIES["op9_weak_supervision"](spark, where).collect()}
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{where}/labels.parquet')").fetchall()
    assert np.mean([kept[i][0] for i, q in labels if q == 1 and not kept[i][1]]) > 0.95
    assert np.mean([kept[i][0] for i, q in labels if q == 0]) < 0.1


def test_op10_held_out(spark):
    where = "/root/testdata/sf0.01"
    rows = QUERIES["op10_language_id"](spark, where).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from read_parquet('{where}/documents.parquet')").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97
