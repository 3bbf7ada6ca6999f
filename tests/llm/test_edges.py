"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; and each method's own parts."""

from __future__ import annotations

import hashlib
import math
import random
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import context_tree as ct
from tidemark.llm import host_reputation, importance, language_id, line_dedup, maxscore, mixing, packing, simhash, weak_supervision
from tidemark.llm.components import components
from tidemark.llm.textbytes import slices

LABELS = "doc_id long, quality int, toxic int"


def columns(df):
    return [c for c in df.columns if not c.startswith(("mix_", "nd_", "dl_"))]


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_every_operator_takes_awkward_tables(spark, request, table):
    docs = request.getfixturevalue(table)
    n = docs.count()
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (9, 0, 0), (None, 1, None), (5, None, 1)], LABELS)
    assert importance.resample(docs, labels).count() == n
    assert importance.resample(docs, labels.limit(0)).filter("qc_kept").count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert line_dedup.dedup_lines(docs).count() == n
    assert weak_supervision.judge(docs).count() == n
    assert language_id.identify(docs, language_id.learn(docs)).count() == n
    assert packing.pack_documents(docs, packing.default_tokenizer()).filter("bp_piece = 0").count() == n
    assert ct.score(docs, ~ct.fold(F.col("doc_id"), 5, 1)).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit("h").alias("host"), F.lit(1).alias("n"))
    assert host_reputation.filter_urls(pages, spark.createDataFrame([(4, 1), (5, None)], "page_id long, bad int")).count() == n


def test_slices_cover_every_row():
    texts = ["a bb", None, "", "é\n\nx", "w" * 50] * 7
    found = [(t.row + i, t.text(i)) for t in slices(pa.array(texts).slice(3, 20), 16) for i in range(t.n)]
    assert found == [(i, (x or "").encode()) for i, x in enumerate(texts[3:23])]


def test_components_of_a_long_chain(spark):
    chain = list(range(1, 200))
    random.Random(1).shuffle(chain)
    pairs = [(chain[i], chain[i + 1]) for i in range(99)] + [(chain[i], chain[i + 1]) for i in range(100, 198)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {found[x] for x in chain[:100]} == {min(chain[:100])} and {found[x] for x in chain[100:]} == {min(chain[100:])}


def test_simhash_links_are_complete(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for x in base for _ in range(12)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = {(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(spark.createDataFrame(signed, "nd_print long")).collect()}
    want = {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    assert {frozenset(x) for x in found} == want and len(found) == len(want)


def test_simhash_keeps_one_of_each_group(spark, odd):
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert kept.count(8) == 2 and 1 in kept and 2 not in kept and 3 not in kept  # 1 to 3 have no words: one group


def test_maxscore_equals_full_scoring(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(600)]
    rows += [(601, None), (602, [1.0, None] * 6), (603, [float("nan")] * 12), (604, [float("inf")] * 12), (None, rows[0][1]), (605, rows[0][1]), (606, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = {}
    for r in maxscore.top_k(df, df.filter("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in rows if i is not None and (i <= 600 or i >= 605)}
    for q in range(0, 600, 50):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:10]
        assert [found[q][k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert maxscore.top_k(df.limit(0), df).count() == 0
    assert maxscore.top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2


def test_mix_is_nested_and_near(spark, prose):
    def taken(share):
        return {r.doc_id: r.mix_copies for r in mixing.mix(prose, share=share).collect()}

    small, large = taken(0.2), taken(0.4)
    assert all(small[i] <= large[i] for i in small) and small == taken(0.2)


def test_targets_stop_at_their_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 50), (None, 0)], "mix_source string, mix_source_size long")
    found = {r.mix_source: r.mix_target for r in mixing.targets(sizes).collect()}
    # Weights 1, 2, 3, 1: b stops at 3, null at 0; a and c share the other 148 by 1 to 3.
    assert found["b"] == 3 and found[None] == 0 and found["a"] == pytest.approx(37) and found["c"] == pytest.approx(111)


def test_packing_bounds_and_bins():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 2048, 400), np.full(30, 1025), np.full(31, 683), np.array([], np.int64)):
        bins = packing.best_fit_decreasing(sizes)
        n = int(bins.max()) + 1 if len(bins) else 0
        assert all(np.bincount(bins, weights=sizes, minlength=n) <= 2048)
        assert packing.lower_bound(sizes) <= n <= packing.lower_bound(sizes) * 11 / 9 + 1
    assert packing.lower_bound(np.full(30, 1025)) == 30 and packing.lower_bound(np.full(31, 683)) == 16


def test_word_encoder_equals_tokenizer():
    path = packing.default_tokenizer()
    from tokenizers import Tokenizer

    texts = ["Don't stop<|endoftext|>now 12 ÉTÉ́  x\x1cy", "a\x01b \x01 c", "ΑΣ ΣΑΣ İI", "日本語 é", "", " \n"]
    found = [x.tolist() for x in packing.WordEncoder(path).encode([t.encode() for t in texts])]
    assert found == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_exchanges_between_groups(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1500, 3000)
    cut = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "bp_row long, bp_length long")
    rows = packing.pack(cut, group_pieces=200).join(cut, "bp_row").collect()
    assert len(rows) == 3000
    by = {}
    for r in rows:
        by.setdefault(r.bp_sequence, []).append((r.bp_offset, r.bp_length))
    assert all(sum(x for _, x in v) <= 2048 for v in by.values())
    assert len(by) <= packing.lower_bound(sizes) * 1.02 + 1


def test_context_tree_equals_plain_recursion(spark):
    """A direct context-tree weighting over nodes held in dictionaries."""
    train, other = ["abracadabra", "abra", None, "cad é"], ["abrac", "zz", ""]
    depth = 3
    nodes: dict = {}

    def walk(text):
        symbols = [0] * depth + list((text or "").encode()) + [255]
        for i in range(depth, len(symbols)):
            prefix = 1
            for k in range(7, -1, -1):
                bit = symbols[i] >> k & 1
                yield tuple(symbols[i - depth : i][::-1]), prefix, bit
                prefix = prefix << 1 | bit

    for t in train:
        for context, prefix, bit in walk(t):
            for d in range(depth + 1):
                nodes.setdefault((context[:d], prefix), [0, 0])[bit] += 1
    children: dict = {}
    for c, p in nodes:
        if c:
            children.setdefault((c[:-1], p), set()).add((c, p))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @cache
    def weighted(node):
        own = kt(*nodes[node])
        if len(node[0]) == depth:
            return own
        below = sum(weighted(c) for c in children[node])
        return np.logaddexp(own, below) - math.log(2)

    def p_one(context, prefix, d=0):
        a, b = nodes.get((context[:d], prefix), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = 0.5 if (context[:d], prefix) not in nodes else 1 / (1 + math.exp(sum(weighted(c) for c in children[(context[:d], prefix)]) - kt(a, b)))
        return w * own + (1 - w) * p_one(context, prefix, d + 1)

    rows = [(i, t, True) for i, t in enumerate(train)] + [(10 + i, t, False) for i, t in enumerate(other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    found = {r.doc_id: r.lm_score for r in ct.score(df, F.col("t"), depth=depth, chunk_bytes=16).collect()}
    for i, t, _ in rows:
        want = sum(math.log10(p if bit else 1 - p) for context, prefix, bit in walk(t) for p in [p_one(context, prefix)])
        assert found[i] == pytest.approx(want, rel=1e-4), (i, t)


def test_context_tree_uses_the_sixth_byte(spark):
    """After the same five bytes only the sixth tells the next one."""
    df = spark.createDataFrame([(i, f"{c}vwxyz{c}", i < 40) for i, c in enumerate("ab" * 20)] + [(50, "avwxyza", False), (51, "avwxyzb", False)], "doc_id long, text string, t boolean")
    found = {r.doc_id: r.lm_score for r in ct.score(df, F.col("t")).collect()}
    assert found[50] > found[51] + 0.5


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.3, 100, 12345.5])
    assert np.allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-9)


def test_line_dedup_is_reversible(spark, odd):
    """Filters and counts take insertions and deletions; deleting what was inserted restores both, and lines come back."""
    refs = line_dedup.line_refs(odd)
    more = line_dedup.line_refs(odd.filter("doc_id is not null").select(F.explode(F.array(F.col("doc_id") + 100, F.col("doc_id") + 200)).alias("doc_id"), "text"))
    rows = lambda s: sorted(tuple(r) for r in s.references.collect()) + sorted(tuple(r) for r in s.counted.collect())
    inside = lambda s: {r.dl_shard: line_dedup.Cuckoo.from_bytes(r.dl_filter).content() for r in s.filters.collect()}
    a = line_dedup.insert_documents(None, refs)
    grown = line_dedup.insert_documents(a, more)
    back = line_dedup.delete_documents(grown, more.select("dl_doc"))
    assert rows(back) == rows(a) == rows(line_dedup.insert_documents(a, refs))
    assert inside(back) == inside(a) and inside(grown) != inside(a)
    assert sum(map(len, inside(grown).values())) == grown.counted.count() > a.counted.count()
    # Of documents 4 to 6, which share a line, 6 keeps it; with 104 and more none does, and without 5 and 6 nothing repeats.
    texts = lambda state: {r.doc_id: r.text for r in line_dedup.dedup_lines(odd.filter("doc_id = 4"), state=state).collect()}
    assert texts(a)[4] == "x" and texts(grown)[4] == "x"
    assert texts(line_dedup.delete_documents(a, spark.createDataFrame([(5,), (6,)], "dl_doc long")))[4].startswith("same line")


def test_line_dedup_deals_shards_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 4)
    monkeypatch.setattr(line_dedup, "GROUP_REFS", 50)
    rows = [(i if i % 7 else None, "\n".join(["a line that every document has", f"line number {i % 40} of a few documents", f"only here stands {i}"])) for i in range(400)]
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    where = {}
    for i, t in rows:
        for line in t.split("\n"):
            where.setdefault(line, set()).add(-1 if i is None else i)
    gone = lambda line, i: len(where[line]) >= 3 and i != max(where[line])
    assert got == sorted((i or -1, "\n".join(x for x in t.split("\n") if not gone(x, -1 if i is None else i))) for i, t in rows)


def test_line_dedup_keeps_the_last(spark, odd):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(odd).collect()}
    assert out[4].text == "x" and out[5].text == "y" and out[6].text.startswith("  SAME") and out[1].text is None
    sums = {r.doc_id: r.dl_sha256 for r in line_dedup.dedup_lines(odd.select("doc_id", "text"), digest=True).collect()}
    assert sums[4] == hashlib.sha256(b"x").hexdigest() and sums[1] == hashlib.sha256(b"").hexdigest()


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = line_dedup.Cuckoo(len(keys))
    for k in keys:
        f.insert(int(k))
    f = line_dedup.Cuckoo.from_bytes(f.to_bytes())
    assert f.contains(keys).all() and f.contains(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.01
    assert all(f.delete(int(k)) for k in keys[:2500]) and f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def test_rules_abstain_and_em_separates():
    patterns = {"+" * 10: 900, "-" + "+" * 8 + "-": 60, "++---0++++": 40}
    p = weak_supervision.fit(patterns)
    assert p["+" * 10] > 0.9 and p["-" + "+" * 8 + "-"] < 0.1 and p["++---0++++"] < 0.1
    assert weak_supervision.fit({}) == {}


def test_em_does_not_follow_a_noisy_rule():
    fine = "+" * 10
    alone = lambda i: fine[:i] + "-" + fine[i + 1 :]
    assert weak_supervision.fit({fine: 800, alone(3): 200})[alone(3)] > 0.5
    two = weak_supervision.fit({fine: 800, alone(3): 100, alone(5): 100})
    assert two[alone(3)] > 0.5 and two[alone(5)] > 0.5
    # The noisy rule's votes don't count, those of two that agree do.
    both = weak_supervision.fit({fine: 700, alone(3): 200, "--++++++++": 60, "--+-++++++": 40})
    assert both[alone(3)] > 0.5 and both["--++++++++"] < 0.1 and both["--+-++++++"] < 0.1


def test_em_equals_plain_expectation_maximisation():
    rng = random.Random(4)
    patterns = {"".join(rng.choice("+++0-") for _ in range(4)): rng.randint(1, 50) for _ in range(25)}
    total = sum(patterns.values())
    weight = 0.01 * total + 1
    prior = {"g": {"-": 0.01, "0": 0.2, "+": 0.79}, "b": {"-": 0.2, "0": 0.2, "+": 0.6}}
    rate, share = {c: [dict(prior[c]) for _ in range(4)] for c in "gb"}, 0.1
    for _ in range(200):
        post = {}
        for p in patterns:
            g, b = 1 - share, share
            for i, vote in enumerate(p):
                g, b = g * rate["g"][i][vote], b * rate["b"][i][vote]
            post[p] = g / (g + b)
        mass = {"g": sum(n * post[p] for p, n in patterns.items())}
        mass["b"] = total - mass["g"]
        share = (mass["b"] + weight * 0.1) / (total + weight)
        for c in "gb":
            for i in range(4):
                for vote in "-0+":
                    n = sum(m * (post[p] if c == "g" else 1 - post[p]) for p, m in patterns.items() if p[i] == vote)
                    rate[c][i][vote] = (n + weight * prior[c][vote]) / (mass[c] + weight)
    found = weak_supervision.fit(patterns)
    assert all(found[p] == pytest.approx(post[p], abs=1e-9) for p in patterns)


def test_variety_does_not_fall_with_length():
    rng = random.Random(5)
    few, many = [f"w{i}" for i in range(100)], [f"v{i}" for i in range(5000)]
    for words in (few, many):
        votes = []
        for n in (1000, 5000, 40_000):
            t = next(slices(pa.array([" ".join(rng.choice(words) for _ in range(n))])))
            f = dict(zip(weak_supervision.FEATURES, weak_supervision.features(t), strict=True))
            want = sum(len(set(x)) for w in [t.text(0).split()] for x in (w[i : i + weak_supervision.SPAN] for i in range(0, n, weak_supervision.SPAN)))
            assert f["n_distinct"][0] == want
            votes.append(f["n_distinct"][0] / f["n_words"][0])
        assert max(votes) < 0.25 if words is few else min(votes) > 0.35


def test_kth_largest(spark):
    rng = random.Random(7)
    values = [rng.gauss(0, 1e6 if i % 50 == 0 else 1) for i in range(3000)] + [1.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 1500, 3040):
        assert importance.kth_largest(df, "x", k, bins=64) == sorted(values, reverse=True)[k - 1]


def test_hosts_shrink_towards_their_domain(spark):
    pages = [(i, f"http://bad.spam.com/{i}") for i in range(40)] + [(100 + i, f"http://new.spam.com/{i}") for i in range(2)] + [(200 + i, f"http://h{i % 9}.fine.org/{i}") for i in range(300)]
    outcomes = [(i, 1) for i in range(40)] + [(200 + i, int(i % 20 == 0)) for i in range(300)]
    df, out = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")
    got = {r.page_id: r for r in host_reputation.filter_urls(df, out, rules=(("allow", "bad.spam.com/7"), ("block", "org/1"))).collect()}
    assert got[3].verdict == "block" and got[7].verdict == "allow" and got[7].rule == "bad.spam.com/7" and got[201].rule == "org/1" and got[205].verdict == "allow"
    assert got[100].bad_bound > got[205].bad_bound


def test_language_dictionaries(spark):
    known = language_id.Compressors([("en", b"the cat and the dog were in the garden of the house " * 3), ("de", "der hund und die katze waren in dem garten hinter dem haus ".encode() * 3)])
    assert known.predict("the garden of the dog")[0] == "en" and known.predict("die katze und der hund")[0] == "de"
    assert known.predict("123 !!")[0] == known.predict(None)[0] == known.predict("")[0] == "und"


def test_maxscore_of_repeated_ids_large_numbers_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) * 2.0**17 for x in rng.normal(size=3 + i % 2)]) for i in range(80)] + [(7, [1.0, 2.0, 3.0])] * 40 + [(0, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:6] + rows[:3], df.schema)
    found = {}
    for r in maxscore.top_k(df, asked).collect():
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for q, v in whole[:6]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:10]
        assert sorted(found[q]) == [(n + 1, *b) for n, b in enumerate(best)]


def test_context_tree_lowers_only_ascii_letters(spark):
    df = spark.createDataFrame([(1, "Abra Cadabra É"), (2, "abra cadabra É"), (3, "abra cadabra é")], "doc_id long, text string")
    got = {r.doc_id: r.lm_score for r in ct.score(df, F.lit(True)).collect()}
    raw = {r.doc_id: r.lm_score for r in ct.score(df, F.lit(True), lower=False).collect()}
    assert got[1] == pytest.approx(got[2]) and got[1] != pytest.approx(got[3]) and raw[1] != pytest.approx(raw[2])
    assert got[1] > raw[1]


def test_simhash_tally_rejects_before_verification(spark):
    """Pairs that share too few positional bytes meet in the index, are counted, and go by their count; the entry changes nothing."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ sum(rng.randint(1, 255) << 8 * i for i in rng.sample(range(8), n)) for n in (1, 2, 3, 4) for _ in range(30)}
    prints |= {base ^ (1 << a) ^ (1 << b) for a, b in ((0, 63), (5, 6), (31, 32))}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "nd_print long")
    signed = lambda x: x & (1 << 64) - 1
    linked = []
    for entry in (4, 6, 8):
        met = {(signed(r.u), signed(r.v)): r.shared for r in simhash.tallied(df, entry=entry).collect()}
        assert all(n == sum((u ^ v) >> 8 * i & 255 == 0 for i in range(8)) for (u, v), n in met.items())
        assert entry == 8 or any(n < 6 for n in met.values())
        linked.append({frozenset((signed(r.u), signed(r.v))) for r in simhash.links(df, entry=entry).collect()})
    assert linked[0] == linked[1] == linked[2] == {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    plan = simhash.links(df, entry=6)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan
    assert [simhash.entry_positions(n) for n in (0, 1000, 1 << 21, 1 << 30, 1 << 40)] == [4, 4, 5, 6, 7]


def test_maxscore_traverses_essential_postings_only():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24)) * 900
    v = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24)) * 60).astype(np.int64)
    ids, read = np.arange(3000), {}
    found = maxscore.search_shard(ids, v, ids[:20], v[:20], 10, read)
    want = [(q, i, -s) for q in range(20) for s, i in sorted((-int(v[q] @ v[j]), j) for j in range(3000) if j != q)[:10]]
    assert found == want
    assert read["postings"] < read["all"] / 2 and read["probed"] < read["all"] / 3


def test_maxscore_splits_by_running_bounds():
    bounds = np.array([[9.0, 5, 1, -np.inf], [3, 2, 1, -np.inf], [1, 1, 1, -np.inf]])
    assert maxscore.essential(bounds, 20).tolist() == [0, 0, 0]
    assert maxscore.essential(bounds, 8).tolist() == [2, 0, 0]
    assert maxscore.essential(bounds, -100).tolist() == [3, 0, 0]


def test_maxscore_refuses_scores_past_64_bits():
    big = np.full((3, 2), 1 << 62, np.int64)
    with pytest.raises(OverflowError):
        maxscore.search_shard(np.arange(3), big, np.arange(1), big[:1], 2)
    near = np.array([[(1 << 30) + i, 1] for i in range(40)], np.int64)
    assert [x[1] for x in maxscore.search_shard(np.arange(40), near, np.array([5]), near[5:6], 3)] == [39, 38, 37]


def test_maxscore_answers_with_one_large_component():
    rng = np.random.default_rng(8)
    v = rng.integers(-2000, 2000, (400, 6))
    for at, large in ((7, 3 << 30), (9, 1 << 45), (11, -(1 << 50))):
        v[at, at % 6] = large
    ids = np.arange(400)
    ask = np.array([0, 7, 9, 100])
    want = []
    for i in ask.tolist():
        scores = {j: sum(int(a) * int(b) for a, b in zip(v[i], v[j], strict=True)) for j in range(400) if j != i}
        want += [(i, j, scores[j]) for j in sorted(scores, key=lambda j: (-scores[j], j))[:5]]
    assert maxscore.search_shard(ids, v, ask, v[ask], 5) == want
    with pytest.raises(OverflowError):
        maxscore.search_shard(ids, v, np.array([500]), np.array([[1 << 50] * 6]), 5)  # some score is beyond 64 bits
    with pytest.raises(OverflowError):
        maxscore.search_shard(ids, np.full((400, 6), 1 << 62), ask, v[ask], 5)


def test_context_tree_of_many_groups_equals_one(spark, prose, monkeypatch):
    """Sums and values by groups of chunks change nothing."""
    found = []
    for group, shards in ((64, 512), (3, 512), (3, 4), (1, 8), (64, 4)):
        monkeypatch.setattr(ct, "GROUP_CHUNKS", group)
        monkeypatch.setattr(ct, "SHARDS", shards)
        found.append(sorted(tuple(r) for r in ct.score(prose, F.col("doc_id") % 3 > 0, chunk_bytes=1000).collect()))
    for other in found[1:]:
        for one, two in zip(found[0], other, strict=True):
            assert one[:5] == two[:5] and one[5:] == pytest.approx(two[5:], rel=1e-6)


def test_context_tree_rows_follow_the_chunks(spark, prose):
    """Arrays are one a chunk and shard, whatever the number of chunks; a group gets back the keys that it brought, no others."""
    shards = 8
    for size in (4000, 1000):
        chunks = ct.chunked(prose, "doc_id", "text", F.lit(True), size, True)
        n = chunks.count()
        counts = ct.count(chunks, shards).withColumn("lm_group", (F.col("lm_chunk") % 4).cast("int")).filter(F.col("lm_kind") == ct.NGRAM).cache()
        assert counts.count() <= n * shards
        sums = ct.partial_sums(counts, ct.NGRAM, 4, shards, 3).collect()
        of = lambda rows, g: {k for r in rows if r.lm_group == g for k in ct._unpacked(r.lm_keys).tolist()}
        raw = counts.collect()
        for g in range(4):
            assert of(sums, g) == of(raw, g)
        assert len({(r.lm_shard, r.lm_fine) for r in sums}) > shards


def test_mix_meets_targets_with_repeated_and_missing_ids(spark):
    rows = [(None, "five words stand right here", s) for s in "ab" for _ in range(200)] + [(7, "x y", "c")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(df, keep=["doc_id", "source"]).groupBy("source").agg(F.max("mix_target").alias("want"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("got"), F.max("mix_copies").alias("most")).collect()
    assert len(out) == 3 and all(abs(r.got - r.want) <= 25 and r.most <= 3 for r in out), out
    again = sorted(map(tuple, mixing.mix(df.repartition(3), keep=["doc_id", "source"]).collect()), key=str)
    assert again == sorted(map(tuple, mixing.mix(df, keep=["doc_id", "source"]).collect()), key=str)


def test_packing_is_ruled_by_its_certificate(spark):
    """Groups that meet their bound are closed at once; the total stays within the groups' bounds."""
    rng = np.random.default_rng(3)
    easy = rng.integers(1, 200, 2000)
    cut = spark.createDataFrame([(i, int(x)) for i, x in enumerate(easy)], "bp_row long, bp_length long")
    rows = packing.pack(cut, group_pieces=400).collect()
    assert all(r.bp_bins == r.bp_bound and r.bp_sequence >> 56 == 1 for r in rows)
    hard = rng.integers(1, 1500, 3000)
    rows = packing.pack(spark.createDataFrame([(i, int(x)) for i, x in enumerate(hard)], "bp_row long, bp_length long"), group_pieces=200).collect()
    assert len(rows) == 3000 and any(r.bp_sequence >> 56 > 1 for r in rows) and all(r.bp_bins >= r.bp_bound for r in rows)
    assert len({r.bp_sequence for r in rows}) <= packing.lower_bound(hard) * 1.02 + 1


def test_packing_takes_other_tokenizers(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)} | {"?": 70_000}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    encoder = packing.WordEncoder(str(tmp_path / "t.json"))
    assert [x.tolist() for x in encoder.encode([b"w1 w69999,w3", b""])] == [[1, 69_999, 70_000, 3], []]


def test_language_sample_takes_repeated_ids_and_long_texts(spark):
    rng = random.Random(3)
    words = {"en": "the and of to in is that it was for".split(), "de": "der die und das ist nicht ein zu den mit".split(), "fi": "ja on ei se hän mutta niin kuin oli olla".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(5, say("en", 30), "en") for _ in range(600)] + [(9, "same old text in english", "en")] * 2000 + [(100 + i, say("de", 30), "de") for i in range(20)]
    rows += [(200 + i, say("fi", 3000), "fi") for i in range(3)]
    learned = dict(language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert list(learned) == ["en", "de", "fi"] and all(len(d) > 1000 for d in learned.values())
    assert len(learned["en"]) <= language_id.SAMPLE_DOCS * 200 and len(learned["fi"]) <= 4 * language_id.SAMPLE_CHARS


def test_language_of_each_text_by_brute_force(spark, odd):
    import zstandard

    dictionaries = [("en", b"the harbour and the engine of the river " * 5), ("de", b"der fluss und der hafen in dem tal " * 5)]
    docs = odd.select("doc_id", "text")
    for r in language_id.identify(docs, dictionaries).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.li_lang, r.li_score) == ("und", 0.0)
            continue
        raw = b" ".join("".join(c if c.islower() and c.isascii() or not c.isascii() else " " for c in r.text.lower()).encode().split())
        sizes = {}
        for name, d in dictionaries:
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = len(c.compress(raw))
        assert r.li_lang == min(sizes, key=lambda k: sizes[k]) and r.li_bytes == min(sizes.values())


def test_page_numbers_are_read_whole(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/12/x"), (2, "http://a.b/en/1234567890123456789012"), (3, None)], "page_id long, url string")
    labels = spark.createDataFrame([(12, 0), (123456789012345678, 0)], "doc_id long, quality int")
    assert [(r.page_id, r.bad) for r in host_reputation.page_outcomes(pages, labels).collect()] == [(1, 1)]


def test_importance_by_brute_force(spark, prose):
    """Ratios, keys and the cut from features counted one document at a time."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)], "doc_id long, quality int")
    n = importance.BUCKETS * importance.CHANNELS
    good, raw, target, each, texts = {i for i in range(0, 120, 2) if i % 3}, np.zeros(n), np.zeros(n), {}, {}
    for r in prose.collect():
        f = importance.features(next(slices(pa.array([r.text]))))[0]
        each[r.doc_id] = f
        texts[r.doc_id] = hashlib.md5(r.text.encode()).hexdigest()
        for x in f.tolist():
            raw[x] += 1
            target[x] += r.doc_id in good
    ratio = np.zeros(n)
    for c in range(importance.CHANNELS):
        span = range(c * importance.BUCKETS, (c + 1) * importance.BUCKETS)
        mass, all_raw, all_target = None, sum(max(raw[i], 0.5) for i in span), sum(target[i] for i in span)
        for i in span:
            mass = max(raw[i], 0.5) / all_raw
            ratio[i] = math.log((target[i] / all_target + importance.SMOOTHING * mass) / (1 + importance.SMOOTHING) / mass)
    keys = {}
    for i, f in each.items():
        u = (int(hashlib.md5(f"0:{i}:{texts[i]}".encode()).hexdigest()[:15], 16) + 0.5) / 2.0**60
        keys[i] = float(sum(ratio[f])) - math.log(-math.log(u))
    k = round(120 * len(good) / 60)
    kept = set(sorted(keys, key=lambda i: -keys[i])[:k])
    rows = importance.resample(prose, labels).collect()
    assert all(r.qc_key == pytest.approx(keys[r.doc_id], rel=1e-4, abs=1e-3) for r in rows)
    assert {r.doc_id for r in rows if r.qc_kept} == kept and {"text", "source"} <= set(prose.columns)
