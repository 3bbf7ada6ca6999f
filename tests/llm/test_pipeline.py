"""The pipeline's stages: columns, and that each decision takes effect."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs, found = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, data).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        found.append((name, before, docs))
    return found


def test_columns(stages):
    assert [name for name, _, _ in stages] == ["quality", "lines", "near_duplicates", "mixture", "pack"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_rejects_junk(stages, spark, data):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{data}/labels.parquet").groupBy("doc_id").min("quality").toDF("doc_id", "q")
    share = lambda df, q: df.join(labels, "doc_id").filter(f"q = {q}").count() / before.join(labels, "doc_id").filter(f"q = {q}").count()
    assert share(after, 1) > 0.9 and share(after, 0) < 0.5


def test_lines_leave_documents(stages):
    _, before, after = stages[1]
    assert before.count() == after.count()
    old, new = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
    keys = {}
    for i, t in old.items():
        for line in t.split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r")
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            if len(k) >= 20:
                keys.setdefault(k, set()).add(i)
    gone = {(k, i) for k, docs in keys.items() if len(docs) >= 3 for i in docs if i != max(docs)}
    for i, t in old.items():
        left = [x for x in t.split("\n") if ("".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")), i) not in gone]
        assert new[i] == "\n".join(left)


def test_one_of_each_group_stays(stages):
    from tidemark.llm import simhash

    _, before, after = stages[2]
    groups = {r.nd_component for r in simhash.near_duplicates(before).collect()}
    assert {r.doc_id for r in after.collect()} == groups


def test_no_pair_of_similar_texts_stays(spark):
    """Against all pairs by brute force: one of each group linked by five-word Jaccard similarity of 0.8 or more."""
    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    sets, parent = {}, {}
    for r in docs.select("doc_id", "text").collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id], parent[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}, r.doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = sorted(sets, key=lambda i: len(sets[i]))
    for n, a in enumerate(by):
        for b in by[n + 1 :]:
            if len(sets[a]) < 0.8 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    kept = [r.doc_id for r in cp.near_duplicates(spark, docs, where).select("doc_id").collect()]
    assert sorted(kept) == sorted({root(i) for i in sets})


def test_mixture_repeats_documents(stages):
    from tidemark.llm import mixing

    _, before, after = stages[3]
    want = {r.doc_id: r.mix_copies for r in mixing.mix(before).collect() if r.mix_copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_all_is_packed(stages):
    _, before, after = stages[4]
    assert after.filter("bp_piece = 0").count() == before.count()


def test_run_leaves_only_its_result(spark, data, tmp_path, monkeypatch):
    for module in ("tidemark.llm.runtime", "corpus_pipeline"):
        monkeypatch.setattr(f"{module}.shared_dir", lambda _: f"file://{tmp_path}")
    assert cp.run(spark, data).count() > 0
    assert len(list((tmp_path / "tidemark").iterdir())) == 1


def test_stages_take_awkward_tables(spark, data, odd, empty, tmp_path):
    for n, table in enumerate((odd.select("doc_id", "text", "lang", "source", "n_chars"), empty)):
        docs, ids = table, {r.doc_id for r in table.collect()}
        for name, stage in cp.STAGES:
            path = str(tmp_path / f"{n}-{name}")
            stage(spark, docs, data).write.parquet(path)
            docs = spark.read.parquet(path)
            now = {r.doc_id for r in docs.select("doc_id").collect()}
            assert now <= ids
            ids = now
        assert docs.count() >= len(ids) and (n == 0) == bool(ids)


def test_planted_near_copies_are_caught(spark, data):
    """Copies with a few changed words go, all but one; other documents stay."""
    import random

    rng = random.Random(11)
    words = [f"{a}{b}" for a in "ba ke li mo nu pa re si to vu".split() for b in "dan fer gul hist jom".split()] * 2
    rows, near = [], 0
    for i in range(60):
        base = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(80, 200))]
        rows.append((i, " ".join(base), "en", "s", 0))
        for c in range(i % 3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // 90)):
                copy[at] = "changed"
            near += 1
            rows.append((1000 + 10 * i + c, " ".join(copy), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, data).collect()}
    assert set(range(60)) <= kept and len([i for i in kept if i >= 1000]) <= 0.02 * near
