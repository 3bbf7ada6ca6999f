"""Quality rules by weak supervision: rules vote or abstain, EM estimates how each votes on good and bad texts.

Each document's features give one vote a rule: 1 good, -1 bad, 0 abstain. Documents are counted by vote pattern (at most
3 ** len(RULES) patterns, whatever the corpus), EM runs on those counts, and a document's verdict is its pattern's posterior.

Rules are ratios, which hold for texts of every size, and variety is counted in windows of SPAN words. Two still know short texts:
`stops` can vote bad beyond about 50 words only, and `variety` falls with length up to SPAN words.

Null text: no words, fails the base rules; every ratio over nothing abstains. Null doc_id: judged like any other. Repeated rows
are judged alike; an empty table gives an empty result. Very long texts are measured whole, in one piece each. Other columns
of the input don't pass; `judge` returns the key and columns that start with `qr_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize
from .textbytes import Texts, mix, slices

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_bars", "n_stops", "n_distinct", "n_marked"]
WINDOW = 5
#: Distinct words are counted within consecutive windows of so many words, over the whole text, so that variety does not fall with length.
SPAN = 500
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True


def _first_of(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a hash stands for the first time in its row (rows ascend), in order."""
    key = mix(h + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return first


def _repeated(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    key = mix(h + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def features(t: Texts) -> list[np.ndarray]:
    """The FEATURES of each row of a slice."""
    data, offsets = t.data, t.offsets
    starts, ends, first = t.words()
    n_words = np.diff(first)

    def per_row(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])

    def per_row_of(at: np.ndarray, flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[at])

    word_rows = np.repeat(np.arange(t.n), n_words)
    inside = np.zeros(len(data) + 1, np.int32)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    in_word = np.cumsum(inside[:-1]) > 0
    h = t.span_hashes(starts, ends)
    covered = np.zeros(len(h), np.int64)
    if len(h) >= WINDOW:
        ok = word_rows[: len(h) - WINDOW + 1] == word_rows[WINDOW - 1 :]
        w = h[: len(h) - WINDOW + 1].copy()
        for i in range(1, WINDOW):
            w = mix(w) + h[i : len(h) - WINDOW + 1 + i]
        at = np.flatnonzero(ok)
        again = at[_repeated(word_rows[at], w[at])]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.subtract.at(edge, again + WINDOW, 1)
        covered = np.cumsum(edge[:-1]) > 0
    ls, le, lf = t.lines()
    word_before = np.concatenate([[0], np.cumsum(in_word)])
    full = word_before[le] > word_before[ls]
    line_rows = np.repeat(np.arange(t.n), np.diff(lf))
    lines = np.flatnonzero(full)
    dup = np.zeros(len(ls), bool)
    dup[lines] = ~_first_of(line_rows[lines], t.span_hashes(ls[lines], le[lines]))
    # A number for each row's window of SPAN words.
    spans = word_rows * (1 << 32) + (np.arange(len(h)) - first[word_rows]) // SPAN
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    single = (ends - starts) == 1
    return [
        n_words, per_row(in_word & ((data & 0xC0) != 0x80)), per_row(_SYMBOL[data]), per_row_of(lf, dup), per_row_of(first, covered), np.diff(lf),
        per_row(_UPPER[data]), per_row(_LETTER[data]), per_row(data == ord("!")), per_row_of(first, single & (last == ord("|"))),
        per_row_of(first, (last == ord(".")) | (last == ord("!")) | (last == ord("?"))), per_row_of(first, _first_of(spans, h)), per_row_of(first, ~single & _SYMBOL[last]),
    ]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, qr_<feature>...) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(1)):
                ids = b.column(0).slice(t.row, t.n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in features(t))], [key, *(f"qr_{f}" for f in FEATURES)])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"qr_{f} long" for f in FEATURES))


def _f(name: str) -> Column:
    return F.col(f"qr_{name}").cast("double")


def _vote(bad: Column, good: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1).otherwise(0), F.lit(0))


def rules() -> dict[str, Column]:
    """The rules' votes; a ratio over nothing is null, and null abstains."""
    words = F.when(_f("n_words") > 0, _f("n_words"))
    letters = F.when(_f("n_letters") > 0, _f("n_letters"))
    symbols, mean_word, caps = _f("n_symbols") / words, _f("word_chars") / words, _f("n_upper") / letters
    repeats, dups, kinds = _f("n_repeat_words") / words, _f("n_dup_lines") / _f("n_lines"), _f("n_distinct") / words
    bangs, bars, stops = _f("n_bangs") / words, _f("n_bars") / words, _f("n_stops") / words
    return {
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "word_length": _vote((mean_word < 2) | (mean_word > 15), mean_word.between(3, 10)),
        "capitals": _vote(caps > 0.4, caps < 0.15),
        "repeats": _vote(repeats > 0.15, repeats < 0.02),
        "dup_lines": _vote(dups > 0.3, dups == 0),
        "variety": _vote(kinds < 0.25, kinds > 0.35),
        "exclaims": _vote(bangs > 0.2, bangs < 0.05),
        "bars": _vote(bars > 0.1, bars == 0),
        "marks": _vote(_f("n_marked") / words > 0.2, _f("n_marked") / words < 0.02),
        "stops": _vote((_f("n_stops") + 0.5) / words < 0.01, stops > 0.01),
    }


def votes(measured: DataFrame) -> DataFrame:
    """Adds qr_votes, the pattern of votes as a string of -, 0 and +."""
    sign = [F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in rules().values()]
    return measured.withColumn("qr_votes", F.concat(*sign))


def fit(patterns: dict[str, int], rounds: int = 200, bad_share: float = 0.1, false_alarm: float = 0.01, catch: float = 0.2, silent: float = 0.2, belief: float = 0.01) -> dict[str, float]:
    """EM over pattern counts: each pattern's posterior probability of being good.

    Every rule's shares of bad votes, abstentions and good votes are estimated, on good and on bad texts. Before any data a rule
    is believed to vote bad on `false_alarm` of the good and `catch` of the bad texts and to abstain on `silent` of both, and
    `bad_share` of texts to be bad; that belief weighs as much as `belief` of all texts (a Dirichlet prior) and gives way to
    what the votes show: a rule that often votes bad where all others vote good is found to be noisy and isn't followed.
    """
    if not patterns:
        return {}
    names, n = list(patterns), np.array(list(patterns.values()), float)
    v = np.array([["-0+".index(c) for c in p] for p in names])
    hot, weight = np.eye(3)[v], belief * n.sum() + 1
    good_prior, bad_prior = (np.array([x, silent, 1 - silent - x]) for x in (false_alarm, catch))
    good, bad = (np.tile(x, (v.shape[1], 1)) for x in (good_prior, bad_prior))
    share = bad_share
    for _ in range(rounds):
        lg = np.log(1 - share) + (hot * np.log(good)).sum((1, 2))
        lb = np.log(share) + (hot * np.log(bad)).sum((1, 2))
        p = 1 / (1 + np.exp(np.clip(lb - lg, -700, 700)))
        wg, wb = n * p, n * (1 - p)
        share = (wb.sum() + weight * bad_share) / (n.sum() + weight)
        good = ((hot * wg[:, None, None]).sum(0) + weight * good_prior) / (wg.sum() + weight)
        bad = ((hot * wb[:, None, None]).sum(0) + weight * bad_prior) / (wb.sum() + weight)
    return dict(zip(names, p.tolist(), strict=True))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, qr_<feature>..., qr_votes, qr_good, qr_kept): the posterior that the text is good, and whether it is `least` at least."""
    voted = materialize(votes(measure(docs, key, text)))
    # At most 3 ** 10 patterns reach the driver.
    patterns = {r["qr_votes"]: r["n"] for r in voted.groupBy("qr_votes").agg(F.count("*").alias("n")).collect()}
    posterior = fit(dict(sorted(patterns.items())))
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "qr_votes string, qr_good double")
    return voted.join(F.broadcast(table), "qr_votes", "left").withColumn("qr_kept", F.col("qr_good") >= least)


def op9_weak_supervision(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("qr_n_words") < 10) | (100 * F.col("qr_n_repeat_words") > 20 * F.col("qr_n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"qr_{c}").alias(c) for c in base], failed.alias("base_failed"), (~failed & F.col("qr_kept")).alias("kept"), F.col("qr_good").alias("p_good"), F.col("qr_votes").alias("votes"))
