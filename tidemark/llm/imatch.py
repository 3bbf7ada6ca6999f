"""I-Match fingerprints, DataFrame functions only.

A text's terms are its distinct lower-cased words, as 64-bit hashes. The lexicon keeps the terms whose document frequency, counted
over all documents, lies in a band: at least `least` documents and at most the share `most` of them. Rare terms are mostly noise,
frequent ones say little. A text's terms within the lexicon are sorted, and each of LEVELS x SUBSETS randomised lexicon subsets
hashes those it holds, so a text has as many hashes (16 bits each, 0 where it has no term of the subset). A text without a term in
the lexicon uses all its terms. Equal texts have equal fingerprints; texts without words have all hashes 0.

Subsets of a level hold a term with a probability of 1/32, 1/128, 1/512 and 1/2048: a hash survives an edit only if none of the
subset's terms comes or goes, so long texts are compared by the sparse levels, short ones by the dense. `likeness` of two fingerprints
is the share of equal hashes at the sparsest level of which at least half of the subsets have a term in either.

Frequencies are counted by 2^TERM_BITS values of the terms' hashes, whatever the vocabulary, so the lexicon is a bitmap of 512 KB that
reaches each task as a scalar subquery: no join, and no shuffle but that of the counts. Terms that share a value share its frequency.

`with_next` gives each document the one that follows. Documents are dealt by ranges of (key, hash of text) to blocks of about ROWS,
at most BLOCKS of them: quantiles of the key cut ranges, which are divided evenly, by the hash where a single key fills them. Each
block also receives the first document of the next, so whole texts are shuffled once, and no task sees more than a block.

Null texts are empty; null keys come last; rows that share a key follow each other by hash of text, and repeated rows each other.
A single document follows itself; an empty table gives an empty result. Other columns pass through; columns of the input that start
with `im_` are replaced.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

TERM_BITS = 22
LEVELS, SUBSETS = (5, 7, 9, 11), 32
LEAST, MOST = 2, 1 / 16
ROWS, BLOCKS, CELLS = 512, 1 << 16, 256
#: Stands for a null key, which comes last.
LAST = (1 << 63) - 2


def _bits(x: Column, start: int, width: int) -> Column:
    return F.shiftright(x, start).bitwiseAND(F.lit((1 << width) - 1))


def terms(text: Column) -> Column:
    """The hashes of the distinct words, in no order."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+")), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _draw(t: Column, level: int, start: int = 0, width: int | None = None) -> Column:
    """The number that a term draws at a level, or some bits of it: bits of its hash above the lexicon's. Below SUBSETS it is a subset's."""
    return _bits(t, TERM_BITS + sum(LEVELS[:level]) + start, LEVELS[level] - start if width is None else width)


def _is_drawn(level: int):
    return lambda t: _draw(t, level) < SUBSETS


def _dealt(level: int) -> Column:
    """The terms of a level by subset, in two steps of a quarter and an eighth: fewer looks at each term than a filter for each subset."""
    low = SUBSETS.bit_length() - 3
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    quarters = F.transform(numbers(4), lambda a: F.filter(f"im_{level}", lambda t: _draw(t, level, low) == a))
    return F.flatten(F.transform(quarters, lambda q: F.transform(numbers(1 << low), lambda b: F.filter(q, lambda t: _draw(t, level, 0, low) == b))))


def learn_lexicon(docs: DataFrame, text: str = "text", least: int = LEAST, most: float = MOST) -> DataFrame:
    """One row: im_lexicon, an array of 64-bit words with a bit for each value of terms' hashes within the band."""
    seen = docs.select(F.explode(terms(F.col(text))).alias("t")).select(_bits(F.col("t"), 0, TERM_BITS).alias("t"))
    ceiling = max(least, most * docs.count())
    kept = seen.groupBy("t").agg(F.count("*").alias("df")).filter(F.col("df").between(least, ceiling))
    words = kept.groupBy(F.shiftright("t", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t").bitwiseAND(63).cast("int"))).alias("b"))
    # Of fixed size: a row for each 64-bit word of the bitmap.
    dense = docs.sparkSession.range(1 << (TERM_BITS - 6)).withColumnRenamed("id", "w").join(words, "w", "left")
    whole = dense.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("all"))
    return materialize(whole.select(F.transform("all", lambda x: x["b"]).alias("im_lexicon")))


def fingerprint(df: DataFrame, lexicon: DataFrame, text: str = "text", name: str = "im_print") -> DataFrame:
    """df plus the array of hashes of a text column. The steps are columns of their own, so none is computed twice."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    df = df.select(*rest, F.sort_array(terms(F.coalesce(F.col(text), F.lit("")))).alias("im_terms"), lexicon.scalar().alias("im_lexicon"))
    known = F.filter("im_terms", lambda t: F.getbit(F.get("im_lexicon", _bits(t, 6, TERM_BITS - 6).cast("int")), t.bitwiseAND(63).cast("int")) == 1)
    df = df.select(*rest, "im_terms", known.alias("im_known")).select(*rest, F.when(F.size("im_known") > 0, F.col("im_known")).otherwise(F.col("im_terms")).alias("im_kept"))
    held = [F.filter("im_kept", _is_drawn(level)).alias(f"im_{level}") for level in range(len(LEVELS))]
    df = df.select(*rest, *held)
    of = lambda g: F.when(F.size(g) > 0, F.pmod(F.xxhash64(g), F.lit(65535)) + 1).otherwise(0).cast("int")
    # A column that is used twice stays a column: a filter would else be run anew for each subset.
    hashes = [F.when(F.size(f"im_{level}") > 0, F.transform(_dealt(level), of)).otherwise(F.array_repeat(F.lit(0), SUBSETS)) for level in range(len(LEVELS))]
    return df.select(*rest, F.concat(*hashes).alias(name))


def as_text(fingerprint: Column) -> Column:
    """Four hexadecimal digits a hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; equal fingerprints give 1."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    out = F.lit(None).cast("double")
    for level in range(len(LEVELS)):
        some = F.filter(F.slice(pairs, level * SUBSETS + 1, SUBSETS), lambda p: (p["a"] > 0) | (p["b"] > 0))
        share = F.size(F.filter(some, lambda p: p["a"] == p["b"])) / F.greatest(F.size(some), F.lit(1))
        enough = F.size(some) >= (SUBSETS // 2 if level else 0)
        out = F.when(enough, share).otherwise(out)
    return F.when(a == b, 1.0).otherwise(out)


def _place(df: DataFrame, rows: int) -> DataFrame:
    """df (im_id, im_tie) plus im_block: blocks are ranges of (im_id, im_tie) in order."""
    stats = df.agg(F.count("*").alias("n"), F.percentile_approx("im_id", [i / CELLS for i in range(CELLS)], 100 * CELLS).alias("q")).first()
    if not stats["n"]:
        return df.withColumn("im_block", F.lit(0).cast("long"))
    rows = max(rows, ceil(stats["n"] / BLOCKS))
    slots: dict[int, int] = {}
    for q in stats["q"]:
        slots[q] = slots.get(q, 0) + 1
    # A key that fills more than one quantile has a range of its own.
    cells = sorted({*slots, *(q + 1 for q, n in slots.items() if n > 1 and q < LAST)})
    widths = [b - a for a, b in zip(cells, [*cells[1:], cells[-1] + max(1, (cells[-1] - cells[0]) // CELLS)], strict=True)]
    pieces = [max(1, ceil(max(slots.get(q, 1), 1) * stats["n"] / CELLS / rows)) for q in cells]
    bases = [sum(pieces[:i]) for i in range(len(pieces))]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    cell = F.greatest(F.size(F.filter(longs(cells), lambda q: q <= F.col("im_id"))) - 1, F.lit(0))
    df = df.withColumn("im_cell", cell)
    low, width, piece, base = (F.get(longs(xs), F.col("im_cell")) for xs in (cells, widths, pieces, bases))
    # The hash is the fraction after the key: rows of one key are spread by it.
    into = (F.col("im_id").cast("decimal(20,0)") - low.cast("decimal(20,0)")).cast("double") + (F.col("im_tie").cast("double") / 2.0**64 + 0.5)
    part = F.least(F.greatest(F.floor(into / width.cast("double") * piece.cast("double")), F.lit(0)), piece - 1)
    return df.withColumn("im_block", (base + part).cast("long")).drop("im_cell")


def with_next(docs: DataFrame, key: str, carried: dict[str, str], text: str = "text", rows: int = ROWS) -> DataFrame:
    """docs plus columns of the next document by ascending key (the first, after the last): carried maps new names to columns."""
    rest = docs.columns
    docs = docs.withColumns({"im_id": F.coalesce(F.col(key).cast("long"), F.lit(LAST)), "im_tie": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    placed = _place(docs, rows)
    firsts = placed.groupBy("im_block").agg(F.min(F.struct("im_id", "im_tie")).alias("f"))
    # At most BLOCKS + 2 * CELLS rows.
    whole, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("im_block")
    firsts = firsts.select("f.*", F.coalesce(F.lag("im_block").over(order), F.max("im_block").over(whole)).alias("im_former"))
    homes = F.when(F.col("im_former").isNull(), F.array(F.struct(F.lit(0).alias("guest"), F.col("im_block").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("guest"), F.col("im_block").alias("block")), F.struct(F.lit(1).alias("guest"), F.col("im_former").alias("block")))
    )
    dealt = placed.join(F.broadcast(firsts), ["im_id", "im_tie"], "left").select(*[F.col(f"`{c}`") for c in rest], "im_id", "im_tie", F.explode(homes).alias("im_home"))
    w = Window.partitionBy("im_home.block").orderBy("im_home.guest", "im_id", "im_tie")
    return dealt.withColumns({new: F.lead(F.col(old)).over(w) for new, old in carried.items()}).filter("im_home.guest = 0").drop("im_id", "im_tie", "im_home")


def edited(text: Column, following: Column) -> Column:
    """The text whose last half is replaced by as much of the start of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs plus im_print, im_edited (text), im_edited_print, im_next_print."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("im_")])
    lexicon = learn_lexicon(docs, text)
    printed = fingerprint(docs.withColumn("im_text", F.coalesce(F.col(text), F.lit(""))), lexicon, "im_text")
    paired = with_next(printed, key, {"im_next": "im_text", "im_next_print": "im_print"}, "im_text")
    return fingerprint(paired.withColumn("im_edited", edited(F.col("im_text"), F.col("im_next"))).drop("im_next", "im_text"), lexicon, "im_edited", "im_edited_print")


def op13_imatch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = compare_with_next(docs)
    return found.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2("im_edited", 256).alias("edited_sha256"), as_text(F.col("im_print")).alias("fingerprint"), as_text(F.col("im_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("im_print"), F.col("im_edited_print")).alias("near_edited"), likeness(F.col("im_print"), F.col("im_next_print")).alias("near_next"),
    )
