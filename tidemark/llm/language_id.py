"""Language identification by compression: the zstandard raw-content dictionary that shortens a text most names its language.

The dictionaries are built from a bounded sample: per language at most SAMPLE_DOCS different labelled texts, those with the
smallest hashes of id and text; of one that is longer than SAMPLE_CHARS characters a slice of so many enters, from a place that its
hash chooses. They are cut to DICT_BYTES in all. Every whole text is then compressed with every language's dictionary.

Null text and texts without a letter: `und`, score 0. Ties go to the language with more labelled documents, then by name.
Texts whose margin over the second language is narrow are marked li_rejected (the best guess stays in li_lang).
No labelled rows: every text is `und`. Repeated rows are predicted alike; an empty table gives an empty result. Other columns
pass through; columns of the input that start with `li_` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import HASH_BITS, hash_place

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 250, 8192, 256 << 10
LEVEL = 6
#: A best size of more than this share of the second best is a narrow margin.
NARROW = 0.97
#: What is compressed: lower case, everything of ASCII but letters taken as space, spaces collapsed.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of labelled documents. What reaches the driver is bounded by the sample."""
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    place = hash_place(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    usable = usable.select(F.col(lang).alias("l"), F.col(text).alias("t"), place.alias("p"))
    n = {r["l"]: r for r in usable.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("p").alias("d")).collect()}
    if not n:
        return []
    # About twice the sample is below the limit; repeated rows, which share a place, are one.
    limit = F.element_at(F.create_map(*[F.lit(x) for name, r in n.items() for x in (name, int(2**HASH_BITS * min(1.0, 2 * sample_docs / max(r["d"], 1))))]), F.col("l"))
    start = F.pmod("p", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = usable.filter(F.col("p") < limit).groupBy("l", "p").agg(F.min(F.substr("t", start, F.lit(SAMPLE_CHARS))).alias("t")).collect()
    out = []
    for name in sorted(n, key=lambda x: (-n[x]["n"], x)):
        texts = [plain(r["t"]) for r in sorted((r for r in rows if r["l"] == name), key=lambda r: r["p"])[:sample_docs]]
        out.append((name, b"\n".join(reversed(texts))[-DICT_BYTES:]))
    return out


class Compressors:
    """Each dictionary made ready once a task."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names = [name for name, _ in dictionaries]
        self.all = []
        for _, raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.all.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool, int | None]:
        """Language, score (how much shorter the best is than all, 0 to 1), rejected, bytes of the best."""
        if not self.all or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True, None
        raw = plain(text)
        sizes = [len(c.compress(raw)) for c in self.all]
        best = min(range(len(sizes)), key=lambda i: sizes[i])
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best] + 64)
        score = 1 / sum(2.0 ** max(-60, sizes[best] - s) for s in sizes)
        return self.names[best], score, sizes[best] > NARROW * rest, sizes[best]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) plus li_lang, li_score, li_rejected, li_bytes."""
    names = [c for c in (docs.columns if keep is None else keep) if not c.startswith("li_")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "li_lang string, li_score double, li_rejected boolean, li_bytes long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Compressors(dictionaries)
        for b in batches:
            found = [known.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*names, "li_lang", "li_score", "li_rejected", "li_bytes"])

    return docs.select(*names, F.col(text).alias("li_text")).mapInArrow(run, schema)


def fold(key: Column, folds: int, number: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == number, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 4, 2))
    out = identify(docs, learn(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull())), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"), F.col("li_rejected").alias("rejected"))
