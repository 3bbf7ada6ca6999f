"""Fill-in-middle rearrangement of texts, cut at the units of a grammar.

A grammar says which neighbouring characters stay together, as pairs of character classes (left, right). It is translated to a
zero-width regex: there is a boundary between two characters unless one of the pairs holds them. Spark's `split` at boundaries keeps
every character, so a text is the concatenation of its pieces; the empty text, of which `split` makes one empty piece, has none.

A text is split in blocks of BLOCK characters, a long one in BLOCKS longer ones. A boundary depends on the two characters beside it
alone, so a block is read with the character before it, and holds as many first characters of units as it has boundaries. Only these
counts are kept; the two blocks that hold a cut are split once more for its place. So no text becomes an array of its pieces.

Three numbers of a row's key (the first 8-digit groups of the sha256 of `seed:key`) choose the two cuts among 0 to n units, whether
the text stays plain, and the order of parts: prefix-suffix-middle or suffix-prefix-middle. Texts that hold a mark stay plain.

Null texts are empty, empty texts plain with no units; a null key counts as an empty one. Repeated rows are rearranged alike, an
empty table gives an empty result. Other columns pass through; columns of the input that start with `fm_` are replaced.
There is no shuffle and no Python in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK, BLOCKS = 512, 128
#: A letter beyond the basic plane, in any class that means letters: a lookbehind then steps by code points, not by halves of one.
_WIDE = "\U00010400"
_SPACE = r"\x20\x09-\x0D"
#: Grammars by name: pairs of classes whose characters stay together. char: each character is a unit; word: white space goes with the
#: word that follows it; token: runs of letters, of digits and of white space, other characters alone; line: with its line feed.
UNITS: dict[str, tuple[tuple[str, str], ...]] = {
    "char": (),
    "word": ((f"[{_SPACE}]", "."), (f"[^{_SPACE}]", f"[^{_SPACE}]")),
    "token": ((rf"[\p{{L}}\p{{M}}{_WIDE}]", rf"[\p{{L}}\p{{M}}{_WIDE}]"), (r"\p{Nd}", r"\p{Nd}"), (f"[{_SPACE}]", f"[{_SPACE}]")),
    "line": ((r"[^\n]", "."),),
}


def boundary(pairs: tuple[tuple[str, str], ...]) -> str:
    """The zero-width regex of a grammar: between two characters that no pair holds together."""
    return "(?s)(?<=.)(?=.)" + "".join(f"(?!(?<={left})(?={right}))" for left, right in pairs)


def pieces(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """The units of a text, whose concatenation it is; none of the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(pairs), -1))


def _block(text: Column, b: Column, size: Column) -> Column:
    """Block b (from 0) with the character before it; the first has none before it."""
    return F.substr(text, F.greatest(b * size, F.lit(1)), F.when(b == 0, size).otherwise(size + 1))


def _starts(text: Column, b: Column, size: Column, pairs) -> Column:
    """How many units begin in block b: its boundaries, and the start of the text."""
    # The blocks' borders: the character before block b is number b * size (from 1), the first block's characters are 1 to size.
    return F.size(pieces(_block(text, b, size), pairs)) - F.when(b == 0, 0).otherwise(1)


def _place(text: Column, unit: Column, n: Column, ends: Column, size: Column, pairs) -> Column:
    """Where unit number `unit` (from 0) begins, in characters; the end of the text where there are as many units."""
    b = F.array_position(F.transform(ends, lambda e: e > unit), F.lit(True)).cast("int") - 1
    before = F.when(b == 0, 0).otherwise(F.get(ends, b - 1))
    # A later block's first piece belongs to the unit that the character before it is of.
    skipped = (unit - before + F.when(b == 0, 0).otherwise(1)).cast("int")
    found = F.length(F.array_join(F.slice(pieces(_block(text, b, size), pairs), F.lit(1), skipped), ""))
    return F.when(unit >= n, F.length(text)).otherwise(F.greatest(b * size - 1, F.lit(0)) + found)


def rearrange(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs plus fm_units (how many), fm_form (plain, psm, spm), fm_prefix, fm_middle, fm_suffix (null if plain) and fm_output."""
    pairs = UNITS[unit]
    rest = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("fm_")]
    t = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    drawn = docs.select(*rest, t.alias("fm_text"), *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"fm_h{i + 1}") for i in range(4)])
    size = F.greatest(F.lit(BLOCK), F.ceil(F.length("fm_text") / BLOCKS).cast("int"))
    drawn = drawn.withColumn("fm_size", size)
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("fm_text") / F.col("fm_size")) - 1, F.lit(0)).cast("int"))
    counts = F.transform(blocks, lambda b: _starts(F.col("fm_text"), b, F.col("fm_size"), pairs))
    # One text has at most BLOCKS blocks, so adding up by prefixes is cheap.
    drawn = drawn.withColumn("fm_counts", counts).withColumn("fm_ends", F.transform("fm_counts", lambda _, i: F.aggregate(F.slice("fm_counts", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)))
    drawn = drawn.withColumn("fm_units", F.element_at("fm_ends", -1).cast("long"))
    marked = F.greatest(*[F.instr("fm_text", m) for m in (PREFIX, SUFFIX, MIDDLE)]) > 0
    stays = (F.col("fm_text") == "") | marked | (F.col("fm_h3") % 100 >= 100 - plain_percent)
    drawn = drawn.withColumn("fm_form", F.when(stays, "plain").when(F.col("fm_h4") % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = (F.col(h) % (F.col("fm_units") + 1) for h in ("fm_h1", "fm_h2"))
    place = lambda cut: F.when(F.col("fm_form") != "plain", _place(F.col("fm_text"), cut, F.col("fm_units"), F.col("fm_ends"), F.col("fm_size"), pairs))
    cut = drawn.withColumns({"fm_from": place(F.least(first, second)).cast("int"), "fm_to": place(F.greatest(first, second)).cast("int")})
    parts = {
        "fm_prefix": F.substr("fm_text", F.lit(1), F.col("fm_from")),
        "fm_middle": F.substr("fm_text", F.col("fm_from") + 1, F.col("fm_to") - F.col("fm_from")),
        "fm_suffix": F.substr("fm_text", F.col("fm_to") + 1, F.length("fm_text") - F.col("fm_to")),
    }
    p, m, s = (F.col(c) for c in parts)
    output = F.when(F.col("fm_form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).when(F.col("fm_form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    return cut.withColumns(parts).select(*rest, "fm_units", "fm_form", *parts, F.coalesce(output, "fm_text").alias("fm_output"))


def restore(output: Column, form: Column) -> Column:
    """The text that `rearrange` was given. No part holds a mark, nor can a part's end and a mark make another, so marks are where they were put."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = rearrange(docs).withColumn("restored", restore(F.col("fm_output"), F.col("fm_form")))
    chars = [F.length(c).cast("long").alias(f"{c.removeprefix('fm_')}_chars") for c in ("fm_prefix", "fm_middle")]
    return made.select("doc_id", F.col("fm_units").alias("n"), F.col("fm_form").alias("form"), *chars, F.sha2("fm_output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, t, a, b, t[1:a] AS p, t[a + 1:b] AS m, t[b + 1:] AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
