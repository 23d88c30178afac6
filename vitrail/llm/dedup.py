"""Exact deduplication: two-pass Bloom filtering, so that only rows with a possible copy are shuffled.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. In the first pass each row sets its pattern, two
bits of one word, in a blocked filter wide enough that different texts seldom share one. Patterns are 8-byte numbers; copies of one in a
task are summed before they move, and those that were set twice or more make the filter of the second pass, which is therefore as
large as the number of repeated texts and not of rows. In the second pass a row whose bits are not all in that filter has no copy
and goes straight through; the others meet on the SHA-256 of their normalised text, which decides exactly.

The filter's words are broadcast as dense arrays, in slices of SLICE_WORDS where they are more: rows are then read once for each slice,
and no row moves for the probe, however large the filter is.

Only DataFrame functions run: no Python on the executors.

Defined results: a null text counts as empty, and empty texts are copies of one another. Of equal texts the row with the
most code points in its original text stays, then the one with the smallest doc_id; a null doc_id loses to any
other. Of rows alike in text and doc_id but not in other columns, `drop_copies` keeps the largest by the hash of the row's JSON, whatever
the order of arrival; of rows alike in all of this (repeated rows) one stays. Texts of any length are hashed whole. An empty table gives
no rows. Extra columns are ignored by `decisions` and kept by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm.common import attach_groups, blank_null, broadcast_in_slices, files_for, fresh, materialize

BLANKS = r"[\x20\x09-\x0D]+"
#: Patterns of the first pass for each row, at least: so many times fewer rows share one with another text.
PATTERNS_PER_ROW = 128
#: Bits of the second pass's filter for each repeated pattern, at least.
BITS_PER_KEY = 16
#: Words (8 bytes each) that lie in one row of the filter, and that may be broadcast at once.
BLOCK = 256
SLICE_WORDS = 16 << 20


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(blank_null(text), BLANKS, "")


def _pattern(key: Column, rows: int) -> Column:
    """The number of a key's pattern, of at least PATTERNS_PER_ROW times as many as there are rows."""
    bits = min(62, max(12, (rows * PATTERNS_PER_ROW).bit_length()))
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _place(pattern: Column, words: int) -> tuple[Column, Column, Column]:
    """Where a pattern lies in a filter of so many words: block, word in the block, and its two bits as a mask."""
    h = F.xxhash64(pattern)
    at = h.bitwiseAND(F.lit(words - 1))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftright(at, BLOCK.bit_length() - 1), at.bitwiseAND(F.lit(BLOCK - 1)).cast("int"), bit(58).bitwiseOR(bit(52))


def repeated(keys: DataFrame, key: str, rows: int) -> DataFrame:
    """First pass: the patterns that two rows or more set (one column, pattern)."""
    return keys.select(_pattern(F.col(key), rows).alias("pattern")).groupBy("pattern").count().where("count > 1").select("pattern")


def filter_words(patterns: DataFrame) -> tuple[DataFrame, int]:
    """The second pass's filter of repeated patterns (block, words: a dense array), and its number of words."""
    words = max(BLOCK, 1 << (patterns.count() * BITS_PER_KEY // 64).bit_length())
    block, word, mask = _place(F.col("pattern"), words)
    held = patterns.groupBy(block.alias("block"), word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    given = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda k: F.coalesce(F.element_at("given", k), F.lit(0).cast("bigint")))
    return held.groupBy("block").agg(given.alias("given")).select("block", dense.alias("words")), words


def probe(df: DataFrame, patterns: DataFrame, key: str, rows: int, out: str, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Second pass: add the boolean `out`, true where another row may have the same key.

    patterns: made by `repeated`, materialised.
    """
    held, words = filter_words(patterns)
    held = materialize(held, "dedup-filter")
    block, word, mask = _place(_pattern(F.col(key), rows), words)
    b, w, m, bits = fresh(df, "block", "word", "mask", "words")
    side = held.select(F.col("block").alias(b), F.col("words").alias(bits))
    placed = df.withColumns({b: block, w: word, m: mask})
    met = broadcast_in_slices(placed, side, b, max(1, slice_words // BLOCK))
    return met.withColumn(out, F.coalesce(F.get(F.col(bits), F.col(w)).bitwiseAND(F.col(m)) == F.col(m), F.lit(False))).drop(b, w, m, bits)


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = materialize(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            F.char_length(blank_null(text)).alias("points"),
            F.sha2(normalised(text), 256).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-keys",
    )
    rows = narrow.count()
    patterns = materialize(repeated(narrow, "sha", rows), "dedup-patterns")
    probed = probe(narrow, patterns, "sha", rows, "possible", slice_words)
    single = probed.where("not possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    shared = materialize(probed.where("possible").drop("possible"), "dedup-possible")
    # the largest (points, -doc_id, -row): nulls are smallest, so a null id loses
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("id"), (-F.col("row")).alias("row")))
    groups = materialize(shared.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size")), "dedup-groups")
    met = attach_groups(shared, groups, "sha", "group_size", rows)
    return single.unionByName(
        met.select("doc_id", (-F.col("best.id")).alias("keep_id"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents without copies, in their own columns.

    Rows without a possible copy pass where they are; the others are shuffled whole, one for each text and task at most.
    """
    sha, points, possible, row = fresh(docs, "sha", "points", "possible", "row")
    keyed = docs.withColumn(sha, F.sha2(normalised(text), 256)).withColumn(points, F.char_length(blank_null(text)))
    keys = materialize(keyed.select(F.col(sha).alias("sha")), "dedup-keys")
    rows = keys.count()
    patterns = materialize(repeated(keys, "sha", rows), "dedup-patterns", files=files_for(rows))
    probed = probe(keyed, patterns, sha, rows, possible, slice_words)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = F.max_by(whole, F.struct(points, -F.col(doc_id).cast("bigint"), F.xxhash64(F.to_json(whole))))
    kept = probed.where(F.col(possible)).groupBy(sha).agg(best.alias(row)).select(f"{row}.*")
    return probed.where(~F.col(possible)).select(docs.columns).unionByName(kept)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY sha) AS group_size,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM r
"""
