"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and pairs of neighbouring words of every document are hashed into buckets. Two smoothed multinomials over the buckets are
counted: one over all documents (raw), one over the trusted ones (those labelled good). A document's score is the sum of
log(trusted / raw) over its n-grams, divided by their number; below the threshold it is rejected. Bucket weights are whole
millionths, so sums and verdicts don't depend on the order of rows. The number of buckets grows with the root of the corpus's bytes, as
a vocabulary does: PER_ROOT times the root, at least LEAST_BUCKETS.

Only DataFrame functions run: no Python on the executors. Counting explodes n-grams and sums them by bucket before the
shuffle, so one row for each task and bucket moves at most; scoring reads each row once where it lies and moves nothing. Trusted
ids are broadcast, in slices where there are more than BROADCAST_IDS, so that no text moves for them either.

Defined results: a null text has no words, lines or symbols. Fewer words than `min_words`, or more than `max_repeat` per cent of
words in repeated windows, fails the base rules; so an empty text is rejected. Windows are compared by 64-bit hashes of
their words. A text without n-grams scores 0. Null and repeated ids in the trusted table count once; a null doc_id is
never trusted. Repeated rows get equal results. An empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm.common import blank_null, broadcast_in_slices, materialize

BLANK_CHARS = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
LEAST_BUCKETS = 1 << 14
#: Buckets for each unit of the root of the corpus's bytes.
PER_ROOT = 2
#: Trusted n-grams added to each bucket; the raw multinomial gets as many for its own size, so that a bucket with few
#: n-grams says little for or against a text, in a small corpus as well.
SMOOTHING = 30.0
#: Millionths of the mean log-likelihood ratio (natural logarithm) below which a document is rejected.
THRESHOLD = -60_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
#: Trusted ids that are broadcast at once.
BROADCAST_IDS = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: str | Column) -> Column:
    body = F.btrim(blank_null(text), F.lit(BLANK_CHARS))
    return F.when(F.octet_length(body) > 0, F.split(body, BLANKS)).otherwise(F.array().cast("array<string>"))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(BLANK_CHARS))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _covered(hashes: Column, window: int) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def places(ordered: Column) -> Column:
        at = lambda k: F.get(ordered, k)["h"]
        same = lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    def total(pos: Column) -> Column:
        own = F.transform(pos, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(pos, k + 1) - p, F.lit(window))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, places), total)


def _repeated_words(words: Column, window: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    covered = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, window)))
    return F.when(F.size(words) > window, covered).otherwise(F.lit(0))


def base_counts(words: Column, text: str | Column) -> dict[str, Column]:
    """The base counts of a text, given its words: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint)."""
    body = blank_null(text)
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.octet_length(body) - F.octet_length(F.regexp_replace(body, SYMBOLS, "")),
        "n_dup_lines": _duplicate_lines(body),
        "n_repeat_words": _repeated_words(words, WINDOW),
    }
    return {k: v.cast("bigint") for k, v in counts.items()}


def base_failed(n_words: Column, n_repeat_words: Column, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat * n_words)


def buckets_of(docs: DataFrame, text: str = "text") -> int:
    """Buckets for a corpus: a power of two."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << (PER_ROOT * math.isqrt(size)).bit_length())


def _bucket(buckets: int, *of: Column) -> Column:
    return F.xxhash64(*of).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _counts(texts: DataFrame, buckets: int, out: str) -> DataFrame:
    """N-grams of a table of words by bucket: bucket, `out`."""
    each = texts.select("words", F.posexplode("words").alias("at", "word"))
    following = F.get("words", F.col("at") + 1)
    grams = each.select(F.explode(F.array(_bucket(buckets, F.col("word")), F.when(following.isNotNull(), _bucket(buckets, F.col("word"), following)))).alias("bucket"))
    return grams.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(out))


def weights(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", most_ids: int = BROADCAST_IDS, buckets: int | None = None) -> list[int]:
    """Millionths of log(trusted / raw) of each bucket, counted over every document.

    trusted: ids of the trusted documents (column doc_id). Raw n-grams are counted without a join; the trusted documents
    are found by their ids before their words are cut.
    """
    buckets = buckets or buckets_of(docs, text)
    ids = materialize(trusted.select(F.col("doc_id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct(), "rules-trusted")
    own = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    good_docs = broadcast_in_slices(own, ids, "id", most_ids, "left_semi")
    raws = _counts(own.select(words_of("text").alias("words")), buckets, "raw")
    goods = _counts(good_docs.select(words_of("text").alias("words")), buckets, "good")
    raw_of, good_of = ({r[0]: r[1] for r in t.collect()} for t in (raws, goods))  # as many rows as buckets at most
    good, raw = sum(good_of.values()), sum(raw_of.values())
    if not good:
        return [0] * buckets  # nothing is trusted: no evidence against any text
    of = lambda g, r: round(1e6 * math.log((g + SMOOTHING) / (r * good / raw + SMOOTHING)))
    return [of(good_of.get(b, 0), raw_of.get(b, 0)) for b in range(buckets)]


def ratio(words: Column, table: list[int]) -> Column:
    """The mean log-likelihood ratio of the words' n-grams, in millionths (summed whole, then divided)."""
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into one literal
    buckets = len(table)

    def of(word: Column, k: Column) -> Column:
        following = F.get(words, k + 1)
        return F.get(held, _bucket(buckets, word)) + F.when(following.isNull(), F.lit(0)).otherwise(F.get(held, _bucket(buckets, word, following)))

    total = F.aggregate(F.transform(words, of), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return total / F.greatest(2 * F.size(words) - 1, F.lit(1))


def judge(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and ratio (mean log-likelihood ratio)."""
    table = weights(docs, trusted, doc_id, text)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # all of a row's figures come from one binding of its words, which no plan can tear apart
    found = let(words_of("text"), lambda w: F.struct(*(v.alias(k) for k, v in base_counts(w, "text").items()), ratio(w, table).alias("ratio")))
    told = own.withColumn("found", found).select("doc_id", "found.*")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    kept = ~failed & (F.col("ratio") >= threshold)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), (F.col("ratio") / 1e6).alias("ratio"))


def keep_clean(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents that pass the base rules and the ratio, in their own columns; nothing is shuffled."""
    table = weights(docs, trusted, doc_id, text)
    passed = let(words_of(text), lambda w: ~base_failed(F.size(w), _repeated_words(w, WINDOW)) & (ratio(w, table) >= threshold))
    return docs.where(passed)
