"""Token counts by offset-mapped attribution.

A document is encoded whole, once, and its tokens' character spans are interval-joined with the spans of its sections: fields of a record
laid end to end, or a text's lines. A character that is split between tokens belongs to each of them. A token that crosses a border
goes where the rule says:

* start: to the section with its first character;
* end: to the section with its last character;
* most: to the section that holds most of its characters, the earlier one if equal.

So the counts of a document's sections add up to the count of its tokens, whatever the rule.

Defined results: a null text (or field) counts as empty. Sections without tokens count 0; an empty text is one section
without tokens. A section's line end belongs to it. Repeated rows are counted each for itself. An empty table gives no
rows; a list of no fields is refused. Texts of any length are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm.bpe import Codec, char_bounds, codec, map_texts
from vitrail.llm.common import short_batches

RULES = ("start", "end", "most")


def attribute(first: np.ndarray, last: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section, from the tokens' spans [first, last) and the ends of the sections, which cover the text without gaps.

    section_ends may repeat (empty sections).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sections = len(section_ends)
    if not len(first):
        return np.zeros(sections, np.int64)
    # the section that holds character c is the first whose end lies behind c
    holds = lambda c: np.minimum(np.searchsorted(section_ends, c, side="right"), sections - 1)
    if rule == "start":
        own = holds(first)
    elif rule == "end":
        own = holds(np.maximum(last - 1, first))
    else:
        own, end = holds(first), holds(np.maximum(last - 1, first))
        begins = np.concatenate([[0], section_ends[:-1]])
        for k in np.flatnonzero(own != end):
            at = np.arange(own[k], end[k] + 1)
            shared = np.minimum(section_ends[at], last[k]) - np.maximum(begins[at], first[k])
            own[k] = at[int(shared.argmax())]
    return np.bincount(own, minlength=sections)


def line_ends(text: str) -> np.ndarray:
    """Characters up to each line's end; each line holds its line end."""
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    return np.cumsum(sizes if sizes[-1] or len(sizes) == 1 else sizes[:-1])


def spans(own: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [first, last) of the tokens of a whole text."""
    return char_bounds(text.encode(), own.byte_ends(np.frombuffer(own.encode(text), "<u4")))


def by_line(docs: DataFrame, path: str, pattern: str | None = None, rule: str = "start", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: doc_id, section (from 0), first_char, n_chars, n_tokens."""

    def make() -> Callable[[list[str]], dict]:
        own = codec(path, pattern)

        def work(texts: list[str]) -> dict:
            columns: list[list[np.ndarray]] = [[], [], []]
            for t in texts:
                ends = line_ends(t)
                begins = np.concatenate([[0], ends[:-1]])
                for c, v in zip(columns, (begins, ends - begins, attribute(*spans(own, t), ends, rule))):
                    c.append(v)
            flat = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in columns]
            counts = np.cumsum([0, *map(len, columns[0])])
            struct = pa.StructArray.from_arrays(flat, ["first_char", "n_chars", "n_tokens"])
            return {"sections": pa.ListArray.from_arrays(pa.array(counts, pa.int32()), struct)}

        return work

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    made = map_texts(narrow, "text", make, {"sections": "array<struct<first_char:bigint,n_chars:bigint,n_tokens:bigint>>"})
    return made.select("doc_id", F.posexplode("sections").alias("section", "s")).select("doc_id", "section", "s.first_char", "s.n_chars", "s.n_tokens")


def by_field(docs: DataFrame, fields: list[str], path: str, pattern: str | None = None, rule: str = "start", doc_id: str = "doc_id", between: str = "\n") -> DataFrame:
    """One row per document and field: doc_id, field, n_tokens.

    The fields are laid end to end with `between` behind each but the last (it counts to the field before) and encoded as
    one text, as a model would see them.
    """
    if not fields:
        raise ValueError("name one field at least")
    short_batches(docs.sparkSession)
    said = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    sizes = F.array(*(F.char_length(said(f)) for f in fields))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.concat_ws(between, *map(said, fields)).alias("text"), sizes.alias("sizes"))

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            counts = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ends = np.cumsum([x + len(between) for x in s])
                ends[-1] -= len(between)
                counts.append(attribute(*spans(own, t), ends, rule).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "counts"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    made = narrow.mapInArrow(run, f"doc_id {kind}, counts array<bigint>")
    names = F.array(*(F.lit(f) for f in fields))
    return made.select("doc_id", F.posexplode("counts").alias("k", "n_tokens")).select("doc_id", F.element_at(names, F.col("k") + 1).alias("field"), "n_tokens")
