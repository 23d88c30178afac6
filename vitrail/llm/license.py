"""License scans by sentence rules.

A text is normalised (lower case, runs of other characters than a-z and 0-9 as one blank) and cut at blank lines, behind full
stops, exclamation and question marks before a blank, and behind a colon at a line's end. Whole lines, or lines that follow one another
without a cut, that make up a known licence sentence become its identifier (the longest sentence first; a list's number before it, and an
address in a paragraph of its own, are allowed), so texts are found however they are wrapped and whatever marks a comment's lines begin
with. The identifiers of a text, in order, are matched against the licence rules in their order: a rule finds its identifiers one
after another (sentences that aren't known may lie between) and uses them up, so a full licence text is taken before
the short references in it. Sentences and rules are in `license_data`.

Only DataFrame functions run, each row where it lies: nothing is shuffled or joined, so no licence, source or group of copies
can grow into one task.

Defined results: a null or empty text has no sentences and no licences. Repeated rows are scanned each for itself. A licence
that is found several times is named once. An empty table gives no rows. Texts of any length are scanned whole. Extra
columns pass through `scan` under their own names. "All rights reserved" says nothing where a licence is found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm import license_data
from vitrail.llm.common import blank_null, fresh
from vitrail.llm.rules import let

STOPS = r"[.!?]+[\x20\x09-\x0D]|:[\x20\x09\x0B-\x0D]*\n"
OTHER = r"[^a-z0-9\n]+"
# Phrases of licences whose colon ends a sentence, or whose point doesn't, and how they are read.
PHRASES = (("conditions: ", "conditions\n\n"), (" v. ", " v "))
#: What may stand before a sentence in a list.
NUMBER = "(?:[0-9a-z] )?"


def normal(sentence: str) -> str:
    """A known sentence as scanned text shows it."""
    return re.sub(OTHER, " ", re.sub(STOPS, " ", sentence).lower()).strip(" ")


KNOWN = {normal(text): name for name, texts in license_data.sentences().items() for text in texts}
RULES = license_data.rules()


def _trie(sentences: list[list[str]], gap: str, address: str) -> str:
    """A pattern of word lists, common beginnings once, longer ones first; `gap` stands between words, `address` before http."""
    heads: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            heads.setdefault(words[0], []).append(words[1:])
    ways = []
    for head, rests in heads.items():
        more = [r for r in rests if r]
        if more:
            inner = "|".join(f"{address if r[0][0] in ('http', 'https') else gap}{_trie(r, gap, address)}" for r in _by_first(more))
            ways.append(f"{head}(?:{inner}){'?' if len(more) < len(rests) else ''}")
        else:
            ways.append(head)
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def _by_first(sentences: list[list[str]]) -> list[list[list[str]]]:
    """Word lists that begin with an address, and the others."""
    apart: tuple[list, list] = ([], [])
    for words in sentences:
        apart[words[0] in ("http", "https")].append(words)
    return [x for x in apart if x]


def wrapped(known: dict[str, str]) -> str:
    """A pattern of known sentences, from a line's begin to a line's end, that may be wrapped between any two words."""
    return rf"(?<![^\n]){NUMBER}({_trie([s.split(' ') for s in known], '[ \n]', '(?: |\n\n?)')})(?![^\n])"


def _without_weak(found: Column) -> Column:
    """Licences found; a reservation of rights alone counts only if nothing else is."""
    return F.when(F.size(found) > 1, F.array_remove(found, license_data.WEAK)).otherwise(found)


def scan(docs: DataFrame, text: str = "text", ids: str = "sentence_ids", licenses: str = "licenses", rules: tuple = RULES, known: dict[str, str] = KNOWN) -> DataFrame:
    """Add the identifiers of a text's licence sentences in order, and its licences in the order of the rules (arrays)."""
    lines, left, found = fresh(docs, "lines", "left", "found")
    # a line end as \n, a cut as two or more
    own = blank_null(text)
    for seen, better in PHRASES:
        own = F.replace(own, F.lit(seen), F.lit(better))
    flat = F.regexp_replace(F.lower(F.regexp_replace(own, STOPS, "\n\n")), OTHER, " ")
    flat = F.btrim(F.regexp_replace(flat, " ?\n ?", "\n"))
    hits = F.transform(F.regexp_extract_all(flat, F.lit(wrapped(known)), F.lit(1)), lambda x: F.regexp_replace(x, r"\n+", " "))
    named = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    out = docs.withColumn(lines, hits).withColumn(ids, F.transform(lines, lambda x: F.element_at(named, x)))
    # identifiers stand between bars: |a||b||c|; a rule's are cut out, leaving what no later rule may run across
    out = out.withColumn(left, F.array_join(F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""))

    def match(state, rule):
        name, sequence = rule["name"], rule["sequence"]
        hit = F.contains(state["left"], sequence)
        return F.struct(
            F.replace(state["left"], sequence, F.lit("#")).alias("left"),
            F.when(hit, F.array_append(state["found"], name)).otherwise(state["found"]).alias("found"),
        )

    told = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("".join(f"|{i}|" for i in seq)).alias("sequence")) for n, seq in rules))
    start = F.struct(F.col(left).alias("left"), F.array().cast("array<string>").alias("found"))
    matched = F.when(F.col(left) == "", F.array().cast("array<string>")).otherwise(let(F.aggregate(told, start, match), lambda s: _without_weak(F.array_distinct(s["found"]))))
    return out.withColumn(found, matched).drop(lines, left).withColumnRenamed(found, licenses)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_known, sentence_ids and licenses (both joined with ';')."""
    own = scan(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return own.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_known"), F.array_join("sentence_ids", ";").alias("sentence_ids"), F.array_join("licenses", ";").alias("licenses"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in KNOWN.items())
    # line ends are doubled, so that each match takes one before and one behind it
    pattern = rf"\n{NUMBER}({_trie([x.split(' ') for x in KNOWN], '(?: |\n\n)', '(?: |\n\n|\n\n\n\n)')})\n"
    own = "coalesce(text, '')"
    for seen, better in PHRASES:
        own = f"replace({own}, '{seen}', '{better.strip()}' || {'chr(10) || chr(10)' if better.endswith(chr(10)) else quoted(' ')})" if not better.startswith(" ") else f"replace({own}, '{seen}', '{better}')"
    steps = []
    for k, (_, seq) in enumerate(RULES):
        sequence = quoted("".join(f"|{i}|" for i in seq))
        steps.append(f"m{k} AS (SELECT *, contains(left{k}, {sequence}) AS hit{k}, replace(left{k}, {sequence}, '#') AS left{k + 1} FROM {'joined' if not k else f'm{k - 1}'})")
    names = ", ".join(f"CASE WHEN hit{k} THEN {quoted(n)} END" for k, (n, _) in enumerate(RULES))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
flat AS (
  SELECT doc_id, chr(10) || replace(trim(regexp_replace(regexp_replace(lower(regexp_replace({own}, '{STOPS}', chr(10) || chr(10), 'g')), '{OTHER}', ' ', 'g'), ' ?\n ?', chr(10), 'g')), chr(10), chr(10) || chr(10)) || chr(10) AS t FROM documents),
lines AS (
  SELECT doc_id, regexp_replace(unnest(l), '\n+', ' ', 'g') AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 1) AS l FROM flat)),
hits AS (SELECT doc_id, count(*) AS n_known, string_agg(id, ';' ORDER BY pos) AS sentence_ids, string_agg('|' || id || '|', '' ORDER BY pos) AS left0
  FROM lines JOIN known ON line = sentence GROUP BY doc_id),
joined AS (SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids, coalesce(left0, '') AS left0 FROM documents d LEFT JOIN hits USING (doc_id)),
{", ".join(steps)},
named AS (SELECT doc_id, n_known, sentence_ids, list_filter([{names}], lambda x: x IS NOT NULL) AS found FROM m{len(RULES) - 1})
SELECT doc_id, n_known, sentence_ids,
  array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i AND (x <> {quoted(license_data.WEAK)} OR len(list_distinct(found)) = 1)), ';') AS licenses FROM named
"""


ORACLE = _oracle()
