"""Byte-level BPE over Arrow batches: encoding with offsets, and decoding back to bytes.

The merges are the tokenizers library's. A rank file lists tokens without their merges, so a merge is stated for every
split of a token into two tokens, in the order of ranks: the library then joins the same pairs in the same order as a
rank-driven encoder. A text is cut into pieces that cannot influence one another, and each worker keeps the ids
of the pieces it has met in a table of bounded size; so a common word is merged once, not once for each occurrence. Vocabularies
for which that isn't known to hold (another pattern, a normaliser, another pre-tokenizer) are given whole texts.

Offsets are character spans [first, last): tokens are mapped to bytes by the byte table, and bytes to characters. A character that is
split between tokens belongs to each of them.

Defined results: a null text counts as empty, an empty text has no ids, repeated rows are encoded alike, texts of any
length are encoded whole, an empty table gives no rows, and extra columns pass through untouched under their own names; a new
column whose name is taken is refused.
"""

from __future__ import annotations

import base64
import json
import re
import weakref
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from vitrail.llm.common import fresh, short_batches

#: White space as the pattern of the rank files sees it (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
#: A run of other characters with at most one blank before it, or white space: no token crosses their borders.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# The splitting pattern, and the pre-tokenizer with the same one built in, for which that is so.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Pieces in one worker's table; at the bound it is emptied and fills anew.
CACHE_PIECES = 600_000
#: A piece of which the pattern makes one or two matches whatever the Unicode version: letters, then punctuation.
PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!#-&(-/:-@\[-`{-~]*)")
#: Pieces longer than this are not kept.
LONG_PIECE = 64


def byte_to_char() -> list[str]:
    """The character that stands for each byte: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


BYTE_CHARS = byte_to_char()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}
_SHOWN = str.maketrans({chr(b): c for b, c in enumerate(BYTE_CHARS)})


def shown(raw: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return raw.decode("latin-1") if raw.isascii() and raw.isalnum() else raw.decode("latin-1").translate(_SHOWN)


def hidden(chars: str) -> bytes:
    """The reverse of `shown`."""
    return bytes(CHAR_BYTES[c] for c in chars)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizer of the tokenizers library that encodes as the rank file at `path` demands."""
    ranks = read_ranks(path)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    model = models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


#: The vocabularies in this worker, each with its table of pieces (met).
CODECS: weakref.WeakSet = weakref.WeakSet()


def forget_pieces() -> None:
    """Empty the worker's tables of pieces: for a worker that goes on to work without them, as it may live as long as the session."""
    for held in [*CODECS]:
        held.met.clear()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str | None) -> Codec:
    return Codec(path, pattern)


class Codec:
    """One vocabulary in one worker: the tokenizer, its byte table and the pieces met so far.

    pattern: the splitting pattern of a rank file; None for a file of the tokenizers library.
    """

    def __init__(self, path: str, pattern: str | None):
        if pattern is None:
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
        else:
            self.tokenizer = from_ranks(path, pattern)
        self.in_pieces = self._cuts_at_blanks(pattern)
        vocab = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.table[i] = token.encode() if token in special else hidden(token)
        self.lengths = np.array([len(x) for x in self.table], np.int32)
        self.model = self.tokenizer.model
        self.met: dict[str, bytes] = {}
        CODECS.add(self)

    def _cuts_at_blanks(self, pattern: str | None) -> bool:
        """Whether PIECES are known to be independent for this vocabulary."""
        told = settings(self.tokenizer)
        if told["normalizer"] is not None or told["model"]["type"] != "BPE" or told["model"].get("dropout"):
            return False
        if any(t["lstrip"] or t["rstrip"] or not t["special"] for t in told["added_tokens"]):
            return False
        return pattern == SPLIT or (pattern is None and PRE_TOKENIZER.items() <= told["pre_tokenizer"].items())

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        if plain := PLAIN.fullmatch(piece):
            ids = [t.id for part in plain.groups() if part for t in self.model.tokenize(shown(part.encode()))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self.met) >= CACHE_PIECES:
                self.met.clear()
            self.met[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not self.in_pieces:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        met, piece = self.met.get, self._piece
        return b"".join([met(p) or piece(p) for p in PIECES.findall(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; a character split between tokens comes together again."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """For each token the byte just after it."""
        return np.cumsum(self.lengths[ids], dtype=np.int64)


def char_bounds(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of tokens with these byte ends.

    A character split between tokens belongs to each of them: a token starts at the character that holds its first
    byte and ends behind the one that holds its last byte.
    """
    begun = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    return begun[np.minimum(starts + 1, len(raw))] - 1 if len(ends) else ends, begun[ends]


def decode_stream(parts: Iterator[bytes]) -> Iterator[str]:
    """Text of byte parts as they come; an unfinished character waits for its other bytes."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield decoder.decode(part)
    yield decoder.decode(b"", True)


def _refuse_clash(given: list[str], new: list[str]) -> None:
    if clash := {c.lower() for c in given} & {k.lower() for k in new}:
        raise ValueError(f"columns {sorted(clash)} exist already; name the new ones otherwise")


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], dict]], fields: dict[str, str]) -> DataFrame:
    """Add the columns `fields` (name: type) made from batches of texts.

    make: called in the worker; gives a function of a batch's texts (null as empty) that returns Arrow arrays by name.
    Only plain Arrow batches pass between the JVM and Python, a batch at a time.
    """
    short_batches(df.sparkSession)
    given = [*df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work([x or "" for x in batch.column(given.index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[k] for k in fields)], names=[*given, *fields])

    _refuse_clash(given, [*fields])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{k}` {v}" for k, v in fields.items())])
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str | None, text: str = "text", ids: str = "ids", offsets: str | None = None, decoded: str | None = None, spans: str | None = None) -> DataFrame:
    """Add the ids of each text as packed little-endian unsigned 32-bit integers (binary).

    offsets: names a column array<struct<first, last>> with each token's character span. spans: the same, packed as the ids are.
    decoded: names a binary column with the bytes that the ids decode to.
    """

    def make() -> Callable[[list[str]], dict]:
        own = codec(path, pattern)

        def work(texts: list[str]) -> dict:
            packed = [own.encode(t) for t in texts]
            made = {ids: pa.array(packed, pa.binary())}
            if decoded:
                made[decoded] = pa.array([own.decode(np.frombuffer(p, "<u4")) for p in packed], pa.binary())
            if offsets or spans:
                found = [char_bounds(t.encode(), own.byte_ends(np.frombuffer(p, "<u4"))) for t, p in zip(texts, packed)]
            if offsets:
                struct = pa.StructArray.from_arrays([pa.array(np.concatenate([s[k] for s in found] or [[]]).astype(np.int32)) for k in (0, 1)], ["first", "last"])
                made[offsets] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s[0]) for s in found)]), pa.int32()), struct)
            if spans:
                made[spans] = pa.array([np.column_stack(s).astype("<u4").tobytes() for s in found], pa.binary())
            return made

        return work

    kinds = {ids: "binary"} | ({decoded: "binary"} if decoded else {}) | ({spans: "binary"} if spans else {}) | ({offsets: "array<struct<first:int,last:int>>"} if offsets else {})
    return map_texts(df, text, make, kinds)


def decode(df: DataFrame, path: str, pattern: str | None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids decode to. Null ids decode to no bytes."""
    given = [*df.columns]
    _refuse_clash(given, [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(given.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*given, out])

    short_batches(df.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` binary"])
    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of its ids, their digest, that of the decoded bytes, and that of the tokens' character spans."""
    ids, decoded, spans = fresh(df, "ids", "decoded", "spans")
    made = encode(df.select(doc_id, text), path, pattern, text, ids, decoded=decoded, spans=spans)
    return made.select(
        F.col(doc_id),
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
        F.sha2(F.col(spans), 256).alias("offsets_sha256"),
    )


def settings(tokenizer: Tokenizer) -> dict:
    """The tokenizer's own description, for tests and reports."""
    return json.loads(tokenizer.to_str())
