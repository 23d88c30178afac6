"""Control trees inside pictures: a private PNG chunk with a lead, the length of the JSON, and the JSON deflated.

Name and lead of the chunk and the format's name are settings, so that files of another producer are read by naming theirs. What
makes a snapshot valid is a table of rules over its nodes as flat rows.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

from vitrail.sources import png


class Missing(ValueError):
    """The picture is sound but holds no snapshot."""


@dataclass(frozen=True)
class Container:
    """Where a snapshot lies in a picture, and what its JSON calls itself."""

    # The container's own format, and its limits.
    chunk: bytes = b"vtRl"
    lead: bytes = b"VITRAIL\0\x01\x01\x01\x00"
    format: str = "vitrail.capture"
    version: int = 3
    max_json: int = 64 << 20
    max_chunk: int = 16 << 20

    def pack(self, snapshot: dict) -> bytes:
        """The chunk's data for a valid snapshot."""
        validate(snapshot, self)
        text = json.dumps(snapshot, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()
        data = b"".join((self.lead, struct.pack(">I", len(text)), zlib.compress(text, 9)))
        for size, limit in ((len(text), self.max_json), (len(data), self.max_chunk)):
            _need(size <= limit, f"a snapshot of {size} bytes is above the limit of {limit}")
        return data

    def unpack(self, data: bytes) -> dict:
        """The snapshot of a chunk's data; lead, stated length and the stream's end must be right."""
        _need(len(data) <= self.max_chunk, "the chunk is above its limit")
        at = len(self.lead) + 4
        _need(len(data) >= at and data.startswith(self.lead), "this is another format")
        stated = int.from_bytes(data[at - 4 : at], "big")
        _need(stated <= self.max_json, "the stated length is above the limit")
        snapshot = json.loads(_inflate(data[at:], stated))
        _need(isinstance(snapshot, dict), "a snapshot is a JSON object")
        validate(snapshot, self)
        return snapshot


OWN = Container()


def _need(good: bool, why: str) -> None:
    if not good:
        raise ValueError(why)


def _inflate(stream: bytes, size: int) -> str:
    """Exactly `size` bytes of text from a stream that ends with them; no more is ever inflated."""
    work = zlib.decompressobj()
    try:
        text = work.decompress(stream, size + 1)
        whole = len(text) == size and work.eof and not work.unused_data
        _need(whole, "the stream is not of the stated length")
        return text.decode()
    except zlib.error as error:
        raise ValueError("the stream is damaged") from error


def payloads(picture: bytes, of: Container = OWN) -> list[bytes]:
    """Data of a picture's snapshot chunks, their sizes and checksums verified."""
    found = []
    for name, start, length in png.frames(picture):
        if name == of.chunk:
            _need(length <= of.max_chunk, "the chunk is above its limit")
            end = start + length
            _need(zlib.crc32(picture[start - 4 : end]).to_bytes(4, "big") == picture[end : end + 4], "the chunk's checksum is wrong")
            found.append(picture[start:end])
    return found


def read(picture: bytes, of: Container = OWN) -> dict:
    match payloads(picture, of):
        case [data]:
            return of.unpack(data)
        case []:
            raise Missing("no snapshot")
    raise ValueError("several snapshots")


def embed(picture: bytes, snapshot: dict, of: Container = OWN) -> bytes:
    """The picture with this snapshot before its end in place of any other; every other byte is kept."""
    payloads(picture, of)
    kept = (picture[start - 8 : start + length + 4] for name, start, length in png.frames(picture) if name not in (of.chunk, b"IEND"))
    return b"".join((png.SIGNATURE, *kept, png.chunk(of.chunk, of.pack(snapshot)), png.chunk(b"IEND", b"")))


def framed_record(record: bytes) -> tuple[dict, bytes]:
    """A collector's record: length, snapshot as JSON, picture."""
    size = int.from_bytes(record[:4], "big")
    return json.loads(record[4 : 4 + size]), record[4 + size :]


def walk(root: object) -> Iterator[tuple[dict, dict | None, int, int]]:
    """Nodes in preorder with parent, depth and place among the siblings (no recursion)."""
    stack = [(root, None, 0, 0)]
    while stack:
        node, parent, depth, place = stack.pop()
        yield node, parent, depth, place
        children = node.get("children", []) if isinstance(node, dict) else []
        stack += [(c, node, depth + 1, k) for k, c in reversed(list(enumerate(children)))]


# Limits of a tree.
MOST_NODES, MOST_DEPTH = 5000, 64


@dataclass
class Flat:
    """A snapshot as columns: what its rules look at."""

    head: dict
    nodes: list[object]
    depth: int

    @classmethod
    def of(cls, snapshot: dict) -> Flat:
        rows = list(islice(walk(snapshot.get("root")), MOST_NODES + 1))
        return cls(snapshot, [r[0] for r in rows], max(r[2] for r in rows))

    def column(self, name: str) -> list:
        return [n.get(name) for n in self.nodes]

    def rectangles(self) -> Iterator[object]:
        lines = ((n.get("text") or {}).get("lines", []) for n in self.nodes)
        return chain(self.column("bounds"), (r for own in lines for line in own for r in line.get("rectangles", [])))

    def targets(self) -> Iterator[str]:
        return chain.from_iterable(t for n in self.nodes for t in (n.get("relationships") or {}).values())


def rectangle(b: object) -> bool:
    """Four finite numbers (no truth values), the sizes not negative."""
    if not isinstance(b, (list, tuple)) or len(b) != 4:
        return False
    return all(type(v) in (int, float) and math.isfinite(v) for v in b) and min(b[2:]) >= 0


def _size(image: object) -> bool:
    size = image.get("size") if isinstance(image, dict) else None
    return isinstance(size, list) and [type(v) is int and v > 0 for v in size] == [True, True] and image.get("coordinate_space") == "image-pixels"


#: What must hold, in the order of the tests; a rule may rely on those before it.
RULES: tuple[tuple[str, Callable[[Flat, Container], bool]], ...] = (
    ("unknown format or version", lambda f, of: (f.head.get("format"), f.head.get("version")) == (of.format, of.version)),
    ("the picture's size or coordinates are not described", lambda f, of: _size(f.head.get("image"))),
    ("too many nodes", lambda f, of: len(f.nodes) <= MOST_NODES),
    ("too deep a tree", lambda f, of: f.depth <= MOST_DEPTH),
    ("a node is no object", lambda f, of: all(isinstance(n, dict) for n in f.nodes)),
    ("ids must be texts of their own", lambda f, of: all(isinstance(i, str) for i in f.column("id")) and len(set(f.column("id"))) == len(f.nodes)),
    ("roles must be texts", lambda f, of: all(isinstance(r, str) for r in f.column("role"))),
    ("a rectangle is wrong", lambda f, of: all(map(rectangle, f.rectangles()))),
    ("a relationship leads nowhere", lambda f, of: set(f.targets()) <= set(f.column("id"))),
)

#: What the strict schema requires.
STRICT_ENVELOPE = ("format", "version", "source", "image", "root", "native", "capture_policy", "warnings")
STRICT_NODE = ("id", "role", "bounds", "states", "relationships", "children", "text", "value")
STRICT: tuple[tuple[str, Callable[[Flat, Container], bool]], ...] = (
    ("the envelope lacks a field", lambda f, of: set(STRICT_ENVELOPE) <= set(f.head)),
    ("a node lacks a field", lambda f, of: all(set(STRICT_NODE) <= set(n) for n in f.nodes)),
    ("a value needs the status 'value'", lambda f, of: all(("value" in v) == (v.get("status") == "value") for v in f.column("value"))),
)


def faults(snapshot: dict, of: Container = OWN, strict: bool = False) -> Iterator[str]:
    """The first rule that a snapshot breaks, if any (later ones may depend on it)."""
    flat = Flat.of(snapshot)
    return (why for why, holds in (*RULES, *(STRICT if strict else ())) if not holds(flat, of))


def validate(snapshot: dict, of: Container = OWN, strict: bool = False) -> None:
    if why := next(faults(snapshot, of, strict), None):
        raise ValueError(why)
