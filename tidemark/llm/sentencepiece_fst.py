"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into two transducers. The normaliser rewrites characters by the model's normalisation map (a trie; longest match first) and passes
the result through a machine of three states (start, word, space) that writes the dummy prefix and escapes or squeezes white space. The piece transducer is
a trie with an arc for each character and, where a piece ends, an output with a weight; a character that is no piece has a byte-fallback arc. Composing both with
an input gives a lattice over its positions; the result is its shortest path in the tropical semiring (weights add along a path, the least path wins), found
position by position.

For unigram models the weights are minus the pieces' scores. For BPE models piece scores are merge ranks, under which the lightest path isn't
the encoding; there a state of the composition also holds the last piece, and an arc from piece u to v has weight 0 if merging the
text of u and v yields just u and v, else infinity. A sequence of pieces is the BPE encoding of its text exactly if every two neighbours are
compatible in that sense; so each position is reached at weight 0 by one path, with all others at infinity, and the lightest path is the encoding.
Both are compared with the sentencepiece library in the tests.

When no piece holds white space after another character (checked at compile time), no path crosses a word start, and texts are composed word by word with
a bounded cache; other models compose whole texts. Where the map is empty, the normaliser's effect on a whole text is two string replacements; the tests hold them
against the transducer. Decoding runs the inverse: pieces to bytes, unescaping, dummy prefix dropped.

Defined cases: null text is encoded as the empty text (no pieces); repeated rows are encoded alike; a null doc_id is carried;
other columns are ignored; a U+2581 in the text decodes to a space, as in the library, and shows as round_trip false.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_or_empty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


class Trie:
    """Strings as paths of characters from state 0; `output` holds what the string that ends in a state gives."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.output: list[str | None] = [None]

    def add(self, key: str, output: str) -> None:
        state = 0
        for c in key:
            after = self.arcs[state].get(c)
            if after is None:
                after = self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
                self.output.append(None)
            state = after
        self.output[state] = output

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """(end, output) of the longest string that starts at `at`."""
        state, found = 0, None
        for end in range(at, len(text)):
            after = self.arcs[state].get(text[end])
            if after is None:
                break
            state = after
            if (output := self.output[state]) is not None:
                found = (end + 1, output)
        return found


def character_map(data: bytes) -> dict[str, str]:
    """What a model's normalisation map replaces by what: a double-array trie over UTF-8 bytes, then the replacements, each ended by a zero byte."""
    if not data:
        return {}
    size = struct.unpack_from("<I", data)[0]
    units = np.frombuffer(data, "<u4", size // 4, 4)
    texts, found = data[4 + size :], {}
    label, labels = units & np.uint32(0x800000FF), np.arange(1, 256, dtype=np.int64)

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    waiting = [(offset(int(units[0])), b"")]
    while waiting:
        base, key = waiting.pop()
        places = base ^ labels
        inside = places < len(units)
        for c in labels[inside][label[places[inside]] == labels[inside]].tolist():
            unit = int(units[base ^ c])
            below = (base ^ c) ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[(key + bytes([c])).decode()] = texts[start : texts.index(b"\0", start)].decode()
            waiting.append((below, key + bytes([c])))
    return found


class Normaliser:
    """Text to the text that pieces are matched with."""

    def __init__(self, mapped: dict[str, str], prefix: bool, squeeze: bool):
        self.prefix, self.squeeze = prefix, squeeze
        self.rewrite = Trie()
        for key, output in mapped.items():
            self.rewrite.add(key, output)
        # Arcs of the white-space machine: (state, whether the character is a space) to (what comes before it, next state).
        mark = SPACE if prefix else ""
        if squeeze:
            self.arcs = {("start", True): ("", "start"), ("start", False): (mark, "word"), ("word", True): ("", "space"), ("word", False): ("", "word"), ("space", True): ("", "space"), ("space", False): (SPACE, "word")}
        else:
            self.arcs = {("start", True): (mark + SPACE, "word"), ("start", False): (mark, "word"), ("word", True): (SPACE, "word"), ("word", False): ("", "word")}

    def transduce(self, text: str) -> str:
        state, at, out = "start", 0, []
        while at < len(text):
            at, read = self.rewrite.longest(text, at) or (at + 1, text[at])
            for c in read:
                before, state = self.arcs[state, c == " "]
                out.append(before if c == " " else before + c)
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.rewrite.arcs[0]:
            return self.transduce(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", SPACE)


class Transducer:
    def __init__(self, model: bytes, cache_words: int = 400_000):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix = bool(normaliser.get(3, 1))
        self.normalise = Normaliser(character_map(normaliser.get(2, b"")), self.prefix, bool(normaliser.get(4, 1)))
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.encode() for p, _, kind in pieces]
        self.pieces = Trie()
        for p in self.id_of:
            self.pieces.add(p, p)
        self.weight = [0.0 if p is None else -self.score[p] for p in self.pieces.output]
        self.pairs = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}  # no path crosses a pair of characters that is in no piece
        self.fallback_weight = 10 - min(self.score.values(), default=0.0)
        covered = set("".join(self.id_of))
        lone = "".join(re.escape(c) for c in "\n\r\t" if c not in covered)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.words = None if inner else re.compile(f"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache: dict[str, tuple[bytes, int]] = {}
        self.most = cache_words
        self.joins: dict[tuple[str, str], bool] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.rank = {p: -s for p, s in self.score.items() if len(p) > 1}  # order of merging

    def merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Pieces by repeated merging, best score first, then leftmost, and the last two that were merged."""
        parts, score, halves = list(text), self.score, ("", "")
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                break
            halves = parts[at], parts[at + 1]
            parts[at : at + 2] = [halves[0] + halves[1]]
        return parts, halves

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that merge into this one; None if merging its text gives something else."""
        if piece not in self.split:
            parts, halves = self.merged(piece)
            self.split[piece] = halves if parts == [piece] else None
        return self.split[piece]

    def compatible(self, u: str, v: str) -> bool:
        """Whether merging the text of u and v gives just u and v.

        Undoes the merges of u and v from the latest, and asks each time whether a merge over the boundary would have come before.
        """
        key = (u, v)
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) > 1_000_000:
                self.joins.clear()
            known = self.joins[key] = self.halves(v) is not None and (not u or self._apart(u, v))
        return known

    def _apart(self, u: str, v: str) -> bool:
        rank, limit = self.rank, math.inf
        while True:
            over = rank.get(u + v)
            if over is not None and over < limit:
                return False
            left, right = rank.get(u, -1.0), rank.get(v, -1.0)
            if left > right:
                limit, u = left, self.split_of(u)[1]
            elif right < 0:
                return True
            else:
                limit, v = right + 0.5, self.split_of(v)[0]

    def split_of(self, piece: str) -> tuple[str, str]:
        found = self.halves(piece)
        assert found is not None
        return found

    def shortest(self, text: str) -> list[str]:
        """Pieces on the lightest path through the composition of a normalised text with the piece transducer."""
        n, arcs, output, weight, joins = len(text), self.pieces.arcs, self.pieces.output, self.weight, self.joins
        ranked = self.kind == BPE
        cost, last = [0.0] + [math.inf] * n, [""] * (n + 1)
        for start in range(n):
            so_far, before, state, end = cost[start], last[start], 0, start
            while end < n:
                after = arcs[state].get(text[end])
                if after is None:
                    break
                state, end = after, end + 1
                piece = output[state]
                if piece is None or not cost[end]:  # nothing is lighter than 0
                    continue
                if ranked:
                    join = joins.get((before, piece))
                    if self.compatible(before, piece) if join is None else join:
                        cost[end], last[end] = 0.0, piece
                elif so_far + weight[state] < cost[end]:
                    cost[end], last[end] = so_far + weight[state], piece
            lone = text[start]
            if lone not in self.id_of:  # byte fallback, or the unknown piece
                found = (0.0 if self.compatible(before, lone) else math.inf) if ranked else so_far + self.fallback_weight
                if found < cost[start + 1]:
                    cost[start + 1], last[start + 1] = found, lone
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _composed(self, segment: str) -> tuple[bytes, int]:
        """Ids of a segment, cut where no path crosses, so that its parts are found in the cache more often."""
        pairs, parts, start = self.pairs, [], 0
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in pairs:
                parts.append(segment[start:k])
                start = k
        if not parts:
            return self._encoded(segment)
        found = [self._cached(x) for x in (*parts, segment[start:])]
        return b"".join([x for x, _ in found]), sum(n for _, n in found)

    def _cached(self, segment: str, compose: bool = False) -> tuple[bytes, int]:
        found = self.cache.get(segment)
        if found is None:
            found = self._composed(segment) if compose else self._encoded(segment)
            if len(segment) <= 64:
                if len(self.cache) >= self.most:
                    self.cache.clear()
                self.cache[segment] = found
        return found

    def _encoded(self, segment: str) -> tuple[bytes, int]:
        ids: list[int] = []
        fell = 0
        for piece in self.shortest(segment):
            found = self.id_of.get(piece)
            if found is not None:
                ids.append(found)
            elif self.byte_ids:
                data = piece.encode("utf-8", "surrogatepass")
                ids += [self.byte_ids[b] for b in data]
                fell += len(data)
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids), fell

    def encode(self, text: str) -> tuple[bytes, int]:
        """(ids as little-endian unsigned 32-bit, ids that come from byte fallback) of a whole text."""
        normal = self.normalise(text)
        if self.words is None:
            return self._encoded(normal) if normal else (b"", 0)
        parts, fell, cache = [], 0, self.cache
        for segment in self.words.findall(normal):
            found = cache.get(segment) or self._cached(segment, True)
            parts.append(found[0])
            fell += found[1]
        return b"".join(parts), fell

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        data = b"".join([table[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_COMPILED: dict[str, Transducer] = {}


def transducer_for(path: str) -> Transducer:
    """One transducer for each worker process and file; a name without folders is a public tokenizer's."""
    if path not in _COMPILED:
        full = path
        if os.sep not in path:
            import public_tokenizers

            full = public_tokenizers.path(path)
        with open(full, "rb") as f:
            _COMPILED[path] = Transducer(f.read())
    return _COMPILED[path]


def _encode(batches, model: str):
    fst = transducer_for(model)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(ids), 256):
            found = [fst.encode(t) for t in texts[at : at + 256]]
            yield pa.RecordBatch.from_pydict({"doc_id": ids[at : at + 256], "ids": [f[0] for f in found], "n_byte_ids": [f[1] for f in found], "text": texts[at : at + 256]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_byte_ids", pa.int64()), ("text", pa.string())]))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_byte_ids, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_encode, model=model), "doc_id long, ids binary, n_byte_ids long, text string")


def _decode(batches, model: str):
    fst = transducer_for(model)
    for batch in batches:
        texts = [fst.decode(x or b"") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, model=model), "doc_id long, text string")


_DIGEST = [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_byte_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())]


def _digest(batches, model: str):
    fst = transducer_for(model)
    for batch in _encode(batches, model):
        doc, ids, fell, texts = (c.to_pylist() for c in batch.columns)
        back = [fst.decode(x) for x in ids]
        columns = [doc, [len(x) // 4 for x in ids], fell, [zlib.crc32(x) for x in ids], [zlib.crc32(b.encode()) for b in back], [a == b for a, b in zip(texts, back, strict=True)]]
        yield pa.RecordBatch.from_pydict(dict(zip([n for n, _ in _DIGEST], columns, strict=True)), schema=pa.schema(_DIGEST))


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per document: counts and checksums of its ids and of the text decoded from them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_digest, model=model), "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
