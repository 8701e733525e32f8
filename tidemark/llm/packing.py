"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each scan task streams its documents once. A document longer than the window is cut into full windows
and a tail; a tail of s tokens goes to the fill level h (0 is a new window) for which the sum over levels
of squared counts of partially filled windows grows least, ties to the fullest level. The counts are kept in
one level array. While more than max_open windows are partially filled, and for what is still open when a task ends, the fullest window is closed with
tokens cut from the emptiest; a task's last remainder is emitted as windows of power-of-two lengths. So no window has padding. No shuffle takes place; memory is bounded by
max_open windows and one Arrow batch of texts.

Defined cases: null or empty text is one end token; repeated rows are packed once each; a null doc_id is
carried as null; no rows give no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import text_or_empty

WINDOW = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Latin letters of one code point, then up to eight marks that form one pre-token and belong to no contraction.
_SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?#*$%&|()\[\]-]{0,8})")


def _byte_letters() -> dict[int, str]:
    """Byte-level spelling of Latin letters: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in plain)
    letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTE_LETTERS = _byte_letters()


#: Words on which a tokenizer is tried when it is loaded.
PROBES = ("the", "Internationalisation", "straße", "ÉCLAIR,", "naïve...", "don't", "O'Neill's", "x1y2", "2024", "co-op", "(see)", "end.\"", "#tag", "a|b", "$$$", "日本語", "😀", "Ω", "ŉ", "zzzzzzzzqqqq", "it's?!")


class WordTokenizer:
    """Token ids of whole texts, as little-endian uint32 bytes, through a bounded cache of words.

    Words are cached only for tokenizers that drop white space and never join across it, and letters are merged directly only where
    the whole tokenizer does the same; PROBES decide both when a tokenizer is loaded. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.most = Tokenizer.from_file(path), {}, cache_words
        self.merges, self.tails = self.tokenizer.model, {}
        self.by_word = self.ids(" \t\n".join(["", *PROBES, ""])) == b"".join(map(self.ids, PROBES)) == self.ids(" ".join(PROBES))
        self.by_merges = True
        try:
            self.encode([" ".join(PROBES)])
            self.by_merges = all(self.cache[p.encode()] == self.ids(p) for p in PROBES)
        except Exception:  # a model of another kind, whose merges can't be asked for
            self.by_merges = False
        self.cache.clear()
        self.tails.clear()

    def learn(self, word: bytes) -> None:
        """Cache a word's ids: letters with trailing punctuation by the merges alone, anything else by the whole tokenizer."""
        own, text = self.cache, word.decode()
        simple = _SIMPLE.fullmatch(text) if self.by_merges and len(text) < 200 else None
        if simple is None:
            own[word] = self.ids(text)
            return
        stem = simple[1].lower()
        key = stem.encode()
        ids = own.get(key)
        if ids is None:
            found = self.merges.tokenize(stem if stem.isascii() else stem.translate(_BYTE_LETTERS))
            ids = own[key] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        tail = simple[2]
        if tail and tail not in self.tails:
            self.tails[tail] = self.ids(tail)
        own[word] = ids + self.tails[tail] if tail else ids

    def ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.ids(t) for t in texts]
        split = [t.encode().split() for t in texts]
        missing = list(set().union(*split) - self.cache.keys())
        own = self.cache
        if missing:
            if len(own) + len(missing) > self.most:
                own.clear()
                missing = list(set().union(*split))
            for word in missing:
                self.learn(word)
        return [b"".join(map(own.__getitem__, words)) for words in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file; a name without folders is a public tokenizer's."""
    if path not in _TOKENIZERS:
        full = path
        if os.sep not in path:
            import public_tokenizers

            full = public_tokenizers.path(path)
        _TOKENIZERS[path] = WordTokenizer(full)
    return _TOKENIZERS[path]


class SumOfSquares:
    """Windows of one task. A piece is [doc_id, start, id bytes, doc_tokens]."""

    def __init__(self, window: int = WINDOW, max_open: int = 1024):
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.counts = np.zeros(window + 1, np.int32)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.full: list[list] = []

    def level_for(self, size: int) -> int:
        n, top = self.counts, self.window - size
        grows = 2 * (n[size:] - n[: top + 1]) + 2
        grows[n[: top + 1] == 0] = np.iinfo(np.int32).max
        grows[0] = 2 * n[size] + 1 if top else 0
        if top and n[top]:
            grows[top] = 1 - 2 * n[top]
        return top - int(np.argmin(grows[::-1]))

    def add(self, doc_id, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        whole = total // w * w
        for at in range(0, whole, w):
            self.full.append([[doc_id, at, ids[4 * at : 4 * (at + w)], total]])
        if size := total - whole:
            self.place([doc_id, whole, ids[4 * whole :], total], size)

    def place(self, piece: list, size: int) -> None:
        level = self.level_for(size)
        if level:
            bin_ = self.levels[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
            bin_.append(piece)
        else:
            bin_ = [piece]
        if level + size == self.window:
            self.full.append(bin_)
            return
        self.levels[level + size].append(bin_)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.close_fullest()

    def _open(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.levels[level].pop()

    def close_fullest(self) -> None:
        """Fill the fullest open window with tokens cut from the emptiest; needs two open windows."""
        used = np.flatnonzero(self.counts)
        least, most = int(used[0]), int(used[-1])
        bin_, giver = self._open(most), self._open(least)
        room = min(self.window - most, least)
        kept, level = least - room, most + room
        while room:
            head, rest = cut(giver.pop(), room)
            bin_.append(head)
            room -= len(head[2]) // 4
            if rest:
                giver.append(rest)
        if level == self.window:
            self.full.append(bin_)
        for window, held in ((giver, kept), (bin_, level if level < self.window else 0)):
            if held:
                self.levels[held].append(window)
                self.counts[held] += 1
                self.n_open += 1

    def settle(self) -> None:
        """Close every open window without padding."""
        while self.n_open > 1:
            self.close_fullest()
        if not self.n_open:
            return
        left = self._open(int(np.flatnonzero(self.counts)[0]))
        left.reverse()
        while left:
            size = sum(len(p[2]) for p in left) // 4
            size = 1 << (size.bit_length() - 1)
            out = []
            while size:
                head, rest = cut(left.pop(), size)
                out.append(head)
                size -= len(head[2]) // 4
                if rest:
                    left.append(rest)
            self.full.append(out)

    def take(self) -> list[list]:
        done, self.full = self.full, []
        return done


def cut(piece: list, size: int) -> tuple[list, list | None]:
    if len(piece[2]) <= 4 * size:
        return piece, None
    doc_id, start, ids, total = piece
    return [doc_id, start, ids[: 4 * size], total], [doc_id, start + size, ids[4 * size :], total]


def rows_of(windows: list[list], first_sequence: int) -> dict[str, list]:
    out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
    for n, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            for name, value in zip(out, (doc_id, start, length, zlib.crc32(ids), total, first_sequence + n, offset), strict=True):
                out[name].append(value)
            offset += length
    return out


def pack_batches(batches: Iterable[pa.RecordBatch], tokenizer: str, window: int, end_id: int, max_open: int, task: int) -> Iterator[pa.RecordBatch]:
    encoder, packer, end = tokenizer_for(tokenizer), SumOfSquares(window, max_open), struct.pack("<I", end_id)
    sequence = task << 40
    schema = pa.schema([(k.split()[0], pa.int64()) for k in PIECES.split(", ")])

    def emit():
        nonlocal sequence
        done = packer.take()
        if done:
            yield pa.RecordBatch.from_pydict(rows_of(done, sequence), schema=schema)
            sequence += len(done)

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(ids), 256):
            for doc_id, data in zip(ids[at : at + 256], encoder.encode(texts[at : at + 256]), strict=True):
                packer.add(doc_id, data + end)
            yield from emit()
    packer.settle()
    yield from emit()


def _task(batches, **settings):
    from pyspark import TaskContext

    yield from pack_batches(batches, task=TaskContext.get().partitionId(), **settings)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID, max_open: int = 1024) -> DataFrame:
    """Pieces of all documents: which token range of which document lies where in which sequence."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_task, tokenizer=tokenizer, window=window, end_id=end_id, max_open=max_open), PIECES)
