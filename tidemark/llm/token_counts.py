"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves are pre-tokens with their length and token count; inner nodes hold sums, so the token count of any range and the leaf at any
offset take logarithmic time. An edit re-encodes only the region it touches: from the first pre-token whose match could have
looked at the edited text (two characters of look-ahead) to the first old boundary behind the edit at which new and old boundaries meet
again; from there on equal text gives equal pre-tokens. The new pre-tokens become a subtree in the place of the first old leaf, the other
old leaves become empty, and sums are updated upwards.

Token ids come from a public byte-level BPE vocabulary; counts of pre-tokens are cached, within a bound. Work on an edit is in proportion to what it touches.

Defined cases: null or empty text has no tokens, and edits on it insert; edits beyond the end are clipped; repeated rows are counted alike; a null
doc_id is carried; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_or_empty


class Counter:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, ranks_path: str, cache_size: int = 500_000):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, int] = {}
        self.most = cache_size

    def size(self, token: str) -> int:
        found = self.cache.get(token)
        if found is None:
            found = len(self.encoding.encode_ordinary(token))
            if len(token) <= 64:
                if len(self.cache) >= self.most:
                    self.cache.clear()
                self.cache[token] = found
        return found

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of each pre-token."""
        tokens = self.pattern.findall(text)
        sizes = list(map(self.cache.get, tokens))
        if None in sizes:
            sizes = [self.size(t) if n is None else n for t, n in zip(tokens, sizes, strict=True)]
        return np.fromiter(map(len, tokens), np.int64, len(tokens)), np.array(sizes, np.int64)


class Tree:
    """Segment tree in levels: level 0 is the leaves, each level above sums pairs. A leaf may hold a tree."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.levels = [np.stack([chars, tokens], axis=1) if len(chars) else np.zeros((1, 2), np.int64)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            if len(below) % 2:
                below = np.concatenate([below, np.zeros((1, 2), np.int64)])
                self.levels[-1] = below
            self.levels.append(below[::2] + below[1::2])
        self.inner: dict[int, Tree] = {}

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character offset below `chars`."""
        at = start = 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            left = int(level[at, 0])
            if offset - start >= left:
                start += left
                at += 1
        return at, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        change = np.array([chars, tokens]) - self.levels[0][leaf]
        for level in self.levels:
            level[leaf] += change
            leaf >>= 1

    def boundary_at_or_after(self, offset: int) -> int:
        """The first pre-token boundary that is not before offset."""
        if offset >= self.chars:
            return self.chars
        if offset <= 0:
            return 0
        leaf, start = self.find(offset)
        if start == offset:
            return start
        if leaf in self.inner:
            return start + self.inner[leaf].boundary_at_or_after(offset - start)
        return start + int(self.levels[0][leaf, 0])

    def start_of(self, offset: int) -> int:
        """Start of the pre-token that holds a character."""
        leaf, start = self.find(offset)
        return start + self.inner[leaf].start_of(offset - start) if leaf in self.inner else start

    def tokens_before(self, offset: int) -> int:
        """Tokens of all pre-tokens before a boundary."""
        if offset >= self.chars:
            return self.tokens
        total = at = start = 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            if offset - start >= int(level[at, 0]):
                start += int(level[at, 0])
                total += int(level[at, 1])
                at += 1
        return total + (self.inner[at].tokens_before(offset - start) if at in self.inner else 0)

    def splice(self, first: int, last: int, new: Tree) -> None:
        """Put new in the place of the pre-tokens between two boundaries; an empty range inserts before `first`."""
        if first >= self.chars and not self.chars:
            self.inner[0] = new
            self.set(0, new.chars, new.tokens)
            return
        leaf, start = self.find(min(first, self.chars - 1))
        width = int(self.levels[0][leaf, 0])
        inside = start < first or last < start + width or first == last
        if inside and last <= start + width:
            own = self.inner.get(leaf)
            if own is None:  # a boundary at this leaf's edge: keep the leaf, put new beside it
                size = self.levels[0][leaf].copy()
                parts = [(new.chars, new.tokens), tuple(size)] if first == start else [tuple(size), (new.chars, new.tokens)]
                own = self.inner[leaf] = Tree(*np.array(parts, np.int64).T)
                own.inner[0 if first == start else 1] = new
            else:
                own.splice(first - start, last - start, new)
            self.set(leaf, own.chars, own.tokens)
            return
        if start < first:  # the range starts inside this leaf's subtree and leaves it
            own = self.inner[leaf]
            own.splice(first - start, width, new)
            self.set(leaf, own.chars, own.tokens)
            self._drop(start + own.chars, last - first - (start + width - first))
            return
        self.inner[leaf] = new
        self.set(leaf, new.chars, new.tokens)
        self._drop(start + new.chars, last - start - width)

    def _drop(self, at: int, size: int) -> None:
        """Empty the pre-tokens in `size` characters behind a boundary."""
        while size > 0:
            leaf, start = self.find(at)
            width = int(self.levels[0][leaf, 0])
            if start == at and width <= size:
                self.inner.pop(leaf, None)
                self.set(leaf, 0, 0)
                size -= width
                continue
            own = self.inner[leaf]
            part = min(size, start + width - at)
            own._drop(at - start, part)
            self.set(leaf, own.chars, own.tokens)
            size -= part


class Document:
    """A text with its tree; `encoded` counts the pre-tokens encoded by edits."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        self.tree = Tree(*counter.split(text))

    def edit(self, start: int, removed: int, inserted: str) -> None:
        old, tree = self.text, self.tree
        start = max(0, min(start, len(old)))
        end = min(len(old), start + max(0, removed))
        self.text = text = old[:start] + inserted + old[end:]
        # A match has looked at two characters behind its end at most (a run of spaces before a word, a contraction).
        first = tree.start_of(max(0, start - 2)) if old else 0
        shift = len(text) - len(old)
        at, chars, tokens, meet = first, [], [], None
        while at < len(text):
            if at >= start + len(inserted) and tree.boundary_at_or_after(at - shift) == at - shift and at - shift >= end:
                meet = at - shift
                break
            token = self.counter.pattern.match(text, at).group()
            chars.append(len(token))
            tokens.append(self.counter.size(token))
            at += len(token)
        self.encoded += len(chars)
        tree.splice(first, len(old) if meet is None else meet, Tree(np.array(chars, np.int64), np.array(tokens, np.int64)))


_COUNTERS: dict[str, Counter] = {}


def counter_for(path: str) -> Counter:
    if path not in _COUNTERS:
        full = path
        if os.sep not in path:
            import public_tokenizers

            full = public_tokenizers.path(path)
        _COUNTERS[path] = Counter(full)
    return _COUNTERS[path]


def sample_edits(text: str, n: int) -> list[tuple[int, int, str]]:
    """n edits (offset, characters removed, text inserted), a fixed function of the text."""
    state, out, size = zlib.crc32(text.encode()) or 1, [], len(text)
    for k in range(n):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        at = state % (size + 1)
        removed = (0, 7, 40)[k % 3]
        inserted = text[at // 2 : at // 2 + 12] if k % 3 != 2 else ""
        out.append((at, removed, inserted))
        size += len(inserted) - min(removed, size - at)
    return out


_COLUMNS = ("doc_id", "n_pretokens", "n_tokens", "edited_chars", "edited_tokens", "reencoded_pretokens")


def _count(batches, ranks: str, n_edits: int):
    counter = counter_for(ranks)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {c: [] for c in _COLUMNS}
        for doc_id, text in zip(ids, texts, strict=True):
            chars, tokens = counter.split(text)
            doc = Document.__new__(Document)
            doc.text, doc.counter, doc.encoded, doc.tree = text, counter, 0, Tree(chars, tokens)
            before = doc.tree.tokens
            for edit in sample_edits(text, n_edits):
                doc.edit(*edit)
            for name, value in zip(_COLUMNS, (doc_id, len(chars), before, len(doc.text), doc.tree.tokens, doc.encoded), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in _COLUMNS]))


def count(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", n_edits: int = 3) -> DataFrame:
    """One row per document: tokens of the text, tokens after n_edits edits kept up through the tree, pre-tokens re-encoded for them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_count, ranks=ranks, n_edits=n_edits), ", ".join(f"{c} long" for c in _COLUMNS))
