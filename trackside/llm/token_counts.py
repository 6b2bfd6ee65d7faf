"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: the leaves hold characters
and tokens of one pre-token each, inner nodes the sums. An edit replaces a range of
characters. Pre-tokens are cut from left to right, and where one ends depends only
on the text from its start to a few characters past its end. So after an edit it
is enough to cut anew from the last pre-token that ends ``LOOKAHEAD`` characters or
more before the edit, until a new boundary behind the edit meets an old one; the
rest is as it was. Only those pre-tokens are encoded again, and only the sums above
them change.

Leaves live in blocks of at most ``2 * BLOCK`` pre-tokens; the tree of sums stands
over the blocks. A tree travels as one binary column (two numbers per pre-token).

Defined results
* A null text counts as empty: no pre-tokens, no tokens. Special token strings in
  a text are ordinary text.
* Edits apply one after another, each to the text the former ones left; start and
  end are cut to that text, a start behind the end becomes the end. A null edit
  list or a null replacement is empty; null offsets are 0.
* Repeated rows are counted alike; empty tables give empty results; extra columns
  are ignored (``build_trees``) or must not be needed (only id, text, tree are kept).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.llm import kernels as K

# The published pre-token pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# No alternative of the pattern looks at more than two characters past the end of its match.
LOOKAHEAD = 3
BLOCK = 64
CACHE_WORDS = 100_000
# Rows that a task holds as Python objects at a time.
SLICE_ROWS = 256
EDITS_TYPE = "array<struct<start:long,end:long,replacement:string>>"


class Counter:
    """Token counts of pre-tokens; frequent ones are remembered (the memory is bounded)."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            n = len(self.encoding._encode_single_piece(piece.encode("utf-8", "replace")))
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of every pre-token."""
        pieces = self.cut.findall(text)
        known, count = self.known, self.tokens
        return [len(p) for p in pieces], [known[p] if p in known else count(p) for p in pieces]


_COUNTERS: dict[int, Counter] = {}


def _counter(vocabulary: bytes) -> Counter:
    """One counter per Python worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


class Tree:
    """Blocks of leaves under a binary tree of (characters, pre-tokens, tokens) sums."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.blocks = [(chars[i:i + BLOCK], tokens[i:i + BLOCK]) for i in range(0, len(chars), BLOCK)] or [([], [])]
        self._grow()

    def _grow(self) -> None:
        """Sums over all blocks; needed at the start and when the number of blocks changed."""
        self.width = 1 << max(len(self.blocks) - 1, 0).bit_length()
        self.sums = [(0, 0, 0)] * (2 * self.width)
        for i, (c, t) in enumerate(self.blocks):
            self.sums[self.width + i] = (sum(c), len(c), sum(t))
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def pieces(self) -> int:
        return self.sums[1][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][2]

    def find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, start) of the leaf that holds character ``at``; of the last one if behind all."""
        i, before = 1, 0
        while i < self.width:
            left = self.sums[2 * i]
            right = self.sums[2 * i + 1]
            if at < before + left[0] or not right[1]:
                i = 2 * i
            else:
                before, i = before + left[0], 2 * i + 1
        block = i - self.width
        sizes = self.blocks[block][0]
        leaf = 0
        while leaf < len(sizes) - 1 and at >= before + sizes[leaf]:
            before += sizes[leaf]
            leaf += 1
        return block, leaf, before

    def splice(self, first: tuple[int, int], gone: int, chars: list[int], tokens: list[int]) -> None:
        """Replace ``gone`` leaves from ``first`` = (block, leaf) on by new ones."""
        block, leaf = first
        touched, b, at, left = [block], block, leaf, gone
        while left:
            c, t = self.blocks[b]
            n = min(left, len(c) - at)
            del c[at:at + n], t[at:at + n]
            left -= n
            if left:
                b, at = b + 1, 0
                touched.append(b)
        c, t = self.blocks[block]
        c[leaf:leaf], t[leaf:leaf] = chars, tokens
        if len(c) > 2 * BLOCK or any(not self.blocks[b][0] for b in touched):
            parts = [(c[i:i + BLOCK], t[i:i + BLOCK]) for i in range(0, len(c), BLOCK)]
            parts += [self.blocks[b] for b in touched[1:] if self.blocks[b][0]]
            self.blocks[block:block + len(touched)] = parts
            self.blocks = self.blocks or [([], [])]
            self._grow()
            return
        for b in touched:
            c, t = self.blocks[b]
            i = self.width + b
            self.sums[i] = (sum(c), len(c), sum(t))
            while i > 1:
                i //= 2
                self._add(i)

    def leaves_from(self, block: int, leaf: int) -> Iterator[int]:
        """Characters of the leaves from a place on."""
        for b in range(block, len(self.blocks)):
            yield from self.blocks[b][0][leaf if b == block else 0:]

    def pack(self) -> bytes:
        return K.pack_ints(np.array([x for c, _ in self.blocks for x in c], dtype="<u4"),
                           np.array([x for _, t in self.blocks for x in t], dtype="<u4"))

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        chars, tokens = K.unpack_ints(raw, "<u4", "<u4")
        return cls(chars.tolist(), tokens.tolist())


def edit_text(counter: Counter, tree: Tree, text: str, start, end, replacement) -> tuple[str, int, int]:
    """Apply one edit to text and tree; returns the new text, pre-tokens and characters encoded again."""
    start = min(max(start or 0, 0), len(text))
    end = min(max(end or 0, start), len(text))
    new = text[:start] + (replacement or "") + text[end:]
    shift = len(new) - len(text)
    block, leaf, at = tree.find(max(start - LOOKAHEAD, 0)) if tree.pieces else (0, 0, 0)
    old = tree.leaves_from(block, leaf)
    old_end, gone = at, 0           # where the removed old leaves end
    chars, tokens, done = [], [], at
    resume = end + shift            # the first character of the new text behind the edit
    for m in counter.cut.finditer(new, at):
        if done >= resume:
            while old_end + shift < done and (n := next(old, None)) is not None:
                old_end, gone = old_end + n, gone + 1
            if old_end + shift == done and old_end >= end:
                break               # an old boundary: the rest is as it was
        chars.append(m.end() - m.start())
        tokens.append(counter.tokens(m.group()))
        done = m.end()
    else:
        gone += sum(1 for _ in old)
    tree.splice((block, leaf), gone, chars, tokens)
    return new, len(chars), sum(chars)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into a few rows each, so that lists of texts and trees stay small."""
    for b in batches:
        for i in range(0, max(b.num_rows, 1), SLICE_ROWS):
            yield b.slice(i, SLICE_ROWS)


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver (about 1 MB) and sent to the tasks."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def build_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text, *keep, n_pretokens, n_tokens, tree): one row per document."""
    sent = _vocabulary(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for b in _slices(batches):
            pieces, tokens, trees = [], [], []
            for text in b.column(1):
                chars, counts = counter.leaves(text.as_py())
                pieces.append(len(chars))
                tokens.append(sum(counts))
                trees.append(K.pack_ints(np.array(chars, dtype="<u4"), np.array(counts, dtype="<u4")))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64()), pa.array(trees, pa.binary())],
                names=[*b.schema.names, "n_pretokens", "n_tokens", "tree"])

    return rows.mapInArrow(task, f"{schema}, n_pretokens long, n_tokens long, tree binary")


def apply_edits(trees: DataFrame, *, edits_col: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """Trees after their edits: id, text, tree, counts before and after, and what was encoded again."""
    sent = _vocabulary(trees.sparkSession, vocabulary)
    kind = trees.schema["id"].dataType.simpleString()
    names = ["id", "text", "tree", "n_tokens", "n_edits", "n_pretokens_after", "n_tokens_after",
             "n_reencoded", "chars_reencoded"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for b in _slices(batches):
            texts, packed, numbers = [], [], []
            for text, raw, edits in zip(b.column(1), b.column(3), b.column(4)):
                text, tree, pieces, chars = text.as_py(), Tree.unpack(raw.as_py()), 0, 0
                edits = edits.as_py() or []
                for e in edits:
                    if e is not None:
                        text, p, c = edit_text(counter, tree, text, e["start"], e["end"], e["replacement"])
                        pieces, chars = pieces + p, chars + c
                texts.append(text)
                packed.append(tree.pack())
                numbers.append((len(edits), tree.pieces, tree.tokens, pieces, chars))
            columns = list(zip(*numbers)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(packed, pa.binary()), b.column(2),
                 *[pa.array(c, pa.int64()) for c in columns]], names=names)

    return trees.select("id", "text", "n_tokens", "tree", edits_col).mapInArrow(
        task, f"id {kind}, text string, tree binary, n_tokens long, n_edits long, n_pretokens_after long, "
              "n_tokens_after long, n_reencoded long, chars_reencoded long")


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Join an edit log (id, seq, start, end, replacement) to its documents, in order of ``seq``."""
    lists = edits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("e"))
    lists = lists.select("id", F.transform("e", lambda e: F.struct(
        e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"),
        e["replacement"].alias("replacement"))).alias("edits"))
    return trees.join(lists, "id", "left")
