"""Benchmark decontamination: size-partitioned MinHash containment search.

All five-word shingles are ordered by one hash. Benchmark items are partitioned by
their number of distinct shingles (powers of two); within a partition an item is
represented by its smallest hashes, as many as the containment threshold needs:
an item of q shingles whose containment is at least t misses at most
floor((1 - t) * q) of them, so of its floor((1 - t) * q) + 1 smallest hashes at
least one lies in every document that must be found. Every partition has a table of
its own; documents of any length look up all their hashes up to the table's
largest, without a sketch of the document. Candidates
are then verified by counting the item's shingles, as words, in the document.
The recall is therefore one by construction, not by chance.

Words are runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text; a text of fewer than five words is one shingle of all its words.

Defined results
* Null or word-less texts and items match nothing. Repeated rows repeat their
  matches; empty tables give an empty result; extra columns are ignored by
  ``find_contaminated`` and carried unchanged by ``decontaminate``.
* Null doc ids are reported as null; ``decontaminate`` judges every row by its
  own text, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackside.llm import kernels as K

SHINGLE = 5
# Benchmark items travel to the tasks in blocks of about this many bytes of text.
BLOCK_BYTES = 4 << 20
PART_CHARS = 4 << 20
_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: str | None) -> bytes:
    """Lower-cased words joined by one space."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS).split())


def shingle_set(norm: bytes) -> set[bytes]:
    w = norm.split()
    if not w:
        return set()
    if len(w) < SHINGLE:
        return {norm}
    return set(map(b" ".join, zip(*[w[i:] for i in range(SHINGLE)])))


def _doc_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of newline-separated normalised texts and the text each is from."""
    starts, ends = K.word_spans(raw)
    h = K.word_hashes(raw, starts, ends)
    breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
    text_of = np.searchsorted(breaks, starts)
    g = K.gram_hashes(h, SHINGLE)
    at = text_of[: len(g)]
    whole = at == text_of[SHINGLE - 1:] if len(g) else np.zeros(0, bool)
    # texts of fewer words: one hash of all their words, salted by their number
    counts = np.bincount(text_of, minlength=len(breaks) + 1)
    first = np.concatenate(([0], np.cumsum(counts)))
    short_g, short_at = [], []
    for n in range(1, SHINGLE):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            v = np.zeros(len(rows), dtype=K.U64)
            for j in range(n):
                v = K.mix(v + h[first[rows] + j] + K.U64(n))
            short_g.append(v)
            short_at.append(rows)
    return np.concatenate([g[whole], *short_g]), np.concatenate([at[whole], *short_at])


class Signatures:
    """The size-partitioned minimum hashes of one block of benchmark items."""

    def __init__(self, items: list[tuple], threshold: float):
        share = 1 - Fraction(str(threshold))
        self.items = []
        pairs: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm = normal_words(text)
            shingles = shingle_set(norm)
            if not shingles:
                continue
            hashes = np.unique(_doc_hashes(norm + b"\n")[0])
            keep = min(len(hashes), int(share * len(shingles)) + 1 + len(shingles) - len(hashes))
            part = len(shingles).bit_length()
            pairs.setdefault(part, []).extend((int(v), len(self.items)) for v in hashes[:keep])
            self.items.append((item_id, shingles))
        # a table per size partition: sorted hashes and their items; a partition of long items holds
        # many hashes but only low ones, one of short items few but high ones
        self.parts = []
        self.seen = np.zeros(1 << 20, dtype=bool)
        for part in sorted(pairs):
            found = sorted(pairs[part])
            hashes = np.array([v for v, _ in found], dtype=K.U64)
            self.parts.append((hashes, np.array([i for _, i in found], dtype=np.int64)))
            self.seen[(hashes >> K.U64(44)).astype(np.int64)] = True

    def candidates(self, g: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a signature hash; each partition is asked for the hashes up to its largest."""
        out: set[tuple[int, int]] = set()
        hit = np.flatnonzero(self.seen[(g >> K.U64(44)).astype(np.int64)])
        g, at = g[hit], at[hit]
        for hashes, owner in self.parts:
            low = np.flatnonzero(g <= hashes[-1])
            lo, hi = np.searchsorted(hashes, g[low], "left"), np.searchsorted(hashes, g[low], "right")
            out |= {(int(t), int(owner[k])) for t, a, b in zip(at[low], lo, hi) if b > a for k in range(a, b)}
        return out


def _matches(texts: list[str | None], sig: Signatures, threshold: Fraction) -> Iterator[tuple[int, int, int, int]]:
    """(text index, item index, shared shingles, item shingles) of verified matches."""
    norms = [normal_words(t) for t in texts]
    at, size, lo = 0, 0, 0
    while lo < len(norms):  # a few MB at a time
        at, size = lo, 0
        while at < len(norms) and (at == lo or size + len(norms[at]) < 4 << 20):
            size += len(norms[at]) + 1
            at += 1
        g, of = _doc_hashes(b"\n".join(norms[lo:at]) + b"\n")
        by_text: dict[int, list[int]] = {}
        for t, i in sig.candidates(g, of):
            by_text.setdefault(t, []).append(i)
        for t, found in sorted(by_text.items()):
            own = shingle_set(norms[lo + t])
            for i in sorted(found):
                wanted = sig.items[i][1]
                shared = len(wanted & own)
                if shared >= threshold * len(wanted):
                    yield lo + t, i, shared, len(wanted)
        lo = at


def _blocks(items: DataFrame, item_id: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in hash blocks of bounded text; each is collected on its own, one after another."""
    text = F.col(text_col).cast("string")
    total = items.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    n = -(-int(total) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64(text), F.lit(max(n, 1)))
    for i in range(n):
        yield [(r[0], r[1]) for r in items.select(F.col(item_id), text.alias("t")).filter(block == i).collect()]


def find_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item_shingles) for containment >= ``threshold``."""
    spark = docs.sparkSession
    doc_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_id].dataType)
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_shared long, n_item_shingles long"
    out = None
    for block in _blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(Signatures(block, threshold))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(_matches(b.column(1).to_pylist(), sent.value, Fraction(str(threshold))))
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                own = [sent.value.items[r[1]][0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own, item_arrow), pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([r[3] for r in rows], pa.int64())],
                    names=["doc_id", "item_id", "n_shared", "n_item_shingles"])

        part = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(task, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _clean(sent, threshold: Fraction):
    """Which texts hold no item of the broadcast block."""
    def keep(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), dtype=bool)
        for lo, part in _parts(texts):
            out[[lo + r[0] for r in _matches(part, sent.value, threshold)]] = False
        return pa.array(out)

    return keep


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts by parts of a few MB, so that one part only is held as Python strings."""
    part, size, lo = [], 0, 0
    for at, t in enumerate(texts):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= PART_CHARS:
            yield lo, part
            part, size, lo = [], 0, at + 1
    if part:
        yield lo, part


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; columns unchanged.

    The same search runs over whole rows, block by block, so no join is needed.
    """
    spark = docs.sparkSession
    for block in _blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(Signatures(block, threshold))

        docs = docs.filter(F.arrow_udf(_clean(sent, Fraction(str(threshold))), "boolean")(F.col(text_col).cast("string")))
    return docs
