"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is split into two 32-bit halves. Two fingerprints that
differ in at most three bits differ in at most one bit in one of the halves, so
each fingerprint enumerates the Hamming ball of radius one in both halves (33
keys each), fetches the fingerprints stored under exactly those keys, and the
complete distance decides. Equal fingerprints are collapsed before the search,
so groups of copies cost one entry.

Defined results
* Text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, n-word shingles with
  repeats, joined by one space; fewer words form one shingle; no word (or a null
  text) gives fingerprint zero, which links like any other.
* A bit is one if set in more than half of the shingle hashes (XXH64, seed 42).
* Linked documents share the component of the smallest id; a null id is never a
  component's name unless all its ids are null. Repeated rows give repeated rows.
* An empty table gives an empty result; extra columns are ignored by
  ``simhash_groups`` and carried unchanged by ``simhash_dedup``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import bounded_batches, first_row, stored
from trackside.llm.components import connected_components

HASH_SEED = 42
_digest = functools.partial(xxhash.xxh64_intdigest, seed=HASH_SEED)
# byte value -> its eight bits, one per byte of a 64-bit lane (counts up to 255 per lane)
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(256)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    if len(w) < words:
        return np.array([_digest(b" ".join(w))], dtype="<u8")
    grams = map(b" ".join, zip(*[w[i:] for i in range(words)]))
    return np.fromiter(map(_digest, grams), dtype="<u8", count=len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of the hashes (strictly more than half); 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 255):
        part = np.ascontiguousarray(_SPREAD[lanes[lo:lo + 255]].sum(axis=0, dtype="<u8"))
        counts += part.view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """(id, fp): one row per input row; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle_words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        task, f"id {kind}, fp long")


def _halves() -> list[tuple[int, Column]]:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return [(0, low), (1, high)]


def hamming_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``max_bits`` bits.

    One fingerprint has at most 43,744 others within three bits, so the number
    of links is linear in the number of distinct fingerprints.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with balls of radius one cover up to three bits")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(
        *[F.struct(F.lit(s).alias("seg"), v.alias("key")) for s, v in _halves()])).alias("k")).select("b", "k.*")
    probes = (fps.select(F.col("fp").alias("a"), F.explode(F.array(
        *[F.struct(F.lit(s).alias("seg"), v.alias("half")) for s, v in _halves()])).alias("k"))
        .select("a", "k.*").select("a", "seg", F.explode(F.transform(
            masks, lambda m: F.col("half").bitwiseXOR(m))).alias("key")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probes.join(index, ["seg", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _named(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id, n_links) of every distinct fingerprint of ``rows`` (id, fp), written once."""
    fps = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    links = stored(hamming_links(fps.select("fp"), max_bits), "simhash-links")
    comp = connected_components(links)
    # a linked fingerprint's component, then the smallest document id in it
    node = fps.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    node = stored(node, "simhash-nodes")
    low = node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    degree = (links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp")
              .agg(F.count(F.lit(1)).alias("n_links")))
    # written, so that later joins deal out a hot fingerprint's rows anew
    return stored(node.join(low, "component").join(degree, "fp", "left").select(
        "fp", "component", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "simhash-named")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: id, fp, n_links (other fingerprints linked), component_id."""
    with bounded_batches(docs.sparkSession):
        rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words), "simhash-fp")
    return rows.join(_named(rows, max_bits), "fp").select("id", "fp", "n_links", "component_id")


def _with_fingerprint(docs: DataFrame, name: str, text_col: str, shingle_words: int) -> DataFrame:
    """``docs`` with one more column, the fingerprint of the row's text. Only texts go to Python, only numbers come back."""
    def own(texts: pa.Array) -> pa.Array:
        fps = [fingerprint(shingle_hashes(t.as_py(), shingle_words)) for t in texts]
        return pa.array(np.array(fps, dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, F.arrow_udf(own, "long")(F.col(text_col).cast("string")))


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document per component: the one with the smallest id.

    Judged row by row: a row stays if its id is the smallest of the component of its
    own fingerprint, so rows that repeat a kept id in that component all stay, and an
    id or a null id that loses in one component does not lose in another. A component
    without any id keeps one row, the one whose columns sort first.
    """
    tag = "__x"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    fp = tag + "fp"
    # texts are hashed once: the rows are written with their fingerprints
    with bounded_batches(docs.sparkSession):
        marked = stored(_with_fingerprint(docs, fp, text_col, shingle_words), "simhash-docs")
    rows = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    named = _named(rows, max_bits)
    # written, so that texts are shuffled only where the losing rows are too many to broadcast
    lost = stored(rows.join(named, "fp").filter(~F.col("id").eqNullSafe(F.col("component_id")))
                  .select(F.col("id").alias(tag + "id"), F.col("fp").alias(tag + "lost")).distinct(), "simhash-lost", "none")
    kept = marked.join(
        lost, F.col(id_col).eqNullSafe(F.col(tag + "id")) & (F.col(fp) == F.col(tag + "lost")), "left_anti")
    unnamed = named.filter(F.col("component_id").isNull()).select(
        F.col("fp").alias(fp), F.col("component").alias(tag + "c"))
    if not unnamed.head(1):
        return kept.select(*docs.columns)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    one = (kept.filter(F.col(id_col).isNull()).join(unnamed, fp).groupBy(tag + "c")
           .agg(first_row([text_col, *rest]).alias(tag + "row"))
           .select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == id_col
                     else F.col(tag + "row").getField(c).alias(c) for c in docs.columns]))
    return kept.filter(F.col(id_col).isNotNull()).select(*docs.columns).unionByName(one)
