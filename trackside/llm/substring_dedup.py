"""Repeated-passage removal by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the
smallest hash among its ``MINIMISER_WORDS``-word grams; consecutive windows that share
the minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket,
where equal windows meet. Each bucket sorts its windows, compares equal hashes by their
words, and reports which words are covered by windows that also start in a document
with a smaller id.

Skew. Grams that are frequent in the corpus are ranked behind all others, so a very
common line or phrase is the minimiser only of windows that consist of nothing else.
Frequent means: more than ``HOT_FACTOR`` times the mean of a count over ``SLOTS`` hash
slots, taken over all grams of all documents (a table of fixed size). Windows that
do consist of common grams form equal strings, and of equal strings a task sends only
those of the smallest id; the others are settled on the spot.

Defined results
* Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. Documents with
  fewer words than a window lose nothing.
* A document is not smaller than itself: repeats inside one document stay. Rows that
  repeat an id are judged one by one against smaller ids only. A null id is neither
  smaller nor larger than any: such rows stay whole and remove nothing.
* Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.llm import kernels as K

WINDOW = 50
MINIMISER_WORDS = 5
SLOTS = 1 << 16
HOT_FACTOR = 4
# One vectorised step takes about this much text; one packed message this many super-k-mer bytes.
STEP_BYTES = 3 << 20
FLUSH_BYTES = 24 << 20
MAX_RUN = 256
_ZSTD_LEVEL = 2


def normal_text(text: str | None) -> bytes:
    """Words joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def _steps(rows: Iterator[tuple], window: int) -> Iterator[list[tuple]]:
    """Groups of (key..., normalised text) with at least one window, a few MB each."""
    group, size = [], 0
    for *key, text in rows:
        norm = normal_text(text)
        if norm.count(b" ") + 1 < window or not norm:
            continue
        group.append((*key, norm))
        size += len(norm) + 1
        if size >= STEP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


class _Words:
    """Words of one step: spans, hashes and the text each belongs to."""

    def __init__(self, norms: list[bytes]):
        self.raw = b"\n".join(norms) + b"\n"
        self.starts, self.ends = K.word_spans(self.raw)
        self.hashes = K.word_hashes(self.raw, self.starts, self.ends)
        breaks = np.flatnonzero(np.frombuffer(self.raw, dtype=np.uint8) == 10)
        self.text_of = np.searchsorted(breaks, self.starts)
        self.first = np.searchsorted(self.text_of, np.arange(len(norms)))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Gram hash at every word, and whether the gram lies inside one text."""
        g = K.gram_hashes(self.hashes, MINIMISER_WORDS)
        return g, self.text_of[: len(g)] == self.text_of[MINIMISER_WORDS - 1:]


def _slot(g: np.ndarray) -> np.ndarray:
    return (g >> K.U64(48)).astype(np.int64)


def hot_slots(docs: DataFrame, text_col: str, window: int) -> np.ndarray:
    """Which of the ``SLOTS`` hash slots hold unusually many grams of the whole corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            for group in _steps(((t.as_py(),) for t in b.column(0)), window):
                g, inside = _Words([x[-1] for x in group]).grams()
                total += np.bincount(_slot(g[inside]), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["slot", "n"])

    sums = (docs.select(F.col(text_col).cast("string")).mapInArrow(count, "slot int, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")))
    got = sums.toPandas()  # SLOTS rows at most
    hot = np.zeros(SLOTS, dtype=bool)
    if len(got):
        hot[got["slot"][got["n"] > HOT_FACTOR * got["n"].sum() / SLOTS]] = True
    return hot


def super_kmers(words: _Words, hot: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, minimiser) of every run of windows that share their minimiser."""
    g, _ = words.grams()
    key = (g >> K.U64(1)) | (hot[_slot(g)].astype(K.U64) << K.U64(63))
    low = K.sliding_min(key, window - MINIMISER_WORDS + 1)
    if not len(low):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=K.U64)
    valid = words.text_of[: len(low)] == words.text_of[window - 1:]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1] | (words.text_of[1: len(low)] != words.text_of[: len(low) - 1])
    begin = np.flatnonzero(new & valid)
    # a run ends where the next one begins or where the windows of its text end
    edge = np.flatnonzero(np.append(new | ~valid, True))
    stop = edge[np.searchsorted(edge, begin, "right")]
    length = stop - begin
    if length.max(initial=0) > MAX_RUN:  # long runs of repetitive text are cut, so no string grows without bound
        parts = -(-length // MAX_RUN)
        of = np.repeat(np.arange(len(begin)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, length = begin[of] + nth * MAX_RUN, np.minimum(MAX_RUN, length[of] - nth * MAX_RUN)
    return begin, length, low[begin]


def _message(strings: list[bytes], numbers: list[np.ndarray], ranges: list[np.ndarray]) -> bytes:
    """Super-k-mers with (id, check, start) and settled ranges (id, check, from, to), compressed."""
    text = b"\n".join(strings)
    body = K.pack_ints(*numbers, *ranges, np.array([len(text)], dtype="<i8"))
    return zstandard.ZstdCompressor(level=_ZSTD_LEVEL).compress(len(body).to_bytes(8, "little") + body + text)


def _open_message(raw: bytes) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    size = int.from_bytes(data[:8], "little")
    *numbers, length = K.unpack_ints(data[8:8 + size], *["<i8"] * 3, *["<i8"] * 4, "<i8")
    text = data[8 + size:]
    return (text.split(b"\n") if length[0] else []), numbers[:3], numbers[3:]


class _Outbox:
    """Collects the super-k-mers of a task by bucket; equal strings go out once per smallest id."""

    def __init__(self, buckets: int, window: int):
        self.buckets, self.window = buckets, window
        self.clear()

    def clear(self) -> None:
        self.size, self.strings, self.best = 0, [], {}
        self.ids, self.checks, self.starts, self.bucket, self.settled = [], [], [], [], []

    def add(self, group: list[tuple], hot: np.ndarray) -> None:
        words = _Words([x[-1] for x in group])
        begin, length, low = super_kmers(words, hot, self.window)
        raw, text = words.raw, words.text_of[begin]
        lo, hi = words.starts[begin], words.ends[begin + length + self.window - 2]
        start = begin - words.first[text]
        bucket = (K.mix(low) % K.U64(self.buckets)).astype(np.int64)
        ids, checks = [x[0] for x in group], [x[1] for x in group]
        best, strings = self.best, self.strings
        for t, a, z, s, n, k in zip(text.tolist(), lo.tolist(), hi.tolist(), start.tolist(), length.tolist(), bucket.tolist()):
            string, doc = raw[a:z], ids[t]
            at = best.get(string)
            if at is not None:
                other = self.ids[at]
                if doc > other:  # an equal passage starts in a smaller document: settled here
                    self.settled.append((doc, checks[t], s, s + n + self.window - 1))
                    continue
                if doc < other:
                    self.settled.append((other, self.checks[at], self.starts[at], self.starts[at] + n + self.window - 1))
                    self.ids[at], self.checks[at], self.starts[at] = doc, checks[t], s
                    continue
            else:
                best[string] = len(strings)
            strings.append(string)
            self.size += z - a + 64
            self.ids.append(doc)
            self.checks.append(checks[t])
            self.starts.append(s)
            self.bucket.append(k)

    def messages(self) -> Iterator[pa.RecordBatch]:
        """(bucket, message) rows; settled ranges ride along, spread over the buckets."""
        order = np.argsort(np.array(self.bucket, dtype=np.int64), kind="stable")
        numbers = [np.array(x, dtype="<i8")[order] for x in (self.ids, self.checks, self.starts)]
        strings = [self.strings[i] for i in order]
        keys = np.array(self.bucket, dtype=np.int64)[order]
        settled = np.array(self.settled, dtype="<i8").reshape(-1, 4)
        extra = settled[:, 1] % self.buckets if len(settled) else np.zeros(0, np.int64)
        by = np.argsort(extra, kind="stable")
        settled, extra = settled[by], extra[by]
        every = np.union1d(keys, extra)
        a, b = np.searchsorted(keys, every), np.searchsorted(keys, every, "right")
        c, d = np.searchsorted(extra, every), np.searchsorted(extra, every, "right")
        sent = [_message(strings[p:q], [x[p:q] for x in numbers], [settled[r:s, j] for j in range(4)])
                for p, q, r, s in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())]
        self.clear()
        for i in range(0, len(sent), 64):
            yield pa.RecordBatch.from_arrays([pa.array(every[i:i + 64]), pa.array(sent[i:i + 64], pa.binary())],
                                             names=["bucket", "message"])


def packed_super_kmers(docs: DataFrame, hot: np.ndarray, *, id_col: str, text_col: str, window: int,
                       buckets: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(buckets, window)
        for b in batches:
            rows = ((i, c, t.as_py()) for i, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
            for group in _steps(rows, window):
                box.add(group, sent.value)
                if box.size >= FLUSH_BYTES:
                    yield from box.messages()
        if box.size or box.settled:
            yield from box.messages()

    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col(text_col).cast("string"))
    return rows.mapInArrow(task, "bucket long, message binary")


def _leaders(words: _Words, string_of: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """For every window of a bucket the first window with the same words."""
    n = len(begins)
    h = words.hashes
    # rolling hash of each window from prefix sums of its words' hashes
    power = np.cumprod(np.concatenate(([K.U64(1)], np.full(len(h), 0x9E3779B97F4A7C15, dtype=K.U64))))
    inverse = np.cumprod(np.concatenate(([K.U64(1)], np.full(len(h), pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=K.U64))))
    total = np.concatenate((np.zeros(1, K.U64), np.cumsum(h * power[:-1])))
    value = K.mix((total[begins + window] - total[begins]) * inverse[begins])
    order = np.argsort(value, kind="stable")
    head = np.ones(n, dtype=bool)
    head[1:] = value[order[1:]] != value[order[:-1]]
    leader = np.empty(n, dtype=np.int64)
    leader[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    # compare words, a run of consecutive windows against its run of leaders at a time
    follow = np.flatnonzero(leader != np.arange(n))
    if len(follow):
        lead = leader[follow]
        cut = np.ones(len(follow), dtype=bool)
        cut[1:] = ((follow[1:] != follow[:-1] + 1) | (lead[1:] != lead[:-1] + 1)
                   | (string_of[follow[1:]] != string_of[follow[:-1]]) | (string_of[lead[1:]] != string_of[lead[:-1]]))
        a = np.flatnonzero(cut)
        z = np.append(a[1:], len(follow)) - 1
        raw, s, e = words.raw, words.starts, words.ends
        mine = zip(s[begins[follow[a]]].tolist(), e[begins[follow[z]] + window - 1].tolist())
        theirs = zip(s[begins[lead[a]]].tolist(), e[begins[lead[z]] + window - 1].tolist())
        if any(raw[i:j] != raw[k:m] for (i, j), (k, m) in zip(mine, theirs)):
            seen: dict[bytes, int] = {}  # two different windows share a hash: compare all by their words
            for w, (i, j) in enumerate(zip(s[begins].tolist(), e[begins + window - 1].tolist())):
                leader[w] = seen.setdefault(raw[i:j], w)
    return leader


def covered_ranges(strings: list[bytes], ids: np.ndarray, checks: np.ndarray, starts: np.ndarray,
                   window: int) -> list[np.ndarray]:
    """(id, check, from, to) word ranges covered by windows that also start in a smaller document."""
    words = _Words(strings)
    per = np.bincount(words.text_of, minlength=len(strings)) - window + 1
    string_of = np.repeat(np.arange(len(strings)), per)
    nth = np.arange(len(string_of)) - np.repeat(np.cumsum(per) - per, per)
    begins = words.first[string_of] + nth
    leader = _leaders(words, string_of, begins, window)
    least = np.full(len(begins), np.iinfo(np.int64).max)
    np.minimum.at(least, leader, ids[string_of])
    gone = least[leader] < ids[string_of]
    edge = np.flatnonzero(gone & ~np.concatenate(([False], gone[:-1] & (string_of[1:] == string_of[:-1]))))
    last = np.flatnonzero(gone & ~np.concatenate((gone[1:] & (string_of[1:] == string_of[:-1]), [False])))
    of = string_of[edge]
    return [ids[of], checks[of], starts[of] + nth[edge], starts[of] + nth[last] + window]


def bucket_ranges(packed: DataFrame, window: int) -> DataFrame:
    """(id, check, lo, hi) ranges of words to remove, from every bucket."""
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        strings, numbers, ranges = [], [[], [], []], [[], [], [], []]
        for raw in pdf["message"]:
            s, own, settled = _open_message(raw)
            strings += s
            for into, x in zip(numbers, own):
                into.append(x)
            for into, x in zip(ranges, settled):
                into.append(x)
        if strings:
            for into, x in zip(ranges, covered_ranges(strings, *[np.concatenate(x) for x in numbers], window)):
                into.append(x)
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("id", "check", "lo", "hi"), ranges)})

    return packed.groupBy("bucket").applyInPandas(task, "id long, check long, lo long, hi long")


def _cut(text: str | None, ranges: list | None) -> tuple[int, int, bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not ranges:
        return n, 0, b" ".join(words)
    keep = np.zeros(n + 1, dtype=np.int64)
    np.add.at(keep, [r["lo"] for r in ranges], 1)
    np.add.at(keep, [r["hi"] for r in ranges], -1)
    kept = [w for w, k in zip(words, (np.cumsum(keep[:-1]) == 0).tolist()) if k]
    return n, n - len(kept), b" ".join(kept)


def default_buckets(spark: SparkSession) -> int:
    """Several buckets per shuffle partition, so that partitions even out."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every row."""
    hot = hot_slots(docs, text_col, window)
    packed = packed_super_kmers(docs, hot, id_col=id_col, text_col=text_col, window=window,
                                buckets=buckets or default_buckets(docs.sparkSession))
    ranges = (bucket_ranges(packed, window).groupBy("id", "check")
              .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("own"), text.alias("text"))
    joined = rows.join(ranges, (F.col("doc") == F.col("id")) & (F.col("own") == F.col("check")), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_cut(t.as_py(), r.as_py()) for t, r in zip(b.column(1), b.column(2))]
            columns = [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                       pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([g[2].decode("utf-8", "surrogatepass") for g in got], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select("doc", "text", "ranges").mapInArrow(task, schema)
