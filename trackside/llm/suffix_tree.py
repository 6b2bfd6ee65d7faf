"""Language-model scores from a probabilistic suffix tree over words.

States are contexts, runs of any number of words that stand before a token. The tree
grows level by level, a level being a number of words:

* a context is tried if it occurs at least ``MIN_COUNT`` times in the training
  documents, the run without its last word was tried before (which is where it is
  counted), and its suffix, one word shorter, was tried too and is followed by more than
  one kind of token (otherwise both have the same distribution). Beyond
  ``FREE_WORDS`` words the suffix must also have been retained;
* it is retained if the distribution after it, judged without the token itself, predicts
  its tokens better than its suffix's does by ``MIN_GAIN`` nats a token.

Growth ends when nothing is left to try. No length and no number of states is set, and the
counts that decide are absolute: a context of a table is a context of any larger one. The
distribution of a state is smoothed (Witten-Bell) into that of its longest retained suffix, down to the
add-one-half word distribution. A token is scored in the state of the longest retained
suffix before it.

How it runs. Documents are packed once into chunks of a few MB, kept in tables bucketed by
chunk, so that no level shuffles them. At every level a chunk asks one bucket per context for
the training totals of its distinct (context, next word) pairs, sending its own
counts; a bucket adds up all chunks, runs the divergence tests of its contexts and
replies with totals, decisions and numbers of next words. Contexts that hold more than a
sixteenth of a mean bucket's tokens are dealt by (context, next word) instead; their tests are added up
by key, and only these decisions are broadcast: at most 16 times the buckets a level.
The number of buckets of a level follows the number of its open tokens, not the number of partitions.
Buckets are ranges of hashes or remainders of word numbers, and contexts of one later word share a bucket as far as they
fit, so that what a pair costs in a message hardly depends on the number of buckets.

Words are identified by 64-bit hashes of their bytes, longer contexts by 64-bit hashes of their words.
Between levels log probabilities are kept in single precision (a relative error of 6e-8).

Defined results
* A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end token. A null text is
  empty and has the end token only. Contexts do not cross documents.
* The model gives every document a proper probability; words unseen in training
  share the mass of one unseen word.
* Repeated rows are documents of their own. Ids may have any type; a null id is scored under a
  null id. Without training documents all scores are those of an empty model. Empty tables give
  an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside.llm import kernels as K
from trackside.llm.common import fresh_path, stored

CHUNK_BYTES = 6 << 20
MIN_COUNT = 2
FREE_WORDS = 2      # contexts of up to so many words are tried whether or not their suffix is retained
MIN_GAIN = 0.01
TEST_WEIGHT = 0.5   # weight of the shorter context in the divergence test, as a share of the context's count
BUCKET_TOKENS = 1_000_000
HOT_SHARE = 16      # a context with over 1 / HOT_SHARE of a mean bucket's tokens is dealt by next word too
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the query that wrote them
_DROP, _KEEP, _HOT = 0, 1, 2
_ODD = K.U64(0x9E3779B97F4A7C15)

_SHORT = ("u1", "u1", "<u8")

REPLY_SCHEMA = "chunk string, bucket long, reply binary, context long, gain double, n long, kinds long"


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(K.pack_ints(*arrays))


def _unpack(raw: bytes, *dtypes) -> list[np.ndarray]:
    return K.unpack_ints(zstandard.ZstdDecompressor().decompress(raw), *dtypes)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, the sign in the lowest bit: small for values that follow each other closely."""
    d = np.diff(values.astype(np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).view(K.U64)


def _walk(steps: np.ndarray) -> np.ndarray:
    """The values of ``_steps``."""
    return np.cumsum((steps >> K.U64(1)).view(np.int64) ^ -(steps & K.U64(1)).view(np.int64)).view(K.U64)


def _rises(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of values that rise from each start on."""
    out = np.diff(values, prepend=values[:1])
    out[starts] = values[starts]
    return out


def _climb(rises: np.ndarray, starts: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The values of ``_rises``, ``per`` of them from each start on."""
    out = np.cumsum(rises, dtype=rises.dtype)
    return out - np.repeat(out[starts] - rises[starts], per)


def _short(values: np.ndarray) -> list[np.ndarray]:
    """Numbers as a first byte and what it leaves: nothing under 128, a byte under 16512, two under 4 million, else all."""
    v = values.astype(K.U64)
    first = v.astype(np.uint8)
    more = np.flatnonzero(v >= K.U64(128))
    rest = v[more] - K.U64(128)
    long = rest >= K.U64(16384)
    far = (rest[long] - K.U64(16384)) >> K.U64(16)
    first[more] = K.U64(128) + (rest >> K.U64(8)) * ~long
    first[more[long]] = K.U64(192) + np.minimum(far, K.U64(63))
    left = np.where(far >= K.U64(63), rest[long], (rest[long] - K.U64(16384)) & K.U64(65535))
    return [first, (rest[~long] & K.U64(255)).astype(np.uint8), left]


def _whole(first: np.ndarray, byte: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The numbers of ``_short``."""
    out = first.astype(K.U64)
    middle, long = (first >= 128) & (first < 192), first >= 192
    out[middle] = K.U64(128) + ((out[middle] - K.U64(128)) << K.U64(8)) + byte
    top = out[long]
    out[long] = K.U64(128) + np.where(top == 255, left, K.U64(16384) + ((top - K.U64(192)) << K.U64(16)) + left)
    return out


def _slice_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as equal ranges of the hashes: however many there are, neighbours stay in one message."""
    return ((hashes >> K.U64(32)) * K.U64(buckets)) >> K.U64(32)


def _starts(values: np.ndarray) -> np.ndarray:
    """Positions in a sorted array at which a new value begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of every distinct value, in their order, and each value's place among them."""
    order = np.argsort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _pairs(context: np.ndarray, contexts: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_groups`` of (context, word), contexts being numbered from 0."""
    bits = int(word.max()).bit_length() if len(word) else 0
    if bits + contexts.bit_length() > 64:
        found, word = np.unique(word, return_inverse=True)
        bits = len(found).bit_length()
    return _groups((context.astype(K.U64) << K.U64(bits)) | word.astype(K.U64))


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order by bucket (in few bits numpy sorts by radix)."""
    return np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")


@dataclass
class Model:
    """What all tasks know: training tokens, distinct ones, buckets, the count from which a context is hot, whether
    two words' numbers fit into one key."""
    total: int
    kinds: int
    buckets: int
    hot: float
    narrow: bool

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.total + 0.5 * (self.kinds + 1))


@dataclass
class Chunk:
    """Documents of one chunk with their sums so far, and the open tokens, whose context is being asked for."""
    per_doc: np.ndarray  # tokens
    train: np.ndarray    # 1 for training documents
    known: np.ndarray    # tokens seen in training
    base: np.ndarray     # log10 sums
    score: np.ndarray    # log10 sum of the tokens that are done
    words: np.ndarray    # the word of every token, as a row of
    names: np.ndarray    # the distinct words in their order: hashes, then numbers
    totals: np.ndarray   # and their training counts
    pos: np.ndarray      # the open tokens, by position; from the second level on:
    count: np.ndarray    # training count of the context
    after: np.ndarray    # training count of the word after the shorter context
    aux: np.ndarray      # second level: by distinct word, the kinds of words after it, 0 if it is no state;
                         # then by open token the count of the shorter context
    p: np.ndarray        # from the third level on: log10 probability in the states found so far

    TYPES = ("<u4", "u1", "<u4", "<f8", "<f8", None, "<u8", "<u8", "<u4", None, None, "<u8", "<f4")  # None: _short

    def pack(self) -> bytes:
        # the count of a context is the count after the shorter one of the token before, where that is open
        count = self.count.copy()
        if len(count):
            count[1:][np.diff(self.pos) == 1] = 0
        arrays = vars(self) | {"names": np.diff(self.names.astype(K.U64), prepend=K.U64(0)), "totals": _steps(self.totals),
                               "pos": np.diff(self.pos, prepend=0), "count": count}
        parts = [[np.asarray(a).astype(t)] if t else _short(np.asarray(a)) for a, t in zip(arrays.values(), self.TYPES)]
        return _pack(*(a for part in parts for a in part))

    @classmethod
    def unpack(cls, raw: bytes) -> Chunk:
        got = iter(_unpack(raw, *(d for t in cls.TYPES for d in ((t,) if t else _SHORT))))
        out = cls(*(next(got) if t else _whole(next(got), next(got), next(got)) for t in cls.TYPES))
        out.words = out.words.astype(np.uint32)
        out.names, out.totals = np.cumsum(out.names, dtype=K.U64), _walk(out.totals)
        out.pos = np.cumsum(out.pos, dtype=np.int64)
        if len(out.count):
            here, out.count = np.flatnonzero(np.diff(out.pos) == 1) + 1, out.count.copy()
            out.count[here] = out.after[here - 1]
        return out

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_doc)), self.per_doc)

    def finish(self, pos: np.ndarray, p: np.ndarray) -> None:
        self.score = self.score + np.bincount(self.docs()[pos], weights=np.log10(p), minlength=len(self.per_doc))

    def deal_words(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words in bucket order, the buckets and their edges."""
        mixed = K.mix(self.names)
        order = np.argsort(mixed)
        bucket = _slice_of(mixed[order], buckets).astype(np.int64)
        begin = _starts(bucket)
        return order, bucket[begin], np.append(begin, len(order))

    def word_messages(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        n = np.bincount(self.words, weights=np.repeat(self.train, self.per_doc), minlength=len(self.names))
        order, into, edges = self.deal_words(buckets)
        for b, lo, hi in zip(into.tolist(), edges[:-1], edges[1:]):
            yield b, _pack(np.diff(K.mix(self.names[order[lo:hi]]), prepend=K.U64(0)), n[order[lo:hi]].astype("<u4"))


class Asked:
    """The distinct (context, word) pairs of a chunk's open tokens, in the order of the messages about them."""

    def __init__(self, s: Chunk, level: int, model: Model):
        word = lambda back: s.words[s.pos - back]
        key = s.names[word(level)]
        if level == 2 and model.narrow:  # the later word in front, so that counts of one word stand together
            key = (s.names[word(1)] << K.U64(32)) | key
        else:
            for back in range(level - 1, 0, -1):
                key = K.mix(key * _ODD + K.mix(s.names[word(back)] + K.U64(1)))
        x, base = s.names[word(0)], model.base(s.totals[word(0)])
        if level == 1:
            count, up, after, p = s.totals[word(1)], np.full(len(x), model.total, dtype=K.U64), s.totals[word(0)], base
        elif level == 2:
            count, up, after, kinds = s.count, s.totals[word(1)], s.after, s.aux[word(1)]
            p = np.where(kinds > 0, (after + kinds * base) / np.maximum(up + kinds, 1), base)
        else:
            count, up, after, p = s.count, s.aux, s.after, 10.0 ** s.p.astype(np.float64)
        self.level, self.count, self.p = level, count, p
        if level == 1 and model.narrow:
            first, pair = _groups((key << K.U64(32)) | x)
        else:
            one, context = _groups(key)
            first, pair = _pairs(context, len(one), x)
        n = np.bincount(pair, weights=s.train[s.docs()[s.pos]], minlength=len(first))
        hot, many, own = count[first] >= model.hot, K.U64(model.buckets), key[first]
        self.many = model.buckets
        self.front = K.U64(32 if level == 2 else 0) if level == 1 or level == 2 and model.narrow else None
        if self.front is None:
            bucket = _slice_of(own, model.buckets)
        elif level == 1:
            bucket = own % many
        else:  # contexts of one later word stay together, up to the count of a hot context
            shares = np.ceil(up[first] / model.hot).astype(K.U64)
            bucket = ((own >> self.front) + K.mix(own) % shares) % many
        bucket = np.where(hot, K.mix(own + x[first] * _ODD) % many, bucket)
        order = _by_bucket(bucket, model.buckets)
        self.place = np.empty(len(order), dtype=np.int64)  # where each token's pair stands
        self.place[order] = np.arange(len(order))
        self.place = self.place[pair]
        at, bucket = first[order], bucket[order].astype(np.int64)
        self.key, self.x, self.n, self.up, self.after = key[at], x[at], n[order], up[at], after[at]
        # all training tokens after a context are in its bucket and add up to its count, except for hot ones
        self.hot_count = np.where(hot[order], count[at], 0)
        new = np.ones(len(at), dtype=bool)  # a context is named once in every message
        new[1:] = (self.key[1:] != self.key[:-1]) | (bucket[1:] != bucket[:-1])
        self.head = np.flatnonzero(new)
        self.context = np.cumsum(new) - 1   # of each pair
        begin = _starts(bucket)
        self.buckets, self.edges = bucket[begin], np.append(begin, len(at))

    def messages(self) -> Iterator[tuple[int, bytes]]:
        cut = np.searchsorted(self.head, self.edges)
        for b, lo, hi, i, j in zip(self.buckets.tolist(), self.edges[:-1], self.edges[1:], cut[:-1], cut[1:]):
            head = self.head[i:j]
            key, at = self.key[head], head - lo
            per = np.diff(np.append(head, hi)).astype("<u4")
            parts = [per, self.hot_count[head].astype("<u8"), self.n[lo:hi].astype("<u4")]
            if self.front is None:
                up = self.up[head].astype("<u8")
                parts += [np.diff(key, prepend=K.U64(0)), up, *[np.zeros(0, "<u4")] * 2, *_short(np.zeros(0))]
            else:  # the later word once, as a quotient by the buckets; what it leaves is mostly the bucket
                late, many = key >> self.front, K.U64(self.many)
                new = _starts(late)
                word = late[new]
                parts += [np.diff(word // many, prepend=K.U64(0)), _steps(self.up[head[new]]),
                          ((word % many + many - K.U64(b)) % many).astype("<u4"), np.diff(np.append(new, len(key))).astype("<u4"),
                          *_short(_rises(key & K.U64((1 << int(self.front)) - 1), new))]
            if self.level == 1:  # the count goes with the word alone
                words, first, which = np.unique(self.x[lo:hi], return_index=True, return_inverse=True)
                parts += [np.diff(words, prepend=K.U64(0)), _steps(self.after[lo:hi][first]), _rises(which.astype("<u4"), at)]
            else:
                parts += [*_short(_rises(self.x[lo:hi], at)), *_short(self.after[lo:hi])]
            yield b, _pack(*parts)


def _open(message: bytes, level: int, bucket: int, model: Model) -> tuple[np.ndarray, ...]:
    """Contexts: key, count if hot, count of the shorter one. By pair: row of the context, word, count after the shorter
    context, training count."""
    per, count, n, step, up, left, runs, *got = _unpack(message, "<u4", "<u8", "<u4", "<u8", "<u8", "<u4", "<u4", *_SHORT,
                                                        *(("<u8", "<u8", "<u4") if level == 1 else _SHORT * 2))
    early, got = _whole(*got[:3]), got[3:]
    key, at = np.cumsum(step), np.cumsum(per, dtype=np.int64) - per
    if len(runs):
        many, new = K.U64(model.buckets), np.cumsum(runs, dtype=np.int64) - runs
        key = np.repeat(key * many + (left.astype(K.U64) + K.U64(bucket)) % many, runs)
        up = np.repeat(_walk(up), runs)
        if level == 2:
            key = (key << K.U64(32)) | _climb(early, new, runs)
    if level == 1:
        which = _climb(got[2], at, per)
        x, after = np.cumsum(got[0])[which], _walk(got[1])[which]
    else:
        x, after = _climb(_whole(*got[:3]), at, per), _whole(*got[3:])
    return key, count, up, np.repeat(np.arange(len(per)), per), x, after, n


def _row(name: str, ids: pa.Array, chunk: Chunk) -> pa.RecordBatch:
    one_list = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([name]), one_list, pa.array([len(chunk.pos)], pa.int64()),
                                       pa.array([chunk.pack()], pa.binary())], names=["chunk", "ids", "open", "state"])


class Levels:
    """Tables of one run in a database of its own below the shared folder: chunks, bucketed by chunk so that
    replies come to them without moving them, and replies. A table goes once the next level is written."""

    def __init__(self, spark: SparkSession, id_type: T.DataType):
        self.spark, self.id_type, self.name = spark, id_type, f"lm_{uuid.uuid4().hex}"
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.schema = (T.StructType().add("chunk", "string").add("ids", T.ArrayType(id_type)).add("open", "long")
                       .add("state", "binary"))
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{fresh_path(spark, 'lm')}'")
        self.before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")

    def write(self, df: DataFrame, table: str, by: str | None = None) -> DataFrame:
        out = df.write.format("parquet").option("compression", "none")
        (out.bucketBy(self.parts, by) if by else out).saveAsTable(f"{self.name}.{table}")
        return self.spark.table(f"{self.name}.{table}")

    def drop(self, *tables: str) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE {self.name}.{t}")

    def close(self) -> None:
        self.spark.conf.set(CLEANUP, self.before)
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def pack_chunks(docs: DataFrame, levels: Levels, *, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Documents packed into chunks, all tokens open."""
    def chunk(ids: list[pa.Array], flags: list[bool], norms: list[bytes]) -> pa.RecordBatch:
        raw = b"\n".join(norms) + b"\n"
        starts, ends = K.word_spans(raw)
        words = K.word_hashes(raw, starts, ends)
        text_of = np.searchsorted(np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10), starts)
        x = np.full(len(words) + len(flags), K.END_WORD, dtype=K.U64)
        x[np.arange(len(words)) + text_of] = words
        names, word = np.unique(x, return_inverse=True)
        zero, none = np.zeros(len(flags)), np.zeros(0)
        per_doc = np.bincount(text_of, minlength=len(flags)) + 1
        state = Chunk(per_doc, np.asarray(flags), zero, zero, zero, word, names, none, np.arange(len(x)), none, none, none, none)
        return _row(uuid.uuid4().hex, pa.concat_arrays(ids), state)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, norms, size = [], [], [], 0
        for b in batches:
            for i, (f, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                norm = b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
                ids.append(b.column(0).slice(i, 1))
                flags.append(bool(f))
                norms.append(norm)
                size += len(norm) + 1
                if size >= CHUNK_BYTES:
                    yield chunk(ids, flags, norms)
                    ids, flags, norms, size = [], [], [], 0
        if ids:
            yield chunk(ids, flags, norms)

    rows = docs.select(F.col(id_col), train, F.col(text_col).cast("string"))
    return levels.write(rows.mapInArrow(task, levels.schema), "chunks_0", "chunk")


def _replies(rows: list[tuple], tests: list[tuple]) -> pd.DataFrame:
    out = [(c, b, r, 0, 0.0, 0, 0) for c, b, r in rows] + [(None, -1, None, *t) for t in tests]
    return pd.DataFrame(out, columns=["chunk", "bucket", "reply", "context", "gain", "n", "kinds"])


def count_words(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One bucket of words: rank in the bucket and training count of each, told to every chunk that has it. A word's
    number is made of rank and bucket."""
    asked = []
    for m in pdf["message"]:
        step, n = _unpack(m, "<u8", "<u4")
        asked.append((np.cumsum(step), n))
    kinds, kind = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
    total = np.bincount(kind, weights=np.concatenate([n for _, n in asked]), minlength=len(kinds)).astype("<u8")
    rank = np.empty(len(kinds), dtype=np.int64)  # frequent words get small numbers
    rank[np.argsort(total, kind="stable")[::-1]] = np.arange(len(kinds))
    rows, at = [], 0
    for chunk, (h, _) in zip(pdf["chunk"], asked):
        mine = kind[at:at + len(h)]
        rows.append((chunk, int(pdf["bucket"].iloc[0]), _pack(rank[mine].astype("<u8"), total[mine])))
        at += len(h)
    return _replies(rows, [(len(kinds) * buckets, 0.0, int(total.sum()), int((total > 0).sum()))])  # above all numbers


def judge_contexts(pdf: pd.DataFrame, level: int, model: Model) -> pd.DataFrame:
    """One bucket of contexts: totals, divergence tests and numbers of next words, told to every chunk that asked."""
    asked = [_open(m, level, int(b), model) for b, m in zip(pdf["bucket"], pdf["message"])]
    key, counts, up = (np.concatenate([q[i] for q in asked]) for i in range(3))
    heads = np.cumsum([0] + [len(q[0]) for q in asked])
    row = np.concatenate([q[3] + h for q, h in zip(asked, heads)])
    x, after, n = (np.concatenate([q[i] for q in asked]) for i in (4, 5, 6))
    one, which = _groups(key)
    size = len(one)
    first, pair = _pairs(which[row], size, x)
    total = np.bincount(pair, weights=n, minlength=len(first))
    seen = np.flatnonzero(total > 0)
    own, at = total[seen], row[first[seen]]
    add = lambda w: np.bincount(which[at], weights=w, minlength=size)
    sums, kinds = add(own), add(None).astype(np.int64)
    count = sums.copy()
    sent = np.flatnonzero(counts)
    count[which[sent]] = counts[sent]
    back, p = TEST_WEIGHT * count[which[at]], after[first[seen]] / up[at]
    gains = add(own * (np.log(own - 1 + back * p) - np.log(p)))
    is_hot = count >= model.hot
    verdict = np.where(is_hot, _HOT, _retained(gains, sums, count)).astype(np.uint8)
    rows, done = [], 0
    for chunk, bucket, q, a, z in zip(pdf["chunk"], pdf["bucket"], asked, heads[:-1], heads[1:]):
        mine = which[a:z]
        rows.append((chunk, bucket, _pack(total[pair[done:done + len(q[4])]].astype("<u8"), verdict[mine],
                                          _steps(kinds[mine]) if level == 1 else kinds[mine].astype("<u8"))))
        done += len(q[4])
    named = np.flatnonzero(is_hot)
    return _replies(rows, list(zip(key[one[named]].view(np.int64).tolist(), gains[named].tolist(),
                                   sums[named].astype(np.int64).tolist(), kinds[named].tolist())))


def _retained(gain: np.ndarray, n: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The divergence test; a context without training tokens fails."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = gain / n - np.log(np.maximum(n - 1, 0) + TEST_WEIGHT * count)
    return (n > 0) & (mean >= MIN_GAIN)


def start(s: Chunk, replies: list[bytes], buckets: int, model: Model) -> None:
    """Word counts are there: base scores; the tokens after a word that occurs often enough stay open."""
    got = [_unpack(r, "<u8", "<u8") for r in replies]
    order, into, _ = s.deal_words(buckets)
    number = np.concatenate([g[0] * K.U64(buckets) + K.U64(b) for g, b in zip(got, into.tolist())])
    by_number = np.argsort(number)  # frequent words first
    s.names, s.totals = number[by_number], np.concatenate([g[1] for g in got])[by_number]
    place = np.empty(len(order), dtype=np.int64)
    place[order[by_number]] = np.arange(len(order))
    s.words = place[s.words]
    count, doc = s.totals[s.words], s.docs()
    p = model.base(s.totals)[s.words]
    add = lambda v: np.bincount(doc, weights=v, minlength=len(s.per_doc))
    s.known, s.base = add(count > 0), add(np.log10(p))
    go = np.concatenate(([False], (doc[1:] == doc[:-1]) & (count[:-1] >= MIN_COUNT)))
    s.finish(np.flatnonzero(~go), p[~go])
    s.pos = np.flatnonzero(go)


def advance(s: Chunk, replies: list[bytes], level: int, big: pd.DataFrame, model: Model) -> None:
    """Contexts of ``level`` words are judged: smooth the retained ones in; tokens with longer ones to try stay open."""
    asked = Asked(s, level, model)
    got = [_unpack(r, "<u8", "u1", "<u8") for r in replies]
    total, verdict = (np.concatenate([g[i] for g in got]) for i in range(2))
    kinds = np.concatenate([_walk(g[2]) if level == 1 else g[2] for g in got])
    keep, kinds = verdict == _KEEP, kinds.astype(np.float64)
    hot = np.flatnonzero(verdict == _HOT)
    if len(hot):
        at = np.searchsorted(big["context"].to_numpy(), asked.key[asked.head[hot]].view(np.int64))
        keep[hot], kinds[hot] = big["keep"].to_numpy()[at], big["kinds"].to_numpy()[at]
    context, total = asked.context[asked.place], total[asked.place].astype(np.float64)
    keep, kinds = keep[context], kinds[context]
    p = np.where(keep, (total + kinds * asked.p) / (asked.count + kinds), asked.p)
    # a token and the one before it, whose run of words is the longer context of the token
    before = np.flatnonzero(s.pos[1:] == s.pos[:-1] + 1)
    go = (total[before] >= MIN_COUNT) & (kinds[before + 1] > 1)
    if level >= FREE_WORDS:
        go &= keep[before + 1]
    before = before[go]
    here = before + 1
    done = np.ones(len(s.pos), dtype=bool)
    done[here] = False
    s.finish(s.pos[done], p[done])
    s.pos, s.count, s.after = s.pos[here], total[before], total[here]
    if level == 1:
        s.aux = np.zeros(len(s.names))
        s.aux[s.words[s.pos - 1]] = np.where(keep, kinds, 0)[here]
    else:
        s.aux, s.p = asked.count[here], np.log10(p[here])
    if not len(here):
        s.words = s.names = s.totals = s.aux = np.zeros(0)
    else:  # words that no open token needs any more are cleared, so that they pack to nothing, and their names go
        needed = np.zeros(len(s.words), dtype=bool)
        for back in range(level + 2):
            needed[s.pos - back] = True
        named = np.zeros(len(s.names), dtype=bool)
        named[s.words[needed]] = True
        s.words = np.where(needed, (np.cumsum(named) - 1)[s.words], 0)
        s.names, s.totals = s.names[named], s.totals[named]
        if level == 1:
            s.aux = s.aux[named]


def score_documents(docs: DataFrame, *, train: Column, id_col: str = "doc_id", text_col: str = "text",
                    buckets: int | None = None) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    levels = Levels(docs.sparkSession, docs.select(F.col(id_col)).schema[0].dataType)
    try:
        return _score(docs, levels, train, id_col, text_col, buckets)
    finally:
        levels.close()


def _score(docs: DataFrame, levels: Levels, train: Column, id_col: str, text_col: str, buckets: int | None) -> DataFrame:

    def deal(table: DataFrame) -> int:
        return buckets or max(1, -(-int(table.agg(F.sum("open")).first()[0] or 0) // BUCKET_TOKENS))

    def ask(table: DataFrame, messages, answer, level: int, parts: int) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, packed in zip(b.column(0), b.column(1)):
                    into, said = zip(*messages(Chunk.unpack(packed.as_py())))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(into)), pa.array(into, pa.int64()),
                                                      pa.array(said, pa.binary())], names=["chunk", "bucket", "message"])

        said = table.filter("open > 0").select("chunk", "state").mapInArrow(task, "chunk string, bucket long, message binary")
        return levels.write(said.repartition(parts, "bucket").groupBy("bucket").applyInPandas(answer, REPLY_SCHEMA),
                            f"replies_{level}")

    def judge(level: int, model: Model):
        return lambda pdf: judge_contexts(pdf, level, model)

    def tell(table: DataFrame, replies: DataFrame, step, level: int) -> DataFrame:
        """The next level's table: every open chunk takes its replies, in the order of its buckets; the others stay."""
        answers = (replies.filter("chunk is not null").groupBy("chunk")
                   .agg(F.collect_list(F.struct("bucket", "reply")).alias("answers")))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, (name, packed, got) in enumerate(zip(b.column(0), b.column(2), b.column(3))):
                    state = Chunk.unpack(packed.as_py())
                    if len(state.pos):
                        step(state, [r["reply"] for r in sorted(got.as_py(), key=lambda r: r["bucket"])])
                    yield _row(name.as_py(), b.column(1).slice(i, 1).flatten(), state)

        out = levels.write(table.join(answers, "chunk", "left").select("chunk", "ids", "state", "answers")
                           .mapInArrow(task, levels.schema), f"chunks_{level + 1}", "chunk")
        levels.drop(f"chunks_{level}", f"replies_{level}")
        return out

    table = pack_chunks(docs, levels, train=train, id_col=id_col, text_col=text_col)
    parts = deal(table)
    replies = ask(table, lambda s: s.word_messages(parts), lambda pdf: count_words(pdf, parts), 0, parts)
    got = replies.filter("chunk is null").agg(F.sum("n"), F.sum("kinds"), F.max("context")).first()
    total = int(got[0] or 0)
    words = Model(total, int(got[1] or 0), parts, total, int(got[2] or 0) <= 1 << 32)
    table, level = tell(table, replies, lambda s, r: start(s, r, parts, words), 0), 0
    while table.filter("open > 0").select("open").first() is not None:
        level, many = level + 1, deal(table)
        model = Model(total, words.kinds, many, max(total / (HOT_SHARE * many), 1.0), words.narrow)
        replies = ask(table, lambda s, k=level, m=model: Asked(s, k, m).messages(), judge(level, model), level, many)
        big = (replies.filter("chunk is null").groupBy("context")
               .agg(F.sum("gain").alias("gain"), F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
               .toPandas().sort_values("context"))  # at most HOT_SHARE * buckets rows
        n = big["n"].to_numpy(dtype=np.float64)
        big["keep"] = _retained(big["gain"].to_numpy(dtype=np.float64), n, n)
        sent = docs.sparkSession.sparkContext.broadcast(big[["context", "keep", "kinds"]])
        table = tell(table, replies, lambda s, r, k=level, t=sent, m=model: advance(s, r, k, t.value, m), level)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, packed in enumerate(b.column(1)):
                s = Chunk.unpack(packed.as_py())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1).flatten(), pa.array(s.train.astype(bool)), pa.array(s.per_doc.astype(np.int64)),
                     pa.array(s.known.astype(np.int64)), pa.array(np.full(len(s.train), total), pa.int64()),
                     pa.array(s.base), pa.array(s.score)],
                    names=["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = (T.StructType().add("id", levels.id_type).add("trained", "boolean").add("n_tokens", "long").add("n_known", "long")
           .add("train_tokens", "long").add("base_score", "double").add("score", "double"))
    return stored(table.select("ids", "state").mapInArrow(rows, out), "lm-scores")
