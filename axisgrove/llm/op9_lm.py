"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

1. Unigrams. Tasks count the hashes of their tokens and send the counts, packed and sorted, to the shard of each hash.
   From the merged counts come N, V and the hot tokens (more than a quarter of a shard's fair share; at most four a
   shard). There is a shard for each SHARD_BYTES of text, so that they stay alike in size as the corpus grows, MOST at
   most.
2. Bigrams. Tasks count pairs and send them to the shard of the first word; the pairs of a hot first word are spread
   over as many shards as its count asks for. A shard's task merges the counts, writes the sorted pair hashes, their
   counts and each context's statistics to the shared folder, and sends on how many distinct words precede each word.
3. The shards of the words write raw and continuation counts, sorted by hash.
4. Scoring tasks memory-map the arrays and look tokens up by binary search; where the shared folder is not mounted they
   read them, and hold a bounded number of bytes. The driver has the list of files, so a lost one raises. Only the
   discounts, totals and the hot contexts' statistics (a few numbers a shard) pass through the driver.

Merging tasks take their rows batch by batch and hold a shard's sums.

Discounts come from the counts of counts of the order at hand (Chen and Goodman's three). The order is 2: a third
order's counts would be several times the text, see the README.

Tokens are words with A-Z lower-cased, then one end a text; they stand for themselves as 64-bit hashes. Files are
written under a temporary name and renamed, so that a task which runs again changes nothing.

Defined results: null text counts as empty and has the end only; without training rows every token is unknown, both
scores are 0 and the perplexity is 1; repeated rows train and are scored each; an empty table gives an empty result; columns other than id and
text are not read.
"""

from __future__ import annotations

import collections
import io
import json
import math
import mmap
import os
import sys
import uuid
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens_np
from .common import fold, shared_dir, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEGIN, END = np.uint64(0x5BD1E995C6A4A793), np.uint64(0xD6E8FEB86659FD93)
CHUNK = 3_000_000  # tokens that a task counts at once
SHARD_BYTES, FEWEST, MOST = 12 << 20, 4, 32_768  # text a shard, and shards
FOLD = 4_000_000  # pairs or words that a merging task gathers before it adds them up
PACKED = "shard int, kind int, data binary"


# --- arrays to and from bytes and files


def pack(*arrays: np.ndarray) -> bytes:
    """Sorted hashes first, as they are; the counts that follow shrink well."""
    out = io.BytesIO()
    np.save(out, arrays[0])
    for a in arrays[1:]:
        small = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        body = io.BytesIO()
        np.save(body, small)
        z = zlib.compress(body.getvalue(), 1)
        out.write(len(z).to_bytes(8, "little"))
        out.write(z)
    return out.getvalue()


def unpack(data: bytes) -> list[np.ndarray]:
    src = io.BytesIO(data)
    out = [np.load(src)]
    while head := src.read(8):
        out.append(np.load(io.BytesIO(zlib.decompress(src.read(int.from_bytes(head, "little"))))))
    return out


def put(root: str, name: str, **arrays: np.ndarray) -> None:
    """One file of several arrays, which appears whole or not at all: it is written under another name and renamed. All
    attempts of a task write the same bytes."""
    head, at, body = {}, 0, []
    for k, v in arrays.items():
        head[k] = (v.dtype.str, list(v.shape), at)
        body.append(v.tobytes() + bytes(-v.nbytes % 64))
        at += len(body[-1])
    first = json.dumps(head).encode()
    first += b" " * (-(8 + len(first)) % 64)
    body = [len(first).to_bytes(8, "little"), first, *body]
    part = f".{name}.{uuid.uuid4().hex}"
    if root.startswith("file:"):
        path = local(root)
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{part}", "wb") as f:
            f.writelines(body)
        os.replace(f"{path}/{part}", f"{path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{part}") as f:
            f.write(b"".join(body))
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            store.move(f"{path}/{part}", f"{path}/{name}")
        else:
            store.delete_file(f"{path}/{part}")


def local(root: str) -> str:
    return "/" + root[5:].lstrip("/")


def get(root: str, name: str) -> tuple[dict[str, np.ndarray], int]:
    """The arrays of a file, and the bytes of memory they take: none where the shared folder is mounted and the file is
    mapped. A file that is not there raises."""
    if root.startswith("file:"):
        with open(f"{local(root)}/{name}", "rb") as f:
            data, taken = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED), 0
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(f"{root}/{name}")
        with store.open_input_file(path) as f:
            data = f.read()
        taken = len(data)
    start = 8 + int.from_bytes(data[:8], "little")
    head = json.loads(bytes(data[8:start]))
    return {k: np.frombuffer(data, dtype=t, count=math.prod(shape), offset=start + at).reshape(shape) for k, (t, shape, at) in head.items()}, taken


#: Where Python allows it, a map holds no file descriptor, so that there can be thousands.
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


class Shelf:
    """The files that a scoring task has open: at most MAPS, and at most HELD bytes of those that cannot be mapped; the
    one used longest ago goes first."""

    MAPS, HELD = 30_000 if UNTRACKED else 600, 256 << 20

    def __init__(self, root: str, names: frozenset) -> None:
        self.root, self.names, self.open, self.held = root, names, collections.OrderedDict(), 0

    def look(self, name: str) -> dict[str, np.ndarray] | None:
        """None for a shard that nothing was written for."""
        if name not in self.names:
            return None
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = get(self.root, name)
            self.held += self.open[name][1]
            while len(self.open) > 1 and (len(self.open) > self.MAPS or self.held > self.HELD):
                self.held -= self.open.popitem(last=False)[1][1]
        return self.open[name][0]


# --- tokens


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before it, first token of each row and the end); each row ends with END and begins after BEGIN."""
    hashes, first = tokens_np.words(data, offsets)
    n = len(offsets) - 1
    starts = first + np.arange(n + 1)
    out = np.empty(len(hashes) + n, dtype=np.uint64)
    ends = np.zeros(len(out), dtype=bool)
    ends[starts[1:] - 1] = True
    out[ends], out[~ends] = END, hashes
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[starts[:-1][starts[:-1] < len(out)]] = BEGIN
    return out, before, starts


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    c = np.ones(len(k), dtype=np.uint64) if counts is None else counts[order].astype(np.uint64)
    return k[at], np.add.reduceat(c, at)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tokens_np.mix(a * tokens_np.STEP + (b ^ (a >> np.uint64(29))))


def pair_shard(a: np.ndarray, b: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shard of pairs: that of the first word, and for a hot one the next `spread` ones by the second word."""
    s = shard_of(tokens_np.mix(a), shards)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], a), len(hot[0]) - 1)
        is_hot = hot[0][at] == a
        s[is_hot] = (s[is_hot] + (tokens_np.mix(b[is_hot]) % hot[1][at[is_hot]]).astype(np.int64)) % shards
    return s


def _rows(rows: list):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "kind", "data"])


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys, and the end."""
    return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))


def count_unigrams(shards: int):
    def run(batches):
        held: list = []

        def flush():
            k, c = summed(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held.clear()
            at = _cut(k, shards)
            return _rows([(s, 0, pack(k[at[s] : at[s + 1]], c[at[s] : at[s + 1]])) for s in range(shards) if at[s] < at[s + 1]])

        n = 0
        for batch in batches:
            for _, _, data, offsets in tokens_np.pieces(batch.column(0)):
                held.append(summed(tokens(data, offsets)[0]))
                n += len(held[-1][0])
                if n > CHUNK:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def unpacked(batches, kinds: tuple | None = None):
    """(shard, kind, arrays) of packed rows, one by one."""
    for batch in batches:
        names = batch.schema.names
        shards, data = batch.column(names.index("shard")), batch.column(names.index("data"))
        kind = batch.column(names.index("kind"))
        for i in range(batch.num_rows):
            yield shards[i].as_py(), kind[i].as_py(), data[i].as_py()


class Sums:
    """Sums of counts by hash, added up whenever FOLD of them have come together."""

    def __init__(self) -> None:
        self.keys, self.counts, self.parts, self.n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n > FOLD:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            parts = [(self.keys, self.counts), *self.parts]
            self.parts, self.n = [], 0
            self.keys, self.counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c.astype(np.uint64) for _, c in parts]))
        return self.keys, self.counts


def merge_unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, shard = Sums(), 0
    for shard, _, data in unpacked(batches):
        sums.add(*unpack(data))
    k, c = sums.result()
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack(k, c)], pa.binary()), pa.array([int(c.sum())]), pa.array([len(k)])], names=["shard", "data", "tokens", "types"])


def hot_tokens(least: int):
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                k, c = unpack(data)
                big = c > least
                yield pa.RecordBatch.from_arrays([pa.array(k[big].view(np.int64)), pa.array(c[big].astype(np.int64))], names=["h", "c"])

    return run


def count_bigrams(shards: int, hot: tuple[np.ndarray, np.ndarray]):
    def run(batches):
        held: list = []

        def flush():
            a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            s = pair_shard(a, b, shards, hot)
            order = np.lexsort((b, a, s))
            a, b, s = a[order], b[order], s[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            c = np.diff(np.append(at, len(a)))
            a, b, s = a[at], b[at], s[at]
            cut = np.searchsorted(s, np.arange(shards + 1))
            rows = []
            for k in range(shards):
                lo, hi = cut[k], cut[k + 1]
                if lo < hi:
                    runs = np.flatnonzero(np.concatenate([[True], a[lo + 1 : hi] != a[lo : hi - 1]]))
                    first = a[lo:hi][runs]
                    rows.append((k, 1, pack(np.concatenate([first, b[lo:hi]]), np.diff(np.append(runs, hi - lo)), c[lo:hi])))
            return _rows(rows)

        n = 0
        for batch in batches:
            for _, _, data, offsets in tokens_np.pieces(batch.column(0)):
                b, a, _ = tokens(data, offsets)
                held.append((a, b))
                n += len(a)
                if n > CHUNK:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def merge_bigrams(root: str, shards: int, hot: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, n = tuple(np.zeros(0, dtype=np.uint64) for _ in range(4)), [], 0

        def added() -> tuple:
            key, a, b, c = (np.concatenate([h, *p]) for h, p in zip(held, zip(*parts))) if parts else held
            order = np.argsort(key)
            key, a, b, c = key[order], a[order], b[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[at], a[at], b[at], np.add.reduceat(c, at)

        shard = 0
        for shard, _, data in unpacked(batches):
            keys, runs, c = unpack(data)
            a, b = np.repeat(keys[: len(runs)], runs), keys[len(runs) :]
            parts.append((pair_key(a, b), a, b, c.astype(np.uint64)))
            n += len(a)
            if n > FOLD:
                held, parts, n = added(), [], 0
        key, a, b, c = added()
        del held, parts
        pair = {"key": key, "count": c.astype(np.min_scalar_type(int(c.max())))}
        # contexts: total, and the numbers of words seen once, twice and more often
        order = np.argsort(a)
        a, ca = a[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        stats = np.stack([np.add.reduceat(x.astype(np.uint64), at) for x in (ca, ca == 1, ca == 2, ca >= 3)], axis=1)
        first = a[at]
        is_hot = np.isin(first, hot[0])
        put(root, f"pair{shard}", **pair, context=first[~is_hot], stats=stats[~is_hot].astype(np.min_scalar_type(int(stats[~is_hot].max()) if (~is_hot).any() else 0)))
        words, preceding = summed(b)
        cut = _cut(words, shards)
        rows = [(s, 2, pack(words[cut[s] : cut[s + 1]], preceding[cut[s] : cut[s + 1]])) for s in range(shards) if cut[s] < cut[s + 1]]
        rows.append((-1 - shard, 3, pack(first[is_hot], stats[is_hot].reshape(-1), np.array(counts_of_counts(c), dtype=np.uint64))))
        yield _rows(rows)

    return run


def write_words(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Raw counts (kind 0) and continuation counts (2) of a shard's words; statistics (3) pass through."""
        sums, shard = {0: Sums(), 2: Sums()}, 0
        for shard, kind, data in unpacked(batches):
            if kind == 3:
                yield _rows([(shard, kind, data)])
            else:
                sums[kind].add(*unpack(data))
        if shard < 0:
            return
        raw, cont = sums[0].result(), sums[2].result()
        both = np.zeros(len(raw[0]), dtype=np.uint64)
        both[np.searchsorted(raw[0], cont[0])] = cont[1]
        put(root, f"word{shard}", word=raw[0], raw=raw[1].astype(np.min_scalar_type(int(raw[1].max()))), cont=both.astype(np.min_scalar_type(int(both.max()))))
        yield _rows([(shard, 4, pack(np.zeros(0, dtype=np.uint64), np.array([*counts_of_counts(both), int(both.sum()), int((both >= 3).sum())], dtype=np.uint64)))])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the counts of counts; 0.5, 1 and 1.5 where those say nothing."""
    n1, n2, n3, n4 = map(float, n)
    if not n1 or not n2:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)])


class Model:
    """What scoring needs beside the files: their names, totals, discounts and the hot contexts' statistics."""

    def __init__(self, root: str, shards: int, n: int, v: int, hot: tuple, rows: list) -> None:
        self.root, self.shards, self.n, self.v, self.hot = root, shards, n, v, hot
        self.hot_stats = np.zeros((len(hot[0]), 4))
        self.files = frozenset(f"pair{-1 - shard}" if kind == 3 else f"word{shard}" for shard, kind, _ in rows)
        bi, uni = np.zeros(4), np.zeros(6)
        for _, kind, data in rows:
            if kind == 3:
                h, stats, counts = unpack(data)
                np.add.at(self.hot_stats, np.searchsorted(hot[0], h), stats.reshape(-1, 4).astype(float))
                bi += counts
            else:
                uni += unpack(data)[1]
        self.d2, self.d1 = discounts(bi), discounts(uni[:4])
        self.pairs = float(uni[4])
        self.gamma1 = float((self.d1 * [uni[0], uni[1], uni[5]]).sum() / self.pairs) if self.pairs else 1.0

    def find(self, keys: np.ndarray, shards: np.ndarray, file: str, index: str, values: tuple, width: int, shelf: Shelf) -> np.ndarray:
        """The values of keys (0 where there is none), shard by shard."""
        out = np.zeros((len(keys), width))
        order = np.argsort(shards, kind="stable")
        cut = np.searchsorted(shards[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            has = shelf.look(f"{file}{s}")
            if has and len(has[index]):
                rows = order[cut[s] : cut[s + 1]]
                at = np.minimum(np.searchsorted(has[index], keys[rows]), len(has[index]) - 1)
                hit = has[index][at] == keys[rows]
                for k, name in enumerate(values):
                    got = has[name][at[hit]]
                    if got.ndim == 2:
                        out[rows[hit]] = got
                    else:
                        out[rows[hit], k] = got
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray, shelf: Shelf) -> tuple:
        """(tokens, known tokens, base score, model score) of each row."""
        tok, before, starts = tokens(data, offsets)
        words, of = np.unique(tok, return_inverse=True)
        raw, cont = self.find(words, shard_of(words, self.shards), "word", "word", ("raw", "cont"), 2, shelf).T
        base = np.log10((raw + 1) / (self.n + self.v + 1))[of]
        back = lambda c, d: np.maximum(c - np.where(c <= 0, 0, d[np.clip(c, 1, 3).astype(int) - 1]), 0)
        p1 = ((back(cont, self.d1) / self.pairs if self.pairs else 0) + self.gamma1 / (self.v + 1))[of]
        heads, at = np.unique(before, return_inverse=True)
        stats = self.find(heads, shard_of(tokens_np.mix(heads), self.shards), "pair", "context", ("stats",), 4, shelf)
        if len(self.hot[0]):
            k = np.minimum(np.searchsorted(self.hot[0], heads), len(self.hot[0]) - 1)
            is_hot = self.hot[0][k] == heads
            stats[is_hot] = self.hot_stats[k[is_hot]]
        total = stats[:, 0]
        gamma = np.where(total > 0, (stats[:, 1:] * self.d2).sum(axis=1) / np.maximum(total, 1), 1.0)
        c = self.find(pair_key(before, tok), pair_shard(before, tok, self.shards, self.hot), "pair", "key", ("count",), 1, shelf)[:, 0]
        p = back(c, self.d2) / np.maximum(total, 1)[at] + gamma[at] * p1
        add = lambda x: np.add.reduceat(x, starts[:-1])
        return np.diff(starts), add((raw > 0).astype(np.int64)[of]), add(base), add(np.log10(p))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of all rows of docs."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    if ":" not in root.split("/")[0]:
        root = "file://" + root
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST, max(FEWEST, -(-size // SHARD_BYTES)))
    uni = texts.mapInArrow(count_unigrams(shards), PACKED).groupBy("shard").applyInArrow(merge_unigrams, "shard int, data binary, tokens bigint, types bigint")
    uni.write.parquet(f"{root}/unigrams")
    uni = spark.read.schema(uni.schema).parquet(f"{root}/unigrams")
    n, v = (x or 0 for x in uni.agg(F.sum("tokens"), F.sum("types")).first())
    least = max(1000, n // (4 * shards))
    found = sorted((r["h"] % 2**64, r["c"]) for r in uni.select("data").mapInArrow(hot_tokens(least), "h bigint, c bigint").collect())
    hot = (np.array([h for h, _ in found], dtype=np.uint64), np.array([min(shards, 1 + c * shards // n) for _, c in found], dtype=np.uint64))
    pairs = texts.mapInArrow(count_bigrams(shards, hot), PACKED).groupBy("shard").applyInArrow(merge_bigrams(f"{root}/files", shards, hot), PACKED)
    done = pairs.unionByName(uni.select("shard", F.lit(0).alias("kind"), "data")).groupBy("shard").applyInArrow(write_words(f"{root}/files"), PACKED)
    return Model(f"{root}/files", shards, n, v, hot, sorted((r["shard"], r["kind"], bytes(r["data"])) for r in done.collect()))


def scorer(model: Model):
    def run(batches):
        shelf = Shelf(model.root, model.files)
        for batch in batches:
            for lo, hi, data, offsets in tokens_np.pieces(batch.column(1), 3_000_000):
                n, known, base, score = model.score(data, offsets, shelf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_tokens, n_known, base_score (add-one unigram), score (log10 probability of the text) and
    perplexity (of a token, so that long and short texts compare)."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.mapInArrow(scorer(model), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return d.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id"), 7) != 2))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")
