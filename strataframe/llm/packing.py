"""Sequence packing by non-negative least squares over a length histogram.

A document longer than the window is cut into whole windows and a rest. The rests' lengths make a
histogram of a few hundred bins (exact up to an eighth of a percent of the window, else in steps of
that width). Length combinations of at most three parts that fill a window are enumerated, their repeat counts are solved by
non-negative least squares against the histogram and rounded, and what is left over is packed
greedily (best fit, longest first), again by bin and count. The plan's size depends on the window
alone. Each document then finds its place from its rank within its bin, so no task ever holds more
than an Arrow batch of documents, and a bin with a third of all rows is only a longer run of ranks.

Defined results: a null text counts as empty (one end id); a null or repeated document key stays
one row each; an empty table gives no pieces; only the named columns are read.
"""

from __future__ import annotations

import bisect
import warnings
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataframe.llm.common import BYTE_WORDS, Memo, materialize, slices

WINDOW, END_ID = 4096, 2
#: The table of rank offsets is broadcast up to this many bytes and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20
_words, _parts = Memo(400_000), Memo(1_000_000)
_tokenizer: dict = {}


def latin_split():
    """The vocabulary's pattern for lower-case Latin-1 text, where each class is a list of characters."""
    by = {"L": "", "N": "", "": ""}
    for c in map(chr, range(256)):
        if c not in "\t\n\v\f\r \x85\xa0":
            kind = unicodedata.category(c)[0]
            by[kind if kind in "LN" else ""] += re.escape(c)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{by['L']}]+|[{by['N']}]|[{by['']}]+").findall


class Parts:
    """The ids of the word-end BPE. Its pattern splits a text into parts that are encoded one by one and kept in a
    memo; many new parts are encoded as one text, as each one's last id is known by its word end. Text beyond
    Latin-1, or with marks of special tokens, goes word by word: the normaliser and the pattern never look across white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            form = json.load(f)
        self.split = latin_split()
        end = form["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in form["model"]["vocab"].items() if t.endswith(end)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def fill(self, new: list[str]) -> None:
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, stops = ids.tobytes(), (stops * 2).tolist()
                _parts.update((p, raw[i:j]) for p, i, j in zip(some, [0, *stops[:-1]], stops, strict=True))
            else:
                _parts.update((p, self.whole(p)) for p in some)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as '<u2' bytes."""
        parts, words, new = [], {}, set()
        for i, text in enumerate(texts):
            try:
                text.encode("latin-1")
                plain = "<|" not in text
            except UnicodeEncodeError:
                plain = False
            if plain:
                parts.append(self.split(text.lower()))
                new.update(parts[-1])
            else:
                parts.append([])
                words[i] = BYTE_WORDS.findall(text.encode())
        self.fill(_parts.missing(new))
        out = [b"".join(map(_parts.__getitem__, p)) for p in parts]
        _words.update((w, self.whole(w.decode())) for w in _words.missing(w for ws in words.values() for w in ws))
        for i, ws in words.items():
            out[i] = b"".join(map(_words.__getitem__, ws))
        return out


def parts_of(path: str) -> Parts:
    if path not in _tokenizer:
        for x in (_tokenizer, _words, _parts):
            x.clear()
        _tokenizer[path] = Parts(path)
    return _tokenizer[path]


def grid(window: int) -> int:
    return max(1, window // 512)


def bin_of(length: int, window: int) -> int:
    """The capacity that a rest of this length takes: itself up to 64, else rounded up to the grid."""
    g = grid(window)
    return length if length <= 64 else min(window, -(-length // g) * g)


def tokenize(docs: DataFrame, key: str, text: str, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per document: part and place in it, doc_id, n ids, ids as '<u2' bytes, the rest's bin and
    its rank among the part's rests of that bin. The result must be written before use: ranks are of one run."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = parts_of(path)
        part, rank, full = TaskContext.get().partitionId(), defaultdict(int), 0
        for batch in slices(batches):
            ids = [x + end for x in coder.ids([t or "" for t in batch.column(1).to_pylist()])]
            n, bins, ranks, fulls = [len(x) // 2 for x in ids], [], [], []
            for x in n:
                fulls.append(full)
                full += x // window
                b = bin_of(x % window, window)
                bins.append(b)
                ranks.append(rank[b])
                rank[b] += 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(bins, pa.int32()), pa.array(ranks, pa.int64()), pa.array(fulls, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "n", "bin", "rank", "full", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"part int, doc_id {kind}, n long, bin int, rank long, full long, ids binary")


def combinations(window: int, shortest: int = 65) -> np.ndarray:
    """All a <= b <= c (0: none) on the grid with a + b + c = window, as rows of grid units."""
    g = grid(window)
    units, least = window // g, -(-shortest // g)
    out = [(0, 0, units)]
    out += [(0, b, units - b) for b in range(least, units // 2 + 1)]
    for a in range(least, units // 3 + 1):
        b = np.arange(a, (units - a) // 2 + 1)
        out += zip([a] * len(b), b.tolist(), (units - a - b).tolist(), strict=True)
    return np.array(out, np.int64)


def nnls(parts: np.ndarray, target: np.ndarray, rounds: int = 400, add: int = 12, tol: float = 1e-3) -> np.ndarray:
    """Active-set non-negative least squares for min |A x - target|, where column j of A counts the parts[j].
    Several columns enter at a time; the inner loop steps back to the feasible set as Lawson and Hanson do."""
    m, x = len(target), np.zeros(len(parts))
    active: list[int] = []

    def columns(js: list[int]) -> np.ndarray:
        a = np.zeros((m, len(js)))
        for row in parts[js].T:
            np.add.at(a, (row, np.arange(len(js))), 1.0)
        a[0] = 0
        return a

    for _ in range(rounds):
        a = columns(active)
        r = target - a @ x[active]
        r[0] = 0
        w = r[parts].sum(axis=1)
        w[active] = 0
        best = [j for j in np.argsort(-w)[:add].tolist() if w[j] > tol * max(1.0, target.max())]
        if not best:
            break
        active += best
        while active:
            a = columns(active)
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ target)
            old = x[active]
            if (s > 0).all():
                x[active] = s
                break
            low = s <= 0
            step = min(1.0, float((old[low] / np.maximum(old[low] - s[low], 1e-300)).min()))
            x[active] = np.maximum(old + step * (s - old), 0)
            gone = low & (x[active] <= 1e-9)
            if not gone.any():
                gone = low
            x[np.array(active)[gone]] = 0
            active = [j for j, g in zip(active, gone.tolist(), strict=True) if not g]
    else:
        warnings.warn(f"least squares stopped after {rounds} rounds; the greedy rest packs what they left", stacklevel=2)
    return x


def greedy(left: dict[int, int], window: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, over (length, count) alone: [(((length, copies), ...), sequences), ...]."""
    spaces: list[int] = []
    open_: dict[int, list] = defaultdict(list)

    def put(space: int, made: tuple, n: int) -> None:
        if n:
            if not open_[space]:
                bisect.insort(spaces, space)
            open_[space].append((made, n))

    for length in sorted(left, reverse=True):
        c = left[length]
        while c > 0:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                made, n = open_[space].pop()
                if not open_[space]:
                    spaces.pop(at)
            else:
                space, made, n = window, (), -(-c // (window // length))
            j = space // length
            whole, over = min(n, c // j), 0
            put(space - j * length, (*made, (length, j)), whole)
            c -= whole * j
            if whole < n and c > 0:
                over, k = 1, min(j, c)
                put(space - k * length, (*made, (length, k)), 1)
                c -= k
            if made:
                put(space, made, n - whole - over)
    return [x for group in open_.values() for x in group]


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """What each sequence holds and how many there are: [(((bin, copies), ...), sequences), ...]. Places
    for every document of the histogram, and for no more."""
    g = grid(window)
    left = {b: c for b, c in histogram.items() if b and c}
    target = np.zeros(window // g + 1)
    for b, c in left.items():
        if b > 64 and b % g == 0:
            target[b // g] = c
    out = []
    if target.any():
        parts = combinations(window)
        parts = parts[((target[parts] > 0) | (parts == 0)).all(axis=1)]
        x = nnls(parts, target) if len(parts) else np.zeros(0)
        for j in np.argsort(-x):
            if (n := int(round(x[j]))) <= 0:
                break
            need = defaultdict(int)
            for u in parts[j].tolist():
                if u:
                    need[u * g] += 1
            n = min([n, *(left.get(b, 0) // k for b, k in need.items())])
            if n > 0:
                out.append((tuple(sorted(need.items(), reverse=True)), n))
                for b, k in need.items():
                    left[b] -= n * k
    return out + greedy({b: c for b, c in left.items() if c}, window)


def places(plan_: list) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """By bin: where each range of ranks starts, and its (first sequence, copies, order in the sequence)."""
    starts, what, taken, first = defaultdict(list), defaultdict(list), defaultdict(int), 0
    for made, n in plan_:
        for order, (b, copies) in enumerate(made):
            starts[b].append(taken[b])
            what[b].append((first, copies, order))
            taken[b] += n * copies
        first += n
    return {b: (starts[b], what[b]) for b in starts}


def place(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """tokens: as of tokenize(), written. One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    slot (order in the sequence) and ids as little-endian unsigned 32-bit bytes."""
    counts = tokens.where("bin > 0").groupBy("part", "bin").agg(F.count("*").alias("c"))
    counts = materialize(counts, "pack-counts")
    histogram = {r.bin: r.c for r in counts.groupBy("bin").agg(F.sum("c").alias("c")).collect()}  # one row per bin
    where = places(plan(histogram, window))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "bin", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    if counts.count() * 64 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols, docs = defaultdict(list), []
            for i, (part, n, b, rank, full, base, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "n", "bin", "rank", "full", "base", "ids")), strict=True)):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                todo = [(k * window, window, (part + 1 << 40) + full + k, 0) for k in range(n // window)]
                if n % window:
                    starts, what = where[b]
                    at = bisect.bisect_right(starts, rank + base) - 1
                    first, copies, order = what[at]
                    k = rank + base - starts[at]
                    todo.append((n - n % window, n % window, first + k // copies, order * window + k % copies))
                for start, length, sequence, slot in todo:
                    docs.append(i)
                    for c, v in (("start", start), ("length", length), ("doc_tokens", n), ("sequence_id", sequence), ("slot", slot)):
                        cols[c].append(v)
                    cols["ids"].append(wide[start : start + length].tobytes())
            arrays = [batch.column("doc_id").take(pa.array(docs, pa.int64())), *(pa.array(cols[c], pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "slot")), pa.array(cols["ids"], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "slot", "ids"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.join(offsets, ["part", "bin"], "left").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, slot long, ids binary")


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds each piece's offset in its sequence; a sequence has at most as many pieces as the window has ids."""
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The operator: documents to pieces with their ids (see place), without offsets."""
    return place(materialize(tokenize(docs, key, text, path, window), "pack-tokens"), window)


def digest(docs: DataFrame, path: str) -> DataFrame:
    pieces = pack(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_offsets(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
