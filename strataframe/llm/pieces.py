"""Sampled segmentations over a SentencePiece vocabulary, and their lossless decoding.

A text is cut into segments, each a run of other characters with all spaces before it (one space is put before the
text), and further where no piece can span the cut: pieces may be of several spaces. Over a segment's lattice of pieces the forward filter sums
the weights of all ways to each place; the backward sampler then draws pieces from the end, each in
proportion to the weight of the ways through it. Weights follow the pieces' ranks: (rank + 10) ** -theta. A score
that is no rank (pieces of several spaces have -1e9) is replaced by the piece's place in the vocabulary.
Every draw is a hash of seed, row key, segment and step: neither partitions nor retries change a result.

Characters that no piece spells, and a literal block mark, go through the byte pieces, so that decoding gives
back the very text. Lattices are kept in a bounded memo per worker; whole texts are read, batch by batch.

Defined results: null text has null ids and decodes to null; an empty text has no ids; rows with equal
keys and texts get equal segmentations, and a null key is the key of an empty text; ids that no piece has are an error; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import GOLDEN, mix, runs, slices

BLOCK, THETA, SEED = "▁", 1.5, 0
STEP = np.uint64(0xD1342543DE82EF95)
MASK, HIGH = (1 << 22) - 1, np.uint64(42)
#: Runs with the spaces before them.
SEGMENTS = re.compile(" *[^ ]+| +").findall


def cutter(names):
    """Cuts a text into segments: between letters and others too, if no piece mixes them; not at all, if a piece has a
    space behind another character."""
    if any(BLOCK in n.lstrip(BLOCK) for n in names):
        return lambda text: [text]
    one_kind = regex.compile(rf"{BLOCK}*(?:\p{{L}}+|[^\p{{L}} ]+)?").fullmatch
    return regex.compile(r" *\p{L}+| *[^\p{L} ]+| +").findall if all(map(one_kind, names)) else SEGMENTS


class Lattices:
    """The vocabulary, and the lattices of many segments at once. Node and edge arrays hold all lattices one after
    another: a segment of n characters has n + 1 nodes, and an edge leads back from a node to an earlier one
    by a piece, or by -1 - c for the byte pieces of character c."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.zeros(256, np.int32)
        self.spelt: list[bytes | None] = [None] * sp.vocab_size()
        names = {}
        for i in range(sp.vocab_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.spelt[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                names[name] = i
                self.spelt[i] = name.replace(BLOCK, " ").encode()
        spelt = [b or b"" for b in self.spelt]
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)
        self.n_bytes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        place = min(names.values())
        ranks = np.array([max(0.0, -sp.get_score(i)) if -sp.get_score(i) <= sp.vocab_size() else i - place for i in names.values()])
        self.longest = max(map(len, names))
        self.cut = cutter(names)
        self.least = -theta * np.log(10.0 + sp.vocab_size())
        hashes = self.rolled(names)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.logw = hashes[order], np.array(list(names.values()), np.int64)[order], (-theta * np.log(10.0 + ranks))[order]
        self.starts = np.zeros(MASK + 1, bool)  # which hashes, by their first bits, are of a piece's beginning
        self.starts[self.rolled({n[:k] for n in names for k in range(1, len(n) + 1)}) >> HIGH] = True
        # two tables from bits of a hash to a piece; the second has those whose place in the first is taken
        self.one, self.two = np.zeros(MASK + 1, np.int32), np.zeros(MASK + 1, np.int32)
        self.one[self.hashes >> HIGH] = np.arange(len(self.hashes))
        for i in np.flatnonzero(self.one[self.hashes >> HIGH] != np.arange(len(self.hashes))):
            self.two[int(self.hashes[i] >> np.uint64(20)) & MASK] = i
        if (self.hashes[self.find(self.hashes)] != self.hashes).any():
            raise ValueError("two pieces have one place in both tables")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, if there is one."""
        first = self.one[h >> HIGH]
        other = np.flatnonzero(self.hashes[first] != h)
        first[other] = self.two[(h[other] >> np.uint64(20)) & np.uint64(MASK)]
        return first

    def rolled(self, names) -> np.ndarray:
        out = np.zeros(len(names), np.uint64)
        for k, name in enumerate(names):
            h = np.zeros(1, np.uint64)
            for c in name:
                h = self.roll(h, np.array([ord(c)], np.uint64))
            out[k] = h[0]
        return out

    @staticmethod
    def roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h + code + np.uint64(1)) * GOLDEN

    def build(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """last node by segment; where its edges end by node; by edge, in the order of nodes: node plus the share of
        the ways up to it, steps back, piece."""
        plain = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        first = np.cumsum(size) - size
        code = np.where(plain == ord(BLOCK), np.uint64(0x110000), plain)
        code[plain == 32] = ord(BLOCK)
        place = runs(size)
        node = np.arange(len(code)) + np.repeat(np.arange(len(segments)), size)  # where each character begins
        left = np.repeat(size, size) - place
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        count, found = np.zeros(len(code) + len(segments), np.int64), []
        for k in range(1, self.longest + 1):
            own = left[at] >= k
            at, h = at[own], h[own]
            if not len(at):
                break
            h = self.roll(h, code[at + k - 1])
            hit = self.find(h)
            is_ = self.hashes[hit] == h
            if k == 1:  # each character ends somewhere
                found.append((node + 1, np.where(is_, self.ids[hit], -1 - plain.astype(np.int64)), np.where(is_, self.logw[hit], self.least)))
            else:
                found.append((node[at[is_]] + k, self.ids[hit[is_]], self.logw[hit[is_]]))
            count[found[-1][0]] += 1
            own = self.starts[h >> HIGH]
            at, h = at[own], h[own]
        edge_end = np.cumsum(count)
        free, n = edge_end - count, int(edge_end[-1])
        back, piece, logw, key = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for k, (end, some, w) in enumerate(found, 1):
            slot = free[end]
            back[slot], piece[slot], logw[slot] = k, some, w
            free[end] += 1
        source = np.repeat(np.arange(len(count)), count) - back
        depth = np.zeros(len(count), np.int64)
        depth[node + 1] = place + 1
        by_depth = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(depth))]
        ways = np.zeros(len(count))
        for a, b in zip(bounds[1:-1].tolist(), bounds[2:].tolist(), strict=True):  # all nodes of a depth, in step
            nodes = by_depth[a:b]
            n = count[nodes]
            start = np.cumsum(n) - n
            e = np.repeat(edge_end[nodes] - n - start, n) + np.arange(start[-1] + n[-1])
            x = ways[source[e]] + logw[e]
            top = np.maximum.reduceat(x, start)
            x = np.exp(x - np.repeat(top, n))
            total = np.add.reduceat(x, start)
            ways[nodes] = top + np.log(total)
            c = np.cumsum(x)
            c = (c - np.repeat(c[start] - x[start], n)) / np.repeat(total, n)
            c[start + n - 1] = 1.5  # above any draw, however rounded
            key[e] = np.repeat(nodes, n) + c
        return first + np.arange(len(segments)) + size, edge_end, key, back, piece

    def sample(self, texts: list[str], keys: list[str], seed: int = SEED) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        flat = [s for ss in cut for s in ss]
        n = np.array([len(ss) for ss in cut], np.int64)
        row = np.array([xxhash.xxh3_64_intdigest(k.encode(), seed=seed) for k in keys], np.uint64)
        if not flat:
            return [np.zeros(0, np.int32) for _ in texts]
        new = list(set(flat))
        number = np.fromiter(map(dict(zip(new, range(len(new)), strict=True)).__getitem__, flat), np.int64, len(flat))
        last, edge_end, key, back, piece_of = self.build(new)
        with np.errstate(over="ignore"):
            state = mix(np.repeat(row, n) + runs(n).astype(np.uint64) * GOLDEN)
        node = last[number]
        lengths = np.fromiter(map(len, new), np.int32, len(new))[number]  # characters left
        live, out = np.arange(len(flat)), []
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > 0]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                x = state[live] + np.uint64(step + 1) * STEP
                x = (x ^ (x >> np.uint64(32))) * GOLDEN
                u = ((x ^ (x >> np.uint64(29))) * STEP >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = node[live]
            edge, u = edge_end[at - 1], u + at
            on = np.flatnonzero(key[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[key[edge[on]] <= u[on]]
            out.append((live, piece_of[edge]))
            node[live] -= back[edge]
            lengths[live] -= back[edge]
        drawn = np.bincount(np.concatenate([own for own, _ in out]), minlength=len(flat))
        piece, end = np.zeros(drawn.sum(), np.int64), np.cumsum(drawn)
        for step, (at, some) in enumerate(out):  # pieces were drawn from the end
            piece[end[at] - 1 - step] = some
        own = np.repeat(np.arange(len(flat)), drawn)
        if (piece < 0).any():
            spelt = [chr(-1 - p).encode() if p < 0 else b"" for p in piece.tolist()]
            size = np.maximum(1, np.array([len(b) for b in spelt]))
            own, ids = np.repeat(own, size), np.repeat(piece, size)
            ids[ids < 0] = self.byte[np.frombuffer(b"".join(spelt), np.uint8)]
        else:
            ids = piece
        ends = np.cumsum(n)
        bounds = np.searchsorted(own, np.r_[0, ends])
        return [ids[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose ids end at `ends`, one text after another, and where each ends."""
        n, at = self.n_bytes[ids], self.first_byte[ids]
        if (n == 0).any():
            raise ValueError("an id that no piece has")
        first = np.r_[0, ends[:-1]][np.diff(np.r_[0, ends]) > 0]
        n[first] -= 1  # the space put before a text
        at[first] += 1
        return self.bytes[np.repeat(at, n) + runs(n)], np.r_[0, np.cumsum(n)][ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.spell(ids, np.array([len(ids)]))[0].tobytes().decode()


_loaded: dict = {}


def lattices(path: str, theta: float) -> Lattices:
    if (path, theta) not in _loaded:
        _loaded.clear()
        _loaded[path, theta] = Lattices(path, theta)
    return _loaded[path, theta]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", theta: float = THETA, seed: int = SEED) -> DataFrame:
    """doc_id, text and ids, a sampled segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts = batch.column(2).to_pylist()
            own = lattices(path, theta).sample([t or "" for t in texts], [k or "" for k in batch.column(1).to_pylist()], seed)
            ends = np.r_[0, np.cumsum([len(x) for x in own])]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*own, np.zeros(0, np.int32)]), pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids], ["doc_id", "text", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode(encoded: DataFrame, path: str, theta: float = THETA) -> DataFrame:
    """Adds decoded, the text that the ids spell; encoded has doc_id, text and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column(2)
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = lattices(path, theta).spell(column.flatten().to_numpy().astype(np.int64), np.cumsum(n))
            flat = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(column.is_valid(), flat, pa.scalar(None, pa.string()))], ["doc_id", "text", "ids", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>, decoded string")


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_pieces, a hash of the ids and whether decoding gave back the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.hash("ids").alias("ids_hash"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))
