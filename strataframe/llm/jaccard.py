"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct word shingles ("tokens"). Two sets with intersection >= t * union miss
few of each other's tokens: the larger at most (1 - t) * n of its n tokens, the smaller at most (1 - t) / (1 + t) * n. In a
common order of all tokens (rare ones first, then by hash) a set's prefix is extended until what it covers exceeds that
bound: a rare token covers one, and frequent tokens are dealt by a hash to classes, of which each covers its tokens in the
prefix less one. If two linked sets shared neither a rare token nor a pair of frequent tokens of one class within their
prefixes, then the set whose prefix ends first would miss as many tokens as its prefix covers. So rare tokens are indexed
singly and frequent ones by pairs within their class. The number of classes grows with the sizes of sets (by powers of two, CLASS
tokens of a prefix to a class), so a set has some signatures for each token it may miss, however long it is; the
smaller set of a pair indexes for its own power of two and the next, where its partner may be. A signature counts
for a pair only if the smaller set has it within its shorter prefix. Every candidate is verified exactly.

Equal sets are one node. Of the nodes that share a signature, all are compared with a hub, or with a few if they are many, central
ones among them (those with the fewest rare tokens, as an original has among its near copies), then with ones of different components; the links found make
components. Nodes of a signature that are then in several components are compared in blocks of at most BLOCK; of
more nodes than that, those leave first that have more tokens of their own than any link allows, in rounds, as their leaving makes more tokens
others' own. Blocks compare counts of tokens in BUCKETS ranges of the hash: the sum of the smaller counts is the most that two sets
can share, and only pairs that could link leave the block to be verified. So nothing is lost, and neither a large group of near copies nor a
passage that many share turns into pairs.

Frequency affects cost, never results: the classes are two bitmaps of at most MOST_CELLS bits, eight bits for each token they
hold; where more tokens are shared, more occurrences are asked of a token until those left fit. A hot signature is one
row of each task before it moves, and joins of its nodes to its hubs are ones that Spark may split. Candidates,
links and components stay in Spark; hubs with many partners are dealt to several tasks.

Defined results: null or wordless text is linked with nothing and has no shingles; fewer words than the width
make one shingle; a null key is a row whose component takes the smallest other key, or null; repeated rows are
equal sets; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.common import BYTE_WORDS, GOLDEN, discard, materialize, mix, slices

WIDTH, PERCENT = 3, 90
#: Prefixes that make a token frequent, comparisons with a hub in one task, tokens of a prefix to a class of frequent ones.
FREQUENT, PER_TASK, CLASS = 8, 128, 2
#: Bits of a bitmap at most, and of a part of it; rows of a block; hash ranges of a sketch.
MOST_CELLS, PART, BLOCK, BUCKETS = 1 << 27, 1 << 15, 1024, 256
#: Hubs of a signature of more than CROWD nodes; any other has one. Rounds in which nodes with many own tokens leave.
HUBS, CROWD, BROADCAST_ROWS, PEELS = 4, 16, 500_000, 4
#: A node's least signatures that tell where a pair of nodes first meets, and what stands for none.
FIRST, NONE = 16, (1 << 63) - 1


def tokens(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = BYTE_WORDS.findall(text.encode().lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    c = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * GOLDEN + c[k : k + len(h)])
    return np.unique(h)


def missing(n, percent: int = PERCENT):
    """How many of its n tokens a set may lack in a partner."""
    return n * (100 - percent) // 100


def missing_smaller(n: int, percent: int = PERCENT) -> int:
    """How many of its n tokens a set may lack in a partner that isn't smaller."""
    return n - -(-2 * percent * n // (100 + percent))


def classes_of(band: int, percent: int = PERCENT) -> int:
    """Classes of frequent tokens for pairs whose larger set has 2 ** band to 2 ** (band + 1) - 1 tokens; 0: single tokens. No more than
    leave the smallest set of such a pair enough to cover."""
    least = -(-percent * (1 << band) // 100)
    return min(max(1, missing(2 << band, percent) // CLASS), -(-percent * least // 100) - 1)


def sketch(t: np.ndarray) -> bytes:
    """Counts of tokens by range of the hash, of the narrowest of three widths that holds them."""
    counts = np.bincount((t >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS)
    most = counts.max()
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


class Classes:
    """Two bitmaps over the last bits of tokens: of those that several prefixes hold, and of the frequent ones."""

    def __init__(self, shared: np.ndarray, frequent: np.ndarray):
        self.shared, self.frequent = shared, frequent

    def __call__(self, t: np.ndarray) -> np.ndarray:
        cell = (t & np.uint64(8 * len(self.shared) - 1)).astype(np.int64)
        bit = (1 << (cell & 7)).astype(np.uint8)
        return (self.shared[cell >> 3] & bit > 0).astype(np.int8) + (self.frequent[cell >> 3] & bit > 0)


def combined(common: np.ndarray, need: int, short: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of frequent tokens, in their order, whose prefix covers `need`, and which of them are within the prefix that
    covers `short`."""
    salt = np.uint64((classes + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    if not classes:
        return mix(common[:need] ^ salt), np.arange(min(need, len(common))) < short
    c = common[: 4 * (need + classes) + 8]
    while True:
        own = (mix(c + salt) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        first = np.zeros(len(c), bool)
        first[order[np.r_[True, own[order][1:] != own[order][:-1]][: len(c)]]] = True
        covered = np.cumsum(~first)
        if len(c) == len(common) or (len(c) and covered[-1] >= need):
            break
        c = common[: 2 * len(c)]
    end, near = np.searchsorted(covered, need) + 1, np.searchsorted(covered, short) + 1 if short > 0 else 0
    order = order[order < end]
    own, at, inside = own[order], [], []
    for d in range(1, len(order)):
        same = np.flatnonzero(own[d:] == own[:-d])
        if not len(same):
            break  # runs of a class are shorter than this
        a, b = order[same], order[same + d]
        at.append(np.stack([a, b]))
        inside.append(b < near)
    if not at:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    (a, b), inside_ = np.concatenate(at, axis=1), np.concatenate(inside)
    with np.errstate(over="ignore"):
        return mix((c[a] * GOLDEN + c[b]) ^ salt), inside_


def signatures(t: np.ndarray, classes: Classes, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """What a set of sorted tokens is found by as the larger of a pair, and as the smaller: signatures, whether each is
    one as the smaller, and how far the set is from a centre of near copies: by rare tokens, then by tokens that are lacking."""
    n, kind = len(t), classes(t)
    long, short = missing(n, percent) + 1, missing_smaller(n, percent) + 1
    rare, common = np.concatenate([t[kind == 0], t[kind == 1]]), t[kind == 2]
    out, small = [rare[:long]], [np.arange(min(long, len(rare))) < short]
    own = n.bit_length() - 1
    for band in range(own, (n * 100 // percent).bit_length()):
        need, near = (long if band == own else short) - len(rare), short - len(rare)
        if need > 0:
            sig, inside = combined(common, need, near, classes_of(band, percent))
            out.append(sig)
            small.append(inside)
    return np.concatenate(out), np.concatenate(small), (min(long, len(rare)) << 32) - n


def sets(docs: DataFrame, key: str, text: str, width: int, percent: int, rest: tuple[str, ...] = ()) -> DataFrame:
    """Written: row, key, text, n, digest (hi, lo), sketch, the prefix in plain hash order, and docs' columns `rest` as a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [tokens(x, width) for x in batch.column(1).to_pylist()]
            digest = np.array([divmod(xxhash.xxh3_128_intdigest(t.tobytes()), 1 << 64) for t in own], np.uint64).reshape(-1, 2).view(np.int64)
            head = [t[: missing(len(t), percent) + 1].view(np.int64) for t in own]
            ends = np.r_[0, np.cumsum([len(h) for h in head])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t) for t in own], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([sketch(t) for t in own], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*head, np.zeros(0, np.int64)]), pa.int64()))], ["key", "text", "rest", "n", "hi", "lo", "sketch", "head"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.struct(F.lit(True).alias("_row"), *rest).alias("rest"))
    schema = T.StructType(list(chosen.schema.fields))
    for c in ("n", "hi", "lo"):
        schema = schema.add(c, "long")
    made = chosen.mapInArrow(run, schema.add("sketch", "binary").add("head", T.ArrayType(T.LongType())))
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")


def classify(all_: DataFrame, frequent: int = FREQUENT, most: int = MOST_CELLS) -> Classes:
    """Counts the prefixes' tokens; at most `most` / PART rows of two bitmaps' parts reach the driver. A bitmap has eight bits for
    each token in it; beyond `most` bits, the least count of shared tokens doubles until those left fit."""
    counts = all_.select(F.explode("head").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    counts = materialize(counts, "jaccard-shared")
    sizes = dict(map(tuple, counts.groupBy(F.floor(F.log2("c")).cast("int")).count().collect()))  # a row per power of two
    low = next(k for k in range(1, 65) if 8 * sum(n for j, n in sizes.items() if j >= k) <= most)
    held = sum(n for j, n in sizes.items() if j >= low)
    cells = min(most, max(1 << 20, 1 << (8 * held).bit_length()))
    often = max(frequent, 1 << low if low > 1 else 0)
    cell = F.col("t").bitwiseAND(F.lit(cells - 1))

    def part(key: tuple, group: pa.Table) -> pa.Table:
        bits = np.zeros((2, PART), bool)
        at = group["cell"].to_numpy() & (PART - 1)
        bits[0, at] = True
        bits[1, at[group["often"].to_numpy(zero_copy_only=False).astype(bool)]] = True
        one, two = np.packbits(bits, axis=1, bitorder="little")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "one": [one.tobytes()], "two": [two.tobytes()]})

    cut = counts.where(F.col("c") >= (1 << low)).groupBy(cell.alias("cell")).agg(F.max(F.col("c") >= often).alias("often"))
    maps = np.zeros((2, cells // PART, PART // 8), np.uint8)
    for r in cut.groupBy(F.expr(f"cell div {PART}").alias("p")).applyInArrow(part, "part long, one binary, two binary").collect():
        maps[0, r.part], maps[1, r.part] = np.frombuffer(r.one, np.uint8), np.frombuffer(r.two, np.uint8)
    discard(counts)
    return Classes(maps[0].ravel(), maps[1].ravel())


def postings(all_: DataFrame, reps: DataFrame, classes: Classes, width: int, percent: int) -> DataFrame:
    """Written: (sig, x, n, far, small) for each signature that two or more nodes share, one of them as the smaller; x: the node's
    row; small: whether it has it as the smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in slices(batches):
            hi, lo = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows, sigs, small, off = [], [], [], []
            for i, (text, node) in enumerate(zip(batch.column(0).to_pylist(), zip(hi.tolist(), lo.tolist(), strict=True), strict=True)):
                if node not in seen:  # of a task's equal sets, one is enough
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(node)
                    s, f, far = signatures(tokens(text, width), classes, percent)
                    rows.append((i, len(s)))
                    off.append(np.full(len(s), far))
                    sigs.append(s)
                    small.append(f)
            at = np.repeat(*np.array(rows, np.int64).reshape(-1, 2).T)
            s, f = np.concatenate([*sigs, np.zeros(0, np.uint64)]).view(np.int64), np.concatenate([*small, np.zeros(0, bool)])
            far = np.concatenate([*off, np.zeros(0, np.int64)])
            for k in range(0, len(s), 100_000):
                some = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(s[k : k + 100_000]), pa.array(hi[some]), pa.array(lo[some]), pa.array(f[k : k + 100_000]), pa.array(far[k : k + 100_000])], ["sig", "hi", "lo", "small", "far"])

    made = materialize(all_.where("n > 0").select("text", "hi", "lo").mapInArrow(run, "sig long, hi long, lo long, small boolean, far long"), "jaccard-signatures")
    shared = made.groupBy("sig").agg(F.min("hi").alias("a"), F.max("hi").alias("b"), F.max("small").alias("any")).where("a <> b and any").select("sig")
    shared = materialize(shared, "jaccard-shared")  # read back, so the join below is one that Spark may split
    out = made.join(few(shared), "sig", "left_semi").join(reps, ["hi", "lo"]).groupBy("sig", "x", "n", "far").agg(F.max("small").alias("small"))
    out = materialize(out, "jaccard-postings")
    discard(made, shared)
    return out


def few(df: DataFrame) -> DataFrame:
    """df, written, marked for broadcast if it has at most BROADCAST_ROWS rows of a few numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, all_: DataFrame, width: int) -> DataFrame:
    """Written: a, b, both and either (sizes of intersection and union) of pairs (a, b) of nodes. A hub's
    text goes to one task per PER_TASK partners; a task holds one hub's tokens at a time."""
    pairs = materialize(pairs, "jaccard-pairs")
    hubs_ = materialize(pairs.groupBy("a").count().where(F.col("count") > PER_TASK), "jaccard-hubs")
    dealt = pairs.join(few(hubs_), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / PER_TASK)), F.lit(0)).alias("part"))
    nodes_ = materialize(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "jaccard-nodes")
    texts = materialize(all_.select("row", "text").join(few(nodes_), "row", "left_semi"), "jaccard-texts")
    partners = dealt.join(texts, dealt.b == texts.row).select("a", "part", "b", "text")
    hubs = dealt.select("a", "part").distinct().join(texts, F.col("a") == texts.row).select("a", "part", F.lit(-1).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for batch in slices(batches):
            out = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                t = tokens(text, width)
                if b < 0:
                    hub, own = a, t
                    continue
                if hub != a:
                    raise ValueError("a pair came before its hub")
                at = np.minimum(np.searchsorted(own, t), len(own) - 1)
                both = int((own[at] == t).sum())
                out.append((a, b, both, len(own) + len(t) - both))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["a", "b", "both", "either"])

    ordered = partners.unionByName(hubs).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    out = materialize(ordered.select("a", "b", "text").mapInArrow(run, "a long, b long, both long, either long"), "jaccard-verified")
    discard(pairs, hubs_, nodes_, texts)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Written: (x, c) for each end of edges (a, b): c is the smallest reachable. Large-star and small-star rounds
    (neighbours move to the smallest one) until nothing changes."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        old = now
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = materialize(small.select("u", F.col("m").alias("v")).union(small.where("v > m").select("v", "m")).distinct(), "components")
        discard(old, large)
    return now.select(F.col("u").alias("x"), F.col("v").alias("c"))


def linked(verified: DataFrame, percent: int) -> DataFrame:
    return verified.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


def sketched(column: pa.Array) -> np.ndarray:
    kinds = {BUCKETS: "u1", 2 * BUCKETS: "<u2", 4 * BUCKETS: "<u4"}
    rows = column.to_pylist()
    if all(len(r) == BUCKETS for r in rows):
        return np.frombuffer(b"".join(rows), "u1").reshape(-1, BUCKETS).astype(np.int32)
    return np.array([np.frombuffer(r, kinds[len(r)]) for r in rows], np.int32).reshape(-1, BUCKETS)


def could(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches (row by row) may be of linked sets."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return most * 100 >= percent * (a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64) - most)


def could_meet(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The same of each row of a with each of b. The sum of smaller counts is the product of the counts written as runs of
    ones, exact in single precision; where counts are large, it is taken directly."""
    levels = int(min(a.max(initial=0), b.max(initial=0)))
    if levels <= 16 and a.shape[0] * b.shape[0]:
        ones = lambda k: (k[:, :, None] >= np.arange(1, levels + 1)).reshape(len(k), -1).astype(np.float32)
        most = (ones(a) @ ones(b).T).astype(np.int64)
    else:
        most = np.array([np.minimum(row, b).sum(axis=1, dtype=np.int64) for row in a]).reshape(len(a), len(b))
    return most * 100 >= percent * (a.sum(axis=1, dtype=np.int64)[:, None] + b.sum(axis=1, dtype=np.int64) - most)


def likely(pairs: DataFrame, all_: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that could link."""
    side = lambda c: all_.select(F.col("row").alias(c), F.col("sketch").alias(f"{c}_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keep = pa.array(could(sketched(batch.column(2)), sketched(batch.column(3)), percent))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def peeled(rest: DataFrame, all_: DataFrame, width: int, percent: int, rounds: int = PEELS) -> DataFrame:
    """rest (sig, x, n, small, c), with solo: how many of x's tokens no other node of rest has; without nodes that
    have more than a link with a larger or smaller set allows."""
    names = materialize(rest.select("x", "n").distinct(), "jaccard-peeled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            own = [tokens(t, width) for t in batch.column(1).to_pylist()]
            at = np.repeat(batch.column(0).to_numpy(), [len(t) for t in own])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], ["x", "t"])

    texts = all_.select(F.col("row").alias("x"), "text").join(few(names.select("x")), "x", "left_semi")
    all_tokens = materialize(texts.mapInArrow(run, "x long, t long"), "jaccard-tokens")
    for _ in range(rounds):
        before = names
        some = all_tokens.join(few(names.select("x")), "x", "left_semi")
        solo = some.groupBy("t").agg(F.count("*").alias("k"), F.min("x").alias("x")).where("k = 1").groupBy("x").agg(F.count("*").alias("solo"))
        counted = before.select("x", "n").join(solo, "x", "left").select("x", "n", F.coalesce("solo", F.lit(0)).alias("solo"))
        names = materialize(counted.where(F.col("solo") * percent <= F.col("n") * (100 - percent)), "jaccard-peeled")
        left, was = names.count(), before.count()
        discard(before)
        if left == was:
            break
    discard(all_tokens)
    return rest.join(names.select("x", "solo"), "x")


def between(rest: DataFrame, all_: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """rest: (sig, x, n, small, c, solo, size). Pairs (a, b) of nodes that share a signature, which the smaller has as such, are in
    different components c and could link. A signature of more than `block` nodes is cut into parts, and each two parts meet in
    a task of their own. A pair leaves at its least common signature, which the nodes' FIRST least ones tell if they have
    any in common; other pairs may leave several times."""
    first = materialize(rest.groupBy("x").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST).alias("first")), "jaccard-first")
    parts = F.ceil(F.col("size") / block).cast("int")
    rows = rest.join(all_.select(F.col("row").alias("x"), "sketch"), "x").join(first, "x").withColumn("part", F.pmod(F.xxhash64("x"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("sig", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "x", "c", "n", "solo", F.col("small").cast("long").alias("small"), "sketch", "first")

    def pairs(sig: int, part: np.ndarray, x: np.ndarray, c: np.ndarray, n: np.ndarray, solo: np.ndarray, small: np.ndarray, k: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.flatnonzero(part == part.min())
        two = one if (part == part[0]).all() else np.flatnonzero(part != part.min())
        found = []
        for at in range(0, len(one), 256):
            some = one[at : at + 256]
            a, b = n[some][:, None], n[two][None]
            most = np.minimum((n - solo)[some][:, None], (n - solo)[two][None])
            may = (c[some][:, None] != c[two]) & (most * 100 >= percent * (a + b - most)) & (((a <= b) & (small[some][:, None] > 0)) | ((b <= a) & (small[two][None] > 0)))
            i, j = np.nonzero(may)
            if len(i) * 8 > may.size:
                i, j = np.nonzero(may & could_meet(k[some], k[two], percent))
            else:
                fits = np.concatenate([could(k[some[i[h : h + 4096]]], k[two[j[h : h + 4096]]], percent) for h in range(0, len(i), 4096)] or [np.zeros(0, bool)])
                i, j = i[fits], j[fits]
            own = np.ones(len(i), bool)
            for h in range(0, len(i), 4096):
                a, b = low[some[i[h : h + 4096]]], low[two[j[h : h + 4096]]]
                both = (a[:, :, None] == b[:, None]).any(axis=2) & (a != NONE)
                own[h : h + 4096] = np.where(both.any(axis=1), np.where(both, a, NONE).min(axis=1) == sig, True)
            i, j = i[own], j[own]
            found.append(np.stack([x[some[i]], x[two[j]]]))
        a, b = np.concatenate(found, axis=1)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def made(key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            out = [pairs(key[a, 0], *(v[a:b] for v in columns)) for a, b in zip(starts, [*starts[1:], len(key)], strict=True) if b - a > 1]
            code = np.unique(np.concatenate([np.stack(x, axis=1) for x in out] or [np.zeros((0, 2), np.int64)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(code[:, 0]), pa.array(code[:, 1])], ["a", "b"])

        for batch in slices(batches, 2048):
            now = [np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1), *(batch.column(i).to_numpy() for i in range(3, 9)), sketched(batch.column(9)), np.array([r + [NONE] * (FIRST - len(r)) for r in batch.column(10).to_pylist()], np.int64).reshape(-1, FIRST)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.flatnonzero((now[0] != now[0][-1]).any(axis=1)).max(initial=-1)) + 1  # the last group may go on
            if last:
                yield made(*(v[:last] for v in now))
            held = [v[last:] for v in now]
        if held is not None:
            yield made(*held)

    return rows.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q").mapInArrow(run, "a long, b long").distinct()


def hubs_of(rows: DataFrame, by: str) -> DataFrame:
    """Written: (sig, hubs), nodes (x, c) by residue of a hash of column `by`: the first ones, and for half of the residues the most
    central ones. Each task knows its own, so no task holds a signature's nodes."""
    residue, node = F.pmod(F.xxhash64(by), F.lit(HUBS)), F.struct("x", "c")
    some = [F.min_by(node, F.when(residue == k, F.col("x" if k % 2 else "far"))).alias(f"h{k}") for k in range(HUBS)]
    hubs = rows.groupBy("sig").agg(F.count("*").alias("all"), F.min_by(node, F.col("x")).alias("one"), *some)
    each = F.array_compact(F.array(*(F.col(f"h{k}") for k in range(HUBS))))
    return materialize(hubs.select("sig", F.when(F.col("all") > CROWD, each).otherwise(F.array("one")).alias("hubs")), "jaccard-hubs-of")


def links(posts: DataFrame, all_: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) enough to connect all nodes that any links connect: first from hubs that are any of a signature's nodes, then
    from ones of different components, then between what is left."""
    sizes = materialize(posts.select(F.col("x").alias("a"), F.col("n").alias("m")).distinct(), "jaccard-sizes")
    rest, found = posts.withColumn("c", F.col("x")), None
    for by in ("x", "c"):
        hubs = hubs_of(rest, by)
        star = rest.select("sig", "x", "n", "c").join(hubs, "sig").select("x", "n", "c", F.col("hubs.x").alias("all"), F.explode("hubs").alias("h"))
        other = (F.col("x") > F.col("h.x")) | ((F.col("x") < F.col("h.x")) & ~F.array_contains("all", F.col("x")))
        star = star.where((F.col("c") != F.col("h.c")) & other).select(F.col("h.x").alias("a"), "x", "n").distinct()
        near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
        star = star.join(sizes, "a").where(near).select("a", F.col("x").alias("b"))
        now = linked(verify(likely(star, all_, percent), all_, width), percent)
        found = now if found is None else found.unionByName(now)
        comp = components(found)
        named = rest.drop("c", "size").join(comp, "x", "left").withColumn("c", F.coalesce("c", "x")).join(hubs, "sig")
        named = materialize(named.where(~F.array_contains("hubs.x", F.col("x"))).drop("hubs"), "jaccard-named")  # a hub has met all others
        several = named.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("small").alias("any"), F.count("*").alias("size"))
        several = materialize(several.where("c0 <> c1 and any").select("sig", "size"), "jaccard-several")
        rest = materialize(named.join(few(several), "sig").select("sig", "x", "n", "far", "small", "c", "size"), "jaccard-rest")
        discard(named, hubs, several)
        if rest.isEmpty():
            return found
    left, large = rest.where(F.col("size") <= BLOCK).withColumn("solo", F.lit(0).cast("long")), rest.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        large = peeled(large.drop("size"), all_, width, percent)
        crowd = materialize(large.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-crowd")
        left = left.unionByName(large.join(few(crowd), "sig"))
    out = found.unionByName(linked(verify(between(left, all_, percent), all_, width), percent))
    discard(rest)
    return out


def grouped(all_: DataFrame, width: int, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """all_: as of sets(). row, key, n, component (the first row of the component) and component_key (its smallest key)."""
    reps = materialize(all_.where("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("x"), F.min("key").alias("least"), F.min("n").alias("n")), "jaccard-reps")
    posts = postings(all_, reps.select("hi", "lo", "x", "n"), classify(all_, frequent), width, percent)
    comp = components(links(posts, all_, width, percent))
    discard(posts)
    named = reps.join(comp, "x", "left").withColumn("c", F.coalesce("c", "x"))
    names = materialize(named.join(comp, "c", "left_semi").groupBy("c").agg(F.min("least").alias("name")), "jaccard-names")
    named = named.join(names, "c", "left").select("hi", "lo", "c", F.coalesce("name", "least").alias("name"))
    rows = all_.select("key", "n", F.when(F.col("n") > 0, F.col("hi")).alias("hi"), "lo", "row").join(named, ["hi", "lo"], "left")
    return rows.select("row", "key", "n", F.coalesce("c", "row").alias("component"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("key")).alias("component_key"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: row (a number of its own), key, n (its tokens), component and component_key."""
    return grouped(sets(docs, key, text, width, percent), width, percent, frequent)


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component left, the first of those with the smallest key; all columns stay."""
    all_ = sets(docs, key, text, width, percent, tuple(c for c in docs.columns if c != text))
    groups = materialize(grouped(all_, width, percent).select("row", "key", "component"), "jaccard-groups")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"))
    gone = few(materialize(groups.join(first, "component").where("row <> first.row").select("row"), "jaccard-gone"))
    return all_.join(gone, "row", "left_anti").select(*(F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_key").alias("component_id"))
