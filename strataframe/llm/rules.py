"""Quality rules: base counts, and tokeniser fertility with rejection bands per language or script.

Public vocabularies split each white-space word; over a document's words they give characters per
token (for each vocabulary), the share of byte-fallback tokens and the entropy of the tokens, as a share of
the most that so many tokens can have. A document outside the band of its group is rejected, and `rejected_by` names the
first measure that is outside.

A group is a script and, where a language column is given, a language. Its bands are fitted: on all its
distinct texts that pass the base rule, each measure's exact quantiles TAIL and 1 - TAIL, widened by
MARGIN times their distance from the median, and SLACK from the median at least. Groups with fewer than LEAST such texts take their script's band, and a script with
fewer than LEAST the one from the vocabulary: its byte-fallback share is at most that of a text that draws the script's
letters with equal odds, as the letters that have a piece are the frequent ones, and more entropy is asked of a script that the vocabulary spells
with few bytes. Letters of unlisted scripts count as a
script of their own, which has the widest band. Texts without a letter have the script "".

Everything is counted once over whole texts, a batch of rows at a time, and written; the bands are fitted on what was written, and it is
judged by them. Texts are not shuffled, only their numbers: texts count as equal if a 64-bit hash and all numbers are. A word's tokens
are kept in a bounded memo per worker.

Defined results: a null or empty text has no words and fails the base rule; a null language is a group of its script; a null key
stays one row; repeated rows are judged each, and count once in the bands; an empty table gives no rows; only the named columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import WORDS, Memo, at_places, materialize, runs, slices, tables
from strataframe.llm.langid import SCRIPTS, codes

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5
#: Texts that a group needs, the share beyond each quantile, and how far bands go beyond.
LEAST, TAIL, MARGIN = 200, 0.01, 0.25
#: How far from the median a band reaches at least, by measure: one emoji or foreign name isn't junk.
SLACK = (0.2, 0.2, 0.05, 0.05)
#: How many times as frequent as others a script's letters with a piece are, about.
#: Least and most of each measure where no texts tell: a character of four bytes that is a word makes five tokens; bytes of one
#: script repeat, so long texts have little entropy.
FREQUENT = 10
WIDEST = ((0.2, 12.0), (0.2, 12.0), (0.0, 1.0), (0.15, 1.0))
Band = tuple[tuple[float, float], ...]

#: Further scripts that have a band; letters of all others are "other".
BLOCKS = SCRIPTS | {
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
}
NAMES = ["", *BLOCKS, "other"]


def block_table() -> np.ndarray:
    out = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], np.uint8) * np.uint8(len(NAMES) - 1)
    for i, ranges in enumerate(BLOCKS.values(), 1):
        for first, last in ranges:
            out[first : last + 1] = i
    return out


TABLE = block_table()
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_token", "chars_per_byte_token", "fallback_share", "entropy_share"]


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(lines) - len(set(lines))


def repeated(word: np.ndarray, doc: np.ndarray, docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document, the words in windows that occur twice or more in it; word: numbers below 2**31, exact."""
    n = len(word) - window + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    inside = doc[:n] == doc[window - 1 :]
    key = doc.astype(np.int64)[:n]
    for k in range(window):
        key = key * (int(word.max()) + 1) + word[k : n + k]
        key = np.unique(key, return_inverse=True)[1]
    twice = inside & (np.bincount(key[inside], minlength=key.max() + 1)[key] >= 2)
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)


class Vocabularies:
    """Tokens per word of a sentencepiece model with byte fallback and of a byte-level rank file."""

    def __init__(self, pieces: str, ranks: str, pattern: str):
        import base64

        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
        self.size = self.sp.vocab_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.size)])
        self.bands = {name: self.band(ranges) for name, ranges in BLOCKS.items()} | {"": WIDEST, "other": WIDEST}
        self.memo = Memo(300_000)
        self.clear()

    def clear(self) -> None:
        self.tokens, self.start, self.n, self.bytes, self.other = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(4))

    def band(self, ranges: list[tuple[int, int]]) -> Band:
        """WIDEST, with the byte-fallback share of the script's letters and marks."""
        signs = [chr(c) for first, last in ranges for c in range(first, last + 1) if unicodedata.category(chr(c))[0] in "LM"]
        spelt = [len(c.encode()) for c in signs if self.sp.piece_to_id(c) == self.sp.unk_id()]
        share = lambda odds: sum(spelt) / (sum(spelt) + odds * (len(signs) - len(spelt)))
        return *WIDEST[:2], (0.0, share(1)), (WIDEST[3][0] if share(FREQUENT) > 0.5 else 2 * WIDEST[3][0], 1.0)

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of words under which their tokens are found."""
        new = self.memo.missing(words)
        if not self.memo:
            self.clear()
        if new:
            ids = self.sp.encode(new, num_threads=1)
            other = [self.bpe.encode_ordinary(f" {w}") for w in new]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, n.sum())
            self.memo.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.tokens) + np.cumsum(n) - n])
            self.bytes = np.concatenate([self.bytes, np.bincount(np.repeat(np.arange(len(n)), n), self.is_byte[flat], len(n)).astype(np.int64)])
            self.n, self.tokens = np.concatenate([self.n, n]), np.concatenate([self.tokens, flat])
            self.other = np.concatenate([self.other, np.fromiter(map(len, other), np.int64, len(other))])
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))


_loaded: dict = {}


def vocabularies(*paths: str) -> Vocabularies:
    if paths not in _loaded:
        _loaded.clear()
        _loaded[paths] = Vocabularies(*paths)
    return _loaded[paths]


def majority_script(text: str) -> int:
    c = codes(text)
    n = np.bincount(TABLE[c], minlength=len(NAMES))
    n[0] = 0
    return int(n.argmax()) if n.any() else 0


def measure(texts: list[str | None], vocab: Vocabularies) -> dict[str, np.ndarray]:
    """Base counts, the base rule, the measures and the script of each text."""
    docs = len(texts)
    texts = [t or "" for t in texts]
    words = [WORDS.findall(t) for t in texts]
    flat = [w for ws in words for w in ws]
    n_words = np.array([len(ws) for ws in words], np.int64)
    doc = np.repeat(np.arange(docs), n_words)
    per = lambda x: np.bincount(doc, x, docs)
    number = vocab.of(flat)
    chars, tokens = per(np.fromiter(map(len, flat), np.int64, len(flat))), per(vocab.n[number])
    n = vocab.n[number]
    ids = vocab.tokens[np.repeat(vocab.start[number], n) + runs(n)]
    key, count = np.unique(np.repeat(doc, n) * vocab.size + ids, return_counts=True)
    entropy = np.log2(np.maximum(tokens, 1)) - np.bincount(key // vocab.size, count * np.log2(count), docs) / np.maximum(tokens, 1)
    out = {
        "n_words": n_words, "word_chars": chars.astype(np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64), "n_dup_lines": np.array([dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated(number, doc, docs).astype(np.int64),
        "chars_per_token": chars / np.maximum(tokens, 1), "chars_per_byte_token": chars / np.maximum(per(vocab.other[number]), 1),
        "fallback_share": per(vocab.bytes[number]) / np.maximum(tokens, 1), "entropy_share": entropy / np.log2(np.clip(tokens, 2, vocab.size)),
    }
    out["script"] = np.array([NAMES[majority_script(t)] for t in texts], object)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_SHARE * n_words)
    return out


def band_of(low: np.ndarray, middle: np.ndarray, high: np.ndarray, margin: float = MARGIN) -> Band:
    """The bands that quantiles of the measures give."""
    low, high = np.minimum(low - margin * (middle - low), middle - SLACK), np.maximum(high + margin * (high - middle), middle + SLACK)
    low[2], high[3] = 0.0, 1.0  # no fallback is never bad, nor is a text whose tokens all differ
    return tuple(zip(low.tolist(), high.tolist(), strict=True))


def first_outside(measures: np.ndarray, bands: list[Band]) -> np.ndarray:
    """Of each row, the number of the first measure outside its band, or len(MEASURES); measures: a row per measure."""
    low, high = np.array(bands).transpose(2, 1, 0)
    return np.vstack([(measures < low) | (measures > high), np.ones(len(bands), bool)]).argmax(axis=0)


def measured(docs: DataFrame, paths: tuple[str, str, str], key: str | None = None, text: str = "text", lang: str | None = None) -> DataFrame:
    """One row per document: key, language, a hash of language and text, counts, measures, script, base_failed, and what the
    vocabulary's band finds outside."""
    names = [*COUNTS, *MEASURES, "script", "base_failed", "outside"]
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(MEASURES) + [pa.string(), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                vocab = vocabularies(*paths)
                out = measure(batch.column(3).to_pylist(), vocab)
                out["outside"] = first_outside(np.array([out[c] for c in MEASURES]), [vocab.bands[s] for s in out["script"]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(out[c], k) for c, k in zip(names, kinds, strict=True))], ["_key", "_lang", "_place", *names])

    group = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    some = docs.select((F.col(key) if key else F.lit(None).cast("string")).alias("_key"), group.alias("_lang"), F.col(text).cast("string").alias("_text"))
    some = some.select("_key", "_lang", F.xxhash64("_text", "_lang").alias("_place"), "_text")
    schema = some.select("_key", "_lang", "_place").schema
    for c in names:
        schema = schema.add(c, "long" if c in COUNTS else "double" if c in MEASURES else {"script": "string", "base_failed": "boolean", "outside": "integer"}[c])
    return some.mapInArrow(run, schema)


def fit_measured(seen: DataFrame, least: int = LEAST) -> dict[tuple[str, str | None], Band]:
    """fit() of a table of measured()."""
    with tables(seen.sparkSession):
        one = materialize(seen.where(~F.col("base_failed")).select("_lang", "_place", "script", *COUNTS, *MEASURES).distinct(), "rules-distinct")
        groups = one.withColumn("group", F.explode(F.array_distinct(F.array("_lang", F.lit(None).cast("string")))))
        values = groups.select("script", "group", F.posexplode(F.array(*MEASURES)).alias("measure", "v"))
        found = at_places(values, ["script", "group", "measure"], lambda n: [q * (n - 1) for q in (TAIL, 0.5, 1 - TAIL)], least)
    return {group: band_of(*np.array([found[*group, k] for k in range(len(MEASURES))]).T) for group in {g[:2] for g in found}}


def fit(docs: DataFrame, paths: tuple[str, str, str], text: str = "text", lang: str | None = None, least: int = LEAST) -> dict[tuple[str, str | None], Band]:
    """Bands by (script, language), and by (script, None) for all languages of a script, from all texts; equal texts count
    once. The driver gets the counts of bins, and three quantiles of each measure and group."""
    with tables(docs.sparkSession):
        return fit_measured(materialize(measured(docs, paths, None, text, lang), "rules-measures"), least)


def judge(docs: DataFrame, paths: tuple[str, str, str], key: str = "doc_id", text: str = "text", lang: str | None = None, bands: dict[tuple[str, str | None], Band] | None = None) -> DataFrame:
    """One row per document: the key, the base counts, the measures, script, base_failed, kept and rejected_by (base, or the
    first measure outside its band; else null). paths: the sentencepiece model, the rank file and the rank file's pattern.
    bands: those of fit(), by default fitted on docs, whose measures are then written."""
    seen = measured(docs, paths, key, text, lang)
    if bands is None:
        seen = materialize(seen, "rules-measures")
        bands = fit_measured(seen)
    carried = [*COUNTS, *MEASURES, "script", "base_failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                groups = zip(batch.column("script").to_pylist(), batch.column("_lang").to_pylist(), strict=True)
                own = [bands.get(g) or bands.get((g[0], None)) for g in groups]
                outside = first_outside(np.array([batch.column(c).to_numpy() for c in MEASURES]), [b or WIDEST for b in own])
                outside = np.where([b is not None for b in own], outside, batch.column("outside").to_numpy())
                by = np.array([*MEASURES, None], object)[outside]
                by[batch.column("base_failed").to_numpy(zero_copy_only=False)] = "base"
                columns = [batch.column(c) for c in ("_key", *carried)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.equal(by, None), pa.bool_()), pa.array(by, pa.string())], ["doc_id", *carried, "kept", "rejected_by"])

    return seen.mapInArrow(run, seen.select(F.col("_key").alias("doc_id"), *carried).schema.add("kept", "boolean").add("rejected_by", "string"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, (P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), lang="lang")
