"""Language spans: script ranges narrow the candidates, then Viterbi over per-word scores.

Training counts character n-grams (2 to 4, with word borders, hashed into BUCKETS) by language over a
hash-drawn sample of about TRAIN_ROWS documents of each of the LANGUAGES most frequent labels, in Spark; one row per language and bucket
comes back.
A word's score for a language is its mean smoothed log-probability times the number of n-grams; a
language in whose training words the word's script is rare is out while another has it. Viterbi
with a switching penalty labels each word; runs of one language are spans. A word ends where the script changes, and every few
letters in scripts without spaces, so languages may change inside a run of letters. All documents of a batch
step forward together, so a long text costs no more memory than its words.

Defined results: null text, or one without a letter, is `und` with score 0 and no spans; a null
language teaches nothing; without any training text all is `und`; ties go to the language that sorts
first; repeated keys stay one row each; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.common import Memo, fold, free, mix, runs, slices

#: Documents per language that train, about; n-gram buckets; the price of a change of language.
TRAIN_ROWS, BUCKETS, PENALTY = 2000, 1 << 16, 8.0
#: Languages that are learnt, those with most documents: the model is one number per bucket and language.
LANGUAGES = 256
#: A word is a run of letters of one script; in scripts without spaces between words, of at most SHORT letters, so that labels
#: can change inside a run.
SHORT = 6
SPACED = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Tamil", "Georgian", "Hangul", "Gurmukhi", "Gujarati", "Oriya", "Telugu", "Kannada", "Malayalam", "Sinhala", "Ethiopic")
UNSPACED = (r"\p{Han}", r"[\p{Hiragana}\p{Katakana}\u30FC]", r"\p{Thai}", r"\p{Lao}", r"\p{Khmer}", r"\p{Myanmar}", r"\p{Tibetan}")
LETTERS = regex.compile("|".join([*(rf"[\p{{{s}}}&&\p{{L}}][[\p{{{s}}}&&\p{{L}}]\p{{M}}]*" for s in SPACED), *(rf"(?:[{s}&&\p{{L}}]\p{{M}}*){{1,{SHORT}}}" for s in UNSPACED), r"\p{L}\p{M}*"]), regex.V1)
NGRAMS = (2, 3, 4)
SPANS = T.ArrayType(T.StructType().add("lang", "string").add("first", "long").add("words", "long"))

#: First and last code points of the scripts told apart; all else is script 0.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


def script_table() -> np.ndarray:
    out = np.zeros(0x10000, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            out[first : last + 1] = i
    return out


TABLE = script_table()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word, that of its first letter."""
    first = codes("".join(w[0] for w in words))
    return TABLE[np.minimum(first, 0xFFFF)] * (first < 0x10000)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of each n-gram of the words, borders included; sorted by word number."""
    text = codes("".join(f"\x02{w}\x03" for w in words)).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    word, place, size = np.repeat(np.arange(len(words)), lengths), runs(lengths), np.repeat(lengths, lengths)
    out, own = [], []
    for n in NGRAMS:
        h = np.full(max(0, len(text) - n + 1), n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x100000001B3) ^ text[k : k + len(h)])
        fits = (place + n <= size)[: len(h)]
        out.append((h[fits] % np.uint64(BUCKETS)).astype(np.int64))
        own.append(word[: len(h)][fits])
    bucket, own_ = np.concatenate(out), np.concatenate(own)
    order = np.argsort(own_, kind="stable")
    return bucket[order], own_[order]


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray
    has: np.ndarray

    def of(self, words: list[str]) -> np.ndarray:
        """A row of scores per word, a column per language."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        bucket, own = grams(words)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total = np.add.reduceat(self.logp[bucket], starts, axis=0)
        n = np.diff(np.r_[starts, len(own)])
        total *= (np.minimum(n, 12) / n)[:, None]  # a very long word has no more say than twelve n-grams
        may = self.has[scripts(words)]
        return np.where(may | ~may.any(axis=1, keepdims=True), total, total - 50).astype(np.float32)


def sample(docs: DataFrame, key: str, lang: str, rows: int) -> DataFrame:
    """About `rows` documents of each language, by a hash of the key; the languages' counts are broadcast while few."""
    counts = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(LANGUAGES)
    share = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(counts), F.col(lang) == F.col("_lang")).where(share < rows / F.col("_n")).drop("_lang", "_n")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[str, list[str]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).extend(w.lower() for w in LETTERS.findall(t or ""))
            for name, words in by.items():
                if not words:
                    continue
                c, s = np.bincount(grams(words)[0], minlength=BUCKETS), np.bincount(scripts(words), minlength=len(SCRIPTS) + 1)
                for kind, v in ((0, c), (1, s)):
                    at = np.flatnonzero(v)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], ["lang", "kind", "at", "n"])

    found = sample(docs, key, lang, rows).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(count, "lang string, kind int, at long, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts, seen = np.zeros((BUCKETS, len(names))), np.zeros((len(SCRIPTS) + 1, len(names)))
    col = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int)
    for kind, into in ((0, counts), (1, seen)):
        own = found["kind"].to_numpy() == kind
        into[found["at"].to_numpy()[own], col[own]] = found["n"].to_numpy()[own]
    logp = np.log((counts + 0.3) / (counts.sum(axis=0) + 0.3 * BUCKETS))
    return Model(names, logp.astype(np.float32), seen / np.maximum(seen.sum(axis=0), 1) >= 0.01)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word: rows of scores are the documents' words one after another. All
    documents take a step together, the longest first."""
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    start, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
    back = np.zeros(scores.shape, np.uint8 if k < 256 else np.uint16)
    path = np.zeros(len(scores), np.int64)
    live = int((n > 0).sum())
    v = scores[start[:live]].astype(np.float64)
    last = np.zeros(len(n), np.int64)
    alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")  # documents with a t-th word
    for t in range(1, len(alive) + 1):
        now = int(alive[t]) if t < len(alive) else 0
        last[now:live] = v[now:live].argmax(axis=1)
        live, v = now, v[:now]
        if not live:
            break
        best = v.argmax(axis=1)
        other = v[np.arange(live), best][:, None] - penalty
        stay = v >= other
        at = start[:live] + t
        back[at] = np.where(stay, np.arange(k), best[:, None])
        v = np.where(stay, v, other) + scores[at]
    now = last
    for t in range(len(alive) - 1, -1, -1):
        own = slice(0, int(alive[t]))
        at = start[own] + t
        path[at] = now[own]
        now[own] = back[at, now[own]]
    return path


def label(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, penalty: float = PENALTY, into: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Adds the predicted language, a score (the share of letters in that language's spans) and spans (language, first word,
    words) under the names `into` to the columns `keep` of docs (all); docs' own columns of these names go."""
    cols = [c for c in keep or docs.columns if c not in into]
    at = len(cols)
    names = model.languages
    memo, rows = Memo(300_000), np.zeros((0, len(names)), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal rows
        for batch in slices(batches):
            texts = [LETTERS.findall(t.lower()) if t else [] for t in batch.column(at).to_pylist()] if names else [[]] * batch.num_rows
            flat = [w for ws in texts for w in ws]
            new = memo.missing(flat)
            if not memo:
                rows = rows[:0]
            memo.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            rows = np.concatenate([rows, model.of(new)])
            lengths = np.array([len(ws) for ws in texts], np.int64)
            path = viterbi(rows[np.fromiter((memo[w] for w in flat), np.int64, len(flat))], lengths, penalty)
            size = np.fromiter(map(len, flat), np.int64, len(flat))
            doc = np.repeat(np.arange(len(texts)), lengths)
            letters = np.bincount(doc * max(1, len(names)) + path, size, len(texts) * max(1, len(names))).reshape(len(texts), -1)
            best = letters.argmax(axis=1)
            share = letters[np.arange(len(texts)), best] / np.maximum(1, letters.sum(axis=1))
            new_span = np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])] if len(flat) else np.zeros(0, bool)
            first = np.flatnonzero(new_span)
            words = np.diff(np.r_[first, len(flat)])
            place = runs(lengths)[first]
            offsets = np.r_[0, np.cumsum(np.bincount(doc[first], minlength=len(texts)))]
            spans = pa.StructArray.from_arrays([pa.array([names[i] for i in path[first]], pa.string()), pa.array(place, pa.int64()), pa.array(words, pa.int64())], ["lang", "first", "words"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([names[b] if n else "und" for b, n in zip(best, lengths, strict=True)], pa.string()), pa.array(share, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], [*cols, *into])

    schema = docs.select(*cols).schema.add(into[0], "string").add(into[1], "double").add(into[2], SPANS)
    return docs.select(*cols, F.col(text).alias(free(docs, "_labelled_text"))).mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(~held))
    return label(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")
