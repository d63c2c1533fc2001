"""Repeated content inside a document.

A document's score is the length-normalised log-likelihood ratio of its hashed
n-gram events between two multinomials: the raw corpus and a trusted target. An
event is the hash bucket of an eight-word window together with whether the same
window started earlier in the document. The trusted target is the corpus as it
would read with each sentence of a document said once: windows that touch a
sentence that the document already had are left out. Repeated windows have
little mass there, so repetition drives the score up. Both multinomials are
counted over all documents.

A document with a share s of repeated words has at least s/8 of its windows
repeated, so the model gives a threshold that no such document falls below. The
score decides which documents can have the share asked for; only those are
measured exactly. Texts are read once: the pass keeps each document's events,
and the words of documents in which any hashed window comes again.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .corpus import texts_of

N = 8
FRESH_BUCKETS = 4096
AGAIN_BUCKETS = 4
#: Marks an event that touches a sentence said before, and so is not of the target.
SAID = 1 << 15
ALPHA = 0.1
_CJK = "぀-ヿ㐀-鿿"
_WORD = regex.compile(rf"[{_CJK}]|(?:(?![{_CJK}])[\p{{L}}\p{{N}}])+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_DIGITS = regex.compile(r"\p{N}+")
_ASCII_DIGITS = re.compile(r"[0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?…؟])(?=\s)|(?<=[。！？\n])")
_NUMBERS = re.compile(r"[0-9]+(?:[.,:][0-9]+)*")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, each run of digits read as 0; kana and Han characters stand alone."""
    if not text:
        return []
    low = text.lower()
    if low.isascii():
        return _ASCII_WORD.findall(_ASCII_DIGITS.sub("0", low))
    return _WORD.findall(_DIGITS.sub("0", low))


class _Ids(dict):
    """A random 64-bit number for each word, drawn from its hash; forgets when large."""

    def __missing__(self, w: str) -> int:
        import xxhash

        v = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return v


def windows(docs: list[list[str]], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a few documents: hash, document number, and whether the same window started earlier in its document."""
    n = np.array([len(d) for d in docs])
    flat = np.fromiter((ids[w] for d in docs for w in d), np.uint64, int(n.sum()))
    if len(flat) < N:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z.astype(bool)
    h = np.zeros(len(flat) - N + 1, np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(h)]
    h ^= h >> np.uint64(29)
    doc = np.repeat(np.arange(len(docs)), n)
    ok = doc[: len(h)] == doc[N - 1 :]
    h, doc = h[ok], doc[: len(ok)][ok]
    salted = (h + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    _, first = np.unique(salted, return_index=True)
    again = np.ones(len(h), bool)
    again[first] = False
    return h, doc, again


def events(h: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Bucket of each event; buckets of repeated windows follow those of fresh ones."""
    top = h >> np.uint64(32)
    return np.where(again, FRESH_BUCKETS + (top % np.uint64(AGAIN_BUCKETS)).astype(np.int64), (top % np.uint64(FRESH_BUCKETS)).astype(np.int64))


def said_before(text: str) -> np.ndarray | None:
    """By word: whether it is in a sentence that the text already had (whatever its numbers); None if there is none."""
    seen: set[str] = set()
    parts, old = [], []
    for part in _SENTENCE.split(text):
        k = _NUMBERS.sub("0", part.lower()).strip(" \t\r\n.!?")
        parts.append(part)
        old.append(bool(k) and k in seen)
        seen.add(k)
    if not any(old):
        return None
    return np.repeat(old, [len(words(x)) for x in parts])


def repeated_share(ws: list[str]) -> float:
    """The exact share of words in a window of eight that also starts at an earlier word."""
    if len(ws) < N + 1:
        return 0.0
    seen: set[tuple] = set()
    total, until = 0, 0
    for i in range(len(ws) - N + 1):
        w = tuple(ws[i : i + N])
        if w in seen:
            total += i + N - max(until, i)
            until = i + N
        else:
            seen.add(w)
    return total / len(ws)


def _slices(texts: list[str | None], limit: int = 1 << 19):
    a = n = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if n and n + size > limit:
            yield a, i
            a, n = i, 0
        n += size + 1
    if a < len(texts):
        yield a, len(texts)


@dataclass
class RepetitionModel:
    """Log ratio of each event bucket, and the least ones of repeated and of fresh windows that the corpus has."""

    ratio: np.ndarray
    again_least: float
    fresh_least: float

    @classmethod
    def of_counts(cls, raw: np.ndarray, target: np.ndarray) -> RepetitionModel:
        size = FRESH_BUCKETS + AGAIN_BUCKETS
        p = (raw + ALPHA) / (raw.sum() + ALPHA * size)
        q = (target + ALPHA) / (target.sum() + ALPHA * size)
        ratio = np.log(p / q)
        again, fresh = ratio[FRESH_BUCKETS:][raw[FRESH_BUCKETS:] > 0], ratio[:FRESH_BUCKETS][raw[:FRESH_BUCKETS] > 0]
        return cls(ratio, float(again.min()) if len(again) else math.inf, float(fresh.min()) if len(fresh) else 0.0)

    def threshold(self, share: float) -> float:
        """No document with at least this share of repeated words scores lower."""
        if share <= 0:
            return -math.inf
        if math.isinf(self.again_least):
            return math.inf
        k = share / N
        bound = k * self.again_least + (1 - k) * self.fresh_least
        # where repeated windows may weigh less than fresh ones, more of them lower the bound
        return min(bound, self.again_least)

    def score(self, events_: np.ndarray) -> float:
        return float(self.ratio[events_ & (SAID - 1)].mean()) if len(events_) else 0.0


def scan_repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, events, said): the one pass over the texts. ``events`` has the buckets of all windows as 16-bit numbers; ``said`` is the text where any hashed window comes again, else null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        ids = _Ids()
        for b in batches:
            texts = b.column(1).to_pylist()
            count, events_, said = np.zeros(len(texts), np.int64), [b""] * len(texts), [None] * len(texts)
            for a, z in _slices(texts):
                if len(ids) > 300_000:
                    ids.clear()
                docs = [words(t) for t in texts[a:z]]
                h, doc, again = windows(docs, ids)
                e = events(h, again).astype("<u2")
                edges = np.searchsorted(doc, np.arange(z - a + 1))
                count[a:z] = [len(d) for d in docs]
                for i in np.unique(doc[again]):
                    said[a + i] = texts[a + i]
                for i in range(z - a):
                    own = e[edges[i] : edges[i + 1]]
                    old = said_before(texts[a + i]) if len(own) else None
                    if old is not None:
                        touched = np.concatenate(([0], np.cumsum(old)))
                        own = np.where(touched[N:] > touched[: len(own)], own | SAID, own).astype("<u2")
                    events_[a + i] = own.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(events_, pa.binary()), pa.array(said, pa.string())],
                names=[key, "n_words", "events", "said"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, events binary, said string")


def fit_repetition(scanned: DataFrame) -> RepetitionModel:
    """Counts the events of all rows; partitions send at most a few thousand partial counts each."""
    size = FRESH_BUCKETS + AGAIN_BUCKETS

    def count(batches):
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    e = np.frombuffer(x, "<u2")
                    raw += np.bincount(e & (SAID - 1), minlength=size)
                    target += np.bincount(e[e < SAID], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    parts = scanned.select("events").mapInArrow(count, "bucket int, raw long, target long")
    raw, target = np.zeros(size), np.zeros(size)
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return RepetitionModel.of_counts(raw, target)


def measure_repetition(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """(key, n_words, repetition_score, repeated_share) of each row.

    The score rules out documents below ``least``: their share is null. It is
    exact for all others, so with 0 it is known for every row. Null and empty
    texts have no words, score 0 and share 0.
    """
    scanned = materialise(scan_repetition(df, key, text), "repetition")
    model = fit_repetition(scanned)
    shared = df.sparkSession.sparkContext.broadcast((model, model.threshold(least)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        m, bound = shared.value
        for b in batches:
            score = np.array([m.score(np.frombuffer(x or b"", "<u2")) for x in b.column(2).to_pylist()])
            share = [None] * b.num_rows
            for i in np.flatnonzero(score >= bound):
                t = b.column(3)[i].as_py()
                share[i] = repeated_share(words(t)) if t is not None else 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array(share, pa.float64())],
                names=[key, "n_words", "repetition_score", "repeated_share"],
            )

    out = f"`{key}` {kind}, n_words long, repetition_score double, repeated_share double"
    return scanned.select(key, "n_words", "events", "said").mapInArrow(run, out)


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and share of every document."""
    return measure_repetition(texts_of(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 30 % repeated words: those that reach the score's threshold for it, measured."""
    return measure_repetition(texts_of(spark, sf_dir), least=0.3).where("repeated_share >= 0.3").select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and repeated share of every document."""
    return p9_scores(spark, sf_dir).select("doc_id", "n_words", F.round("repeated_share", 9).alias("repeated_share"))


ORACLE = {
    "p9_found": """
        with split as (
          select doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '\\p{N}+', '0', 'g'),
                 '([\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}])', ' \\1 ', 'g'), '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]|[\\p{L}\\p{N}]+') as w
          from documents where text is not null),
        runs as (
          select doc_id, len(w) as n, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) as run
          from split where len(w) >= 9),
        again as (select *, row_number() over (partition by doc_id, run order by i) > 1 as rep from runs),
        hit as (select distinct doc_id, n, unnest(range(i, i + 8)) as at from again where rep)
        select doc_id from hit group by doc_id, n having count(*) / n >= 0.3""",
}
# the same runs, for every document
ORACLE["p9_shares"] = ORACLE["p9_found"].replace(
    "select doc_id from hit group by doc_id, n having count(*) / n >= 0.3",
    "select d.doc_id, coalesce(len(s.w), 0) as n_words, round(coalesce(h.k / len(s.w), 0), 9) as repeated_share from documents d left join split s using (doc_id) left join (select doc_id, count(*) as k from hit group by 1) h using (doc_id)",
)
QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_shares": p9_shares}
