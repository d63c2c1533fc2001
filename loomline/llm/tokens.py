"""Token counts under an existing tokenizer.

For totals by slice, every text goes through the tokenizer's own pre-splitting;
each distinct piece is tokenized once, and the cached lengths are joined with
the frequencies of pieces. A piece that is itself in the vocabulary is one token
and needs no lookup, so only the other pieces travel.

The vocabulary file's path is a parameter; by default it is taken from the
folder named in LOOMLINE_TOKENIZERS, or else /opt/tokenizers.
"""

from __future__ import annotations

import base64
import os
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .corpus import arrow_map, current, language_label, language_names, states, table

VOCABULARY = os.path.join(os.environ.get("LOOMLINE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: The pre-splitting of this family of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file; special tokens' strings are ordinary text."""
    import tiktoken

    return tiktoken.Encoding("loomline", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(1)
def _pieces():
    import regex

    return regex.compile(PATTERN)


def count_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """The other columns with the number of tokens of each whole text, row by row. Null and empty texts have 0."""
    rest = [c for c in df.columns if c not in (text, out)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{out}` long"])

    def run(b):
        enc = encoder(path)
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        return pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array(n, pa.int64())], names=[*rest, out])

    return arrow_map(df.select(*rest, text), run, schema)


def token_budget(df: DataFrame, slices: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Exact totals by slice: (slices..., n_docs, n_chars, n_tokens).

    A null in a slice column is a slice value of its own. Null and empty texts
    count as documents without tokens. Partial counts leave each partition, so a
    slice of any size never meets in one task with its texts.
    """
    names = [f"s{k}" for k in range(len(slices))]
    given = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(slices, names)], F.col(text).alias("text"))

    def count(batches):
        known = _ranks(path)
        split = _pieces().findall
        whole: dict[str, bool] = {}
        single: Counter = Counter()
        docs: Counter = Counter()
        chars: Counter = Counter()
        rest: dict[tuple, Counter] = defaultdict(Counter)
        held = 0
        k = len(names)

        def out():
            keys, piece, n, nd, nc = [], [], [], [], []
            for s in docs:
                keys.append(s)
                piece.append(None)
                n.append(single[s])
                nd.append(docs[s])
                nc.append(chars[s])
            for s, c in rest.items():
                keys += [s] * len(c)
                piece += c.keys()
                n += c.values()
                nd += [0] * len(c)
                nc += [0] * len(c)
            for a in range(0, len(keys), 50_000):
                z = a + 50_000
                yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in keys[a:z]], pa.string()) for i in range(k)], pa.array(piece[a:z], pa.string()), pa.array(n[a:z], pa.int64()), pa.array(nd[a:z], pa.int64()), pa.array(nc[a:z], pa.int64())], names=[*names, "piece", "n", "n_docs", "n_chars"])

        for b in batches:
            for *s, t in zip(*(c.to_pylist() for c in b.columns)):
                s = tuple(s)
                docs[s] += 1
                if not t:
                    continue
                chars[s] += len(t)
                one = 0
                own = rest[s]
                size = len(own)
                for p in split(t):
                    w = whole.get(p)
                    if w is None:
                        if len(whole) > 200_000:
                            whole.clear()
                        w = whole[p] = p.encode("utf-8", "surrogatepass") in known
                    if w:
                        one += 1
                    else:
                        own[p] += 1
                single[s] += one
                held += len(own) - size
            if held > 400_000:
                yield from out()
                for d in (single, docs, chars, rest):
                    d.clear()
                held = 0
        yield from out()

    cols = ", ".join([*(f"{n} string" for n in names), "piece string, n long, n_docs long, n_chars long"])
    parts = materialise(given.mapInArrow(count, cols), "pieces")

    def lengths(b):
        enc = encoder(path)
        pieces = b.column(0).to_pylist()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode_ordinary(p)) for p in pieces], pa.int64())], names=["piece", "length"])

    # each distinct piece once; frequencies are summed by slice before they meet the lengths, so a frequent piece has one row a slice
    pieces = parts.where("piece is not null").groupBy(*names, "piece").agg(F.sum("n").alias("n"))
    pieces = materialise(pieces, "piece-counts")
    length = arrow_map(pieces.select("piece").distinct(), lengths, "piece string, length long")
    none = F.lit(0).cast("long")
    many = pieces.join(length, "piece").select(*names, (F.col("n") * F.col("length")).alias("n_tokens"), none.alias("n_docs"), none.alias("n_chars"))
    one = parts.where("piece is null").select(*names, F.col("n").alias("n_tokens"), "n_docs", "n_chars")
    total = one.unionByName(many).groupBy(*names).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
    return total.select(*[F.col(n).alias(c) for n, c in zip(names, slices)], "n_docs", "n_chars", "n_tokens")


def tidy(value: Column) -> Column:
    """A slice value without case and outer blanks; blank and placeholder values are 'unknown'."""
    low = F.lower(F.trim(value))
    return F.when(low.isNull() | low.isin("", "unknown", "und", "none", "null", "n/a"), "unknown").otherwise(low)


def p5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens of the current records by source type, language, collection and topic area."""
    topics = table(spark, sf_dir, "collection_manifests").select("collection_id", "topic_area").dropDuplicates(["collection_id"])
    codes = language_names(spark, sf_dir)
    df = states(spark, sf_dir, "source_type", "language", "collection_id")
    now = current(df).where("text is not null").join(F.broadcast(topics), "collection_id", "left")
    sliced = now.select(
        tidy(F.col("source_type")).alias("source_type"),
        F.coalesce(language_label(F.col("language"), codes), F.lit("unknown")).alias("language"),
        F.coalesce(F.trim("collection_id"), F.lit("unknown")).alias("collection_id"),
        tidy(F.col("topic_area")).alias("topic_area"),
        "text",
    )
    return token_budget(sliced, ["source_type", "language", "collection_id", "topic_area"])


def p5_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals for each dimension by itself."""
    full = materialise(p5_budget(spark, sf_dir), "budget")
    out = None
    for d in ("source_type", "language", "collection_id", "topic_area"):
        one = full.groupBy(F.col(d).alias("slice_value")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens")).withColumn("dimension", F.lit(d))
        out = one if out is None else out.unionByName(one)
    return out.select("dimension", "slice_value", "n_docs", "n_chars", "n_tokens")


QUERIES = {"p5_budget": p5_budget, "p5_by_dimension": p5_by_dimension}
