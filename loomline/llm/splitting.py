"""Splitting oversized texts at natural boundaries.

A hierarchy of separators (section, paragraph, line, sentence, word, character)
is applied recursively: a part over the limit is cut by the next finer separator
until every atom fits. Atoms are packed greedily up to the limit, and each piece
starts ``overlap`` characters before the end of the one before it. Offsets are
code points of the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import latest, states, table

#: Each pattern matches where a part ends; the finest level cuts anywhere.
LEVELS = (
    re.compile(r"\n(?=#{1,6} |={1,6} ?[^=\n]+ ?={1,6}$|\\(?:sub)*section\{|\.\. _)|(?=<h[1-6][ >])|\f|\n(?=[^\n]+\n[=~^-]{4,}$)", re.M),
    re.compile(r"\n[ \t\r]*\n\s*|(?<=</p>)|(?<=</P>)|(?<=</div>)|(?<=</li>)"),
    re.compile(r"\n"),
    re.compile(r"(?<=[.!?…؟])[\"'”’»)\]]*\s+|(?<=[。！？])"),
    re.compile(r"\s+"),
)


def atoms(text: str, a: int, z: int, cap: int, level: int = 0) -> list[int]:
    """Ends of the atoms of text[a:z], each at most ``cap`` long."""
    if z - a <= cap:
        return [z]
    if level == len(LEVELS):
        return [*range(a + cap, z, cap), z]
    ends, at = [], a
    cuts = [m.end() for m in LEVELS[level].finditer(text, a, z)]
    for e in [*cuts, z]:
        if e > at:
            ends += atoms(text, at, e, cap, level + 1)
            at = e
    return ends


def split_text(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Pieces (start, end) of at most ``limit`` code points; neighbours share ``overlap`` (less than the limit)."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ends = atoms(text, 0, len(text), limit - overlap)
    pieces, start, i = [], 0, 0
    while i < len(ends):
        j = i
        while j + 1 < len(ends) and ends[j + 1] - start <= limit:
            j += 1
        pieces.append((start, ends[j]))
        start, i = ends[j] - overlap, j + 1
    return pieces


def split_documents(df: DataFrame, key: str = "doc_id", text: str = "text", limit: str = "max_chars", overlap: str = "overlap_chars") -> DataFrame:
    """(key, chunk_index, char_start, char_end, piece) with the limit and overlap taken from columns.

    A null or empty text gives no piece; a null limit leaves the text whole, a
    null overlap is 0. Long texts are cut row by row, so a batch never holds
    more than its own rows and their pieces.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys = b.column(0)
            rows, no, start, end, piece = [], [], [], [], []
            for i, (t, lim, lap) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                for k, (a, z) in enumerate(split_text(t or "", len(t or "") or 1 if lim is None else lim, lap or 0)):
                    rows.append(i)
                    no.append(k)
                    start.append(a)
                    end.append(z)
                    piece.append(t[a:z])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string())], names=[key, "chunk_index", "char_start", "char_end", "piece"])

    return df.select(key, text, limit, overlap).mapInArrow(run, f"`{key}` {kind}, chunk_index int, char_start int, char_end int, piece string")


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States with their collection's limits; chunker_configs is a fixed table of 60 rows."""
    configs = table(spark, sf_dir, "chunker_configs").select("collection_id", "max_chars", "overlap_chars").dropDuplicates(["collection_id"])
    df = states(spark, sf_dir, "collection_id").join(F.broadcast(configs), "collection_id", "left")
    return df.withColumn("over", F.coalesce(F.length("text") > F.col("max_chars"), F.lit(False)))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized current records."""
    df = _limited(spark, sf_dir)
    now = df.groupBy("doc_id").agg(F.max("stored_at").alias("stored_at"), F.max_by("over", "stored_at").alias("over")).where("over").drop("over")
    whole = df.where("over").select("doc_id", "stored_at", "text", "max_chars", "overlap_chars").join(now, ["doc_id", "stored_at"])
    return split_documents(whole.dropDuplicates(["doc_id"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current records that the splitter cuts into more than one piece."""
    df = _limited(spark, sf_dir)
    # texts within their limit stay in the JVM; each state sends its number of pieces
    sent = df.select(F.struct("doc_id", "stored_at").alias("state"), F.when(F.col("over"), F.col("text")).alias("text"), "max_chars", "overlap_chars")

    def count(batches):
        for b in batches:
            n = [len(split_text(t, lim, lap or 0)) if t is not None else 1 for t, lim, lap in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["state", "pieces"])

    got = sent.mapInArrow(count, "state struct<doc_id:string,stored_at:timestamp>, pieces int").select("state.*", "pieces")
    return latest(got, "pieces").where("pieces > 1").select("doc_id")


ORACLE = {
    "p4_found": """
        with ranked as (
          select doc_id, collection_id, json_data, row_number() over (partition by doc_id order by stored_at desc) as rn
          from corpus_documents),
        texts as (
          select doc_id, collection_id, json_extract_string(json_data, '$.text') as text
          from ranked where rn = 1 and json_valid(json_data))
        select t.doc_id from texts t join chunker_configs c on t.collection_id = c.collection_id
        where length(t.text) > c.max_chars""",
}
QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
