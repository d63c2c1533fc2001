"""Cutting texts into chunks: (key, chunk_index, chunk[, char_start, char_end]).

Null and blank texts give no chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _some(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.trim("text") != ""))


def fixed_window_chars(df: DataFrame, key: str, text: str, size: int, overlap: int = 0, min_length: int = 1) -> DataFrame:
    """Windows of ``size`` code points, each ``overlap`` into the one before; the last ends with the text. Windows are stripped, and numbered before short ones are left out."""
    step = size - overlap
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    x = _some(df, key, text).select(key, "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    x = x.select(key, "chunk_index", (F.col("chunk_index") * step).alias("char_start"), F.least(F.col("chunk_index") * step + size, n).alias("char_end"), F.trim(F.substring(F.col("text"), F.col("chunk_index") * step + 1, F.lit(size))).alias("chunk"))
    return x.where(F.length("chunk") >= min_length)


def fixed_window_tokens(df: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` white-space tokens, joined by blanks."""
    step = size - overlap
    x = _some(df, key, text).select(key, F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("t"))
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - size) / step)).cast("int")
    x = x.select(key, "t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return x.select(key, "chunk_index", F.array_join(F.slice("t", F.col("chunk_index") * step + 1, F.lit(size)), " ").alias("chunk"))


def _split(df: DataFrame, key: str, parts: Column, min_length: int) -> DataFrame:
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & (F.length(p) >= min_length))
    return df.select(key, F.posexplode(kept).alias("chunk_index", "chunk"))


def paragraphs(df: DataFrame, key: str, text: str, min_length: int = 1) -> DataFrame:
    """Parts between blank lines, stripped, numbered after short ones are left out."""
    return _split(_some(df, key, text), key, F.split("text", r"\r?\n[ \t\r]*\n"), min_length)


def sentences(df: DataFrame, key: str, text: str, min_length: int = 1) -> DataFrame:
    """Parts after . ! or ? and white space before a capital, quote or bracket."""
    return _split(_some(df, key, text), key, F.split(F.regexp_replace("text", r"([.!?])\s+([A-Z\"'(\[])", "$1\x01$2"), "\x01"), min_length)


def with_context(chunks: DataFrame, key: str, before: int, joiner: str = "\n") -> DataFrame:
    """Each chunk with the ``before`` chunks ahead of it in front."""
    w = Window.partitionBy(key).orderBy("chunk_index").rowsBetween(-before, 0)
    return chunks.select(key, "chunk_index", F.array_join(F.collect_list("chunk").over(w), joiner).alias("chunk"))


def merge_short(df: DataFrame, key: str, parts: Column, min_length: int, joiner: str = "\n\n") -> DataFrame:
    """Parts of an array merged forward until each has ``min_length`` characters; a short rest joins the last one."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(joiner), p))
        full = F.length(joined) >= min_length
        return F.struct(F.when(full, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    def close(acc: Column) -> Column:
        n = F.size(acc["done"])
        tail = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["done"], -1), F.lit(joiner), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when(n == 0, F.array(acc["open"])).otherwise(tail)

    return df.select(key, F.posexplode(F.aggregate(parts, start, step, close)).alias("chunk_index", "chunk"))


def vocabulary(df: DataFrame, text: str, unicode: bool = False) -> DataFrame:
    """(token, n, docs) of a corpus; counts combine before the shuffle, also those of one hot token."""
    t = df.select(X.tokens(F.col(text), unicode).alias("t")).where("t is not null")
    # an entry for each token and one for each distinct token of a text: both counts come from one pass
    one = lambda c, n, d: F.transform(c, lambda w: F.struct(w.alias("token"), F.lit(n).alias("n"), F.lit(d).alias("d")))
    per = t.select(F.explode(F.concat(one(F.col("t"), 1, 0), one(F.array_distinct("t"), 0, 1))).alias("s")).select("s.*")
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


def vocabulary_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: vocab_size, total_tokens, avg_tokens_per_doc."""
    v = vocabulary(df, text).agg(F.count("*").alias("vocab_size"), F.sum("n").alias("total_tokens"))
    return v.join(F.broadcast(df.agg(F.count("*").alias("docs")))).select("vocab_size", "total_tokens", F.try_divide("total_tokens", "docs").alias("avg_tokens_per_doc"))


#: Distinct tokens up to which document frequencies are broadcast.
SMALL_VOCABULARY = 200_000


def keywords(df: DataFrame, key: str, text: str, top: int = 5, idf: bool = False) -> DataFrame:
    """(key, token, score, rank): the most frequent tokens of each document, or those with the highest tf-idf; ties by token.

    A document's repeated tokens combine before the shuffle. Document
    frequencies meet the rows by broadcast while there are few, else in a join
    whose frequent tokens are salted.
    """
    words = X.tokens(F.col(text), False)
    per = df.select(key, words.alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    if idf:
        n = df.agg(F.count("*").alias("docs"))
        seen = vocabulary(df, text).select("token", F.col("docs").alias("df"))
        if seen.limit(SMALL_VOCABULARY + 1).count() <= SMALL_VOCABULARY:
            per = per.join(F.broadcast(seen), "token")
        else:
            salts = 16
            seen = seen.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            per = per.withColumn("s", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(seen, ["token", "s"]).drop("s")
        per = per.join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") / F.col("dl") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1), 8))
    else:
        per = per.withColumn("score", F.col("tf").cast("double"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "token")
    return per.select(key, "token", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)


def parse_subtitles(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cue, start_s, end_s, cue_text) of SRT, VTT and SBV texts: blank-line blocks with a time line; tags are dropped."""
    clock = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"
    line = rf"{clock}\s*(?:-->|,)\s*{clock}"
    block = F.regexp_replace(F.col(text), "\r", "")
    x = df.select(key, F.posexplode(F.split(block, r"\n\s*\n")).alias("_i", "b")).where(F.col("b").rlike(line))
    part = lambda g: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("b", line, g), F.lit("")), F.lit("999999")).cast("double"), F.lit(0.0))
    seconds = lambda g: part(g) * 3600 + part(g + 1) * 60 + part(g + 2) + part(g + 3) / 1000
    body = F.regexp_replace("b", rf"(?s)^.*?{line}[^\n]*\n?", "")
    w = Window.partitionBy(key).orderBy("_i")
    return x.select(key, F.row_number().over(w).alias("cue"), seconds(1).alias("start_s"), seconds(5).alias("end_s"), F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>|\{[^}]*\}", ""), r"\s*\n\s*", " ")).alias("cue_text"))


def html_sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, element_index, html_tag, section_type, section_text) of titles, headings, paragraphs and list items."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:title|h[1-6]|p|li)[\s>].*?</(?:title|h[1-6]|p|li)>)"), F.lit(1))
    x = df.select(key, F.posexplode(found).alias("element_index", "e"))
    tag = F.lower(F.regexp_extract("e", r"(?i)^<([a-z0-9]+)", 1))
    kind = F.when(tag.isin("title", "h1"), "title").when(tag.startswith("h"), "header").otherwise("text")
    return x.select(key, "element_index", tag.alias("html_tag"), kind.alias("section_type"), F.trim(F.regexp_replace(X.strip_tags(F.col("e")), r"\s+", " ")).alias("section_text"))


def pack_parts(df: DataFrame, key: str, parts: Column, max_length: int, joiner: str = " ") -> DataFrame:
    """Parts of an array packed in order into chunks of at most ``max_length`` characters; a longer part stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(acc["open"], F.lit(joiner), p)
        fits = F.length(joined) <= max_length
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open"))).otherwise(F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, joined).otherwise(p).alias("open")))

    done = F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return df.select(key, F.posexplode(done).alias("chunk_index", "chunk"))


#: Frequent English words that carry no topic (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "each", "for", "from", "if", "in", "into", "is", "it", "its", "of", "on", "or", "our", "that", "the", "this", "to", "until", "was", "we", "when", "while", "with", "without")


def word_chunks(df: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = STOP_WORDS, min_length: int = 2, n: int = 1) -> DataFrame:
    """(key, tokens, ngrams): lower-case words without stop words, numbers and short words, and their n-grams."""
    w = df.select(key, F.col(text).alias("_t")).withColumn("_w", X.tokens(F.col("_t"), False))
    kept = F.filter("_w", lambda x: (F.length(x) >= min_length) & ~x.isin(*stop_words) & ~x.rlike("^[0-9]+$"))
    return w.select(key, kept.alias("tokens")).select(key, "tokens", X.ngrams(F.col("tokens"), n).alias("ngrams"))


def merge_similar(df: DataFrame, key: str, chunk: str, vector: str, order: str, threshold: float) -> DataFrame:
    """(key, chunk_index, chunk): neighbouring chunks of a document joined while the mean vector so far and the next one have at least this cosine. A document's chunks meet in one fold, never more."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chunk).alias("c"), F.transform(vector, lambda v: v.cast("double")).alias("v")))).alias("r"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.array().cast("array<double>").alias("sum"))

    def step(acc: Column, p: Column) -> Column:
        near = F.coalesce(F.try_divide(dot(acc["sum"], p["v"]), F.sqrt(dot(acc["sum"], acc["sum"]) * dot(p["v"], p["v"]))), F.lit(0.0)) >= threshold
        fresh = F.struct(acc["done"].alias("done"), p["c"].alias("open"), p["v"].alias("sum"))
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), p["c"]).alias("open"), F.zip_with(acc["sum"], p["v"], lambda x, y: x + y).alias("sum"))
        cut = F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), p["c"].alias("open"), p["v"].alias("sum"))
        return F.when(F.size(acc["sum"]) == 0, fresh).when(near, joined).otherwise(cut)

    return rows.select(key, F.posexplode(F.aggregate("r", start, step, lambda a: F.array_append(a["done"], a["open"]))).alias("chunk_index", "chunk"))


def parse_microdvd(df: DataFrame, key: str, text: str, frame_rate: float = 25.0) -> DataFrame:
    """(key, cue, start_s, end_s, cue_text) of {start}{end}text lines counted in frames; | breaks a line."""
    line = r"^\{([0-9]+)\}\{([0-9]+)\}(.*)$"
    x = df.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r", ""), "\n")).alias("_i", "l")).where(F.col("l").rlike(line))
    at = lambda g: F.regexp_extract("l", line, g).cast("double") / frame_rate
    w = Window.partitionBy(key).orderBy("_i")
    return x.select(key, F.row_number().over(w).alias("cue"), at(1).alias("start_s"), at(2).alias("end_s"), F.trim(F.regexp_replace(F.regexp_extract("l", line, 3), r"\|", " ")).alias("cue_text"))
