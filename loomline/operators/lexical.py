"""Words of documents: stop words by language, stems, dictionaries, bags of words, language by frequent words, and sentence splitters by script."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .ordered import running_total

#: ISO code to the name that stop-word lists go by (fixed values).
LANGUAGE_NAMES = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian", "it": "italian",
    "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish",
}
#: Frequent short words by language (fixed values).
COMMON_WORDS = {
    "de": "der die das und ist nicht mit für auf eine", "en": "the and of is in that for with each when", "es": "el los las que del una por con para se",
    "fr": "le les des est une dans pour que avec la", "it": "il gli che della per una con sono di si", "nl": "de het een van en niet met voor op is",
    "pl": "się nie jest na do że z dla po od", "pt": "os das que uma para com não por em do", "tr": "ve bir için ile bu olarak daha her ne sonra",
}


def language_name(code: str | None, default: str = "english") -> str:
    """The list name of a code such as en, en-GB or English; the default for what isn't known."""
    low = (code or "").strip().lower()
    return low if low in LANGUAGE_NAMES.values() else LANGUAGE_NAMES.get(low.replace("_", "-").split("-")[0], default)


def stop_words(spark: SparkSession, languages: list[str]) -> DataFrame:
    """(language, word) of the lists that come with the engine, for a few languages by code or name."""
    from pyspark.ml.feature import StopWordsRemover

    rows = [(c, w) for c in languages for w in StopWordsRemover.loadDefaultStopWords(language_name(c))]
    return spark.createDataFrame(rows, "language string, word string")


def stem_plural(word: Column) -> Column:
    """An English word without its plural ending: -ies becomes -y (not -eies, -aies), -es becomes -e (not -aes, -ees, -oes), -s goes (not -us, -ss)."""
    return (
        F.when(word.rlike(r"[^ea]ies$"), F.regexp_replace(word, r"ies$", "y"))
        .when(word.rlike(r"[^aeo]es$"), F.regexp_replace(word, r"s$", ""))
        .when(word.rlike(r"[^us]s$"), F.regexp_replace(word, r"s$", ""))
        .otherwise(word)
    )


def process_tokens(tokens: Column, stop: list[str] = (), min_length: int = 1, letters_only: bool = False, lower: bool = True, stem: Callable[[Column], Column] | None = None) -> Column:
    """Tokens in lower case, without stop words, short words and, if asked, all with other than letters, then stemmed. Null gives an empty array."""
    x = F.coalesce(tokens, F.array().cast("array<string>"))
    if lower:
        x = F.transform(x, lambda w: F.lower(w))
    ok = lambda w: (F.length(w) >= min_length) & (~F.lower(w).isin(*stop) if stop else F.lit(True)) & (w.rlike(r"^\p{L}+$") if letters_only else F.lit(True))
    x = F.filter(x, ok)
    return F.transform(x, stem) if stem else x


def enrich(df: DataFrame, text: str, tokenizer: Callable[[Column], Column] | None = None, stem: Callable[[Column], Column] | None = None, lemmas: dict[str, str] | None = None, stop: list[str] = ()) -> DataFrame:
    """Adds tokens, stems and lemmas of a text column. A tokenizer, a stemmer and a table of irregular lemmas can be given; a word that isn't in the table has its stem as lemma."""
    cut = tokenizer or (lambda c: X.tokens(c, True))
    stem = stem or stem_plural
    table = F.create_map(*[F.lit(x) for kv in (lemmas or {"": ""}).items() for x in kv])
    x = df.withColumn("tokens", process_tokens(cut(F.col(text)), stop)).withColumn("stems", F.transform("tokens", stem))
    return x.withColumn("lemmas", F.transform("tokens", lambda w: F.coalesce(F.try_element_at(table, w), stem(w))))


def dictionary(df: DataFrame, text: str) -> DataFrame:
    """(token, token_id, n, docs): tokens numbered in order from 0, with their counts. An empty corpus raises nothing and has no tokens."""
    from .chunking import vocabulary

    v = vocabulary(df, text).withColumn("_one", F.lit(1))
    return running_total(v, [F.asc("token")], {"_id": "_one"}).select("token", (F.col("_id") - 1).alias("token_id"), "n", "docs")


def bag_of_words(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, token_id, n): how often each document has each token of a dictionary; counts combine before they meet it."""
    t = df.select(key, F.explode(X.tokens(F.col(text), False)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return t.join(known.select("token", "token_id"), "token").select(key, "token_id", "n")


def language_by_words(text: Column, least_tokens: int = 5, fallback: str | None = None, least_share: float = 0.05) -> Column:
    """A struct (language, confidence) by the share of tokens that are frequent words of each language: a baseline without a model. Fewer tokens, or a lower share, give the fallback with confidence 0; ties go to the first code."""
    words = X.tokens(text, True)
    n = F.size(words)
    times = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    counts = {c: times(ws.split()) for c, ws in sorted(COMMON_WORDS.items())}
    top = F.greatest(*counts.values())
    lang = F.lit(None).cast("string")
    for c, k in sorted(counts.items(), reverse=True):
        lang = F.when(k == top, c).otherwise(lang)
    sure = (n >= least_tokens) & (top >= least_share * n)
    share = F.round(F.try_divide(top, n), 6)
    return F.struct(F.when(sure, lang).otherwise(F.lit(fallback)).alias("language"), F.when(sure, share).otherwise(0.0).alias("confidence"))


def label_language(df: DataFrame, text: str, label: str, detect: Callable[[Column], Column] = language_by_words, least_confidence: float = 0.1, overwrite: bool = False) -> DataFrame:
    """Fills a language column where it is null (everywhere with ``overwrite``) with what a detector is sure enough of; otherwise it stays."""
    x = df.withColumn("_l", detect(F.col(text)))
    new = F.when(F.col("_l.confidence") >= least_confidence, F.col("_l.language"))
    return x.withColumn(label, F.coalesce(new, F.col(label)) if overwrite else F.coalesce(F.col(label), new)).drop("_l")


def sentences_by_script(df: DataFrame, key: str, text: str, min_length: int = 1) -> DataFrame:
    """(key, chunk_index, script, chunk): wide full stops end sentences in Han and kana, danda in Indic scripts, others need white space after them. The script is the text's own."""
    kind = X.script(F.col(text))
    wide = F.regexp_replace(F.col(text), r"([。！？])\s*", "$1\x01")
    narrow = F.regexp_replace(F.col(text), r"([.!?؟।])\s+", "$1\x01")
    x = df.where(F.col(text).isNotNull()).select(key, kind.alias("script"), F.when(kind.isin("han", "kana"), wide).otherwise(narrow).alias("m"))
    parts = F.filter(F.transform(F.split("m", "\x01"), lambda p: F.trim(p)), lambda p: F.length(p) >= min_length)
    return x.select(key, "script", F.posexplode(parts).alias("chunk_index", "chunk"))


def sentence_chunks(df: DataFrame, key: str, text: str, split: Callable[[str], list[str]] | None = None, min_length: int = 1) -> DataFrame:
    """(key, chunk_index, char_start, char_end, chunk): sentences with their places; ``split`` brings a splitter of one's own, which runs in Arrow batches. Texts that are null or hold NUL give no chunk."""
    from ..functions.strings import bad_text, offsets_of

    fine = df.where(bad_text(F.col(text)).isNull())
    if split is None:
        parts = X.split_sentences(F.col(text))
    else:

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def own(s: pd.Series) -> pd.Series:
            return s.map(lambda x: list(split(x)))

        parts = own(text)
    x = fine.select(key, F.col(text).alias("t"), parts.alias("p")).withColumn("o", offsets_of(F.col("t"), F.col("p")))
    rows = x.select(key, F.posexplode(F.arrays_zip("p", "o")).alias("chunk_index", "z")).select(key, "chunk_index", F.col("z.o.char_start").alias("char_start"), F.col("z.o.char_end").alias("char_end"), F.col("z.p").alias("chunk"))
    return rows.where(F.length("chunk") >= min_length)


def keep_within(df: DataFrame, key: str, parts: Column, least: int, most: int, joiner: str = " ") -> DataFrame:
    """(key, chunk_index, chunk) within limits of white-space tokens: parts above ``most`` are cut, parts below ``least`` join the next one as long as it fits, and a short last one joins the one before."""
    words = lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != "")
    cut = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(words(p)) / most).cast("int") - 1)), lambda i: F.array_join(F.slice(words(p), i * most + 1, most), joiner))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    size = lambda p: F.size(words(p))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["open"] != "") & (size(acc["open"]) < least) & (size(acc["open"]) + size(p) <= most)
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, F.concat(acc["open"], F.lit(joiner), p)).otherwise(p).alias("open"))

    def close(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.element_at(acc["done"], -1)
        back = (n > 0) & (size(acc["open"]) < least) & (size(last) + size(acc["open"]) <= most)
        joined = F.array_append(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.concat(last, F.lit(joiner), acc["open"]))
        return F.when(acc["open"] == "", acc["done"]).when(back, joined).otherwise(F.array_append(acc["done"], acc["open"]))

    x = df.select(key, F.filter(cut, lambda p: p != "").alias("_p"))
    return x.select(key, F.posexplode(F.aggregate("_p", start, step, close)).alias("chunk_index", "chunk"))


def normalize_graphemes(df: DataFrame, text: str, form: str = "NFC", longest: int | None = None) -> DataFrame:
    """Adds clean_text (without byte order marks and control characters, composed), n_codepoints and n_graphemes; a text longer than ``longest`` has null in all three. Pure ASCII stays in the JVM."""

    @F.pandas_udf(T.StringType())
    def compose(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: unicodedata.normalize(form, x) if x is not None else None)

    bare = F.regexp_replace(F.regexp_replace(F.col(text), "﻿", ""), r"[\p{Cc}&&[^\n\t]]", "")
    fits = F.lit(True) if longest is None else F.length(text) <= longest
    x = df.withColumn("_b", F.when(fits, bare))
    x = x.withColumn("clean_text", F.when(F.col("_b").rlike(r"[^\x00-\x7F]"), compose("_b")).otherwise(F.col("_b"))).drop("_b")
    return x.withColumn("n_codepoints", F.length("clean_text")).withColumn("n_graphemes", X.grapheme_count(F.col("clean_text")))
