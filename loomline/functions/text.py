"""Text scalars as column expressions: normalisers, tokens, hashes and small parsers.

Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ligatures and what they stand for (fixed values).
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "Ǆ": "DZ", "ǅ": "Dz", "ǆ": "dz", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae",
}

#: File suffix to source type (fixed values).
SOURCE_TYPES = {
    "txt": "text", "md": "markdown", "rst": "documentation", "html": "web", "htm": "web", "pdf": "research", "xml": "document", "csv": "table", "tsv": "table",
    "json": "data", "jsonl": "data", "srt": "subtitle", "vtt": "subtitle", "sbv": "subtitle", "sub": "subtitle", "mp3": "audio", "wav": "audio", "mp4": "video", "png": "image", "jpg": "image", "zip": "archive", "py": "code",
}


def tokens(text: Column, unicode: bool = True) -> Column:
    """Lower-case word tokens; with ``unicode`` off, ASCII letters and digits only."""
    if unicode:
        return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.lower(w))


def word_count(text: Column) -> Column:
    """Words between white space; blank text has 0."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def collapse_whitespace(text: Column, keep_lines: bool = True) -> Column:
    """Runs of blanks as one blank, lines stripped, or, with ``keep_lines`` off, all white space as one blank."""
    if not keep_lines:
        return F.trim(F.regexp_replace(text, r"\s+", " "))
    one = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(one, r" ?\n ?", "\n"))


def strip_tags(text: Column) -> Column:
    """Text without <...> tags."""
    return F.regexp_replace(text, r"<[^>]+>", "")


def expand_ligatures(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def join_hyphenated(text: Column) -> Column:
    """Words that a line break split at a hyphen, joined again: a hyphen after a letter or digit, one line break among blanks, and a letter or digit goes away with all between."""
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N}_])-[\p{Z}\s&&[^\n]]*\n[\p{Z}\s]*(?=[\p{L}\p{N}_])", "")


def strip_controls(text: Column) -> Column:
    """Text without control and format characters other than line feed and tab."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{P}+", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x.casefold() if x is not None else None)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(lambda x: html.unescape(x) if x is not None else None)


def nfkc(text: Column) -> Column:
    """Compatibility composition; pure ASCII text, the usual case, never leaves the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """Text in a normal form of Unicode: NFC, NFD, NFKC or NFKD. Pure ASCII never leaves the JVM."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form!r}")

    @F.pandas_udf(T.StringType())
    def norm(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: unicodedata.normalize(form, x) if x is not None else None)

    return F.when(text.rlike(r"[^\x00-\x7F]"), norm(text)).otherwise(text)


def casefold(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), _casefold(text)).otherwise(F.lower(text))


def unescape(text: Column) -> Column:
    return F.when(text.contains("&"), _unescape(text)).otherwise(text)


def normalize_text(text: Column, lower: bool = False, min_length: int = 0) -> Column:
    """Unicode, ligatures, controls, hyphenation, white space, then case; a text that ends up shorter than ``min_length`` is null."""
    t = collapse_whitespace(join_hyphenated(strip_controls(expand_ligatures(nfkc(text)))))
    t = F.lower(t) if lower else t
    return F.when(F.length(t) >= min_length, t)


def grapheme_count(text: Column) -> Column:
    """User-perceived characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1)))


def ngrams(words: Column, n: int, joiner: str = "_") -> Column:
    """Neighbouring words joined; fewer than n words give an empty array."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), joiner))).otherwise(F.array().cast("array<string>"))


def type_token_ratio(words: Column) -> Column:
    """Distinct words over words; 0 without words."""
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)


def content_hash(text: Column) -> Column:
    """32 hex digits; empty or null text has zeros."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("0" * 32)).otherwise(F.substring(F.sha2(text, 256), 1, 32))


def document_id(*parts: Column) -> Column:
    """A stable id of its parts; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def source_type(path: Column) -> Column:
    """Source type by file suffix, in any case; 'unknown' for others."""
    m = F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("unknown"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dedup_lines(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text's lines without those that came before, compared without outer blanks; blank lines stay."""
    # columns of their own: an expression inside a lambda would be computed again for each line
    x = df.withColumn("_lines", F.split(text, "\n")).withColumn("_bare", F.transform("_lines", lambda y: F.trim(y)))
    pairs = F.arrays_zip(F.col("_lines").alias("l"), F.col("_bare").alias("b"))
    keep = F.filter(pairs, lambda s, i: (s["b"] == "") | (F.array_position(F.col("_bare"), s["b"]) == i + 1))
    return x.withColumn(out, F.array_join(F.transform(keep, lambda s: s["l"]), "\n")).drop("_lines", "_bare")


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each writing system."""
    names = {"latin": "IsLatin", "cyrillic": "IsCyrillic", "arabic": "IsArabic", "han": "IsHan", "kana": "IsHiragana}\\p{IsKatakana"}
    return {k: F.length(F.regexp_replace(text, rf"[^\p{{{v}}}]", "")) for k, v in names.items()}


def script(text: Column) -> Column:
    """The writing system with most letters; kana before Han, as Japanese mixes both; null for none."""
    c = script_counts(text)
    top = F.greatest(*c.values())
    out = F.when(top == 0, None).when(c["kana"] * 5 > top, "kana")
    for k, v in c.items():
        out = out.when(v == top, k)
    return out


def human_size(n: Column) -> Column:
    """Bytes as B to PB with one decimal."""
    out = F.when(n < 1024, F.concat(F.format_string("%.1f", n.cast("double")), F.lit(" B")))
    for i, u in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {u}")))
    return out.otherwise(F.concat(F.format_string("%.1f", n / float(1024**5)), F.lit(" PB")))


def redact(text: Column) -> Column:
    """E-mail addresses and telephone-like digit groups replaced by placeholders."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(t, r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -][0-9]{3,4}", "[PHONE]")


def split_sentences(text: Column) -> Column:
    """Sentences by the full stops of many scripts; wide ones need no blank after them."""
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?؟।።])\s+", "$1\x01"), r"([。！？])\s*", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.trim(x)), lambda x: x != "")


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def has_rtl(text: Column) -> Column:
    return text.rlike(r"[\p{IsArabic}\p{IsHebrew}]")


def split_cjk(text: Column) -> Column:
    """One token for each Han character, runs of letters and digits otherwise."""
    return F.regexp_extract_all(text, F.lit(r"(\p{IsHan}|[A-Za-z0-9]+)"), F.lit(1))


def natural_key(text: Column) -> Column:
    """A sort key by which every run of digits counts by its value and letters in lower case; numbers may be of any length."""
    part = lambda k: F.regexp_extract_all(text, F.lit("([^0-9]*)([0-9]*)"), F.lit(k))
    value = lambda d: F.regexp_replace(d, "^0+", "")
    return F.zip_with(part(1), part(2), lambda t, d: F.struct(F.lower(t).alias("text"), F.when(d != "", F.length(value(d))).alias("size"), value(d).alias("digits")))
