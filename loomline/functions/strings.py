"""String, URI and array helpers as column expressions. Null in gives null out unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_SCHEMES = ("http", "https")


def drop_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, F.length(text))).otherwise(text)


def drop_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix) & F.lit(bool(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def shorten_middle(text: Column, length: int, mark: str = "...") -> Column:
    """A text of at most ``length`` characters: a longer one keeps its start and end, the start taking the odd character."""
    keep = max(0, length - len(mark))
    tail = keep // 2
    cut = F.concat(F.substring(text, 1, keep - tail), F.lit(mark[:length]), F.right(text, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(text) > length, cut).otherwise(text)


def scheme_of(uri: Column) -> Column:
    """The scheme in lower case, empty without one."""
    return F.lower(F.regexp_extract(uri, r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*):", 1))


def safe_uri(uri: Column, schemes: tuple[str, ...] = SAFE_SCHEMES, longest: int = 2048) -> Column:
    """The URI without control characters and outer blanks, cut to ``longest``; null if its scheme isn't allowed or it has no host."""
    bare = F.trim(F.regexp_replace(uri, r"[\x00-\x1F\x7F]", ""))
    ok = scheme_of(bare).isin(*schemes) & bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+")
    return F.when(ok, F.substring(bare, 1, longest))


def clean_line(text: Column, longest: int) -> Column:
    """One line: control characters and white space as single blanks, cut to ``longest`` with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F\s]+", " "))
    return F.when(F.length(one) > longest, F.concat(F.substring(one, 1, longest - 1), F.lit("…"))).otherwise(one)


def join_uri(base: Column, path: str) -> Column:
    """A path appended to a URI, before its query, with one slash between."""
    head, query = F.regexp_extract(base, r"^([^?#]*)", 1), F.regexp_extract(base, r"^[^?#]*(.*)$", 1)
    return F.concat(F.regexp_replace(head, "/+$", ""), F.lit("/" + path.lstrip("/")), query)


def add_query(uri: Column, key: str, value: Column) -> Column:
    """A URI with one more query parameter."""
    sign = F.when(uri.contains("?"), "&").otherwise("?")
    return F.concat(uri, sign, F.lit(f"{key}="), F.url_encode(value))


def bad_text(text: Column) -> Column:
    """What makes a text unfit for a chunker: 'null', 'nul' (a NUL character), 'surrogate' (a lone half of a pair, which arrives as a replacement sign or in that range), else null."""
    return F.when(text.isNull(), "null").when(text.contains("\x00"), "nul").when(text.rlike(r"[\x{D800}-\x{DFFF}]"), "surrogate")


def finiteness(values: Column) -> Column:
    """Of an array of numbers: 'nan' if it has one, else 'inf' if it has one, else 'finite'; null elements count as NaN."""
    x = F.transform(values, lambda v: v.cast("double"))
    return F.when(values.isNull(), None).when(F.exists(x, lambda v: v.isNull() | F.isnan(v)), "nan").when(F.exists(x, lambda v: F.abs(v) == float("inf")), "inf").otherwise("finite")


def offsets_of(text: Column, parts: Column) -> Column:
    """(char_start, char_end) of each part, searched one after the other from the end of the one before; a part that isn't found lies at the cursor."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char_start:int,char_end:int>>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        hit = F.position(p, text, acc["at"] + 1)
        a = F.when(hit > 0, hit - 1).otherwise(acc["at"]).cast("int")
        z = F.when(hit > 0, a + F.length(p)).otherwise(acc["at"]).cast("int")
        return F.struct(z.alias("at"), F.array_append(acc["done"], F.struct(a.alias("char_start"), z.alias("char_end"))).alias("done"))

    return F.aggregate(parts, start, step, lambda acc: acc["done"])
