"""Queries on words, languages, string helpers and further chunkers, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..functions import strings as Z
from ..functions import text as X
from ..operators import lexical as L
from ..session import spread
from .evaluation import t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def docs(s, d, *more):
    return spread(t(s, d, "documents").select("doc_id", "text", *more))


_TOK = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))"
_UTOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+')"
_STEM = (
    "case when regexp_matches({w}, '[^ea]ies$') then regexp_replace({w}, 'ies$', 'y') when regexp_matches({w}, '[^aeo]es$') then regexp_replace({w}, 's$', '') "
    "when regexp_matches({w}, '[^us]s$') then regexp_replace({w}, 's$', '') else {w} end"
)

query("casefold_text", "select doc_id, lower(text) as folded from documents where regexp_full_match(text, '[\\x00-\\x7F]*')")(
    lambda s, d: docs(s, d).where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", X.casefold(F.col("text")).alias("folded"))
)
query("strip_punctuation", r"select doc_id, regexp_replace(text, '\p{P}+', '', 'g') as clean from documents")(lambda s, d: docs(s, d).select("doc_id", X.strip_punctuation(F.col("text")).alias("clean")))
query("strip_controls", r"select doc_id, replace(regexp_replace(replace(replace(text, chr(10), '<lf>'), chr(9), '<tab>'), '[\p{Cc}\p{Cf}]', '', 'g'), '<lf>', chr(10)) as clean from documents where text not like '%<tab>%' and text not like '%<lf>%' and text not like '%' || chr(9) || '%'")(
    lambda s, d: docs(s, d).where(~F.col("text").rlike("\t|<lf>|<tab>")).select("doc_id", X.strip_controls(F.col("text")).alias("clean"))
)
query("stems", f"select doc_id, list_transform({_TOK}, lambda w: {_STEM.format(w='w')}) as stems from documents")(
    lambda s, d: docs(s, d).select("doc_id", F.transform(X.tokens(F.col("text"), False), L.stem_plural).alias("stems"))
)
query(
    "process_tokens",
    f"select doc_id, list_transform(list_filter({_TOK}, lambda w: length(w) >= 4 and w not in ('when', 'with', 'each') and regexp_full_match(w, '[a-z]+')), lambda w: {_STEM.format(w='w')}) as tokens from documents where text is not null",
)(lambda s, d: docs(s, d).where("text is not null").select("doc_id", L.process_tokens(X.tokens(F.col("text"), False), ["when", "with", "each"], 4, True, stem=L.stem_plural).alias("tokens")))


def _enriched(s, d):
    return L.enrich(docs(s, d).where("text is not null"), "text", lambda c: X.tokens(c, False), lemmas={"was": "be", "is": "be", "are": "be", "has": "have"}).select("doc_id", "tokens", "stems", "lemmas")


query(
    "enrich_tokens",
    f"select doc_id, {_TOK} as tokens, list_transform({_TOK}, lambda w: {_STEM.format(w='w')}) as stems, list_transform({_TOK}, lambda w: case when w in ('was', 'is', 'are') then 'be' when w = 'has' then 'have' else {_STEM.format(w='w')} end) as lemmas from documents where text is not null",
)(_enriched)
_DICT = f"with x as (select doc_id, unnest({_TOK}) as token from documents), v as (select token, (row_number() over (order by token) - 1)::bigint as token_id, count(*) as n, count(distinct doc_id) as docs from x group by 1)"
query("token_dictionary", _DICT + " select * from v")(lambda s, d: L.dictionary(docs(s, d), "text"))
query("bag_of_words", _DICT + " select doc_id, token_id, count(*) as n from x join v using (token) group by 1, 2")(lambda s, d: L.bag_of_words(docs(s, d), "doc_id", "text", L.dictionary(docs(s, d), "text")))
_SCORES = ", ".join("len(list_filter(w, lambda x: x in ({}))) as {}".format(", ".join(f"'{w}'" for w in ws.split()), f"c_{c}") for c, ws in sorted(L.COMMON_WORDS.items()))
_TOP = "greatest(" + ", ".join(f"c_{c}" for c in sorted(L.COMMON_WORDS)) + ")"
_PICK = "case " + " ".join(f"when c_{c} = {_TOP} then '{c}'" for c in sorted(L.COMMON_WORDS)) + " end"
_BYWORDS = f"with x as (select doc_id, lang, {_UTOK} as w from documents where text is not null), c as (select doc_id, lang, len(w) as n, {_SCORES} from x), r as (select doc_id, lang, case when n >= 5 and {_TOP} >= 0.05 * n then {_PICK} end as language, case when n >= 5 and {_TOP} >= 0.05 * n then round({_TOP} / n, 6) else 0 end as confidence from c)"
query("language_by_words", _BYWORDS + " select doc_id, language, confidence::double as confidence from r")(
    lambda s, d: docs(s, d).where("text is not null").withColumn("l", L.language_by_words(F.col("text"))).select("doc_id", "l.language", "l.confidence")
)
query("label_language", _BYWORDS + " select doc_id, coalesce(lang, case when confidence >= 0.1 then language end) as lang from r")(lambda s, d: L.label_language(docs(s, d, "lang").where("text is not null"), "text", "lang").select("doc_id", "lang"))
query(
    "language_names",
    "select iso_code, case iso_code when 'de' then 'german' when 'en' then 'english' when 'es' then 'spanish' when 'fr' then 'french' when 'it' then 'italian' when 'nl' then 'dutch' when 'pt' then 'portuguese' when 'ru' then 'russian' when 'tr' then 'turkish' else 'english' end as list_name from language_codes",
)(lambda s, d: t(s, d, "language_codes").select("iso_code", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.LANGUAGE_NAMES.items() for x in kv]), F.col("iso_code")), F.lit("english")).alias("list_name")))
query("stop_word_lists")(lambda s, d: L.stop_words(s, ["en", "de-AT", "fr", "xx"]).groupBy("language").agg(F.count("*").alias("n")))

_SCRIPTS = ", ".join(f"length(regexp_replace(text, '[^\\p{{{v}}}]', '', 'g')) as {k}" for k, v in (("latin", "Latin"), ("cyrillic", "Cyrillic"), ("arabic", "Arabic"), ("han", "Han"), ("kana", "Hiragana}\\p{Katakana")))
_SCRIPT = f"with c as (select doc_id, text, {_SCRIPTS} from documents where text is not null), k as (select *, greatest(latin, cyrillic, arabic, han, kana) as top from c), s as (select doc_id, text, case when top = 0 then null when kana * 5 > top then 'kana' when latin = top then 'latin' when cyrillic = top then 'cyrillic' when arabic = top then 'arabic' when han = top then 'han' else 'kana' end as script from k)"
ORACLE["script_of_text"] = _SCRIPT + " select doc_id, script from s union all select doc_id, null from documents where text is null"
query(
    "sentences_by_script",
    _SCRIPT
    + r""", m as (select doc_id, script, case when script in ('han', 'kana') then regexp_replace(text, '([。！？])\s*', '\1' || chr(1), 'g') else regexp_replace(text, '([.!?؟।])\s+', '\1' || chr(1), 'g') end as m from s),
    p as (select doc_id, script, list_filter(list_transform(string_split(m, chr(1)), lambda x: trim(x)), lambda x: length(x) >= 1) as p from m)
    select doc_id, script, unnest(range(len(p)))::int as chunk_index, unnest(p) as chunk from p""",
)(lambda s, d: L.sentences_by_script(docs(s, d), "doc_id", "text"))
ORACLE["grapheme_counts"] = "select doc_id, length_grapheme(replace(text, chr(13) || chr(10), chr(10)))::int as graphemes, length(text)::int as codepoints from documents"
query(
    "normalize_graphemes",
    "select doc_id, length(nfc_normalize(b))::int as n_codepoints, length_grapheme(nfc_normalize(b))::int as n_graphemes from (select doc_id, regexp_replace(replace(text, chr(65279), ''), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', '', 'g') as b from documents)",
)(lambda s, d: L.normalize_graphemes(docs(s, d), "text").select("doc_id", "n_codepoints", "n_graphemes"))
query("sentence_offsets")(lambda s, d: L.sentence_chunks(docs(s, d), "doc_id", "text"))
query("custom_sentences", "select doc_id, chunk_index, chunk from (select doc_id, unnest(range(len(p)))::int as chunk_index, unnest(p) as chunk from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null)) where length(chunk) >= 1")(
    lambda s, d: L.sentence_chunks(docs(s, d), "doc_id", "text", lambda x: x.split("\n")).select("doc_id", "chunk_index", "chunk")
)
query("offsets_cover", "select doc_id, true as fits from documents where text is not null")(
    lambda s, d: L.sentence_chunks(docs(s, d), "doc_id", "text").join(docs(s, d), "doc_id").withColumn("ok", F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("chunk")).groupBy("doc_id").agg(F.bool_and("ok").alias("ok")).join(docs(s, d).where("text is not null").select("doc_id"), "doc_id", "right").select("doc_id", F.coalesce("ok", F.lit(True)).alias("fits"))
)
_LINES = "list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')"
query("keep_within")(lambda s, d: L.keep_within(docs(s, d), "doc_id", F.split("text", "\n"), 8, 24))

query("bad_texts", "select doc_id, case when text is null then 'null' when contains(text, chr(0)) then 'nul' end as bad from documents")(lambda s, d: docs(s, d).select("doc_id", Z.bad_text(F.col("text")).alias("bad")))
query(
    "path_strings",
    r"""select distinct input_path, case when starts_with(input_path, 'corpora/') then substr(input_path, 9) else input_path end as bare,
    case when suffix(input_path, '.md') then left(input_path, length(input_path) - 3) else input_path end as stem,
    case when length(input_path) > 21 then left(input_path, 9) || '...' || right(input_path, 9) else input_path end as short from reader_files""",
)(lambda s, d: t(s, d, "reader_files").select("input_path").distinct().select("input_path", Z.drop_prefix(F.col("input_path"), "corpora/").alias("bare"), Z.drop_suffix(F.col("input_path"), ".md").alias("stem"), Z.shorten_middle(F.col("input_path"), 21).alias("short")))
_U = "case when o_orderkey % 4 = 0 then 'ftp' when o_orderkey % 4 = 1 then 'HTTPS' else 'http' end || '://h.example/a/?k=' || o_orderkey"


def _uris(s, d):
    k = F.col("o_orderkey")
    scheme = F.when(k % 4 == 0, "ftp").when(k % 4 == 1, "HTTPS").otherwise("http")
    u = F.concat(F.lit("\t "), scheme, F.lit("://h.example/a/?k="), k.cast("string"), F.lit("\n"))
    x = t(s, d, "orders").select("o_orderkey", "o_orderpriority", Z.safe_uri(u).alias("safe"), Z.scheme_of(u).alias("scheme"))
    return x.select("o_orderkey", "safe", "scheme", Z.join_uri(F.col("safe"), "/b").alias("below"), Z.add_query(F.col("safe"), "p", F.col("o_orderpriority")).alias("asked"), Z.clean_line(F.concat(F.lit("a\n\tb "), "o_orderpriority"), 9).alias("line"))


query(
    "uris",
    f"""with x as (select o_orderkey, o_orderpriority, {_U} as u, lower(regexp_extract({_U}, '^([A-Za-z]+):', 1)) as scheme from orders), y as (select *, case when scheme in ('http', 'https') then u end as safe from x)
    select o_orderkey, safe, scheme, regexp_replace(safe, '/\\?', '/b?') as below, safe || '&p=' || replace(url_encode(o_orderpriority), '%20', '+') as asked,
    case when length('a b ' || o_orderpriority) > 9 then left('a b ' || o_orderpriority, 8) || '…' else 'a b ' || o_orderpriority end as line from y""",
)(_uris)
query("finiteness", "select vec_id, case when vec_id % 7 = 0 then 'nan' when vec_id % 7 = 1 then 'inf' else 'finite' end as status from embeddings")(
    lambda s, d: t(s, d, "embeddings").select(
        "vec_id",
        Z.finiteness(F.when(F.col("vec_id") % 7 == 0, F.array_append("embedding", F.lit(float("nan")).cast("float"))).when(F.col("vec_id") % 7 == 1, F.array_append("embedding", F.lit(float("inf")).cast("float"))).otherwise(F.col("embedding"))).alias("status"),
    )
)

# folds of the chunkers, as recursion over the parts
_FOLD = """with recursive p as (select doc_id, {parts} as p from documents where trim(text) <> ''),
 r(doc_id, i, p, done, open) as (select doc_id, 1, p, []::varchar[], '' from p union all {step}),
 e as (select doc_id, p, done, open from r where i = len(p) + 1)"""
_PARA = "list_filter(list_transform(string_split_regex(text, '\\r?\\n[ \\t\\r]*\\n'), lambda p: trim(p)), lambda p: p <> '')"
_JOIN = "case when open = '' then p[i] else open || chr(10) || chr(10) || p[i] end"
ORACLE["merge_short_paragraphs"] = (
    _FOLD.format(parts=_PARA, step=f"select doc_id, i + 1, p, case when length({_JOIN}) >= 400 then list_append(done, {_JOIN}) else done end, case when length({_JOIN}) >= 400 then '' else {_JOIN} end from r where i <= len(p)")
    + """, f as (select doc_id, case when open = '' then done when len(done) = 0 then [open] else list_append(done[1:len(done) - 1], done[len(done)] || chr(10) || chr(10) || open) end as c from e)
 select doc_id, unnest(range(len(c)))::int as chunk_index, unnest(c) as chunk from f"""
)
_SENT = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
ORACLE["pack_sentences"] = (
    _FOLD.format(parts=_SENT, step="select doc_id, i + 1, p, case when open = '' or length(open || ' ' || p[i]) <= 400 then done else list_append(done, open) end, case when open = '' then p[i] when length(open || ' ' || p[i]) <= 400 then open || ' ' || p[i] else p[i] end from r where i <= len(p)")
    + """, f as (select doc_id, case when open = '' then done else list_append(done, open) end as c from e)
 select doc_id, unnest(range(len(c)))::int as chunk_index, unnest(c) as chunk from f"""
)

query("user_aggregate", "select o_orderpriority, round(median(o_totalprice) - min(o_totalprice), 4) as value from orders group by 1")(
    lambda s, d: H.group_statistic(t(s, d, "orders"), ["o_orderpriority"], "o_totalprice", lambda x: sorted(x)[(len(x) - 1) // 2] / 2 + sorted(x)[len(x) // 2] / 2 - x.min()).withColumn("value", F.round("value", 4))
)
query("optional_keywords", "select doc_id, null::varchar[] as keywords from documents")(lambda s, d: docs(s, d).select("doc_id", H.optional("yake", lambda x: [x])(F.col("text")).alias("keywords")))


def _built(s, d):
    return H.CorpusBuilder(
        lambda: docs(s, d),
        filter=lambda: lambda x: x.where("trim(text) <> ''"),
        chunker=lambda: lambda x: x.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda p: p != "")).alias("chunk_index", "chunk")),
        enricher=lambda: lambda x: x.withColumn("n_words", X.word_count(F.col("chunk"))),
    ).build()


query(
    "corpus_builder",
    "select doc_id, chunk_index, chunk, case when trim(regexp_replace(chunk, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(chunk, '\\s+', ' ', 'g')), ' ')) end::int as n_words from (select doc_id, unnest(range(len(p)))::int as chunk_index, unnest(p) as chunk from (select doc_id, list_filter(string_split(text, chr(10)), lambda p: p <> '') as p from documents where trim(text) <> ''))",
)(_built)
query("human_sizes", "select event_id, case when n < 1024 then format('{:.1f} B', n::double) when n < 1024 ** 2 then format('{:.1f} KB', n / 1024.0::double) when n < 1024 ** 3 then format('{:.1f} MB', n / 1048576.0::double) when n < 1024.0 ** 4 then format('{:.1f} GB', n / 1073741824.0::double) when n < 1024.0 ** 5 then format('{:.1f} TB', n / 1099511627776.0::double) else format('{:.1f} PB', n / 1125899906842624.0::double) end as size from (select event_id, ((event_id + 3) << ((event_id % 10 * 4)::int + 1)) + 1 as n from events)")(
    lambda s, d: t(s, d, "events").select("event_id", X.human_size(F.expr("shiftleft(event_id + 3, cast(event_id % 10 * 4 as int) + 1) + 1")).alias("size"))
)
query("unicode_nfc", "select doc_id, nfc_normalize(text) as clean from documents")(lambda s, d: docs(s, d).select("doc_id", X.unicode_form(F.col("text"), "NFC").alias("clean")))


def _registered(s, d):
    parts = H.Registry()
    parts.add("tokenizer", "small", lambda c: F.regexp_extract_all(c, F.lit("([a-z]+)"), F.lit(1)))
    parts.add("stemmer", "head", lambda w: F.substring(w, 1, 3))
    x = L.enrich(docs(s, d).where("text is not null"), "text", parts.get("tokenizer", "small"), parts.get("stemmer", "head"))
    return x.select("doc_id", "tokens", "stems")


query("registered_parts", "select doc_id, t as tokens, list_transform(t, lambda w: w[1:3]) as stems from (select doc_id, regexp_extract_all(text, '[a-z]+') as t from documents where text is not null)")(_registered)
