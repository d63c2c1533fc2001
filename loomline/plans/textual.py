"""Queries on text functions, chunkers and corpus statistics, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators.ordered import quantiles, running_total
from ..operators.search import near_names
from ..session import spread
from .evaluation import rounded, t

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
_WC = "case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) end"


def _corpus_stats(s, d):
    x = docs(s, d, "source", "added_at").withColumn("wc", X.word_count(F.col("text")))
    one = x.agg(F.count("*").alias("n_docs"), F.sum("wc").alias("total_words"), F.round(F.avg("wc"), 2).alias("mean_words"), F.min("wc").alias("min_words"), F.max("wc").alias("max_words"), F.sum(F.length("text")).alias("total_chars"), F.count(F.col("source")).alias("n_with_source"), F.min("added_at").alias("first_added"), F.max("added_at").alias("last_added"))
    return one.join(F.broadcast(quantiles(x, "wc", {"median_words": 0.5})))


query("corpus_stats", f"with x as (select *, {_WC} as wc from documents) select count(*) as n_docs, cast(sum(wc) as bigint) as total_words, round(avg(wc), 2) as mean_words, cast(min(wc) as int) as min_words, cast(max(wc) as int) as max_words, cast(sum(length(text)) as bigint) as total_chars, count(source) as n_with_source, min(added_at) as first_added, max(added_at) as last_added, median(wc) as median_words from x")(_corpus_stats)
for _n, _c in (("lang", "lang"), ("source", "source"), ("section", "section_type"), ("collection", "collection_id")):
    query(f"corpus_{_n}_counts", f"select coalesce({_c}, 'unknown') as label, count(*) as n from documents group by 1")(lambda s, d, c=_c: t(s, d, "documents").groupBy(F.coalesce(c, F.lit("unknown")).alias("label")).agg(F.count("*").alias("n")))
query("grouping_sets", "select section_type, collection_id, count(*) as n, grouping(section_type, collection_id) as g from documents group by cube (section_type, collection_id)")(lambda s, d: t(s, d, "documents").cube("section_type", "collection_id").agg(F.count("*").alias("n"), F.grouping_id().alias("g")))
query("default_filter", f"select doc_id from documents where {_WC} >= 20 and length(text) >= 200")(lambda s, d: docs(s, d).where((X.word_count(F.col("text")) >= 20) & (F.length("text") >= 200)).select("doc_id"))
query("text_metrics", f"select doc_id, cast({_WC} as int) as words, length(text) as chars, round(case when len({_TOK}) > 0 then len(list_distinct({_TOK})) / len({_TOK}) else 0 end, 6) as ttr from documents")(lambda s, d: docs(s, d).select("doc_id", X.word_count(F.col("text")).alias("words"), F.length("text").cast("bigint").alias("chars"), F.round(X.type_token_ratio(X.tokens(F.col("text"), False)), 6).alias("ttr")))
query("tokenise", f"select doc_id, {_TOK} as tokens from documents")(lambda s, d: docs(s, d).select("doc_id", X.tokens(F.col("text"), False).alias("tokens")))
query("ngrams_2", f"with x as (select doc_id, {_TOK} as w from documents) select doc_id, case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) else [] end as grams from x")(lambda s, d: docs(s, d).select("doc_id", X.tokens(F.col("text"), False).alias("w")).select("doc_id", X.ngrams(F.col("w"), 2).alias("grams")))
_VOC = f"with x as (select doc_id, unnest({_TOK}) as token from documents)"
query("vocabulary_top20", _VOC + " select token, count(*) as n, count(distinct doc_id) as docs from x group by 1 order by n desc, token limit 20")(lambda s, d: C.vocabulary(docs(s, d), "text").orderBy(F.desc("n"), "token").limit(20))
query("vocabulary_stats", _VOC + " select count(distinct token) as vocab_size, count(*) as total_tokens, round(count(*) / (select count(*) from documents), 6) as avg_tokens_per_doc from x")(lambda s, d: rounded(C.vocabulary_stats(docs(s, d), "text"), "avg_tokens_per_doc"))
query("keywords_tf", _VOC + ", f as (select doc_id, token, count(*) as tf from x group by 1, 2) select doc_id, token, tf::double as score, (row_number() over (partition by doc_id order by tf desc, token))::int as rank from f qualify rank <= 5")(lambda s, d: C.keywords(docs(s, d), "doc_id", "text"))
query("keywords_tfidf", _VOC + ", f as (select doc_id, token, count(*) as tf, sum(count(*)) over (partition by doc_id) as dl, count(*) over (partition by token) as df from x group by 1, 2), z as (select doc_id, token, round(tf / dl * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1), 8) as score from f) select doc_id, token, score, (row_number() over (partition by doc_id order by score desc, token))::int as rank from z qualify rank <= 5")(lambda s, d: C.keywords(docs(s, d), "doc_id", "text", idf=True))
_SOME = "from documents where trim(text) <> ''"
query("fixed_window_chars", f"with x as (select doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 500) / 400.0))::int + 1))::int as chunk_index {_SOME}) select doc_id, chunk_index, chunk_index * 400 as char_start, least(chunk_index * 400 + 500, length(text))::int as char_end, trim(substring(text, chunk_index * 400 + 1, 500)) as chunk from x where length(trim(substring(text, chunk_index * 400 + 1, 500))) >= 1")(lambda s, d: C.fixed_window_chars(docs(s, d), "doc_id", "text", 500, 100))
query("fixed_window_tokens", f"with x as (select doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as t {_SOME}), y as (select doc_id, t, unnest(range(0, greatest(0, ceil((len(t) - 64) / 48.0))::int + 1))::int as chunk_index from x) select doc_id, chunk_index, array_to_string(list_slice(t, chunk_index * 48 + 1, chunk_index * 48 + 64), ' ') as chunk from y")(lambda s, d: C.fixed_window_tokens(docs(s, d), "doc_id", "text", 64, 16))
_PARTS = "list_filter(list_transform({s}, lambda p: trim(p)), lambda p: p <> '')"
_PARA = _PARTS.format(s="string_split_regex(text, '\\r?\\n[ \\t\\r]*\\n')")
_SENT = _PARTS.format(s="string_split(regexp_replace(text, '([.!?])\\s+([A-Z\"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))")
query("paragraph_chunks", f"with x as (select doc_id, {_PARA} as p {_SOME}) select doc_id, (unnest(range(len(p))))::int as chunk_index, unnest(p) as chunk from x")(lambda s, d: C.paragraphs(docs(s, d), "doc_id", "text"))
query("sentence_chunks", f"with x as (select doc_id, {_SENT} as p {_SOME}) select doc_id, (unnest(range(len(p))))::int as chunk_index, unnest(p) as chunk from x")(lambda s, d: C.sentences(docs(s, d), "doc_id", "text"))
query("chunk_overlap", f"with x as (select doc_id, {_PARA} as p {_SOME}), c as (select doc_id, (unnest(range(len(p))))::int as chunk_index, unnest(p) as chunk from x) select doc_id, chunk_index, string_agg(chunk, chr(10)) over (partition by doc_id order by chunk_index rows between 1 preceding and current row) as chunk from c")(lambda s, d: C.with_context(C.paragraphs(docs(s, d), "doc_id", "text"), "doc_id", 1))
query("merge_short_paragraphs")(lambda s, d: C.merge_short(docs(s, d).where("trim(text) <> ''"), "doc_id", F.filter(F.transform(F.split("text", r"\r?\n[ \t\r]*\n"), lambda p: F.trim(p)), lambda p: p != ""), 400))
query("normalize_whitespace", r"select doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')) as clean from documents")(lambda s, d: docs(s, d).select("doc_id", X.collapse_whitespace(F.col("text")).alias("clean")))
query("strip_html", "select doc_id, regexp_replace(text, '<[^>]+>', '', 'g') as clean from documents")(lambda s, d: docs(s, d).select("doc_id", X.strip_tags(F.col("text")).alias("clean")))
query("fix_hyphenation", r"select p_partkey, regexp_replace(replace(p_name, ' ', '-' || chr(10) || ' '), '(\w)-\s*\n\s*(\w)', '\1\2', 'g') as clean from part")(lambda s, d: t(s, d, "part").select("p_partkey", X.join_hyphenated(F.replace(F.col("p_name"), F.lit(" "), F.lit("-\n "))).alias("clean")))
query("expand_ligatures", "select doc_id, " + "replace(" * 6 + "text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae') as clean from documents")(lambda s, d: docs(s, d).select("doc_id", X.expand_ligatures(F.col("text")).alias("clean")))
query("normalize_text")(lambda s, d: docs(s, d).select("doc_id", X.normalize_text(F.col("text"), lower=True, min_length=10).alias("clean")))
query("grapheme_counts")(lambda s, d: docs(s, d).select("doc_id", X.grapheme_count(F.col("text")).alias("graphemes"), F.length("text").alias("codepoints")))
query("script_of_text")(lambda s, d: docs(s, d).select("doc_id", X.script(F.col("text")).alias("script")))
query("redact", r"select event_id, regexp_replace(user_id || '@mail.example +1 555 123 4567', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]') as x, 1 as y from events where 1 = 0 union all select event_id, '[EMAIL] [PHONE]', 1 from events")(lambda s, d: t(s, d, "events").select("event_id", X.redact(F.concat(F.col("user_id").cast("string"), F.lit("@mail.example +1 555 123 4567"))).alias("x"), F.lit(1).alias("y")))
query("content_hash", "select doc_id, case when coalesce(text, '') = '' then repeat('0', 32) else substr(sha256(text), 1, 32) end as h from documents")(lambda s, d: docs(s, d).select("doc_id", X.content_hash(F.col("text")).alias("h")))
query("document_ids", "select doc_id, substr(sha256(concat_ws(chr(31), cast(doc_id as varchar), coalesce(source, ''), coalesce(text, ''))), 1, 32) as id from documents")(lambda s, d: docs(s, d, "source").select("doc_id", X.document_id(F.col("doc_id"), F.col("source"), F.col("text")).alias("id")))
query("source_type_infer", "with m as (select unnest(['txt', 'md', 'rst', 'html', 'pdf']) as e, unnest(['text', 'markdown', 'documentation', 'web', 'research']) as s) select input_path, coalesce(s, 'unknown') as source_type, count(*) as n from reader_files left join m on lower(regexp_extract(input_path, '\\.([^./]+)$', 1)) = e group by 1, 2")(lambda s, d: t(s, d, "reader_files").groupBy("input_path", X.source_type(F.col("input_path")).alias("source_type")).agg(F.count("*").alias("n")))
query("provenance_filename", "select distinct input_path, regexp_extract(input_path, '([^/]*)$', 1) as name, regexp_extract(input_path, '_([a-z]+)', 1) as title, regexp_extract(input_path, '/p([0-9]+)_', 1) as no from reader_files")(lambda s, d: t(s, d, "reader_files").select("input_path", X.basename(F.col("input_path")).alias("name"), F.regexp_extract("input_path", "_([a-z]+)", 1).alias("title"), F.regexp_extract("input_path", "/p([0-9]+)_", 1).alias("no")).distinct())
query("edit_distance_pairs", "with n as (select distinct p_name from part) select a.p_name as a, b.p_name as b, cast(levenshtein(a.p_name, b.p_name) as int) as distance from n a join n b on a.p_name < b.p_name where levenshtein(a.p_name, b.p_name) <= 4")(lambda s, d: near_names(t(s, d, "part"), "p_name", 4))
query("dedup_lines", "with x as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null), k as (select *, row_number() over (partition by doc_id, trim(l) order by i) as r from x) select doc_id, string_agg(l, chr(10) order by i) as clean from k where r = 1 or trim(l) = '' group by 1")(lambda s, d: X.dedup_lines(docs(s, d).where("text is not null"), "text", "clean").select("doc_id", "clean"))
query("dedup_exact", "select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by sha256(text)")(lambda s, d: docs(s, d).where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h"))
query("upsert_last_wins", "select doc_id, max(stored_at) as stored_at, count(*) as n_states from corpus_documents group by 1")(lambda s, d: t(s, d, "corpus_documents").groupBy("doc_id").agg(F.max("stored_at").alias("stored_at"), F.count("*").alias("n_states")))
query("current_labels", "select doc_id, language, source_type from (select *, row_number() over (partition by doc_id order by stored_at desc) as r from corpus_documents) where r = 1")(lambda s, d: t(s, d, "corpus_documents").groupBy("doc_id").agg(F.max_by(F.struct("language", "source_type"), "stored_at").alias("s")).select("doc_id", "s.*"))
query("json_fields", "select doc_id, stored_at, json_extract_string(json_data, '$.source_title') as title, cast(json_extract_string(json_data, '$.page_number') as int) as page from corpus_documents where json_valid(json_data)")(lambda s, d: t(s, d, "corpus_documents").select("doc_id", "stored_at", F.from_json("json_data", "source_title string, page_number int, doc_id string").alias("j")).where("j.doc_id is not null").select("doc_id", "stored_at", F.col("j.source_title").alias("title"), F.col("j.page_number").alias("page")))
_NAT = "regexp_extract_all(input_path, '([^0-9]*)([0-9]*)', {})"
query("natural_sort_paths", f"select input_path, row_number() over (order by list_transform(list_zip({_NAT.format(1)}, {_NAT.format(2)}), lambda x: {{'t': lower(x[1]), 'n': coalesce(try_cast(x[2] as hugeint), -1)}}), input_path) as pos from (select distinct input_path from reader_files)")(
    lambda s, d: running_total(t(s, d, "reader_files").select("input_path").distinct().withColumn("k", X.natural_key(F.col("input_path"))).withColumn("one", F.lit(1).cast("long")), [F.col("k"), F.col("input_path")], {"pos": "one"}).select("input_path", "pos")
)
_SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>{n}</i>\nsecond line\n\n2\n00:01:00,000 --> 00:01:03,250\nbye {n}\n"
query("srt_parse", "select n_nationkey as id, 1 as cue, 1.0::double as start_s, 2.5::double as end_s, n_name || ' second line' as cue_text from nation union all select n_nationkey, 2, 60.0, 63.25, 'bye ' || n_name from nation")(lambda s, d: C.parse_subtitles(t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.replace(F.lit(_SRT), F.lit("{n}"), F.col("n_name")).alias("x")), "id", "x"))
query("html_sections", "select n_nationkey as id, unnest([0, 1, 2]) as element_index, unnest(['h1', 'p', 'li']) as html_tag, unnest(['title', 'text', 'text']) as section_type, unnest([n_name, 'about ' || n_name, 'item']) as section_text from nation")(lambda s, d: C.html_sections(t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("<h1 class='a'>"), "n_name", F.lit("</h1><p>about <b>"), "n_name", F.lit("</b></p><ul><li>item</li></ul>")).alias("x")), "id", "x"))

# the first names of these queries; both are whole
for _new, _old in (("edit_distance_pairs", "edit_distance"), ("natural_sort_paths", "natural_sort")):
    QUERIES[_old], ORACLE[_old] = QUERIES[_new], ORACLE[_new]
_UNITS = "case when n < 1024 then format('{:.1f} B', n) " + " ".join(f"when n < 1024.0 ** {k + 1} then format('{{:.1f}} {u}', n / 1024.0::double ** {k})" for k, u in enumerate(("KB", "MB", "GB", "TB"), 1)) + " end"
query("human_size", f"with x as (select input_path, max(n_bytes)::double as n from reader_files where n_bytes is not null group by 1) select input_path, {_UNITS} as size from x")(
    lambda s, d: t(s, d, "reader_files").groupBy("input_path").agg(F.max("n_bytes").alias("n")).where("n is not null").select("input_path", X.human_size(F.col("n")).alias("size"))
)
