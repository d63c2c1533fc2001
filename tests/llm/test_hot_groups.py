"""Hot groups: one text, length, source or piece with a third of all rows and more; null keys; tables with odd rows."""

from datetime import datetime

from loomline.llm import corpus, entry, mixing, neardup, packing, tokens

DAY = datetime(2024, 1, 1)


def test_a_third_are_copies(spark):
    hot = " ".join(f"word{i}" for i in range(40))
    rows = [(f"d{i:05}", DAY, hot if i % 3 == 0 else " ".join(f"t{i}x{k}" for k in range(35))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, stored_at timestamp, text string")
    members, links = neardup.near_duplicates(df, len(rows))
    assert links.count() == 0
    pairs = neardup.document_pairs(members, links)
    assert pairs.count() == 999 and {r.doc_id_a for r in pairs.collect()} == {"d00000"}


def test_rank_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as g")
    got = corpus.rank_within(df, ["g"], ["id"], 400_000)
    top = got.groupBy("g").agg({"rank": "max", "id": "count"}).collect()
    assert all(r["max(rank)"] == r["count(id)"] - 1 for r in top)
    assert got.select("g", "rank").distinct().count() == 5000


def test_one_length_and_one_source(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "64L as n_tokens", "'s' as source")
    got = packing.pack(df, {"b": 256}).groupBy("box_no").count().collect()
    assert len(got) == 1000 and all(r["count"] == 4 for r in got)
    m = mixing.mix(df, [("m", "s", 1.0, 2), ("m", "t", None, 1), ("m", "u", 1.0, None)]).collect()
    assert len(m) == 4000 and {r.repeats for r in m} == {2}


def test_one_piece(spark):
    df = spark.range(500).selectExpr("'zzqxjv ' as text", "cast(null as string) as s")
    r = tokens.token_budget(df, ["s"]).collect()
    assert len(r) == 1 and r[0].n_tokens == 500 * len(tokens.encoder().encode_ordinary("zzqxjv "))


def test_queries_on_odd_tables(spark, tmp_path):
    """Every query on tables with nulls in every column, repeated and empty rows."""
    shapes = {
        "corpus_documents": ("doc_id string, input_path string, source_type string, section_type string, language string, collection_id string, chunk_index int, char_start int, char_end int, json_data string, stored_at timestamp", 11),
        "reader_files": ("input_path string, reader string, file_type string, encoding string, collection_id string, n_bytes long, raw_head binary, read_at timestamp", 8),
        "documents": ("doc_id long, text string, lang string, source string, n_chars long, collection_id string, section_type string, added_at timestamp", 8),
        "collection_manifests": ("collection_id string, title string, author string, source_date string, language string, description string, source_type string, topic_area string, tags array<string>, expected_file_count int", 10),
        "chunker_configs": ("collection_id string, chunking_strategy string, min_chars int, max_chars int, overlap_chars int", 5),
        "language_codes": ("iso_code string, iso3_code string, english_name string, script string", 4),
        "mix_targets": ("mix_id string, source string, target_share double, max_repeats int", 4),
        "box_capacities": ("box_id string, capacity_tokens int", 2),
    }
    real = "/root/testdata/sf0.001"
    for name, (schema, n) in shapes.items():
        odd = spark.createDataFrame([(None,) * n] * 2, schema)
        base = spark.read.parquet(f"{real}/{name}.parquet")
        base = base.select(*[base[c].cast(odd.schema[c].dataType).alias(c) for c in odd.columns])
        base.unionByName(odd).unionByName(base.limit(3)).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, q in entry.queries().items():
        df = q(spark, str(tmp_path))
        rows = df.collect()
        if name.endswith("_found"):
            assert len(set(rows)) == len(rows), name


def test_queries_on_empty_tables(spark, tmp_path):
    from pathlib import Path

    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        df = spark.read.parquet(str(p))
        (df if p.stem in ("language_codes", "chunker_configs", "box_capacities", "mix_targets", "collection_manifests") else df.where("false")).write.parquet(str(tmp_path / p.name))
    for name, q in entry.queries().items():
        assert q(spark, str(tmp_path)).count() in (0, 19), name
