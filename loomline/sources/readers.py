"""Sources: tabular files by suffix, corpus entries, text with unknown encodings, archives and XML.

Readers give lazy frames; what must be parsed in Python is parsed file by file
in Arrow batches on the executors. Pickled objects are not read: loading them
runs code from the file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[..., DataFrame]
_LOADERS: dict[str, Loader] = {}


def register_loader(suffix: str, loader: Loader, override: bool = False) -> None:
    """Binds a loader (spark, path, **options) to a suffix; an existing one is only replaced with ``override``."""
    if suffix in _LOADERS and not override:
        raise ValueError(f"{suffix} already has a loader")
    _LOADERS[suffix] = loader


def suffix_of(path: str) -> str:
    """The last suffix in lower case, without a compression suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = re.sub(r"\.(gz|bz2|zst|xz)$", "", name)
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def load_data(spark: SparkSession, path: str, suffix: str | None = None, **options) -> DataFrame:
    """A frame of one path or glob, by its suffix or the given one; gz, bz2 and zst are read as they are."""
    s = suffix or suffix_of(path)
    if s not in _LOADERS:
        raise ValueError(f"no loader for {s!r}; known: {sorted(_LOADERS)}")
    return _LOADERS[s](spark, path, **options)


def load_data_meta(spark: SparkSession, path: str, suffix: str | None = None, **options) -> dict:
    """The frame with its row count, columns and format."""
    df = load_data(spark, path, suffix, **options)
    return {"data": df, "shape": (df.count(), len(df.columns)), "source": path, "format": suffix or suffix_of(path)}


def _csv(sep: str) -> Loader:
    def load(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
        r = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').options(**options)
        return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)

    return load


def _files(parse: Callable[[bytes], pd.DataFrame]) -> Loader:
    """A loader that parses each whole file on an executor; the schema, if not given, is that of the first file."""

    def load(spark: SparkSession, path: str, schema: str | None = None, **_options) -> DataFrame:
        raw = spark.read.format("binaryFile").load(path).select("content")
        if schema is None:
            first = parse(bytes(raw.first().content))
            schema = spark.createDataFrame(pa.Table.from_pandas(first.head(100), preserve_index=False)).schema
        return raw.mapInPandas(lambda it: (parse(bytes(c)) for pdf in it for c in pdf["content"]), schema)

    return load


def _npy(b: bytes) -> pd.DataFrame:
    import numpy as np

    x = np.load(io.BytesIO(b), allow_pickle=False)
    return pd.DataFrame({"row": range(len(x)), "vector": [r.astype("float32").ravel().tolist() for r in x]})


def _zip_csv(b: bytes) -> pd.DataFrame:
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        return pd.concat([pd.read_csv(z.open(n)) for n in z.namelist() if n.lower().endswith(".csv")], ignore_index=True)


def _xlsx(b: bytes) -> pd.DataFrame:
    """The first sheet of a workbook: the first row names the columns; numbers, texts and truth values, an empty cell is null."""
    from xml.etree import ElementTree

    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if plain(t) == "t") for si in root if plain(si) == "si"]
        sheet = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[0]
        root = ElementTree.fromstring(z.read(sheet))
    rows: list[dict[int, object]] = []
    for r in (e for e in root.iter() if plain(e) == "row"):
        row: dict[int, object] = {}
        for k, c in enumerate(e for e in r if plain(e) == "c"):
            letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
            at = k
            if letters:
                at = -1
                for ch in letters:
                    at = (at + 1) * 26 + ord(ch) - 65
            kind = c.get("t", "n")
            v = next((e.text for e in c if plain(e) == "v"), None)
            if kind == "inlineStr":
                row[at] = "".join(t.text or "" for t in c.iter() if plain(t) == "t")
            elif v is not None:
                row[at] = shared[int(v)] if kind == "s" else v if kind == "str" else v == "1" if kind == "b" else float(v)
        rows.append(row)
    if not rows:
        return pd.DataFrame()
    head = {k: str(v) for k, v in sorted(rows[0].items())}
    return pd.DataFrame([[r.get(k) for k in head] for r in rows[1:]], columns=list(head.values()))


def load_dataset(spark: SparkSession, name: str, folder: str, schema: str | None = None) -> DataFrame:
    """A named data set, ``name``.csv of a folder, without rows in which everything is missing. An unknown name raises with those that are there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    known = sorted(s.getPath().getName()[:-4] for s in fs.listStatus(at) if s.getPath().getName().endswith(".csv"))
    if name not in known:
        raise ValueError(f"no data set {name!r}; known: {known}")
    df = load_data(spark, f"{folder}/{name}.csv", schema=schema)
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull())


register_loader(".csv", _csv(","))
register_loader(".tsv", _csv("\t"))
register_loader(".txt", _csv("\t"))
register_loader(".parquet", lambda spark, path, **o: spark.read.options(**o).parquet(path))
register_loader(".orc", lambda spark, path, **o: spark.read.options(**o).orc(path))
register_loader(".json", lambda spark, path, schema=None, **o: (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).options(**o).json(path))
register_loader(".jsonl", lambda spark, path, schema=None, **o: (spark.read.schema(schema) if schema else spark.read).options(**o).json(path))
register_loader(".feather", _files(lambda b: pd.read_feather(io.BytesIO(b))))
register_loader(".xlsx", _files(_xlsx))
register_loader(".npy", _files(_npy))
register_loader(".zip", _files(_zip_csv))


def load_sql(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **properties) -> DataFrame:
    """A query on a database over JDBC; ``partition`` (column, low, high, parts) reads it in parallel. The driver's jar must be on the class path."""
    r = spark.read.format("jdbc").option("url", url).options(**properties)
    if partition:
        column, low, high, parts = partition
        return r.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    return r.option("query", query).load()


def load_sqlite(spark: SparkSession, path: str, query: str, chunk: int = 50_000) -> DataFrame:
    """A SELECT on a local SQLite file, opened read-only, for files of moderate size on the driver."""
    import sqlite3

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        parts = [pa.Table.from_pandas(p, preserve_index=False) for p in pd.read_sql_query(query, con, chunksize=chunk)]
    finally:
        con.close()
    return spark.createDataFrame(pa.concat_tables(parts, promote_options="permissive"))


def sqlite_tables(path: str) -> list[str]:
    import sqlite3

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        return [r[0] for r in con.execute("select name from sqlite_master where type = 'table' order by name")]
    finally:
        con.close()


def clean_sql(query: str) -> str:
    """A query without comments; comment signs inside of string literals stay."""
    return re.sub(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|/\*.*?\*/|--[^\n]*", lambda m: m.group(1) or " ", query, flags=re.S).strip()


def corpus_directory(spark: SparkSession, path: str, suffixes: list[str] | None = None, recursive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """(input_path, file_type, n_bytes, modified, content) of the files below a folder; ``content`` is only read where it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    df = r.load(path).select(F.col("path").alias("input_path"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("file_type"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), "content")
    if suffixes:
        df = df.where(F.col("file_type").isin([s.lower() for s in suffixes]))
    return df.where(F.col("n_bytes") <= max_bytes) if max_bytes else df


def corpus_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """(input_path) of a given list; anything but http and https raises."""
    bad = [u for u in urls if not re.match(r"^https?://[^\s/]+", u)]
    if bad:
        raise ValueError(f"not http(s): {bad[:3]}")
    return spark.createDataFrame([(u,) for u in urls], "input_path string")


def corpus_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(input_path) of a text manifest: blank lines and lines from # are skipped, relative paths are taken from the manifest's folder."""
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    line = F.trim("value")
    absolute = line.startswith("/") | line.rlike(r"^[a-z][a-z0-9+.-]*://")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.when(absolute, line).otherwise(F.concat(F.lit(base + "/"), line)).alias("input_path"))


def decode_bytes(raw: bytes, encoding: str | None = None) -> tuple[str, str]:
    """(text, encoding): the stated encoding if it decodes, else a byte order mark, strict UTF-8, then Windows-1252 with replacement; line ends become line feeds."""
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    tries = [encoding] if encoding else []
    tries += [e for m, e in marks if raw.startswith(m)] + ["utf-8"]
    for e in tries:
        try:
            return raw.decode(e).replace("\r\n", "\n").replace("\r", "\n"), e
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("cp1252", "replace").replace("\r\n", "\n").replace("\r", "\n"), "cp1252"


def read_texts(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """(input_path, file_type, text, encoding) of files with content. Valid UTF-8, the usual case, is decoded in the JVM."""

    @F.pandas_udf("text string, encoding string")
    def cascade(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(bytes(b), encoding) if b is not None else (None, None) for b in s], columns=["text", "encoding"])

    easy = F.is_valid_utf8(F.col("content").cast("string")) & ~F.col("content").startswith(F.lit(bytearray(b"\xef\xbb\xbf"))) if encoding is None else F.lit(False)
    simple = F.struct(F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n").alias("text"), F.lit("utf-8").alias("encoding"))
    return files.select("input_path", "file_type", F.when(easy, simple).otherwise(cascade("content")).alias("d")).select("input_path", "file_type", "d.*")


def read_zip_members(files: DataFrame, suffixes: list[str] | None = None, max_files: int = 10_000, max_bytes: int = 1 << 30) -> DataFrame:
    """(input_path, member, text, error) of the text members of archives; members with unsafe paths, and what is over an archive's budgets, come out as errors."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["input_path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                        total = 0
                        for k, info in enumerate(i for i in z.infolist() if not i.is_dir()):
                            name = info.filename
                            total += info.file_size
                            if name.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", name):
                                out.append((path, name, None, "unsafe path"))
                            elif k >= max_files or total > max_bytes:
                                out.append((path, name, None, "over budget"))
                            elif not suffixes or any(name.lower().endswith(s) for s in suffixes):
                                out.append((path, name, decode_bytes(z.read(info))[0], None))
                except (zipfile.BadZipFile, RuntimeError) as e:
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["input_path", "member", "text", "error"])

    return files.select("input_path", "content").mapInPandas(run, "input_path string, member string, text string, error string")


def read_xml_text(files: DataFrame, tag: str = "p") -> DataFrame:
    """(input_path, element_index, text, error) of the elements of a name, in any name space. Documents with a DTD or entities are refused."""

    def run(batches):
        from xml.etree import ElementTree

        for pdf in batches:
            out = []
            for path, raw in zip(pdf["input_path"], pdf["content"]):
                raw = bytes(raw)
                if re.search(rb"<!\s*(DOCTYPE|ENTITY)", raw, re.I):
                    out.append((path, None, None, "declares a DTD or entities"))
                    continue
                try:
                    root = ElementTree.fromstring(raw)
                except ElementTree.ParseError as e:
                    out.append((path, None, None, str(e)))
                    continue
                hits = [e for e in root.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] == tag]
                out += [(path, i, " ".join("".join(e.itertext()).split()), None) for i, e in enumerate(hits)]
            yield pd.DataFrame(out, columns=["input_path", "element_index", "text", "error"]).astype({"element_index": "Int32"})

    return files.select("input_path", "content").mapInPandas(run, "input_path string, element_index int, text string, error string")
