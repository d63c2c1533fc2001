"""Readers of document files as rows: plain and marked-up text, web pages, TEI and ALTO, subtitles, archives and readers of one's own.

Files come as frames with input_path, file_type and content. Every reader runs on
the executors, one file at a time, and a file that can't be read gives a row with
its error.
"""

from __future__ import annotations

import io
import json
import mimetypes
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import corpus_directory, decode_bytes

#: The columns of every reader; attributes holds what is particular to a format.
SCHEMA = "input_path string, reader string, source_type string, chunk_index int, section_type string, text string, attributes map<string,string>, error string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

Chunk = dict[str, Any]
Extractor = Callable[[bytes, str], Any]


def format_of(path: str) -> dict[str, Any]:
    """What a path or URL says about its format: whether it is a URL, its joined suffixes (.csv.gz), its last one without a compression, the compression, and the guessed MIME type."""
    bare = re.sub(r"[?#].*$", "", path)
    name = bare.rstrip("/").rsplit("/", 1)[-1].lower()
    parts = [f".{p}" for p in name.split(".")[1:]]
    packed = parts[-1] if parts and parts[-1] in (".gz", ".bz2", ".zst", ".xz") else None
    plain = parts[:-1] if packed else parts
    mime, _ = mimetypes.guess_type(name)
    return {"is_url": bool(re.match(r"^[a-z][a-z0-9+.-]*://", path, re.I)), "extension": "".join(parts[-2:]) if packed else (parts[-1] if parts else ""), "suffix": plain[-1] if plain else "", "compression": packed, "mime": mime}


def normalise_chunks(raw: Any, source_type: str = "unknown", section_type: str = "text") -> list[Chunk]:
    """What an extractor returned as a list of chunks: a text, a dict with a text, or a list of either; missing types take the defaults. Anything else raises."""
    items = raw if isinstance(raw, list) else [raw]
    out = []
    for x in items:
        if isinstance(x, str):
            x = {"text": x}
        if not isinstance(x, dict) or not isinstance(x.get("text"), str):
            raise TypeError(f"a chunk is a text or a dict with a text, not {type(x).__name__}")
        out.append({"source_type": source_type, "section_type": section_type, **x})
    return out


def read_with(files: DataFrame, reader: str, extract: Extractor, source_type: str = "unknown", section_type: str = "text", max_bytes: int | None = None) -> DataFrame:
    """Rows of a reader of one's own: ``extract`` gets the bytes and the path of a file. Keys of a chunk that are no columns go to attributes."""
    if max_bytes is not None and max_bytes <= 0:
        raise ValueError("max_bytes must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["input_path"], pdf["content"]):
                try:
                    if raw is None:
                        raise ValueError("no content")
                    data = bytes(raw)
                    if max_bytes is not None and len(data) > max_bytes:
                        raise ValueError(f"{len(data)} bytes are more than {max_bytes}")
                    for i, c in enumerate(normalise_chunks(extract(data, path), source_type, section_type)):
                        more = {k: str(v) for k, v in c.items() if k not in _COLUMNS and v is not None}
                        rows.append((path, reader, c["source_type"], i, c["section_type"], c["text"], more, None))
                except Exception as e:  # noqa: BLE001 - a bad file must not end the run
                    rows.append((path, reader, source_type, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"chunk_index": "Int32"})

    return files.select("input_path", "content").mapInPandas(run, SCHEMA)


def _text(data: bytes, _path: str) -> Any:
    text, encoding = decode_bytes(data)
    return {"text": text, "encoding": encoding}


class _Sections(HTMLParser):
    """Titles, headings, paragraphs, list items, cells and code of a page, in order; scripts, styles and navigation are left out."""

    KINDS = {"title": "title", "h1": "title", **{f"h{i}": "header" for i in range(2, 7)}, "p": "text", "li": "list_item", "td": "table", "th": "table", "pre": "code", "blockquote": "text", "figcaption": "caption"}
    SKIP = frozenset("script style noscript template nav footer aside form".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Chunk] = []
        self.skip, self.tag, self.parts = 0, "", []

    def close_part(self) -> None:
        s = "".join(self.parts)
        s = s.strip("\n") if self.tag == "pre" else " ".join(s.split())
        if s and self.tag:
            self.out.append({"text": s, "section_type": self.KINDS[self.tag], "html_tag": self.tag})
        self.tag, self.parts = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.KINDS and not self.skip:
            self.close_part()
            self.tag = tag
        elif tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self.close_part()

    def handle_data(self, data: str) -> None:
        if not self.skip and self.tag:
            self.parts.append(data)


def _web(data: bytes, _path: str) -> Any:
    p = _Sections()
    p.feed(decode_bytes(data)[0])
    p.close_part()
    return [{"element_index": i, **c} for i, c in enumerate(p.out)]


def _tree(data: bytes):
    """The root of a document without a DTD or entities."""
    from xml.etree import ElementTree

    if re.search(rb"<!\s*(DOCTYPE|ENTITY)", data, re.I):
        raise ValueError("declares a DTD or entities")
    return ElementTree.fromstring(data)


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _words(e) -> str:
    return " ".join("".join(e.itertext()).split())


def tei(data: bytes, stage_directions: bool = True, speakers: bool = True) -> list[Chunk]:
    """Lines, speeches, stage directions, heads and paragraphs of a TEI text, with its act, scene, page and line; name spaces don't matter."""
    out: list[Chunk] = []
    place: dict[str, Any] = {"page_number": None, "line_number": None}

    def say(e, kind: str, here: dict, speaker: str | None) -> None:
        s = _words(e)
        if s:
            front = f"{speaker}: " if speaker and speakers and kind in ("verse", "dialogue") else ""
            out.append({"text": front + s, "section_type": kind, **here, **place, "speaker": speaker})

    def walk(e, here: dict, speaker: str | None) -> None:
        name = _name(e)
        if name in ("teiHeader", "speaker"):
            return
        if name == "pb":
            place["page_number"] = e.get("n")
        elif name in ("div", "div1", "div2"):
            kind = e.get("type")
            if kind in ("act", "scene"):
                before = sum(1 for c in here.get("_seen", []) if c == kind)
                here.setdefault("_seen", []).append(kind)
                n = e.get("n")
                here = {**{k: v for k, v in here.items() if k != "_seen"}, kind: int(n) if n and n.isdigit() else before + 1}
            else:
                here = {k: v for k, v in here.items() if k != "_seen"}
            for c in e:
                walk(c, here, speaker)
            return
        elif name == "sp":
            speaker = next((_words(c) for c in e if _name(c) == "speaker"), None)
        elif name == "l":
            place["line_number"] = e.get("n")
            say(e, "verse", {k: v for k, v in here.items() if k != "_seen"}, speaker)
            return
        elif name in ("p", "ab"):
            place["line_number"] = None
            say(e, "dialogue" if speaker else "text", {k: v for k, v in here.items() if k != "_seen"}, speaker)
            return
        elif name == "stage":
            if stage_directions:
                say(e, "stage_direction", {k: v for k, v in here.items() if k != "_seen"}, None)
            return
        elif name == "head":
            say(e, "header", {k: v for k, v in here.items() if k != "_seen"}, None)
            return
        for c in e:
            walk(c, here, speaker)

    walk(_tree(data), {}, None)
    return out


def _digits(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p]


def unsafe_member(name: str) -> bool:
    """Whether an archive member's path leaves the archive."""
    return name.startswith(("/", "\\")) or bool(re.match(r"^[A-Za-z]:", name)) or ".." in re.split(r"[\\/]", name)


def alto(data: bytes, granularity: str = "block") -> list[Chunk]:
    """Pages, blocks or lines of the ALTO files of an archive, in natural order of their names, with their box and mean word confidence from 0 to 1. A path that leaves the archive raises."""
    if granularity not in ("page", "block", "line"):
        raise ValueError(f"unknown granularity {granularity!r}")
    out: list[Chunk] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        bad = [n for n in z.namelist() if unsafe_member(n)]
        if bad:
            raise ValueError(f"unsafe path {bad[0]!r}")
        for page, name in enumerate(sorted((n for n in z.namelist() if n.lower().endswith(".xml")), key=_digits)):
            root = _tree(z.read(name))
            wanted = {"page": "Page", "block": "TextBlock", "line": "TextLine"}[granularity]
            for e in root.iter():
                if _name(e) != wanted:
                    continue
                lines = [e] if granularity == "line" else [x for x in e.iter() if _name(x) == "TextLine"]
                strings = [[s for s in x.iter() if _name(s) == "String"] for x in lines]
                text = "\n".join(" ".join(s.get("CONTENT", "") for s in row) for row in strings).strip()
                if not text:
                    continue
                sure = [float(s.get("WC")) for row in strings for s in row if s.get("WC")]
                sure = [c / 100 if c > 1 else c for c in sure]
                box = ",".join(e.get(k, "") for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
                out.append({"text": text, "page_number": page, "member": name, "bbox": box, "confidence": round(sum(sure) / len(sure), 6) if sure else None})
    return out


_CLOCK = r"(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?"


def _seconds(h, m, s, f) -> float:
    return round(int(h or 0) * 3600 + int(m) * 60 + int(s) + (int(f.ljust(3, "0")) / 1000 if f else 0), 3)


def subtitles(data: bytes, path: str) -> list[Chunk]:
    """Cues of SRT, VTT, SBV, MicroDVD (at 25 frames a second) and LRC files, with start and end in seconds."""
    text = decode_bytes(data)[0]
    bare = lambda s: " ".join(re.sub(r"<[^>]+>|\{[^}]*\}", "", s).split())
    out: list[Chunk] = []
    if path.lower().endswith(".lrc"):
        found = [(_seconds(None, *m.groups()), bare(line[line.rfind("]") + 1 :])) for line in text.split("\n") for m in re.finditer(r"\[(\d+):(\d{2})(?:[.:](\d{1,3}))?\]", line)]
        found.sort()
        return [{"text": s, "start_s": a, "end_s": found[i + 1][0] if i + 1 < len(found) else None} for i, (a, s) in enumerate(found) if s]
    if path.lower().endswith(".sub"):
        for m in re.finditer(r"^\{(\d+)\}\{(\d+)\}(.*)$", text, re.M):
            out.append({"text": bare(m[3].replace("|", " ")), "start_s": int(m[1]) / 25, "end_s": int(m[2]) / 25})
        return [c for c in out if c["text"]]
    for block in re.split(r"\n\s*\n", text):
        m = re.search(rf"^\s*{_CLOCK}\s*(?:-->|,)\s*{_CLOCK}[^\n]*\n?", block, re.M)
        if m and (s := bare(block[m.end() :])):
            g = m.groups()
            out.append({"text": s, "start_s": _seconds(*g[:4]), "end_s": _seconds(*g[4:])})
    return out


def jsonl(data: bytes, _path: str, max_document: int = 1 << 20) -> list[Chunk]:
    """Documents of a JSON-lines file: objects with a text; longer ones than ``max_document`` characters raise, blank lines are skipped."""
    out = []
    for k, line in enumerate(decode_bytes(data)[0].split("\n")):
        if line.strip():
            d = json.loads(line)
            if len(d.get("text", "")) > max_document:
                raise ValueError(f"line {k + 1} is too long")
            out.append({kk: v if isinstance(v, str) else json.dumps(v) for kk, v in d.items()})
    return out


#: Reader, extractor and source type by suffix.
_READERS: dict[str, tuple[str, Extractor, str]] = {}


def register_reader(suffixes: list[str], reader: str, extract: Extractor, source_type: str, override: bool = False) -> None:
    """Binds a reader to suffixes; one that is bound is only replaced with ``override``."""
    for s in suffixes:
        if s in _READERS and not override:
            raise ValueError(f"{s} already has the reader {_READERS[s][0]}")
        _READERS[s] = (reader, extract, source_type)


register_reader([".txt", ".text", ".log"], "text", _text, "text")
register_reader([".md", ".markdown"], "markdown", _text, "markdown")
register_reader([".rst"], "rest", _text, "documentation")
register_reader([".html", ".htm"], "web", _web, "web")
register_reader([".xml", ".tei"], "tei", lambda d, _p: tei(d), "document")
register_reader([".zip"], "alto", lambda d, _p: alto(d), "document")
register_reader([".srt", ".vtt", ".sbv", ".sub", ".lrc"], "subtitles", subtitles, "subtitle")
register_reader([".jsonl"], "jsonl", jsonl, "data")


def reader_of(path: str) -> tuple[str, Extractor, str]:
    """The reader of a path; one without raises."""
    s = format_of(path)["suffix"]
    if s not in _READERS:
        raise ValueError(f"no reader for {s!r}; known: {sorted(_READERS)}")
    return _READERS[s]


def read_documents(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Rows of files of any registered format, each by its suffix (in any case); others give a row with an error."""

    def extract(data: bytes, path: str) -> Any:
        _name_, fn, kind = reader_of(path)
        return [{"source_type": kind, **c} for c in normalise_chunks(fn(data, path), kind)]

    rows = read_with(files, "", extract, max_bytes=max_bytes)
    names = F.create_map(*[F.lit(x) for s, (n, _, _) in _READERS.items() for x in (s, n)])
    return rows.withColumn("reader", F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract("input_path", r"(\.[^./]+)$", 1))), F.lit("none")))


def read_sources(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Rows of several folders, files or globs, with the number of the source in the order given."""
    parts = [read_documents(corpus_directory(spark, p), **options).withColumn("source_no", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable(spark: SparkSession, path: str) -> DataFrame:
    """No rows, in the readers' schema, once the path has been seen to exist; else an error is raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return spark.createDataFrame([], SCHEMA)


def archive_members(files: DataFrame, suffixes: list[str] | None = None, max_files: int = 10_000, max_bytes: int = 1 << 30) -> DataFrame:
    """(input_path, member, n_bytes, content, error) of zip and tar archives (also compressed ones): members that leave the archive, are no plain files, or exceed its budgets come out as errors."""

    def members(raw: bytes) -> Iterator[tuple[str, int, Callable[[], bytes] | None]]:
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, i.file_size, lambda i=i: z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                for m in t:
                    if m.isdir():
                        continue
                    yield m.name, m.size, (lambda m=m: t.extractfile(m).read()) if m.isfile() else None

    def run(batches):
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["input_path"], pdf["content"]):
                total = 0
                try:
                    for k, (name, size, read) in enumerate(members(bytes(raw))):
                        total += size
                        if unsafe_member(name):
                            out.append((path, name, size, None, "unsafe path"))
                        elif read is None:
                            out.append((path, name, size, None, "no plain file"))
                        elif k >= max_files or total > max_bytes:
                            out.append((path, name, size, None, "over budget"))
                        elif not suffixes or any(name.lower().endswith(s) for s in suffixes):
                            out.append((path, name, size, read(), None))
                except (zipfile.BadZipFile, tarfile.TarError, RuntimeError, OSError, EOFError) as e:
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["input_path", "member", "n_bytes", "content", "error"]).astype({"n_bytes": "Int64"})

    return files.select("input_path", "content").mapInPandas(run, "input_path string, member string, n_bytes long, content binary, error string")


def run_batch(rows: DataFrame, stop_on_error: bool = False, callback: Callable[[str, int, str | None], None] | None = None) -> DataFrame:
    """The rows that were read, with a look at the errors: ``callback`` gets each file's path, chunks and error; with ``stop_on_error`` the first error (by path) is raised.

    One row a file comes to the driver, and only if there is a callback.
    """
    bad = rows.where("error is not null")
    if stop_on_error and (first := bad.orderBy("input_path").first()):
        raise RuntimeError(f"{first.input_path}: {first.error}")
    if callback:
        each = rows.groupBy("input_path").agg(F.count("text").alias("n"), F.max("error").alias("error")).orderBy("input_path")
        for r in each.toLocalIterator():
            callback(r.input_path, r.n, r.error)
    return rows.where("error is null")


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 8, schema: str | None = None) -> DataFrame:
    """A table of an SQLite file that all executors can open, read in ranges of its row numbers, without passing through the driver."""
    import sqlite3

    def connect():
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    quoted = '"' + table.replace('"', '""') + '"'
    con = connect()
    try:
        low, high = con.execute(f"select min(rowid), max(rowid) from {quoted}").fetchone()
        first = pd.read_sql_query(f"select * from {quoted} limit 100", con)
    finally:
        con.close()
    kind = schema or spark.createDataFrame(first).schema if len(first) else schema
    if low is None:
        if schema is None:
            raise ValueError("an empty table needs a schema")
        return spark.createDataFrame([], schema)
    step = max(1, -(-(high - low + 1) // parts))
    ranges = spark.createDataFrame([(a, a + step) for a in range(low, high + 1, step)], "a long, z long").repartition(parts)

    def run(batches):
        for pdf in batches:
            for a, z in pdf.itertuples(index=False):
                c = connect()
                try:
                    yield from pd.read_sql_query(f"select * from {quoted} where rowid >= {int(a)} and rowid < {int(z)}", c, chunksize=20_000)
                finally:
                    c.close()

    return ranges.mapInPandas(run, kind)
