"""Repair of text that was decoded with the wrong character encoding.

Round-trip repair: a run of characters is encoded again in the encoding that it
was wrongly decoded with, and strictly decoded as the encoding that was meant;
this repeats for nested layers. A step is accepted when the garbling cost drops:
the cost is the code length of the run under a character bigram model of clean
text, so that a wrong reading costs far more than the right one. Replacement
characters mark a text as garbled, but cannot be undone.

Runs are the stretches of characters that wrong readings can give, between
blanks; each distinct run is decided once in a worker process.
"""

from __future__ import annotations

import codecs
import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, spread
from .corpus import Tally, chunks, latest, of_latest, states, table

#: Encodings that text is wrongly read with, and encodings that it was written in.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "koi8-r", "cp866", "iso8859-2", "iso8859-15", "cp1256")
MEANT = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1254", "koi8-r", "cp866", "iso8859-2", "mac_roman", "cp437", "gb18030", "euc-jp", "shift_jis", "big5", "cp1256", "iso8859-5", "iso8859-6")
MULTIBYTE = frozenset(("utf-8", "gb18030", "euc-jp", "shift_jis", "big5"))
_TRIM = re.compile(r"^[\x00-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x40\x5b-\x60\x7b-\x7f]+$")
LAYERS = 3
#: Occurrences, in this many texts, from which a character or pair counts as usual (what is rarer may itself be a slip), and occurrences that are added to those of a pair's first character. Both grow with the texts.
FEW, SMOOTH, PER_TEXTS = 3, 20, 30000
MEMORY = 200_000


def _loose(encoding: str) -> dict[int, int]:
    """Character to byte of a single-byte encoding; bytes without a character are the control characters, as lenient decoders leave them."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    for b in range(128, 160):
        out.setdefault(b, b)
    return out


_TABLES = {e: _loose(e) for e in WRONG}
#: Characters of clean typography; a text with no others beyond ASCII is clean.
QUIET = "“”‘’–—…°±£•"


def _char_class(codes: set[int]) -> str:
    """A character class of code points, for Python and Java alike."""
    out, todo = [], sorted(codes)
    while todo:
        a = z = todo.pop(0)
        while todo and todo[0] == z + 1:
            z = todo.pop(0)
        out.append(f"\\u{a:04x}-\\u{z:04x}" if z > a else f"\\u{a:04x}")
    return "".join(out)


#: Characters beyond ASCII that a wrong single-byte reading can give.
_GIVEN = {c for t in _TABLES.values() for c in t if c > 127}
_ODD = (_GIVEN | {0xFFFD}) - set(map(ord, QUIET))
#: A superset of what wrong readings can give that costs little to test.
UNUSUAL = f"[^\\x00-\\x7F{QUIET}]"
_ODD_RE = re.compile(f"[{_char_class(_ODD)}]")
_RIGHT = re.compile(f"[\\x21-\\x7e{_char_class(_GIVEN)}]*")
_LEFT = frozenset(map(chr, [*range(0x21, 0x7F), *(_GIVEN - _ODD)]))


def _edges(run: str, path: str) -> list[int]:
    """By number of repaired characters: how many characters of the run as stored they came from."""
    edges = list(range(len(run) + 1))
    for step in path.split("+"):
        wrong, meant = step.split(">")
        decoder = codecs.getincrementaldecoder(meant)()
        now, taken = "", [0]
        for k, c in enumerate(run, 1):
            got = decoder.decode(bytes([_TABLES[wrong][ord(c)]]))
            now += got
            taken += [k] * len(got)
        run, edges = now, [edges[k] for k in taken]
    return edges


@dataclass
class Place:
    """A repaired run: its start and length in the repaired text, its start in the stored one, what is stored, and the layers undone."""

    at: int
    size: int
    start: int
    run: str
    path: str


def stored_at(places: list[Place], at: int) -> int:
    """The position in the stored text of a position in the repaired one."""
    k = bisect_right(places, at, key=lambda p: p.at) - 1
    if k < 0:
        return at
    p = places[k]
    inside = at - p.at
    return p.start + (_edges(p.run, p.path)[inside] if inside < p.size else len(p.run) + inside - p.size)


def _readings(t: str) -> tuple[str, ...]:
    """A text as its characters are counted: blanks as one space, with spaces around; in either case too, if it isn't ASCII."""
    x = " " + re.sub(r"[\x00-\x20]+", " ", t) + " "
    return (x,) if t.isascii() else (x, x.lower(), x.upper())


@dataclass
class GarbleModel:
    """Character bigram code lengths of clean text, in bits."""

    pairs: dict[str, float]
    singles: dict[str, float]
    unseen: float
    memory: dict[str, tuple[str, str | None]] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def fit(cls, texts: list[str]) -> GarbleModel:
        from collections import Counter

        two: Counter[str] = Counter()
        one: Counter[str] = Counter()
        for t in texts:
            for x in _readings(t):
                one.update(x)
                two.update(map(str.__add__, x[:-1], x[1:]))
        lead = Counter()
        for p, n in two.items():
            lead[p[0]] += n
        return cls.of_counts(two, one, lead, sum(one.values()), len(texts))

    @classmethod
    def of_counts(cls, two: dict[str, int], one: dict[str, int], lead: dict[str, int], total: int, texts: int) -> GarbleModel:
        """The model of the counts of pairs, of characters, of pairs by their first character, of all characters and of the texts."""
        scale = max(1, texts / PER_TEXTS)
        singles = {c: -math.log2(n / total) for c, n in one.items() if n >= FEW * scale}
        pairs = {p: -math.log2(n / (lead[p[0]] + SMOOTH * scale)) for p, n in two.items() if n >= FEW * scale}
        return cls(pairs, singles, 22.0)

    def cost(self, s: str) -> float:
        """Code length of a run in bits."""
        t = f" {s} "
        bits = 0.0
        pairs, singles, unseen = self.pairs, self.singles, self.unseen
        for a, b in zip(t, t[1:]):
            p = a + b
            got = pairs.get(p)
            bits += got if got is not None else 6.0 + min(singles.get(b, unseen), 16.0)
        return bits

    def known(self, s: str) -> bool:
        return all(c in self.singles for c in s if ord(c) > 127)

    def clean(self, s: str) -> bool:
        """Whether every pair of neighbours with a character beyond ASCII is usual."""
        t = f" {s} "
        pairs = self.pairs
        return all(a < "\x80" and b < "\x80" or a + b in pairs for a, b in zip(t, t[1:]))

    def step(self, s: str) -> tuple[str, str] | None:
        """The best single round trip of a run, as (text, 'wrong>meant'), if it lowers the cost enough."""
        at = self.cost(s)
        utf: list[tuple[float, str, str]] = []
        rest: list[tuple[float, str, str]] = []
        seen = set()
        for w in WRONG:
            t = _TABLES[w]
            if not all(ord(c) in t for c in s):
                continue
            raw = bytes(t[ord(c)] for c in s)
            for m in MEANT:
                if (raw, m) in seen or m == w:
                    continue
                seen.add((raw, m))
                try:
                    got = raw.decode(m)
                except UnicodeDecodeError:
                    continue
                if got == s or "�" in got or any(ord(c) < 32 for c in got):
                    continue
                new = self.cost(got)
                # what decodes strictly as UTF-8 is no accident; other encodings need clear evidence
                if m == "utf-8":
                    if new < 0.9 * at:
                        utf.append((new, got, f"{w}>{m}"))
                elif len(s) > 2 and (new < 0.72 * at - 4 or new < at - 8 and self.clean(got)) and self.known(got):
                    rest.append((new, got, f"{w}>{m}"))
        best = min(utf or rest, default=None)
        return best and best[1:]

    def repair_run(self, s: str) -> tuple[str, str | None]:
        """A run's text after repair and the layers undone, the outermost first; (s, None) for a clean one."""
        got = self.memory.get(s)
        if got is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            got = self.memory[s] = self._repair(s)
        return got

    def _repair(self, s: str) -> tuple[str, str | None]:
        path: list[str] = []
        now = s
        while len(path) < LAYERS and not now.isascii() and not self.clean(now):
            nxt = self.step(now)
            if nxt is None:
                break
            now = nxt[0]
            path.append(nxt[1])
        return now, "+".join(path) or None

    def repair(self, text: str) -> tuple[str, str | None]:
        """The whole text with its runs repaired; the layers undone, or 'lost' where only replacement characters tell, or None."""
        return self.repair_placed(text)[:2]

    def repair_placed(self, text: str) -> tuple[str, str | None, list[Place]]:
        """As ``repair``, with the place of each repaired run."""
        how: list[str] = []
        places: list[Place] = []
        longer = 0
        out: list[str] = []
        end = 0
        for m in _ODD_RE.finditer(text):
            a = m.start()
            if a < end:
                continue
            while a > end and text[a - 1] in _LEFT:
                a -= 1
            z = _RIGHT.match(text, m.end()).end()
            core = _TRIM.sub("", text[a:z])
            got, path = self.repair_run(core) if core else (core, None)
            if path:
                how.append(path)
                at = text.index(core, a)
                out += [text[end:at], got, text[at + len(core) : z]]
                places.append(Place(at + longer, len(got), at, core, path))
                longer += len(got) - len(core)
            else:
                out.append(text[end:z])
            end = z
        if how:
            return "".join(out) + text[end:], max(sorted(set(how)), key=how.count), places
        return text, "lost" if "�" in text else None, places


#: Bits of a code point in a pair's number, and the numbers under which texts and their readings are counted.
_BITS = 21
_TEXTS, _READINGS = -1, -2


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(pair, n): how often each pair of neighbouring characters occurs in all texts, as the first's code point times 2**21 plus the second's; under negative numbers, how many texts and readings there are."""

    def run(batches):
        wide, plain, many = Tally(), np.zeros((128, 128), np.int64), [0, 0]

        def out(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t is not None]
            many[0] += len(texts)
            for lo, hi in chunks(texts):
                every = [x for t in texts[lo:hi] for x in _readings(t)]
                many[1] += len(every)
                # NUL is in no reading, and keeps them apart
                cp = np.frombuffer("\0".join(every).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                a, z = cp[:-1], cp[1:]
                low = (a | z) < 128
                plain += np.bincount(a[low] * 128 + z[low], minlength=1 << 14).reshape(128, 128)
                rest = ~low & (a > 0) & (z > 0)
                wide.add(a[rest] << _BITS | z[rest])
                if wide.full():
                    yield out(*wide.take())
        plain[0] = plain[:, 0] = 0
        a, z = np.nonzero(plain)
        yield out(*wide.take())
        yield out(a << _BITS | z, plain[a, z])
        yield out(np.array([_TEXTS, _READINGS]), np.array(many))

    return df.select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def fit_garble_model(spark: SparkSession, sf_dir: str) -> GarbleModel:
    """Fits the bigram model on every text of the documents table. Only what is usual comes to the driver, however many texts there are."""
    counts = materialise(pair_counts(spread(table(spark, sf_dir, "documents").select("text"))), "pairs")
    many = {r.pair: r.n for r in counts.where("pair < 0").collect()}
    texts, readings = many.get(_TEXTS, 0), many.get(_READINGS, 0)
    if not texts:
        return GarbleModel.fit([])
    real = counts.where("pair >= 0")
    by = lambda c: {chr(r[0]): r[1] for r in real.groupBy(c.alias("c")).agg(F.sum("n")).collect()}
    one, lead = by(F.col("pair").bitwiseAND((1 << _BITS) - 1)), by(F.shiftright("pair", _BITS))
    # the space that a reading begins with is the second of no pair
    one[" "] = one.get(" ", 0) + readings
    got = real.where(F.col("n") >= FEW * max(1, texts / PER_TEXTS)).toArrow()
    two = {chr(p >> _BITS) + chr(p & (1 << _BITS) - 1): n for p, n in zip(got["pair"].to_pylist(), got["n"].to_pylist())}
    return GarbleModel.of_counts(two, one, lead, sum(one.values()), texts)


def repair_texts(df: DataFrame, model: GarbleModel, *columns: str) -> DataFrame:
    """Replaces nothing, and adds for each given text column c: c_repaired and c_garbling (the layers undone, 'lost', or null for clean text).

    Null stays null, empty and ASCII texts pass as clean.
    """
    added = [f"{c}{x}" for c in columns for x in ("_repaired", "_garbling")]
    df = df.drop(*added)
    schema = T.StructType([*df.schema.fields, *[T.StructField(a, T.StringType()) for a in added]])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            cols = list(b.columns)
            for c in columns:
                fixed, how = [], []
                for t in b.column(b.schema.get_field_index(c)).to_pylist():
                    x, h = m.repair(t) if t and not t.isascii() else (t, None)
                    fixed.append(x)
                    how.append(h)
                cols += [pa.array(fixed, pa.string()), pa.array(how, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *added])

    return df.mapInArrow(run, schema)


def garbled_flags(df: DataFrame, model: GarbleModel, *columns: str) -> DataFrame:
    """The rows with one flag more, ``garbled``: whether any of the text columns needs repair. The texts don't leave the worker."""
    rest = [c for c in df.columns if c not in columns and c != "garbled"]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("garbled", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            flag = [False] * b.num_rows
            for c in columns:
                for i, t in enumerate(b.column(b.schema.get_field_index(c)).to_pylist()):
                    if t and not flag[i] and not t.isascii():
                        flag[i] = m.repair(t)[1] is not None
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array(flag)], names=[*rest, "garbled"])

    return df.select(*rest, *columns).mapInArrow(run, schema)


def decode_files(df: DataFrame, model: GarbleModel, raw: str = "raw_head", encoding: str = "encoding", key: str = "input_path") -> DataFrame:
    """(key, decoded, repaired, garbling) of files read with a stated encoding: ``garbling`` is 'undecodable' where the bytes are invalid in it, else as in repair_texts.

    Files with null bytes or a null encoding are left out; an unknown encoding counts as undecodable. A character cut off at the end of the bytes is no error.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import codecs

        m = shared.value
        for b in batches:
            keys = b.column(0).to_pylist()
            out: list[list] = [[], [], []]
            for data, enc in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    text = codecs.getincrementaldecoder(enc.strip())("strict").decode(data, False)
                    fixed, how = m.repair(text)
                except (UnicodeDecodeError, LookupError):
                    text, fixed, how = None, None, "undecodable"
                    for e in MEANT:
                        try:
                            got = codecs.getincrementaldecoder(e)("strict").decode(data, False)
                        except UnicodeDecodeError:
                            continue
                        if fixed is None or m.cost(got) < m.cost(fixed):
                            fixed = got
                for o, v in zip(out, (text, fixed, how)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *[pa.array(o, pa.string()) for o in out]], names=[key, "decoded", "repaired", "garbling"])

    some = df.where(F.col(raw).isNotNull() & F.col(encoding).isNotNull()).select(key, raw, encoding)
    return some.mapInArrow(run, f"`{key}` {kind}, decoded string, repaired string, garbling string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current records with garbled text or title, and files whose stated encoding misreads their bytes."""
    model = fit_garble_model(spark, sf_dir)
    df = states(spark, sf_dir, title=True)
    odd = F.coalesce(F.col("text").rlike(UNUSUAL), F.lit(False)) | F.coalesce(F.col("source_title").rlike(UNUSUAL), F.lit(False))
    # a state without unusual characters only has to say that it is there, without its text
    parted = df.select("doc_id", "stored_at", *[F.when(odd, F.col(c)).alias(c) for c in ("text", "source_title")])
    flags = garbled_flags(parted, model, "text", "source_title")
    records = latest(flags, "garbled").where("garbled").select(F.lit("corpus_documents").alias("tbl"), F.col("doc_id").alias("rec_key"))
    files = table(spark, sf_dir, "reader_files").select("input_path", "encoding", "raw_head")
    bad = decode_files(files, model).where("garbling is not null").select("input_path").distinct()
    return records.unionByName(bad.select(F.lit("reader_files").alias("tbl"), F.col("input_path").alias("rec_key")))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and title of garbled current records after repair; only garbled states leave their task."""
    model = fit_garble_model(spark, sf_dir)
    got = repair_texts(states(spark, sf_dir, title=True), model, "text", "source_title")
    got = got.where("text_garbling is not null or source_title_garbling is not null")
    cols = ("text_repaired", "text_garbling", "source_title_repaired", "source_title_garbling")
    return of_latest(spark, sf_dir, got.select("doc_id", "stored_at", *cols), "doc_id").select("doc_id", *cols)


def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each file that its stated encoding misreads: as read, and restored."""
    model = fit_garble_model(spark, sf_dir)
    files = table(spark, sf_dir, "reader_files").select("input_path", "encoding", "raw_head")
    return decode_files(files, model).where("garbling is not null").distinct()


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired, "p6_files": p6_files}
