"""Language of documents and passages by language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: a slot holds one bit for each class, so
the AND of the slots of an n-gram gives every language that contains it. Each
sentence collects, for each language, how many of its n-grams the language
contains (popcounts), corrected for the false positives that the filter's fill
lets expect; the largest corrected share decides and its lead is the confidence.

N-grams are four characters inside a word with its borders, and two characters
in Han and kana. A further class for program code keeps code from counting as a
language. Everything runs on whole Arrow batches in numpy.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, spread
from .corpus import Tally, chunks, language_label, language_names, latest, of_latest, states, table
from .encoding import GarbleModel, fit_garble_model, stored_at

CODE = "code"
SLOT_BITS = 18
#: A language keeps an n-gram if its documents have it at least this often, against the language that has it most.
KEEP_RATE = 0.12
#: A language keeps an n-gram that at least two of its documents have, and at least this share of them; one document is enough for a language of fewer than SMALL.
COMMON = 0.001
SMALL = 20
#: Texts up to this length aren't fitted on.
SHORT = 40
#: Times that texts which the filter reads otherwise may change their label, and once more.
ROUNDS = 2
MIN_SHARE = 0.45
#: Confidence from which a sentence counts as one written in a language, and from which a plain one does: with letters enough and few signs of code, links or tables.
SURE = 0.7
PLAIN = 0.5
PLAIN_LETTERS = 30
PLAIN_SIGNS = 0.06
MIN_GRAMS = 10
MIN_CJK = 5
#: Code points from here on are no letters in Unicode.
_TOP = 0x33480
#: Languages that the result's bitmask has room for.
MOST_LANGUAGES = 62


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the folded letter (0: no letter), whether it is Han or kana, whether it is upper case."""
    fold = np.zeros(_TOP, np.uint32)
    upper = np.zeros(_TOP, bool)
    for c in range(_TOP):
        ch = chr(c)
        k = unicodedata.category(ch)
        if k[0] == "L":
            low = ch.lower()
            fold[c] = ord(low[0])
            upper[c] = k == "Lu"
    cjk = np.zeros(_TOP, bool)
    for a, b in ((0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, _TOP)):
        cjk[a:b] = fold[a:b] > 0
    return fold, cjk, upper


_STOPS = np.array([ord(c) for c in ".!?…؟;:,)"], np.uint32)
_ENDS = np.array([ord(c) for c in ".!?…؟"], np.uint32)
_WIDE_ENDS = np.array([ord(c) for c in "。！？"], np.uint32)
_SPACES = np.array([9, 10, 13, 32, 0xA0, 0], np.uint32)
_SIGNS = np.array([ord(c) for c in "=<>{}[]()|_/\\`#*~^&"], np.uint32)
_QUOTES = np.array([ord(c) for c in "\"'”’»)]<*`_"], np.uint32)


def _cut(cp: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Marks the last character of each sentence. Lines end sentences, and so does NUL between records."""
    low = np.minimum(cp, _TOP - 1)
    nxt = np.append(cp[1:], 0).astype(np.uint32)
    before = np.concatenate(([0], low[:-1]))
    end = np.isin(cp, _ENDS) & (np.isin(nxt, _SPACES) | np.isin(nxt, _QUOTES) | (upper[np.minimum(nxt, _TOP - 1)] & ~upper[before]))
    return end | np.isin(cp, _WIDE_ENDS) | (cp == 10) | (cp == 0)


def grams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a code point array, and the position of each."""
    fold, cjk, _ = _tables()
    low = np.minimum(cp, _TOP - 1)
    f = np.zeros(len(cp) + 3, np.uint32)
    f[1:-2] = fold[low]
    c0, c1, c2, c3 = f[:-3], f[1:-2], f[2:-1], f[3:]
    at = np.flatnonzero((c1 > 0) & (c2 > 0))
    a, b = c1[at], c2[at]
    wide = cjk[np.minimum(a, _TOP - 1)] | cjk[np.minimum(b, _TOP - 1)]
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    h += np.where(wide, np.uint32(0), c0[at] * np.uint32(0xC2B2AE3D) + c3[at] * np.uint32(0x27D4EB2F) + np.uint32(1))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h, at


def gram_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted hashes of the different n-grams of each of a few texts."""
    if not texts:
        return []
    # NUL is no letter: it ends a word as the border of a text does
    h, at = grams(_points("\0".join(texts)))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, side="right")
    key = np.unique(doc.astype(np.uint64) << np.uint64(32) | h)
    borders = np.searchsorted(key, np.arange(1, len(texts), dtype=np.uint64) << np.uint64(32))
    return np.split(key.astype(np.uint32), borders)


def least_documents(n: int) -> float:
    """Documents of a class of n that an n-gram must be in."""
    return 1 if n < SMALL else max(2, COMMON * n)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def _lanes() -> np.ndarray:
    """By word of sixteen classes: its bits spread over 16-bit lanes of four words, so that one sum counts all of them."""
    m = np.arange(1 << 16, dtype=np.uint64)
    out = np.zeros((len(m), 4), np.uint64)
    for k in range(16):
        out[:, k // 4] |= ((m >> np.uint64(k)) & np.uint64(1)) << np.uint64(16 * (k % 4))
    return out


def class_names(labels: set[str]) -> list[str]:
    """The classes of a filter: the languages in order, and code."""
    classes = sorted(labels - {CODE}) + [CODE]
    if len(classes) > MOST_LANGUAGES:
        raise ValueError(f"{len(classes) - 1} languages are more than {MOST_LANGUAGES - 1}")
    return classes


@dataclass
class LanguageFilter:
    """A fitted filter: slots of both hashes by words of sixteen classes. ``classes`` ends with the class of code."""

    classes: list[str]
    first: list[np.ndarray]
    second: list[np.ndarray]
    false_rate: np.ndarray

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h >> np.uint32(32 - SLOT_BITS), (h * np.uint32(0x297A2D39)) >> np.uint32(32 - SLOT_BITS)

    @classmethod
    def build(cls, classes: list[str], kept: dict[int, np.ndarray]) -> LanguageFilter:
        one, two = ([np.zeros(1 << SLOT_BITS, np.uint16) for _ in range(0, len(classes), 16)] for _ in "12")
        fill = []
        for k, h in sorted(kept.items()):
            a, b = cls._slots(h)
            w, bit = k // 16, np.uint16(1 << k % 16)
            one[w][a] |= bit
            two[w][b] |= bit
            fill.append(float(np.mean((one[w] & bit) > 0)) * float(np.mean((two[w] & bit) > 0)))
        return cls(classes, one, two, np.array(fill))

    @classmethod
    def fit(cls, texts: list[str], labels: list[str | None], rounds: int = ROUNDS) -> LanguageFilter:
        """Fits on labelled texts. Labels may be wrong here and there: a rarely seen n-gram of a class is left out, and after each round texts that the filter reads otherwise change their label."""
        classes = class_names({x for x in labels if x})
        number = {c: k for k, c in enumerate(classes)}
        seen = [x for a, z in chunks(texts) for x in gram_sets(texts[a:z])]
        now = np.array([number.get(x, -1) if x else -1 for x in labels])
        model = None
        for _ in range(rounds):
            rows: list[np.ndarray] = []
            n = np.zeros(len(classes))
            for k in range(len(classes)):
                own = [seen[i] for i in np.flatnonzero(now == k)]
                n[k] = max(1, len(own))
                rows.append(np.concatenate(own) if own else np.zeros(0, np.uint32))
            every, where = np.unique(np.concatenate(rows), return_inverse=True)
            cls_of = np.repeat(np.arange(len(classes)), [len(r) for r in rows])
            df = np.bincount(cls_of * len(every) + where, minlength=len(classes) * len(every)).reshape(len(classes), -1)
            rate = df / n[:, None]
            keep = (rate >= KEEP_RATE * rate.max(axis=0)) & (df >= np.array([least_documents(x) for x in n])[:, None])
            model = cls.build(classes, {k: every[keep[k]] for k in range(len(classes))})
            now = model.relabelled(seen, now)
        return model

    def relabelled(self, seen: list[np.ndarray], now: np.ndarray) -> np.ndarray:
        """The classes of texts by this filter where it reads them clearly; code and texts without a class stay."""
        found = self.whole(seen)
        return np.where((found >= 0) & (now >= 0) & (now != len(self.classes) - 1), found, now)

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        """Bitmasks of the classes that contain each n-gram, in words of sixteen classes."""
        a, b = self._slots(h)
        return [one[a] & two[b] for one, two in zip(self.first, self.second)]

    def whole(self, seen: list[np.ndarray]) -> np.ndarray:
        """The class of each set of n-grams, -1 if none leads clearly."""
        n = np.array([len(h) for h in seen])
        counts = np.zeros((len(seen), len(self.classes)))
        some = np.flatnonzero(n >= MIN_GRAMS)
        if len(some):
            masks = self.masks(np.concatenate([seen[i] for i in some]))
            first = np.concatenate(([0], np.cumsum(n[some])[:-1]))
            for k in range(len(self.classes)):
                counts[some, k] = np.add.reduceat(((masks[k // 16] >> (k % 16)) & 1).astype(np.int64), first)
        share = self.corrected(counts, n)
        top = np.sort(np.pad(share, ((0, 0), (1, 0))), axis=1)
        return np.where((top[:, -1] > 0.6) & (top[:, -1] - top[:, -2] > 0.1), share.argmax(axis=1), -1)

    def corrected(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1)[:, None]
        return np.clip((counts - n * self.false_rate) / (1 - self.false_rate) / n, 0, 1)

    def sentences(self, texts: list[str]) -> dict[str, np.ndarray]:
        """The sentences of a few texts: text number, start, end, class (-1: none), confidence, and whether they count as sentences of that language."""
        _, cjk, upper = _tables()
        joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts)
        cp = _points(joined)
        if not len(cp):
            return {k: np.zeros(0, int) for k in ("doc", "start", "end", "cls")} | {"conf": np.zeros(0), "sure": np.zeros(0, bool)}
        last = _cut(cp, upper)
        last[-1] = True
        ends = np.flatnonzero(last) + 1
        # no lane may overflow: sentences are counted in stretches of at most 60,000 characters
        long = np.flatnonzero(np.diff(np.concatenate(([0], ends))) > 60_000)
        if len(long):
            starts0 = np.concatenate(([0], ends[:-1]))
            ends = np.unique(np.concatenate([ends, *[np.arange(starts0[i] + 60_000, ends[i], 60_000) for i in long]]))
        starts = np.concatenate(([0], ends[:-1]))
        h, at = grams(cp)
        n = np.zeros(len(ends), np.int64)
        counts = np.zeros((len(ends), len(self.classes)))
        if len(h):
            seg = np.searchsorted(ends, at, side="right")
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            own = seg[first]
            n[own] = np.diff(np.append(first, len(h)))
            for w, masks in enumerate(self.masks(h)):
                sums = np.add.reduceat(_lanes()[masks], first, axis=0)
                for k in range(min(16, len(self.classes) - 16 * w)):
                    counts[own, 16 * w + k] = (sums[:, k // 4] >> np.uint64(16 * (k % 4))) & np.uint64(0xFFFF)
        wide = np.zeros(len(ends), bool)
        wide_at = np.add.reduceat(cjk[np.minimum(cp, _TOP - 1)].astype(np.int32), starts)
        wide = wide_at * 2 > n
        size = np.array([len(t) + 1 for t in texts])
        offset = np.concatenate(([0], np.cumsum(size)[:-1]))
        doc = np.searchsorted(offset, starts, side="right") - 1
        share = self.corrected(counts, n)
        # the whole text breaks near ties within it
        total = np.zeros((len(texts), len(self.classes)))
        np.add.at(total, doc, share * n[:, None])
        main = total.argmax(axis=1)[doc]
        best = share.argmax(axis=1)
        row = np.arange(len(ends))
        best = np.where(share[row, main] >= share[row, best] - 0.08, main, best)
        top = share[row, best]
        rest = share.copy()
        rest[row, best] = 0
        lead = top - rest.max(axis=1) if rest.shape[1] > 1 else top
        known = (n >= np.where(wide, MIN_CJK, MIN_GRAMS)) & (top >= MIN_SHARE)
        conf = np.where(known, np.clip(top * (0.5 + 0.5 * np.clip(lead / 0.3, 0, 1)), 0, 1), 0.0)
        at0 = offset[doc]
        letters = np.add.reduceat((_tables()[0][np.minimum(cp, _TOP - 1)] > 0).astype(np.int32), starts)
        signs = np.add.reduceat(np.isin(cp, _SIGNS).astype(np.int32), starts)
        sure = known & ((conf >= SURE) | (conf >= PLAIN) & (letters >= PLAIN_LETTERS) & (signs <= PLAIN_SIGNS * letters))
        return {"sure": sure, "doc": doc, "start": starts - at0, "end": np.minimum(ends - at0, size[doc] - 1), "cls": np.where(known, best, -1), "conf": conf}


def gram_counts(df: DataFrame, classes: list[str], model: LanguageFilter | None = None) -> DataFrame:
    """(cls, gram, n): how many of the texts of a class have an n-gram, and with gram null how many texts it has. With a ``model``, texts are of the class that it reads."""
    number = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, k)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        tally, n = Tally(), np.zeros(len(classes), np.int64)

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(counts, pa.int64())], names=["cls", "gram", "n"])

        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_numpy()
            for a, z in chunks(texts):
                seen, now = gram_sets(texts[a:z]), labels[a:z]
                if m is not None:
                    now = m.relabelled(seen, now)
                n += np.bincount(now, minlength=len(classes))
                tally.add(np.repeat(now.astype(np.int64) << 32, [len(x) for x in seen]) | np.concatenate(seen))
                if tally.full():
                    yield out(*tally.take())
        yield out(*tally.take())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.nulls(len(n), pa.int64()), pa.array(n)], names=["cls", "gram", "n"])

    rows = df.select("text", F.element_at(number, F.col("label")).alias("cls"))
    return rows.mapInArrow(run, "cls int, gram long, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def fit_on(docs: DataFrame, rounds: int = ROUNDS) -> LanguageFilter:
    """``LanguageFilter.fit`` on every row of a table of any size with text and label. Only the n-grams that a class keeps come to the driver: their number is bounded by the share of documents that have them."""
    labels = {r.label for r in docs.select("label").distinct().collect() if r.label}
    classes = class_names(labels)
    docs = docs.where(F.col("label").isNotNull() & (F.length("text") > SHORT))
    model = None
    for _ in range(rounds):
        counts = materialise(gram_counts(docs, classes, model), "grams")
        n = dict.fromkeys(range(len(classes)), 1) | {r.cls: max(1, r.n) for r in counts.where("gram is null").collect()}
        of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("cls") + 1)
        rated = counts.where("gram is not null").withColumn("rate", F.col("n") / of(n.values()))
        rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
        kept = rated.where((F.col("rate") >= KEEP_RATE * F.col("top")) & (F.col("n") >= of(map(least_documents, n.values()))))
        got = kept.select("cls", "gram").toArrow()
        cls, gram = got["cls"].to_numpy(), got["gram"].to_numpy().astype(np.uint32)
        model = LanguageFilter.build(classes, {k: gram[cls == k] for k in range(len(classes))})
    return model


def fit_language_filter(spark: SparkSession, sf_dir: str) -> LanguageFilter:
    """Fits a filter on every labelled row of the documents table; rows of section type code make the class of code."""
    label = F.when(F.col("section_type") == "code", CODE).otherwise(language_label(F.col("lang"), language_names(spark, sf_dir)))
    return fit_on(spread(table(spark, sf_dir, "documents").select("text", label.alias("label"))))


def _unread(s: dict[str, np.ndarray], texts: list[str]) -> list[int]:
    """Texts with a longer sentence beyond ASCII that no language claims."""
    odd = np.unique(s["doc"][(s["cls"] < 0) & (s["end"] - s["start"] >= 20)])
    return [int(d) for d in odd if not texts[d].isascii()]


def tag_documents(df: DataFrame, model: LanguageFilter, text: str = "text", min_sentences: int = 2, garble: GarbleModel | None = None) -> DataFrame:
    """Adds to each row its main language, a confidence in 0..1 and the languages of at least ``min_sentences`` sentences as a bitmask (``languages_mask``, bit k is ``model.classes[k]``).

    With a ``garble`` model, texts with sentences that no language claims are
    read again after the repair of wrong encodings: garbling doesn't change the
    language of a text.

    Null, empty and letterless texts get language null, confidence 0 and mask 0.
    Other columns pass unchanged; columns named like the results are replaced.
    """
    added = ("language_found", "language_confidence", "languages_mask")
    df = df.drop(*added)
    shared = df.sparkSession.sparkContext.broadcast((model, garble))
    schema = T.StructType([*df.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.LongType())])

    def run(batches):
        m, repairer = shared.value
        real = len(m.classes) - 1
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            mask, name, conf = np.zeros(len(texts), np.int64), np.full(len(texts), -1), np.zeros(len(texts))
            for a, z in chunks(texts):
                s = m.sentences(texts[a:z])
                if repairer:
                    hit = False
                    for d in _unread(s, texts[a:z]):
                        fixed, how = repairer.repair(texts[a + d])
                        if how and how != "lost":
                            texts[a + d], hit = fixed, True
                    if hit:
                        s = m.sentences(texts[a:z])
                ok = (s["cls"] >= 0) & (s["cls"] < real)
                per = np.zeros((z - a, len(m.classes)), np.int64)
                sure = ok & s["sure"]
                np.add.at(per, (s["doc"][sure], s["cls"][sure]), 1)
                weight = np.zeros((z - a, len(m.classes)))
                length = (s["end"] - s["start"])[ok]
                np.add.at(weight, (s["doc"][ok], s["cls"][ok]), length * s["conf"][ok])
                total = np.zeros(z - a)
                np.add.at(total, s["doc"][ok], length)
                mask[a:z] = ((per >= min_sentences) << np.arange(len(m.classes))).sum(axis=1)
                has = total > 0
                name[a:z] = np.where(has, weight.argmax(axis=1), -1)
                conf[a:z] = np.where(has, weight.max(axis=1) / np.maximum(total, 1), 0)
            cols = [pa.array([m.classes[k] if k >= 0 else None for k in name], pa.string()), pa.array(conf), pa.array(mask)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *added])

    return df.mapInArrow(run, schema)


PASSAGE = ("passage_no", "passage_language", "confidence", "char_start", "char_end")


def tag_passages(df: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text", garble: GarbleModel | None = None) -> DataFrame:
    """One row for each passage: neighbouring sentences in one language, with its place in code points and a confidence.

    Sentences without a language of their own (numbers, code, single words)
    join the passage before them, or the first one; a text without any language
    gives one passage with language null.

    With a ``garble`` model every text is read after the repair of wrong
    encodings; places are those of the stored text.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, garble))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        m, repairer = shared.value
        real = len(m.classes) - 1
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out: dict[str, list] = {k: [] for k in ("key", "no", "lang", "conf", "start", "end")}
            places: dict[int, list] = {}
            for i, t in enumerate(texts):
                if repairer and not t.isascii():
                    texts[i], _, found = repairer.repair_placed(t)
                    if found:
                        places[i] = found
            for a, z in chunks(texts):
                s = m.sentences(texts[a:z])
                cls = np.where(s["cls"] < real, s["cls"], -1)
                for d in range(z - a):
                    lo, hi = np.searchsorted(s["doc"], (d, d + 1))
                    runs: list[list] = []
                    for i in range(lo, hi):
                        k, size = cls[i], s["end"][i] - s["start"][i]
                        if size <= 0:
                            continue
                        if runs and (k < 0 or runs[-1][0] == k or runs[-1][0] < 0):
                            r = runs[-1]
                            r[0] = max(r[0], k)
                            r[2] = s["end"][i]
                        else:
                            r = [k, s["start"][i], s["end"][i], 0.0, 0]
                            runs.append(r)
                        if k >= 0:
                            r[3] += s["conf"][i] * size
                            r[4] += size
                    for no, (k, start, end, c, w) in enumerate(runs):
                        out["key"].append(a + d)
                        out["no"].append(no)
                        out["lang"].append(m.classes[k] if k >= 0 else None)
                        out["conf"].append(c / w if w else 0.0)
                        out["start"].append(stored_at(places.get(a + d, []), int(start)))
                        out["end"].append(stored_at(places.get(a + d, []), int(end)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(out["key"], pa.int64())), pa.array(out["no"], pa.int32()), pa.array(out["lang"], pa.string()), pa.array(out["conf"], pa.float64()), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32())],
                names=[key, "passage_no", "passage_language", "confidence", "char_start", "char_end"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, passage_no int, passage_language string, confidence double, char_start int, char_end int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of at least two sentences of a current record that its label does not name."""
    model = fit_language_filter(spark, sf_dir)
    codes = language_names(spark, sf_dir)
    df = states(spark, sf_dir, "language").select("doc_id", "stored_at", language_label(F.col("language"), codes).alias("label"), "text")
    tagged = tag_documents(df, model, garble=fit_garble_model(spark, sf_dir)).select("doc_id", "stored_at", "label", "languages_mask")
    own = F.lit(0).cast("long")
    for k, c in enumerate(model.classes[:-1]):
        own = F.when(F.col("label") == c, F.lit(1 << k).cast("long")).otherwise(own)
    left = tagged.select("doc_id", "stored_at", F.col("languages_mask").bitwiseAND(F.bitwise_not(own)).alias("left"))
    names = F.array(*[F.when(F.col("left").bitwiseAND(1 << k) != 0, F.lit(c)) for k, c in enumerate(model.classes[:-1])])
    return latest(left, "left").where("left > 0").select("doc_id", F.explode(F.array_compact(names)).alias("found_language"))


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every current record with its language, confidence and place. Passages are made for each state next to the scan; only they are shuffled."""
    model = fit_language_filter(spark, sf_dir)
    df = states(spark, sf_dir).where("text is not null").select(F.struct("doc_id", "stored_at").alias("state"), "text")
    got = tag_passages(df, model, key="state", garble=fit_garble_model(spark, sf_dir)).select("state.*", *PASSAGE)
    return of_latest(spark, sf_dir, got, "doc_id", "passage_no").select("doc_id", *PASSAGE)


QUERIES = {"p1_found": p1_found, "p1_passages": p1_passages}
