"""Removal of long repeated strings, of bytes or of words, by prefix-free parsing."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded_batches, discard, numbered, text_bytes, written

GRAM, BLOCK = 8, 1 << 19
#: Fixed value: the bytes that separate words.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Measure:
    """Strings of span symbols (bytes or words). Each has its trigger in its first reach symbols, 1,000 at most; strides: how finely strings that share a
    bucket are told apart, in steps, the last of them 1."""

    kind: str
    span: int
    reach: int
    strides: tuple[int, ...]

    @property
    def width(self) -> int:
        return 1 if self.kind == "byte" else 8

    @property
    def least_bytes(self) -> int:
        return self.span if self.kind == "byte" else 2 * self.span - 1


def byte_strings(span: int = 400, reach: int = 300, strides: tuple[int, ...] = (16, 1)) -> Measure:
    return Measure("byte", span, reach, strides)


def word_strings(span: int = 50, reach: int = 38, strides: tuple[int, ...] = (6, 1)) -> Measure:
    return Measure("word", span, reach, strides)


_hash = xxhash.xxh3_64_intdigest
_LONG = 64
_POWERS = np.cumprod(np.r_[1, np.full(_LONG - 1, 0x9E3779B97F4A7C15, np.uint64)].astype(np.uint64), dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[list(SEPARATORS)] = True
_SEPARATOR = re.compile(b"[" + SEPARATORS + b"]")


def words(raw: bytes, at_once: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of raw: its longest runs without separators. at_once: bytes (and what a word needs more) in arrays at a time."""
    found, at = [], 0
    while at < len(raw) or not found:
        end = len(raw)
        if at + at_once < end and (m := _SEPARATOR.search(raw, at + at_once)):
            end = m.start()
        starts, ends, h = _words(raw[at:end])
        found.append((starts + at, ends + at, h))
        at = end
    return tuple(map(np.concatenate, zip(*found)))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    on = np.r_[False, ~_BLANK[data], False]
    edges = np.flatnonzero(on[1:] != on[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    size = ends - starts
    short = np.minimum(size, _LONG)  # longer words are hashed below
    first = np.cumsum(short) - short
    place = np.arange(int(short.sum())) - np.repeat(first, short)
    terms = (data[np.repeat(starts, short) + place].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    h = np.add.reduceat(terms, first)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = _hash(raw[starts[k] : ends[k]])
    return starts, ends, h


def symbols(texts: Sequence[bytes], kind: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(buffer, grams, ends): the texts' symbols end to end, a hash at each symbol, and where each text ends, counted in symbols."""
    if kind == "word":
        raw = b"\n".join(texts)
        starts, _, h = words(raw)
        cuts = np.cumsum([len(t) + 1 for t in texts])
        return h.tobytes(), h, np.searchsorted(starts, cuts)
    raw = b"".join(texts)
    padded = np.frombuffer(raw + bytes(GRAM), np.uint8)
    return raw, np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,)), np.cumsum([len(t) for t in texts], dtype=np.int64)


def parse(grams: np.ndarray, ends: np.ndarray, span: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix-free parse of texts that lie end to end: arrays (trigger, low, high), one row per phrase.

    grams: a rolling hash at each symbol. The trigger of a string of span symbols is the smallest hash (the first of equals) in
    its first reach symbols, so it depends on the string alone: equal strings have their triggers at equal places, and no phrase
    is longer than reach. Row: all strings that start at low..high have their trigger at trigger. Every start of a string that
    fits in its text is in exactly one row.
    """
    starts = np.r_[0, ends[:-1]]
    fits = ends - starts >= span
    starts, last = starts[fits], ends[fits] - span
    out = [[], [], []]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in out)
    at = int(starts[0])
    while True:
        hi = min(at + BLOCK, int(last[-1]) + 1)
        n = hi - at + reach - 1
        m = (grams[at : at + n] * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)
        m |= np.arange(n, dtype=np.uint64)
        k = 1
        while 2 * k <= reach:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if k < reach:
            m = np.minimum(m[: len(m) - (reach - k)], m[reach - k :])
        trigger = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        a, b = np.searchsorted(last, at), np.searchsorted(starts, hi)
        edge = np.zeros(hi - at + 1, np.int32)
        np.add.at(edge, np.maximum(starts[a:b] - at, 0), 1)
        np.add.at(edge, np.minimum(last[a:b] + 1 - at, hi - at), -1)
        s = np.flatnonzero(np.cumsum(edge[:-1]))
        if len(s):
            t = trigger[s]
            first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)])
            for o, x in zip(out, (t[first], s[first], s[np.r_[first[1:] - 1, len(s) - 1]])):
                o.append(x + at)
        if hi > last[-1]:
            return tuple(np.concatenate(o) for o in out)
        at = max(hi, int(starts[min(np.searchsorted(last, hi), len(starts) - 1)]))


def _slices(sizes: list[int], most: int = 1 << 20):
    """Ranges of texts with up to most bytes together, or one text."""
    a = total = 0
    for b, size in enumerate(sizes):
        if total and total + size > most:
            yield a, b
            a, total = b, 0
        total += size
    yield a, len(sizes)


def _hashes(buffer: bytes, a: np.ndarray, b: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return np.fromiter((_hash(buffer[x:y], s) for x, y, s in zip(a.tolist(), b.tolist(), seed.tolist())), np.uint64, len(a)).view(np.int64)


#: place = low << 23 | pre << 13 | n << 3 | u in one bigint: low, the first string's start; pre, how far the trigger lies behind it; n, strings; u, the measure.
U, N, LOW = "cast(place & 7 as int)", "cast(shiftright(place, 3) & 1023 as int)", "cast(shiftright(place, 23) as int)"


def phrases(texts: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """texts (h1, h2, r, t) to one row per phrase: bucket k (hash of the symbols that every string of the row has), class c (hash of all
    symbols of the row's strings and of the trigger's place), h1, h2, r, place."""
    schema = pa.schema([(c, pa.int64()) for c in ("k", "c", "h1", "h2", "r", "place")])

    def run(batches):
        for b in batches:
            keys = [b.column(j).to_numpy() for j in range(3)]
            for x, y in _slices(pc.binary_length(b.column(3)).to_pylist()):
                part = b.column(3)[x:y].to_pylist()
                for u, m in enumerate(measures):
                    buffer, grams, ends = symbols(part, m.kind)
                    t, lo, hi = parse(grams, ends, m.span, m.reach)
                    doc, w = np.searchsorted(ends, t, "right"), m.width
                    k = _hashes(buffer, t * w, (t + m.span - m.reach) * w, np.full(len(t), u))
                    c = _hashes(buffer, lo * w, (hi + m.span) * w, (t - lo) * 8 + u)
                    place = (lo - np.r_[0, ends][doc]) << 23 | (t - lo) << 13 | (hi - lo + 1) << 3 | u
                    yield batch(schema, k, c, *(v[x:y][doc] for v in keys), place)

    return texts.mapInArrow(run, "k long, c long, h1 long, h2 long, r long, place long")


_STRINGS = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("many", pa.bool_()), ("a", pa.int32()), ("b", pa.int32()), ("s", pa.int64()), ("w", pa.int64())])


def _strings(contexts: DataFrame, measures: Sequence[Measure], step: int) -> DataFrame:
    """Contexts (k, c, many, place, raw, ranges) to groups of up to strides[step] neighbouring strings: (k, c, many, a, b, s, w), for the
    strings a..b of entry (k, c). s: hash of what every string of a full group has; w: hash of all the group's symbols. Groups are cut at
    equal places before the trigger, so equal strings of different entries are in groups of equal s. ranges null: all strings."""

    def run(batches):
        for batch_in in batches:
            cols = [[] for _ in range(7)]
            for k, c, many, place, raw, ranges in zip(*(batch_in.column(j).to_pylist() for j in range(6))):
                u, pre = place & 7, place >> 13 & 1023
                stride, span, w = measures[u].strides[step], measures[u].span, measures[u].width
                for lo, hi in [(r["a"], r["b"]) for r in ranges] if ranges else [(0, (place >> 3 & 1023) - 1)]:
                    for j in range((pre - hi) // stride, (pre - lo) // stride + 1):
                        near, far = max(j * stride, pre - hi), min(j * stride + stride - 1, pre - lo)
                        a, b, core = pre - far, pre - near, pre - j * stride
                        s = _hash(raw[core * w : (core + span - stride + 1) * w], j * 8 + u)
                        x = _hash(raw[a * w : (b + span) * w], (far << 20) + (u << 17) + 1)
                        for col, v in zip(cols, (k, c, many, a, b, s, x)):
                            col.append(v)
                if len(cols[0]) > 20000:
                    yield _string_batch(cols)
                    cols = [[] for _ in range(7)]
            if cols[0]:
                yield _string_batch(cols)

    return contexts.select("k", "c", "many", "place", "raw", "ranges").mapInArrow(run, "k long, c long, many boolean, a int, b int, s long, w long")


def _string_batch(cols: list[list]) -> pa.RecordBatch:
    hashed = [np.frombuffer(array("Q", x), np.int64) for x in cols[5:]]
    return batch(_STRINGS, *cols[:5], *hashed)


def _shared_strings(contexts: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """(k, c, a, b): the strings a..b of entry (k, c) that other entries have too.

    Groups of strides[0] neighbouring strings are counted by what all of them share: a group that one entry alone has is done, and one
    that is the same in all its entries is repeated as a whole. Only the others are told apart with the next stride, the last being single
    strings. Every bucket goes this way, whatever its size: rows grow with entries, are counted map-side, and are never brought together.
    """
    ranges = F.lit(None).cast("array<struct<a:int,b:int>>").alias("ranges")
    at, found = contexts.select("*", ranges), None
    steps = len(measures[0].strides)
    for step in range(steps):
        last = step == steps - 1
        each = written(_strings(at, measures, step), f"strings-{step}")
        keys = ["s", "w"] if last else ["s"]
        twice = each.groupBy(*keys).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("w").alias("w0"), F.max("w").alias("w1")).filter("c0 <> c1")
        twice = twice.select(*keys, (F.col("w0") != F.col("w1")).alias("mixed"))
        hits = written(each.join(twice, keys).select("k", "c", "many", "a", "b", "mixed"), f"hits-{step}")
        discard(each)
        runs = hits.filter("not many and not mixed").select("k", "c", "a", "b")
        found = runs if found is None else found.union(runs)
        if not last:
            more = hits.filter("mixed").groupBy("k", "c").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
            at = contexts.join(more, ["k", "c"])
    return found


def repeats(df: DataFrame, measures: Sequence[Measure], id_col: str = "doc_id", text_col: str = "text", every_text: bool = False) -> DataFrame:
    """(rest, n_bytes, sha, z, spans): per input row its other columns as a struct rest, first whether the text is null and then the columns
    in order; the text's UTF-8 size, and either sha, the sha256 of the whole text (no phrase of it is repeated), or z, the text in zstd, with
    spans, the repeated ranges (u, a, b): symbols a..b-1 of measure u. every_text: z for all rows.

    A symbol is in a range if a string of measures[u].span symbols covers it that starts at another place too: in another document, in
    another row, or elsewhere in the same text. Strings never cross texts; null texts are empty; ids may be null or repeated.

    1. Each text is parsed into phrases at rolling-hash triggers (see parse); the phrase table is written.
    2. Phrases are counted by bucket. A bucket that occurs once holds no repeated string: in most text that's the end of it.
    3. A bucket whose occurrences all have the same symbols is repeated as a whole: the dictionary has one entry.
    4. For the rest, one occurrence of each distinct entry is fetched, and its strings are compared with those of the bucket's other
    entries (see _shared_strings).

    Texts are known by two independent 64-bit hashes together, so copies share their ranges and ids play no part in what is removed.
    """
    bounded_batches(df)
    t = text_bytes(text_col)
    key = {"h1": F.xxhash64(t), "h2": F.xxhash64(F.lit("second"), t), "r": F.xxhash64(F.col(f"`{id_col}`"))}
    keys = [c.alias(k) for k, c in key.items()]
    least = min(m.least_bytes for m in measures)
    all_phrases = written(phrases(df.select(*keys, t.alias("t")).filter(F.octet_length("t") >= least), measures), "phrases")
    buckets = all_phrases.groupBy("k").agg(F.count("*").alias("occurs"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("occurs > 1")
    buckets = written(buckets.select("k", (F.col("c0") != F.col("c1")).alias("mixed")), "buckets")
    found = written(all_phrases.join(buckets, "k"), "repeated-phrases")
    discard(all_phrases, buckets)

    entries = found.filter("mixed").groupBy("k", "c").agg(F.count("*").alias("copies"), F.min(F.struct("h1", "h2", "r", "place")).alias("at"))
    entries = written(entries.select("k", "c", (F.col("copies") > 1).alias("many"), "at.*"), "entries")
    wanted = entries.select("h1", "h2", F.struct("k", "c", "many", "place", "r").alias("want"))
    none = found.select("h1", "h2", F.lit(None).cast(wanted.schema["want"].dataType).alias("want"))
    active = wanted.union(none).groupBy("h1", "h2").agg(F.collect_list("want").alias("wants"))

    @F.arrow_udf("binary")
    def squeezed(texts: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=3)
        return pa.array([z.compress(x) for x in texts.to_pylist()], pa.binary())

    rest = [F.col(f"`{text_col}`").isNull().alias("_0"), *[F.col(f"`{c}`").alias(f"_{j}") for j, c in enumerate((c for c in df.columns if c != text_col), 1)]]
    rows = df.select(*keys, F.struct(*rest).alias("rest"), F.octet_length(t).cast("long").alias("n_bytes"), F.unhex(F.sha2(t, 256)).alias("sha"), squeezed(t).alias("z"))
    store = rows.join(active, ["h1", "h2"], "left")
    known = F.col("wants").isNotNull()
    wants = F.filter("wants", lambda x: x["r"] == F.col("r"))  # one of a text's copies is asked
    store = store.select("h1", "h2", "rest", "n_bytes", F.when(~known, F.col("sha")).alias("sha"), F.when(known | F.lit(every_text), F.col("z")).alias("z"), wants.alias("wants"))
    store = written(store, "texts")

    def fetch(batches):
        z = zstandard.ZstdDecompressor()
        schema = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("many", pa.bool_()), ("place", pa.int64()), ("raw", pa.binary())])
        for b in batches:
            asks, ends = b.column(1).flatten(), np.cumsum(pc.list_value_length(b.column(1)).to_numpy())
            k, c, many, place = (asks.field(j) for j in range(4))
            places, at, raws, sent = place.to_numpy(), 0, [], 0
            for packed, end in zip(b.column(0), ends.tolist()):
                raw, buffers = z.decompress(packed.as_py()), {}
                for p in places[at:end].tolist():
                    u, n, low = p & 7, p >> 3 & 1023, p >> 23
                    m = measures[u]
                    if u not in buffers:
                        buffers[u] = symbols([raw], m.kind)[0]
                    raws.append(buffers[u][low * m.width : (low + n - 1 + m.span) * m.width])
                at = end
                if len(raws) > 4000 or at == len(places):
                    yield batch(schema, k[sent:at], c[sent:at], many[sent:at], place[sent:at], raws)
                    raws, sent = [], at

    contexts = store.filter("size(wants) > 0").select("z", "wants").mapInArrow(fetch, "k long, c long, many boolean, place long, raw binary")
    contexts = written(contexts, "contexts")
    runs = _shared_strings(contexts, measures)

    span = "case " + " ".join(f"when {U} = {j} then {m.span}" for j, m in enumerate(measures)) + " end"
    whole = ["h1", "h2", f"{U} as u", f"{LOW} as a", f"{LOW} + {N} - 1 + {span} as b"]
    spans = found.filter("not mixed").selectExpr(*whole)
    spans = spans.union(found.filter("mixed").join(entries.filter("many").select("k", "c"), ["k", "c"]).selectExpr(*whole))
    part = ["h1", "h2", f"{U} as u", f"{LOW} + a as a", f"{LOW} + b + {span} as b"]
    spans = spans.union(runs.join(entries.filter("not many").select("k", "c", "h1", "h2", "place"), ["k", "c"]).selectExpr(*part))
    spans = written(spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("u", "a", "b")).alias("spans")), "spans")
    discard(found, entries, contexts)
    fields = ["rest", "n_bytes", "sha", "z"]
    out = store.filter("z is not null").join(spans, ["h1", "h2"], "left").select(*fields, "spans")
    return out.union(store.filter("z is null").select(*fields, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))


def merged(spans: pa.ListArray, measures: int) -> list[list[list[tuple[int, int]]]]:
    """For each row and measure the maximal runs of symbols that the row's ranges cover; a null row has none."""
    flat, rows = spans.flatten(), len(spans)
    group = np.repeat(np.arange(rows), pc.coalesce(pc.list_value_length(spans), 0).to_numpy())
    group = (group * measures + flat.field(0).to_numpy()) << 32  # one number line for all rows: those of later rows lie behind
    a, b = group + flat.field(1).to_numpy(), group + flat.field(2).to_numpy()
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]][: len(a)])
    a, b = a[first], b[np.r_[first[1:] - 1, len(b) - 1]] if len(first) else b
    cuts = np.searchsorted(a, np.arange(rows * measures + 1) << 32).tolist()
    runs = list(zip((a & 0xFFFFFFFF).tolist(), (b & 0xFFFFFFFF).tolist()))
    return [[runs[cuts[i * measures + u] : cuts[i * measures + u + 1]] for u in range(measures)] for i in range(rows)]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))


def byte_ranges(raw: bytes, runs: list[tuple[int, int]], kind: str) -> list[tuple[int, int]]:
    """Runs of symbols as byte ranges; a run of words goes from the first word's start to the last one's end."""
    if kind == "byte" or not runs:
        return runs
    starts, ends, _ = words(raw)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in runs]


def removal_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_of: Measure = byte_strings(), words_of: Measure = word_strings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words), one row per input row; see repeats.

    The first five are about byte strings: what is removed and what is left. n_repeated_words counts the words that strings of words cover
    which also start elsewhere, such as passages shorter than a byte string; nothing is removed for them. Ids that aren't numbers are null.
    """
    found = repeats(df.select(numbered(id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), [bytes_of, words_of])
    fields = [(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("kept_sha256", pa.string()), ("n_repeated_words", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, n, sha, packed, (gone, repeated) in zip(*(b.column(j).to_pylist() for j in range(4)), merged(b.column(4), 2)):
                kept = sha.hex() if packed is None else hashlib.sha256(without(z.decompress(packed), gone)).hexdigest()
                out.append((doc, n, sum(y - x for x, y in gone), len(gone), kept, sum(y - x for x, y in repeated)))
            yield batch(schema, *(zip(*out) if out else ([],) * 6))

    rows = found.select(F.col("rest._1").alias("doc_id"), "n_bytes", "sha", "z", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: Measure = byte_strings()) -> DataFrame:
    """df with what repeated strings cover taken out of its texts, all rows and columns kept, whatever their names; a null text stays null.

    Byte ranges may halve a character; what is left of it is dropped from the text. Ranges of words are whole words with what is between them.
    """
    found = repeats(df, [of], id_col, text_col, every_text=True)

    @F.arrow_udf("string")
    def kept(packed: pa.Array, spans: pa.Array) -> pa.Array:
        z = zstandard.ZstdDecompressor()
        out = []
        for p, (runs,) in zip(packed.to_pylist(), merged(spans, 1)):
            raw = z.decompress(p)
            out.append(without(raw, byte_ranges(raw, runs, of.kind)).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    rest: dict[str, Column] = {c: F.col(f"rest._{j}") for j, c in enumerate((c for c in df.columns if c != text_col), 1)}
    rest[text_col] = F.when(~F.col("rest._0"), kept("z", "spans"))
    return found.select(*[rest[c].alias(c) for c in df.columns])
