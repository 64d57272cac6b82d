"""Token packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections import Counter
from functools import cache

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, numbered, written

#: Fixed value: how byte-level BPE splits text before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_RUN = 5000
LONG_BLANK = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def byte_alphabet() -> dict[str, int]:
    """Character to byte, as byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file as the tokenizers library gives them without special tokens, as little-endian uint32 bytes.

    Where the file is plain byte-level BPE whose ids follow its merges, tiktoken runs the same merges several times as fast. Other
    kinds of files, texts with a special token's string, and texts with a long run of white space, for which tiktoken's pattern needs
    more stack the longer it is, are encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        self.special = [t["content"] for t in d.get("added_tokens") or ()]
        self.fast = self._merges(d)

    def _merges(self, d: dict):
        m, pre = d["model"], d.get("pre_tokenizer") or {}
        if m["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or d.get("normalizer") or m.get("dropout") or m.get("ignore_merges"):
            return None
        alphabet = byte_alphabet()
        parts = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        order = sorted(m["vocab"][a + b] for a, b in parts)
        if [m["vocab"][a + b] for a, b in parts] != order or len(set(order)) != len(order):
            return None
        import tiktoken

        special = set(self.special)
        ranks = {bytes(alphabet[c] for c in t): i for t, i in m["vocab"].items() if t not in special}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= LONG_RUN and LONG_BLANK.search(text)):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and part and nth, the writing task and the piece's place
    among its pieces of this length. Documents longer than capacity are cut at its multiples."""
    bounded_batches(df)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def run(batches):
        bpe, nth, part = byte_bpe(tokenizer), Counter(), TaskContext.get().partitionId()
        end = array("I", [end_id]).tobytes()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = memoryview(bpe.encode(text.as_py() or "") + end)
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    size = min(capacity, n - s)
                    out.append((doc, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, part, nth[size]))
                    nth[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [()] * 7, schema)], schema=schema)

    rows = df.select(numbered(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns (((length, times), ...), packs) that hold the histogram.

    Lengths are placed longest first, each into the packs that are shortest so far; all packs of one pattern move at once, so
    the work depends on the number of lengths, not on the number of documents. Where no pack has room, new ones are
    opened and filled with as many pieces of this length as fit.
    """
    room: dict[int, Counter] = {}

    def put(space: int, pattern: tuple, packs: int) -> None:
        if packs:
            room.setdefault(space, Counter())[pattern] += packs

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            space = max((s for s in room if room[s]), default=0)
            if space < length:
                fit = capacity // length
                packs, left = divmod(n, fit)
                put(capacity - fit * length, ((length, fit),), packs)
                put(capacity - left * length, ((length, left),), int(left > 0))
                break
            pattern, packs = min(room[space].items())
            used = min(n, packs)
            room[space][pattern] -= used
            if not room[space][pattern]:
                del room[space][pattern]
            more = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(space - length, more, used)
            n -= used
    total = Counter()
    for packs in room.values():
        total.update(packs)
    return sorted(total.items(), reverse=True)


def slots(patterns: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, sequence, offset, times): the pieces of this length with ranks low..high-1 go, times to each pack, to sequences from
    sequence on, from offset on."""
    out, rank, sequence = [], Counter(), 0
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            low = rank[length]
            rank[length] += packs * times
            out.append((length, low, rank[length], sequence, offset, times))
            offset += length * times
        sequence += packs
    return out


def slot_bound(capacity: int) -> int:
    """How many slots there can be. Placing a length changes whole patterns and then splits one or adds two, so there are at most two
    patterns for each length; and the lengths of a pattern differ, so there are less than sqrt(2 * capacity) of them."""
    return 2 * capacity * math.isqrt(2 * capacity)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document's ids and end_id.

    Sequences are filled from offset 0 without gaps. Null and empty texts are the end id alone; ids may be null or repeated;
    an empty table gives no rows.

    The piece table is written, with each piece's number within its task and length; the sums of those counts over tasks make
    it a rank within its length, without bringing the pieces of a length together. The histogram has capacity rows at most and
    is all that the driver sees; the pattern slots, at most slot_bound(capacity) however many documents there are, are broadcast
    and joined by rank.
    """
    cut = written(pieces(df, id_col, text_col, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity, end_id), "pieces")
    counts = written(cut.groupBy("length", "part").count(), "piece-counts")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts_before = counts.select("length", "part", before.alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = slots(shortest_pack_first(histogram, capacity))
    assert len(places) <= slot_bound(capacity)
    table = df.sparkSession.createDataFrame(places, "slot_length long, low long, high long, sequence long, base long, times long")
    rank = F.col("before") + F.col("nth")
    placed = cut.join(counts_before, ["length", "part"]).withColumn("rank", rank)
    placed = placed.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.expr("(rank - low) div times")).alias("sequence_id"),
        (F.col("base") + nth % F.col("times") * F.col("length")).alias("offset"),
    )


def sequence_sizes(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequence_id, used, padded): a sequence is padded to capacity unless its size is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return used.withColumn("padded", F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, F.col("used")).otherwise(F.lit(capacity)))
