"""Packing into sequences by shortest-pack-first over the length histogram.

Documents are tokenised, closed with the end id and cut into full pieces of
``size`` ids and a rest. A full piece is a sequence by itself and needs no
place among others. Of the rests only the histogram of lengths (less than
``size`` numbers, whatever the corpus) comes to the driver. There lengths are placed
longest first: each goes to the shortest packs that still have room, a count
at a time, so packing patterns with counts are updated instead of single
packs. Where no pack has room, new packs take as many copies as fit. Patterns
become slots (length, range of ranks) -> (sequences, offset), and pieces join
them by their rank among the pieces of their length. Ranks come from counts by
(length, salt) and a row number within these; there are ``SALTS`` salts, and
beyond that one for every ``GROUP`` rests, so a group stays about that large
even where all rests have one length.

Null text counts as empty: a piece of the end id alone. A very long text is cut
into many pieces; memory follows one text. Ids may be null or repeated; each
row is packed once, and ties in rank are settled by the row's own columns. An
empty table gives no rows. Columns beyond ``doc_id`` and ``text`` are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, durable

SIZE, END_ID, SALTS, GROUP = 2048, 1, 256, 100_000  # GROUP: rests that one rank group holds, about
SLOT = "length long, first long, last long, sequence_base long, base_offset long, copies long"


class Encoder:
    """Ids of the ``tokenizers`` file; texts in plain Latin script take a faster library with the same vocabulary."""

    def __init__(self, vocabulary: str, ranks: str):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile("[^\\x00-ſ‐-‧€]")

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(s in text for s in self.special) or self.odd.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """The worker's encoder; the files are named by path, by default those of the installed public tokenizers."""
    if (vocabulary, ranks) not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[vocabulary, ranks] = Encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return _ENCODERS[vocabulary, ranks]


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document cut into full pieces and a rest."""

    def run(batch):
        tokenise = encoder(vocabulary, ranks).ids
        out: dict[str, list] = defaultdict(list)
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(tokenise(text), END_ID).astype("<u4")
            n = len(ids)
            raw = memoryview(ids).cast("B")
            for at in range(0, n, size):
                end = min(n, at + size)
                for name, value in (("doc_id", doc), ("start", at), ("length", end - at), ("ids_crc32", zlib.crc32(raw[4 * at : 4 * end])), ("doc_tokens", n)):
                    out[name].append(value)
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, copies), ...]) of packs; shortest pack first, lengths longest first."""
    open_: dict[int, list[list]] = defaultdict(list)  # filled length -> patterns [count, parts]

    def put(fill: int, count: int, parts: tuple) -> None:
        if count:
            open_[fill].append([count, parts])

    shortest = size + 1
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while shortest <= size and not open_.get(shortest):
                shortest += 1
            if shortest + length <= size:
                pattern = open_[shortest][-1]
                take = min(left, pattern[0])
                pattern[0] -= take
                if not pattern[0]:
                    open_[shortest].pop()
                put(shortest + length, take, _grown(pattern[1], length))
                left -= take
            else:
                per = size // length
                many, rest = divmod(left, per)
                put(per * length, many, ((length, per),))
                put(rest * length, 1 if rest else 0, ((length, rest),) if rest else ())
                shortest, left = min([shortest, *([per * length] if many else []), *([rest * length] if rest else [])]), 0
    merged: dict[tuple, int] = defaultdict(int)
    for made in open_.values():
        for count, parts in made:
            merged[parts] += count
    return sorted(((c, list(p)) for p, c in merged.items()), key=lambda x: (x[1], x[0]), reverse=True)


def _grown(parts: tuple, length: int) -> tuple:
    return (*parts[:-1], (length, parts[-1][1] + 1)) if parts[-1][0] == length else (*parts, (length, 1))


def slots(made: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset, copies) for every part of every pattern."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, parts in made:
        offset = 0
        for length, copies in parts:
            first = used[length]
            used[length] += count * copies
            out.append((length, first, used[length] - 1, sequence, offset, copies))
            offset += length * copies
        sequence += count
    return out


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, ranks: str | None = None, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    every = durable(pieces(docs, size, vocabulary, ranks))
    cut = every.filter(F.col("length") < size)
    salts = max(SALTS, round(cut.count() / group))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", F.spark_partition_id()), F.lit(salts)))
    counts = durable(cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # less than ``size`` rows
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))  # at most size * salts rows
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = cut.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    made = patterns(histogram, size)
    table = spark.createDataFrame(slots(made), SLOT).withColumnRenamed("length", "slot_length")
    # The slots' number follows the histogram's ``size`` bins, never the rows.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    index = F.col("rank") - F.col("first")
    rests = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence_base") + F.floor(index / F.col("copies")).cast("long")).alias("sequence_id"),
        (F.col("base_offset") + F.pmod(index, F.col("copies")) * F.col("length")).alias("offset"),
    )
    # The checkpoint's rows keep their places, so this numbers full pieces alike in every run of a task.
    own = F.lit(sum(count for count, _ in made)) + F.monotonically_increasing_id()
    return rests.unionByName(every.filter(F.col("length") == size).withColumn("sequence_id", own).withColumn("offset", F.lit(0).cast("long")))
