"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The vocabulary and its scores come from a model file (a path; never trained
here). A text gets one leading space, spaces become the meta symbol, and the
best path of pieces by summed score is sought. Only boundaries within the
longest piece can still be reached, so the search keeps that window; when all
surviving paths meet in one boundary, every id before it is final and is
committed. A character without a piece costs the least score less ten
and is written as its bytes' pieces, also a meta symbol of the text itself, so
decoding always gives back the very text. On equal scores the longer last
piece wins.

No piece of the model reaches over the place between another character and a
space, or over a character that no piece holds, so paths always meet there and
the stream may start anew; what it gave for a part between such places is
remembered. Models without that property are searched in one stream.

Null text counts as empty; the empty text has no ids. Memory beyond the text
and its ids follows the window, however long the text is. Repeated rows are
encoded alike. Ids may be null or repeated. An empty table gives no rows.
Columns beyond ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

META, OWN = "▁", "\udfff"  # the meta symbol; what stands for one in the text itself
CHUNK = 64  # characters handed to the search at a time
CACHE = 600_000  # parts of a chunk at most that a worker remembers, at most


def trie(score: dict[str, tuple[float, int]]) -> dict:
    """By character: (the same for what follows it, score or None, id or -1)."""
    root: dict = {}
    for piece, (value, i) in sorted(score.items()):  # a prefix comes before what it begins
        at = root
        for c in piece[:-1]:
            at = at.setdefault(c, ({}, None, -1))[0]
        at[piece[-1]] = (at[piece[-1]][0] if piece[-1] in at else {}, value, i)
    return root


class Model:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {self.pieces[i]: (float(m.get_score(i)), i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - 10
        self.longest = max(map(len, self.score), default=1)
        self.raw = [b""] * n
        for p, (_, i) in self.score.items():
            self.raw[i] = p.replace(META, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        if len(self.bytes) < 256:
            raise ValueError("the model lacks byte pieces")
        self.trie = trie(self.score)
        splits = not any(META in p.lstrip(META) for p in self.score)
        newline = not any("\n" in p for p in self.score)
        self.part = re.compile(r"\n|[ ]*[^ \n]+|[ ]+" if newline else r"[ ]*[^ ]+|[ ]+") if splits else re.compile(r"(?s).+")
        self.known: dict[str, bytes] = {}

    def stream(self, chunks):
        """Yields runs of final ids for an iterable of strings, meta symbols in place.

        A boundary is left once its pieces have been tried, so all that is held
        are the boundaries since the last commit and as many characters ahead
        as the longest piece has. Where no path reaches beyond a boundary, all
        of them meet there and it is committed; where paths overlap for long,
        their back pointers are followed to the boundary in which they meet.
        """
        longest, root, score, unknown = self.longest, self.trie, self.score, self.unknown
        chunks, more = iter(chunks), True
        held, best, back = "", [0.0], [(0, 0)]  # characters since the last commit; scores and back pointers (boundary, id or -1) of their boundaries
        at = reach = 0  # the boundary whose pieces are tried next; the furthest that any path has come to
        while True:
            while more and len(held) - at < longest:
                chunk = next(chunks, None)
                if chunk is None:
                    more = False
                else:
                    held += chunk
                    best += [-np.inf] * len(chunk)
                    back += [(0, 0)] * len(chunk)
            if at and at == reach:
                yield self._path(held, back, at)
                held = held[at:]
                if not held and not more:
                    return
                best, back = [0.0] + [-np.inf] * len(held), [(0, 0)] * (len(held) + 1)
                at = reach = 0
                continue
            if at == len(held):
                return
            if at >= 2 * longest and at % longest == 0:
                alive = set(range(at, reach + 1))  # any path goes on from one of these
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last][0])
                meet = alive.pop()
                if meet:
                    yield self._path(held, back, meet)
                    held, best, at, reach = held[meet:], best[meet:], at - meet, reach - meet
                    back = [(0, 0)] + [(max(0, b - meet), i) for b, i in back[meet + 1 :]]
            so_far, n, end, below = best[at], len(held), at, root
            while end < n:
                node = below.get(held[end])
                if node is None:
                    break
                end += 1
                below, value, i = node
                if value is not None and so_far + value > best[end]:
                    best[end], back[end] = so_far + value, (at, i)
                    if end > reach:
                        reach = end
            if held[at] not in score and so_far + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = so_far + unknown, (at, -1)
                reach = max(reach, at + 1)
            at += 1

    def _path(self, chars, back, end: int) -> list[int]:
        out = []
        while end:
            start, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                c = META if chars[start] == OWN else chars[start]
                out.extend(self.bytes[b] for b in reversed(c.encode("utf-8", "surrogatepass")))
            end = start
        return out[::-1]

    def part_ids(self, part: str) -> bytes:
        """The ids of a part, by the stream; short parts are remembered."""
        line = part.replace(META, OWN).replace(" ", META)
        found = np.array([i for run in self.stream(line[k : k + CHUNK] for k in range(0, len(line), CHUNK)) for i in run], "<u4").tobytes()
        if len(part) <= CHUNK:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[part] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        known, part_ids = self.known.get, self.part_ids
        return np.frombuffer(b"".join([known(p) or part_ids(p) for p in self.part.findall(" " + text)]), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:] if len(ids) else ""


_MODELS: dict[str | None, Model] = {}


def model(path: str | None = None) -> Model:
    """The worker's model; by default the public 32k model."""
    if path not in _MODELS:
        import public_tokenizers

        _MODELS[path] = Model(path or public_tokenizers.path("piece_bpe_32k.model"))
    return _MODELS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batch):
        import pyarrow as pa

        made = [model(path).encode(t) for t in batch.column("text").to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(m) for m in made]))).astype(np.int32)
        values = np.concatenate(made).astype(np.int32) if made else np.zeros(0, np.int32)
        return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "text": [model(path).decode(i or []) for i in batch.column("ids").to_pylist()]}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and whether decoding gives the text back."""

    def run(batch):
        import pyarrow as pa

        m, texts = model(path), batch.column("text").to_pylist()
        made = [m.encode(t) for t in texts]
        counts = [len(x) for x in made]
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(made).astype(np.int32)))
        return {"doc_id": batch.column("doc_id"), "ids": ids, "n_ids": counts, "ids_crc32": [zlib.crc32(x.tobytes()) for x in made], "exact": [m.decode(x.tolist()) == (t or "") for x, t in zip(made, texts)]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, exact boolean")
