"""Packing by minimum bin slack. Documents become token ids; whole windows are cut off
the long ones, and the remaining lengths are combined so that windows fill up exactly:
a subset-sum table over bits finds the multiset of remaining lengths whose total comes
closest to the window, and walking it back gives how many of each length to take.

A window that no multiset fills takes a cut piece of one more document, so only the last
window of a shard can fall short; that one is dealt into lengths that are powers of two,
which need no padding. A shard is a run of consecutive documents of one input partition,
closed once it holds SHARD_TOKENS ids, so there is no shuffle and memory is bounded.

Defined cases: a null or empty text is the end id alone; a very long text is cut over as
many windows as it needs; of multisets that fill a window alike the one found first from the
longest length down is taken; repeated rows are packed each; rows with a null doc_id are
packed too; an empty table gives none. Other columns of the input, whatever their names, are
ignored."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import held

WINDOW, END_ID, SHARD_TOKENS = 2048, 1, 2_000_000
VOCABULARY = "byte_bpe_50k.json"

#: Characters for which the letter classes of the tokenizer's pattern and of Python's `re` agree.
PLAIN = "\t\n\x0b\x0c\r\x20-\x7e¡«»¿À-ÖØ-öø-ɏ–—‘’“”…€"
#: The pattern that splits text before the merges, for those characters; runs of letters, the most frequent, come first, as nothing else begins like them.
LETTERS, WHITE = "A-Za-zÀ-ÖØ-öø-ɏ", "\t\n\x0b\x0c\r "
PIECES = f""" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{WHITE}{LETTERS}0-9]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"""
SPECIAL = "<|endoftext|>"


class _Pieces(dict):
    """Ids of pieces, each made when it is first asked for."""

    def __init__(self, ids_of: Callable[[str], list[int]]):
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = array("I", self.ids_of(piece)).tobytes()
        return found


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. The merges of a piece between two splits
    depend on nothing else, so each distinct piece is tokenized once (within a bounded
    cache); texts with other characters go to the tokenizer whole."""

    def __init__(self, path: str | None = None, most: int = 600_000):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.split = re.compile(PIECES).findall
        self.piece = self._pieces(path, public_tokenizers)
        self.known = _Pieces(self.piece)
        self.most = most

    def _pieces(self, path, public):
        """The same merges read as ranks, by a reader that takes less than half the time for a
        piece; only for the public vocabulary that has both files. Tests hold the ids against
        the tokenizer's on any text."""
        if path:
            return lambda p: self.whole.encode(p, add_special_tokens=False).ids
        import base64

        import tiktoken

        with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text or self.odd(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        out = b"".join(map(self.known.__getitem__, self.split(text)))
        if len(self.known) > self.most:
            self.known.clear()
        return out


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """Minimum bin slack: how many of each length, of which counts[length] are there, come
    closest to room without passing it. Bit t of the table is set once some multiset
    totals t; lengths join from the longest down, as runs of 1, 2, 4, ... copies, until
    room itself is reached or none is left."""
    reach, full, steps = 1, (1 << room + 1) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, run = min(int(counts[length]), room // length), 1
        while left:
            take = min(run, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & full
            left, run = left - take, run * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def pack(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that lay items of these lengths into
    windows. Each sequence but those of the last window is exactly full."""
    out, sequence = [], 0
    counts, waiting = np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]
    for item, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            out.append((item, start, window, sequence, 0))
            sequence += 1
        if rest := n % window:
            counts[rest] += 1
            waiting[rest].append((item, n - rest))
    total = int((counts * np.arange(window + 1)).sum())
    while total >= window:
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        chosen = {top: 1}
        for length, k in fullest(counts, window - top).items():
            counts[length] -= k
            chosen[length] = chosen.get(length, 0) + k
        at = 0
        for length, k in chosen.items():
            for _ in range(k):
                item, start = waiting[length].pop()
                out.append((item, start, length, sequence, at))
                at += length
        while at < window:  # no multiset fits: one more document is cut
            length = int(np.flatnonzero(counts)[-1])
            item, start = waiting[length].pop()
            counts[length] -= 1
            take = min(length, window - at)
            out.append((item, start, take, sequence, at))
            at += take
            if take < length:
                counts[length - take] += 1
                waiting[length - take].append((item, start + take))
        total -= window
        sequence += 1
    room, at = 0, 0
    for length in np.flatnonzero(counts)[::-1].tolist():
        for item, start in waiting[length]:
            done = 0
            while done < length:
                if at == room:
                    sequence += bool(room)
                    room, at = 1 << total.bit_length() - 1, 0
                take = min(length - done, room - at)
                out.append((item, start + done, take, sequence, at))
                at, done, total = at + take, done + take, total - take
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packer(path: str | None, window: int, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        docs: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, size
            pieces = pack([len(x) // 4 for x in docs], window)
            for i in range(0, len(pieces), 1000):
                part = pieces[i : i + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[p[0]] for p in part], pa.int64()),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.int64()),
                        pa.array([docs[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in part], pa.binary()),
                        pa.array([len(docs[p[0]]) // 4 for p in part], pa.int64()),
                        pa.array([base + p[3] for p in part], pa.int64()),
                        pa.array([p[4] for p in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            base += max((p[3] for p in pieces), default=-1) + 1
            ids.clear()
            docs.clear()
            size = 0

        for batch in batches:
            for part in held(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids.append(doc_id)
                    docs.append((encode(text) if text else b"") + end)
                    size += len(docs[-1]) // 4
                    if size >= shard_tokens:
                        yield from flush()
        if docs:
            yield from flush()

    return run


def pack_sequences(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece of a document: its ids (little-endian, 32 bits each), the
    sequence it lies in and its place there. path: a tokenizer file, by default the public one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(path, window, end_id, shard_tokens), SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
