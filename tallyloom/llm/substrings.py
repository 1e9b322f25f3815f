"""Substring dedup by compaction of a De Bruijn graph of words. Every k consecutive words
of a document are an edge from the node of its first k-1 words to the node of its last
k-1. Only edges that several documents have matter. Where such edges follow each other
through nodes that don't branch they compact into one path, and paths are what documents
are compared by: a path that also stands in a document with a smaller doc_id is removed.

Documents are dealt into blocks by a hash, and three exchanges join what blocks know:

1. by an edge's first node: a block sends each distinct edge once, as a sorted run of
   NODE_BITS of the node and of its last word. The join says which edges several documents
   have, and which nodes such edges leave in several ways;
2. by the last node of the edges that several documents have: which nodes they reach in
   several ways, and at which nodes a document's run of them begins or ends;
3. by path: between all these nodes a document that has one edge has the whole path, so a
   block's documents are cut into the same paths as all others. A path's key is 128 bits of
   all its words; the join gives the smallest document that has it and the place there, its
   source. Spans are equal word by word to their source's, up to that key.

Joins answer with a bit or a number for what a block sent, in its order. So a passage that
a third of all documents share is sent once a block, whatever its copies; nothing is
collected or capped. Short keys in the first two joins can only tell too many edges or
nodes apart as shared or branching, which cuts paths shorter; a branch is missed where two
words after one node agree in all their bits, once in 16 million such pairs. The texts are
exchanged once and read by every step.

Defined cases: a null or empty text has no words; a text of fewer than k words has no edge
and stays whole; a very long text makes its block longer; a document with a null doc_id is
neither removed from nor a reason to remove; rows with the same doc_id are one document for
the order, so repeated rows don't remove from each other; of a path's places in its source
the first one counts; an empty table gives none. Other columns of the input, whatever
their names, are ignored."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordHasher, held, joined, pack_sorted, pack_uints, runs, text_bytes, unpack_sorted, unpack_uints, windows

#: Words of an edge; bytes of text in a block on average; edges in a bucket on average, at six bytes of text an edge; bits of a node, besides those of its bucket, and of a word.
K, BLOCK_BYTES, BUCKET_EDGES, NODE_BITS, WORD_BITS = 13, 6 << 20, 1 << 20, 20, 24


class _Keys:
    """What one block says of its edges or nodes: distinct keys in order, each one's bucket in the first bits."""

    def __init__(self, keys: np.ndarray, bits: int, node_bits: int):
        self.order = np.argsort(keys)
        ordered = keys[self.order]
        self.begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.distinct = ordered[self.begin]
        self.width = node_bits + WORD_BITS
        bucket = (self.distinct >> np.uint64(self.width)).astype(np.int64)
        self.parts = [(int(bucket[at]), at, to) for at, to in runs(bucket)]

    def relative(self, at: int, to: int) -> bytes:
        return pack_sorted(self.distinct[at:to] & np.uint64((1 << self.width) - 1))

    def any(self, flags: np.ndarray) -> np.ndarray:
        """For each distinct key, whether the flag of one of its occurrences is set."""
        return np.logical_or.reduceat(flags[self.order], self.begin) if len(self.begin) else np.zeros(0, bool)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The value of each occurrence's key."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, np.diff(np.append(self.begin, len(self.order))))
        return out


def _key(node: np.ndarray, word: np.ndarray | int, bits: int, node_bits: int) -> np.ndarray:
    word = word >> np.uint64(64 - WORD_BITS) if isinstance(word, np.ndarray) else np.uint64(word)
    return (node >> np.uint64(64 - bits - node_bits)) << np.uint64(WORD_BITS) | word


class _Block:
    """The documents of a block in order of doc_id, and their edges."""

    def __init__(self, table: pa.Table, k: int, bits: int, node_bits: int):
        self.k, self.bits, self.node_bits = k, bits, node_bits
        known = table.filter(pa.compute.is_valid(table["doc_id"]))
        self.docs = known.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.others = table.filter(pa.compute.is_null(table["doc_id"]))
        hasher, hashes, counts = WordHasher(lower=False), [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for batch in self.docs.combine_chunks().to_batches():
            for part in held(batch, "text"):
                h, rows = hasher(*joined(part.column("text")))
                hashes.append(h)
                counts.append(np.diff(rows))
        self.words, self.rows = np.concatenate(hashes), np.cumsum(np.concatenate(counts))
        self.ids = self.docs["doc_id"].to_numpy()
        nodes, places = windows(self.words, self.rows, k - 1)
        self.node = np.zeros(len(self.words), np.uint64)
        self.node[places] = nodes
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        n = max(0, len(row) - k + 1)
        self.at = np.flatnonzero(row[:n] == row[k - 1 :]) if n else np.zeros(0, np.int64)
        self.row = row[self.at]
        self.edges = _Keys(_key(self.node[self.at], self.words[self.at + k - 1], bits, node_bits), bits, node_bits)

    def shared_here(self) -> np.ndarray:
        """For each distinct edge, whether several documents of the block have it."""
        e = self.edges
        if not len(e.begin):
            return np.zeros(0, bool)
        own = self.ids[self.row][e.order]
        return np.minimum.reduceat(own, e.begin) != np.maximum.reduceat(own, e.begin)

    def shared(self, repeated: np.ndarray, branching: np.ndarray) -> None:
        """Runs of shared edges. repeated and branching (its first node): of each distinct edge."""
        self.repeated, self.branch = self.edges.spread(repeated), self.edges.spread(branching)
        self.goes_on = np.zeros(len(self.at), bool)  # to another shared edge
        if len(self.at) > 1:
            self.goes_on[:-1] = (np.diff(self.at) == 1) & self.repeated[1:] & self.repeated[:-1]
        after = np.zeros(len(self.at), bool)
        after[1:] = self.goes_on[:-1]
        self.starts, self.ends = self.repeated & ~after, self.repeated & ~self.goes_on
        some = self.at[self.repeated]
        self.reached = _Keys(_key(self.node[some + 1], self.words[some], self.bits, self.node_bits), self.bits, self.node_bits)

    def paths(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First edge and number of edges of each path. cut: of each distinct key in reached, whether paths end at its node."""
        ends = self.ends.copy()
        ends[np.flatnonzero(self.repeated)] |= self.reached.spread(cut)
        ends[:-1] |= self.repeated[:-1] & self.branch[1:] & (np.diff(self.at) == 1)
        last = np.flatnonzero(ends)
        after = np.zeros(len(self.at), bool)
        after[1:] = self.goes_on[:-1] & ~ends[:-1]
        first = np.flatnonzero(self.repeated & ~after)
        return first, last - first + 1


_SENT = "to int, block int, keys binary, flags binary, places binary, numbers binary"
_BINARY = ("keys", "flags", "places", "numbers")


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i, n in enumerate(("to", "block", *_BINARY))})


def _told(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table[c].to_pylist() for c in ("to", *_BINARY)), strict=True), key=lambda r: r[0])


def _bits(raw: bytes, n: int, which: int) -> np.ndarray:
    size = (n + 7) // 8
    return np.unpackbits(np.frombuffer(raw, np.uint8)[which * size : which * size + size], count=n).astype(bool)


def _answered(keys: _Keys, told: list[tuple], which: int) -> np.ndarray:
    """The bits that the buckets gave for the keys of a block, in order."""
    raw = {to: flags for to, _, flags, _, _ in told if to >= 0}
    return np.concatenate([np.zeros(0, bool), *(_bits(raw[b], to - at, which) for b, at, to in keys.parts)])


def _carried(told: list[tuple]) -> tuple:
    return next((r for r in told if r[0] < 0), (-1, None, b"", None, None))


def _settings(k: int, bits: int, node_bits: int) -> Callable[[pa.Table], _Block]:
    return lambda table: _Block(table, k, bits, node_bits)


def _edges_out(block_of: Callable) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = block_of(table)
        here = block.shared_here()
        return _rows([(b, key[0].as_py(), block.edges.relative(at, to), np.packbits(here[at:to]).tobytes(), None, None) for b, at, to in block.edges.parts])

    return run


def _gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What the blocks sent to a bucket: each one's keys, the distinct keys, how many blocks have them, and whether a block's flag of them is set."""
    own = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    flags = [_bits(raw, len(x), 0) for raw, x in zip(table["flags"].to_pylist(), own, strict=True)]
    every = np.concatenate([np.zeros(0, np.uint64), *own])
    order = np.argsort(every)
    ordered = every[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(every) else np.zeros(0, np.int64)
    some = np.logical_or.reduceat(np.concatenate(flags)[order], begin) if len(begin) else np.zeros(0, bool)
    return own, ordered[begin], np.diff(np.append(begin, len(every))), some


def _several(nodes: np.ndarray) -> np.ndarray:
    """Nodes, in order, that occur more than once in a sorted list."""
    return np.unique(nodes[1:][nodes[1:] == nodes[:-1]])


def _edges_met(key: tuple, table: pa.Table) -> pa.Table:
    """Join 1: which edges are shared, and which first nodes branch."""
    own, keys, blocks, some = _gathered(table)
    shared = (blocks > 1) | some
    nodes = keys >> np.uint64(WORD_BITS)
    branch = np.isin(nodes, _several(nodes[shared]))
    rows = []
    for block, x in zip(table["block"].to_pylist(), own, strict=True):
        at = np.searchsorted(keys, x)
        rows.append((key[0].as_py(), block, None, np.packbits(shared[at]).tobytes() + np.packbits(branch[at]).tobytes(), None, None))
    return _rows(rows)


def _nodes_out(block_of: Callable) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        block, bits = block_of(table), _told(told)
        repeated, branching = (_answered(block.edges, bits, i) for i in (0, 1))
        block.shared(repeated, branching)
        reached = block.reached
        ends = reached.any(block.ends[block.repeated])
        starts = _Keys(_key(block.node[block.at[block.starts]], 0, block.bits, block.node_bits), block.bits, block.node_bits)
        parts = {b: (at, to) for b, at, to in reached.parts}
        begins = {b: starts.relative(at, to) for b, at, to in starts.parts}
        me = key[0].as_py()
        rows = []
        for b in sorted(parts.keys() | begins.keys()):
            at, to = parts.get(b, (0, 0))
            rows.append((b, me, reached.relative(at, to), np.packbits(ends[at:to]).tobytes(), begins.get(b), None))
        # Its own answers go along, for the next step.
        rows.append((-1 - me, me, None, np.packbits(repeated).tobytes() + np.packbits(branching).tobytes(), None, None))
        return _rows(rows)

    return run


def _nodes_met(key: tuple, table: pa.Table) -> pa.Table:
    """Join 2: at which nodes paths end."""
    bucket = key[0].as_py()
    if bucket < 0:
        return table.select(["to", "block", *_BINARY])
    own, keys, _, ends = _gathered(table)
    nodes = keys >> np.uint64(WORD_BITS)
    starts = [unpack_sorted(x) >> np.uint64(WORD_BITS) for x in table["places"].to_pylist() if x]
    cut = np.isin(nodes, np.concatenate([_several(nodes), nodes[ends], *starts]))
    rows = [(bucket, block, None, np.packbits(cut[np.searchsorted(keys, x)]).tobytes(), None, None) for block, x in zip(table["block"].to_pylist(), own, strict=True) if len(x)]
    return _rows(rows)


def _paths_out(block_of: Callable, bits: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        block, rows = block_of(table), _told(told)
        n, flags = len(block.edges.distinct), _carried(rows)[2]
        block.shared(_bits(flags, n, 0), _bits(flags, n, 1))
        first, edges = block.paths(_answered(block.reached, rows, 0))
        words, lo = memoryview(block.words.tobytes()), block.at[first]
        hi = lo + edges + block.k - 1
        number: dict[bytes, int] = {}
        which = [number.setdefault(xxhash.xxh3_128_digest(words[8 * a : 8 * b]), len(number)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        me, out = key[0].as_py(), []
        which = np.array(which, np.int64)
        row, start = block.row[first], lo - block.rows[block.row[first]]
        # Documents are in order, so a path's first place is that in its smallest document.
        once = np.unique(which, return_index=True)[1] if len(which) else which
        names = np.frombuffer(b"".join(number), np.uint64).reshape(-1, 2)
        bucket = (names[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
        order = np.argsort(bucket, kind="stable")
        for at, to in runs(bucket[order]):
            some = order[at:to]
            out.append((int(bucket[some[0]]), me, names[some].tobytes(), block.ids[row[once[some]]].astype(np.int64).tobytes(), pack_uints(start[once[some]].astype(np.uint64)), pack_uints(some.astype(np.uint64))))
        out.append((-1 - me, me, pack_uints(row.astype(np.uint64)), pack_uints(start.astype(np.uint64)), pack_uints(edges.astype(np.uint64)), pack_uints(which.astype(np.uint64))))
        return _rows(out)

    return run


def _paths_met(key: tuple, table: pa.Table) -> pa.Table:
    """Join 3: of each block's paths those that a document smaller than all of the block's has, with that document and the place in it."""
    if key[0].as_py() < 0:
        return table.select(["to", "block", *_BINARY])
    names = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64).reshape(-1, 2)
    ids = np.frombuffer(b"".join(table["flags"].to_pylist()), np.int64)
    starts = np.concatenate([unpack_uints(x) for x in table["places"].to_pylist()]).astype(np.int64)
    order = np.lexsort((starts, ids, names[:, 1], names[:, 0]))
    ordered = names[order]
    begin = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    source = np.empty(len(order), np.int64)
    source[order] = order[np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))]
    rows, at = [], 0
    for block, numbers in zip(table["block"].to_pylist(), table["numbers"].to_pylist(), strict=True):
        numbers = unpack_uints(numbers)
        own = source[at : at + len(numbers)]
        earlier = ids[own] < ids[at : at + len(numbers)]
        at += len(numbers)
        if earlier.any():
            rows.append((key[0].as_py(), block, None, ids[own[earlier]].tobytes(), pack_uints(starts[own[earlier]].astype(np.uint64)), pack_uints(numbers[earlier])))
    return _rows(rows)


RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long,source:long,source_start:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))


def _spans_of(starts: list[int], ends: list[int], sources: list[int], places: list[int]) -> list[dict]:
    """Paths that follow each other here and in their source as one span."""
    out: list[dict] = []
    for a, b, d, p in zip(starts, ends, sources, places, strict=True):
        last = out[-1] if out else None
        if last and a <= last["end"] and last["source"] == d and p - last["source_start"] == a - last["start"]:
            last["end"] = b
        else:
            out.append({"start": a, "end": b, "source": d, "source_start": p})
    return out


def _remover(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "spans": []}
        docs = table.filter(pa.compute.is_valid(table["doc_id"])).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        answers = _told(told)
        carried = _carried(answers)
        row, start, edges, which = (unpack_uints(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in carried[1:])
        ids = docs["doc_id"].to_numpy() if docs.num_rows else np.zeros(0, np.int64)
        # Each path's source is its first place here, but where another block knows a smaller one.
        once = np.unique(which, return_index=True)[1] if len(which) else which
        source, place = ids[row[once]], start[once]
        for to, _, flags, places, numbers in answers:
            if to >= 0:
                at = unpack_uints(numbers).astype(np.int64)
                source[at], place[at] = np.frombuffer(flags, np.int64), unpack_uints(places).astype(np.int64)
        gone = source[which] < ids[row]
        row, start, edges, which = row[gone], start[gone], edges[gone], which[gone]
        begin = np.searchsorted(row, np.arange(docs.num_rows + 1))
        for i, (doc_id, text) in enumerate(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True)):
            words, lost, spans = (text or "").encode().split(), 0, []
            n = len(words)
            some = slice(begin[i], begin[i + 1])
            if begin[i] < begin[i + 1]:
                ends = start[some] + edges[some] + k - 1
                spans = _spans_of(start[some].tolist(), ends.tolist(), source[which[some]].tolist(), place[which[some]].tolist())
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, start[some], 1)
                np.add.at(depth, ends, -1)
                keep = np.cumsum(depth[:-1]) == 0
                words = [w for w, stays in zip(words, keep.tolist(), strict=True) if stays]
                lost = n - len(words)
            for name, value in zip(out, (doc_id, n, lost, b" ".join(words).decode(), spans), strict=True):
                out[name].append(value)
        for text in table.filter(pa.compute.is_null(table["doc_id"]))["text"].to_pylist():
            words = (text or "").encode().split()
            for name, value in zip(out, (None, len(words), 0, b" ".join(words).decode(), []), strict=True):
                out[name].append(value)
        return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["spans"], _SPANS)], names=list(out))

    return run


def remove_repeats(docs: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, bucket_edges: int = BUCKET_EDGES, node_bits: int = NODE_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and spans (of
    removed words, each with its source's doc_id and first word there) of every row. One
    job: the exchange of the texts by block serves all steps."""
    size = text_bytes(docs)
    blocks = max(1, -(-size // block_bytes))
    bits = min(20, max(0, (size // 6 // bucket_edges).bit_length()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    block_of = _settings(k, bits, node_bits)
    texts = rows.groupBy("block")
    edges = texts.applyInArrow(_edges_out(block_of), _SENT).groupBy("to").applyInArrow(_edges_met, _SENT)
    nodes = texts.cogroup(edges.groupBy("block")).applyInArrow(_nodes_out(block_of), _SENT).groupBy("to").applyInArrow(_nodes_met, _SENT)
    paths = texts.cogroup(nodes.groupBy("block")).applyInArrow(_paths_out(block_of, bits), _SENT).groupBy("to").applyInArrow(_paths_met, _SENT)
    return texts.cogroup(paths.groupBy("block")).applyInArrow(_remover(k), RESULT)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The digests from plain SQL, where doc_id is unique.
ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + {K - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM w)),
firsts AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (win), range({K}) r(k) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
left_over AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.p) AS kept, count(*) AS n FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over ON w.doc_id = left_over.doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]], k: int = K) -> list[tuple[int | None, int, int, str]]:
    """The same by the definition; for tests."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - k + 1):
                e = tuple(w[j : j + k])
                first[e] = min(first.get(e, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out
