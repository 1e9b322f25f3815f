"""Language-model scoring by prediction by partial matching over bytes.

The training documents' bytes make a trie of contexts up to ORDER symbols: for every
context, how often each symbol followed it. A symbol is coded in the longest context that
knows it; each longer context that doesn't costs an escape (half a count for each of the
context's distinct symbols, which they give up), and the symbols it does know are excluded from the shorter ones. The
symbols a context knows are all known to its suffixes too, so what exclusion takes from a
shorter context is one pair of numbers a context, and the code length of a symbol after a
full context is a value of that (context, symbol) pair alone.

Documents are dealt into blocks by a hash. A block sends each distinct pair and word once
with its count. Pairs go to buckets by the last LONG symbols of their context, so that a
bucket has the two longest orders whole, and no context brings more than 257 x 257 pairs a
block, however frequent it is. A bucket sums the counts and sends the pairs of the shorter
orders on, once for the whole corpus, to buckets of these; from them it gets what coding
after an escape costs, and returns to each block the values of the pairs and words it has.
The texts are exchanged once, for sending and for scoring. A first pass over the table
counts words and the last two symbols; only its sums, 257 x 257 at most, reach the driver.

Defined cases: a null or empty text is the end symbol alone; a very long text is a step of
its own in its block; a document with a null doc_id is trained on; without training
documents every symbol has probability 1/257; repeated rows are each trained on and scored;
an empty table gives none. Other columns of the input, whatever their names, are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordHasher, cut, drop_cut, held, joined, pack_sorted, pack_uints, runs, text_bytes, unpack_sorted, unpack_uints

#: Symbols of the longest context, and of the shortest that a bucket of pairs has whole; bytes of text in a block, for a bucket of counts, and for one of shorter contexts.
ORDER, LONG, BLOCK_BYTES, BUCKET_BYTES, SHORT_BYTES = 5, 4, 14 << 20, 16 << 20, 64 << 20
#: A byte is its own symbol; the symbol of a text's end also stands before its start.
END, SYMBOLS, BITS = 256, 257, 9
WORDS, PAIRS = 0, 1


def held_out(doc_id: Column, parts: int = 10, part: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def pairs_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every byte and every end of the rows as one integer, and where each row's begin."""
    n = len(at) - 1
    lengths = np.diff(at)
    begin = at[:-1] + np.arange(n) * (ORDER + 1)
    symbols = np.full(len(raw) + n * (ORDER + 1), END, np.int64)
    place = np.arange(len(raw)) + np.repeat((np.arange(n) + 1) * (ORDER + 1) - 1, lengths)
    symbols[place] = _LOWER[raw]
    pair = np.zeros(len(symbols) - ORDER, np.int64)
    for j in range(ORDER + 1):
        pair <<= BITS
        pair |= symbols[j : j + len(pair)]
    keep = np.ones(len(symbols), bool)
    for j in range(ORDER):
        keep[begin + j] = False
    return pair[keep[ORDER:]], np.concatenate([[0], np.cumsum(lengths + 1)])


def _parts(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        yield from held(batch, "text")


def _grouped_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return _grouped_sums(np.concatenate(keys), np.concatenate(counts))


def _values(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, all of them known; looked up in order, which stays in the cache."""
    out = np.empty(len(wanted), values.dtype)
    order = np.argsort(wanted)
    out[order] = values[np.searchsorted(keys, wanted[order])] if len(wanted) else values[:0]
    return out


def _family(pairs: np.ndarray, buckets: int, symbols: int) -> np.ndarray:
    """The bucket of a pair, by the last symbols of its context: every context of as many or more is whole there."""
    context = ((pairs >> BITS) & ((1 << symbols * BITS) - 1)).astype(np.uint64)
    return (((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_SENT = "kind int, bucket int, block int, keys binary, counts binary"


def _rows(kind: int, block: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    for at, to in runs(bucket):
        yield kind, int(bucket[at]), block, pack_sorted(keys[at:to].astype(np.uint64)), pack_uints(counts[at:to].astype(np.uint64))


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


def _sender(word_bits: int, pair_buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        hasher = WordHasher(lower=True)
        words, pairs = ([], []), ([], [])
        for part in _parts(table):
            raw, at = joined(part.column("text"))
            learn = part.column("learn").to_numpy(zero_copy_only=False)
            h, rows = hasher(raw, at)
            p, begin = pairs_of(raw, at)
            for store, values, lengths in ((words, h, np.diff(rows)), (pairs, p, np.diff(begin))):
                for s, x in zip(store, _grouped_sums(values, np.repeat(learn, lengths)), strict=True):
                    s.append(x)
        block, out = key[0].as_py(), []
        k, n = _summed(*words, np.uint64)
        out += _rows(WORDS, block, (k >> np.uint64(64 - word_bits)).astype(np.int64) if word_bits else np.zeros(len(k), np.int64), k, n)
        k, n = _summed(*pairs, np.int64)
        out += _rows(PAIRS, block, _family(k, pair_buckets, LONG), k, n)
        return _table(out, ["kind", "bucket", "block", "keys", "counts"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of counts of what was sent to one bucket."""
    return _summed([unpack_sorted(x) for x in table["keys"].to_pylist()], [unpack_uints(x) for x in table["counts"].to_pylist()], np.uint64)


def _counter(word_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of training texts: counts of the last two symbols, and words with their distinct hashes a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last = WordHasher(lower=True), np.zeros(1 << 2 * BITS, np.int64)
        words, found = 0, [np.zeros(0, np.uint64)]

        def flushed(found: list[np.ndarray], words: int) -> pa.RecordBatch:
            known = np.unique(np.concatenate(found))
            bucket = (known >> np.uint64(64 - word_bits)).astype(np.int64) if word_bits else np.zeros(len(known), np.int64)
            rows = [(-1 - int(bucket[at]), 0, pack_sorted(known[at:to])) for at, to in runs(bucket)] + [(-1, words, None)]
            return _table(rows, ["last", "n", "keys"], [pa.int64(), pa.int64(), pa.binary()]).combine_chunks().to_batches()[0]

        for batch in batches:
            for part in held(batch, "text"):
                raw, at = joined(part.column("text"))
                h, _ = hasher(raw, at)
                words += len(h)
                found.append(np.unique(h))
                pairs, _ = pairs_of(raw, at)
                last += np.bincount(pairs & ((1 << 2 * BITS) - 1), minlength=len(last))
                if sum(map(len, found)) > 1 << 21:
                    yield flushed(found, words)
                    words, found = 0, found[:1]
        yield flushed(found, words)
        rows = np.flatnonzero(last)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(last[rows]), pa.nulls(len(rows), pa.binary())], names=["last", "n", "keys"])

    return run


def _different(key: tuple, table: pa.Table) -> pa.Table:
    parts = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    return pa.table({"n": pa.array([len(np.unique(np.concatenate(parts)))], pa.int64())})


def statistics(rows: DataFrame, word_bits: int) -> tuple[int, int, np.ndarray]:
    """Words, different words and counts of the last two symbols of the training texts; at most 257 * 257 + 1 rows are collected."""
    counted = cut(rows.filter("learn").select("text").mapInArrow(_counter(word_bits), "last long, n long, keys binary"))
    last = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    words = 0
    for r in counted.filter("keys is null").groupBy("last").agg(F.sum("n").alias("n")).collect():
        if r["last"] < 0:
            words = r["n"]
        else:
            last[r["last"] >> BITS, r["last"] & (1 << BITS) - 1] = r["n"]
    different = counted.filter("keys is not null").groupBy("last").applyInArrow(_different, "n long").agg(F.sum("n")).first()[0]
    drop_cut(counted)
    return words, different or 0, last


class Trie:
    """Counts of contexts from some order down, of whole families. With last, orders 1 and 0
    come from the whole corpus and the trie reaches the bottom; without, it ends at order LONG."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, last: np.ndarray | None, top: int):
        pairs, counts = pairs[counts > 0].astype(np.int64), counts[counts > 0]
        self.top, self.low = top, LONG if last is None else 0
        self.keys, self.counts = [None] * (top + 1), [None] * (top + 1)
        for k in range(top, max(self.low, 2) - 1, -1):
            self.keys[k], self.counts[k] = _summed([pairs & ((1 << (k + 1) * BITS) - 1)], [counts], np.int64)
        if last is not None:
            full = np.argwhere(last > 0)
            self.keys[1], self.counts[1] = full[:, 0] << BITS | full[:, 1], last[full[:, 0], full[:, 1]]
            ends = last.sum(axis=0)
            self.keys[0], self.counts[0] = np.flatnonzero(ends), ends[ends > 0]
        # for each context: what all its symbols total, and how many they are; the same without what the next longer context knows
        none = [None] * (top + 1)
        self.contexts, self.total, self.distinct, self.rest, self.others = none[:], none[:], none[:], none[:], none[:]
        for k in range(self.low, top + 1):
            contexts, back = np.unique(self.keys[k] >> BITS, return_inverse=True)
            self.contexts[k] = contexts
            self.total[k] = np.bincount(back, self.counts[k], len(contexts)).astype(np.int64)
            self.distinct[k] = np.bincount(back, minlength=len(contexts))
            if k > self.low:
                short = k - 1
                known = self.counts[short][np.searchsorted(self.keys[short], self.keys[k] & ((1 << k * BITS) - 1))]
                up = np.searchsorted(self.contexts[short], contexts & ((1 << short * BITS) - 1))
                self.rest[short] = self.total[short][up] - np.bincount(back, known, len(contexts)).astype(np.int64)
                self.others[short] = self.distinct[short][up] - self.distinct[k]

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log10(self, pairs: np.ndarray, escaped: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of what coding each pair's symbol costs within the trie's orders; which pairs
        are not coded there, and the lowest order's context of each of those, or -1. escaped:
        each pair's longest context, if it is known, has been escaped from already."""
        out = np.zeros(len(pairs))
        left = np.arange(len(pairs))
        longer = np.full(len(pairs), -1)  # the longer context's index, if it is known
        for k in range(self.top, self.low - 1, -1):
            wanted = pairs[left] & ((1 << (k + 1) * BITS) - 1)
            here, known = self.find(self.contexts[k], wanted >> BITS)
            if escaped and k == self.top:
                longer = np.where(known, here, -1)
                continue
            total, distinct = np.zeros(len(left)), np.zeros(len(left))
            if len(self.contexts[k]):
                total, distinct = self.total[k][here].astype(float), self.distinct[k][here].astype(float)
                over = longer >= 0
                if k < self.top and over.any():
                    total[over], distinct[over] = self.rest[k][longer[over]], self.others[k][longer[over]]
            spot, hit = self.find(self.keys[k], wanted)
            if hit.any():
                out[left[hit]] += np.log10((self.counts[k][spot[hit]] - 0.5) / total[hit])
            missed = known & ~hit & (distinct > 0)
            out[left[missed]] += np.log10(0.5 * distinct[missed] / total[missed])
            longer = np.where(known, here, -1)[~hit]
            left = left[~hit]
        if self.low == 0:
            out[left] -= np.log10(max(1, SYMBOLS - len(self.keys[0])))
        return out, left, longer


_SHORT = (1 << LONG * BITS) - 1


def _asked(trie: Trie, pairs: np.ndarray) -> np.ndarray:
    """The pairs of order LONG - 1 that matter to what the trie doesn't code: theirs, and all that their known contexts hold."""
    _, left, context = trie.log10(pairs)
    escaped = np.zeros(len(trie.contexts[LONG]), bool)
    escaped[context[context >= 0]] = True
    own = trie.keys[LONG][escaped[np.searchsorted(trie.contexts[LONG], trie.keys[LONG] >> BITS)]] if len(trie.contexts[LONG]) else np.zeros(0, np.int64)
    return np.unique(np.concatenate([pairs[left] & _SHORT, own & _SHORT]))


_PASSED = "short int, bucket int, keys binary, counts binary, asked binary"


def _passer(shorts: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """What one bucket of pairs sends on: summed pairs of order LONG - 1, and those that it asks about."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = []
        if key[0].as_py() == PAIRS:
            pairs, counts = _added(table)
            pairs = pairs.astype(np.int64)
            asked = _asked(Trie(pairs, counts, None, ORDER), pairs)
            some, n = _summed([pairs[counts > 0] & _SHORT], [counts[counts > 0]], np.int64)
            to, ask = _family(some, shorts, 2), _family(asked, shorts, 2)
            for b in np.union1d(to, ask).tolist():
                rows.append((b, key[1].as_py(), pack_sorted(some[to == b].astype(np.uint64)), pack_uints(n[to == b].astype(np.uint64)), pack_sorted(asked[ask == b].astype(np.uint64))))
        return _table(rows, ["short", "bucket", "keys", "counts", "asked"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    return run


_TOLD = "kind int, bucket int, asked binary, counts binary, totals binary, distincts binary, logs binary"


def _teller(last: np.ndarray) -> Callable[[tuple, pa.Table], pa.Table]:
    """For every pair asked about: its count, its context's total and number of symbols, and what its symbol costs once that context is escaped from."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        trie, rows = Trie(*_added(table), last, LONG - 1), []
        for bucket, raw in zip(table["bucket"].to_pylist(), table["asked"].to_pylist(), strict=True):
            asked = unpack_sorted(raw).astype(np.int64)
            spot, hit = trie.find(trie.keys[LONG - 1], asked)
            here, known = trie.find(trie.contexts[LONG - 1], asked >> BITS)
            numbers = [np.where(ok, x[at] if len(x) else 0, 0).astype(np.uint64) for ok, x, at in ((hit, trie.counts[LONG - 1], spot), (known, trie.total[LONG - 1], here), (known, trie.distinct[LONG - 1], here))]
            rows.append((PAIRS, bucket, raw, *map(pack_uints, numbers), trie.log10(asked, escaped=True)[0].astype(np.float32).tobytes()))
        return _table(rows, ["kind", "bucket", "asked", "counts", "totals", "distincts", "logs"], [pa.int32(), pa.int32()] + [pa.binary()] * 5)

    return run


def _resolved(pairs: np.ndarray, counts: np.ndarray, told: pa.Table) -> np.ndarray:
    """log10 probabilities of all pairs of one bucket."""
    trie = Trie(pairs, counts, None, ORDER)
    out, left, context = trie.log10(pairs)
    if not len(left):
        return out
    column = lambda name, read: np.concatenate([read(x) for x in told[name].to_pylist()])
    asked = column("asked", unpack_sorted).astype(np.int64)
    order = np.argsort(asked, kind="stable")
    asked, n, total, distinct, logs = (x[order] for x in (asked, *(column(c, unpack_uints).astype(float) for c in ("counts", "totals", "distincts")), column("logs", lambda x: np.frombuffer(x, np.float32))))
    at = np.searchsorted(asked, pairs[left] & _SHORT)
    total, distinct, n, logs = total[at], distinct[at], n[at], logs[at].astype(float)
    # What a known context of order LONG holds is taken from the shorter one.
    over = context >= 0
    if over.any():
        spot, known = trie.find(asked, trie.keys[LONG] & _SHORT)
        held_counts = np.where(known, column("counts", unpack_uints).astype(float)[order][spot], 0)
        gone = np.bincount(np.searchsorted(trie.contexts[LONG], trie.keys[LONG] >> BITS), held_counts, len(trie.contexts[LONG]))
        total[over] -= gone[context[over]]
        distinct[over] -= trie.distinct[LONG][context[over]]
    hit, missed = n > 0, (n == 0) & (distinct > 0)
    out[left[hit]] += np.log10((n[hit] - 0.5) / total[hit])
    out[left[missed]] += np.log10(0.5 * distinct[missed] / total[missed])
    out[left[~hit]] += logs[~hit]
    return out


_ANSWER = "kind int, block int, keys binary, values binary"


def _resolve(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
    """The values of what each block sent to one bucket: counts of words, log10 probabilities of pairs."""
    rows = []
    if table.num_rows:
        kind = table["kind"][0].as_py()
        keys, counts = _added(table)
        values = counts if kind == WORDS else _resolved(keys.astype(np.int64), counts, told).astype(np.float32)
        for block, raw in zip(table["block"].to_pylist(), table["keys"].to_pylist(), strict=True):
            own = values[np.searchsorted(keys, unpack_sorted(raw))]
            rows.append((kind, block, raw, pack_uints(own) if kind == WORDS else own.tobytes()))
    return _table(rows, ["kind", "block", "keys", "values"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def _scorer(ends: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def lookup(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [(k, v) for t, k, v in zip(answers["kind"].to_pylist(), answers["keys"].to_pylist(), answers["values"].to_pylist(), strict=True) if t == kind]
        keys = np.concatenate([unpack_sorted(k) for k, _ in rows] or [np.zeros(0, np.uint64)])
        values = np.concatenate([unpack_uints(v).astype(float) if kind == WORDS else np.frombuffer(v, np.float32).astype(float) for _, v in rows] or [np.zeros(0)])
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def sums(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[rows[1:]] - total[rows[:-1]]

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        hasher, out = WordHasher(lower=True), []
        words, counts = lookup(answers, WORDS)
        pairs, chances = lookup(answers, PAIRS)
        for part in _parts(docs) if docs.num_rows else ():
            raw, at = joined(part.column("text"))
            h, rows = hasher(raw, at)
            n = _values(words, counts, h)
            p, begin = pairs_of(raw, at)
            out.append(
                pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": pa.compute.invert(part.column("learn")),
                        "n_tokens": pa.array(np.diff(rows) + 1, pa.int64()),
                        "n_known": pa.array(sums(n > 0, rows).astype(np.int64) + int(ends > 0), pa.int64()),
                        "raw_score": pa.array(sums(np.log10(n + 0.1), rows) + np.log10(ends + 0.1), pa.float64()),
                        "score": pa.array(sums(_values(pairs, chances, p.astype(np.uint64)), begin), pa.float64()),
                    }
                )
            )
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("raw_score", pa.float64()), ("score", pa.float64())])
        return pa.Table.from_batches([b.cast(schema) for b in out], schema)

    return run


def score(docs: DataFrame, learn: Column, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, short_bytes: int = SHORT_BYTES) -> DataFrame:
    """learn: over doc_id, which documents are trained on; the others are held out. doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (words alone) and score (log10
    probability of the text's bytes, A-Z in lower case, and its end)."""
    size = text_bytes(docs)
    blocks, buckets, shorts = (max(1, -(-size // x)) for x in (block_bytes, bucket_bytes, short_bytes))
    word_bits = (buckets - 1).bit_length()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learn.alias("learn"))
    ends = rows.filter("learn").count()
    words, different, last = statistics(rows, word_bits)
    tokens, vocabulary = words + ends, different + int(ends > 0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    # One job: the texts are exchanged once, for sending and for scoring, and what was sent once, for passing on and for resolving.
    sent = rows.groupBy("block").applyInArrow(_sender(word_bits, buckets), _SENT)
    passed = sent.groupBy("kind", "bucket").applyInArrow(_passer(shorts), _PASSED)
    told = passed.groupBy("short").applyInArrow(_teller(last), _TOLD)
    answers = sent.groupBy("kind", "bucket").cogroup(told.groupBy("kind", "bucket")).applyInArrow(_resolve, _ANSWER)
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(ends), "doc_id long, held_out boolean, n_tokens long, n_known long, raw_score double, score double")
    per = float(np.log10(tokens + 0.1 * (vocabulary + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("raw_score") - F.col("n_tokens") * F.lit(per)).alias("base_score"), "score")


def brute_force(train: list[bytes], text: bytes) -> float:
    """log10 probability of one text with plain dictionaries; for tests."""
    import math

    def symbols(t: bytes) -> list[int]:
        return [END] * ORDER + list(t.lower()) + [END]

    seen: dict[tuple, dict[int, int]] = {}
    for t in train:
        s = symbols(t)
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                follow = seen.setdefault(tuple(s[i - k : i]), {})
                follow[s[i]] = follow.get(s[i], 0) + 1
    s, out = symbols(text), 0.0
    for i in range(ORDER, len(s)):
        gone: set[int] = set()
        for k in range(ORDER, -1, -1):
            follow = {x: n for x, n in seen.get(tuple(s[i - k : i]), {}).items() if x not in gone}
            if not follow:
                continue
            total = sum(follow.values())
            if s[i] in follow:
                out += math.log10((follow[s[i]] - 0.5) / total)
                break
            out += math.log10(0.5 * len(follow) / total)
            gone |= set(follow)
        else:
            out -= math.log10(max(1, SYMBOLS - len(seen.get((), {}))))
    return out
