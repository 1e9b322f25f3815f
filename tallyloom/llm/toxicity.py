"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max
inverted index, distance-weighted votes, calibrated on the examples themselves.

Terms are a text's words and their heads of 4 to 7 letters; all that tell the two classes
apart on the examples (chi-square) make up the vectors, with the root of their share of the
text's words for frequency, and one more term stands for all the other words, so that a cue
counts for less in a longer text. Its weight is the one of OTHERS whose votes, each example
left out in turn, give the examples' labels the highest likelihood. The index holds a
bounded, documented sample of the labelled rows (EXAMPLES of each class, by a hash of
doc_id), so it can be sent to every executor; every document is scored in one pass without a
shuffle. Blocks of the index hold examples whose weightiest terms are the same; only those
whose bound reaches the kth best cosine so far are opened.

Defined cases: a null or empty text, or one without any of the terms, gets the share of
toxic documents that such examples have; a very long text is counted whole, like any other;
labels that are null, or whose document isn't there, teach nothing; a document labelled
twice is toxic if any of its labels is; of a doc_id with several texts the smallest one
teaches; equal similarities rank by doc_id; repeated rows are scored each; with no usable
examples every score is 0. An empty table gives none; other columns of the input, whatever
their names, are ignored by score and carried by without_toxic."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import held

#: Labelled rows of each class in the sample, least chi-square of a term, neighbours that vote, documents in a block of the index.
EXAMPLES, LEAST_CHI, NEIGHBOURS, BLOCK = 2000, 30.0, 15, 16
#: Weights to choose from for the term for all other words; least score of a toxic text; letters of a head; least examples of a term.
OTHERS, THRESHOLD, HEADS, LEAST_TEXTS = (0.1, 0.2, 0.4, 0.8), 0.3, (4, 5, 6, 7), 4
_LETTERS = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text falls in the part that teaches nothing; null ids don't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in HEADS if len(word) > n)]


def beginnings(vocabulary: dict[str, int]) -> frozenset[str]:
    """First letters of all terms: a word that begins otherwise has none of them."""
    return frozenset(t[: HEADS[0]].rstrip("*") for t in vocabulary)


def counted(text: str | None, vocabulary: dict[str, int] | None = None, begin: frozenset[str] = frozenset()) -> dict:
    """How often each term occurs in a whole text: all terms, or those of a vocabulary by
    number, and then all words under -1 if there is any of them."""
    words = _LETTERS((text or "").lower())
    out: dict = {}
    if vocabulary is None:
        for word, n in Counter(words).items():
            for t in terms_of(word):
                out[t] = out.get(t, 0) + n
        return out
    known = [(w, ts) for w in set(words) if w[: HEADS[0]] in begin and (ts := [vocabulary[t] for t in terms_of(w) if t in vocabulary])]
    if known:
        often = Counter(words)
        for w, ts in known:
            for t in ts:
                out[t] = out.get(t, 0) + often[w]
        out[-1] = len(words)
    return out


@dataclass
class Index:
    """Examples dealt into blocks. For each term: the examples that have it with their
    weights, where those of each block begin, and the largest weight in each block."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    share: float  # of toxic documents among the labelled ones
    postings: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    begins: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    tops: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bare: float = 0.0  # score of a text without terms
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    opened: int = 0  # blocks so far

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of length 1; the last term is the one for other words."""
        t = np.array([*sorted(i for i in counts if i >= 0), len(self.vocabulary)], np.int64)
        w = np.sqrt([counts[i] / counts[-1] for i in t[:-1].tolist()] + [1.0]) * self.idf[t]
        return t, w / math.sqrt(float((w * w).sum()))

    def add(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        sizes = [len(t) for t, _ in vectors]
        owner = np.repeat(np.arange(len(vectors)), sizes)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        order = np.lexsort((owner, term))
        self.postings, self.weights = owner[order], np.concatenate([np.zeros(0), *(w for _, w in vectors)])[order]
        blocks = -(-len(vectors) // BLOCK)
        cell = term[order] * (blocks + 1) + self.postings // BLOCK
        self.begins = np.searchsorted(cell, np.arange(len(self.idf) * (blocks + 1))).reshape(len(self.idf), blocks + 1)
        self.tops = np.zeros((len(self.idf), blocks))
        np.maximum.at(self.tops, (term[order], self.postings // BLOCK), self.weights)

    def _cosines(self, t: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of all examples of some blocks, from those blocks' postings alone."""
        begin, end = self.begins[t][:, blocks].ravel(), self.begins[t][:, blocks + 1].ravel()
        n = end - begin
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        slot = np.repeat(np.tile(np.arange(len(blocks)), len(t)), n) * BLOCK + self.postings[at] % BLOCK
        return np.bincount(slot, self.weights[at] * np.repeat(np.repeat(w, len(blocks)), n), len(blocks) * BLOCK)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties to the smaller doc_id, exactly:
        blocks are opened from the highest bound down, until none can hold a better one."""
        if not len(t):
            return []
        bounds = w @ self.tops[t]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        at, group = 0, 4
        while at < len(order) and not (len(best) >= k and bounds[order[at]] < scores[k - 1] - 1e-9):
            blocks = order[at : at + group]
            cosines = self._cosines(t, w, blocks)
            rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            there = (cosines > 0) & (rows != but)
            best, scores = np.concatenate([best, rows[there]]), np.concatenate([scores, np.round(cosines[there], 12)])
            if len(best) > k:  # no row under the kth best value can stay
                keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                best, scores = best[keep], scores[keep]
            first = np.lexsort((best, self.ids[best], -scores))[:k]
            best, scores = best[first], scores[first]
            at, group = at + group, group * 2
            self.opened += len(blocks)
        return list(zip(scores.tolist(), best.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic votes: nearer examples weigh more, and the sample's classes as in the labelled rows."""
        n1 = max(1, int(self.toxic.sum()))
        n0 = max(1, len(self.toxic) - n1)
        v = [0.0, 0.0]
        for s, i in near:
            y = int(self.toxic[i])
            v[y] += (self.share / n1 if y else (1 - self.share) / n0) / (1.05 - min(1.0, s))
        return v[1] / (v[0] + v[1]) if v[0] + v[1] else 0.0

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        if not counts or not len(self.ids):
            return self.bare, []
        near = self.nearest(*self.vector(counts))
        if not near:
            return self.bare, []
        return float(np.interp(round(self.vote(near), 9), *self.curve)), near


def _calibrated(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A nondecreasing curve from votes to shares of toxic weight (pool adjacent violators),
    each step drawn a little to the middle so that no score claims certainty. Equal votes are one step."""
    steps, back = np.unique(np.round(votes, 9), return_inverse=True)
    pools: list[list[float]] = []
    for x, y, w in zip(steps.tolist(), np.bincount(back, toxic * weight).tolist(), np.bincount(back, weight).tolist(), strict=True):
        pools.append([x, x, y, w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            a, b = pools.pop(-2), pools.pop()
            pools.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    total = weight.sum() / max(1, len(weight))
    xs, ys = [], []
    for lo, hi, y, w in pools:
        p = (y + 0.5 * total) / (w + total)
        xs += [lo, hi]
        ys += [p, p]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, examples: int = EXAMPLES) -> Index:
    """teaches: over doc_id, which labelled rows may be learned from."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(teaches).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in own.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for y in (0, 1):  # bounded: at most `examples` rows of each class reach the driver
        picked += [(r["doc_id"], y) for r in own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect()]
    share = n.get(1, 0) / max(1, sum(n.values()))
    none = Index({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), share)
    if not n.get(1) or not n.get(0):
        none.bare = float(share)
        return none
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # so at most `examples` of each class, however often a doc_id occurs

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in held(batch, "text"):
                rows = [counted(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([list(r) for r in rows], pa.list_(pa.string()))], names=["doc_id", "toxic", "terms"])

    each = texts.mapInArrow(terms, "doc_id long, toxic int, terms array<string>")
    n1, n0 = (sum(y == k for _, y in picked) for k in (1, 0))
    per = each.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    a, b, c, d = F.col("a"), F.col("b"), n1 - F.col("a"), n0 - F.col("b")
    chi = (n1 + n0) * (a * d - b * c) * (a * d - b * c) / F.nullif((a + b) * (c + d) * n1 * n0, F.lit(0.0))
    best = per.withColumn("chi", chi).filter((F.col("chi") >= LEAST_CHI) & (F.col("a") + F.col("b") >= LEAST_TEXTS)).select("term").collect()
    vocabulary = {t: i for i, t in enumerate(sorted(r["term"] for r in best))}
    begin = beginnings(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in held(batch, "text"):
                rows = [counted(t, vocabulary, begin) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))], names=["doc_id", "toxic", "t", "n"])

    rows = texts.mapInArrow(vectors, "doc_id long, toxic int, t array<int>, n array<int>").collect()
    return fitted(vocabulary, [(r["doc_id"], r["toxic"], dict(zip(r["t"], r["n"], strict=True))) for r in rows], share)


def fitted(vocabulary: dict[str, int], rows: list[tuple[int, int, dict[int, int]]], share: float) -> Index:
    """The index of examples (doc_id, label, counts) with the weight of other words that suits them best, and its calibration."""
    if not rows:
        return Index({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), share)
    toxic = np.array([r[1] for r in rows])
    # Share of documents with the term, as in the labelled rows, not in the evened-out sample.
    weight = np.where(toxic == 1, share / max(1, (toxic == 1).sum()), (1 - share) / max(1, (toxic == 0).sum()))
    frequency = np.zeros(len(vocabulary))
    for (_, _, counts), w in zip(rows, weight, strict=True):
        frequency[[i for i in counts if i >= 0]] += w
    idf = np.log(1 + 1 / np.maximum(frequency, 1e-9))
    chosen, least = None, math.inf
    for others in OTHERS:
        index = Index(vocabulary, np.append(idf, others), np.zeros(0), np.zeros(0), share)
        every = [index.vector(counts) for _, _, counts in rows]
        # Examples of the same weightiest term share blocks, so that a block's bounds are close.
        heaviest = [int(t[w.argmax()]) for t, w in every]
        order = sorted(range(len(rows)), key=lambda i: (heaviest[i], rows[i][0]))
        index.ids, index.toxic = np.array([rows[i][0] for i in order]), toxic[order]
        every, own = [every[i] for i in order], weight[order]
        index.add(every)
        some = np.array([len(t) > 1 for t, _ in every])
        bare = own[~some]
        index.bare = float((bare * index.toxic[~some]).sum() / bare.sum()) if len(bare) else 0.0
        loss = 0.0
        if some.any():
            votes = np.array([index.vote(index.nearest(t, w, but=i)) for i, (t, w) in enumerate(every) if len(t) > 1])
            index.curve = _calibrated(votes, index.toxic[some], own[some])
            p = np.clip(np.interp(np.round(votes, 9), *index.curve), 1e-9, 1 - 1e-9)
            loss = -float((own[some] * np.where(index.toxic[some] == 1, np.log(p), np.log(1 - p))).sum())
        if loss < least:
            chosen, least = index, loss
    chosen.opened = 0
    return chosen


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, predicted and evidence (nearest examples with similarity and label)."""
    begin = beginnings(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[float, str]] = {}
        for batch in batches:
            for part in held(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    counts = counted(text, index.vocabulary, begin)
                    key = tuple(sorted(counts.items()))
                    if key not in known:
                        if len(known) > 20_000:
                            known.clear()
                        p, near = index.score(counts)
                        known[key] = p, ",".join(f"{index.ids[i]}:{s:.4f}:{index.toxic[i]}" for s, i in near[:3])
                    out.append(known[key])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, evidence string").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, index: Index) -> DataFrame:
    """The rows of docs, all columns, whose score stays under the threshold."""
    begin = beginnings(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in held(batch, "text"):
                yield part.filter(pa.array([index.score(counted(t, index.vocabulary, begin))[0] < THRESHOLD for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
