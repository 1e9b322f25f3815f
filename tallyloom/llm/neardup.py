"""Near-duplicate detection by a chosen-path set similarity join.

Every document becomes the set of its distinct 5-word shingles; documents with equal sets
are one class from then on. In each of TREES independent trees the classes branch: a node
deals its members out by the minwise token at a position that the node's own path picks
(and, one time in 1/LEAST - 1, by a second position as well), so that two similar sets
keep walking together.

Components are all that is asked for, so only members of different components have to
meet. A node whose members are all of one component ends; a node with few pairs of members
of different components (as many as LEAF members make) is compared exhaustively; any other
branches again. The comparison is on all minwise tokens first, and on the full sets for the
members whose tokens agree with those of another component's member nearly as often as the
threshold asks. A leaf returns what its links connect as stars, so that thousands of copies
cost rows in proportion to their number. Components come from the links by alternating
large-star and small-star steps, all in DataFrames.

Trees run in two batches. The large nodes of the first batch's first level are dealt at
random into chunks, each compared exhaustively together with some members of the node that
are in all of its chunks (hubs). Where most pairs of a large group are links, this makes it
one component at the cost of its members, and its nodes end at once in every later level;
where most aren't, branching parts the group by more than a node's second position adds to
it. So rows follow the number of members either way, not the size of groups.

Expected recall of a link at similarity s in a node path of d steps is 1 - (1 - s^d)^TREES
at least: over 0.99999 at s = 0.85 for the usual d = 1 and 2, less about one link in
100,000 that the comparison of tokens misses in a tree.

A node that is still large after DEPTH steps is compared exhaustively in blocks: its
members are dealt into parts, and every two parts meet in a task of their own.

Defined cases: a null text or one without words has an empty set, size 0, and is linked
with nothing; fewer than 5 words are one shingle; a very long text is one step of its own,
and its set goes whole into the comparison; repeated rows and equal texts are one class; a
null doc_id never names a component, and a component of nothing else has a null id; ties go
to the smaller id; an empty table gives none. Other columns of the input, whatever their
names, are ignored by near_duplicates and carried by kept_documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordHasher, cut, drop_cut, free_shuffles, held, joined, mix, pack_sorted, runs, unpack_sorted, windows

#: Words a shingle; least similarity in hundredths; minwise tokens a set; independent trees, in batches; members of a leaf; steps after which a node branches no more; members of a node that are in all of its chunks.
SHINGLE, LEAST, TOKENS, TREES, BATCHES, LEAF, DEPTH, HUBS = 5, 85, 96, 16, (4, 12), 768, 40, 32
#: Leaves where one component has nearly all members may hold so many times LEAF.
WIDE = 4


def _sets(part: pa.RecordBatch, hasher: WordHasher, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, rows = hasher(*joined(part.column("text")))
    shingles, at = windows(h, rows, k)
    begin = np.searchsorted(at, rows)
    out = []
    for i in range(part.num_rows):
        n = rows[i + 1] - rows[i]
        if n >= k:
            out.append(np.unique(shingles[begin[i] : begin[i + 1]]))
        elif n:
            one = np.uint64(n)
            for x in h[rows[i] : rows[i + 1]]:
                one = np.uint64((int(one) * 0xD6E8FEB86659FD93 + int(x)) & (1 << 64) - 1)
            out.append(mix(np.array([one])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signer(k: int, tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    factors = np.random.default_rng(11).integers(1, 1 << 63, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for part in held(batch, "text"):
                sizes, keys, signed = [], [], []
                for x in _sets(part, hasher, k):
                    sizes.append(len(x))
                    keys.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    if len(x):
                        # The product's upper half orders the set anew for each factor; its least value names the token.
                        least = np.full(tokens, np.iinfo(np.uint64).max)
                        for lo in range(0, len(x), 1 << 16):
                            some = x[lo : lo + (1 << 16), None]
                            for at in range(0, tokens, 16):
                                np.minimum(least[at : at + 16], (some * factors[None, at : at + 16]).min(axis=0), out=least[at : at + 16])
                        signed.append((mix(least) >> np.uint64(32)).astype(np.uint32).tobytes())
                    else:
                        signed.append(None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())], names=["doc_id", "mark", "n", "key", "tokens"])

    return run


def _token(position: Column) -> Column:
    """The 32-bit minwise token at a position, as hexadecimal text."""
    return F.hex(F.substring(F.col("tokens"), position.cast("int") * 4 + 1, F.lit(4)))


def _step(nodes: DataFrame, least: int, tokens: int) -> DataFrame:
    """One step down: path, key, root, tokens. All members of a node take the same positions."""
    first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(tokens))
    second = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(tokens))
    more = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(least)) < 100 - least
    to = F.array(F.xxhash64("path", F.lit(1), _token(first)), F.xxhash64("path", F.lit(2), _token(second)))
    return nodes.select("key", "root", "tokens", F.explode(F.when(more, to).otherwise(F.slice(to, 1, 1))).alias("path"))


def _planted(classes: DataFrame, trees: range, least: int, tokens: int) -> DataFrame:
    """path, key and root of all classes (key, root, tokens) one step below the roots of the trees. Most nodes have a member or a few, so their rows go without tokens."""
    roots = F.explode(F.array(*[F.xxhash64(F.lit(t), F.lit(7)) for t in trees])).alias("path")
    return cut(_step(classes.select("key", "root", "tokens", roots), least, tokens).select("path", "key", "root"))


def _gathered(live: DataFrame, leaf: int) -> DataFrame:
    """live with members and small of its node, less the nodes of a single component. Sums by
    node and component go first, so a large node is a row a component in the second sum."""
    per = live.groupBy("path", "root").agg(F.count(F.lit(1)).cast("double").alias("m"))
    nodes = per.groupBy("path").agg(F.sum("m").alias("members"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    few = (F.col("members") * F.col("members") - F.col("same") <= leaf * leaf) & (F.col("members") <= WIDE * leaf)
    # Written first: a join of two plain exchanges is one that adaptive execution can split at a large node.
    nodes = cut(nodes.select("path", F.col("members").cast("long").alias("members"), few.alias("small")))
    out = cut(live.join(nodes, "path"))
    drop_cut(nodes)
    return out


def _chunks(large: DataFrame, leaf: int, hubs: int) -> DataFrame:
    """path, key and root: the members of large nodes (with their number) dealt at random into chunks of about half a leaf, and about so many of each node's members in all of its chunks."""
    parts = F.ceil(F.col("members") * 2 / leaf).cast("long")
    own = F.array(F.pmod(F.xxhash64("path", "key", F.lit(5)), parts))
    hub = F.pmod(F.xxhash64("path", "key", F.lit(6)), F.col("members")) < hubs
    part = F.explode(F.when(hub, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(own))
    return large.select("path", "key", "root", part.alias("part")).select(F.xxhash64("path", "part", F.lit(8)).alias("path"), "key", "root")


def _blocks(large: DataFrame, leaf: int) -> DataFrame:
    """path, key and root: the members of large nodes, dealt into parts of about half a leaf; every two parts of a node are a leaf."""
    parts = F.ceil(F.col("members") * 2 / leaf).cast("long")
    own = F.pmod(F.xxhash64("path", "key", F.lit(9)), parts)
    rows = large.select("path", "key", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    return rows.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"), F.lit(10)).alias("path"), "key", "root")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _walked(live: DataFrame, classes: DataFrame, leaf: int, least: int, tokens: int, depth: int) -> list[DataFrame]:
    """path, key and root of all leaves below the nodes of live (path, key, root)."""
    leaves, done, before = [], 1, live
    while True:
        inside = _gathered(live, leaf)
        drop_cut(before)
        leaves.append(inside.filter("small").select("path", "key", "root"))
        large = inside.filter("not small")
        if large.isEmpty():
            return leaves
        if done >= depth:
            return [*leaves, _blocks(large, leaf)]
        steps = 1 if done < 4 else 2
        rows = large.select("path", "key", "root").join(classes.select("key", "tokens"), "key")
        for _ in range(steps):
            rows = _step(rows, least, tokens)
        live = before = cut(rows.select("path", "key", "root"))
        done += steps


def links_in(keys: list[bytes], sets: list[np.ndarray], least: int) -> list[tuple[bytes, bytes]]:
    """Exhaustive comparison of a leaf on its full sets. What the links connect comes back as
    stars: each member with the smallest key that it reaches."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    every, back = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(back, kind="stable")
    token, owner = back[order], owner[order]
    first = np.flatnonzero(np.diff(token, prepend=-1))
    spread = np.diff([*first, len(token)])
    shared = np.zeros((n, n), np.int32)
    wide = np.repeat(spread > 1, spread)
    # tokens that several members have, as columns of a 0/1 matrix, some thousands at a time
    token, owner = token[wide], owner[wide]
    if len(token):
        _, column = np.unique(token, return_inverse=True)
        for at in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((n, min(4096, int(column[-1]) + 1 - at)), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            shared += (part @ part.T).astype(np.int32)
    alike = 100 * shared.astype(np.int64) >= least * (sizes[:, None] + sizes[None, :] - shared)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        x, y = find(int(a)), find(int(b))
        root[max(x, y)] = min(x, y)
    return [(keys[find(i)], keys[i]) for i in range(n) if find(i) != i]


def _agreement(some: np.ndarray, every: np.ndarray) -> np.ndarray:
    """How many tokens each of some rows has in common with each of many, position by position."""
    out = np.zeros((len(some), len(every)), np.int16)
    for a, b in zip(some.T, np.ascontiguousarray(every.T), strict=True):
        out += a[:, None] == b[None]
    return out


def _agreeing(least: int, tokens: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Members of leaves whose tokens agree with those of a member of another component as
    often as similar sets' do, less 4.5 standard deviations."""
    enough = tokens * least / 100 - 4.5 * (tokens * least / 100 * (1 - least / 100)) ** 0.5

    def run(key: tuple, table: pa.Table) -> pa.Table:
        paths = table["path"].to_numpy()
        signs = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32).reshape(-1, tokens)
        roots = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1] if table.num_rows else np.zeros(0, np.int64)
        keep = np.zeros(table.num_rows, bool)
        order = np.argsort(paths, kind="stable")
        for lo, hi in runs(paths[order]):
            rows = order[lo:hi]
            # The members of the most frequent component needn't look at each other.
            own, often = np.unique(roots[rows], return_counts=True)
            lookers = rows[roots[rows] != own[often.argmax()]]
            for at in range(0, len(lookers), 64):  # some rows against all at a time
                some = lookers[at : at + 64]
                agree = (signs[some][:, None] == signs[rows][None]).sum(axis=2) if len(rows) <= 64 else _agreement(signs[some], signs[rows])
                match = (agree >= enough) & (roots[some][:, None] != roots[rows][None])
                keep[some] |= match.any(axis=1)
                keep[rows] |= match.any(axis=0)
        return table.select(["path", "key"]).filter(pa.array(keep))

    return run


def _promising(leaves: DataFrame, classes: DataFrame, least: int, tokens: int, rows: int = 8000) -> DataFrame:
    """leaves: path, key and root. path and key of the members that are worth comparing on
    their sets, which are far larger than their tokens."""
    groups = max(1, -(-leaves.count() // rows))
    dealt = leaves.join(classes.select("key", "tokens"), "key").withColumn("group", F.pmod(F.xxhash64("path"), F.lit(groups)))
    return cut(dealt.groupBy("group").applyInArrow(_agreeing(least, tokens), "path long, key binary"))


def _comparer(least: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaves: dict[int, dict[bytes, int]] = {}
        for i, (path, own) in enumerate(zip(table["path"].to_pylist(), table["key"].to_pylist(), strict=True)):
            leaves.setdefault(path, {})[own] = i
        column, found = table["shingles"], []
        for members in leaves.values():
            if len(members) > 1:
                keys = sorted(members)
                found += links_in(keys, [unpack_sorted(column[members[k]].as_py()) for k in keys], least)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return run


def _linked(leaves: DataFrame, classes: DataFrame, docs: DataFrame, signed: DataFrame, k: int, least: int, tokens: int, rows: int = 2000) -> DataFrame:
    """Links between members of the leaves, as stars; some leaves make up one task's group, of about so many rows."""
    some = _promising(leaves, classes, least, tokens)
    groups = max(1, -(-some.count() // rows))
    wanted = cut(some.select("key").distinct())
    sets = cut(_shingles(docs, signed, wanted, k))
    free_shuffles(docs.sparkSession)
    both = some.join(sets, "key").withColumn("group", F.pmod(F.xxhash64("path"), F.lit(groups)))
    links = cut(both.groupBy("group").applyInArrow(_comparer(least), "a binary, b binary"))
    for done in (some, wanted, sets):
        drop_cut(done)
    free_shuffles(docs.sparkSession)
    return links


def _shingles(docs: DataFrame, signed: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key and shingles (48 bits of each hash, sorted and packed) of the classes in wanted, from one document each."""
    picked = signed.filter("key is not null").select("key", "doc_id").join(wanted, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = rows.join(picked.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    if not picked.filter("doc_id is null").isEmpty():  # a class that only rows without an id have
        some = some.unionByName(rows.filter("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for part in held(batch, "text"):
                found = [x for x in _sets(part, hasher, k) if len(x)]
                keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([pack_sorted(x >> np.uint64(16)) for x in found], pa.binary())], names=["key", "shingles"])

    return some.mapInArrow(run, "key binary, shingles binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """key -> root (the smallest key of its component), for every key but the roots, by
    alternating large-star and small-star steps until no link changes. known: what an
    earlier call returned, to go on from."""
    if known is not None:
        links = links.unionByName(known.select(F.col("key").alias("a"), F.col("root").alias("b")))
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour hangs on the smallest one around
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # every node and its smaller neighbours hang on the smallest of those
        each = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        after = cut(large.join(least, "u").select(each).select("e.*").filter("u != v").distinct())
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(edges)
        if before is not None and tuple(mark) == before:
            return after.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before, edges = tuple(mark), after


def labelled(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, trees: int = TREES, batches: tuple[int, ...] = BATCHES, leaf: int = LEAF, tokens: int = TOKENS, depth: int = DEPTH, hubs: int = HUBS) -> DataFrame:
    """doc_id, mark (a hash of the text), n (shingles), key (of its class) and root (the key
    that names its component; both null without words) of every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    signed = cut(rows.mapInArrow(_signer(k, tokens), "doc_id long, mark long, n long, key binary, tokens binary"))
    classes = cut(signed.filter("key is not null").groupBy("key").agg(F.first("tokens").alias("tokens")))
    early = max(1, round(batches[0] * trees / sum(batches)))
    live = _planted(classes.withColumn("root", F.col("key")), range(early), least, tokens)
    inside = _gathered(live, leaf)
    drop_cut(live)
    leaves = inside.filter("small").select("path", "key", "root").unionByName(_chunks(inside.filter("not small"), leaf, hubs))
    links = _linked(leaves, classes, docs, signed, k, least, tokens)
    found = components(links)
    drop_cut(links)
    # From here on nodes of one component end.
    rooted = cut(classes.join(found, "key", "left").select("key", "tokens", F.coalesce("root", "key").alias("root")))
    drop_cut(classes)
    live = inside.filter("not small").select("path", "key").join(rooted.select("key", "root"), "key").select("path", "key", "root")
    planted = _planted(rooted, range(early, trees), least, tokens) if trees > early else None
    live = cut(live.unionByName(planted) if planted is not None else live)
    for done in (inside, *([planted] if planted is not None else [])):
        drop_cut(done)
    leaves = _walked(live, rooted, leaf, least, tokens, depth)
    links = _linked(_union(leaves), rooted, docs, signed, k, least, tokens)
    drop_cut(rooted)
    found = components(links, found)
    drop_cut(links)
    free_shuffles(spark)
    return signed.select("doc_id", "mark", "n", "key").join(found, "key", "left").select("doc_id", "mark", "n", "key", F.coalesce("root", "key").alias("root"))


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_shingles, class_key and component_id of every row."""
    rows = cut(labelled(docs, **settings))
    # Rows without words have no root: each is a component of its own.
    # Written first, so that adaptive execution can split the join at a component of many rows.
    ids = cut(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component")))
    out = rows.join(ids, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def kept_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component: the one with
    the smallest doc_id (null last), and of those the one whose text has the smallest hash;
    of rows with equal doc_id and text one stays. Rows without words stay all."""
    rows = cut(labelled(docs, **settings).filter("root is not null").groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = cut(rows.groupBy("root").agg(F.min(order).alias("first")))
    judged = rows.join(first, "root").withColumn("stays", order == F.col("first"))
    # The rest: rows that go, and rows of which one copy stays.
    some = judged.filter("not stays or copies > 1").groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "mark").agg(F.max("stays").alias("stays"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").cast("long").isNull().alias("none"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.struct(*[F.col(c) for c in docs.columns]).alias("own"))
    marked = own.join(some, ["id", "none", "mark"], "left")
    clean = marked.filter("stays is null").select("own")
    one = marked.filter("stays").dropDuplicates(["id", "none", "mark"]).select("own")
    return clean.unionByName(one).select("own.*")


#: The query's result from plain SQL, where doc_id is unique.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM w)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {SHINGLE - 1}),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= {LEAST} * (x.size + y.size - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON w.doc_id = a
"""


def brute_force(rows: list[tuple[int | None, str | None]], k: int = SHINGLE, least: int = LEAST) -> list[tuple[int | None, int, int | None]]:
    """(doc_id, size of the set, component) by the definition; for tests."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids: dict[int, list[int]] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids.setdefault(find(i), []).append(doc_id)
    return [(doc_id, len(sets[i]), min(ids[find(i)]) if find(i) in ids and sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]
