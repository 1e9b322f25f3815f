"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns propose candidate spans in every text. The hashes of their values are counted
over the whole corpus, by distinct repositories (documents) and owners (sources): a value
that many owners hold is a copied example, one that stays with few owners looks like a
live credential of theirs. Counts are summed on the map side by hash and owner before any
row moves, so that a value held by a third of all rows is a few rows in the shuffle.

Defined cases: a null or empty text has no spans; a null source is an owner of its own;
repeated rows each get their spans and count as one repository; an empty table gives
none; spans that begin at the same place are in the order of the kinds, and redaction blanks
what overlapping spans cover together, under the first one's kind. Very long texts and texts
of very many spans take time in proportion to their length, times the root of the number of
spans at most. The input's other columns are carried or ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut

#: Kind, pattern, group of the value, least characters of the value. The first three are the base; a shorter match is found and then dropped.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("prefixed", r"\b(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|npm_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 26),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 27),
)
BASE = 3
#: A value that so many owners hold is a copied example.
COPIED_OWNERS = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _pieces(items: Column) -> Column:
    """An array in pieces of about the root of its size: what is appended to one by one is a piece, so steps grow by the root too."""
    step = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    cuts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), step)
    return F.transform(cuts, lambda i: F.slice(items, i, step))


def _before(sizes: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of a short array, from 0 on; one more than the array has."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, add(F.element_at(acc, -1), x)))


def _spans(text: Column, order: int) -> Column:
    """All spans of one kind: the text between matches and the matches, in turn, give the places, in code points."""
    kind, pattern, group, least = KINDS[order]
    pairs = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        # A match's value comes from the match alone: the pattern matches it again from its first character to its last.
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("size"), F.regexp_extract(m, pattern, group).alias("value"))).alias("own"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,hash:bigint>>)")

    def walked(piece: Column, at: Column) -> Column:
        return F.aggregate(
            piece,
            F.struct(at.alias("at"), empty.alias("found")),
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + p["own"]["size"]).alias("at"),
                F.when(
                    F.length(p["own"]["value"]) >= least,
                    F.array_append(
                        acc["found"],
                        F.struct(
                            (acc["at"] + p["gap"]).alias("start"), F.lit(order).alias("ord"), (acc["at"] + p["gap"] + p["own"]["size"]).alias("end"),
                            F.lit(kind).alias("kind"), F.xxhash64(p["own"]["value"]).alias("hash"),
                        ),
                    ),
                ).otherwise(acc["found"]).alias("found"),
            ),
            lambda acc: acc["found"],
        )

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + p["gap"] + p["own"]["size"]))
        return _let(_before(sizes, lambda at, n: at + n), lambda starts: F.flatten(F.transform(pieces, lambda c, i: walked(c, starts[i]))))

    matched = F.filter(pairs, lambda p: p["own"].isNotNull())
    return F.when(text.rlike(pattern), _let(matched, lambda m: _let(_pieces(m), placed))).otherwise(empty)


def candidates(text: Column) -> Column:
    """Array of all spans of a text by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in range(len(KINDS))]))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """hash -> owners and repositories, from rows with repo, owner and spans."""
    each = found.select("repo", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    # Repeated rows of a repository are one; a repository has one owner but where its rows disagree.
    held = each.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def judged(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """row -> spans with owners, repos and verdict, for the rows with spans. The join is by
    hash against one row a hash; adaptive execution splits a hash that many rows hold."""
    counts = cut(ownership(found))
    each = found.select("row", F.explode("spans").alias("span")).select("row", "span", F.col("span.hash").alias("hash"))
    verdict = F.when(F.col("owners") >= copied_owners, F.lit("copied")).otherwise(F.lit("live"))
    fields = [F.col(f"span.{c}").alias(c) for c in ("start", "ord", "end", "kind", "hash")]
    return each.join(counts, "hash").select("row", F.struct(*fields, "owners", "repos", verdict.alias("verdict")).alias("span")).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def scan(docs: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """doc_id and spans (start, ord, end, kind, hash, owners, repos, verdict) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("repo"), F.col("source").cast("string").alias("owner"), candidates(text).alias("spans")))
    some = found.filter(F.size("spans") > 0)
    verdicts = judged(some, copied_owners)
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,hash:bigint,owners:bigint,repos:bigint,verdict:string>>)")
    clean = found.filter(F.size("spans") == 0).select(F.col("repo").alias("doc_id"), none.alias("spans"))
    return clean.unionByName(some.select("row", F.col("repo").alias("doc_id")).join(verdicts, "row").select("doc_id", "spans"))


def digests(scanned: DataFrame) -> DataFrame:
    def count(order: int, name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == order)).cast("long").alias(name)

    def verdicts(which: str) -> Column:
        return F.size(F.array_distinct(F.transform(F.filter("spans", lambda s: s["verdict"] == which), lambda s: s["hash"]))).cast("long").alias(f"n_{which}")

    return scanned.select(
        "doc_id", count(0, "n_assign"), count(1, "n_access"), count(2, "n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["ord"] < BASE)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), verdicts("live"), verdicts("copied"),
    )


def _blanked(text: Column, spans: Column) -> Column:
    """text with each span, or what several that overlap cover, replaced by its kind in angle brackets. spans: by start, one at least."""

    def part(piece: Column, first: Column, last: Column) -> Column:
        """The text between two places with the spans of a piece replaced, read from a copy of that text alone."""

        def replaced(own: Column) -> Column:
            return F.aggregate(
                piece,
                F.struct(first.alias("at"), F.lit("").alias("out")),
                lambda acc, s: F.struct(
                    F.greatest(acc["at"], s["end"]).alias("at"),
                    F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(own, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"),
                ),
                lambda acc: acc["out"],
            )

        return _let(F.substring(text, first + 1, last - first), replaced)

    def joined(pieces: Column) -> Column:
        ends = F.transform(pieces, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        return _let(
            _before(ends, lambda at, end: F.greatest(at, end)),
            lambda at: F.concat(F.array_join(F.transform(pieces, lambda c, i: part(c, at[i], at[i + 1])), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text))),
        )

    return _let(_pieces(spans), joined)


def redacted(docs: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """docs with every live-looking span replaced by its kind in angle brackets; copied
    examples stay. Only rows with a candidate are shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    any_ = F.lit(False)
    for _, pattern, _, _ in KINDS:
        any_ = any_ | text.rlike(pattern)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")
    found = cut(docs.filter(any_).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("repo"), F.col("source").cast("string").alias("owner"), candidates(text).alias("spans"), own))
    both = found.select("row", "own").join(judged(found, copied_owners), "row", "left")
    live = F.filter(F.coalesce(F.col("spans"), F.array()), lambda s: s["verdict"] == "live")
    whole = F.col("own.text")
    cleaned = F.when(F.size(live) > 0, _let(live, lambda s: _blanked(whole, s))).otherwise(whole)
    changed = both.select(*[(cleaned if c == "text" else F.col("own")[c]).alias(c) for c in docs.columns])
    return docs.filter(~any_).unionByName(changed)
