"""The parts of the corpus operators that need no Spark, against definitions."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import html, media, mixing, neardup, packing, scoring, search, substrings, toxicity
from tallyloom.llm.common import WordHasher, pack_sorted, pack_uints, runs, unpack_sorted, unpack_uints, windows

texts = st.lists(st.text(alphabet="ab A\t\n\x0b é日 \xa0", max_size=30), max_size=8)


def hashed(rows, lower=False):
    raw = [t.encode() for t in rows]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return WordHasher(lower)(np.frombuffer(b"".join(raw), np.uint8), at)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_word_hashes_follow_the_words(rows):
    h, at = hashed(rows)
    words = [t.encode().split() for t in rows]
    assert np.diff(at).tolist() == [len(w) for w in words]
    known = {}
    for x, w in zip(h.tolist(), [w for ws in words for w in ws], strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 4))
def test_windows_stay_in_their_row(rows, k):
    h, at = hashed(rows, lower=True)
    found, first = windows(h, at, k)
    want = [tuple(w[j : j + k]) for w in (t.encode().lower().split() for t in rows) for j in range(len(w) - k + 1)]
    assert len(found) == len(want) == len(first)
    assert len(set(found.tolist())) == len(set(want))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_integers_come_back(xs):
    assert unpack_uints(pack_uints(np.array(xs, np.uint64))).tolist() == xs
    assert unpack_sorted(pack_sorted(np.array(sorted(xs), np.uint64))).tolist() == sorted(xs)


def test_runs():
    assert runs(np.array([], int)) == [] and runs(np.array([3, 3, 1])) == [(0, 2), (2, 3)]


def test_png_comes_back_and_wrong_ones_are_refused():
    rng = random.Random(1)
    for n in (64, 640, 64 * 300):
        payload = bytes(rng.randrange(256) for _ in range(n))
        png = media.encode_png(payload)
        assert media.decode_png(png).tobytes() == payload
        for at in (10, len(png) // 2, len(png) - 5):
            broken = bytearray(png)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(png[:-12])


@pytest.mark.parametrize("kinds", [[0, 1, 2, 3, 4, 4, 2, 2, 1], [4] * 5, [3, 3, 0], []])
def test_every_row_filter_is_undone(kinds):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (len(kinds), 16), dtype=np.uint8)
    coded = np.zeros_like(rows)
    for y, kind in enumerate(kinds):
        for x in range(16):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            coded[y, x] = (int(rows[y, x]) - (0, a, b, (a + b) >> 1, media._paeth(a, b, c))[kind]) & 255
    assert (media.unfilter(np.array(kinds, int), coded) == rows).all()


def test_cosine_hash_is_the_transform():
    rng = np.random.default_rng(4)
    image = rng.random((32, 32))
    k, n = np.arange(8), np.arange(32)
    low = np.array([[sum(image[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in n for x in n) for v in k] for u in k]).ravel()
    low[0] = 0
    assert media.cosine_hashes(image[None])[0] == np.packbits(low > np.median(low)).tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packing_is_whole_and_full(lengths):
    pieces = packing.pack(lengths, 64)
    by_item, by_sequence = {}, {}
    for item, start, length, sequence, offset in pieces:
        by_item.setdefault(item, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for item, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by_item[item]):
            assert start == at
            at += length
        assert at == n
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64 and not at & (at - 1)  # a power of two: no padding at all


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8), st.integers(0, 40))
def test_fullest_is_the_best_subset(lengths, room):
    counts = np.bincount(lengths, minlength=64)
    chosen = packing.fullest(counts, room)
    assert all(k <= counts[n] for n, k in chosen.items())
    best = max(s for m in range(1 << len(lengths)) if (s := sum(x for i, x in enumerate(lengths) if m >> i & 1)) <= room)
    assert sum(n * k for n, k in chosen.items()) == best


def test_encoder_equals_the_tokenizer():
    encode, rng = packing.Encoder(most=50), random.Random(5)
    for t in ["", "it's we'll 12ab _x  \n\n y", "a <|endoftext|> b", "²½ ªº \x1c \xa0 日本語", *("".join(rng.choice("ab1 \t\n'sé–€_,.") for _ in range(25)) for _ in range(300))]:
        assert np.frombuffer(encode(t), "<u4").tolist() == encode.whole.encode(t, add_special_tokens=False).ids, t


ENCODER = []


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=st.characters(max_codepoint=0x250), max_size=80), st.text(alphabet=" \t\n\x0b\x1c\x85\xa0'sé1²_-a", max_size=40)))
def test_encoder_equals_the_tokenizer_on_any_text(text):
    encode = ENCODER[0] if ENCODER else ENCODER.append(packing.Encoder(most=50)) or ENCODER[0]
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids


def test_top_k_is_exact_with_ties():
    rng = np.random.default_rng(6)
    for low, high in ((-3, 4), (-200, 200), (0, 1)):
        v = rng.integers(low, high, (300, 8))
        ids = rng.permutation(1000)[:300]
        found = search.top_k(ids[:7], v[:7], ids, v, 5)
        want = []
        for i in range(7):
            s = v @ v[i]
            order = sorted((-int(x), int(j)) for x, j in zip(s, ids, strict=True) if j != ids[i])[:5]
            want += [(int(ids[i]), j, -x) for x, j in order]
        assert found == want


def test_model_probabilities():
    train = [b"abracadabra", b"Abra", b"", b"banana ba"]
    rows = [t + bytes() for t in train]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    pairs, begin = scoring.pairs_of(np.frombuffer(b"".join(rows), np.uint8), at)
    keys, counts = np.unique(pairs, return_counts=True)
    last, n = np.unique(pairs & ((1 << 18) - 1), return_counts=True)
    table = np.zeros((257, 257), np.int64)
    table[last >> 9, last & 511] = n
    trie = scoring.Trie(keys, counts, table, scoring.ORDER)
    for text in (b"abra", b"cab zz", b"", b"naBa\xff"):
        p, _ = scoring.pairs_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert trie.log10(p)[0].sum() == pytest.approx(scoring.brute_force(train, text), rel=1e-9)
    for context in (b"abrac", b"ban", b"q"):  # all symbols after a context have one unit of probability
        s = [256] * scoring.ORDER + list(context)
        head = 0
        for x in s[-scoring.ORDER :]:
            head = head << 9 | x
        assert (10 ** trie.log10((head << 9) | np.arange(257))[0]).sum() == pytest.approx(1, abs=1e-9)
    empty = scoring.Trie(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((257, 257), np.int64), scoring.ORDER)
    assert empty.log10(pairs[:3])[0] == pytest.approx(-np.log10(257))


def test_links_in_a_leaf_span_its_components():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.97], rng.integers(0, 1 << 40, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    keys = [bytes([i]) for i in range(40)]
    found = neardup.links_in(keys, sets, 85)
    alike = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert len({b for _, b in found}) == len(found) and not {a for a, _ in found} & {b for _, b in found}  # stars

    def parts(links):
        root = list(range(40))
        for a, b in sorted(links):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    assert parts({(a[0], b[0]) for a, b in found}) == parts(alike)


def test_field_likelihood_and_decoding():
    pages = [([["a"], ["b"], ["a"]], [1, 0, 1]), ([["b"], ["b"]], [0, 0]), ([["a", "c"]], [1])]
    field = html.train(pages, rounds=60)
    import itertools

    for rows, labels in pages:
        every = {y: html.log_likelihood(field, rows, list(y)) for y in itertools.product((0, 1), repeat=len(rows))}
        assert sum(np.exp(x) for x in every.values()) == pytest.approx(1)
        assert field.decode(rows) == list(max(every, key=every.get)) == labels
    assert field.decode([]) == []


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav></body></html>", ""),
        ("<body><article><h1>A &amp; B</h1><p>One\n  two<br>three &lt;x&gt;.</p><div class='ad'>Buy now</div><p>Four <b>five</b>.</article><footer>&copy; me</footer>", "A & B\n\nOne two three <x>.\n\nFour five."),
        ("<body><article><p>Long enough text that reads like a sentence of an article.<script>var a='</p>'</script></p></article><div class=comments><p>First!</p></div>", "Long enough text that reads like a sentence of an article."),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, html.trained()) == text


def test_held_out_pages_are_labelled_well():
    field, wrong, total = html.trained(), 0, 0
    for page, rows in html.labelled_pages(60, seed=77):
        got = html.main_text(page, field)
        for text, y in rows:
            total += 1
            wrong += (text in got) != bool(y) and not any(text in other for other, z in rows if z and not y)
    assert wrong / total < 0.02


def test_counted_terms():
    assert toxicity.counted("Loser, losers! LOSER")["loser"] == 2
    vocabulary = {"loser": 0, "lose*": 1}
    assert toxicity.counted("Loser, losers! other", vocabulary, toxicity.beginnings(vocabulary)) == {0: 1, 1: 2, -1: 3}
    assert toxicity.counted("other", vocabulary, toxicity.beginnings(vocabulary)) == {}
    assert toxicity.counted(None) == {}


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(9)
    index = toxicity.Index({f"t{i}": i for i in range(6)}, np.append(rng.random(6) + 0.2, 0.4), np.arange(200), rng.integers(0, 2, 200), 0.1)
    counts = [{**{int(t): int(rng.integers(1, 4)) for t in rng.choice(6, rng.integers(1, 4), replace=False)}, -1: int(rng.integers(10, 60))} for _ in range(200)]
    vectors = [index.vector(c) for c in counts]
    index.add(vectors)
    dense = np.zeros((200, 7))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(20):
        cos = np.round(dense @ dense[i], 12)
        want = sorted((-x, j) for j, x in enumerate(cos.tolist()) if j != i and x > 0)[: toxicity.NEIGHBOURS]
        assert [(pytest.approx(-x), j) for x, j in want] == index.nearest(*vectors[i], but=i)


def test_blocks_are_opened_by_bound_only():
    """100 kinds of examples, each of words of its own: a search opens the blocks of one kind and a few more."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, {i // 40 * 2: int(rng.integers(1, 9)), i // 40 * 2 + 1: int(rng.integers(1, 9)), -1: 20}) for i in range(4000)]
    index = toxicity.fitted({f"t{i}": i for i in range(200)}, rows, 0.5)
    blocks = index.tops.shape[1]
    assert index.opened == 0 and blocks == 250
    for kind in range(0, 100, 7):
        before = index.opened
        near = index.nearest(*index.vector({2 * kind: 3, 2 * kind + 1: 3, -1: 20}))
        assert len(near) == toxicity.NEIGHBOURS and {int(index.ids[i]) // 40 for _, i in near} == {kind}
        assert index.opened - before <= 12


def plain_score(examples, share, text):
    """Score of a text by the definition: dictionaries, all cosines, the same votes and curve."""
    import math
    from collections import Counter

    n1, n0 = (sum(y == k for _, y, _ in examples) for k in (1, 0))
    terms = {i: set(toxicity.counted(t)) for i, _, t in examples}
    vocabulary = []
    for term in sorted(set().union(*terms.values())):
        a, b = (sum(term in terms[i] for i, y, _ in examples if y == k) for k in (1, 0))
        c, d = n1 - a, n0 - b
        below = (a + b) * (c + d) * n1 * n0
        if below and a + b >= toxicity.LEAST_TEXTS and (n1 + n0) * (a * d - b * c) ** 2 / below >= toxicity.LEAST_CHI:
            vocabulary.append(term)
    weight = {i: share / n1 if y else (1 - share) / n0 for i, y, _ in examples}
    idf = {t: math.log(1 + 1 / max(sum(weight[i] for i in weight if t in terms[i]), 1e-9)) for t in vocabulary}

    def vector(text, others):
        own = {t: n for t, n in toxicity.counted(text).items() if t in idf}
        total = sum(Counter(toxicity._LETTERS((text or "").lower())).values())
        v = {t: math.sqrt(n / total) * idf[t] for t, n in own.items()}
        v[None] = others  # all there is in a text without terms
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    def vote(v, but, others, vectors):
        near = sorted((-round(sum(x * vectors[i].get(t, 0) for t, x in v.items()), 12), i, y) for i, y, _ in examples if i != but)
        got = [0.0, 0.0]
        for s, _, y in [x for x in near if x[0] < 0][: toxicity.NEIGHBOURS]:
            got[y] += (share / n1 if y else (1 - share) / n0) / (1.05 - min(1.0, -s))
        return got[1] / sum(got) if sum(got) else 0.0

    best = None
    for others in toxicity.OTHERS:
        vectors = {i: vector(t, others) for i, _, t in examples}
        some = [(i, y) for i, y, _ in examples if len(vectors[i]) > 1]
        votes = np.array([vote(vectors[i], i, others, vectors) for i, _ in some])
        ys, ws = np.array([y for _, y in some]), np.array([weight[i] for i, _ in some])
        curve = toxicity._calibrated(votes, ys, ws)
        p = np.interp(np.round(votes, 9), *curve)
        loss = -(ws * np.where(ys == 1, np.log(p), np.log(1 - p))).sum()
        if best is None or loss < best[0] - 1e-12:
            best = loss, others, vectors, curve
    _, others, vectors, curve = best
    v = vector(text, others)
    if len(v) == 1:
        bare = [(weight[i], y) for i, y, _ in examples if len(vectors[i]) == 1]
        return sum(w * y for w, y in bare) / sum(w for w, _ in bare) if bare else 0.0
    return float(np.interp(round(vote(v, None, others, vectors), 9), *curve))


def toxic_texts(rng, n):
    cues, plain = ["scum", "idiot", "vermin", "pathetic"], [f"plain{chr(97 + i)}" for i in range(26)]
    out = []
    for i in range(n):
        words = list(rng.choice(plain, int(rng.integers(3, 30))))
        y = int(rng.random() < 0.4)
        if y:
            words += list(rng.choice(cues, int(rng.integers(1, 4))))
        out.append((i, y if rng.random() < 0.95 else 1 - y, " ".join(words)))
    return out


def test_scores_by_definition(spark):
    rng = np.random.default_rng(6)
    examples, others = toxic_texts(rng, 160), [(1000 + i, y, t) for i, y, t in toxic_texts(rng, 60)]
    docs = spark.createDataFrame([(i, t) for i, _, t in examples + others] + [(2000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in examples], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, labels["doc_id"] >= 0)
    share = sum(y for _, y, _ in examples) / len(examples)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, index).collect()}
    for i, _, t in others[:25] + [(2000, 0, None)]:
        assert got[i] == pytest.approx(plain_score(examples, share, t), abs=1e-6)


def test_substring_definition():
    w = [f"w{i}" for i in range(40)]
    rows = [(2, " ".join(w[:20])), (1, " ".join(w[5:30])), (3, " ".join(w[:12])), (None, " ".join(w))]
    got = substrings.brute_force(rows)
    assert got[0][:3] == (2, 20, 15) and got[1][2] == 0 and got[2][2] == 0 and got[3][2] == 0


def test_crc_of_ids_matches():
    assert zlib.crc32(b"12") % 4 in range(4) and mixing.BLOCK >= 1
