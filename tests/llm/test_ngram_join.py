import random
import re
from collections import defaultdict

import numpy as np
import pytest

from seriesloom.llm import components as components_module
from seriesloom.llm import ngram_join, signature_tree
from seriesloom.llm import shingles as shingles_module
from seriesloom.llm.components import components
from seriesloom.llm.shared import groups_in_order, small_batches
from seriesloom.llm.shingles import Hasher, digest

from .conftest import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width=4, percent=85):
    """component id by row position."""
    sets, up = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return sorted((str(r[0]), len(sets[i]), str(min(ids[find(i)], default=None))) for i, r in enumerate(rows))


def found(df, **how):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.ngram_components(df, **how).collect())


def test_awkward_rows(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


def test_empty_table(no_docs):
    assert ngram_join.ngram_components(no_docs).count() == 0
    assert ngram_join.keep_one(no_docs).count() == 0


def family(seed, n, size, edits):
    """n texts, each the base with some words changed, and a shared passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 2048), (4, 85, 8), (5, 80, 16), (3, 60, 2048), (3, 60, 4)])
def test_families_against_brute_force(spark, width, percent, block):
    texts = []
    for seed, (n, size, edits) in enumerate([(40, 60, 6), (30, 200, 12), (25, 12, 2), (20, 6, 1), (60, 30, 3)]):
        texts += family(seed, n, size, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(9)
    texts += [passage + " " + " ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randint(2, 80))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, width=width, percent=percent, block_sets=block) == brute(rows, width, percent)


def test_keep_one(docs):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 13 not in ids and 3 not in ids and {4, 5, 6, 8} <= set(ids) and 9 not in ids


def halves(a):
    """Sets of 64 bits as sets of 128."""
    a = np.unique(np.asarray(a, dtype=np.uint64))
    return np.stack([a, a ^ np.uint64(77)])


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_every_link_shares_a_signature(percent):
    rng = np.random.default_rng(3)
    signer = ngram_join.Signer(percent, rng.integers(0, 40, 1 << 10).astype(np.uint8))
    for n in [*range(1, 40), 60, 100, 250, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, int((101 - percent) / 100 * n)) + 1)
            more = rng.integers(0, 2**63, int(rng.integers(0, max(1, int((101 - percent) / 100 * n)) + 1)), dtype=np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - drop], more]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                assert np.intersect1d(signer.signatures(halves(a)), signer.signatures(halves(b))).size, (n, len(a), len(b), both)


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    for percent in (60, 85):
        sets = []
        for _ in range(12):
            base = rng.integers(0, 10_000, int(rng.integers(5, 60))).astype(np.uint64)
            for _ in range(int(rng.integers(1, 20))):
                keep = base[rng.random(len(base)) < 0.95]
                sets.append(halves(np.concatenate([keep, rng.integers(0, 10_000, 1).astype(np.uint64)])))
        sets.append(halves([]))
        links = signature_tree.Links(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a[0], sets[j][0]))
                if both and 100 * both >= percent * (a.shape[1] + sets[j].shape[1] - both):
                    links.join(i, j)
        want = [links.find(i) for i in range(len(sets))]
        for leaf, tokens in ((32, 1 << 14), (32, 40), (2, 10)):
            signature_tree.LEAF, signature_tree.LEAF_TOKENS = leaf, tokens
            mine = signature_tree.Links(len(sets))
            for a, b in signature_tree.linked(sets, None, percent):
                mine.join(a, b)
            assert [mine.find(i) for i in range(len(sets))] == want
            cut = len(sets) // 2
            parts = signature_tree.Links(len(sets))
            for edges, offset in ((signature_tree.linked(sets[:cut], None, percent), 0), (signature_tree.linked(sets[cut:], None, percent), cut)):
                for a, b in edges:
                    parts.join(a + offset, b + offset)
            for a, b in signature_tree.linked(sets[:cut], sets[cut:], percent, [parts.find(i) for i in range(len(sets))]):
                parts.join(a, b)
            assert [parts.find(i) for i in range(len(sets))] == want
        signature_tree.LEAF, signature_tree.LEAF_TOKENS = 32, 1 << 14


def test_block_signatures_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        a, b = ([halves(rng.permutation(pool)[: int(rng.integers(1, 2500))]) for _ in range(3)] for _ in range(2))
        (_, _, hidden, bits), (_, _, other, more) = signature_tree.block_signature(a), signature_tree.block_signature(b)
        bound = int(np.bitwise_count(np.frombuffer(bits, np.uint8) & np.frombuffer(more, np.uint8)).sum()) + min(hidden, other)
        assert bound >= max(len(np.intersect1d(x[0], y[0])) for x in a for y in b)


def test_sets_match_tuples():
    hasher = Hasher(4)
    texts = ["A b\tC d e", "a b c d e", "", " \n", "x", "x y z", "X  y z", "é É e", "q " * 50, "a b c d", "b a c d", "d c b a", "a a b b", "b b a a", None]
    sets = [hasher.set_of(t) for t in texts]
    for i, a in enumerate(texts):
        assert sets[i].shape == (2, len(shingles(a)))
        for j, b in enumerate(texts):
            assert (digest(sets[i]) == digest(sets[j])) == (shingles(a) == shingles(b))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_fool_polynomial_hashes(spark, size):
    word = "".join("ab"[i.bit_count() % 2] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = (Hasher(4).set_of(x) for x in (word, other))
    assert not np.intersect1d(a[0], b[0]).size and not np.intersect1d(a[1], b[1]).size
    rows = [(1, word), (2, other), (3, word + " "), (4, f"{word} x y z"), (5, f"{other} x y z")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_long_texts_are_cut_into_words_as_a_whole(monkeypatch):
    text = words(8, 3000) + " \x0b\x0c\r\n " + "y" * 5000 + " " + words(9, 50)
    whole = Hasher(4).set_of(text)
    for size in (1, 7, 100, 4999):
        monkeypatch.setattr(shingles_module, "AT_ONCE", size)
        assert (Hasher(4).set_of(text) == whole).all()


def test_rows_without_identifiers(spark):
    texts = family(3, 30, 40, 3) + family(4, 10, 12, 1)
    rows = [(None, t) for t in texts for _ in range(5)] + [(7, texts[0]), (7, texts[0]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)
    kept = [r["text"] for r in ngram_join.keep_one(df.distinct()).collect()]
    of = {}
    sets = {t: shingles(t) for t in {t for _, t in rows if t}}
    for t in sets:
        linked = [u for u in of if 100 * len(sets[t] & sets[u]) >= 85 * len(sets[t] | sets[u])]
        of[t] = t
        for u in linked:
            old, new = of[u], of[t]
            of = {k: new if v == old else v for k, v in of.items()}
    assert len([t for t in kept if t]) == len(set(of.values()))


def test_many_long_texts_in_one_batch():
    import resource

    import pyarrow as pa

    base = words(11, 170_000)
    texts = [f"{base} {words(100 + i, 20)}" for i in range(64)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(64), pa.int64()), pa.array(texts), pa.array(range(64), pa.int64())], names=["doc_id", "text", "mark"])
    rows = pa.RecordBatch.from_arrays([pa.array([1] * 64, pa.int64()), pa.array([0] * 64, pa.int32()), pa.array(range(64), pa.int64()), pa.array(texts)], names=["root", "block", "uid", "text"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(b.num_rows for b in small_batches([batch])) == 64 and max(b.num_rows for b in small_batches([batch])) <= 5
    hasher = Hasher(4)
    for part in small_batches([batch]):
        for t in part.column(1).to_pylist():
            hasher.set_of(t)
    assert sum(t.num_rows for _, t in groups_in_order([rows], 2)) == 64
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


@pytest.mark.parametrize("edges_a_task", [1 << 19, 40])
def test_components(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(components_module, "EDGES", edges_a_task)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    want = {(x, find(x)) for x in up if find(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
