import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from seriesloom.llm import exact_dedup, mixing


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups_against_brute_force(spark, docs):
    rows = exact_dedup.exact_groups(docs, runs=8, fan_in=2).collect()
    source = [(r["doc_id"], norm(r["text"])) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for doc_id, text in source:
        groups[text].append(doc_id)
    want = Counter()
    for doc_id, text in source:
        ids = [i for i in groups[text] if i is not None]
        want[doc_id, min(ids) if ids else None, len(groups[text]), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


@pytest.mark.parametrize(("runs", "fan_in"), [(1, 2), (4, 4), (64, 8), (27, 3)])
def test_tree_shape_does_not_matter(docs, runs, fan_in):
    a = exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256")
    b = exact_dedup.exact_groups(docs, runs=runs, fan_in=fan_in).select(*a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_drop_copies_keeps_columns_and_one_row_each(docs):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in docs.select("text").collect()})


def test_empty_table(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.take_copies(no_docs).count() == 0


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """By repeated sharing, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        free -= over
    return out


def test_mix_targets_and_copies(docs):
    rows = mixing.mix(docs).collect()
    source = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in source:
        sizes[r["source"]] += n_words(r["text"])
    want = targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], n_words(r["text"])) for r in source)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * largest[s]


def test_targets_stop_at_three_times(spark):
    small = [(i, "w " * 10, "a") for i in range(5)] + [(100 + i, "w " * 100, "b") for i in range(50)] + [(200, "w", None)]
    df = spark.createDataFrame(small, "doc_id long, text string, source string")
    found = {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix(df).select("source", "target", "source_size").distinct().collect()}
    want = targets({"a": 50, "b": 5000, None: 1})
    assert found == {s: (pytest.approx(want[s]), n) for s, n in (("a", 50), ("b", 5000), (None, 1))}
    assert found[None][0] == 3.0


def test_reruns_and_partitions_agree(spark, docs):
    a = sorted(map(str, mixing.mix(docs).collect()))
    b = sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert a == b


def test_take_copies_follows_the_plan(docs):
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["source"]] += r["copies"]
    out = mixing.take_copies(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["source"]) for r in out.select("doc_id", "source").collect()) == +plan
