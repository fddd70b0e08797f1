import re
from collections import Counter

import corpus_pipeline
from seriesloom.llm import toxicity
from seriesloom.llm.shared import table

from .test_exact_and_mixing import norm, targets
from .test_ngram_join import shingles


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    model = toxicity.trained(docs, labels)
    rows = [tuple(r) for r in docs.collect()]
    at = docs.columns.index("text")
    step = docs
    kept = [r for r in rows if model.above(r[at])[0] < toxicity.REJECT_FROM]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf).cache()
        results.append(step)
    assert all(s.columns == docs.columns for s in results[:-1])
    assert sorted(map(tuple, results[0].collect())) == sorted(kept)
    first = {}
    for r in sorted(kept):
        first.setdefault(norm(r[at]), r)
    assert sorted(map(tuple, results[1].collect())) == sorted(first.values())
    left, sets = sorted(first.values()), {r[0]: shingles(r[at], 5) for r in first.values()}
    up = {r[0]: r[0] for r in left}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [r[0] for r in left]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    left = [r for r in left if find(r[0]) == r[0]]
    assert sorted(map(tuple, results[2].collect())) == left
    source = docs.columns.index("source")
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[at])) for r in left}
    sizes = Counter()
    for r in left:
        sizes[r[source]] += size[r[0]]
    want, taken, copies = targets(sizes), Counter(), Counter()
    for r in results[3].collect():
        taken[r["source"]] += size[r["doc_id"]]
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * max(size[r[0]] for r in left if r[source] == s)
    pieces = Counter()
    for r in results[4].collect():
        pieces[r["doc_id"]] += r["start"] == 0
    assert pieces == copies


def test_run_writes_in_the_shared_folder(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns


def tables(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, whole long").write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 0, 1 if r[1] and "awful" in r[1] else 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_awkward_rows(spark, tmp_path):
    texts = [f"plain text number {i} " + " ".join(f"w{i * 37 + j}" for j in range(30)) for i in range(40)] + [f"an awful thing {i} " + " ".join(f"v{i * 41 + j}" for j in range(30)) for i in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], len(t), "x", 1) for i, t in enumerate(texts)]
    near = texts[0] + " one more"
    rows += [(100, near, "en", "a", None, None, None), (None, near + " again", None, None, None, None, None), (None, texts[1], None, "a", None, None, None)]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "b", 0, "", 0), (None, " \n", None, None, None, None, None), (None, None, None, None, None, None, None)]
    rows += [(300, "long " + "word " * 60_000 + "end", "en", "c", None, None, None)] * 2 + [(301, "y" * 400_000, "en", "c", None, None, None)] + rows[:5]
    tables(spark, tmp_path, rows)
    step, results = table(spark, str(tmp_path), "documents"), []
    names = step.columns
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path)).cache()
        results.append(step)
    assert all(s.columns == names for s in results[:-1])
    clean, exact, near_kept, mixed = ([r["text"] for r in s.select("text").collect()] for s in results[:-1])
    assert sum("awful" in (t or "") for t in clean) <= 3 and all(t in clean for t in texts[:40]) and None in clean
    assert len(exact) == len({norm(t) for t in clean}) and {norm(t) for t in exact} == {norm(t) for t in clean}
    sets = [shingles(t, 5) for t in near_kept]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert texts[0] in near_kept and near not in near_kept and texts[1] in near_kept
    assert Counter(r["doc_id"] for r in results[-1].where("start = 0").collect()) == Counter(r["doc_id"] for r in results[3].collect())


def test_nothing(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
