import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import ann, language_id, packing, pii, token_counts, toxicity, url_filter
from seriesloom.llm.shared import table
from seriesloom.llm.tokens import Encoder, vocabulary_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# --- tokens, packing, counts ---


BITS = ["word", " ", "  ", "   ", "\n", " \n", ".", "###", "a", "é", " the", " of", "\t ", "12", "!", "'s", "'", "'r", "e", "ll", "<|endof", "text|>", "<|endoftext|>", "<|", "|>", "\u00a0", "\u2003", "\x1c", "日本", "\U0001f600"]


def test_ids_and_pre_tokens_are_the_tokenizers(tokenizer, docs):
    rng, e = random.Random(2), Encoder()
    assert e.ids("a <|endoftext|> b").tolist() == ids_of(tokenizer, "a <|endoftext|> b") == [64, 220, 50256, 275]
    texts = [r["text"] for r in docs.select("text").collect() if r["text"] and len(r["text"]) < 5000]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for t in texts:
        ids, parts = ids_of(tokenizer, t), e.pre_tokens(t)
        assert e.ids(t).tolist() == ids, repr(t)
        assert "".join(parts) == t
        assert e.counts(parts).sum() == len(ids) and [x for p in parts for x in e.ids(p)] == ids, repr(t)


@pytest.mark.parametrize("open_windows", [1, 4, 64])
def test_packing(docs, tokenizer, open_windows):
    rows = packing.pack(docs, open_windows=open_windows, with_ids=True).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*ids_of(tokenizer, r["text"]), 0], dtype="<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= 1024 and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    have = Counter()
    for (doc_id, n), pieces in by_doc.items():
        times = Counter(p[0] for p in pieces)
        assert len(set(times.values())) == 1
        distinct = sorted(set(pieces))
        if len(distinct) == len(times):
            whole = b"".join(p for _, p in distinct)
            assert len(whole) == 4 * n
            have[doc_id, n, zlib.crc32(whole)] += times[0]
    assert have == want


def test_packing_wastes_little(spark, sf):
    rows = packing.pack(table(spark, sf, "documents")).collect()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert sum(1024 - n for n in used.values()) < 0.02 * sum(used.values())


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def edited(text, edits):
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def test_token_counts(spark, docs, no_docs, tokenizer):
    steps = [token_counts.noise_edits, token_counts.secret_edits]
    secret = "0123456789abcdef" * 2 + "01234567"
    more = spark.createDataFrame([(100, f"a ### b {secret}"), (100, f"a ### b {secret}"), (None, f"<|endoftext|>##### {secret}")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    want = Counter()
    for r in df.collect():
        text = r["text"] or ""
        row = [r["doc_id"], len(ids_of(tokenizer, text))]
        for step in steps:
            edits = step(text)
            text = edited(text, edits)
            row += [len(edits), len(ids_of(tokenizer, text))]
        want[tuple(row)] += 1
    rows = token_counts.token_counts(df, steps).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["edits_1"], r["tokens_1"], r["edits_2"], r["tokens_2"]) for r in rows) == want
    assert all((r["encoded_1"] > 0) == (r["edits_1"] > 0) for r in rows)
    assert token_counts.token_counts(no_docs, steps).count() == 0


def test_edits_match_encoding_again(tokenizer):
    rng, e = random.Random(8), Encoder()
    again = whole = 0
    for _ in range(500):
        tree = token_counts.TokenTree(e, "".join(rng.choice(BITS) for _ in range(rng.randint(0, rng.choice([6, 60, 300])))))
        for _ in range(4):
            text = tree.text
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 3)) // 2 * 2))
            edits = [(a, b, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 3)))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            tree = token_counts.TokenTree(e, text, token_counts.unpacked(token_counts.packed(tree.lengths)), [token_counts.unpacked(token_counts.packed(x)) for x in tree.levels])
            tree.apply(edits)
            assert tree.text == edited(text, edits) and tree.lengths.sum() == len(tree.text)
            assert tree.total == len(ids_of(tokenizer, tree.text)) == tree.levels[0].sum(), (text, edits)
            again, whole = again + tree.encoded, whole + len(e.pre_tokens(tree.text))
    assert again < 0.6 * whole


def test_an_edit_of_a_long_text_encodes_a_few_pre_tokens():
    tree = token_counts.TokenTree(Encoder(), "some words of a text " * 20_000)
    built = tree.encoded
    for _ in range(20):
        tree.apply([(200_000, 200_004, "change"), (300_000, 300_000, " more")])
    assert tree.encoded - built < 20 * 60 and tree.total == len(Encoder().ids(tree.text))


def test_stored_trees_take_batches_of_edits(spark, tmp_path, tokenizer):
    df = spark.createDataFrame([(1, "one two ### three"), (2, "x"), (3, None), (4, "same"), (4, "same"), (None, "none")], "doc_id long, text string").withColumn("edits", F.lit("mine"))
    trees = token_counts.store_trees(token_counts.build_trees(df), str(tmp_path / "a"))
    first = spark.createDataFrame([(1, 8, 11, "four"), (1, 0, 3, "a one"), (3, 0, 0, "new text"), (4, 4, 4, "<|endoftext|>")], "doc_id long, start long, end long, text string")
    trees = token_counts.store_trees(token_counts.update_trees(token_counts.with_edits(trees, first)), str(tmp_path / "b"))
    trees = token_counts.update_trees(trees, lambda text: [(0, 1, "Z")] if text else [])
    rows = trees.select("doc_id", "text", token_counts.token_total().alias("n"), "first_tokens", "encoded").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows) == [("1", "Z one two four three"), ("2", "Z"), ("3", "Zew text"), ("4", "Zame<|endoftext|>"), ("4", "Zame<|endoftext|>"), ("None", "Zone")]
    assert all(r["n"] == len(ids_of(tokenizer, r["text"])) for r in rows)


# --- language ---


def test_language_accuracy_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs = table(spark, big, "documents")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(docs):
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (4, 5, 6, 15):
            assert r["lang_pred"] == "und" and r["score"] == 0
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] in {"und", "en", "de", "fr", "es"}


def test_language_without_labels(docs, no_docs):
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(no_docs).count() == 0


def plain_grams(text):
    t = text.lower()
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_against_brute_force(monkeypatch):
    texts = ["abcab", "abc", "", "é", "ÀBÇ", "x\U0001f600y" * 3, "the cat sat on the mat", "der hund und die katze"]
    for at_once in (1 << 18, 5, 3):
        monkeypatch.setattr(language_id, "AT_ONCE", at_once)
        for a in texts:
            assert len(language_id.grams(a)) == len(plain_grams(a))
            for b in texts:
                x, y = plain_grams(a), plain_grams(b)
                want = len(x & y) / max(1, len(x) * len(y)) ** 0.5 if x and y else 0
                assert language_id.kernel(language_id.grams(a), language_id.grams(b)) == pytest.approx(want)


def test_scores_against_brute_force(spark, sf):
    rows = [r for r in table(spark, sf, "documents").where("lang is not null and text is not null").orderBy("doc_id").limit(120).collect()]
    texts, langs = [r["text"][:3000] for r in rows], [r["lang"] for r in rows]
    model = language_id.fit(texts, langs, per_language=5)
    chosen = [i for k in model.languages for i in [j for j, x in enumerate(langs) if x == k][:5]]
    sets = [plain_grams(t) for t in texts]
    k = np.array([[len(a & sets[i]) / (len(a) * len(sets[i])) ** 0.5 for i in chosen] for a in sets])
    values, vectors = np.linalg.eigh(k[chosen])
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    y = np.array([[1.0 if x == name else -1.0 for name in model.languages] for x in langs])
    w = np.diag([1 / langs.count(x) for x in langs])
    f = k @ root
    margins = f @ np.linalg.solve(f.T @ w @ f + language_id.RIDGE * np.eye(len(chosen)) / len(chosen), f.T @ w @ y)
    assert np.allclose(model.kernels([language_id.grams(t) for t in texts]), k, atol=1e-5)
    assert np.allclose(model.kernels([language_id.grams(t) for t in texts]) @ model.coefficients, margins, atol=0.02)
    best, score = model.predict(texts)
    assert (best == margins.argmax(axis=1)).mean() > 0.98 and ((score > 0) & (score <= 1)).all()


def test_long_texts_keep_their_language(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    rows = docs.where("lang is not null and text is not null").orderBy("doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r["text"])
    long = spark.createDataFrame([(10_000_000 + i, "\n".join(t)[: 400_000 + i], x) for i, (x, t) in enumerate(sorted(by.items()))], "doc_id long, text string, lang string")
    out = language_id.identify(docs.select("doc_id", "text", "lang").unionByName(long)).where("doc_id >= 10000000").collect()
    want = {10_000_000 + i: x for i, x in enumerate(sorted(by))}
    assert {r["doc_id"]: r["lang_pred"] for r in out} == want


def test_language_sample_is_bounded(spark):
    rows = [(None, f"same text of {x}", x) for x in ("aa", "bb") for _ in range(3000)] + [(i, f"some other text {i} of {i % 2}" + "z" * 40_000 * (i < 3), "ab"[i % 2] * 2) for i in range(0, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.training_rows(df, id_col="doc_id", text_col="text", lang_col="lang", most=50)
    assert Counter(x for _, x in got) == {"aa": 50, "bb": 50} or all(n <= 50 for n in Counter(x for _, x in got).values())
    assert max(len(t) for t, _ in got) <= language_id.TRAIN_CHARS


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(t):
    return [int(c) for c in t if c in "0123456789"]


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans_equal_the_plain_patterns(spark, sf):
    rng = random.Random(6)
    bits = ["@", ".", "a", "b.c", "x@y.z", "1", "23", "255", "256", "001", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "..", "%", "1.2.3.4", "+1 (743) 555-3824", "\n", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    texts += [r["text"] for r in table(spark, sf, "documents").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), repr(t[:300])


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000, "1 " * 100_000, "a.b@" + "c." * 100_000):
        pii.base_spans(t)


def test_personal_data_rows(docs, no_docs):
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["spans"] == "" and by_id[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(no_docs).count() == 0


def test_classifier_adds_likely_spans_and_leaves_others(spark):
    good = [f"please call 415-555-{1000 + i} or write to me{i}@mail.example.com, card 4111 1111 1111 1111 ok" for i in range(40)]
    bad = [f"order 123456789{i} of version 1.2.3 section 300.400.500.600" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert all("phone:12:24" in rows[i]["spans"] and rows[i]["n_phone"] == 0 and rows[i]["n_email"] == 1 and rows[i]["n_card"] == 1 for i in range(40))
    assert all(rows[i]["spans"] == "" for i in range(40, 80))
    for r in rows.values():
        base = [s for k, own in plain_spans((good + bad)[r["doc_id"]]).items() for s in [f"{k}:{a}:{b}" for a, b in own]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == "please call <PHONE> or write to <EMAIL>, card <CARD> ok" and clean[79] == bad[39]


def test_secrets_and_lookalikes(spark):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    good = [f"some words token = \"{hexes(40)}\" more" for _ in range(60)] + [f"x AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789') for _ in range(16))} y" for _ in range(60)] + [f"password={hexes(18)} end" for _ in range(60)]
    bad = [f"see commit {hexes(40)} of the build" for _ in range(60)] + [f"token: {'a' * 12} and password: ........" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    found = [any(x["kind"] == "secret" for x in rows[i]["found"]) for i in range(len(rows))]
    assert sum(found[:180]) >= 175 and sum(found[180:]) <= 5
    one = next(x for x in rows[0]["found"])
    assert re.fullmatch("[0-9a-f]{40}", good[0][one["start"] : one["end"]])


def test_added_spans_follow_the_classifier(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    rows = pii.find_personal_data(df).collect()
    texts = [r["text"] for r in df.collect()]
    all_found = [pii.candidates(t or "") for t in texts]
    counted = Counter((x["kind"], x["votes"]) for own in all_found for x in own)
    sample = [(x["kind"], x["votes"], x["features"]) for own in all_found for x in own]
    distinct = sorted({(k, v, tuple(f)) for k, v, f in sample})
    weights = pii.fitted([(k, v, n) for (k, v), n in sorted(counted.items())], [(k, v, list(f)) for k, v, f in distinct])
    want = Counter(",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in own if x["base"] or weights[x["features"]].sum() > 0) for own in all_found)
    assert len(distinct) < pii.SAMPLED and Counter(r["spans"] for r in rows) == want
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in rows)


def test_expectation_maximisation_finds_reliable_labelers():
    rng, counts = random.Random(1), Counter()
    for _ in range(4000):
        real = rng.random() < 0.5
        vote = lambda p: "+" if (rng.random() < p) == real else "-"
        counts["".join([vote(0.95), vote(0.9), vote(0.5), "0", vote(0.8), vote(0.6)])] += 1
    rates, _ = pii.reliabilities(sorted(counts.items()))
    accuracy = [(rates[j, 1, 2] + rates[j, 0, 0]) / 2 for j in (0, 1, 2, 4, 5)]
    assert np.allclose(accuracy, [0.95, 0.9, 0.5, 0.8, 0.6], atol=0.05)


# --- toxicity ---


def test_toxicity_learns_and_orders(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    half = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    model = toxicity.trained(docs, half)
    assert model.thresholds[0] < model.thresholds[1]
    rows = toxicity.severity(docs, model).join(labels.join(half, "doc_id", "left_anti").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    bad, good = [r for r in rows if r["label"] == 1], [r for r in rows if r["label"] == 0]
    assert sum(r["toxic"] for r in bad) >= 0.8 * len(bad) and sum(r["toxic"] for r in good) <= 0.01 * len(good)
    assert all(0 <= r["expected_severity"] <= 2 and (r["grade"] > 0) == r["toxic"] for r in rows)


def test_scores_equal_the_formula(spark, docs):
    model = toxicity.Model({"one": 1.5, "^qqqq": -0.7, "two": 0.25, "^wordy": 2.0}, (0.3, 1.1))
    df = spark.createDataFrame([(1, "One one two QQQQxy"), (2, "wordyes wordy"), (3, None), (4, "qqqq")], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r, text in zip(toxicity.severity(df, model).collect(), [x["text"] for x in df.collect()], strict=True):
        own = {x.lower() for x in re.findall(r"\w+", text or "")}
        value = sum(w for f, w in model.weights.items() if (any(x.startswith(f[1:]) and len(x) > len(f) - 1 for x in own) if f[0] == "^" else f in own))
        p = [1 / (1 + np.exp(t - value)) for t in model.thresholds]
        assert r["p_toxic"] == pytest.approx(p[0]) and r["expected_severity"] == pytest.approx(sum(p)) and r["grade"] == sum(x >= 0.5 for x in p)


def test_fit_is_the_minimum_of_the_ordinal_loss():
    rng = np.random.default_rng(1)
    x = rng.random((80, 4)) < 0.4
    grade = np.clip((x @ np.array([2.0, 1.0, 0.0, -1.0]) + rng.normal(0, 0.7, 80)).round(), 0, 2).astype(int)
    rows, columns = np.nonzero(x)

    def loss(v):
        w, t = v[:4], v[4:]
        out = toxicity.PENALTY / 2 * (w @ w)
        for toxic in (True, False):
            mine = (grade > 0) == toxic
            for k in (0, 1):
                p = 1 / (1 + np.exp(t[k] - x[mine] @ w))
                out -= 0.5 / mine.sum() * np.where(grade[mine] > k, np.log(p), np.log(1 - p)).sum()
        return out

    w, low, high = toxicity.fit(4, rows, columns, grade)
    found = np.array([*w, low, high])
    for i in range(6):
        step = np.eye(6)[i] * 0.05
        assert loss(found) <= min(loss(found + step), loss(found - step)) + 1e-6


def test_cut_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        toxic = rng.random(60) < 0.4
        margins = np.where(toxic, rng.normal(0.6, 0.6, 60), rng.normal(-0.8, 0.5, 60))
        loss = lambda c: (margins[toxic] < c).mean() + toxicity.COST * (margins[~toxic] >= c).mean()
        assert loss(toxicity.best_cut(margins, toxic)) <= min(loss(c) for c in np.linspace(-1, 1, 400)) + 1e-9


def test_training_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "bad thing")] * 500 + [(2, "fine"), (2, "other"), (None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 10, 10).count() == 2


def test_toxicity_of_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (7, None), (11, 0), (13, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    assert toxicity.severity(docs, model).count() == docs.count()
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert toxicity.severity(no_docs, model).count() == 0 and toxicity.drop_toxic(no_docs, model).count() == 0
    nothing = toxicity.trained(docs, labels.limit(0))
    assert not any(r["toxic"] for r in toxicity.severity(docs, nothing).collect())


# --- neighbours ---


def exact_nearest(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_against_brute_force(spark, sf):
    data = table(spark, sf.replace("0.001", "0.1"), "embeddings")
    want = exact_nearest([(r["vec_id"], r["embedding"]) for r in data.collect()])
    got = defaultdict(list)
    for r in ann.nearest(data, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    for q, found in got.items():
        real = dict(want[q])
        assert all(abs(s - real.get(i, s)) < 1e-9 for i, s in found)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [0.0, 2.0], 2), (50, [0.0, 2.0], 2), (1, [2.0, 0.0], None), (2, [1.0, 1e-3], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [float("inf"), 1.0], 0), (100, [0.0, 0.0], 0), (8, [3.0, 0.0], 0), (None, [1.0, 1.0], 0), (9, [1e38, 1e38], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").withColumns({"codes": F.lit(1), "size": F.lit("x")})
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [1, 8, 2, 9, 50] and got[50] == [9, 2, 0, 1, 8] and set(got) == {0, 50}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 3)"), F.col("vec_id") % 50 == 0).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=16).tolist()
    rows = [(i, same) for i in range(0, 900, 3)] + [(i, rng.normal(size=16).tolist()) for i in range(1, 900, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q, found in got.items():
        if q % 3 == 0:
            assert found == [i for i in range(0, 20, 3) if i != q][:5]


# --- urls ---


def plain_judge(url, rules=url_filter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_against_plain_rules(spark):
    rng = random.Random(5)
    bits = ["http://", "https://", "EXAMPLE.org", "example.org", "www.", "a.b.", "org", ".com", "com", "/", "/es/", "/en/1", "/en/", "/fr/", "/de/", "?q=/es/", "#x", "", ":", "//", "..", "é", "@"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(3000)] + [None, "", "://", "x://", "http://example.org/es/x?y", "http://" + "a." * 3000 + "org/" + "x" * 100_000] + ["http://example.org/es/"] * 50
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("mine"), "row": F.lit(1), "found": F.lit(2)})
    for r in url_filter.judge(df, url_filter.rule_table(spark, url_filter.RULES)).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(urls[r["page_id"]]), urls[r["page_id"]]


def test_many_shapes_of_rules(spark):
    rng = random.Random(7)
    labels = ["a", "b", "c", "org", "x-y"]
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choice(labels) for _ in range(rng.randint(1, 6))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 40)))) for _ in range(800)]
    rules += [("block", "a", "/" + "a" * n) for n in range(5000)] + [("allow", None, "/"), ("block", "b", None), rules[0], rules[0]]
    urls = [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 8)))}/{''.join(rng.choice('ab/') for _ in range(rng.randint(0, 45)))}" for _ in range(400)] + ["http://a/" + "a" * 6000 + "b"]
    table = url_filter.rule_table(spark, rules)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), table).collect()}
    for i, url in enumerate(urls):
        assert got[i] == plain_judge(url, [r for r in rules if None not in r])[2:], url


def test_urls_nothing_to_judge(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    assert url_filter.judge(none, rules).count() == 0
    one = spark.createDataFrame([(None, "http://a.org/"), (None, "http://a.org/")], "page_id long, url string")
    assert [r["rule"] for r in url_filter.judge(one, rules).collect()] == ["org/", "org/"]
    assert [r["verdict"] for r in url_filter.judge(one, rules.limit(0), default="block").collect()] == ["block", "block"]
