import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import empty_docs, hard_docs, prose, spaced_words
from veritrail.llm import pitman_yor, quality, tokens, toxicity


def chunk_of(texts):
    return next(tokens.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])))


def folded(divisor, remainder, n, held):
    ids = [i for i in range(1, 50 * n) if (zlib.crc32(str(i).encode()) % divisor == remainder) == held]
    return ids[:n]


def test_gradients_of_gated_attention_equal_differences():
    rng = np.random.default_rng(0)
    x, of, y = rng.standard_normal((7, 10)).astype(np.float32), np.array([0, 1, 4, 7]), np.array([0.0, 1.0, 1.0])
    model = quality.Model(width=10)
    for k in quality.Model.names:
        setattr(model, k, getattr(model, k).astype(np.float64))
    loss = lambda: float(-(y * np.log(p := model.forward(x, of)["p"]) + (1 - y) * np.log(1 - p)).mean())
    grads = model.gradients(x, of, y)
    for k in quality.Model.names:
        w = getattr(model, k)
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            down = loss()
            w[at] = keep
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-4 + 1e-2 * abs(grads[k][at])


def test_attention_weights_sum_to_one_and_passages_cover_the_text():
    chunk = chunk_of(["", None, prose(1, 200), "x " * 64, " \n"])
    x, of = quality.passages(chunk)
    assert np.diff(of).tolist() == [1, 1, 4, 1, 1] and x.shape[1] == quality.WIDTH and np.isfinite(x).all()
    assert np.allclose(np.add.reduceat(quality.Model().forward(x, of)["a"], of[:-1]), 1)
    one = [quality.passages(chunk_of([t]))[0] for t in ["", None, prose(1, 200), "x " * 64, " \n"]]
    assert np.allclose(np.concatenate(one), x)


def labelled(spark, n=500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1, n):
        bad = rng.random() < 0.25
        text = prose(i, rng.randrange(20, 200))
        if bad:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    return hard_docs(spark, rows[10:]), spark.createDataFrame(labels + [(6, 1, None), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    model = quality.learned(docs, labels)
    rows = quality.scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id and r.doc_id > 10]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.scores(empty_docs(spark), model).count() == 0


def test_quality_never_learns_from_held_out_labels(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    score = lambda m: sorted((str(r.doc_id), r.score) for r in quality.scores(docs, m).collect())
    assert score(quality.learned(docs, labels)) == score(quality.learned(docs, flipped))


def test_quality_without_labels_of_both_kinds(spark):
    docs, labels = labelled(spark, 30)
    assert {r.score for r in quality.scores(docs, quality.learned(docs, labels.limit(0))).collect()} == {0.5}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("stem", [False, True])
def test_the_automaton_accepts_what_edit_distance_does(stem):
    rng = random.Random(2)
    trie = toxicity.Trie([("idiot", stem), ("clown", stem), ("cloud", stem), ("abc", stem)])
    words = ["".join(rng.choice("idotclwnuab") for _ in range(rng.randrange(3, 8))) for _ in range(1500)]
    for term in ("idiot", "clown"):
        for _ in range(400):
            w = list(term)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "o"])
            words.append("".join(w) + ("tail" if stem and rng.random() < 0.5 else ""))
    for word in words:
        ends = range(1, len(word) + 1) if stem else [len(word)] if word else []
        near = not stem and any(levenshtein(word[:e], t) <= 1 for e in ends for t in ("idiot", "clown", "cloud"))
        exact = any(word.startswith(t) if stem else word == t for t in ("idiot", "clown", "cloud", "abc"))
        assert trie.match(word) == (("stem" if stem else "abuse") if exact else "misspelled" if near else None), word


def test_the_filter_misses_no_word_that_the_automaton_accepts():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon([("pathetic", False), ("moron", False), ("scum", False), ("vequ", True), ("lostra", True), ("größe", False)])
    words = []
    for term, stem in lexicon.trie.terms:
        for _ in range(300):
            w = list(term)
            if rng.random() < 0.8:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "ä"])
            words.append("".join(w) + ("ing" if stem else ""))
    words = [w for w in words if len(spaced_words(w)) == 1]
    chunk = chunk_of([" ".join(words)])
    hit = {i for i, _ in lexicon.hits(chunk, tokens.words(chunk))}
    assert hit == {i for i, w in enumerate(words) if lexicon.trie.match(w)}


def toxic_docs(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(11, n):
        words = prose(i, rng.randrange(30, 120)).split()
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "pathetic", "veq" + rng.choice("uvw") + "a" + str(rng.randrange(9))]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return hard_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_docs(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.learned(docs, labels)
    rows = toxicity.scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {"moron", "pathetic"} <= {t for t, _ in model.terms}
    assert toxicity.scores(empty_docs(spark), model).count() == 0
    assert len({r.score for r in toxicity.scores(docs, toxicity.learned(docs, labels.limit(0))).collect()}) == 1


def test_quotation_scores_below_abuse_and_misspelling_above_clean():
    toxic = [f"{prose(i, 30)} you moron {prose(i + 1000, 30)}" for i in range(60)]
    model = toxicity.fit(toxic, [prose(i + 5000, 60) for i in range(200)])
    p = lambda t: float(model.predict(chunk_of([t]))[0])
    abuse, quoted, reported, misspelled, clean = p("you are a moron now"), p('he said "what a moron" to them'), p("they called him a moron"), p("you are a morron now"), p("you are nice now")
    assert abuse > 0.7 > quoted and abuse > reported and abuse > misspelled > clean


def test_stirling_numbers_sum_over_partitions():
    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            for k in range(len(p)):
                yield p[:k] + [p[k] + 1] + p[k + 1 :]
            yield [*p, 1]

    d = 0.8
    for c in range(1, 7):
        weights = {}
        for p in partitions(c):
            w = 1.0
            for size in p:
                for k in range(1, size):
                    w *= k - d
            weights[len(p)] = weights.get(len(p), 0) + w
        for t, w in weights.items():
            assert abs(np.exp(pitman_yor.stirling(d)[c, t]) - w) < 1e-9 * w


def test_seating_follows_its_conditional():
    n, c, d, strength, parent, others = 40_000, 4, 0.8, 1.0, 0.05, 7
    rng = np.random.default_rng(1)
    got = np.bincount(pitman_yor.seat(np.full(n, c), np.full(n, parent), np.full(n, others), d, strength, rng), minlength=c + 1)[1:] / n
    logit = [np.log(strength + d * (others + np.arange(t))).sum() + pitman_yor.stirling(d)[c, t] + t * np.log(parent) for t in range(1, c + 1)]
    p = np.exp(logit) / np.exp(logit).sum()
    assert np.abs(got - p).max() < 0.01
    many = pitman_yor.seat(np.full(5, 5000), np.full(5, 0.01), np.full(5, 100), d, strength, rng)
    assert ((many >= 1) & (many <= 5000)).all()


def test_sweeps_agree_with_all_seatings_of_a_context():
    d, strength = 0.8, 1.0
    c, parent = np.array([4, 6, 2, 1]), np.array([0.2, 0.05, 0.01, 0.1])
    weights = pitman_yor.stirling(d)
    mean, norm = np.zeros(4), 0.0
    for seating in itertools.product(*(range(1, n + 1) for n in c)):
        t = np.array(seating)
        w = np.exp(np.log(strength + d * np.arange(t.sum())).sum() + weights[c, t].sum() + (t * np.log(parent)).sum())
        mean, norm = mean + w * t, norm + w
    copies, rng = 4000, np.random.default_rng(3)
    counts, parents, tables, got = np.tile(c, copies), np.tile(parent, copies), np.ones(4 * copies, int), []
    for sweep in range(30):
        totals = np.repeat(tables.reshape(copies, 4).sum(axis=1), 4)
        tables = pitman_yor.seat(counts, parents, totals - tables, d, strength, rng)
        if sweep >= 10:
            got.append(tables.reshape(copies, 4).mean(axis=0))
    assert np.allclose(np.mean(got, axis=0), mean / norm, rtol=0.03)


def test_contexts_dealt_over_shards_score_as_in_one_shard(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"the w{(k * 71 + j * j * 13) % 900} of" for j in range(120))) for k in range(200)], "doc_id long, text string").repartition(2)
    one = {r.doc_id: r for r in pitman_yor.scores(df).collect()}
    monkeypatch.setattr(pitman_yor, "SHARD", 48 << 10)
    for r in pitman_yor.scores(df).collect():
        assert (r.n_known, r.train_tokens, r.held_out) == (one[r.doc_id].n_known, one[r.doc_id].train_tokens, one[r.doc_id].held_out)
        assert abs(r.score - one[r.doc_id].score) < 0.02 * abs(one[r.doc_id].score) and abs(r.base_score - one[r.doc_id].base_score) < 1e-6


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    words, c = 30, rng.integers(0, 6, 30)
    t = np.array([rng.integers(1, x + 1) if x else 0 for x in c])
    guests = rng.integers(1, 9, words)
    tables = np.array([rng.integers(1, g + 1) for g in guests])
    above = np.append(pitman_yor.parent(guests, tables, guests.sum(), tables.sum(), words), pitman_yor.parent(0, 0, guests.sum(), tables.sum(), words))
    assert abs(above.sum() - 1) < 1e-12
    p = pitman_yor.predictive(np.append(c, 0), np.append(t, 0), np.full(words + 1, c.sum()), np.full(words + 1, t.sum()), above)
    assert abs(p.sum() - 1) < 1e-12 and (p > 0).all()


@pytest.mark.parametrize("shard", [12 << 20, 3000])
def test_language_model_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(pitman_yor, "SHARD", shard)
    extra = [(100 + i, " ".join(f"a{k} b{k} c{k}" for k in np.random.default_rng(i).integers(0, 30, 60)), "en", "s", 1) for i in range(80)]
    df = hard_docs(spark, extra)
    rows = pitman_yor.scores(df).collect()
    texts = [(r.doc_id, [*spaced_words(r.text), None]) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = {}
    for i, w in texts:
        if not held(i):
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    base = lambda w: sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
    expected = sorted(((str(i), held(i), len(w), sum(x in count for x in w), n, round(base(w), 5)) for i, w in texts))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == expected
    mine = [r for r in rows if r.held_out and r.doc_id and r.doc_id >= 100]
    assert mine and all(r.score > r.base_score and r.score < 0 for r in mine)
    assert pitman_yor.scores(empty_docs(spark)).count() == 0
