import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import alnum_words, empty_docs, hard_docs, prose, spaced_words
from veritrail.llm import ann, common, decontamination, passages, simhash, tokens


def brute_fingerprint(text):
    w = spaced_words(text)
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fingerprint); least id of what links reach."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints_and_components_as_by_hand(spark):
    extra = [(20 + k, f"one two three four {k % 3}", "en", "s", 1) for k in range(9)] + [(40, "the", "en", "s", 1), (41, "THE", "en", "s", 1)]
    df = hard_docs(spark, extra)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    expected = sorted(((i, f, c) for (i, f), c in zip(rows, brute_components(rows), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(df).collect()), key=str) == expected
    assert simhash.groups(empty_docs(spark)).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    kept = [m % (1 << 64) for m in simhash.masks()]
    for i in range(64):
        for j in range(64):
            assert any(not (m & ((1 << i) | (1 << j))) for m in kept)


@pytest.mark.parametrize("small", [2, 24])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(150):  # a large group that a chain of small steps connects
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 3)):
            x ^= 1 << rng.randrange(40)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    rows = [(k, f) for k, f in enumerate(sorted(fps))]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.links(spark.createDataFrame([(signed(f),) for _, f in rows], "fp long"))
    found = {r.node: r.root for r in common.components(links).collect()}
    expected = brute_components(rows)
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == v) for v in set(labels)}
    assert groups([found.get(signed(f), signed(f)) for _, f in rows]) == groups(expected)


def test_deduplication_keeps_one_of_each_group_and_all_columns(spark):
    df = hard_docs(spark, [(30, "a b c d e", "en", "s", 1), (31, "a b c d e", "en", "s", 1)])
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(30) == 1 and 31 not in ids and ids.count(6) == 1 and ids.count(None) == 2 and 2 in ids and 3 not in ids


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(7, 7)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in range(100, 161)} == {100} and {found[k] for k in range(1, 60)} == {1}


def test_word_hashes_do_not_depend_on_place_or_batch():
    import pyarrow as pa

    texts = ["", "a b", None, "b  a\tb", "x" * (3 << 20) + " a", "漢字 a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for limit in (1, 10, tokens.CHUNK):
        seen = {}
        n = 0
        for chunk in tokens.chunks(iter([batch]), limit=limit):
            w = tokens.words(chunk, tokens.SPACED)
            for d in range(chunk.n):
                assert w.of[d + 1] - w.of[d] == len(spaced_words(texts[n]))
                for word, h in zip(spaced_words(texts[n]), tokens.word_hashes(chunk, w)[w.of[d] :], strict=False):
                    assert seen.setdefault(word, h) == h
                n += 1
        assert n == len(texts) and len(set(seen.values())) == len(seen)


def test_compact_windows_partition_all_passages():
    rng = np.random.default_rng(0)
    v, of = tokens.mix(rng.integers(0, 60, 200).astype(np.uint64)), np.array([0, 0, 90, 95, 200])
    rank = (v & ~passages._LOW) | np.arange(200, dtype=np.uint64)
    w = passages.compact_windows(v, of, 10)
    for d in range(4):
        for a in range(of[d], of[d + 1]):
            for b in range(a + 9, of[d + 1]):
                c = a + int(np.argmin(rank[a : b + 1]))
                assert sum(1 for left, at, right in w if left <= a and at == c and right >= b) == 1


def exact_repeats(docs, n=50):
    first, out = {}, {}
    for i, text in sorted(docs):
        w = alnum_words(text)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if first.setdefault(g, i) != i:
                out.setdefault(i, set()).update(range(k, k + n))
    return out


def repeated_docs(spark):
    passage, line = prose(7, 60), prose(8, 12)
    rows = []
    for k in range(40):
        body = [prose(100 + k, 80), line, prose(200 + k, 80)]
        if k % 4 == 0:
            body.insert(1, passage)
        rows.append((50 + k, ".\n".join(body), "en", "s", 1))
    rows += [(200, rows[5][1], "en", "s", 1), (201, " ".join(passage.split()[:30] + ["changed"] + passage.split()[31:]), "en", "s", 1)]
    return hard_docs(spark, rows)


def test_repeated_passages_are_found_and_clean_text_is_not(spark):
    df = repeated_docs(spark)
    truth = exact_repeats([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    found = {}
    for r in passages.repeats(df).collect():
        assert (r.match_doc_id, r.match_start_word) < (r.doc_id, r.start_word) and r.match_doc_id <= r.doc_id and r.similarity >= 0.8
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert all(words <= found.get(i, set()) for i, words in truth.items())
    assert 201 in found and not set(found) - set(truth) - {201}
    assert passages.repeats(empty_docs(spark)).count() == 0


def test_repeats_within_a_document_and_periodic_text(spark):
    passage = prose(31, 55)
    docs = [(10, " ".join([prose(32, 30), passage, prose(33, 40)])), (11, " ".join([prose(34, 20)] + [passage] * 6 + [prose(35, 20)])), (12, "it " * 3000), (13, prose(36, 10) + " it" * 500), (14, "one two " * 80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert passages.alignments(df).count() < 30
    cut = {r.doc_id: r.text for r in passages.cut(df).collect()}
    assert passage in cut[10] and cut[11].split() == (prose(34, 20) + " " + prose(35, 20)).split() and len(cut[12].split()) < 60 and len(cut[13].split()) < 70 and len(cut[14].split()) < 60


def test_cutting_leaves_one_of_each_passage(spark):
    df = repeated_docs(spark)
    cut = passages.cut(df)
    assert cut.columns == df.columns
    rows = cut.collect()
    assert not exact_repeats([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    ids = [r.doc_id for r in rows]
    assert 200 not in ids and ids.count(6) == 2 and ids.count(None) == 2 and 3 in ids
    before = {r.doc_id: r for r in df.collect()}
    assert all(r.text == before[r.doc_id].text and r.n_chars == before[r.doc_id].n_chars for r in rows if r.doc_id in (1, 2, 3, 4, 51, 5, 7))


def test_benchmark_items_as_by_hand(spark):
    items = [(1, prose(11, 30)), (2, prose(12, 8)), (3, "two words"), (4, None), (5, ""), (1, prose(11, 30)), (6, prose(13, 200)), (None, prose(14, 20))]
    changed = " ".join("zzz" if k == 15 else w for k, w in enumerate(items[0][1].split()))
    docs = [
        (60, prose(21, 5000) + " " + items[0][1].upper() + "! " + prose(22, 300)), (61, items[1][1].replace(" ", ", ")), (62, "just two words here"), (63, prose(23, 50) + " " + changed),
        (64, items[6][1] + " tail"), (65, " ".join(items[0][1].split()[:15])), (66, items[7][1]), (60, items[1][1]),
    ]
    df = hard_docs(spark, [(i, t, "en", "s", 1) for i, t in docs])
    table = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long")
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    truth = set()
    for r in df.collect():
        for i, t in items:
            w = alnum_words(t)
            need = grams(w, min(5, len(w))) if w else set()
            if need and len(need & grams(alnum_words(r.text), min(5, len(w)))) >= 0.8 * len(need):
                truth.add((r.doc_id, i))
    got = decontamination.contained(df, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth and (63, 1) in truth and (60, 1) in truth and (65, 1) not in truth
    kept = decontamination.clean(df, table)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)[:20]) for r in kept.collect()) == sorted((str(r.doc_id), str(r.text)[:20]) for r in df.collect() if r.doc_id not in {d for d, _ in truth})
    assert decontamination.contained(empty_docs(spark), table).count() == 0 and decontamination.clean(df, table.limit(0)).count() == df.count()


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(k, 25)) for k in range(20)], "item_id long, text string")
    df = spark.createDataFrame([(k, prose(k, 25) + " " + prose(99, 40)) for k in range(20)], "doc_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in decontamination.contained(df, items).collect()}
    monkeypatch.setattr(decontamination, "BLOCK", 50)
    assert {(r.doc_id, r.item_id) for r in decontamination.contained(df, items).collect()} == whole == {(k, k) for k in range(20)}
    assert decontamination.clean(df, items).count() == 0


def test_nearest_neighbours_recall_ties_and_what_takes_no_part(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    rows = [(k, [float(x) for x in base[k]]) for k in range(300)] + [(1000 + k, [float(x) for x in base[0]]) for k in range(30)]
    rows += [(400, None), (500, []), (600, [0.0] * 32), (700, [float("nan")] + [1.0] * 31), (800, [None] + [1.0] * 31), (900, [float("inf")] * 32), (None, [1.0] * 32), (200, rows[200][1]), (2100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, tab int, code string")
    got = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {0, 100, 200, 1000}
    hits = total = 0
    for q, found in got.items():
        truth = sorted((float(np.sqrt(((x - good[q]) ** 2).sum())), i) for i, x in good.items() if i != q)[:10]
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and all(abs(s - float(np.sqrt(((good[i] - good[q]) ** 2).sum()))) < 1e-12 for _, i, s in found)
        hits, total = hits + len({i for _, i in truth} & {i for _, i, _ in found}), total + 10
    assert hits / total >= 0.9
    assert [i for _, i, _ in got[0]] == list(range(1000, 1010)) and [i for _, i, _ in got[1000]] == [0, *range(1001, 1010)]
    assert ann.search(df.limit(0)).count() == 0


def test_pieces_of_a_large_bucket_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, [float(x) for x in rng.standard_normal(8)]) for k in range(400)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.search(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert sorted(map(tuple, ann.search(df).collect())) == whole


def nearest(x, q):
    apart = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return set([i for i in np.lexsort((np.arange(len(x)), apart)) if i != q][:10])


@pytest.mark.parametrize("norms", [None, (0.25, 8.0)])
def test_recall_on_unit_and_on_mixed_norms(spark, norms):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= np.exp(rng.uniform(*np.log(norms), (len(x), 1)))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & nearest(x, q)) / 10 for q in range(0, 6000, 100)]) >= 0.9


def test_one_id_with_two_vectors_dimensions_apart_and_short_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (100, [1.0] * 20), *((k, [float(k)] * 20) for k in range(1, 5)), (300, [1e-300, 0.0]), (400, [1e300, 1e300])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got[100]) == {1, 2, 3, 4} and set(got[300]) == {0, 400} and set(got[0]) == {300, 400}


def test_what_hashing_leaves_short_is_searched_exactly(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 24))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "TABLES", 1)
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "BLOCK", 2)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == {q: nearest(x, q) for q in range(0, 500, 100)}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 64))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)


def changed(words, rng, fresh):
    words = list(words)
    words[rng.randrange(len(words))] = f"new{fresh}"
    return words


def near(a, b):
    """Whether passages of 50 words are at 0.8: 41 of 46 shingles equal by place."""
    return any(sum(a[k : k + 5] == b[k : k + 5] for k in range(s, s + 46)) >= 41 for s in range(len(a) - 49))


@pytest.mark.parametrize("size", [50, 60])
def test_no_near_copy_of_a_short_passage_is_missed(spark, size):
    rng, rows = random.Random(size), []
    for k in range(300):
        first = prose(3000 + k, size).split()
        second = list(first)
        second[rng.randrange(5, size - 5)] = "changed"
        rows += [(2 * k, " ".join([prose(5000 + k, 40), *first, prose(6000 + k, 40)])), (2 * k + 1, " ".join([prose(7000 + k, 30), *second, prose(8000 + k, 30)]))]
    found = {(r.doc_id, r.match_doc_id) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {(2 * k + 1, 2 * k) for k in range(300)}


def test_a_word_put_in_or_left_out_is_found(spark):
    rng, rows = random.Random(5), []
    for k in range(100):
        first = prose(3000 + k, 60).split()
        at = rng.randrange(10, 50)
        second = [*first[:at], *(["more"] if k % 2 else []), *first[at + 1 - k % 2 :]]
        rows += [(2 * k, " ".join([prose(5000 + k, 40), *first, prose(6000 + k, 40)])), (2 * k + 1, " ".join([prose(7000 + k, 30), *second, prose(8000 + k, 30)]))]
    found = {(r.doc_id, r.match_doc_id) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(2 * k + 1, 2 * k) for k in range(100)}


@pytest.mark.parametrize("small", [32, 4])
def test_drifting_versions_meet_their_near_ones(spark, monkeypatch, small):
    monkeypatch.setattr(passages, "SMALL", small)
    rng, rows, versions = random.Random(6), [], []
    for chain in range(8):
        words = prose(900 + chain, 60).split()
        for k in range(40):
            versions.append(words)
            rows.append((len(rows), " ".join([prose(20_000 + len(rows), 30), *words, prose(30_000 + len(rows), 30)])))
            words = changed(words, rng, len(rows))
    want = {i for i in range(len(rows)) if any(near(versions[i], versions[j]) for j in range(i - i % 40, i))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id for r in passages.repeats(df).collect()}
    assert len(want) > 250 and want <= found


def test_runs_are_those_of_compact_windows():
    texts = [prose(k, 120) for k in range(20)] + ["it " * 90, prose(1, 49)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array(texts)], ["doc_id", "text"])
    chunk = next(tokens.chunks(iter([batch])))
    key, ids, word, pieces, same = passages.picked(chunk)
    assert set(ids.tolist()) == set(range(21))
    for d in range(20):
        w = texts[d].split()
        at = sorted(word[ids == d].tolist())
        assert at[0] < passages.PICK and all(b - a <= passages.PICK for a, b in zip(at, at[1:], strict=False))
        assert len(w) - passages.GRAM - at[-1] < passages.PICK


def test_a_near_copy_far_back_in_a_large_group_is_found(spark):
    shared, rows = prose(777, 40).split(), []
    for k in range(72):
        own = prose(40_000 + k % 60, 10).split()
        if k >= 60 and k % 2:
            own[1] = f"changed{k}"
        elif k >= 60:
            own.insert(1, f"more{k}")
        rows.append((k, " ".join([prose(41_000 + k, 20), *shared, *own, prose(42_000 + k, 20)])))
    found = {(r.doc_id, r.match_doc_id) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found >= {(k, k - 60) for k in range(60, 72)}


def test_a_large_group_of_versions_loses_none_to_others_that_look_near(spark):
    rng, versions = random.Random(12), []
    base = prose(555, 50).split()
    for k in range(400):  # two versions differ in two words, or in one where the places are the same
        words = list(base)
        words[rng.choice([*range(5, 12), *range(38, 45)])] = f"own{k}"
        versions.append(words)
    rows = [(k, " ".join([prose(50_000 + k, 20), *words, prose(60_000 + k, 20)])) for k, words in enumerate(versions)]
    want = {i for i in range(400) if any(near(versions[i], versions[j]) for j in range(i))}
    found = {r.doc_id for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(want) > 350 and want <= found


def test_nearest_of_equally_near_vectors(spark):
    """One-hot vectors and points of a lattice, of which hundreds are equally near: distances are those of the nearest, in order."""
    rng = random.Random(8)
    for dim, n, kind in ((256, 200, "one_hot"), (16, 3000, "lattice")):
        ids = rng.sample(range(1, 5 * n), n) + [0]
        vectors = {i: [float(k == j % dim) for k in range(dim)] if kind == "one_hot" else [float(rng.randrange(1, 3)) for _ in range(dim)] for j, i in enumerate(ids)}
        got: dict[int, list] = {}
        for r in ann.search(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)).collect():
            got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        hits = total = 0
        for q in (i for i in ids if i % 100 == 0):
            want = sorted(math.dist(vectors[q], v) for i, v in vectors.items() if i != q)[: ann.TOP]
            assert got[q] == sorted(got[q]) and len(got[q]) == ann.TOP and all(abs(s - math.dist(vectors[q], vectors[i])) < 1e-12 for s, i in got[q])
            hits, total = hits + sum(s <= want[-1] + 1e-12 for s, _ in got[q]), total + ann.TOP
        assert hits >= 0.9 * total, (kind, hits, total)


def test_ties_go_to_the_smaller_id_among_all_that_is_met(spark):
    """500 candidates at one distance, met in one bucket in an order of their own: none is dropped, the smallest ids come first."""
    rng = random.Random(2)
    n, dim = 500, 512
    ids = rng.sample(range(1000, 9000), n)
    q = np.zeros((n + 1, dim), "<i2")
    q[np.arange(n), np.arange(n)] = 32767
    q[n, dim - 1] = 32767
    columns = {"slot": [0] * (n + 1), "code": [0] * (n + 1), "piece": [0] * (n + 1), "asks": [0] * n + [1], "cls": list(range(n + 1)), "most": [math.inf] * (n + 1), "scale": [1 / 32767] * (n + 1), "q": [r.tobytes() for r in q]}
    batch = pa.RecordBatch.from_pydict(columns)
    met = pa.Table.from_batches(list(ann._compared(iter([batch])))).to_pydict()
    assert sorted(met["cls"]) == list(range(n)) and max(met["low"]) <= math.sqrt(2) <= min(met["high"])
    classes = spark.createDataFrame([(c, i, [i], [float(k == c) for k in range(dim)]) for c, i in enumerate([*ids, 7])], "cls long, least long, ids array<long>, vec array<double>")
    classes = classes.withColumn("vec", F.when(F.col("cls") == n, F.array(*[F.lit(float(k == dim - 1)) for k in range(dim)])).otherwise(F.col("vec")))
    asked, candidates = spark.createDataFrame([(7, n)], "query_id long, qcls long"), spark.createDataFrame(list(zip(met["qcls"], met["cls"], met["low"], met["high"], strict=True)), "qcls long, cls long, low double, high double")
    rows = sorted(ann._ranked(asked, candidates, classes).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in rows] == sorted(ids)[: ann.TOP]


def versions_of(base, n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        words = list(base)
        words[rng.choice([*range(5, 12), *range(38, 45)])] = f"own{k}"
        out.append(words)
    return out


def repeated_words(a, b):
    """Words of a in shingles that passages of 50 words at 0.8 repeat from b, by place."""
    out = set()
    for s in range(len(a) - 49):
        equal = [k for k in range(s, s + 46) if a[k : k + 5] == b[k : k + 5]]
        if len(equal) >= 41:
            out.update(w for k in equal for w in range(k, k + 5))
    return out


def test_passages_of_a_large_group_grow_with_its_versions_and_hold_all_words(spark):
    base, made = prose(555, 50).split(), {}
    for n in (200, 800):
        versions = versions_of(base, n, 12)
        rows = [(k, " ".join([prose(50_000 + k, 20), *words, prose(60_000 + k, 20)])) for k, words in enumerate(versions)]
        found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        made[n] = len(found)
        held = {}
        for r in found:
            held.setdefault(r.doc_id, set()).update(range(r.start_word - 20, r.end_word - 20))
        for i in range(n if n == 200 else 0):
            want = set().union(*(repeated_words(versions[i], versions[j]) for j in range(i)))
            assert want <= held.get(i, set()), (i, sorted(want - held.get(i, set())))
    assert made[800] < 6 * made[200] and made[800] < 4 * 800, made


def test_each_text_of_an_id_in_a_large_group_has_its_passages(spark):
    versions = versions_of(prose(556, 50).split(), 150, 13)
    text = lambda k, words, tail: " ".join([prose(50_000 + k, 20), *words, prose(tail, 20)])
    rows = [(k, text(k, words, 60_000 + k)) for k, words in enumerate(versions)] + [(149, text(149, versions[149], 99_000)), (148, text(148, versions[3], 99_001))]
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    marks = {(r.doc_id, r.mark) for r in found.collect()}
    want = {r.doc_id: r.n for r in spark.createDataFrame(rows, "doc_id long, text string").groupBy("doc_id").agg(F.countDistinct("text").alias("n")).collect()}
    near_ones = [i for i in range(1, 150) if any(near(versions[i], versions[j]) for j in range(i))]
    assert {148, 149} <= set(near_ones) and all(sum(d == i for d, _ in marks) == want[i] for i in near_ones)


def test_sets_of_windows_are_those_of_brute_force():
    rng = np.random.default_rng(7)
    pairs = []
    for k in range(120):
        a = rng.integers(0, (4, 30, 10**6)[k % 3], rng.integers(0, 120)).astype(np.int32)
        b = np.concatenate([a[:50], rng.integers(0, 10**6, 5).astype(np.int32), a[50:]])[: len(a)] if k % 2 else rng.permutation(a)
        pairs.append((a, b))
    pairs += [(np.zeros(90, np.int32), np.zeros(90, np.int32)), (np.tile(np.arange(3), 30), np.tile(np.arange(3), 30)[::-1])]
    size = np.array([len(a) for a, _ in pairs])
    of = np.concatenate([[0], np.cumsum(size)])
    start, share = passages._by_sets(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]), of[:-1], size)
    want = {}
    for p, (a, b) in enumerate(pairs):
        for s in range(len(a) - passages.SPAN + 1):
            x, y = set(a[s : s + passages.SPAN].tolist()), set(b[s : s + passages.SPAN].tolist())
            if len(x & y) / len(x | y) >= passages.SIMILARITY:
                want[of[p] + s] = len(x & y) / len(x | y)
    assert want and dict(zip(start.tolist(), share.tolist(), strict=True)) == want


def test_words_beside_a_sure_repeat_are_held(spark):
    """Passages whose inner words an earlier document repeats for longer, and whose first words a later one alone has; some within one document."""
    docs, least = [], {}
    for k in range(80):
        fresh = lambda n: [f"w{k}x{random.Random(k * 1000 + n + j).getrandbits(40)}" for j in range(n)]  # noqa: B023, E731
        x = [f"x{k}y{random.Random(f'{k}-{j}').getrandbits(40)}" for j in range(140)]
        skip = 3 + k % 8
        first, second = x[skip : skip + 90], x[:50]
        docs += [(10 * k + 1, " ".join(fresh(30) + first + fresh(31)))] + [(10 * k + 2, " ".join(fresh(32) + second + fresh(33)))] * (k % 2)
        before = fresh(34) + second + fresh(35) if k % 2 == 0 else fresh(36)
        docs.append((10 * k + 3, " ".join(before + x + fresh(37))))
        least[10 * k + 3] = set(range(len(before), len(before) + 50))
    found = {}
    for r in passages.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert {i: sorted(words - found.get(i, set())) for i, words in least.items() if not words <= found.get(i, set())} == {}
