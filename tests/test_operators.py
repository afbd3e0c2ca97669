from pyspark.sql import functions as F

from veritrail.operators import acquisition, dedupe, diagnostics, integrity, layout, ledger, quotes, ranking, replay, sections, versions


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PAPER = "Title\nAbstract\n\nWe measure flames at 1200 K and report speeds.\n\nBody text that goes on.\n" + "word " * 60 + "\nReferences\n" + "\n".join(f"Smith, J. (19{k}) Flame 12:{k}" for k in range(10, 22))


def test_sections_and_bibliography(spark):
    docs = frame(spark, [(1, PAPER), (2, "no headings here"), (3, None), (4, "")], "doc_id long, text string")
    regions = sections.special_regions(F.col("text"))
    rows = {r.doc_id: r for r in docs.select("doc_id", "text", regions.alias("r")).collect()}
    found = {x.label: PAPER[x.start : x.end] for x in rows[1].r}
    assert found["abstract"].startswith("We measure") and found["abstract"].endswith("speeds.") and found["references"].startswith("References") and found["references"].endswith("12:21")
    assert not rows[2].r
    place = PAPER.index("Smith")
    assert docs.where("doc_id = 1").select(sections.section_of(regions, F.lit(place)).alias("s"), sections.section_of(regions, F.lit(0)).alias("b")).first() == ("references", "body")
    region = sections.bibliography_regions(docs).collect()
    assert len(region) == 1 and region[0].confident and PAPER[region[0].region_start : region[0].region_end].endswith("12:21")
    lines = sections.lines(docs.where("doc_id = 1")).collect()
    assert all(PAPER[r.line_start :].startswith(r.line) for r in lines)


HAY = "The ignition delay does not increase with pressure at 1200 K in the shock tube experiments."


def test_quotes_exact_near_and_reversed(spark):
    docs = frame(spark, [(1, HAY + " tail " * 30), (2, "unrelated text " * 20), (3, None)], "doc_id long, text string")
    asked = [HAY, HAY.replace("does not increase", "does increase"), HAY.replace("1200", "1500"), HAY.replace("experiments", "experimente"), "too short", "a quote that nobody ever wrote down anywhere"]
    items = frame(spark, list(enumerate(asked)), "item_id long, text string")
    assert [(r.item_id, r.doc_id, r.q_start) for r in quotes.occurrences(docs, items).collect()] == [(0, 1, 0)]
    near = {r.item_id: (r.doc_id, r.reason) for r in quotes.near_matches(docs, items).collect()}
    assert near == {1: (1, "semantic_discrepancy"), 2: (1, "semantic_discrepancy"), 3: (1, None)}


def test_what_changes_a_claim(spark):
    cases = [("it is stable", "it is unstable", True), ("speeds increased", "speeds decreased", True), ("heat of 12 kJ", "heat of 13 kJ", True), ("has no effect", "has an effect", True),
             ("more or less", "more or loss", False), ("flame speed", "flame speeds", False), ("", "", False), ("a b", "a b", False)]
    df = frame(spark, cases, "a string, b string, want boolean")
    assert [r.got for r in df.select(quotes.differs_in_meaning(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]


def test_the_gram_filter_misses_no_near_match(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    asked = []
    for k in range(60):
        at = rng.randrange(200)
        q = list(text[at : at + rng.randrange(40, 120)].strip())
        for _ in range(rng.randrange(1, 8)):
            q[rng.randrange(len(q))] = rng.choice("abcdefghxyz")
        asked.append((k, "".join(q)))
    found = {r.item_id: r.q_start for r in quotes.near_matches(frame(spark, [(1, text)], "doc_id long, text string"), frame(spark, asked, "item_id long, text string")).collect()}
    truth = {}
    for k, q in asked:
        last = len(text) - len(q)
        shares = [(SequenceMatcher(None, text[s : s + len(q)], q).ratio(), -s) for s in {*range(0, last + 1, max(1, len(q) // 8)), last}]
        if q not in text and len(q) >= 20 and max(shares)[0] >= 0.92:
            truth[k] = -max(shares)[1]
    assert found == truth and truth


def test_overlapping_occurrences(spark):
    docs = frame(spark, [(1, "ab" * 20)], "doc_id long, text string")
    items = frame(spark, [(1, "ab" * 10)], "item_id long, text string")
    assert sorted(r.q_start for r in quotes.occurrences(docs, items).collect()) == list(range(0, 21, 2))


def test_evidence_anchors_and_identity(spark):
    claims = frame(spark, [("a", "at 1200 K, NO2 formed", ["1200", "NO", "no2"]), ("b", "c++ (x)", ["c++"])], "claim_id string, window string, anchors array<string>")
    assert [(r.claim_id, r.missing) for r in quotes.missing_anchors(claims).collect()] == [("a", ["NO"])]
    i = acquisition.identity(F.lit("DOI 10.1/ab c. The laminar flame speed"), F.lit("10.1/abc"), F.lit("Laminar flames in tubes")).alias("i")
    assert spark.range(1).select(i).first().i == (False, 1 / 3, True)


def test_verdicts_take_the_first_rung(spark):
    flags = [
        ("q" * 30, None, False, False, False, "body", True, False, "no_artifact"), ("q" * 30, False, False, False, False, "body", True, False, "artifact_unreadable"), ("q", True, True, False, False, "body", True, False, "quote_not_found too_short"),
        ("q" * 30, True, False, False, True, "body", True, False, "quote_not_found semantic_discrepancy"), ("q" * 30, True, False, False, False, "body", True, False, "quote_not_found"), ("q" * 30, True, True, False, False, "references", False, True, "references_only"),
        ("q" * 30, True, True, False, False, "body", False, True, "identity_mismatch"), ("q" * 30, True, True, False, False, "body", True, True, "spans_missing"), ("q" * 30, True, True, False, False, "body", True, False, "grounded_exact"),
        ("q" * 30, True, False, True, False, "body", True, False, "grounded_fuzzy"),
    ]
    df = frame(spark, flags, "q string, r boolean, e boolean, n boolean, d boolean, s string, i boolean, m boolean, want string")
    assert all(r.got == r.want for r in df.select("want", quotes.verdict(*[F.col(c) for c in "qrendsim"]).alias("v")).select("want", F.concat_ws(" ", "v.status", "v.reason").alias("got")).collect())


def test_dedupe_and_covers(spark):
    hits = frame(spark, [("a", None, 1), ("b", "p", 2), ("a", "q", 3), ("a", "r", 4)], "key string, pdf string, ord int")
    assert {(r.key, r.pdf, r.position) for r in dedupe.upgraded(hits, ["key"], "ord", F.col("pdf").isNotNull()).collect()} == {("a", "q", 1), ("b", "p", 2)}
    assert {(r.key, r.pdf, r.position) for r in dedupe.latest_wins(hits, ["key"], "ord", ["pdf"]).collect()} == {("a", "r", 1), ("b", "p", 2)}
    held, fresh = frame(spark, [("a", "old", "x"), ("b", "old", "y")], "k string, note string, owner string"), frame(spark, [("a", "", "z"), ("c", "new", "z")], "k string, note string, owner string")
    assert {tuple(r) for r in dedupe.merged(held, fresh, "k", ["note"], ["owner"]).collect()} == {("a", "old", "x"), ("b", "old", "y"), ("c", "new", "z")}
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "node string, next string")
    found = {(r.node, r.reached) for r in dedupe.closure(edges).collect()}
    assert found == {(p, q) for p in "abc" for q in "abc"} | {("x", "y")}


def test_ranking(spark):
    names = frame(spark, [("g-1.5",), ("g-2",), ("g-2.10",), ("g-2.9",), ("h-9",), ("g-x",)], "n string")
    assert [r.n for r in ranking.version_order(names, "n", "g").collect()] == ["g-2.10", "g-2.9", "g-2", "g-1.5"]
    payload = frame(spark, [(1, '{"results":[{"url":"u"},{"url":3,"t":1},5]}'), (2, '[{"url":"v"}]'), (3, "broken"), (4, '{"x":1}')], "i long, payload string")
    assert [(r.i, r.position) for r in ranking.hits(payload).collect()][:1] == [(1, 0)] and {r.i for r in ranking.hits(payload).collect()} == {1, 2}
    places = frame(spark, [(1, [("publisher", "p", "P"), ("repository", None, "R"), ("repository", "r", "S")])], "i long, l array<struct<host_type string, pdf_url string, name string>>")
    assert places.select(ranking.best_location(F.col("l")).alias("b")).first().b == ("r", "S")


def test_versions_never_break_ties(spark):
    artifacts = frame(spark, [(s,) for s in "abcde"], "sha string")
    records = frame(spark, [("a", "x1", "p", "v2", True), ("b", "x2", "p", "v1", True), ("c", "x3", "p", "v2", True), ("c", "x4", "p", "v2", True), ("d", "x5", "p", "v2", False)], "sha string, extraction string, extractor string, code_sha string, usable boolean")
    found = {r.sha: (r.kind, r.extraction) for r in versions.current_selection(artifacts, records, frame(spark, [("p", "v2")], "extractor string, code_sha string")).collect()}
    assert found == {"a": ("selected", "x1"), "b": ("no_current_record", None), "c": ("multiple_current_records", None), "d": ("unusable_record_present", None), "e": ("no_records_stored", None)}


def test_integrity(spark):
    nodes = frame(spark, [("root", None), ("a", "root"), ("b", "a"), ("lonely", "root")], "node string, parent string")
    up = integrity.ancestors(spark, nodes)
    assert {(r.node, r.ancestor, r.depth) for r in up.collect()} == {("a", "root", 1), ("b", "a", 1), ("b", "root", 2), ("lonely", "root", 1)}
    assert [r.node for r in integrity.undecorated(nodes.select("node"), frame(spark, [("b",)], "node string"), up).collect()] == ["lonely"]
    assert {r.node for r in integrity.on_cycles(spark, frame(spark, [("a", "b"), ("b", "a"), ("c", "a")], "node string, parent string")).collect()} == {"a", "b"}
    parts = frame(spark, [("m", 0.3), ("m", 0.7), ("n", 0.5)], "g string, f double")
    assert [r.g for r in integrity.wrong_sums(parts, "g", "f").collect()] == ["n"]
    kinds = frame(spark, [("ppm", "mole_fraction", "ppm"), ("ppm", "mole_fraction", "%"), ("volume_percent", "mole_fraction", "%"), ("odd", "x", "y")], "basis string, quantity string, unit string")
    assert integrity.wrong_basis(kinds).count() == 2


def test_replay_has_three_outcomes(spark):
    texts = frame(spark, [(1, "hello world"), (2, "short")], "doc_id long, text string")
    spans = frame(spark, [(1, 0, 5, "hello"), (2, 0, 9, "short"), (3, 0, 1, "x"), (4, 0, 1, "y")], "doc_id long, start int, end int, recorded string")
    found = {r.doc_id: r.outcome for r in replay.outcomes(replay.checked_spans(spans, texts), "doc_id").collect()}
    assert found == {1: "verified", 2: "failed", 3: "unverifiable", 4: "unverifiable"}
    assert {r.side for r in replay.first_differences(texts, texts.limit(1)).collect()} == {"left"}


GRID = [(1, f"r{r}c{c}", 100.0 * c, 100.0 * c + 30, 10.0 * r + 0.2 * c, 8.0) for r in range(3) for c in range(3)]


def test_layout(spark):
    fragments = frame(spark, GRID, "page int, text string, x_start double, x_end double, baseline_y double, font_height double")
    cells = {(r.band, r.block): r.text for r in layout.cells(fragments, ["page"]).collect()}
    assert cells == {(r + 1, c + 1): f"r{r}c{c}" for r in range(3) for c in range(3)}
    regions = frame(spark, [(1, "q", 95.0, 135.0, -1.0, 5.0), (1, "z", 0.0, 1.0, 900.0, 901.0)], "page int, region_id string, x_start double, x_end double, y_top double, y_bottom double")
    assert {(r.region_id, r.left_text, r.right_text) for r in layout.neighbours(fragments, regions).collect()} == {("q", "r0c0", "r0c2"), ("z", None, None)}
    box = frame(spark, [(1, "f", -1.0, 150.0, -1.0, 25.0)], "page int, footprint_id string, x_start double, x_end double, y_top double, y_bottom double")
    assert layout.in_footprint(fragments, box).count() == 6
    assert [(r.footprint_id, r.n_rows) for r in layout.truncated_columns(fragments, box).collect()] == [("f", 3)]
    chain = frame(spark, [(1, y) for y in (1.0, 1.4, 1.8, 3.0)], "page int, baseline_y double")
    assert [r.band for r in layout.bands(chain, ["page"]).orderBy("baseline_y").collect()] == [1, 1, 1, 2]


def test_ledger(spark):
    requests = frame(spark, [(1, k, a) for k, a in enumerate([6.0, 5.0, 4.0, 1.0])], "run long, ord long, amt double")
    assert [r.admitted for r in ledger.admitted(requests, "run", "ord", "amt", 10.0, 9).orderBy("ord").collect()] == [True, False, True, False]
    assert ledger.admitted_natively(requests, "run", "ord", "amt", 10.0, 9).first()[2:] == (2, 10.0)
    runs = frame(spark, [(float("nan"), 2.0, "succeeded", "none"), (-1.0, 3.0, "succeeded", "none"), (None, 4.0, "failed", "tool_not_found"), (None, 5.0, "failed", "timeout"), (0.5, 9.0, "failed", "none")], "actual double, estimate double, status string, failure string")
    assert float(ledger.spend(runs.withColumn("g", F.lit(1)), ["g"]).first().consumed) == 10.5
    charges = frame(spark, [("2024-01-01 10:00:00", 5.0, None), ("2024-01-02 10:00:00", -2.0, "2024-01-01 00:00:00"), ("2024-01-02 11:00:00", 3.0, "2024-01-01 00:00:00")], "ts string, amount double, reserved string")
    assert {(str(r.day), float(r.total)) for r in ledger.daily_totals(charges, "ts", "amount", "reserved").collect()} == {("2024-01-01", 5.0), ("2024-01-02", 3.0)}
    legal = frame(spark, [("a", "b"), ("b", "c"), ("a", "c")], "previous string, state string")
    assert {(r.origin, r.target): r.path for r in ledger.paths(spark, legal).collect()}[("a", "c")] == ["a", "c"]
    steps = [("draft", "validated", None, True), ("draft", "running_t3", None, False), ("failed", "ready_for_planning", None, True), ("failed", "approved_for_execution", None, False)]
    df = frame(spark, steps, "a string, b string, f string, want boolean")
    assert all(r.got == r.want for r in df.select("want", ledger.can_step(F.col("a"), F.col("b"), F.col("f")).alias("got")).collect())
    calls = frame(spark, [("pro-1", 1_000_000, 0), ("odd", 1, 1), ("pro-1", None, 5)], "model string, input_tokens long, output_tokens long")
    prices = frame(spark, [("^pro", 2.0, 4.0, 1), (".*1$", 9.0, 9.0, 2)], "pattern string, input_rate double, output_rate double, place int")
    assert sorted(r.cost_usd for r in ledger.model_cost(calls, prices).collect()) == [2.0, 5.0, 5.0]


def test_acquisition(spark):
    requests = frame(spark, [("s1", "10.1/a", "Laminar flame speed of methane", "requested"), ("s2", "10.1/b", "Laminar flame speed of ammonia", "rejected"), ("s3", None, "Other", "fulfilled")], "slug string, doi string, title string, status string")
    files = frame(spark, [(1, "laminar flame speed of methane by nobody"), (2, "cooking"), (3, "laminar flame speed of methane and ammonia 10.1/b"), (4, "laminar flame speed of methane ammonia")], "file_id long, text string")
    assert {r.file_id: (r.slug, r.status) for r in acquisition.inferred(files, requests).collect()} == {1: ("s1", "matched"), 2: (None, "no_match"), 3: ("s2", "matched"), 4: (None, "ambiguous")}
    reasons = acquisition.queue_reason(frame(spark, [("p", 1, "fetch_failed"), ("p", 2, "paywalled"), ("q", 1, "unreadable")], "paper string, position int, reason string"), frame(spark, [("p", "complete"), ("q", "partial"), ("r", "partial"), ("s", "complete")], "paper string, coverage string"), "paper")
    assert {r.paper: r.reason for r in reasons.collect()} == {"p": "paywalled", "q": "unreadable", "r": "oa_lookup_incomplete", "s": "no_open_access_copy"}


def test_diagnostics(spark):
    assert [r.n for r in frame(spark, [("iteration_12",), ("odd",)], "x string").select(diagnostics.iteration_number(F.col("x")).alias("n")).collect()] == [12, -1]
    asked, ok, done = (frame(spark, [(1, x) for x in v], "g int, label string") for v in (["a", "b", "c"], ["a", "b"], ["a"]))
    assert diagnostics.quality(asked, ok, done, "g", "label").first() == (1, 3, 2, 1, ["b", "c"], False)


def test_providers_give_candidates_of_the_wanted_paper_only(spark):
    import json

    from veritrail.operators import providers

    doi = "10.1/x"
    answers = [
        ("openalex", {"best_oa_location": {"pdf_url": "a"}, "locations": [{"is_oa": True, "pdf_url": "b"}, {"is_oa": False, "pdf_url": "c"}, {"is_oa": True, "pdf_url": "a"}, 5]}, [("a", 0), ("b", 1)]),
        ("unpaywall", {"best_oa_location": None, "oa_locations": [{"url_for_pdf": "u"}, {"url_for_pdf": 7}]}, [("u", 1)]),
        ("crossref", {"message": {"link": [{"URL": "l", "content-type": "application/pdf", "intended-application": "text-mining"}, {"URL": "m", "content-type": "text/html", "intended-application": "text-mining"}]}}, [("l", 0)]),
        ("semantic_scholar", {"openAccessPdf": {"url": "s", "status": "GOLD"}}, [("s", 0)]),
        ("core", {"results": [{"doi": "https://doi.org/10.1/X", "downloadUrl": "d", "links": [{"type": "download", "url": "e"}], "sourceFulltextUrls": ["f", "d"]}, {"doi": "10.9/other", "downloadUrl": "z"}]}, [("d", 1), ("e", 1), ("f", 1)]),
        ("doaj", {"results": [{"bibjson": {"identifier": [{"type": "doi", "id": "10.1/x"}], "link": [{"type": "fulltext", "url": "h", "content_type": "HTML"}, {"type": "fulltext", "url": "p", "content_type": "pdf"}]}}]}, [("p", 0), ("h", 0)]),
        ("europepmc", {"resultList": {"result": [{"doi": "10.1/x", "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "pdf", "url": "q"}, {"documentStyle": "html", "url": "r"}]}}]}}, [("q", 1)]),
        ("chemrxiv", {"itemHits": [{"item": {"title": "The Title!", "asset": {"original": {"url": "t"}}}}, {"item": {"title": "Other", "asset": {"original": {"url": "w"}}}}]}, [("t", 2)]),
    ]
    rows = [(k, doi, "the title", name, json.dumps(payload)) for k, (name, payload, _) in enumerate(answers)] + [(99, doi, "t", "openalex", "no json"), (98, doi, "t", "core", "[1]")]
    found = {}
    for r in providers.candidates(frame(spark, rows, "paper int, doi string, title string, provider string, payload string")).orderBy("paper", "position").collect():
        found.setdefault(r.paper, []).append((r.url, r.tier))
    assert found == {k: want for k, (_, _, want) in enumerate(answers)}


def test_constructs_and_refuted_claims(spark):
    from veritrail.operators import stitching

    text = "😀 At 1200 K and 1.0/1.5 atm the speed was 35 cm/s; p = 10 bar\nrun 5\nK3 2.5 s-1 at 7K"
    found = stitching.constructs(frame(spark, [(1, text), (2, None), (3, "none")], "doc_id long, text string"))
    spans = {(text[r.value_start : r.value_end], text[r.unit_start : r.unit_end]): r for r in found.collect()}
    assert {("1200", "K"), ("35", "cm/s"), ("10", "bar"), ("7", "K")} <= set(spans) and ("1.5", "atm") not in spans and ("5", "K") not in spans
    at = lambda s, k=0: (text.index(s, k), text.index(s, k) + len(s))
    claim = lambda i, label, value, unit, q: (i, 1, *at(label), *at(value), *at(unit), q)
    claims = [claim(1, "speed", "35", "cm/s", "velocity"), claim(2, "At", "1200", "K", "pressure"), claim(3, "At", "35", "cm/s", "velocity"), claim(4, "the", "speed", "was", "velocity"), claim(5, "was", "cm/s", "35", "velocity")]
    df = frame(spark, claims, "claim_id int, doc_id long, label_start int, label_end int, value_start int, value_end int, unit_start int, unit_end int, quantity string")
    assert {r.claim_id: r.refutation for r in stitching.refuted(df, found).collect()} == {1: None, 2: "other_quantity", 3: "several_constructs", 4: "no_construct", 5: "other_place"}


def test_identity_is_a_strict_conjunction(spark):
    from veritrail.operators import identity

    body = "Laminar flame speeds of toluene in air\nJane Smith, 2012\nDOI 10.1016/j.cf.1\n" + "text " * 200
    cited = "A review of flames\nBob Roe 2020\n" + "text " * 200 + "\nReferences\nSmith, J. Laminar flame speeds of toluene in air (2012) 10.1016/j.cf.1"
    title = "Laminar flame speeds of toluene in air"
    rows = [
        (1, body, "10.1016/j.cf.1", title, ["Smith, J."], 2012, True), (2, cited, "10.1016/j.cf.1", title, ["Smith, J."], 2012, False), (3, body, None, title, ["Smith, J."], 2012, True),
        (4, body, None, title, [], 2012, False), (5, body, None, title, ["Smith, J."], 1999, False), (6, "Erratum: " + body, "10.1016/j.cf.1", title, ["Smith"], 2012, False),
        (7, body.replace("flame speeds", "ame speeds"), "10.1016/j.cf.1", title, ["Smith"], 2012, True), (8, body.replace("toluene", "benzene"), "10.1016/j.cf.1", title, ["Smith"], 2012, False),
    ]
    df = frame(spark, rows, "k int, text string, doi string, title string, authors array<string>, year int, want boolean")
    assert {r.k: r.identity for r in identity.confirmed(df).collect()} == {r[0]: r[-1] for r in rows}
    assert identity.missing_token("flow in a tue", "flow in a tube") is None and identity.missing_token("methanol flame", "methane flame") == "methane" and identity.missing_token("d2 flame", "h2 flame") == "h2"


def test_affixes_and_edges(spark):
    from veritrail.functions import affixes

    df = frame(spark, [(1, " ± "), (2, "(cid:12)"), (3, "≤"), (4, "x"), (5, ""), (6, "·")], "k int, x string")
    assert [r.a for r in df.orderBy("k").select(affixes.affix_class(F.col("x")).alias("a")).collect()] == ["sign", "sign", "relational", None, None, "exponent"]
    cases = [("1023K", 4, 5, True), ("Kinetics", 0, 1, False), ("12.5", 3, 4, False), ("1,000", 0, 1, False), ("1023K", 0, 4, True), ("a b", 2, 3, True), ("xy", 1, 1, True)]
    df = frame(spark, cases, "t string, s int, e int, want boolean")
    assert all(r.got == r.want for r in df.select("want", affixes.clean_edges(F.col("t"), F.col("s"), F.col("e")).alias("got")).collect())


def test_migrations(spark):
    from veritrail.operators import migrations

    old = frame(spark, [("r", 1, ["a", "b"]), ("q", 2, None)], "report_id string, calls int, covered array<string>")
    made = migrations.covered_pairs(migrations.report_to_passes(old, ["calls"])).orderBy("report_id").collect()
    assert made[1].passes == [(1,)] and made[1].covered == [("a", "root"), ("b", "root")] and made[0].covered == []
    assert migrations.manifest(frame(spark, [("s", None)], "slug string, status string")).first() == ("s", "requested", "", 0, "")
    held, fresh = frame(spark, [("a", 1)], "sha string, n int"), frame(spark, [("a", 2), ("b", 3)], "sha string, n int")
    assert {tuple(r) for r in migrations.appended(held, fresh).collect()} == {("a", 1), ("b", 3)}


def test_region_refusals_in_order_up_to_the_first_that_halts(spark):
    fragments = frame(spark, [
        (1, 1, "3.14", 100.0, 120.0, 50.0, False, True), (1, 2, "x -", 60.0, 95.0, 50.0, False, True), (1, 3, "-5", 130.0, 140.0, 50.0, False, True), (1, 4, "far", 10.0, 20.0, 90.0, False, True),
        (2, 5, "7", 100.0, 110.0, 50.0, False, False), (2, 6, "over", 105.0, 125.0, 51.0, False, True), (3, 7, "1", 100.0, 110.0, 50.0, True, True), (4, 8, "2", 100.0, 110.0, 50.0, False, True), (4, 9, "y", 50.0, 40.0, 50.0, False, True),
        (6, 10, "4", 100.0, 110.0, 50.0, False, True), (6, 11, "-3", 111.0, 115.0, 53.0, False, True), (6, 12, "9", 50.0, 90.0, 50.0, False, True),
    ], "page int, fragment_id long, text string, x_start double, x_end double, baseline_y double, rotated boolean, mapped boolean")
    pages = frame(spark, [(1, True, True), (2, True, True), (3, True, True), (4, True, True), (5, True, False), (6, True, True)], "page int, available boolean, complete boolean")
    box = (99.0, 121.0, 50.0)
    asked = [("a", 1, *box, [1]), ("b", 1, *box, []), ("c", 1, *box, [99]), ("d", 1, *box, [4]), ("e", 2, *box, [5]), ("f", 3, *box, [7]), ("g", 4, *box, [8]), ("h", 5, *box, [1]), ("i", 9, *box, [1]), ("j", 1, 5.0, 5.0, 1.0, [1]), ("k", 6, 99.0, 110.5, 50.0, [10]), ("l", 1, 129.0, 141.0, 50.0, [3])]
    regions = frame(spark, asked, "region_id string, page int, x_start double, x_end double, baseline_y double, members array<long>")
    found = {r.region_id: r.refusals for r in layout.region_refusals(fragments, regions, pages).collect()}
    assert found == {
        "a": ["adjacent_unreadable"], "b": ["empty"], "c": ["foreign_member"], "d": ["member_outside_region"], "e": ["unmapped_member", "straddled"], "f": ["rotated_member"], "g": ["uncomparable_neighbour"],
        "h": ["page_incomplete"], "i": ["extraction_unavailable"], "j": ["invalid_geometry"], "k": ["adjacent_unreadable"], "l": [],
    }


def test_grounded_tokens(spark):
    from veritrail.operators import grounding

    text = "😀 T = 1023K, range 1000-1200 K; the K value 5 and 5 Kinetics a.b(c)"
    claims = [
        ("1023", "value", None, "grounded"), ("1200", "value", None, "fragment_of_a_numeral"), ("1000-1200", "value", None, "grounded"), ("K", "unit", 0, "grounded"), ("K", "unit", 3, "unclean_edge"), ("K", "unit", None, "ambiguous"),
        ("5", "value", None, "ambiguous"), ("5", "value", 1, "grounded"), ("5", "value", 7, "no_such_occurrence"), ("zzz", "label", None, "not_found"), ("a.b(c)", "label", None, "grounded"), ("inetics", "label", None, "unclean_edge"),
    ]
    df = frame(spark, [(1, *c) for c in claims] + [(2, "x", "label", None, "no_text")], "doc_id long, token string, role string, occurrence int, want string")
    rows = grounding.grounded(df, frame(spark, [(1, text)], "doc_id long, text string")).collect()
    assert [(r.token, r.status) for r in rows if r.status != r.want] == [] and all(text[r.start : r.end] == r.token for r in rows if r.status == "grounded")


def test_near_matches_measure_few_windows(spark, monkeypatch):
    """The windows measured by difflib are those that may reach the threshold; results are those of measuring every window."""
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeiorstn") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    asked = [(i, line(rnd.randint(6, 30))) for i in range(12)]
    texts = []
    for i in range(16):
        changed = list(rnd.choice(asked)[1])
        for _ in range(rnd.randrange(len(changed) // 14 + 1)):
            at = rnd.randrange(len(changed))
            changed[at : at + 1] = rnd.choice([[], ["z"], [changed[at], "e"]])
        texts.append(f"{line(20)} {''.join(changed)} {line(20)}")
    asked = [(i, q) for i, q in asked if len(q) >= quotes.SHORTEST]
    want, all_ = set(), 0
    for d, hay in enumerate(texts):
        for i, q in asked:
            starts = quotes._grid(len(q), len(hay)).tolist()
            all_ += len(starts)
            best = max(((SequenceMatcher(None, hay[s : s + len(q)], q).ratio(), -s) for s in starts), default=(0, 0))
            if q not in hay and best[0] >= quotes.THRESHOLD:
                want.add((d, i, -best[1]))
    found = quotes.near_matches(frame(spark, list(enumerate(texts)), "doc_id long, text string"), frame(spark, asked, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.q_start) for r in found} == want and len(want) > 3
    measured = []
    monkeypatch.setattr(quotes, "SequenceMatcher", lambda *a, **k: measured.append(1) or SequenceMatcher(*a, **k))
    for hay in texts:
        for i, q in asked:
            quotes.like_windows(hay, q, quotes.gram_places(hay, q), quotes.THRESHOLD)
    assert len(measured) <= 2 * len(texts) < all_ / 10
