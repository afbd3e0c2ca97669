import re

from tests.llm.helpers import alnum_words, empty_docs, hard_docs
from veritrail.llm import licenses, queries, url_filters
from veritrail.llm.licence_rules import BASE, Rule, rules

URLS = [
    (1, "https://www.example.com/en/a?x=1"), (2, "https://blog.example.com/en/"), (3, "http://EXAMPLE.com/en"), (4, "ftp://x.net/fr/q#f"), (5, "https://x.net"), (6, None), (7, "no scheme"),
    (8, ""), (9, "http://com/"), (10, "http://a.b.c.example.com/en/" + "d/" * 3000), (None, "https://a.com/"), (11, "https://x.net/es/#a"), (11, "https://x.net/es/#a"), (12, "https://notexample.com/en/"),
    (13, "http://net/fr/://com/"),
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_every_url_is_judged_as_by_hand(spark):
    df = spark.createDataFrame([(i, u, "h", "r", "p") for i, u in URLS], "page_id long, url string, host string, rule string, prefix string")
    got = sorted(map(tuple, url_filters.judge(df, queries.url_rules(spark)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u in URLS], key=str)


def test_empty_rules_and_empty_table(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r.verdict for r in url_filters.judge(df, none, default="block").collect()} == {"block"}
    assert url_filters.judge(df.limit(0), queries.url_rules(spark)).count() == 0


def test_paths_without_final_slash_and_ties(spark):
    some = spark.createDataFrame([("a.com", "/en", "block"), ("a.com", "/en", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.com/english"), (2, "http://a.com/e")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(df, some).collect()} == {1: ("a.com/en", "block"), 2: (None, "allow")}


def test_many_equal_rows_come_back(spark):
    df = spark.range(10_000).selectExpr("1L AS page_id", "'http://a.com/' AS url")
    assert url_filters.judge(df, queries.url_rules(spark)).count() == 10_000


def test_no_python_in_the_plans(spark):
    for plan in (url_filters.judge(spark.createDataFrame(URLS, "page_id long, url string"), queries.url_rules(spark)), licenses.scan(empty_docs(spark))):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().optimizedPlan().toString())


def brute_base(text):
    w = alnum_words(text)
    found = [(k, label) for label, phrase in BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "Licensed Under the MIT-License; under the mit license", "CC-BY-NC 4.0 and cc by cc by nc", "Apache License, Version 2.0!", "under the\nmit\tlicense" * 2, "mit licenses", "under thé mit license",
    "gnu general public license version 3 or later", "nothing at all", "the mit license " * 400, "under the mit license " * 3,
]


def test_base_places_as_by_hand(spark):
    df = hard_docs(spark, [(100 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)])
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(r.doc_id, *brute_base(r.text)) for r in df.collect()], key=str)
    assert licenses.scan(empty_docs(spark)).count() == 0


def test_all_labels_hold_base_labels_and_scores_are_shares(spark):
    rows = licenses.scan(hard_docs(spark, [(100 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)])).collect()
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert {r.labels for r in rows if r.doc_id == 106} == {"gpl-3+"}


def test_contained_detections_are_suppressed_by_priority(spark):
    listed = [Rule("low", 1, 0.3, "a", "a b c"), Rule("inside", 1, 0.4, "b", "b c"), Rule("strong", 3, 0.9, "b", "b"), Rule("same", 1, 0.2, "a", "a b c")]
    df = spark.createDataFrame([(1, "x a b c")], "doc_id long, text string")
    assert licenses.scan(df, listed=listed).first().labels == "low,strong"


def test_suppression_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    listed = [Rule(f"r{k}", rng.randrange(1, 5), 0.5, "w", " ".join(rng.choice(("wa", "wb", "w.", ".{1,6}? wb")) for _ in range(rng.randrange(1, 4)))) for k in range(12)]
    texts = [" ".join(rng.choice(("wa", "wb", "wc")) for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), listed=listed).collect()}
    for i, t in enumerate(texts):
        norm, found = f" {t} ", []
        for k, rule in enumerate(listed):
            for m in re.finditer(f" (?:{rule.pattern})(?= )", norm):
                found.append((norm[: m.start()].count(" "), norm[: m.start()].count(" ") + m[0].count(" "), rule.priority, k, rule.label))
        above = lambda a, b: (a[0], -a[1], -a[2], a[3]) < (b[0], -b[1], -b[2], b[3])
        kept = {d[4] for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and above(o, d) for o in found)}
        assert got[i] == ",".join(sorted(kept)), (t, found)


def sample(pattern, rng):
    """A random text that a pattern of literals, branches, repeats and classes matches."""
    import re._constants as c
    import re._parser as parser

    def make(items):
        out = ""
        for op, x in items:
            if op is c.LITERAL:
                out += chr(x)
            elif op is c.IN:
                out += chr(rng.choice([v for o, v in x if o is c.LITERAL] or [v[0] for o, v in x if o is c.RANGE]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += "".join(make(x[2]) for _ in range(rng.randint(x[0], min(x[1], x[0] + 3))))
            elif op is c.SUBPATTERN:
                out += make(x[3])
            elif op is c.BRANCH:
                out += make(rng.choice(x[1]))
            elif op is c.ANY:
                out += "z"
            elif op is not c.ASSERT_NOT:
                raise AssertionError(op)
        return out

    return make(parser.parse(pattern))


def test_hundreds_of_rules_compile_and_match_only_texts_with_their_keyword():
    import random

    rng = random.Random(1)
    assert len(rules()) >= 300
    for r in rules():
        for _ in range(12):
            text = sample(r.pattern, rng)
            assert r.keyword in text, (r, text)
