"""Driver queries over documents, pages and benchmark: text, quotes, numerals, hosts. Each states what it exercises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import canonical, numerals, text, web
from veritrail.operators import acquisition, quotes, sections
from veritrail.sources import extraction
from veritrail.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL for DuckDB if it can be put so."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_NORM = "trim(regexp_replace(lower({}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_DOC, _ITEM = _NORM.format("d.text"), _NORM.format("b.text")


@query(f"""
    SELECT b.item_id, d.doc_id, instr({_DOC}, {_ITEM}) - 1 AS q_start
    FROM benchmark b JOIN documents d ON contains({_DOC}, {_ITEM}) WHERE length({_ITEM}) >= 20""")
def quote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First exact place of each benchmark item in each document, after normalization."""
    return quotes.first_places(quotes.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query(f"""
    WITH hits AS (SELECT b.item_id, d.doc_id, {_DOC} AS h, {_ITEM} AS q FROM benchmark b JOIN documents d ON contains({_DOC}, {_ITEM}) WHERE length({_ITEM}) >= 20),
    places AS (SELECT item_id, doc_id, h, q, unnest(generate_series(0, length(h) - length(q))) AS q_start FROM hits)
    SELECT item_id, doc_id, q_start FROM places WHERE substring(h, q_start + 1, length(q)) = q""")
def quote_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exact places, overlapping ones too."""
    return quotes.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_JOINED = "trim(regexp_replace(replace(lower(regexp_replace({}, '([0-9A-Za-z_])-[ \\t\\r\\f\\v]*\\n\\s*([0-9A-Za-z_])', '\\1\\2', 'g')), 'ß', 'ss'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"""
    WITH d AS (SELECT doc_id, {_JOINED.format("text")} AS h FROM documents), b AS (SELECT item_id, {_JOINED.format("text")} AS q FROM benchmark)
    SELECT item_id, doc_id, q AS quote, (SELECT count(*) FROM range(1, length(h) - length(q) + 2) AS r(i) WHERE substring(h, i, length(q)) = q) AS n_places
    FROM d JOIN b ON contains(h, q) WHERE length(q) >= 20""")
def quote_raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of benchmark items by full normalization, cut out of the raw texts at their raw offsets and normalized again."""
    docs = table(spark, sf_dir, "documents")
    found = quotes.raw_places(docs, table(spark, sf_dir, "benchmark")).join(docs.select("doc_id", "text"), "doc_id")
    cut = text.normalized_with_map(F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))["text"]
    return found.select("item_id", "doc_id", cut.alias("quote")).groupBy("item_id", "doc_id", "quote").agg(F.count("*").alias("n_places"))


@query(f"""
    WITH hits AS (SELECT b.item_id, d.doc_id, {_DOC} AS h, length({_ITEM}) AS n, instr({_DOC}, {_ITEM}) - 1 AS s
                  FROM benchmark b JOIN documents d ON contains({_DOC}, {_ITEM}) WHERE length({_ITEM}) >= 20)
    , cuts AS (SELECT *, greatest(0, s - 600) AS lo, length(regexp_extract(substring(h, greatest(0, s - 600) + 1, s - greatest(0, s - 600)), '(?s)^.*[.!?\\n]')) AS b, length(regexp_extract(substring(h, s + n + 1, 600), '(?s)^[^.!?\\n]*[.!?\\n]')) AS a FROM hits),
    ends AS (SELECT *, CASE WHEN b > 0 THEN lo + b ELSE greatest(0, s - 300) END AS l, CASE WHEN a > 0 THEN s + n + a ELSE least(length(h), s + n + 300) END AS r FROM cuts)
    SELECT item_id, doc_id, substring(h, l + 1, r - l) AS evidence FROM ends""")
def evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around each first exact place."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    places = quotes.first_places(quotes.occurrences(docs, items))
    hays = docs.select("doc_id", text.normalized(F.col("text")).alias("hay"))
    sizes = items.select("item_id", F.length(text.normalized(F.col("text"))).alias("n"))
    joined = places.join(sizes, "item_id").join(hays, "doc_id")
    return joined.select("item_id", "doc_id", quotes.evidence_window(F.col("hay"), F.col("q_start"), F.col("q_start") + F.col("n")).alias("evidence"))


@query()
def quote_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near matches of benchmark items, with what the difference means. The ratio is difflib's, which SQL lacks."""
    return quotes.near_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""
    WITH hits AS (SELECT DISTINCT b.item_id FROM benchmark b JOIN documents d ON contains({_DOC}, {_ITEM}) WHERE length({_ITEM}) >= 20)
    SELECT b.item_id, CASE WHEN length({_ITEM}) < 20 OR h.item_id IS NULL THEN 'quote_not_found' ELSE 'grounded_exact' END AS status, CASE WHEN length({_ITEM}) < 20 THEN 'too_short' END AS reason
    FROM benchmark b LEFT JOIN hits h ON b.item_id = h.item_id""")
def verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status for every benchmark item against the whole corpus; each item comes out exactly once."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hit = quotes.occurrences(docs, items).select("item_id").distinct().withColumn("hit", F.lit(True))
    no, yes = F.lit(False), F.lit(True)
    status = quotes.verdict(text.normalized(F.col("text")), yes, F.coalesce("hit", no), no, no, F.lit("body"), yes, no)
    return items.join(hit, "item_id", "left").select("item_id", status.alias("v")).select("item_id", "v.status", "v.reason")


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized(F.col("text")).alias("norm"))


@query()
def norm_text_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full normalization with its offset map: sizes, and that the first and last offsets lie in the text."""
    made = table(spark, sf_dir, "documents").select("doc_id", "text", text.normalized_with_map(F.col("text")).alias("m"))
    whole = text.raw_span(F.col("m.offsets"), F.lit(0), F.size("m.offsets"), F.length("text"))
    return made.select("doc_id", F.length("m.text").alias("n_norm"), F.size("m.offsets").alias("n_map"), whole["start"].alias("raw_start"), whole["end"].alias("raw_end"))


@query("SELECT doc_id, sha256(text) AS sha, sha256('plain|' || sha256(text) || '|' || sha256(lower(text))) AS binding FROM documents")
def sha_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content addresses and derivation bindings."""
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha"), canonical.derivation_binding(F.lit("plain"), sha, F.sha2(F.lower("text"), 256)).alias("binding"))


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    e AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM l)
    SELECT doc_id, line_no, length(line) AS n_chars,
        coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start
    FROM e""")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), "line_start")


_SHORT_LINE = r"regexp_matches(line, '[.|!]{1,}\s*$')"


@query(rf"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    e AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM l),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start FROM e),
    u AS (SELECT *, row_number() OVER w AS n, (length(line) < 120 AND regexp_matches(line, '[.]\s*$'))::INT AS hit FROM o WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    d AS (SELECT *, avg(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS density FROM u),
    i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM d WHERE density >= 0.6)
    SELECT doc_id, min(line_start) AS region_start, max(line_start + length(line)) AS region_end, count(*) AS n_lines, (count(*) >= 8 AND avg(hit) >= 0.7) AS confident
    FROM i GROUP BY doc_id, island""")
def dense_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of dense lines by the bibliography rule, with short sentences for citations, which these texts lack."""
    mark = (F.length("line") < 120) & F.col("line").rlike(r"[.]\s*$")
    return sections.bibliography_regions(table(spark, sf_dir, "documents"), citation=mark)


@query()
def bibliography_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by the citation shapes themselves; DuckDB's regexps lack some of them."""
    return sections.bibliography_regions(table(spark, sf_dir, "documents"))


@query("""
    WITH b AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2000)) AS s FROM documents),
    t AS (SELECT doc_id, list_filter(regexp_split_to_array(substring(text, s + 1, 2000), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS tokens FROM b),
    m AS (SELECT doc_id, (list_sum(list_transform(tokens, lambda x: length(x)))::DOUBLE / len(tokens) >= 12)::INT AS lost FROM t WHERE len(tokens) > 0)
    SELECT d.doc_id, coalesce(round(avg(m.lost), 9), 0.0) AS lost_share, coalesce(avg(m.lost), 0.0) >= 0.25 AS spacing_lost
    FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id""".replace("\\\\", "\\"))
def space_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = table(spark, sf_dir, "documents").select("doc_id", text.space_loss(F.col("text")).alias("share"))
    return shares.select("doc_id", F.round("share", 9).alias("lost_share"), (F.col("share") >= text.SPACE_LOSS_SHARE).alias("spacing_lost"))


@query("SELECT doc_id, length(text) >= 9000 AND regexp_matches(text, '(?im)^\\s*(?:[0-9]+[.\\s]*)?(?:references|bibliography|works cited|literature cited)\\s*$') AS full_article, greatest(8000, length(text) // 3 + 4000) AS tokens FROM documents")
def full_article_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_full_article(F.col("text")).alias("full_article"), text.estimated_tokens(F.col("text")).alias("tokens"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages, by an HTML parser that decodes entities."""
    made = table(spark, sf_dir, "pages").select("page_id", extraction.html_text("html").alias("text"))
    return made.select("page_id", "text", F.length("text").alias("n_chars"))


@query("""
    WITH h AS (SELECT page_id, length(html) AS size, html, lower(regexp_replace(substring(html, 1, 4096), '^\\s+', '')) AS head FROM pages)
    SELECT page_id, size, CASE WHEN html IS NULL THEN NULL WHEN head LIKE '<html%' OR head LIKE '<!doctype%' THEN 'text/html' ELSE 'text/plain' END AS fetched,
        CASE WHEN html IS NULL THEN NULL WHEN substring(hex(encode(html)), 8193, 1) IN ('8', '9', 'A', 'B') THEN 'application/octet-stream' WHEN head LIKE '<?xml%' OR head LIKE '<article%' OR head LIKE '<!doctype article%' THEN 'application/xml' WHEN head LIKE '<html%' OR head LIKE '<!doctype html%' THEN 'text/html' ELSE 'text/plain' END AS dropped FROM h""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of pages as fetched and as dropped; a dropped one whose first 4096 bytes end within a character counts as bytes."""
    raw, known = F.encode("html", "UTF-8"), F.col("html").isNotNull()
    fetched, dropped = F.when(known, extraction.fetched_type(raw)), F.when(known, extraction.content_type(raw))
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("size"), fetched.alias("fetched"), dropped.alias("dropped"))


@query("""
    SELECT doc_id, NOT contains(text, '–') AND regexp_matches(text, '[0-9]+e[0-9]+') AS suspects_dash_corruption, contains(text, 'þ') AS has_thorn_plus_marker,
        contains(text, '¼') AS has_equals_ambiguity_marker, contains(text, '/C0') AS has_slash_c0_minus_marker, regexp_matches(text, '[0-9]+\\s+6\\s+[0-9]+') AS has_ascii6_uncertainty_marker
    FROM documents""")
def glyph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", numerals.glyph_health(F.col("text")).alias("g")).select("doc_id", "g.*")


@query()
def numerals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean numerals of documents, parsed. The pattern looks behind, which DuckDB's regexps cannot."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(numerals.candidates(F.col("text"))).alias("n", "span"))
    return found.select("doc_id", "n", "span", numerals.parsed(F.col("span")).alias("p")).select("doc_id", "n", "span", "p.kind", "p.text", "p.value", "p.low", "p.high", "p.reason")


@query("""
    WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '' WHEN 1 THEN p_size || '.50' WHEN 2 THEN p_size || '-' || (p_size + 3) WHEN 3 THEN p_size || '_0' ELSE p_size || 'e2' END AS span FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN 'unresolvable' WHEN 2 THEN 'range' ELSE 'scalar' END AS kind,
        CASE p_partkey % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN replace(span, 'e2', 'e+2') ELSE span END AS text,
        CASE p_partkey % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE span::DOUBLE END AS value,
        CASE WHEN p_partkey % 5 = 2 THEN split_part(span, '-', 1)::DOUBLE END AS low, CASE WHEN p_partkey % 5 = 2 THEN split_part(span, '-', 2)::DOUBLE END AS high,
        CASE WHEN p_partkey % 5 = 3 THEN 'digit_separator' END AS reason
    FROM p""")
def numeral_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made of part sizes: plain, decimal, range, separator and exponent."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    span = F.when(k == 0, size).when(k == 1, F.concat(size, F.lit(".50"))).when(k == 2, F.concat(size, F.lit("-"), (F.col("p_size") + 3).cast("string"))).when(k == 3, F.concat(size, F.lit("_0"))).otherwise(F.concat(size, F.lit("e2")))
    made = table(spark, sf_dir, "part").select("p_partkey", numerals.parsed(span).alias("p"))
    return made.select("p_partkey", "p.kind", "p.text", "p.value", "p.low", "p.high", "p.reason")


_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '[.]$', '')"


@query(f"SELECT page_id, {_HOST} AS host, ({_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') OR {_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org')) AS admissible FROM pages")
def host_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is listed or below a listed one."""
    hosts = spark.sql("SELECT * FROM VALUES ('example.com'), ('example.org') AS t(host)")
    return web.admissible(table(spark, sf_dir, "pages").select("page_id", "url"), hosts).select("page_id", "host", "admissible")


@query("""
    SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^[a-z]+://[^/?#]*@') AND NOT regexp_matches(url, '^[a-z]+://[^/?#]*:[0-9]+') AS safe FROM pages""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.is_safe_url(F.col("url")).alias("safe"))


@query(r"""
    WITH k AS (SELECT event_id, json_keys(props) AS names, props FROM events),
    f AS (SELECT event_id, unnest(names) AS name, props FROM k)
    SELECT event_id, name, regexp_matches(name, '(?i)key|token|secret|password|authorization|credential') AS secret_key FROM f""")
def secret_key_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of event properties and whether they tell of secrets."""
    names = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.explode(names).alias("name")).select("event_id", "name", web.is_secret_key(F.col("name")).alias("secret_key"))


@query(r"""
    WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]+ ?= ?[^ \t\n\r\f\v]+')) AS field FROM documents),
    s AS (SELECT doc_id, trim(split_part(field, '=', 1)) AS name, trim(substring(field, length(split_part(field, '=', 1)) + 2), ' "') AS v FROM f)
    SELECT doc_id, name, CASE WHEN regexp_matches(name, '(?i)key|token|secret|password|authorization|credential') OR regexp_matches(v, '(sk-|AIza|ghp_|gho_|ghu_|ghs_|ghr_|xox[a-z]-)[A-Za-z0-9_\-]{6,}')
        OR (regexp_matches(v, '^[A-Za-z0-9_\-]{20,}$') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')) THEN '[REDACTED]' ELSE v END AS value FROM s""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value fields in documents with secret values redacted."""
    fields = F.regexp_extract_all("text", F.lit(r"[A-Za-z_]+ ?= ?[^ \t\n\r\f\x0B]+"), F.lit(0))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(fields).alias("field"))
    name = F.split_part("field", F.lit("="), F.lit(1))
    value = F.btrim(F.substr("field", F.length(name) + 2), F.lit(' "'))
    return found.select("doc_id", F.trim(name).alias("name"), web.redacted_value(F.trim(name), value).alias("value"))


@query(r"""
    WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://doi.org/10.1016/J.X.' || page_id WHEN 1 THEN 'doi: 10.1021/abc.' || page_id ELSE 'isbn-' || page_id END AS raw, url FROM pages)
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN '10.1016/j.x.' || page_id WHEN 1 THEN '10.1021/abc.' || page_id END AS doi,
        CASE page_id % 3 WHEN 0 THEN '10.1016' WHEN 1 THEN '10.1021' END AS prefix,
        CASE page_id % 3 WHEN 0 THEN '10.1016-j.x.' || page_id WHEN 1 THEN '10.1021-abc.' || page_id
            ELSE regexp_replace(substring(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '^-+|-+$', '', 'g') || '-' || substring(sha256(lower(trim(url))), 1, 8) END AS slug
    FROM t""")
def doi_and_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs in several spellings, their registrants and safe names."""
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("https://doi.org/10.1016/J.X."), n)).when(k == 1, F.concat(F.lit("doi: 10.1021/abc."), n)).otherwise(F.concat(F.lit("isbn-"), n))
    made = table(spark, sf_dir, "pages").select("page_id", "url", raw.alias("raw"))
    return made.select("page_id", text.normalized_doi(F.col("raw")).alias("doi"), text.doi_prefix(F.col("raw")).alias("prefix"), text.slug(text.normalized_doi(F.col("raw")), F.col("url")).alias("slug"))


@query("""
    WITH w AS (SELECT b.item_id, b.text, list_distinct(list_filter(string_split(trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND NOT list_contains(['and', 'for', 'from', 'the', 'with', 'using', 'via', 'study', 'studies', 'analysis', 'effect', 'effects', 'new', 'novel', 'high', 'low'], x))) AS words FROM benchmark b),
    s AS (SELECT b.item_id, d.doc_id, len(list_filter(b.words, lambda x: contains(lower(substring(d.text, 1, 6000)), x)))::DOUBLE / len(b.words) AS share FROM w b JOIN documents d ON contains({doc}, {item}) WHERE length({item}) >= 20 AND len(b.words) > 0)
    SELECT item_id, doc_id, round(share, 9) AS share, share >= 0.8 AS ok FROM s""".format(doc=_DOC, item=_ITEM))
def title_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of an item's words in the front of the documents that hold the item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    places = quotes.first_places(quotes.occurrences(docs, items)).select("item_id", "doc_id")
    joined = places.join(items.select("item_id", F.col("text").alias("title")), "item_id").join(docs, "doc_id")
    i = acquisition.identity(F.col("text"), F.lit(None).cast("string"), F.col("title"))
    return joined.select("item_id", "doc_id", i.alias("i")).select("item_id", "doc_id", F.round("i.share", 9).alias("share"), "i.ok")
