"""Nested records of evidence: a walk over their schema, and their re-verification against the texts that they cite.

An envelope is one row: attribution (with attribution_ref), a subject that is either labelled or refused with a reason,
scalar claims with a measured value and perhaps an uncertainty, categorical claims, and statements that were left
unextracted. A reference names a node and a locator (kind, start, end); beside most stands the text read there, which
makes the two a pair that must agree. Three kinds of references have no text beside them: they support a reading
and prove no more than that a place exists. Names of findings and gaps are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions import places, units
from veritrail.operators import boundaries
from veritrail.operators.replay import outcome

#: Fields by which the schema walk knows references, measured values and uncertainties.
REF, VALUE, UNCERTAINTY = ("node_id", "locator"), ("quantity_kind", "unit_raw"), ("kind", "basis", "scale")
#: The inventory of pairs, written apart from the walk: (place of a reference, place of the text beside it).
PAIRS = (
    ("subject.label_ref", "subject.label_raw"),
    ("scalar_claims[*].label_ref", "scalar_claims[*].label_raw"),
    ("scalar_claims[*].value.value_ref", "scalar_claims[*].value.raw_text"),
    ("scalar_claims[*].value.unit_ref", "scalar_claims[*].value.unit_raw"),
    ("scalar_claims[*].uncertainty.upper.value_ref", "scalar_claims[*].uncertainty.upper.raw_text"),
    ("scalar_claims[*].uncertainty.upper.unit_ref", "scalar_claims[*].uncertainty.upper.unit_raw"),
    ("scalar_claims[*].uncertainty.lower.value_ref", "scalar_claims[*].uncertainty.lower.raw_text"),
    ("scalar_claims[*].uncertainty.lower.unit_ref", "scalar_claims[*].uncertainty.lower.unit_raw"),
    ("categorical_claims[*].label_ref", "categorical_claims[*].label_raw"),
    ("categorical_claims[*].token_ref", "categorical_claims[*].token_raw"),
    ("unextracted[*].label_ref", "unextracted[*].label_raw"),
)
#: References that support a reading: (claim, its text, the reference).
SUPPORTS = (("attribution", "attribution", "attribution_ref"), ("subject", "subject.reason", "subject.reason_ref"), ("unextracted[*]", "unextracted[*].reason", "unextracted[*].statement_ref"))
#: The only reference fields without a text beside them, and kinds of uncertainty that state nothing.
UNPAIRED, STATES_NOTHING = ("attribution_ref", "reason_ref", "statement_ref"), ("unknown", "unspecified_percentage")
#: The inventory of uncertainties.
UNCERTAIN = ("scalar_claims[*].uncertainty",)
#: Nodes of an envelope that a look-up reads one after another; of more, those of one shelf.
SHELF = 16


def _is(kind: T.DataType, has: Iterable[str]) -> bool:
    return isinstance(kind, T.StructType) and set(has) <= set(kind.names)


def _matches(kind: T.DataType, has: Iterable[str]) -> list[T.StructType]:
    """The struct types within a type that have the given fields."""
    if isinstance(kind, T.ArrayType):
        return _matches(kind.elementType, has)
    if isinstance(kind, T.MapType):
        return _matches(kind.valueType, has)
    if not isinstance(kind, T.StructType):
        return []
    return [kind] * _is(kind, has) + [m for f in kind for m in _matches(f.dataType, has)]


def _sites(at: Column, kind: T.DataType, path: Column | None, has: tuple[str, ...], fields: tuple[str, ...], none: Column) -> Column:
    """array<struct<path, fields>> of the structs with the given fields in a column of a type; none is that array without any. No path gives none."""
    on = lambda *more: None if path is None else F.concat(path, *more)
    if isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(at, lambda x, i: _sites(x, kind.elementType, on(F.lit("["), i.cast("string"), F.lit("]")), has, fields, none)))
        return F.coalesce(found, none)
    if isinstance(kind, T.MapType):
        found = F.flatten(F.transform(F.map_entries(at), lambda e: _sites(e["value"], kind.valueType, on(F.lit("["), e["key"].cast("string"), F.lit("]")), has, fields, none)))
        return F.coalesce(found, none)
    named = [] if path is None else [path.alias("path")]
    here = [F.when(at.isNotNull(), F.array(F.struct(*named, *[at[f].alias(f) for f in fields]))).otherwise(none)] if _is(kind, has) else []
    below = [_sites(at[f.name], f.dataType, on(F.lit(f".{f.name}")), has, fields, none) for f in kind if _matches(f.dataType, has)]
    return _joined([*here, *below])


def _walk(rows: DataFrame, key: str, has: tuple[str, ...], fields: tuple[str, ...], paths: bool = True) -> Column:
    """array<struct<path, fields>> of every struct that has the fields ``has``, wherever the schema holds one; without paths on demand."""
    tops = [f for f in rows.schema if f.name != key and _matches(f.dataType, has)]
    if not tops:
        raise ValueError(f"no column of {rows.columns} holds a struct with {has}")
    kind = _matches(tops[0].dataType, has)[0]
    item = T.StructType([T.StructField("path", T.StringType())] * paths + [*[T.StructField(f, kind[f].dataType) for f in fields]])
    none = F.expr(f"cast(array() as array<{item.simpleString()}>)")
    return _joined([_sites(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name) if paths else None, has, fields, none) for f in tops])


def _joined(arrays: list[Column]) -> Column:
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def walked(rows: DataFrame, key: str, has: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """(key, path, fields): every struct that has the fields ``has``, wherever the schema holds one, arrays in arrays too.

    Paths are dotted, with indices from 0 in brackets (map keys for maps). Structs that are null have no row. All
    such structs must agree in the types of ``fields``. The walk is of the schema: one expression within the row, no shuffle.
    """
    return rows.select(key, F.inline(_walk(rows, key, has, fields)))


def kinds_walked(rows: DataFrame, key: str, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, path, kind): every struct of each kind, which the fields of the kind tell; the rows are read once."""
    named = lambda name: lambda x: F.struct(x["path"].alias("path"), F.lit(name).alias("kind"))
    found = [F.transform(_walk(rows, key, has, has[:1]), named(name)) for name, has in kinds.items()]
    return rows.select(key, F.inline(_joined(found)))


def _listed(rows: DataFrame, places_: Iterable[tuple[str, ...]], made) -> Column:
    """What the arrays hold that ``made`` gives for (place, path, item, others) of each item that is not null at places such as `a[*].b.c`.

    places_: a place, then others below the same items. Goes by the names given, apart from the schema walk; an array is passed once
    for all places in it. Places that the rows' schema has not are left out; an array that is null holds nothing.
    """
    heads: dict[str, list[tuple[str, ...]]] = {}
    for place, *others in places_:
        if _has(rows, place):
            heads.setdefault(place.partition("[*].")[0] if "[*]." in place else "", []).append((place, *others))

    def at(top: Column | None, name: str) -> Column:
        first, *rest = name.split(".")
        return reduce(lambda c, n: c[n], rest, F.col(f"`{first}`") if top is None else top[first])

    def found(listed: list[tuple[str, ...]], head: str, top: Column | None, number: Column | None) -> Column:
        items = []
        for place, *others in listed:
            item, *beside = (at(top, n.removeprefix(f"{head}[*].") if head else n) for n in (place, *others))
            path = F.lit(place) if number is None else F.concat(F.lit(f"{head}["), number, F.lit(place.removeprefix(f"{head}[*")))
            items.append(F.when(item.isNotNull(), made(place, path, item, *beside)))
        return _all(items)

    of = lambda head, listed: F.flatten(F.transform(F.col(head), lambda x, i: found(listed, head, x, i.cast("string")))) if head else found(listed, head, None, None)
    return _all([of(head, listed) for head, listed in heads.items()])


def _all(arrays: list[Column]) -> Column:
    """One array of what several hold; those that are null hold nothing."""
    return F.flatten(F.array_compact(F.array(*arrays)))


def _has(rows: DataFrame, place: str) -> bool:
    """Whether the rows' schema has a place."""
    kind: T.DataType = rows.schema
    for name in place.replace("[*]", "").split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def _ref(path: Column, item: Column, text: Column, claim: Column) -> Column:
    return F.array(F.struct(path.alias("path"), item["node_id"].alias("node_id"), item["locator"].alias("locator"), text.alias("text"), claim.alias("claim")))


def _pairs(rows: DataFrame) -> Column:
    """array<struct<path, node_id, locator, text, claim>>: each reference of the inventory with the text beside it; claim is null."""
    return _listed(rows, PAIRS, lambda place, path, item, text: _ref(path, item, text, F.lit(None).cast("string")))


def _listed_supports(rows: DataFrame, made) -> Column:
    """``_listed`` of references that support a reading: (claim, path, item, text), where claim is the path of the claim and text what is claimed."""
    named = {ref: name for name, _, ref in SUPPORTS}
    claim = lambda place, path: F.regexp_replace(path, r"\.[^.]*$", "") if "[*]" in named[place] else F.lit(named[place])
    return _listed(rows, [(ref, text) for _, text, ref in SUPPORTS], lambda place, path, item, text: made(claim(place, path), path, item, text))


def _supports(rows: DataFrame) -> Column:
    """The same of references that support a reading: text is what is claimed, claim the path of the claim."""
    return _listed_supports(rows, lambda claim, path, item, text: _ref(path, item, text, claim))


def pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, node_id, locator, recorded): each reference of the inventory with the text beside it."""
    return rows.select(key, F.inline(_pairs(rows))).select(key, "path", "node_id", "locator", F.col("text").alias("recorded"))


def _shelf(node_id: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(node_id), n).cast("int")


def _shelved(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """rows with ``_shelves``, the nodes of their key (node_id, text, problem) on shelves by a hash of their ids; null without any.

    One join by the key, so that no reference is shuffled. Of n nodes a shelf holds about four times the root of n, or all up to SHELF.
    """
    named = nodes.where(F.col("node_id").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("node_id", "text", "problem")).alias("_nodes"))
    several = F.ceil(F.sqrt(F.size("_nodes")) / 4).cast("int")
    dealt = places.let(several, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter("_nodes", lambda x: _shelf(x["node_id"], n) == i)))
    shelves = named.select("_key", F.when(F.size("_nodes") <= SHELF, F.array("_nodes")).otherwise(dealt).alias("_shelves"))
    return rows.join(shelves, F.col(key) == F.col("_key"), "left").drop("_key")


def _named(node_id: Column) -> Column:
    """The nodes of an id (of rows with shelves), or a null if there is none."""
    found = F.filter(F.get("_shelves", _shelf(node_id, F.size("_shelves"))), lambda n: n["node_id"] == node_id)
    unknown = F.array(F.get(F.get("_shelves", F.lit(0)), F.lit(-1)))
    return places.let(found, lambda nodes: F.when(F.size(nodes) > 0, nodes).otherwise(unknown))


def _in_range(locator: Column, text: Column) -> Column:
    return (locator["start"] >= 0) & (locator["start"] <= locator["end"]) & (locator["end"] <= F.length(text))


def _pair_finding(at: Column, recorded: Column, node: Column) -> Column:
    """What is wrong with a reference, given its locator, the text beside it and its node, or null."""
    text = node["text"]
    return (
        F.when(F.coalesce(at["kind"], F.lit("")) != "char_span", "not_a_char_span")
        .when(node["problem"].isNotNull(), "node_problem")
        .when(text.isNull(), "unknown_node")
        .when(~F.coalesce(_in_range(at, text), F.lit(False)), "out_of_range")
        .when(~F.substr(text, at["start"] + 1, at["end"] - at["start"]).eqNullSafe(recorded), "differs")
    )


def _pair_category(finding: Column, node: Column) -> Column:
    return F.when(finding == "node_problem", node["problem"]).when(finding.isin("not_a_char_span", "unknown_node"), "unverifiable").when(finding.isNotNull(), "failed")


def checked_pairs(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Pairs with ``finding``, null where the text at the place is the one recorded, and its ``category``.

    Findings: not_a_char_span, node_problem, unknown_node, out_of_range, differs. nodes: (key, node_id, text, problem),
    where problem is null, failed or unverifiable and becomes the category of all that cite the node.
    """

    def made(place: str, path: Column, item: Column, text: Column) -> Column:
        known = (path.alias("path"), item["node_id"].alias("node_id"), item["locator"].alias("locator"), text.alias("recorded"))
        return F.transform(_named(item["node_id"]), lambda node: places.let(_pair_finding(item["locator"], text, node), lambda f: F.struct(*known, f.alias("finding"), _pair_category(f, node).alias("category"))))

    return _shelved(rows, nodes, key).select(key, F.inline(_listed(rows, PAIRS, made)))


def _sound(at: Column, node: Column) -> Column:
    """Whether a place can be cut out of its node's text."""
    return F.coalesce((at["kind"] == "char_span") & node["problem"].isNull() & _in_range(at, node["text"]), F.lit(False))


def _claim(path: Column, claim: Column, gap: Column, support: Column) -> Column:
    return F.struct(path.alias("path"), claim.alias("claim"), gap.alias("gap"), support.alias("support"))


def _semantic(rows: DataFrame) -> Column:
    gap = lambda at, node: F.when(_sound(at, node), "support_unrecorded").otherwise("location_unresolved")
    return _listed_supports(rows, lambda claim, path, item, text: F.transform(_named(item["node_id"]), lambda node: _claim(claim, text, gap(item["locator"], node), path)))


def semantic_claims(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, claim, gap, support): readings whose support is a place alone.

    support_unrecorded if the place can be cut out of a sound node's text, else location_unresolved.
    """
    return _shelved(rows, nodes, key).select(key, F.inline(_semantic(rows)))


def _open_units(values: Column) -> Column:
    """Of measured values those of which several quantities admit the unit's spelling."""
    return F.filter(values, lambda x: F.trim(x["unit_raw"]).isin(*units.shared_spellings()))


def _stated(x: Column, f: str) -> Column:
    return ~x[f].isin(*STATES_NOTHING) if f == "kind" else x[f].isNotNull()


def _derived(rows: DataFrame, key: str) -> Column:
    """array<struct<path, claim>>: values that decide a reading; a quantity is one where several admit the unit's spelling."""
    values = F.transform(_open_units(_walk(rows, key, VALUE, VALUE)), lambda x: F.struct(F.concat(x["path"], F.lit(".quantity_kind")).alias("path"), x["quantity_kind"].alias("claim")))
    one = lambda x, f: F.struct(F.concat_ws(".", x["path"], F.lit(f)).alias("path"), x[f].alias("claim"))
    said = F.flatten(F.transform(_walk(rows, key, UNCERTAINTY, UNCERTAINTY), lambda x: F.array(*[F.when(_stated(x, f), one(x, f)) for f in UNCERTAINTY])))
    return F.concat(values, F.array_compact(said))


def _n_derived(rows: DataFrame, key: str, values: Column) -> Column:
    """How many there are, given the measured values with their units."""
    said = F.transform(_walk(rows, key, UNCERTAINTY, UNCERTAINTY, paths=False), lambda x: reduce(lambda a, b: a + b, [F.coalesce(_stated(x, f), F.lit(False)).cast("int") for f in UNCERTAINTY]))
    return F.size(_open_units(values)) + F.aggregate(said, F.lit(0), lambda n, x: n + x)


def _unsupported(rows: DataFrame, key: str) -> Column:
    return F.transform(_derived(rows, key), lambda x: _claim(x["path"], x["claim"], F.lit("no_support_offered"), F.lit(None).cast("string")))


def derived_claims(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, claim, gap, support): values that decide a reading and that nothing supports. Within the row.

    A quantity is one where several admit the unit's spelling; of an uncertainty each of kind, basis and scale that it states.
    """
    return rows.select(key, F.inline(_unsupported(rows, key)))


def claims(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """What ``semantic_claims`` and ``derived_claims`` give, with the rows read once."""
    return _shelved(rows, nodes, key).select(key, F.inline(F.concat(_semantic(rows), _unsupported(rows, key))))


_MEASURED = ("quantity_kind", "unit_raw", "value_ref", "unit_ref")
_VALUE = {"path": "string", "quantity": "string", "start": "long", "end": "long", "value_start": "long", "value_end": "long", "text": "string"}


def _read(values: Column, made) -> Column:
    """What ``made`` gives for the columns of ``_VALUE`` of each measured value (path, quantity, places of unit and number, text) whose node is sound and has a text."""

    def of(x: Column) -> Column:
        number, unit = x["value_ref"], x["unit_ref"]
        same, sound = number["node_id"] == unit["node_id"], lambda n: n["problem"].isNull() & n["text"].isNotNull()
        at = (x["path"], x["quantity_kind"], unit["locator"]["start"], unit["locator"]["end"], F.when(same, number["locator"]["start"]), F.when(same, number["locator"]["end"]))
        return F.transform(F.filter(_named(F.coalesce(unit["node_id"], number["node_id"])), sound), lambda n: made(**dict(zip(_VALUE, (*at, n["text"]), strict=True))))

    return F.flatten(F.transform(values, of))


def _bounded(at: DataFrame) -> DataFrame:
    """Located values (text, start, end, quantity, value_start, value_end, …) with ``violation`` of the unit and ``piece``, whether the number is one."""
    at = at.withColumn("_whole", boundaries.whole_numeral(F.col("text"), F.col("value_start"), F.col("value_end")))
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")), F.lit(False))
    piece = F.coalesce((F.col("value_start") >= 0) & (F.col("value_start") < F.col("value_end")) & (F.col("value_end") <= F.length("text")) & ~F.col("_whole"), F.lit(False))
    judged = boundaries.unit_violations(at.withColumn("_inside", inside).withColumn("piece", piece), whole="_whole")
    return judged.withColumn("violation", F.when(F.col("_inside"), F.col("violation"))).drop("_inside", "_whole")


def _boundary_rows(violation: str, piece: str, path: str) -> Column:
    """array<struct<path, finding, category>> of a judged value."""
    made = lambda end, finding: F.struct(F.concat(F.col(path), F.lit(end)).alias("path"), finding.alias("finding"), F.lit("failed").alias("category"))
    return F.array_compact(F.array(F.when(F.col(violation).isNotNull(), made(".unit_ref", F.col(violation))), F.when(F.col(piece), made(".value_ref", F.lit("value_not_whole")))))


def boundary_findings(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, finding, category): measured values whose number or unit is a piece of something longer in its text."""
    made = lambda **given: F.struct(*[c.cast(_VALUE[name]).alias(name) for name, c in given.items()])
    at = _shelved(rows, nodes, key).select(key, F.inline(_read(_walk(rows, key, VALUE, _MEASURED), made)))
    return _bounded(at).select(key, F.inline(_boundary_rows("violation", "piece", "path")))


def _places(kind: T.DataType, has: tuple[str, ...], path: str = "") -> list[str]:
    """Places of the structs with the given fields in a type, as inventories write them; `[key]` for what maps hold."""
    if isinstance(kind, T.ArrayType):
        return _places(kind.elementType, has, f"{path}[*]")
    if isinstance(kind, T.MapType):
        return _places(kind.valueType, has, f"{path}[key]")
    if not isinstance(kind, T.StructType):
        return []
    return [path] * _is(kind, has) + [p for f in kind for p in _places(f.dataType, has, f"{path}.{f.name}".removeprefix("."))]


def _agree(rows: DataFrame, key: str) -> bool:
    """Whether the schema alone tells that walk and inventories name the same places, each once; then they have the same paths in every row."""
    kind, named = T.StructType([f for f in rows.schema if f.name != key]), lambda listed: sorted(p for p in listed if _has(rows, p))
    refs = [ref for ref, _ in PAIRS] + [ref for *_, ref in SUPPORTS]
    return sorted(_places(kind, REF)) == named(refs) and sorted(_places(kind, UNCERTAINTY)) == named(UNCERTAIN) and all(ref.split(".")[-1] in UNPAIRED for *_, ref in SUPPORTS)


_FINDING = "array<struct<path: string, finding: string, category: string>>"


def _unreconciled(rows: DataFrame, key: str, walk: Column, pairs: Column, supports: Column) -> Column:
    """array<struct<path, finding, category>> of places that only one of inventories and walk has, given the paths of each, and supports that are pairs."""
    if _agree(rows, key):
        return F.expr(f"cast(array() as {_FINDING})")
    paths = lambda found: F.transform(found, lambda x: x["path"])
    sites, hand = paths(_walk(rows, key, UNCERTAINTY, UNCERTAINTY)), _listed(rows, [(p,) for p in UNCERTAIN], lambda place, path, item: F.array(path))
    named = F.concat(pairs, supports)
    owed = F.filter(supports, lambda p: ~F.element_at(F.split(p, r"\."), -1).isin(*UNPAIRED))
    found = [(F.array_except(walk, named), "never_named"), (F.array_except(named, walk), "never_walked"), (F.array_except(sites, hand), "never_named"), (F.array_except(hand, sites), "never_walked"), (owed, "support_is_a_pair")]
    row = lambda why: lambda p: F.struct(p.alias("path"), F.lit(why).alias("finding"), F.lit("failed").alias("category"))
    return F.concat(*[F.transform(which, row(why)) for which, why in found])


def unreconciled(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, finding, category): places that the inventories and the walk don't both have, and supports that are pairs. Within the row."""
    paths = lambda found: F.transform(found, lambda x: x["path"])
    return rows.select(key, F.inline(_unreconciled(rows, key, paths(_walk(rows, key, REF, REF)), paths(_pairs(rows)), paths(_supports(rows)))))


def _judged(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, n_total, n_checked, n_support_only, n_claims, found): what an envelope owes, judged after one join with the nodes; the rows are read once.

    One row of an envelope has its counts and what pairs and inventories find, judged within the row; beside it stands a row for each
    measured value whose text is known, with null counts and what its boundaries find. found: array<struct<path, finding, category>>.
    """
    is_span = lambda locator: F.coalesce(locator["kind"] == "char_span", F.lit(False))
    paths = lambda found: F.transform(found, lambda x: x["path"])
    n = lambda found: F.size(found).cast("long")

    def pair(place: str, path: Column, item: Column, text: Column) -> Column:
        wrong = lambda f, node: F.when(f.isNotNull(), F.struct(path.alias("path"), f.alias("finding"), _pair_category(f, node).alias("category")))
        return F.transform(_named(item["node_id"]), lambda node: places.let(_pair_finding(item["locator"], text, node), lambda f: wrong(f, node)))

    support = lambda claim, path, item, text: F.transform(_named(item["node_id"]), lambda node: _sound(item["locator"], node))
    # Arrays that several expressions read are columns of their own, so that each is made once.
    at = _shelved(rows, nodes, key).withColumns({"_pairs": _listed(rows, PAIRS, pair), "_sound": _listed_supports(rows, support), "_v": _walk(rows, key, VALUE, _MEASURED)})
    if _agree(rows, key):  # each reference has one path, which both have
        total, open_ = n(F.filter(_walk(rows, key, REF, ("locator",), paths=False), lambda x: is_span(x["locator"]))), F.expr(f"cast(array() as {_FINDING})")
    else:
        at = at.withColumns({"_p": _pairs(rows), "_s": _supports(rows), "_w": _walk(rows, key, REF, REF)})
        p, s, w = F.col("_p"), F.col("_s"), F.col("_w")
        spans = lambda found: paths(F.filter(found, lambda x: is_span(x["locator"])))
        total, open_ = n(F.array_distinct(F.concat(spans(w), spans(p)))), _unreconciled(rows, key, paths(w), paths(p), paths(s))
    numbers = {
        "n_total": total, "n_checked": n(F.filter("_pairs", lambda f: f.isNull())), "n_support_only": n(F.filter("_sound", lambda x: x)),
        "n_claims": _n_derived(rows, key, F.col("_v")).cast("long") + n(F.col("_sound")),
    }
    kinds = _VALUE | dict.fromkeys(numbers, "long") | {"open": _FINDING}
    part = lambda **given: F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])
    parts = F.concat(F.array(part(open=F.concat(F.array_compact("_pairs"), open_), **numbers)), _read(F.col("_v"), part))
    return _bounded(at.select(key, F.inline(parts))).select(key, *numbers, F.coalesce("open", _boundary_rows("violation", "piece", "path")).alias("found"))


_UNCHECKED = "named_struct('path', '', 'finding', 'nothing_checked', 'category', 'unverifiable')"


def findings(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, finding, category) of a replay: pairs, boundaries, reconciliation, and envelopes without one checked pair.

    Nothing is written on the way, and no finding leaves the task of its envelope.
    """
    bare = F.when(F.col("n_checked") == 0, F.concat("found", F.array(F.expr(_UNCHECKED))))
    return _judged(rows, nodes, key).select(key, F.inline(F.coalesce(bare, "found")))


def replayed(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, n_total, n_checked, n_support_only, n_unchecked, n_failed, n_unverifiable, n_claims, evidence, overall) of each envelope.

    Counts of character spans are of places that the walk or the inventory has. evidence: a failure fails, anything open
    leaves it open. overall: a claim whose meaning nothing supports leaves open what the evidence verified.
    Each envelope is walked once, meets its nodes in one join by its key, and only counts are summed by the key.
    An envelope without references has zeros.
    """
    n = lambda c: F.sum(F.coalesce(c, F.lit(0).cast("long")))
    of = lambda category: F.size(F.filter(F.col("found"), lambda f: f["category"] == category)).cast("long")
    counted = _judged(rows, nodes, key).groupBy(key).agg(*[n(F.col(c)).alias(c) for c in ("n_total", "n_checked", "n_support_only", "n_claims")], n(of("failed")).alias("n_failed"), n(of("unverifiable")).alias("_open"))
    whole = counted.withColumn("n_unverifiable", F.col("_open") + (F.col("n_checked") == 0).cast("long"))
    evidence = outcome(F.col("n_failed"), F.col("n_unverifiable"), F.col("n_checked"))
    whole = whole.withColumn("n_unchecked", F.col("n_total") - F.col("n_checked") - F.col("n_support_only")).withColumn("evidence", evidence)
    overall = F.when((F.col("evidence") == "verified") & (F.col("n_claims") > 0), "unverifiable").otherwise(F.col("evidence"))
    return whole.withColumn("overall", overall).select(key, "n_total", "n_checked", "n_support_only", "n_failed", "n_unverifiable", "n_claims", "n_unchecked", "evidence", "overall")
