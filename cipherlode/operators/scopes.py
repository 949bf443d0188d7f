"""What names mean: each use is brought to the innermost declaration around it, and values follow constants to their ends."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cipherlode.operators.lexical import SCALAR
from cipherlode.store import large, settle

#: How often the way from constant to constant is doubled: eight steps.
DOUBLINGS = 3
_FIELDS = "map<string,struct<kind:string,code:string,text:string,number:bigint,place:int>>"


class Resolved(NamedTuple):
    """named: those of lexical.calls that have names in their arguments, replaced by what they are set to; plain: the others, as they are; constants: strings and numbers of the top level, at their places."""

    named: DataFrame
    plain: DataFrame
    constants: DataFrame


def _let(value: str, name: str, then: str) -> str:
    """SQL of then, with value worked out once under a name."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _names(v: str) -> str:
    """SQL of the names in a value, as structs of name and place."""
    one = "if({0}.place IS NOT NULL, named_struct('name', {0}.code, 'place', {0}.place), NULL)".format
    return f"array_compact(concat(array({one(v)}), transform(map_values({v}.fields), x -> {one('x')}), transform({v}.branches, x -> {one('x')})))"


def _uses(named: DataFrame) -> DataFrame:
    """(path, name, place) of rows (path, names)."""
    return named.select("path", F.explode("names").alias("n")).select("path", "n.name", "n.place")


def bind(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """uses (path, name, place) with the ord, alias and value of the innermost of declared (path, name, low, high, ord, alias, value) that holds there; null where none does.

    The scopes of a name are nested intervals, so one sweep over a file's places of a name finds them: opening
    scopes count up, closing ones down, and what holds at a place is the last one opened at the
    depth there. No use meets a declaration that doesn't hold: a name declared in
    thousands of functions, as minified code has it, costs as much as thousands of names.
    """
    decl = F.struct("ord", "alias", "value")
    opens = declared.select("path", "name", F.col("low").alias("pos"), F.lit(1).alias("step"), F.lit(None).cast("int").alias("place"), decl.alias("decl"))
    nothing = F.lit(None).cast(dict(opens.dtypes)["decl"]).alias("decl")
    closes = declared.where("low >= 0").select("path", "name", F.col("high").alias("pos"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("place"), nothing)
    points = uses.select("path", "name", F.col("place").alias("pos"), F.lit(0).alias("step"), "place", nothing)
    order = W.Window.partitionBy("path", "name").orderBy("pos", "step")
    swept = opens.union(closes).union(points).withColumn("depth", F.sum("step").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    at_depth = W.Window.partitionBy("path", "name", "depth").orderBy("pos", "step").rowsBetween(W.Window.unboundedPreceding, 0)
    held = swept.withColumn("decl", F.when(F.col("depth") > 0, F.last("decl", ignorenulls=True).over(at_depth)))
    return held.where("place IS NOT NULL").select("path", "name", "place", "decl.ord", "decl.alias", "decl.value")


def _ends(bound: DataFrame) -> DataFrame:
    """(path, place, end): for places whose constant is set to another name, that name's place, and so on, eight times at most."""
    links = settle(bound.where("alias AND value.kind = 'name'").select("path", "place", F.col("value.place").alias("end")))
    if links.isEmpty():
        return links
    for _ in range(DOUBLINGS):
        ahead = links.select("path", F.col("place").alias("end"), F.col("end").alias("further"))
        links = settle(links.join(large(ahead), ["path", "end"], "left").select("path", "place", F.coalesce("further", "end").alias("end")))
    return links


def _struct(**fields: str) -> str:
    return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"


def _whole(v: str, known: str) -> str:
    """SQL of a value without names that are known: struct of SCALAR and fields. Branches that say the same are the first of them.

    A branch says its kind, text and number; an object, what its name is set to.
    """
    found = lambda x: f"try_element_at({known}, {x}.place)"
    bare = lambda x: _struct(**{c: f"{x}.{c}" for c in SCALAR}, place="cast(NULL AS int)")
    none = f"cast(map() as {_FIELDS})"
    own = f"transform_values({v}.fields, (f, x) -> {_let(found('x'), 'k', f"if(k IS NULL, {bare('x')}, {bare('k')})")})"
    named = _struct(kind="if(x.kind = 'object', x.kind, y.kind)", text="y.text", number="if(x.kind = 'object', NULL, y.number)")
    says = f"if(x.place IS NULL, {_struct(kind='x.kind', text='x.text', number='x.number')}, {_let(found('x'), 'y', named)})"
    of_object = f"cast(map('name', {_struct(kind="'string'", code="''", text='s.text', number='cast(NULL AS bigint)', place='cast(NULL AS int)')}) as {_FIELDS})"
    agreed = _struct(kind="s.kind", code="''", text="if(s.kind = 'object', NULL, s.text)", number="s.number", fields=f"if(s.kind = 'object', {of_object}, {none})")
    said = f"array_distinct(transform({v}.branches, x -> {says}))"
    choice = _let(said, "a", _let("try_element_at(a, 1)", "s", f"if(size(a) = 1 AND s.kind IN ('string', 'number', 'object') AND (s.text IS NOT NULL OR s.number IS NOT NULL), {agreed}, NULL)"))
    of_name = _let(found(v), "k", f"if(k IS NULL, NULL, {_struct(**{c: f'k.{c}' for c in SCALAR}, fields=f'coalesce(k.fields, {none})')})")
    written = _struct(kind=f"if({v}.kind = 'choice', 'other', {v}.kind)", **{c: f"{v}.{c}" for c in SCALAR[1:]}, fields=own)
    return f"coalesce({of_name}, if({v}.kind = 'choice', {choice}, NULL), {written})"


def _gathered(places: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(path, key, known): a map of what is known by place, for rows (path, key, names)."""
    each = places.select("path", key, F.explode("names").alias("n")).select("path", key, F.col("n.place").alias("place")).distinct()
    value = F.struct(*(c for c in known.columns if c not in ("path", "place")))
    return each.join(large(known), ["path", "place"]).groupBy("path", key).agg(F.map_from_entries(F.collect_list(F.struct("place", value.alias("value")))).alias("known"))


def resolve(fact: DataFrame, calls: DataFrame) -> Resolved:
    """Names in arguments, in their fields and in branches are what a constant of their file sets them to, through other constants; others stay names.

    Only names are joined: calls without any go by. A constant that isn't a string, a
    number or the like has its own names replaced too; one that depends on a choice
    between constants that are choices themselves is not read. Names that go round in a circle stay names.
    """
    declared = fact.where("kind = 'declared'").select("path", "name", "low", "high", "ord", "alias", "value")
    asking = calls.where("asks > 0").withColumn("names", F.expr(f"array_distinct(flatten(transform(args, v -> {_names('v')})))"))
    of_values = declared.where("alias").withColumn("names", F.expr(f"array_distinct({_names('value')})"))
    uses = _uses(asking).union(_uses(of_values)).dropDuplicates(["path", "place"])  # files may share a path
    bound = settle(bind(uses, declared))

    ends = _ends(bound)
    final = bound.join(large(ends), ["path", "place"], "left").select("path", "place", F.coalesce("end", "place").alias("end"))
    target = bound.select("path", F.col("place").alias("end"), F.col("name"), "ord", F.when(F.col("alias") & (F.col("value.kind") != "name"), F.col("value")).alias("value"))
    known = final.join(large(target), ["path", "end"])
    scalar = known.select("path", "place", *(F.when(F.col("value").isNull(), F.lit(plain).cast(kind) if plain != "code" else F.col("name")).otherwise(F.col(f"value.{c}")).alias(c) for c, plain, kind in (("kind", "name", "string"), ("code", "code", "string"), ("text", None, "string"), ("number", None, "bigint"))), F.when(F.col("value.kind").isin("object", "choice"), F.col("ord")).alias("ord"))
    scalar = settle(scalar)

    # Constants that are objects or choices, with their own names replaced.
    plain = scalar.where("kind <> 'choice'").select("path", "place", *SCALAR, F.lit(None).cast(_FIELDS).alias("fields"))
    held = of_values.join(large(_gathered(of_values, "ord", plain)), ["path", "ord"], "left").select("path", "ord", F.expr(_whole("value", "known")).alias("value"))
    rich = scalar.where("ord IS NOT NULL").join(large(held.select("path", "ord", "value")), ["path", "ord"]).select("path", "place", "value.*")
    full = scalar.where("ord IS NULL").select("path", "place", *SCALAR, F.lit(None).cast(_FIELDS).alias("fields")).union(rich)

    arg = _let(_whole("v", "known"), "w", _struct(**{c: f"w.{c}" for c in SCALAR}, place="cast(NULL AS int)", fields="w.fields", branches="array()", **{c: f"v.{c}" for c in ("given", "line", "col", "evidence")}))
    found = asking.join(large(_gathered(asking, "ord", full)), ["path", "ord"], "left").withColumn("args", F.expr(f"transform(args, v -> {arg})").cast(calls.schema["args"].dataType)).select(*calls.columns)

    top = fact.where("kind = 'declared' AND alias AND low = -1").select("path", "ord", "name", "line", "col", "evidence")
    constants = top.join(large(held.select("path", "ord", "value")), ["path", "ord"]).where("value.kind IN ('string', 'number')")
    return Resolved(found, calls.where("asks <= 0"), constants.select("path", "ord", "name", "line", "col", "evidence", F.struct(F.col("value.kind").alias("kind"), F.col("value.text").alias("text"), F.col("value.number").alias("number")).alias("value")))
