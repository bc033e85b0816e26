"""Attributes and selections of tagged features, declared as JSON and turned into columns.

A tag column is a map from string to string. Selections are conditions on it; getters draw a value from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark types of declared attribute types.
TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz", "time": "string"}
#: Other names of them.
ALIASES = {"string": "str", "enumstring": "str", "boolean": "bool"}


class AttributeConfigError(ValueError):
    """A declaration that can't be understood."""


def tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def selection(spec, tags: Column) -> Column:
    """A condition: a tag's name or {tag: true} (it is there), {tag: values} (it has one of them), or and, or, not of such.

    {"compound": "and", "clauses": [...]} is the same as {"and": [...]}; nothing at all is true.
    """
    if spec is None or spec == {} or spec == "":
        return F.lit(True)
    if isinstance(spec, dict) and "compound" in spec:
        if spec["compound"] not in ("and", "or", "not") or not spec.get("clauses"):
            raise AttributeConfigError(f"not a selection: {spec!r}")
        return selection({spec["compound"]: spec["clauses"]}, tags)
    if isinstance(spec, str):
        return tag(tags, spec).isNotNull()
    if isinstance(spec, list):
        return reduce(lambda a, b: a | b, [selection(s, tags) for s in spec])
    if not isinstance(spec, dict) or not spec:
        raise AttributeConfigError(f"not a selection: {spec!r}")
    made = []
    for key, value in spec.items():
        if key == "and":
            made.append(reduce(lambda a, b: a & b, [selection(s, tags) for s in value]))
        elif key == "or":
            made.append(reduce(lambda a, b: a | b, [selection(s, tags) for s in value]))
        elif key == "not":
            # Of a list only the first clause counts.
            made.append(~selection(value[0] if isinstance(value, list) else value, tags))
        elif value is True:
            made.append(tag(tags, key).isNotNull())
        else:
            values = value if isinstance(value, list) else [value]
            made.append(F.coalesce(tag(tags, key).isin([str(v) for v in values]), F.lit(False)))
    return reduce(lambda a, b: a & b, made)


def cast(value: Column, kind: str) -> Column:
    """A tag's text as a type: units after white space are cut off, what is no such value is null.

    Any text that is not empty is true.
    """
    kind = ALIASES.get(kind, kind)
    if kind not in TYPES:
        raise AttributeConfigError(f"unknown type: {kind}")
    if kind == "str":
        return value
    if kind == "bool":
        return F.when(value.isNotNull(), value != "")
    first = F.split(F.trim(value), r"\s+")[0]
    if kind == "int":
        return F.when(first.rlike(r"^[+-]?\d+$"), first.try_cast("bigint"))
    return first.try_cast(TYPES[kind])


def constant(value, kind: str) -> Column:
    """A declared value as a type; what is no such value is null, and numbers lose their fraction as integers."""
    kind = ALIASES.get(kind, kind)
    if value is None:
        return F.lit(None).cast(TYPES[kind])
    if isinstance(value, str):
        return cast(F.lit(value), kind)
    if kind == "bool":
        return F.lit(bool(value))
    if isinstance(value, bool) and kind == "str":
        return F.lit(str(value))
    return F.lit(value).try_cast(TYPES[kind])


def getter(spec, tags: Column, kind: str = "str") -> Column:
    """A value drawn from tags.

    "name" or {"get": name}: the tag. {"gather": names}: the first that is there. {"alternative": getters}: the first that
    gives a value. {"min": getters}, {"max": getters}: the least or greatest value, null ones skipped. {"constant": v}.
    {"ifpresent": {"key": name, "then": v, "else": getter}}: v where the tag is there. {"switch": {"key": name, "cases":
    {value: v}, "default": v}}. {"more": getters}: all values that are there, without repeats, as an array. The flat forms
    {"ifpresent": name, "value": v} and {"switch": name, "cases": {...}} do as well. Declared values get the type, too.
    """
    if isinstance(spec, str):
        return cast(tag(tags, spec), kind)
    if isinstance(spec, dict) and isinstance(spec.get("switch"), str) and "cases" in spec:
        spec = {"switch": {"key": spec["switch"], "cases": spec["cases"]}}
    if isinstance(spec, dict) and isinstance(spec.get("ifpresent"), str) and "value" in spec:
        spec = {"ifpresent": {"key": spec["ifpresent"], "then": spec["value"]}}
    if not isinstance(spec, dict) or len(spec) != 1:
        raise AttributeConfigError(f"not a getter: {spec!r}")
    ((name, arg),) = spec.items()
    every = lambda: [getter(a, tags, kind) for a in arg]
    if name == "get":
        return cast(tag(tags, arg), kind)
    if name == "gather":
        return F.coalesce(*[cast(tag(tags, a), kind) for a in arg])
    if name == "alternative":
        return F.coalesce(*every())
    if name in ("min", "max"):
        made = every()
        return made[0] if len(made) == 1 else (F.least if name == "min" else F.greatest)(*made)
    if name == "constant":
        return constant(arg, kind)
    if name == "ifpresent":
        return F.when(tag(tags, arg["key"]).isNotNull(), constant(arg["then"], kind)).otherwise(getter(arg["else"], tags, kind) if "else" in arg else F.lit(None))
    if name == "switch":
        chain = None
        for value, result in arg["cases"].items():
            hit = tag(tags, arg["key"]) == value
            chain = F.when(hit, constant(result, kind)) if chain is None else chain.when(hit, constant(result, kind))
        out = constant(arg.get("default"), kind)
        return chain.otherwise(out) if chain is not None else out
    if name == "more":
        return F.array_distinct(F.filter(F.array(*every()), lambda v: v.isNotNull()))
    raise AttributeConfigError(f"unknown getter: {name}")


def extract(df, attributes: list[dict], tags: str = "tags"):
    """The rows with their declared attributes as columns.

    An attribute has name, type, getter and, optionally, selection (where it applies; the word "restrict" is the same as
    restrict) and restrict (rows without it go).
    Array attributes make a row for each place in them; shorter ones are null beyond their end.
    """
    t = F.col(tags)
    arrays = []
    attributes = [{**{k: v for k, v in a.items() if k != "selection"}, "restrict": True} if a.get("selection") == "restrict" else a for a in attributes]
    for a in attributes:
        value = getter(a["getter"], t, a.get("type", "str"))
        if "selection" in a:
            value = F.when(selection(a["selection"], t), value)
        df = df.withColumn(a["name"], value)
        if isinstance(a["getter"], dict) and "more" in a["getter"]:
            arrays.append(a["name"])
        elif a.get("restrict"):
            df = df.where(F.col(a["name"]).isNotNull())
    if arrays:
        zipped = F.explode_outer(F.arrays_zip(*[F.col(a) for a in arrays])).alias("_z")
        df = df.select(*[c for c in df.columns if c not in arrays], zipped).select("*", *[F.col(f"_z.{a}").alias(a) for a in arrays]).drop("_z")
        for a in attributes:
            if a["name"] in arrays and a.get("restrict"):
                df = df.where(F.col(a["name"]).isNotNull())
    return df
