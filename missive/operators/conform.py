"""Conformity of JSON records with a schema: keys that lack or are too many, and values of another type, at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound

FAULT = "array<struct<path:string,code:string,found:string>>"
#: The kinds of JSON values, by their schema in a VARIANT, that a type takes.
KINDS = {"string": "STRING", "boolean": "BOOLEAN", "bigint": "BIGINT", "int": "BIGINT", "double": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "date": "STRING", "timestamp": "STRING", "timestamp_ntz": "STRING"}


def _one(path: Column, code: str, found: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(code).alias("code"), found.alias("found"))).cast(FAULT)


def _none() -> Column:
    return F.array().cast(FAULT)


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _of_type(v: Column, kind: T.DataType, path: Column) -> Column:
    if isinstance(kind, T.StructType):
        return bound(v, lambda o: _of_object(o, kind, path))
    if isinstance(kind, T.ArrayType):
        parts = F.try_variant_get(v, "$", "array<variant>")
        inside = F.flatten(F.transform(parts, lambda x, i: _of_value(x, kind.elementType, kind.containsNull, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(_kind(v) == "ARRAY", inside).otherwise(_one(path, "mistyped", _kind(v)))
    name = kind.simpleString()
    if name not in KINDS:
        raise ValueError(f"no rule for values of type {name}")
    good = F.schema_of_variant(v).rlike(f"^({KINDS[name]})$")
    if name in ("date", "timestamp", "timestamp_ntz"):
        good = good & v.try_cast("string").try_cast(name).isNotNull()
    return F.when(good, _none()).otherwise(_one(path, "mistyped", _kind(v)))


def _of_value(v: Column, kind: T.DataType, nullable: bool, path: Column) -> Column:
    void = F.schema_of_variant(v) == "VOID"
    return F.when(void, _none() if nullable else _one(path, "null", F.lit("VOID"))).otherwise(_of_type(v, kind, path))


def _of_object(v: Column, kind: T.StructType, path: Column) -> Column:
    keys, names = F.json_object_keys(F.to_json(v)), F.array(*(F.lit(f.name) for f in kind))
    under = lambda name: F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), name)
    fault = lambda code: lambda name: F.struct(under(name).alias("path"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("found"))
    parts = [F.transform(F.array_except(names, keys), fault("missing")).cast(FAULT), F.transform(F.array_except(keys, names), fault("unexpected")).cast(FAULT)]
    for f in kind:
        child = F.try_variant_get(v, f"$['{f.name}']", "variant")
        parts.append(F.when(F.array_contains(keys, f.name), _of_value(child, f.dataType, f.nullable, under(F.lit(f.name)))).otherwise(_none()))
    return F.when(_kind(v) == "OBJECT", F.concat(*parts)).otherwise(_one(path, "mistyped", _kind(v)))


def faults(lines: DataFrame, schema: T.StructType | str, line: str = "line") -> DataFrame:
    """A row for each fault of each line: the other columns of lines, path, code and the kind of value found.

    code: malformed (no JSON), mistyped (a line that is no object has it with an empty path), missing, unexpected, null. A null line is malformed.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    v = F.try_parse_json(line)
    found = F.when(v.isNull(), _one(F.lit(""), "malformed", F.lit(None).cast("string"))).otherwise(_of_value(v, kind, False, F.lit("")))
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, F.explode(found).alias("_fault")).select(*kept, "_fault.*")
