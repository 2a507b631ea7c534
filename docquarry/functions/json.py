"""Fields of JSON text by dot path.

``Text`` reads fields from a JSON column (as variants, so that numbers, strings,
booleans and nulls stay apart), ``Typed`` from the columns of a DataFrame; the filter
compiler and the aggregates take either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, IntegerType, LongType, NumericType, ShortType, StringType, StructType


def json_path(field: str) -> str:
    return "$" + "".join(f"['{part}']" for part in field.split("."))


def raw(value: Column, field: str) -> Column:
    """The JSON text at a path, strings without their quotes."""
    return F.get_json_object(value, "$." + field)


class Text:
    """Fields of JSON text; text that isn't JSON has none."""

    def __init__(self, value: Column):
        self.variant = F.try_parse_json(value)

    def get(self, field: str) -> Column:
        return F.try_variant_get(self.variant, json_path(field), "variant")

    def kind(self, field: str) -> Column:
        """string, number, boolean, null, object, array; SQL null where the field is missing."""
        name = F.regexp_extract(F.schema_of_variant(self.get(field)), "^([A-Z]+)", 1)
        return (
            F.when(self.get(field).isNull(), F.lit(None).cast("string"))
            .when(F.is_variant_null(self.get(field)), "null")
            .when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean")
            .when(name == "OBJECT", "object")
            .when(name == "ARRAY", "array")
            .otherwise("number")
        )

    def exists(self, field: str) -> Column:
        return self.get(field).isNotNull()

    def is_null(self, field: str) -> Column:
        return F.coalesce(F.is_variant_null(self.get(field)), F.lit(False))

    def _as(self, field: str, kind: str, target: str) -> Column:
        return F.when(F.schema_of_variant(self.get(field)).rlike(kind), F.try_variant_get(self.variant, json_path(field), target))

    def string(self, field: str) -> Column:
        return self._as(field, "^STRING", "string")

    def boolean(self, field: str) -> Column:
        return self._as(field, "^BOOLEAN", "boolean")

    def number(self, field: str) -> Column:
        return self._as(field, "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)", "double")

    def integer(self, field: str) -> Column:
        """Null for numbers that aren't written as integers."""
        whole = F.schema_of_variant(self.get(field)).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
        return F.when(whole, F.try_variant_get(self.variant, json_path(field), "bigint"))


class Typed:
    """Columns of a DataFrame, and of its structs, as fields; a null is a missing field."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _find(self, field: str) -> tuple[Column | None, DataType | None]:
        kind: DataType = self.df.schema
        column: Column | None = None
        for part in field.split("."):
            if not isinstance(kind, StructType) or part not in kind.names:
                return None, None
            column = self.df[part] if column is None else column[part]
            kind = kind[part].dataType
        return column, kind

    def exists(self, field: str) -> Column:
        column, _ = self._find(field)
        return F.lit(False) if column is None else column.isNotNull()

    def is_null(self, field: str) -> Column:
        return F.lit(False)

    def _as(self, field: str, kind: type, target: str) -> Column:
        column, own = self._find(field)
        return column.cast(target) if isinstance(own, kind) else F.lit(None).cast(target)

    def string(self, field: str) -> Column:
        return self._as(field, StringType, "string")

    def boolean(self, field: str) -> Column:
        return self._as(field, BooleanType, "boolean")

    def number(self, field: str) -> Column:
        return self._as(field, NumericType, "double")

    def integer(self, field: str) -> Column:
        return self._find(field)[0].cast("bigint") if self.is_integer(field) else F.lit(None).cast("bigint")

    def is_integer(self, field: str) -> bool:
        return isinstance(self._find(field)[1], ByteType | ShortType | IntegerType | LongType)


def embedding(value: Column, dims: int, field: str = "embedding") -> Column:
    """The vector in a field, null unless it has ``dims`` numbers."""
    found = F.from_json(value, f"struct<`{field}`:array<float>>")[field]
    return F.when(F.size(found) == dims, found)


def project(value: Column, fields: dict[str, str]) -> list[Column]:
    """Columns of declared types; what has another type is null."""
    text = Text(value)
    reader = {"string": text.string, "integer": text.integer, "float": text.number, "boolean": text.boolean}
    return [reader[kind](name).alias(name) for name, kind in fields.items()]


def violations(value: Column, rules: list[tuple[str, str, bool]], strict: bool = False) -> Column:
    """The first complaint against rules (name, kind or any, required), null if there is none; ``strict`` forbids other fields."""
    text, out = Text(value), F.lit(None).cast("string")
    for name, kind, required in reversed(rules):
        if kind != "any":
            out = F.when(text.exists(name) & (text.kind(name) != kind), F.lit(f"{name}: not a {kind}")).otherwise(out)
    for name, _, required in reversed(rules):
        if required:
            out = F.when(~text.exists(name), F.lit(f"{name}: missing")).otherwise(out)
    if strict:
        extra = F.array_except(F.json_object_keys(value), F.array(*(F.lit(n) for n, _, _ in rules)))
        out = F.when(out.isNull() & (F.size(extra) > 0), F.concat(F.element_at(extra, 1), F.lit(": not declared"))).otherwise(out)
    return out
