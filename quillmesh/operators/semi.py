"""Scores in JSON lines of varying shape, read as VARIANT: no schema is inferred, a broken line costs only itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a variant's own type is called when it is a number (a truth value counts as 1 or 0).
NUMBER = r"^(?:BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\(.*)$"


def number(v: Column) -> Column:
    """The number that a variant is; null for anything else, also for a number in a string."""
    return F.when(F.schema_of_variant(v).rlike(NUMBER), F.try_variant_get(v, "$", "double"))


def lookup(v: Column, field: str) -> Column:
    """The number at a dotted path; where the path is missing or null, that of its last name one level down, the first by name of the part that holds it. A path that meets something other than an object on its way has none."""
    names = field.split(".")
    at = lambda k: F.try_variant_get(v, "$" + "".join(f"['{n}']" for n in names[:k]), "variant")
    absent = lambda x: x.isNull() | F.is_variant_null(x)
    stopped = F.lit(False)
    for k in range(1, len(names)):
        stopped = stopped | (~absent(at(k)) & ~F.schema_of_variant(at(k)).startswith("OBJECT"))
    parts = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    inside = F.filter(F.transform(parts, lambda x: number(F.try_variant_get(x, f"$['{names[-1]}']", "variant"))), lambda x: x.isNotNull())
    return F.when(stopped, None).when(~absent(at(len(names))), number(at(len(names)))).otherwise(F.get(inside, F.lit(0)))


def quality(lines: DataFrame, field: str, by: list[str] | None = None) -> DataFrame:
    """total, valid, parse_errors, success_rate, mean, low and high of a score in lines (line and the columns by), rounded to 3; a line that is no JSON or has no number there is an error."""
    rows = lines.withColumn("score", lookup(F.try_parse_json("line"), field))
    many, valid = F.count("*"), F.count("score")
    return rows.groupBy(*(by or [])).agg(many.alias("total"), valid.alias("valid"), (many - valid).alias("parse_errors"), F.round(F.try_divide(valid, many), 3).alias("success_rate"),
        F.round(F.avg("score"), 3).alias("mean"), F.round(F.min("score"), 3).alias("low"), F.round(F.max("score"), 3).alias("high"))
