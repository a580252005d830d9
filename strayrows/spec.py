"""Column roles of a table, derived from its schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = "row_id"


@dataclass(frozen=True)
class FeatureSpec:
    """Key, features (in table order) and optional label of a table."""

    features: tuple[str, ...]
    categorical: frozenset[str]
    id: str = ID
    label: str | None = None

    @classmethod
    def from_schema(
        cls, schema: T.StructType, id: str = ID, label: str | None = None
    ) -> FeatureSpec:
        features, categorical = [], set()
        for field in schema.fields:
            if field.name in (id, label):
                continue
            if isinstance(field.dataType, (T.StringType, T.BooleanType)):
                categorical.add(field.name)
            elif not isinstance(field.dataType, T.NumericType):
                raise TypeError(
                    f"column {field.name} of type {field.dataType.simpleString()} is neither "
                    "numeric nor categorical; cast or drop it first"
                )
            features.append(field.name)
        return cls(tuple(features), frozenset(categorical), id, label)

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if f not in self.categorical)

    @property
    def categories(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if f in self.categorical)


def split_roles(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Key as `row_id`, numeric features as doubles, categories as strings, label as `label`."""
    columns = [F.col(quote(spec.id)).cast("bigint").alias(ID)]
    for f in spec.features:
        kind = "string" if f in spec.categorical else "double"
        columns.append(F.col(quote(f)).cast(kind).alias(f))
    if spec.label is not None:
        columns.append(F.col(quote(spec.label)).cast("int").alias("label"))
    return df.select(*columns)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def double(value: float) -> str:
    """A double literal for a SQL expression."""
    return f"{value!r}D"
