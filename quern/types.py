"""Declared table schemas and their Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Amounts of money keep 18 decimals and 20 digits before them.
MONEY = T.StructType([T.StructField("amount", T.DecimalType(38, 18)), T.StructField("currency", T.StringType())])
KINDS: dict[str, T.DataType] = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "json": T.StringType(), "money": MONEY}
#: Spellings of truth values that imports accept, lower-cased.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


class TableError(ValueError):
    """A refused table operation; code names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "string"
    primary: bool = False
    required: bool = False
    unique: bool = False
    indexed: bool = False
    #: For json columns: keys kept as typed columns ``name__key``.
    extracted: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnSpec, ...]
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        for c in self.columns:
            if c.kind not in KINDS:
                raise TableError("unknown_kind", f"{c.name}: {c.kind}")
            if c.name in self._by_name:
                raise TableError("duplicate_column", c.name)
            self._by_name[c.name] = c
        if sum(c.primary for c in self.columns) != 1:
            raise TableError("primary_key", f"{self.name} needs exactly one primary column")

    @property
    def primary(self) -> str:
        return next(c.name for c in self.columns if c.primary)

    def get(self, name: str) -> ColumnSpec | None:
        return self._by_name.get(name)

    def struct(self) -> T.StructType:
        fields = [T.StructField(c.name, KINDS[c.kind], not (c.primary or c.required)) for c in self.columns]
        return T.StructType(fields + [T.StructField(f"{c.name}__{key}", KINDS[kind]) for c in self.columns for key, kind in c.extracted])

    def kinds(self) -> dict[str, str]:
        return {c.name: c.kind for c in self.columns} | {f"{c.name}__{key}": kind for c in self.columns for key, kind in c.extracted}


def parse_boolean(value: Column) -> Column:
    """True or false for the accepted spellings, else null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def parse_money(amount: Column, currency: Column) -> Column:
    """An exact amount and an upper-case ISO currency; null unless both are well formed."""
    number, code = amount.cast("string"), F.upper(F.trim(currency))
    ok = number.rlike(r"^-?[0-9]{1,20}(\.[0-9]{1,18})?$") & code.rlike("^[A-Z]{3}$")
    return F.when(ok, F.struct(number.try_cast("decimal(38,18)").alias("amount"), code.alias("currency")))


def decode(value: Column, kind: str) -> Column:
    """Text as a value of a kind; null where it isn't one. Dates must be days of the calendar."""
    text = F.trim(value.cast("string"))
    if kind == "boolean":
        return parse_boolean(value)
    if kind == "integer":
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    if kind == "float":
        return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    if kind == "date":
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))
    if kind == "datetime":
        return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), text.try_cast("timestamp"))
    if kind == "money":
        return parse_money(F.get_json_object(value, "$.amount"), F.get_json_object(value, "$.currency"))
    return value.cast("string")


def encode(value: Column, kind: str) -> Column:
    """A value of a kind as text: ISO dates and datetimes in UTC, true or false, plain decimals."""
    if kind == "money":
        return F.to_json(F.struct(F.rtrim(value["amount"].cast("string"), F.lit("0")).alias("amount"), value["currency"].alias("currency")))
    if kind == "datetime":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return value.cast("string")


_UNITS = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}


def parse_duration(text: str) -> int:
    """Seconds of 7d, 168h, 30m or 45s."""
    m = re.fullmatch(r"\s*(\d+)\s*([dhms])\s*", text)
    if not m:
        raise TableError("bad_duration", text)
    return int(m[1]) * _UNITS[m[2]]
