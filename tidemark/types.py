"""The eighteen value types of versioned tables and their Spark columns.

Columns of types that Spark lacks travel in companions that lose nothing: unsigned 64-bit numbers as DECIMAL(20,0), times as
nanoseconds of the day, instants as struct<ts, ns> (ns: the nanoseconds below a microsecond), instants with an offset as
struct<ts, ns, offset_s>, decimals beyond 38 digits as canonical text.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgumentError, NullViolationError, TypeMismatchError

MAX_COLUMNS, MAX_SCALE = 16384, 10**9
_INSTANT = [T.StructField("ts", T.TimestampType()), T.StructField("ns", T.ShortType())]
SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "date": T.DateType(),
    "time": T.LongType(), "datetime": T.StructType(_INSTANT), "datetime_tz": T.StructType([*_INSTANT, T.StructField("offset_s", T.IntegerType())]),
}
#: Ranges that the Spark type alone doesn't keep.
RANGES = {"uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1), "time": (0, 86_400 * 10**9 - 1)}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False
    scale: int = 0
    primary_key: bool = False

    @property
    def spark(self) -> T.DataType:
        if self.type == "decimal":
            return T.DecimalType(38, self.scale) if self.scale <= 38 else T.StringType()
        return SPARK[self.type]

    def to_json(self) -> dict:
        return asdict(self)


def known(type_: str) -> bool:
    return type_ == "decimal" or type_ in SPARK


#: Names of the log's own columns.
RESERVED = frozenset({"row_id", "change_type", "block_id", "snapshot_id", "item_ordinal", "schema_version", "ordinal", "__batch", "__nearest"})


def check_columns(columns: list[Column]) -> None:
    names = [c.name for c in columns]
    if not columns or len(columns) > MAX_COLUMNS or not all(names) or len(set(names)) < len(names):
        raise InvalidArgumentError("columns need unique, non-empty names, and at most 16384 of them")
    if taken := {n.lower() for n in names} & RESERVED:
        raise InvalidArgumentError(f"reserved names: {sorted(taken)}")
    for c in columns:
        if not known(c.type):
            raise InvalidArgumentError(f"unknown type {c.type!r}")
        if c.type == "decimal" and not 0 <= c.scale <= MAX_SCALE:
            raise InvalidArgumentError(f"scale {c.scale}")


def spark_schema(columns: list[Column]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.spark, True, {"logical": c.type, "scale": c.scale, "nullable": c.nullable, "primary_key": c.primary_key}) for c in columns])


def check_strict(df: DataFrame, columns: list[Column]) -> SparkColumn:
    """Types must be equal (no cast, no widening) and in order; gives a condition that holds for rows with a null or a value out
    of range where none may be."""
    for c in columns:
        if c.name not in df.columns:
            raise TypeMismatchError(f"no column {c.name}")
        got = df.schema[c.name].dataType
        if got != c.spark and not (isinstance(c.spark, T.StructType) and got.simpleString() == c.spark.simpleString()):
            raise TypeMismatchError(f"{c.name}: {got.simpleString()} is not {c.spark.simpleString()}")
    if extra := set(df.columns) - {c.name for c in columns} - {"row_id", "ordinal", "change_type"}:
        raise TypeMismatchError(f"columns that the table doesn't have: {sorted(extra)}")
    bad = F.lit(False)
    for c in columns:
        if not c.nullable:
            bad |= F.col(f"`{c.name}`").isNull()
        if c.type in RANGES:
            low, high = RANGES[c.type]
            bad |= F.coalesce(~F.col(f"`{c.name}`").between(F.lit(low).cast(c.spark), F.lit(high).cast(c.spark)), F.lit(False))
    return bad


def raise_if(df: DataFrame, bad: SparkColumn) -> None:
    if df.where(bad).limit(1).count():
        raise NullViolationError("a null, or a value out of its type's range, in a column that takes none")


# value helpers
def time_of_day(h, m, s, ns) -> SparkColumn:
    """Nanoseconds since midnight; raises for parts out of range."""
    h, m, s, ns = (x if isinstance(x, SparkColumn) else F.lit(x) for x in (h, m, s, ns))
    ok = h.between(0, 23) & m.between(0, 59) & s.between(0, 59) & ns.between(0, 10**9 - 1)
    return F.when(ok, ((h * 60 + m) * 60 + s).cast("long") * 10**9 + ns).otherwise(F.raise_error(F.lit("time of day out of range")).cast("long"))


def time_parts(t: SparkColumn) -> dict[str, SparkColumn]:
    sec = F.floor(t / F.lit(10**9).cast("long")).cast("long")
    return {"hour": F.floor(sec / 3600).cast("int"), "minute": (F.floor(sec / 60) % 60).cast("int"), "second": (sec % 60).cast("int"), "nanosecond": (t % 10**9).cast("int")}


def civil_date(ts: SparkColumn, offset_s: SparkColumn | int = 0) -> SparkColumn:
    """The date of an instant in its own zone."""
    return F.to_date(F.timestamp_seconds(F.unix_micros(ts) / 1e6 + offset_s))


def unix_day(d: SparkColumn) -> SparkColumn:
    return F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86400


def value_or(c: SparkColumn, default) -> SparkColumn:
    return F.coalesce(c, F.lit(default))
