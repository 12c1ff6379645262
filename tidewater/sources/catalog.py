"""Table schemas: declared by CREATE TABLE, kept as JSON."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from tidewater.errors import BindingError, ParseError
from tidewater.plans.dialect import Token, name_of, significant, split_commas

#: Fixed value: the dimension of VECTOR without one.
DEFAULT_DIMENSION = 3


@dataclass(frozen=True)
class Column:
    name: str
    kind: str  # Spark's simple string
    nullable: bool = True
    dimension: int | None = None

    @property
    def type(self) -> T.DataType:
        return T._parse_datatype_string(self.kind)


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...]
    key: str | None = None
    indexes: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise BindingError(f"table {self.name} has no column {name}")

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True, {"vector_dim": c.dimension} if c.dimension else {}) for c in self.columns])

    def with_index(self, index: str, column: str) -> TableSchema:
        return replace(self, indexes=self.indexes | {index: self.column(column).name})

    def indexable(self, column: str) -> bool:
        """Whether an index can lead from the column's values to keys."""
        return self.key is not None and column != self.key and not isinstance(self.column(column).type, T.ArrayType)

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(x: dict) -> TableSchema:
        return TableSchema(x["name"], tuple(Column(**c) for c in x["columns"]), x["key"], x["indexes"])


def spark_type(ts: Sequence[Token]) -> tuple[str, int | None]:
    """A declared type as Spark's, and a vector's dimension. The words are looked for in this order."""
    name, args = ts[0].word, [t.text for t in ts[1:] if t.kind == "number"]
    if "VECTOR" in name:
        return "array<double>", int(args[0]) if args else DEFAULT_DIMENSION
    if name.startswith("BOOL"):
        return "boolean", None
    if name.startswith("TIMESTAMP"):
        return "timestamp", None
    if name.startswith("DATE"):
        return "date", None
    if name == "INTERVAL" or name == "POINT":
        raise ParseError(f"type {name} is not supported")
    if "INT" in name:
        return "bigint", None
    if name in ("DECIMAL", "NUMERIC") and args:
        return f"decimal({','.join(args)})", None
    if name in ("FLOAT", "DOUBLE", "REAL", "DECIMAL", "NUMERIC", "FLOAT4", "FLOAT8"):
        return "double", None
    return "string", None


def parse_create(ts: Sequence[Token]) -> TableSchema:
    """CREATE TABLE name (column type [NOT NULL] [PRIMARY KEY], ..., [PRIMARY KEY (column)])."""
    words = [t.word for t in ts]
    at = 2
    if words[2:5] == ["IF", "NOT", "EXISTS"]:
        at = 5
    if len(ts) < at + 2 or ts[at + 1].text != "(" or ts[-1].text != ")":
        raise ParseError("expected CREATE TABLE name (columns)")
    columns, key = [], None
    for part in split_commas(ts[at + 2 : -1]):
        own = [t.word for t in part]
        if own[:2] == ["PRIMARY", "KEY"]:
            names = [t for t in part[2:] if t.kind in ("name", "quoted")]
            if len(names) != 1:
                raise ParseError("a primary key has one column")
            key = name_of(names[0])
            continue
        if len(part) < 2:
            raise ParseError("a column needs a name and a type")
        kind, dimension = spark_type(part[1:])
        primary = any(own[i : i + 2] == ["PRIMARY", "KEY"] for i in range(len(own)))
        not_null = any(own[i : i + 2] == ["NOT", "NULL"] for i in range(len(own)))
        columns.append(Column(name_of(part[0]), kind, not (primary or not_null), dimension))
        key = columns[-1].name if primary else key
    if len({c.name.lower() for c in columns}) < len(columns):
        raise BindingError("a column is declared twice")
    schema = TableSchema(name_of(ts[at]), tuple(columns), key)
    if key is not None:
        schema.column(key)
    return schema


def parse_create_sql(sql: str) -> TableSchema:
    return parse_create(significant(sql))
