"""Schemas: a text format, Spark types, equality, overlays, differences, DDL and migrations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions.wkt import GEOMETRY
from wayledger.operators.crud import Store, Transaction


class SchemaError(ValueError):
    """Text that is no schema."""


_SCALARS = {
    "null": T.NullType(), "bool": T.BooleanType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "text": T.StringType(), "date": T.TimestampType(), "datetime": T.TimestampType(), "guid": T.StringType(), "uuid": T.StringType(),
    "time": T.LongType(), "bin": T.BinaryType(), "jsonb": T.StringType(),
}
_GEOMETRIES = ("point", "multipoint", "polyline", "polygon", "geometry")
_ALIASES = {"uuid": "guid", "date": "datetime"}


@dataclass(frozen=True)
class FieldType:
    name: str
    has_z: bool = False
    has_m: bool = False
    width: int = 0
    srid: int = 0

    @property
    def is_geometry(self) -> bool:
        return self.name in _GEOMETRIES

    def spark(self) -> T.DataType:
        return GEOMETRY if self.is_geometry else _SCALARS[self.name]

    def __str__(self) -> str:
        number = self.srid if self.is_geometry else self.width
        return self.name + "z" * self.has_z + "m" * self.has_m + (f"({number})" if number else "")


def parse_type(text: str) -> FieldType:
    """'int64', 'text(50)', 'pointzm(4326)': the number is a width, or the SRID of a geometry."""
    m = re.fullmatch(r"([a-z][a-z0-9]*)(?:\(\s*(-?\d+)\s*\))?", text.strip().lower())
    if not m:
        raise SchemaError(f"no field type: {text!r}")
    name, number = m.group(1), int(m.group(2) or 0)
    if name in _SCALARS:
        return FieldType(_ALIASES.get(name, name), width=number)
    g = re.fullmatch(rf"({'|'.join(_GEOMETRIES)})(z?)(m?)|({'|'.join(_GEOMETRIES)})mz", name)
    if not g:
        raise SchemaError(f"no field type: {text!r}")
    return FieldType(g.group(1) or g.group(4), bool(g.group(2)) or bool(g.group(4)), bool(g.group(3)) or bool(g.group(4)), srid=number)


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    required: bool = False
    title: str = ""
    unit: str = ""
    group: str = ""
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Index:
    fields: tuple[str, ...]
    unique: bool = False
    primary: bool = False
    name: str = ""

    def describe(self) -> str:
        return ("primary " if self.primary else "unique " if self.unique else "") + "(" + ",".join(self.fields) + ")"

    def same(self, other: Index) -> bool:
        return (self.fields, self.unique, self.primary) == (other.fields, other.unique, other.primary)


@dataclass(frozen=True)
class Relation:
    kind: str  # 'hasone' or 'hasmany'
    accessor: str
    local: str
    foreign: str
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    title: str = ""
    fields: tuple[Field, ...] = ()
    indexes: tuple[Index, ...] = ()
    relations: tuple[Relation, ...] = ()
    flags: tuple[str, ...] = ()
    base: str = ""
    network: tuple[str, ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def by_title(self, title: str) -> Field | None:
        """The only field of this title, without regard to case."""
        found = [f for f in self.fields if f.title.lower() == title.lower()]
        return found[0] if len(found) == 1 else None

    def primary_key(self) -> Index | None:
        return next((i for i in self.indexes if i.primary), None)

    def struct(self) -> T.StructType:
        def one(f: Field) -> T.StructField:
            meta = {"type": str(f.type), "title": f.title, "unit": f.unit, "group": f.group, "tags": list(f.tags)}
            return T.StructField(f.name, f.type.spark(), not f.required, {k: v for k, v in meta.items() if v})

        return T.StructType([one(f) for f in self.fields])


@dataclass(frozen=True)
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    spaces: tuple[str, ...] = ()
    version: int = 0


# --- text ----------------------------------------------------------------------------------------------

_LEX = re.compile(r'\s+|#[^\n]*|//[^\n]*|"(?P<quoted>[^"]*)"|(?P<word>[A-Za-z_0-9][\w.]*)|(?P<mark>[{}();:,])|(?P<other>\S)')


class _Text:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        at, line = 0, 1
        while at < len(text):
            m = _LEX.match(text, at)
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group(m.lastgroup), line))
            line += m.group().count("\n")
            at = m.end()
        self.tokens.append(("end", "", line))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][:2]

    def line(self) -> int:
        return self.tokens[self.at][2]

    def next(self, kind: str | None = None, value: str | None = None) -> str:
        k, v, line = self.tokens[self.at]
        if kind and k != kind or value is not None and v != value:
            raise SchemaError(f"line {line}: expected {value or kind}, found {v or 'the end'!r}")
        self.at += 1
        return v

    def accept(self, value: str) -> bool:
        if self.peek()[0] in ("word", "mark") and self.peek()[1] == value:
            self.at += 1
            return True
        return False

    def words(self) -> tuple[str, ...]:
        out = [self.next("word")]
        while self.accept(","):
            out.append(self.next("word"))
        return tuple(out)


def parse_schema(text: str) -> Schema:
    """Tables of a schema text; untitled tables serve only as bases of others and drop out."""
    t = _Text(text)
    version = int(t.next()) if t.accept("VERSION") and t.peek()[1].isdigit() else 0
    tables: dict[str, Table] = {}
    spaces: list[str] = []
    suffixes: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
    while t.peek()[0] != "end":
        t.next("word", "CREATE")
        if t.accept("SCHEMA"):
            spaces.append(t.next("word"))
        elif t.accept("SUFFIX"):
            t.next("word", "TABLES")
            t.next("mark", "{")
            originals = t.words()
            t.next("mark", ";")
            suffixes.append((originals, t.words()))
            t.next("mark", ";")
            t.next("mark", "}")
        else:
            t.next("word", "TABLE")
            table = _parse_table(t, tables)
            tables[table.name] = table
        t.next("mark", ";")
    titled = {n: x for n, x in tables.items() if x.title}
    for originals, endings in suffixes:
        for o in originals:
            if o not in titled:
                raise SchemaError(f"no table {o!r} to suffix")
            titled |= {o + e: replace(titled[o], name=o + e, flags=(*titled[o].flags, "suffix")) for e in endings}
    return Schema(titled, tuple(spaces), version)


def _parse_table(t: _Text, known: dict[str, Table]) -> Table:
    title, name = t.next("quoted"), t.next("word")
    base = known.get(t.next("word")) if t.accept(":") else None
    if t.tokens[t.at - 2][1] == ":" and base is None:
        raise SchemaError(f"line {t.line()}: {name} has an unknown base")
    fields, relations = list(base.fields if base else ()), list(base.relations if base else ())
    indexes, flags, network, group = list(base.indexes if base else ()), [], (), ""
    t.next("mark", "{")
    while not t.accept("}"):
        if t.peek()[0] == "quoted":
            group = t.next()
            continue
        word = t.next("word")
        if word in ("required", "optional"):
            kind = t.next("word")
            if t.accept("("):
                kind += f"({t.next('word')})"
                t.next("mark", ")")
            field_name, field_title = t.next("word"), t.next("quoted")
            extra = dict(_extras(t))
            fields.append(Field(field_name, parse_type(kind), word == "required", field_title, extra.get("unit", ""), group))
        elif word in ("hasone", "hasmany"):
            relations.append(Relation(word, t.next("word"), t.next("word"), t.next("word"), tuple(_extras(t))))
        elif word == "flags":
            flags += t.words()
        elif word in ("netlink", "netnode"):
            if network:
                raise SchemaError(f"line {t.line()}: only one network per table")
            network = (word, t.next("quoted"), t.next("word"), *([t.next("word")] if word == "netlink" else []))
        else:
            raise SchemaError(f"line {t.line()}: unexpected {word!r}")
    while t.peek()[1] in ("PRIMARY", "UNIQUE", "INDEX"):
        word = t.next()
        t.next("word", "KEY") if word == "PRIMARY" else t.next("word", "INDEX") if word == "UNIQUE" else None
        label = t.next("word") if t.peek()[0] == "word" else ""
        t.next("mark", "(")
        indexes.append(Index(t.words(), word != "INDEX", word == "PRIMARY", label))
        t.next("mark", ")")
    names = [f.name for f in fields]
    if missing := [f for i in indexes for f in i.fields if f not in names]:
        raise SchemaError(f"{name}: no fields {missing} to index")
    return Table(name, title, tuple(fields), tuple(indexes), tuple(relations), tuple(flags), base.name if base else "", network)


def _extras(t: _Text) -> list[tuple[str, str]]:
    out = []
    while t.peek()[0] == "word" and t.peek(1) == ("mark", ":"):
        key = t.next()
        t.next("mark", ":")
        out.append((key, t.next()))
    return out


def print_table(x: Table) -> str:
    lines = [f'CREATE TABLE "{x.title}" {x.name}', "{"]
    group = ""
    for f in x.fields:
        if f.group != group:
            lines.append(f'\t"{f.group}"')
            group = f.group
        lines.append(f'\t{"required" if f.required else "optional"}\t{f.type}\t{f.name}\t"{f.title}"' + (f"\tunit:{f.unit}" if f.unit else ""))
    lines += [f"\t{r.kind} {r.accessor} {r.local} {r.foreign}" + "".join(f" {k}:{v}" for k, v in r.options) for r in x.relations]
    if x.network:
        lines.append(f'\t{x.network[0]} "{x.network[1]}" {" ".join(x.network[2:])}')
    if x.flags:
        lines.append("\tflags " + ", ".join(x.flags))
    tail = "".join(f" {'PRIMARY KEY' if i.primary else 'UNIQUE INDEX' if i.unique else 'INDEX'}{' ' + i.name if i.name else ''}({', '.join(i.fields)})" for i in x.indexes)
    return "\n".join([*lines, "}" + tail + ";"])


def print_schema(s: Schema) -> str:
    head = [f"VERSION {s.version}"] if s.version else []
    return "\n\n".join([*head, *(f"CREATE SCHEMA {n};" for n in s.spaces), *map(print_table, s.tables.values())]) + "\n"


# --- comparison --------------------------------------------------------------------------------------------


def equal_tables(a: Table, b: Table, geometry_types: bool = True, guids: bool = True, spatial_indexes: bool = True) -> bool:
    """Whether ``b``, read from a database with these abilities, is what ``a`` asks for. A width of 0 in ``a`` allows any."""
    if len(a.fields) != len(b.fields):
        return False
    for f in a.fields:
        g = b.field(f.name)
        if g is None:
            return False
        if f.type.name != g.type.name and not (f.type.is_geometry and g.type.is_geometry and not geometry_types or f.type.name == "guid" and g.type.name == "bin" and not guids):
            return False
        if f.type.width and f.type.width != g.type.width:
            return False
    for i in a.indexes:
        spatial = len(i.fields) == 1 and (f := a.field(i.fields[0])) is not None and f.type.is_geometry
        if not any(i.same(j) for j in b.indexes) and not (spatial and not spatial_indexes):
            return False
    return True


def overlay(info: Table, onto: Table) -> Table:
    """``onto`` with the titles, units, groups, tags and flags that ``info`` has; no field is added."""

    def merged(f: Field) -> Field:
        g = info.field(f.name)
        return f if g is None else replace(f, title=g.title or f.title, unit=g.unit or f.unit, group=g.group or f.group, tags=tuple(dict.fromkeys((*f.tags, *g.tags))))

    return replace(onto, fields=tuple(map(merged, onto.fields)), flags=tuple(dict.fromkeys((*onto.flags, *info.flags))))


@dataclass(frozen=True)
class Change:
    kind: str  # 'create space', 'drop table', 'rename field', ...
    table: str
    name: str = ""
    new: object = None

    def __str__(self) -> str:
        what = f"{self.table}.{self.name}" if self.name else self.table
        extra = {"rename field": f" -> {self.new}", "change type": f" to {self.new.type if isinstance(self.new, Field) else self.new}"}.get(self.kind, "")
        return f"{self.kind} {what}{extra}"


def diff(old: Schema, new: Schema) -> list[Change]:
    """Changes in the order they can be made. A field counts as renamed if a field of its title goes away."""
    out = [Change("create space", s) for s in sorted(set(new.spaces) - set(old.spaces))] + [Change("drop space", s) for s in sorted(set(old.spaces) - set(new.spaces))]
    out += [Change("create table", n, new=new.tables[n]) for n in sorted(new.tables.keys() - old.tables.keys())]
    out += [Change("drop table", n) for n in sorted(old.tables.keys() - new.tables.keys())]
    for name in sorted(new.tables.keys() & old.tables.keys()):
        a, b = old.tables[name], new.tables[name]
        out += [Change("drop index", name, i.describe(), i) for i in a.indexes if not any(i.same(j) for j in b.indexes)]
        renamed = set()
        for f in b.fields:
            before = a.field(f.name) or (a.by_title(f.title) if f.title else None)
            if before is not None and before.name != f.name and (b.field(before.name) or before.name in renamed):
                before = None
            if before is None:
                out.append(Change("create field", name, f.name, f))
                continue
            if before.name != f.name:
                renamed.add(before.name)
                out.append(Change("rename field", name, before.name, f.name))
            if before.type.name != f.type.name:
                out.append(Change("change type", name, f.name, f))
        out += [Change("drop field", name, f.name) for f in a.fields if not b.field(f.name) and f.name not in renamed]
        out += [Change("create index", name, i.describe(), i) for i in b.indexes if not any(i.same(j) for j in a.indexes)]
    return out


def create_table(x: Table) -> str:
    columns = ", ".join(f"`{f.name}` {f.type.spark().simpleString()}{' NOT NULL' if f.required else ''}" for f in x.fields)
    return f"CREATE TABLE `{x.name}` ({columns}) USING parquet"


def index_ddl(changes: list[Change], dialect: str = "postgres") -> list[str]:
    """Statements of the indexes that changes create or drop, for databases that have indexes."""
    from wayledger.plans.dialects import DIALECTS

    quoted = lambda *parts: DIALECTS[dialect].identifier(parts)
    out = []
    for c in changes:
        index = c.new if c.kind in ("create index", "drop index") else None
        if index is None:
            continue
        table, name = quoted(c.table), quoted(index.name or "_".join(("idx", c.table, *index.fields)))
        fields = ", ".join(quoted(f) for f in index.fields)
        if c.kind == "drop index":
            out.append(f"ALTER TABLE {table} DROP CONSTRAINT {name}" if index.primary else f"DROP INDEX {name}")
        elif index.primary:
            out.append(f"ALTER TABLE {table} ADD CONSTRAINT {name} PRIMARY KEY ({fields})")
        else:
            out.append(f"CREATE {'UNIQUE ' if index.unique else ''}INDEX {name} ON {table} ({fields})")
    return out


def ddl(changes: list[Change]) -> list[str]:
    """Spark statements of changes. Indexes have none (see ``index_ddl``); renames, type changes and drops need a table format that allows them."""
    make: dict[str, Callable[[Change], str]] = {
        "create space": lambda c: f"CREATE DATABASE `{c.table}`",
        "drop space": lambda c: f"DROP DATABASE `{c.table}`",
        "create table": lambda c: create_table(c.new),
        "drop table": lambda c: f"DROP TABLE `{c.table}`",
        "create field": lambda c: f"ALTER TABLE `{c.table}` ADD COLUMNS (`{c.name}` {c.new.type.spark().simpleString()})",
        "rename field": lambda c: f"ALTER TABLE `{c.table}` RENAME COLUMN `{c.name}` TO `{c.new}`",
        "change type": lambda c: f"ALTER TABLE `{c.table}` ALTER COLUMN `{c.name}` TYPE {c.new.type.spark().simpleString()}",
        "drop field": lambda c: f"ALTER TABLE `{c.table}` DROP COLUMN `{c.name}`",
    }
    return [make[c.kind](c) for c in changes if c.kind in make]


def apply_changes(df: DataFrame, table: str, changes: list[Change]) -> DataFrame:
    """A table's rows brought to the new schema; values that the new type cannot hold become null."""
    for c in changes:
        if c.table != table:
            continue
        if c.kind == "create field":
            df = df.withColumn(c.name, F.lit(None).cast(c.new.type.spark()))
        elif c.kind == "rename field":
            df = df.withColumnRenamed(c.name, c.new)
        elif c.kind == "change type":
            df = df.withColumn(c.name, F.col(f"`{c.name}`").try_cast(c.new.type.spark()))
        elif c.kind == "drop field":
            df = df.drop(c.name)
    return df


def field_rows(df: DataFrame) -> list[tuple[str, str, bool]]:
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]


def field_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, field, old_type, new_type) between the schemas of two tables."""
    spark = old.sparkSession
    side = lambda df, name: spark.createDataFrame(field_rows(df), f"field string, {name} string, _n boolean").drop("_n")
    both = side(old, "old_type").join(side(new, "new_type"), "field", "full_outer")
    change = F.when(F.col("old_type").isNull(), "create").when(F.col("new_type").isNull(), "drop").when(F.col("old_type") != F.col("new_type"), "change")
    return both.select(change.alias("change"), "field", "old_type", "new_type").where("change is not null")


def type_of(t: T.DataType) -> FieldType:
    """The field type that a Spark type stands for; any that has none is text."""
    if t == GEOMETRY:
        return FieldType("geometry")
    names = {T.BooleanType: "bool", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.StringType: "text", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "datetime", T.BinaryType: "bin"}
    return FieldType(names.get(type(t), "text"))


def table_of(df: DataFrame, name: str) -> Table:
    """The schema of a table that exists; field metadata written by ``Table.struct`` is used."""

    def one(f: T.StructField) -> Field:
        m = f.metadata or {}
        return Field(f.name, parse_type(m["type"]) if "type" in m else type_of(f.dataType), not f.nullable, m.get("title", ""), m.get("unit", ""), m.get("group", ""), tuple(m.get("tags", ())))

    return Table(name, name, tuple(map(one, df.schema)))


def catalog_schema(spark, database: str | None = None, tables: list[str] | None = None) -> Schema:
    """The tables of a Spark database, all or those named."""
    found = [t.name for t in spark.catalog.listTables(database) if tables is None or t.name in tables]
    return Schema({n: table_of(spark.table(f"{database}.{n}" if database else n), n) for n in sorted(found)})


# --- migrations -----------------------------------------------------------------------------------------------

VERSION_TABLE = "migration_version"


def migrate(store: Store, migrations: list[list[Callable[[Transaction], None]]], log: Callable[[str], None] = lambda _: None) -> int:
    """Run the blocks a store has not seen, all in one transaction; the version they lead to.

    A block is a list of steps; block n brings the store to version n. An error leaves the store as it was.
    """
    known = VERSION_TABLE in store.tables()
    version = store.read(VERSION_TABLE).first().version if known else 0
    if known and version >= len(migrations):
        return version
    with store.begin() as tx:
        for number, block in enumerate(migrations[version:], version + 1):
            log(f"migration {number}")
            for step in block:
                step(tx)
        tx.write(VERSION_TABLE, store.spark.createDataFrame([(max(version, len(migrations)),)], "version int"))
        tx.commit()
    return max(version, len(migrations))
