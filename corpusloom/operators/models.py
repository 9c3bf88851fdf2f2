"""ORM models over files(repo_id, path, content), in one pass over the files.

A class's fields and table are read from its own body: to its closing brace, or as far as it is indented."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.catalog import GO_TYPES, JAVA_TYPES, MODEL_RULES, SCRIPT_TYPES
from corpusloom.operators.hits import Lines, brace_body, first, indented_body, rows_of_files, suffix


class Field(NamedTuple):
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    default: str = ""
    max_length: int = 0
    is_relation: bool = False
    relation_type: str = ""
    relation_target: str = ""


FIELDS = (
    "array<struct<name:string,type:string,nullable:boolean,primary_key:boolean,default:string,max_length:int,is_relation:boolean,"
    "relation_type:string,relation_target:string>>"
)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", r"$1_$2"), r"([a-z0-9])([A-Z])", r"$1_$2"))


def _snake(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()


RELATIONS = ("ManyToOne", "OneToMany", "ManyToMany", "OneToOne")


def _length(text: str, pattern: str) -> int:
    return int(first(pattern, text) or 0)


def _arguments(text: str, start: int) -> str:
    """What stands between the bracket before ``start`` and its partner."""
    depth = 1
    for m in re.finditer(r"[()]", text[start:]):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return text[start : start + m.start()]
    return text[start:]


def jpa_fields(body: str) -> Iterator[Field]:
    """Private fields but transient and static ones; a field's annotations stand between it and the statement before."""
    after = 0
    for m in re.finditer(r"private\s+(?:final\s+)?(\w+(?:<[^>;]+>)?(?:\[\])?)\s+(\w+)\s*[;=]", body):
        notes = re.split(r"(?m);|^\s*\}", body[after : m.start()])[-1]
        after = m.end()
        if "@Transient" in notes:
            continue
        relation = next((r for r in RELATIONS if f"@{r}" in notes), "")
        column = first(r"@(?:Join)?Column\s*\(([^)]*)\)", notes)
        inner = first(r"<(?:[^,>]+,)?\s*(\w+)>", m[1]) or m[1]
        yield Field(
            m[2], JAVA_TYPES.get(m[1], m[1].upper()), not re.search(r"nullable\s*=\s*false", column), bool(re.search(r"@Id\b", notes)), "",
            _length(column, r"length\s*=\s*(\d+)"), bool(relation), relation, inner if relation else "",
        )


def django_fields(body: str) -> Iterator[Field]:
    for m in re.finditer(r"(\w+)\s*=\s*models\.(\w+)\s*\(", body):
        args = _arguments(body, m.end())
        relation = m[2] if m[2] in ("ForeignKey", "OneToOneField", "ManyToManyField") else ""
        yield Field(
            m[1], m[2], bool(re.search(r"null\s*=\s*True", args)), m[2] in ("AutoField", "BigAutoField") or bool(re.search(r"primary_key\s*=\s*True", args)),
            first(r"default\s*=\s*([^,)]+)", args).strip(), _length(args, r"max_length\s*=\s*(\d+)"), bool(relation), relation,
            first(r"^\s*(?:to\s*=\s*)?['\"]?([\w.]+)", args) if relation else "",
        )


def sqlalchemy_fields(body: str) -> Iterator[Field]:
    for m in re.finditer(r"(\w+)\s*=\s*(?:\w+\.)?Column\s*\(", body):
        args = _arguments(body, m.end())
        target = first(r"ForeignKey\s*\(\s*['\"]([\w.]+)", args)
        yield Field(
            m[1], first(r"^\s*(?:['\"]\w+['\"]\s*,\s*)?(?:\w+\.)?(\w+)", args) or "VARCHAR", not re.search(r"nullable\s*=\s*False", args), bool(re.search(r"primary_key\s*=\s*True", args)),
            first(r"default\s*=\s*([^,)]+)", args).strip(), _length(args, r"String\s*\(\s*(\d+)"), bool(target), "ForeignKey" if target else "", target,
        )
    for m in re.finditer(r"(\w+)\s*=\s*(?:\w+\.)?relationship\s*\(\s*['\"]?(\w+)", body):
        yield Field(m[1], "relationship", is_relation=True, relation_type="relationship", relation_target=m[2])


def typeorm_fields(body: str) -> Iterator[Field]:
    for m in re.finditer(r"@(PrimaryGeneratedColumn|PrimaryColumn|Column)\s*\(([^)]*)\)\s*(\w+)[?!]?\s*:\s*(\w+)", body):
        yield Field(
            m[3], SCRIPT_TYPES.get(m[4].lower(), m[4].upper()), bool(re.search(r"nullable\s*:\s*true", m[2])), m[1] != "Column",
            first(r"default\s*:\s*([^,}]+)", m[2]).strip(), _length(m[2], r"length\s*:\s*(\d+)"),
        )
    for m in re.finditer(r"@(ManyToOne|OneToMany|ManyToMany|OneToOne)\s*\(\s*\(\)\s*=>\s*(\w+)", body):
        yield Field(m[2].lower(), m[1], is_relation=True, relation_type=m[1], relation_target=m[2])


def sequelize_fields(body: str) -> Iterator[Field]:
    for m in re.finditer(r"(\w+)\s*:\s*\{\s*type\s*:\s*\w+\.(\w+)([^}]*)", body):
        yield Field(m[1], m[2].upper(), not re.search(r"allowNull\s*:\s*false", m[3]), bool(re.search(r"primaryKey\s*:\s*true", m[3])))


def mongoose_fields(body: str) -> Iterator[Field]:
    for m in re.finditer(r"(\w+)\s*:\s*\{\s*type\s*:\s*([\w.]+)([^}]*)", body):
        target = first(r"ref\s*:\s*['\"](\w+)", m[3])
        yield Field(m[1], m[2].rpartition(".")[2].upper(), not re.search(r"required\s*:\s*true", m[3]), is_relation=bool(target), relation_type="ref" if target else "", relation_target=target)


def gorm_fields(body: str) -> Iterator[Field]:
    for m in re.finditer(r"(?m)^[ \t]*(\w+)[ \t]+([\w.\[\]*]+)[ \t]*(?:`([^`\n]*)`)?", body):
        tag = first(r"gorm:\"([^\"]*)\"", m[3] or "")
        yield Field(
            m[1], GO_TYPES.get(m[2].lstrip("*"), m[2].lstrip("*").upper()), "not null" not in tag.lower(), "primarykey" in tag.lower(), first(r"default:([^;]+)", tag), _length(tag, r"size:(\d+)"),
        )


def eloquent_fields(body: str) -> Iterator[Field]:
    for name in re.findall(r"['\"](\w+)['\"]", first(r"\$fillable\s*=\s*\[([^\]]+)\]", body)):
        yield Field(name, "VARCHAR")


#: By orm: pattern of the class's name in its head, how its body ends (braces, indent, or so many characters at most within the first
#: braces), pattern of an explicit table in head and body, the table without one, and the fields.
READERS = {
    "jpa": (r"class\s+(\w+)", "braces", r"@Table\s*\(\s*(?:[^)]*?\bname\s*=\s*)?\"(\w+)\"", str, jpa_fields),
    "django": (r"class\s+(\w+)", "indent", r"db_table\s*=\s*['\"](\w+)['\"]", _snake, django_fields),
    "sqlalchemy": (r"class\s+(\w+)", "indent", r"__tablename__\s*=\s*['\"](\w+)['\"]", _snake, sqlalchemy_fields),
    "typeorm": (r"class\s+(\w+)", "braces", r"@Entity\s*\(\s*(?:\{\s*name\s*:\s*)?['\"](\w+)['\"]", str.lower, typeorm_fields),
    "sequelize": (r"['\"](\w+)['\"]", "braces", r"tableName\s*:\s*['\"](\w+)['\"]", str, sequelize_fields),
    "mongoose": (r"(\w+)\s*=", "braces", r"collection\s*:\s*['\"](\w+)['\"]", str.lower, mongoose_fields),
    "gorm": (r"type\s+(\w+)", "braces", r"tablename:(\w+)", _snake, gorm_fields),
    "eloquent": (r"class\s+(\w+)", "braces", r"\$table\s*=\s*['\"](\w+)['\"]", lambda n: _snake(n).replace("_", ""), eloquent_fields),
    "activerecord": (r"class\s+(\w+)", "none", r"table_name\s*=\s*['\"](\w+)['\"]", lambda n: _snake(n).replace("_", ""), lambda body: ()),
}


def orm_models(files: DataFrame, rules=MODEL_RULES) -> DataFrame:
    """repo_id, path, orm, class_name, table_name, line, fields (an array of structs), n_fields: one row per model class."""

    def read(path: str, text: str) -> Iterator[tuple]:
        ext, line = suffix(path), None
        for orm, extensions, pattern in rules:
            if ext not in extensions:
                continue
            named, ends, explicit, table, fields = READERS[orm]
            for m in re.finditer(pattern, text, re.ASCII):
                if ends == "indent":
                    start, stop = m.end(), indented_body(text, m.end())
                elif ends == "braces":
                    start, stop = brace_body(text, m.end() - (m[0][-1] == "{"))
                else:
                    start, stop = m.end(), m.end()
                body = text[start:stop].removeprefix("{")
                if orm == "gorm":
                    if "gorm.Model" not in body and "gorm:" not in body:
                        continue
                name = first(named, m[0])
                line = line or Lines(text)
                listed = list(fields(body))
                yield orm, name, first(explicit, m[0] + body) or table(name), line(m.start()), listed, len(listed)

    return rows_of_files(files, read, f"orm string, class_name string, table_name string, line long, fields {FIELDS}, n_fields long")


def model_fields(models: DataFrame) -> DataFrame:
    """One row per field, with its nine columns."""
    return models.select("repo_id", "path", "orm", "class_name", "table_name", F.posexplode("fields").alias("place", "f")).select("repo_id", "path", "orm", "class_name", "table_name", "place", "f.*")


def model_summary(models: DataFrame) -> DataFrame:
    return models.groupBy("repo_id").agg(F.count("*").alias("n_models"), F.sum("n_fields").alias("n_fields"), F.array_join(F.array_sort(F.collect_set("orm")), ",").alias("orms"))
