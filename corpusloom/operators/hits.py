"""Pattern hits with offsets and lines: one narrow pass over files, whatever the number of patterns.

A file's rows come from a small helper that sees one text at a time; Spark deals files to tasks in Arrow batches, and texts don't
leave their partition. Time is linear in the text for each pattern, however many matches it has."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Files, and bytes of text, that a step holds at most; a longer file is a step of its own.
STEP_ROWS, STEP_BYTES = 1000, 16 << 20


def suffix(path: str) -> str:
    """The lower-case extension, or nothing."""
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


class Lines:
    """Line numbers, from 1, of offsets in a text."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, offset: int) -> int:
        return bisect_left(self.ends, offset) + 1


def holds(text: str, start: int, end: int, conditions: Sequence[tuple[str, int, str, bool]]) -> bool:
    """Whether the surroundings of a match are as wanted."""
    for where, chars, pattern, wanted in conditions:
        if where == "before":
            part = text[max(0, start - chars) : start]
        elif where == "from":
            part = text[start : start + chars]
        else:
            stop = text.find("\n", end)
            part = text[start : stop if stop >= 0 else len(text)]
        if bool(re.search(pattern, part, re.ASCII)) != wanted:
            return False
    return True


def first(pattern: str, text: str) -> str:
    """The first group of the pattern's first match, or nothing."""
    m = re.search(pattern, text, re.ASCII)
    return (m[1] or "") if m else ""


def brace_body(text: str, start: int) -> tuple[int, int]:
    """From the first { at or after ``start`` to behind its }; to the end of the text if it isn't closed, empty without one."""
    depth, first_ = 0, -1
    for m in BRACES.finditer(text, start):
        if m[0] == "{":
            depth += 1
            first_ = m.start() if first_ < 0 else first_
        elif first_ >= 0:
            depth -= 1
            if not depth:
                return first_, m.end()
    return (first_, len(text)) if first_ >= 0 else (len(text), len(text))


def indented_body(text: str, start: int) -> int:
    """Where the block ends whose head begins the line that ``start`` lies on: before the next line that isn't blank, a comment or the
    end of a bracket, and isn't indented further."""
    line = text.rfind("\n", 0, start) + 1
    indent = INDENT.match(text, line).end() - line
    at = text.find("\n", start)
    while at >= 0:
        m = INDENT.match(text, at + 1)
        begin = m.end()
        if begin >= len(text):
            break
        if text[begin] not in "\n\r#)]}.," and begin - at - 1 <= indent:
            return at
        at = text.find("\n", begin)
    return len(text)


BRACES, INDENT = re.compile(r"[{}]"), re.compile(r"[ \t]*")


def rows_of_files(files: DataFrame, read: Callable[[str, str], Iterable[tuple]], schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """repo_id, path, the ``keep`` columns of the file and the columns of ``schema`` for each row that ``read(path, content)`` gives.
    A null content is empty."""
    same = ("repo_id", "path", *keep)
    shape = T.StructType([*(files.schema[c] for c in same), *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(shape)

    def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = 0
        while start < batch.num_rows:
            n = min(STEP_ROWS, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > STEP_BYTES:
                n //= 2
            yield batch.slice(start, n)
            start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                out: list[tuple] = []
                for content, *own in zip(*(part.column(c).to_pylist() for c in ("content", *same)), strict=True):
                    out += [(*own, *row) for row in read(own[1] or "", content or "")]
                columns = list(zip(*out, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.select(*same, "content").mapInArrow(run, shape)
