"""Text answers of a live model's connector as a data source: rows of seven kinds of lines.

``spark.dataSource.register(ConnectorText)``, then ``spark.read.format("connector_text")`` with
``paths`` (comma-separated or a folder's glob on a shared file system) or, for text that is in a
table already, ``rows_of``. A file is a partition, so many answers are read side by side; lines
that look like data but can't be read are rows of the kind ``bad``.
"""

from __future__ import annotations

import glob
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id bigint, name string, n bigint, x double, y double, z double, x1 double, y1 double, z1 double"
# Lines that tell of the answer and not of elements.
META = ("model_title", "timestamp", "source", "type:", "language", "is_linked_doc", "note:", "units")
NUMBER = r"-?\d+\.?\d*"
PLACE = re.compile(rf"\s*(\d{{5,}})\s*,[^,]*,.*?\(\s*({NUMBER})\s*[,;]\s*({NUMBER})(?:\s*[,;]\s*({NUMBER}))?")
BOX = re.compile(r'\s*(\d+)\s*,\s*"?\[\s*\(([^)]*)\)\s*,\s*\(([^)]*)\)\s*\]')
CATEGORY = re.compile(r"-\s*Category\s*:\s*(.*)")
LABEL = re.compile(r"([A-Za-z_]+)\s*\[(\d+)\]\s*(\{[^}]*\})?\s*:(.*)")
SUBSET = re.compile(r"\s*(-?\d+)\s*,\s*(\d+)\s*,\s*(\d+)")
TITLE = re.compile(r"\s*model_title\s*:\s*(.+)", re.IGNORECASE)
LOOSE = re.compile(r"\b(\d{5,})\b")


def _row(kind: str, id_: int | None = None, name: str | None = None, n: int | None = None, low: tuple = (None,) * 3, high: tuple = (None,) * 3) -> tuple:
    return (kind, id_, name, n, *low, *high)


def parsed(lines: Iterator[str]) -> Iterator[tuple]:
    """Rows of SCHEMA: ``title`` (name), ``location`` (id and place), ``box`` (id and corners),
    ``category`` (name), ``listed`` (id under the label and category before it), ``subset`` (id of a
    compressed list, n of its elements, x none), ``loose`` (any other number of five digits and
    more), ``bad``."""
    category, label, opened = None, None, False
    for line in lines:
        if m := TITLE.match(line):
            yield _row("title", name=m[1].strip())
            continue
        if line.strip().lower().startswith(META):
            continue
        if m := CATEGORY.match(line.strip()):
            category, label, opened = m[1].strip(), None, False
            yield _row("category", name=category)
            continue
        if m := BOX.match(line):
            corners = [tuple(float(v) for v in part.split(",")) if _floats(part) else () for part in (m[2], m[3])]
            good = all(len(c) == 3 for c in corners)
            yield _row("box", int(m[1]), category, low=corners[0], high=corners[1]) if good else _row("bad", name=line.strip())
            continue
        if m := PLACE.match(line):
            yield _row("location", int(m[1]), category, low=(float(m[2]), float(m[3]), float(m[4]) if m[4] else None))
            continue
        if m := LABEL.search(line):
            label, opened = m[1], m[3] is not None
            name = f"{category}/{label}" if category else label
            rest = m[4]
            if opened and not rest.strip():
                continue  # a compressed list goes on in the next line
            if opened and (s := SUBSET.match(rest)):
                yield _row("subset", int(s[1]), name, int(s[2]))
            else:
                for number in re.findall(r"-?\d+", rest):
                    yield _row("listed", int(number), name, int(m[2]))
            opened = False
            continue
        if opened and (s := SUBSET.match(line)):
            yield _row("subset", int(s[1]), f"{category}/{label}" if category else label, int(s[2]))
            opened = False
            continue
        found = LOOSE.findall(line)
        for number in found:
            yield _row("loose", int(number), category)
        if not found and line.strip() and any(c.isdigit() for c in line) and "(" in line:
            yield _row("bad", name=line.strip())


def _floats(part: str) -> bool:
    try:
        return [float(v) for v in part.split(",")] is not None
    except ValueError:
        return False


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        given = [p.strip() for p in options.get("paths", "").split(",") if p.strip()]
        self.paths = sorted({f for p in given for f in (glob.glob(p) if any(c in p for c in "*?[") else [p])})

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no paths
            return
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield from parsed(f)


class ConnectorText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "connector_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def rows_of(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the rows of SCHEMA of answers that are in a table, a text in each row."""
    import pandas as pd

    names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *row) for k, t in zip(batch[key], batch[text], strict=True) if isinstance(t, str) for row in parsed(iter(t.splitlines()))]
            made = pd.DataFrame(out, columns=names)
            for c in ("id", "n"):
                made[c] = made[c].astype("Int64")
            yield made

    return answers.select(key, text).mapInPandas(run, f"{key} {dict(answers.dtypes)[key]}, {SCHEMA}")
