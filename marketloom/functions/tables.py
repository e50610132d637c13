"""Table functions for SQL: facts and sections of long documents.

``register_tables(spark)`` makes ``facts(body)``, ``facts(body, array('Tag', ...))`` and
``sections(html)`` known, for use as ``SELECT ... FROM docs, LATERAL facts(docs.body)``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DateType, DoubleType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

FACT = StructType()
for _name, _type in (("taxonomy", StringType()), ("tag", StringType()), ("unit", StringType()), ("period_end", DateType()), ("filed", DateType()), ("value", DoubleType()), ("form", StringType()), ("accession", StringType())):
    FACT.add(_name, _type)
SECTION = StructType().add("section", StringType()).add("body", StringType()).add("sha256", StringType())
_SPACE = re.compile(r"[ \t\n\r]*")
_DECODE = json.JSONDecoder(parse_constant=lambda word: (_ for _ in ()).throw(ValueError(word)))


class Pull:
    """A JSON text read on demand: members and items of what is open; only single values are
    ever built. Whatever breaks the grammar raises ValueError where it stands."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self._skip_space()

    def _skip_space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, char: str) -> None:
        if self.peek() != char:
            raise ValueError(f"no {char} at {self.at}")
        self.at += 1
        self._skip_space()

    def value(self):
        """The whole value that comes next."""
        out, self.at = _DECODE.raw_decode(self.text, self.at)
        self._skip_space()
        return out

    def _parts(self, begin: str, end: str, named: bool) -> Iterator[str | int]:
        self.take(begin)
        k = 0
        while self.peek() != end:
            if k:
                self.take(",")
            name = k
            if named:
                name = self.value()
                if not isinstance(name, str):
                    raise ValueError(f"no name at {self.at}")
                self.take(":")
            before = self.at
            yield name
            if self.at == before:  # nobody read it
                self.value()
            k += 1
        self.take(end)

    def members(self) -> Iterator[str]:
        """Names of an object's members; the reader stands on each one's value."""
        return self._parts("{", "}", True)

    def items(self) -> Iterator[int]:
        """Places of an array's items."""
        return self._parts("[", "]", False)

    def objects(self, kind: str) -> bool:
        """The next value is an object ({) or an array ([)."""
        return self.peek() == kind


def _date(value) -> dt.date | None:
    try:
        return dt.date.fromisoformat(value[:10]) if isinstance(value, str) else None
    except ValueError:
        return None


def read_facts(text: str, wanted: set[str] | None = None) -> Iterator[tuple]:
    """Rows of facts: taxonomy: tag: units: unit: [row]. Rows without a filing date, a period or
    a numeric value go; parts of another shape are passed over."""
    p = Pull(text)
    if not p.objects("{"):
        p.value()
    else:
        for top in p.members():
            if top != "facts" or not p.objects("{"):
                continue
            for taxonomy in p.members():
                for tag in p.members() if p.objects("{") else ():
                    if wanted is not None and tag not in wanted or not p.objects("{"):
                        continue
                    for part in p.members():
                        if part != "units" or not p.objects("{"):
                            continue
                        for unit in p.members():
                            for _ in p.items() if p.objects("[") else ():
                                row = p.value()
                                if not isinstance(row, dict):
                                    continue
                                end, filed, val = _date(row.get("end")), _date(row.get("filed")), row.get("val")
                                if end and filed and isinstance(val, (int, float)) and not isinstance(val, bool):
                                    yield taxonomy, tag, unit, end, filed, float(val), row.get("form"), row.get("accn")
    if p.at < len(text):
        raise ValueError(f"more text at {p.at}")


def _wants_string(argument: AnalyzeArgument, name: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, StringType):
        raise ValueError(f"{name} takes a string, not {'a table' if argument.isTable else argument.dataType.simpleString()}")


class Facts:
    """A row for each fact of a JSON document. A document that is null or not JSON to its end has
    none: it is read once to see that, holding nothing, and once for its rows."""

    @staticmethod
    def analyze(body: AnalyzeArgument, tags: AnalyzeArgument | None = None) -> AnalyzeResult:
        _wants_string(body, "facts")
        if tags is not None and not (isinstance(tags.dataType, ArrayType) and isinstance(tags.dataType.elementType, StringType)):
            raise ValueError("the tags of facts are an array of strings")
        return AnalyzeResult(FACT)

    def eval(self, body, tags=None):
        if body is None:
            return
        wanted = None if tags is None else set(tags)
        try:
            for _ in read_facts(body, wanted):
                pass
        except (ValueError, RecursionError):
            return
        yield from read_facts(body, wanted)


#: Fixed value: the headings of a filing that count.
_HEADING = re.compile(r"\bitem\s+(1a|1b|1c|1|2|3|7a|7|8)\s*[.:-]", re.I | re.A)
_OPEN = re.compile(r"<(script|style)", re.I)
_TAG = re.compile(r"<[^>]+>")


def plain(page: str) -> str:
    """HTML without scripts, styles and tags; a script that does not close is only a tag."""
    parts, at, unclosed = [], 0, set()
    for m in _OPEN.finditer(page):
        name = m[1].lower()
        if m.start() < at or name in unclosed:
            continue
        end = re.compile(f"</{name}>", re.I).search(page, page.find(">", m.end()) + 1) if page.find(">", m.end()) >= 0 else None
        if end is None:
            unclosed.add(name)
            continue
        parts.append(page[at : m.start()])
        at = end.end()
    return re.sub(r"[ \t\n\x0b\f\r\xa0]+", " ", html.unescape(_TAG.sub(" ", " ".join([*parts, page[at:]])))).strip(" ")


class Sections:
    """A row for each item of a filing: the longest text under one of its headings, of equally
    long ones the first; ``document`` if there is no heading. A null page counts as empty."""

    @staticmethod
    def analyze(page: AnalyzeArgument) -> AnalyzeResult:
        _wants_string(page, "sections")
        return AnalyzeResult(SECTION)

    def eval(self, page):
        text = plain(page or "")
        found = list(_HEADING.finditer(text))
        best: dict[str, tuple[int, int]] = {}
        for k, m in enumerate(found):
            end = found[k + 1].start() if k + 1 < len(found) else len(text)
            name = f"item_{m[1].lower()}"
            if name not in best or end - m.start() > best[name][1] - best[name][0]:
                best[name] = m.start(), end
        for name, (a, b) in (best or {"document": (0, len(text))}).items():
            yield name, text[a:b], hashlib.sha256(text[a:b].encode()).hexdigest()


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    spark.udtf.register("facts", udtf(Facts))
    spark.udtf.register("sections", udtf(Sections))
