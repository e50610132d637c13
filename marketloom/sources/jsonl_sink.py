"""A sink of redacted JSON lines, as a Python data source with commit.

``df.write.format("redacted_jsonl").mode("append").save(path)`` adds a line a row. Tasks write to
a hidden folder of the job; only a commit moves the files of the attempts that count beside those
of earlier appends, so a lost executor or a failed job leaves nothing that readers see.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from marketloom.operators.records import SECRET_PATTERNS
from marketloom.operators.redaction import MASK, mask_json, mask_value, secret

FILE_BYTES = 128 << 20


def folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def plain(value: Any) -> Any:
    """A value of a column as JSON has it."""
    if isinstance(value, (dt.datetime, dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class JsonlWriter(DataSourceArrowWriter):
    def __init__(self, path: str, json_columns: list[str], text_columns: list[str], overwrite: bool):
        self.path, self.json_columns, self.text_columns, self.overwrite = path, json_columns, text_columns, overwrite
        self.job = uuid.uuid4().hex

    def line(self, row: dict[str, Any]) -> str:
        """One record: names mask, JSON text is put in as JSON, free text loses what looks secret."""
        parts = []
        for name, value in row.items():
            if secret(name):
                text = json.dumps(MASK)
            elif name in self.json_columns:
                text = "null" if value is None else mask_json(value)
            else:
                if name in self.text_columns and value is not None:
                    for pattern in SECRET_PATTERNS:
                        value = re.sub(pattern, MASK, value)
                text = json.dumps(mask_value(plain(value)), ensure_ascii=False, allow_nan=False)
            parts.append(f"{json.dumps(name, ensure_ascii=False)}:{text}")
        return re.sub(r"[\r\n]+", " ", "{" + ",".join(parts) + "}")  # line ends stand between JSON tokens only

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = folder(self.path)
        stage = f"{root}/_staged-{self.job}"
        fs.create_dir(stage, recursive=True)
        names, out = [], None
        for batch in iterator:
            for row in batch.to_pylist(maps_as_pydicts="lossy"):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.jsonl")
                    out = fs.open_output_stream(f"{stage}/{names[-1]}", compression=None)
                out.write(self.line(row).encode() + b"\n")
                if out.tell() > FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = folder(self.path)
        stage = f"{root}/_staged-{self.job}"
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".jsonl")] if self.overwrite else []
        fs.create_dir(root, recursive=True)
        for name in (x for m in messages if m for x in m.files):
            fs.move(f"{stage}/{name}", f"{root}/{name}")
        for path in old:
            fs.delete_file(path)
        self._clear(fs, stage)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = folder(self.path)
        self._clear(fs, f"{root}/_staged-{self.job}")

    def _clear(self, fs: pafs.FileSystem, stage: str) -> None:
        if fs.get_file_info(stage).type == pafs.FileType.Directory:
            fs.delete_dir(stage)


class RedactedJsonl(DataSource):
    """Options: path; json, text: columns (comma-separated) with JSON text, with free text."""

    @classmethod
    def name(cls) -> str:
        return "redacted_jsonl"

    def writer(self, schema, overwrite: bool) -> JsonlWriter:
        named = lambda option: [c.strip() for c in self.options.get(option, "").split(",") if c.strip()]
        return JsonlWriter(self.options["path"], named("json"), named("text"), overwrite)


def register_sink(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(RedactedJsonl)
