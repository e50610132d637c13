"""Masking by recursion over parsed values, and the sink's files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.operators.redaction import MALFORMED, mask_json, mask_value, redact_json
from marketloom.sources.jsonl_sink import JsonlWriter, register_sink

NAMES = st.sampled_from(["a", "note", "token", "Api_Key", "myPassword2", "account_number", "x\"y", "", "tokén"])
VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(NAMES, x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.booleans(), st.sampled_from([None, 2]))
def test_equals_recursion(value, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    assert json.loads(mask_json(text)) == mask_value(value)


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"token":{"value":"abc123"}}', '{"token":"[redacted]"}'),
        ('{"secret":[{"k":"s3"}], "n": 1.50}', '{"secret":"[redacted]", "n": 1.50}'),
        ('{"password":[["p1"]]}', '{"password":"[redacted]"}'),
        ('{"note":"say \\"token\\": x"}', '{"note":"say \\"token\\": x"}'),
        ('{"tok\\u0065n": 1, "token": 2}', '{"tok\\u0065n": "[redacted]", "token": "[redacted]"}'),
        ('{"a": 1} {"token": 2}', MALFORMED), ('{"token": NaN}', MALFORMED), ("{'token': 1}", MALFORMED), ("", MALFORMED), (None, MALFORMED), ('"token"', '"token"'),
        ('{"x": {"token": "s"}, "token": {"token": {}}, "z": []}', '{"x": {"token": "[redacted]"}, "token": "[redacted]", "z": []}'),
    ],
)
def test_by_hand(text, want):
    assert mask_json(text) == want


def test_deep_and_long_records():
    deep = "[" * 5000 + '{"token": "s3cret"}' + "]" * 5000
    out = mask_json(deep)
    assert "s3cret" not in out and (out == MALFORMED or out.endswith('{"token": "[redacted]"}' + "]" * 5000))
    long = json.dumps({"list": [{"k": "v" * 50, "token": ["s3cret"] * 3}] * 20_000})
    assert "s3cret" not in mask_json(long)


def test_column(spark):
    df = spark.createDataFrame([('{"api_key": [1, {"a": 2}]}',), (None,), ("{oops",)], "b string")
    assert [r.v for r in df.select(redact_json(F.col("b")).alias("v")).collect()] == ['{"api_key": "[redacted]"}', MALFORMED, MALFORMED]


def test_sink_appends_overwrites_and_hides(spark, tmp_path):
    register_sink(spark)
    path = str(tmp_path / "out")
    row = spark.createDataFrame(
        [(1, '{"token": [2]}', "key=sk-abcDEF0123456789", {"secret": "s", "b": "c"}, dt.datetime(2024, 1, 2), float("nan"), ["x\ny"])],
        "id long, payload string, note string, m map<string,string>, at timestamp, v double, l array<string>",
    )
    save = lambda mode: row.write.format("redacted_jsonl").option("json", "payload").option("text", "note").mode(mode).save(path)
    save("append")
    save("append")
    lines = [json.loads(x.value) for x in spark.read.text(path, pathGlobFilter="*.jsonl").collect()]
    assert len(lines) == 2 and lines[0] == lines[1]
    assert lines[0] | {"at": ""} == {"id": 1, "payload": {"token": "[redacted]"}, "note": "[redacted]", "m": {"secret": "[redacted]", "b": "c"}, "at": "", "v": None, "l": ["x\ny"]}
    save("overwrite")
    assert spark.read.text(path, pathGlobFilter="*.jsonl").count() == 1


def test_a_job_that_fails_leaves_nothing(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "out")
    w = JsonlWriter(path, [], [], False)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    first, again = w.write(iter([batch])), w.write(iter([batch]))  # a task and its second attempt
    assert not list((tmp_path / "out").glob("*.jsonl"))
    w.commit([again])
    assert len(list((tmp_path / "out").iterdir())) == 1 and first.files != again.files
    v = JsonlWriter(path, [], [], False)
    v.write(iter([batch]))
    v.abort([])
    assert len(list((tmp_path / "out").iterdir())) == 1
