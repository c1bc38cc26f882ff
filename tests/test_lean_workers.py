"""Python workers that encode and decode frames do without pandas, and read Arrow buffers as Arrow does."""

import os
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import PythonEvalType

import __spark_entry__
from tidewire.decode.batch import Bytes, given, integers, numbers
from tidewire.decode.binary import word_sum
from tidewire.decode.layout import LAYOUT, layout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Reads a batch of frames and link types as a worker does, and says whether pandas came with it.
WORKER = """
import sys
import pyarrow as pa
from tidewire.decode.binary import word_sum
from tidewire.decode.layout import layout
frames, links = next(iter(pa.ipc.open_stream(sys.stdin.buffer))).columns
found, sums = layout.func(frames, links), word_sum.func(frames)
assert len(found) == len(sums) == len(frames)
print("pandas" in sys.modules)
"""
HEADER = bytes.fromhex("02aabb010001005056000100" + "0800" + "4600003000010000400600000a000001c0a80101" + "94040000" + "0050" + "9c40" + "00" * 8 + "60000000" + "00000000" + "020405b4" + "01" * 8)
FRAMES = [HEADER, None, b"", b"\x01", HEADER[:20], b"\xff" * 61, HEADER + b"x"] * 9


def test_no_pandas_in_a_worker():
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(FRAMES, pa.binary()), pa.array([1, None, 113] * 21, pa.int32())], ["frame", "link_type"])
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    done = subprocess.run([sys.executable, "-c", WORKER], input=sink.getvalue().to_pybytes(), capture_output=True, cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, timeout=120)
    assert done.stdout.decode().strip() == "False", done.stderr.decode()[-2000:]


@pytest.mark.parametrize("first", [0, 1, 7, 8, 13])
@pytest.mark.parametrize("kind", [pa.int16(), pa.int32(), pa.int64()])
def test_buffers_are_read_as_arrow_reads_them(first, kind):
    values = pa.array([3, None, -7, 0, 1234] * 5, kind)[first:]
    assert given(values).tolist() == [v.is_valid for v in values]
    assert integers(values, -1).tolist() == values.fill_null(-1).to_pylist()
    assert integers(values[:0], -1).tolist() == []
    assert numbers(integers(values, 0), kind, given(values)).equals(values)
    assert numbers(integers(values, 0), kind).equals(values.fill_null(0))
    truth = pa.array([True, None, False, True, True] * 5)[first:]
    assert numbers(np.array([bool(v) for v in truth.to_pylist()]), pa.bool_(), given(truth)).equals(truth)


@pytest.mark.parametrize("first", [0, 1, 9])
def test_a_slice_of_frames_is_laid_out_as_the_frames(first):
    frames, links = pa.array(FRAMES, pa.binary()), pa.array([1] * len(FRAMES), pa.int32())
    some, all_ = layout.func(frames[first:], links[first:]), layout.func(frames, links)
    assert some.to_pylist() == all_.to_pylist()[first:]
    assert Bytes(frames[first:]).given.tolist() == [f is not None for f in FRAMES[first:]]
    assert [f.name for f in some.type] == LAYOUT.names
    some.validate(full=True)


@pytest.mark.parametrize("name", ["decode_arp", "decode_udp"])
def test_each_python_node_reads_arrow(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Spark turns the batches of a pandas function into pandas before the function is asked
    kinds = re.findall(r"ArrowEvalPython \[.*\], (\d+)", plan)
    assert kinds and set(kinds) == {str(PythonEvalType.SQL_SCALAR_ARROW_UDF)}


def test_sums_of_words(spark):
    rows = [(k, b) for k, b in enumerate([None, b"", b"\x01", b"\x01\x02", b"\x01\x02\x03", b"\xff" * 1499, *[bytes(range(k % 256)) for k in range(300)]])]
    made = spark.createDataFrame(rows, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("b", T.BinaryType())])).select("k", word_sum(F.col("b")).alias("n")).orderBy("k").collect()
    padded = [None if b is None else b + b"\0" * (len(b) % 2) for _, b in rows]
    assert [r.n for r in made] == [None if b is None else sum(b[0::2]) * 256 + sum(b[1::2]) for b in padded]
