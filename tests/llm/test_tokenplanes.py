"""Files of token planes: exact round trips of ids, planes, chunks and documents in any order of reading."""

import io
import json
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewire.llm import entry, tokenplanes

SF = "/root/testdata/sf0.001"


def brute(rows):
    exact = Tokenizer.from_file(entry.tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


@pytest.mark.parametrize("width", (1, 8))
def test_planes(width):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 2), (1000, 50_257), (65_536, 1 << 32), (9, 1 << 16)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        planes = tokenplanes.to_planes(ids, width)
        assert len(planes) <= 32 // width
        assert np.array_equal(tokenplanes.from_planes(planes, n, width), ids)


@pytest.mark.parametrize("width", (1, 8))
@pytest.mark.parametrize("chunk", (1, 5, 64))
def test_every_range_of_chunks(width, chunk):
    rng = random.Random(chunk)
    docs = [(k if k % 7 else None, np.array([rng.randrange(300) for _ in range(rng.choice((1, 2, 3, 40)))], dtype=np.uint32)) for k in range(60)]
    out = io.BytesIO()
    writer = tokenplanes.ChunkWriter(out, width, chunk)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = tokenplanes.ChunkReader(pa.BufferReader(out.getvalue()))
    assert len(reader.index) == -(-sum(len(i) for _, i in docs) // chunk)
    for step in (1, 3, 1000):
        got = [d for k in range(0, len(reader.index), step) for batch in reader.documents(k, min(k + step, len(reader.index))) for d in batch]
        assert [(d, ids.tolist()) for d, _, ids in got] == [(d, ids.tolist()) for d, ids in docs]
        assert [s for _, s, _ in got] == np.cumsum([0, *(len(i) for _, i in docs)])[:-1].tolist()


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, entry.op11_token_planes(spark, SF).collect())) == brute(docs)


def test_odd_rows(spark, tmp_path):
    rows = [(3, None), (1, ""), (1, "same text"), (None, "no id"), (2, "é́à 𝔘nicode <|endoftext|> İ"), (9, "long " * 60_000), (-4, "x"), *[(5, "copy of a row")] * 200]
    odd = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(5)
    exact = Tokenizer.from_file(entry.tokenizer_path())
    key = lambda r: r[1]
    for n, (planes, hot) in enumerate((("bit", 1 << 20), ("byte", 10))):
        path = str(tmp_path / f"planes{n}")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tokenplanes.write(odd, path, entry.tokenizer_path(), planes=planes, chunk=100, hot_bytes=hot)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        got = tokenplanes.read(spark, path, ids=True, step=2).collect()
        assert sorted((tuple(r)[:4] for r in got), key=key) == brute(rows)
        texts = {r.doc_id: exact.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist(), skip_special_tokens=False) for r in got}
        assert texts[9] == "long " * 60_000 and texts[None] == "no id"
        files = json.load(open(f"{path}/manifest.json"))["files"]
        assert sum(f["ids"] for f in files) == sum(r.n_tokens for r in got)
    assert len({f["part"] for f in files}) > 1  # copies of one row were dealt out
    tokenplanes.write(odd.limit(0), str(tmp_path / "none"), entry.tokenizer_path())
    assert tokenplanes.read(spark, str(tmp_path / "none")).count() == 0
