"""Lines of a store by where they stand, whatever their times."""

import json

import pytest

from tidewire.operators import store


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """A file of many splits: equal times, three types, lines that do not parse, blank ones."""
    folder = tmp_path_factory.mktemp("store")
    with open(folder / "a.jsonl", "w") as out:
        for k in range(5000):
            if k % 50 == 7:
                out.write('{"type": "scan", broken\n')
            elif k % 50 == 9:
                out.write("  \n")
            else:
                out.write(json.dumps({"type": ("scan", "capture", "note")[k % 3], "ts": 1, "data": {"k": k, "name": f"Host{k % 40}"}}) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    yield str(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def wanted(path):
    out = []
    for line in open(path + "/a.jsonl"):
        try:
            out.append((line.rstrip("\n"), json.loads(line)))
        except ValueError:
            pass
    return out


def test_many_splits(spark, path):
    assert store.lines(spark, path).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("kind", [None, "scan"])
@pytest.mark.parametrize("last", [None, 1, 37, 100_000])
def test_last(spark, path, kind, last):
    rows = [r["data"]["k"] for _, r in wanted(path) if kind in (None, r["type"])]
    got = [json.loads(r.data)["k"] for r in store.records(spark, path, kind, last).collect()]
    assert (got if last else sorted(got)) == (rows[-last:] if last else rows)


@pytest.mark.parametrize("part,limit", [("HOST17", 20), ("host3", 7), ("nowhere", 5), ("", 5), ("scan", 10_000)])
def test_first(spark, path, part, limit):
    rows = [line for line, _ in wanted(path) if part and part.lower() in line.lower()][:limit]
    assert [r.value for r in store.search_lines(spark, path, part, limit).collect()] == rows


def test_nothing(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    assert store.records(spark, str(tmp_path), last=3).count() == store.search_lines(spark, str(tmp_path), "x").count() == 0
