"""Blocks that are written and read back, and loads that are published by a rename."""

import json

import pytest

from truecolumn.errors import ExistingTableError, LoadError, SchemaError
from truecolumn.sinks import block_files as W
from truecolumn.sinks import tables as S


@pytest.mark.parametrize("codec", ["off", "zstd", "lz4", "gzip", None])
def test_blocks_come_back(spark, tmp_path, codec):
    df = spark.range(3000).repartition(4).selectExpr("id", "repeat('é\n\"', cast(id % 50 AS int)) AS text")
    path = W.write_blocks(df, str(tmp_path / "b"), codec, limit=5000)
    blocks = W.read_blocks(spark, path).collect()
    assert len(blocks) > 20 and all(len(b.body.encode()) == b.raw_bytes <= 5000 for b in blocks)
    # No two neighbours of a partition would fit one block.
    by_shard = {}
    for b in sorted(blocks, key=lambda b: (b.shard, b.block)):
        by_shard.setdefault(b.shard, []).append(b)
    for own in by_shard.values():
        assert [b.block for b in own] == list(range(len(own)))
        assert all(a.raw_bytes + 1 + len(b.body.split("\n")[0].encode()) > 5000 for a, b in zip(own, own[1:], strict=False))
    read = sorted((json.loads(r.line) for r in W.read_block_lines(spark, path).collect()), key=lambda r: r["id"])
    assert read == [{"id": i, "text": 'é\n"' * (i % 50)} for i in range(3000)]
    index = W.block_index(spark, path).collect()
    assert sum(r.rows for r in index) == 3000 and {r.codec for r in index} == {codec or "off"}
    assert json.loads((tmp_path / "b" / "_SUCCESS").read_text())["blocks"] == len(blocks)
    assert list((tmp_path / "b" / "_writing").glob("*")) == []
    with pytest.raises(LoadError, match="exists"):
        W.write_blocks(df, path)


def test_failed_blocks_leave_nothing(spark, tmp_path):
    df = spark.range(100).repartition(4).selectExpr("id", "repeat('x', if(id = 77, 900, 5)) AS text")
    with pytest.raises(LoadError, match="nothing was created"):
        W.write_blocks(df, str(tmp_path / "b"), "zstd", limit=200)
    assert not list((tmp_path / "b").rglob("*.*")) if (tmp_path / "b").exists() else True
    with pytest.raises(SchemaError):
        W.write_blocks(df, str(tmp_path / "c"), "brotli")
    empty = W.write_blocks(df.where("id < 0"), str(tmp_path / "e"))
    assert json.loads((tmp_path / "e" / "_SUCCESS").read_text())["blocks"] == 0 and empty


def test_a_stopped_load_leaves_no_target(spark, monkeypatch):
    df = spark.range(5).selectExpr("id", "cast(id AS string) AS v")
    real = S.publish

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(S, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        S.load_table(df, "default.stopped")
    assert not spark.catalog.tableExists("stopped")
    (left,) = [n for n in S.abandoned_loads(spark, "default") if n.startswith("default.stopped")]
    monkeypatch.setattr(S, "publish", real)
    assert S.load_table(df, "default.stopped").count() == 5
    S.drop_tables(spark, [left])
    assert not [n for n in S.abandoned_loads(spark, "default") if "stopped" in n]


def test_progress_of_a_slow_load(spark, tmp_path):
    import time

    from truecolumn.plans.mapping import ColumnMapping
    from truecolumn.sinks.load_runs import load, source_bytes
    from truecolumn.sources.csv_text import read_text_table

    folder = tmp_path / "with space"
    folder.mkdir()
    for i in range(12):
        (folder / f"{i}.csv").write_text("id\n" + f"{i}\n" * 200)
    text = read_text_table(spark, str(folder)).repartition(12)
    assert source_bytes(text) == sum(f.stat().st_size for f in folder.iterdir())

    def slow(batches):
        for batch in batches:
            time.sleep(0.4)
            yield batch

    seen = []
    mapping = [ColumnMapping("id", "id", "Int64", "Int64")]
    read = read_text_table(spark, str(folder))
    lazy = read.mapInPandas(slow, read.schema)
    run = load(lazy, mapping, "watched_load", report=seen.append)
    assert run.rows == 2400 and run.src_bytes == seen[-1].read_bytes == seen[-1].total_bytes > 0
    reads, tasks = [p.read_bytes for p in seen], [p.tasks_done for p in seen]
    assert reads == sorted(reads) and tasks == sorted(tasks) and seen[-1].tasks_done == seen[-1].tasks_known
    assert "of 0.0 MB (100 %)" in seen[-1].line()

    def broken(_):
        raise RuntimeError("no screen")

    assert load(lazy, mapping, "watched_again", report=broken).rows == 2400


def test_fate_is_read_from_the_catalog(spark, monkeypatch):
    df = spark.range(5).selectExpr("id", "cast(id AS string) AS v")
    real = S.publish

    def refused(*_):
        raise RuntimeError("no rename today")

    monkeypatch.setattr(S, "publish", refused)
    with pytest.raises(LoadError, match="nothing was created"):
        S.load_table(df, "refused")
    assert not spark.catalog.tableExists("refused") and not [n for n in S.abandoned_loads(spark, "default") if "refused" in n]

    def reported_as_failed(session, staging, name):
        real(session, staging, name)
        raise RuntimeError("connection lost")

    monkeypatch.setattr(S, "publish", reported_as_failed)
    assert S.load_table(df, "published", S.Layout(shard_by="id", shards=4)).count() == 5

    def too_late(session, staging, name):
        session.range(7).write.saveAsTable(name)
        real(session, staging, name)

    monkeypatch.setattr(S, "publish", too_late)
    with pytest.raises(ExistingTableError):
        S.load_table(df, "taken")
    assert spark.table("taken").count() == 7 and not [n for n in S.abandoned_loads(spark, "default") if "taken" in n]
