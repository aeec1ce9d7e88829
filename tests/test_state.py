"""Bounded caches of models and references, and a stream's work with its done keys in the state store."""

import os

import pytest
from pyspark.sql import functions as F

from pairloom.operators import resume
from pairloom.streaming import jobs


def test_memo_is_bounded():
    memo, asked = resume.Memo(2), []
    for k in "abacab":
        assert memo.get(k, lambda: asked.append(k) or k.upper()) == k.upper()
    assert asked == ["a", "b", "c", "a", "b"] and len(memo.held) == 2 and memo.made == 5
    with pytest.raises(RuntimeError):
        memo.get("z", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert "z" not in memo.held and memo.get("z", lambda: 1) == 1
    with pytest.raises(ValueError, match="one result at least"):
        resume.Memo(0)


def test_file_marks(tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("one")
    first = resume.file_marks(str(a))
    assert first == resume.file_marks([str(a)]) and first[0][1] == 3
    a.write_text("other")
    assert resume.file_marks(str(a)) != first
    os.remove(a)
    assert resume.file_marks([str(a), None]) == ((repr(str(a)), None, None), ("None", None, None))


def test_references_are_prepared_once(spark, tmp_path):
    """As often as there are files (and workers), not as often as there are rows; again when a file has changed."""
    log, files = tmp_path / "log", [tmp_path / f"{i}.txt" for i in range(3)]
    log.mkdir()
    for i, f in enumerate(files):
        f.write_text(f"voice {i}")

    def prepare(model, path):
        import pathlib
        import uuid

        (pathlib.Path(str(log)) / f"{os.path.basename(path)}-{uuid.uuid4().hex}").write_text("")
        return pathlib.Path(path).read_text() + model

    slot = resume.Slot("say", "said string", lambda: "!", lambda model, row, voice: {"said": f"{voice} {row['text']}"}, reference="voice", prepare=prepare)
    rows = spark.createDataFrame([(i, f"t{i}", str(files[i % 3]) if i != 50 else str(tmp_path / "gone")) for i in range(90)], "id int, text string, voice string").coalesce(1)
    got = {r.id: r for r in slot.run(rows, ["text", "voice"], ["id"]).collect()}
    assert got[4].said == "voice 1! t4" and got[50].said is None and got[50].error_message.startswith("FileNotFoundError")
    assert len(got) == 90 and len(list(log.iterdir())) == 4  # three files, and the one that isn't there
    files[1].write_text("another voice")
    assert {r.id: r.said for r in slot.run(rows.where("id = 4"), ["text", "voice"], ["id"]).collect()} == {4: "another voice! t4"}
    with pytest.raises(ValueError, match="go together"):
        resume.Slot("x", "y string", lambda: 0, lambda m, r: {}, reference="voice")


def test_models_of_one_name(spark):
    """Slots of one name with other loaders have their own models."""
    rows = spark.createDataFrame([(1, "a")], "id int, text string").coalesce(1)
    for sign in ("load_a", "load_b"):
        load = {"load_a": lambda: "A", "load_b": lambda: "B"}[sign]
        slot = resume.Slot("same", "out string", load, lambda model, row: {"out": model})
        assert slot.run(rows, ["text"], ["id"]).first().out == sign[-1].upper()


def test_stream_does_each_key_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    files = {k: tmp_path / f"{k}.txt" for k in range(4)}
    for f in files.values():
        f.write_text("bad")
    files[2].write_text("good")

    def call(model, row):
        with open(row["path"]) as f:
            text = f.read()
        if text == "bad":
            raise RuntimeError("bad file")
        return {"text_out": f"{text} {row['line']}"}

    slot = resume.Slot("read", "text_out string", lambda: 0, call)

    def step(batch):
        spark.createDataFrame([(k, line, None if k is None else str(files[k])) for k, line in batch], "k int, line string, path string").coalesce(1).write.mode("append").parquet(src)
        stream = jobs.event_stream(spark, src, spark.read.parquet(src).schema, "*.parquet", files=100)
        jobs.process_keyed(stream, out, ckpt, ["k"], slot, ["line", "path"], "path").awaitTermination()
        return sorted((r.k is not None, r.k, r.text_out, r.status) for r in jobs.settled(spark.read.parquet(out), ["k"]).collect())

    assert step([(1, "x"), (2, "y"), (2, "a"), (2, "y"), (None, "n")]) == [(False, None, None, "failed"), (True, 1, None, "failed"), (True, 2, "good a", "ok")]
    files[1].write_text("fine")
    # a failed key comes again, a good one with the same file doesn't
    assert step([(1, "x"), (2, "b")])[1:] == [(True, 1, "fine x", "ok"), (True, 2, "good a", "ok")]
    files[2].write_text("changed")
    assert step([(1, "z"), (2, "c")])[1:] == [(True, 1, "fine x", "ok"), (True, 2, "changed c", "ok")]
    n = spark.read.parquet(out).groupBy("k").count().where("k is not null")
    assert {r.k: r["count"] for r in n.collect()} == {1: 2, 2: 2}
    # the last batch is replayed when its commit is lost: the same rows, once
    commits = sorted((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].parent / f".{commits[-1].name}.crc"):
        p.unlink(missing_ok=True)
    before = sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    stream = jobs.event_stream(spark, src, spark.read.parquet(src).schema, "*.parquet", files=100)
    jobs.process_keyed(stream, out, ckpt, ["k"], slot, ["line", "path"], "path").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == before
    assert spark.read.parquet(out).where(F.col("batch") > 10).count() == 0
