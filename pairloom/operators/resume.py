"""Work that resumes, keeps its failures, and calls models through declared slots."""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pending(todo: DataFrame, done: DataFrame, keys: list[str], retry: Column | None = None) -> DataFrame:
    """Rows of todo that done doesn't hold; where `retry` is true of a done row, it is done again."""
    finished = done if retry is None else done.where(~F.coalesce(retry, F.lit(False)))
    return todo.join(finished.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def carried(rows: DataFrame, cached: DataFrame, keys: list[str], values: list[str], error: str = "error") -> DataFrame:
    """rows with cached values where they were measured without an error, and `reused`."""
    have = cached.where(F.coalesce(F.col(error), F.lit("")) == "").select(*keys, *values, F.lit(True).alias("_have"))
    return rows.join(have, keys, "left").withColumn("reused", F.coalesce("_have", F.lit(False))).drop("_have")


def first_errors(rows: DataFrame, order: str, error: str = "error", most: int = 20) -> DataFrame:
    """The first failures of a run, in order."""
    return rows.where(F.coalesce(F.col(error), F.lit("")) != "").orderBy(order).limit(most)


def sample_keys(rows: DataFrame, key: str, n: int, by: list[str], seed: int) -> DataFrame:
    """All rows of n keys for each value of `by`, drawn without replacement in the order of a seeded hash of the key."""
    from pyspark.sql import Window as W

    keys = rows.select(*by, key).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string")), 256), key))
    return rows.join(keys.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r"), [*by, key], "left_semi")


def file_marks(paths: object) -> tuple:
    """Path, size and time of change of each file: a file that is written again has other marks. What is no file on this
    machine is marked by itself alone."""
    marks = []
    for path in paths if isinstance(paths, (list, tuple)) else [paths]:
        try:
            stat = os.stat(path)
            marks.append((str(path), stat.st_size, stat.st_mtime_ns))
        except (OSError, TypeError, ValueError):
            marks.append((repr(path), None, None))
    return tuple(marks)


class Memo:
    """At most `keep` results; the one that came first goes first. A result that couldn't be made isn't kept."""

    def __init__(self, keep: int):
        if keep < 1:
            raise ValueError("a memo keeps one result at least")
        self.keep, self.held, self.made = keep, OrderedDict(), 0

    def get(self, key: object, make: Callable[[], object]) -> object:
        if key not in self.held:
            got = make()
            self.made += 1
            while len(self.held) >= self.keep:
                self.held.popitem(last=False)
            self.held[key] = got
        return self.held[key]


#: Fixed value: references that a worker keeps.
KEEP = 16
#: What a worker process holds: loaded models, and what they made of reference files.
_models, _references = Memo(KEEP), Memo(KEEP)


class Slot:
    """A model behind a declared schema: `load` runs once for each worker, `call` on batches of rows.

    A row that fails, or a batch that does, comes back with the stage's name and the message, cut to `most` characters;
    nothing is lost and the job goes on. With `prepare` and `reference`, what the model makes of a row's reference file (or
    files) is made once in a worker for as long as the file stays the same, and handed to `call`; KEEP of them are held.
    `files` are the model's own: a model whose files have changed is loaded again.
    """

    def __init__(self, name: str, schema: str, load: Callable[[], object], call: Callable[..., dict], most: int = 1000, files: tuple[str, ...] = (), reference: str | None = None, prepare: Callable[[object, object], object] | None = None):
        if (reference is None) != (prepare is None):
            raise ValueError("a reference column and what prepares it go together")
        self.name, self.schema, self.load, self.call, self.most = name, schema, load, call, most
        self.files, self.reference, self.prepare, self.names = files, reference, prepare, []

    def one(self, row: dict) -> dict:
        """What the slot makes of a row, with error_stage and error_message."""
        made = dict.fromkeys(self.names)
        # functions come to each task as new objects, but with equal code
        mine = (self.name, getattr(self.load, "__code__", None), file_marks(list(self.files)))
        model = _models.get(mine, self.load)
        try:
            if self.prepare is None:
                got = self.call(model, row)
            else:
                path = row[self.reference]
                path = path.tolist() if hasattr(path, "tolist") else path
                got = self.call(model, row, _references.get((mine, getattr(self.prepare, "__code__", None), file_marks(path)), lambda: self.prepare(model, path)))
            return {**made, **got, "error_stage": "", "error_message": ""}
        except Exception as e:  # noqa: BLE001  kept as the row's result
            return {**made, "error_stage": self.name, "error_message": f"{type(e).__name__}: {e}"[: self.most]}

    def run(self, rows: DataFrame, inputs: list[str], keys: list[str], distinct: bool = False) -> DataFrame:
        """keys with the slot's columns, error_stage and error_message. With distinct, equal inputs are computed once."""
        if distinct:
            once = self.run(rows.select(*inputs).distinct(), inputs, inputs)
            return rows.select(*keys, *[c for c in inputs if c not in keys]).join(once, inputs).select(*keys, *[c for c in once.columns if c not in inputs])
        source = rows.select(*keys, *[c for c in inputs if c not in keys])
        made = self.names = T._parse_datatype_string(self.schema).fieldNames()

        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                out = [{k: row[k] for k in keys} | self.one(row) for row in pdf.to_dict("records")]
                yield pd.DataFrame(out, columns=[*keys, *made, "error_stage", "error_message"])

        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        return source.mapInPandas(batches, f"{kinds}, {self.schema}, error_stage string, error_message string")


#: Declared outputs of the model slots that a speech pipeline fills; the engine owns what comes before and after.
SLOTS = {
    "recognise": "text string, segments array<struct<start:double,end:double,text:string>>",
    "translate": "text string",
    "nbest": "candidates array<struct<text:string,score:double>>",
    "synthesise": "rate int, samples array<float>",
    "embed": "embedding array<float>",
    "detect_language": "language string, confidence double",
    "align": "words array<struct<word:string,start:double,end:double>>",
    "separate": "vocals array<float>, background array<float>",
    "pitch": "f0_hz array<float>, voiced array<boolean>, rms array<float>, duration double",
    "probe": "seconds double, has_video boolean",
}
