"""The few text functions that built-in expressions can't give: Arrow-batched, over whole columns."""

from __future__ import annotations

import math
import multiprocessing
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and the notation of floats, as Python has them.
GAP = r"(?U:[\s\x1c-\x1f])"
PYTHON_FLOAT = r"(?i)^[+-]?(inf(inity)?|nan|([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?)$"

GRADE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("correct", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("error_type", T.StringType()), T.StructField("error_message", T.StringType())])


def last_boxed(text: str | None) -> str | None:
    """The contents of the last \\boxed or \\fbox: a balanced group, or the rest up to $ or a line's end; empty and unclosed are None."""
    found = list(re.finditer(r"\\(?:boxed|fbox)", text or ""))
    if not found:
        return None
    rest = text[found[-1].end() :].lstrip()
    if not rest.startswith("{"):
        return re.match(r"[^$\r\n]*", rest)[0].strip() or None
    depth = 0
    for m in re.finditer(r"[{}]", rest):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return rest[1 : m.start()].strip() or None
    return None


def normal_text(text: str | None) -> str | None:
    """NFKC, white space collapsed."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split())


def column(f: Callable, kind: T.DataType, *cols: Column | str) -> Column:
    """f over columns, batch by batch; nulls are passed as None."""

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([f(*[None if x is None or x != x else x for x in row]) for row in zip(*parts, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(one if len(cols) == 1 else two, kind)(*cols)


def float_text(value: Column) -> Column:
    """Doubles as Python writes them; null stays."""
    return F.when(F.isnan(value), "nan").otherwise(column(lambda v: None if v is None else repr(v), T.StringType(), F.when(~F.isnan(value), value)))


def math_form(answer: Column) -> Column:
    """Answers for comparison: no dollar signs at the ends, text wrappers opened, gaps of one space; numbers as `float_text`.

    Only the writing of numbers leaves the JVM.
    """
    bare = F.regexp_replace(answer, rf"^{GAP}*\$*|\$*{GAP}*$", "")
    text = F.regexp_replace(F.regexp_replace(bare, r"\\text\{([^}]*)\}", "$1"), f"{GAP}+", " ")
    text = F.regexp_replace(text, "^ | $", "")
    return F.coalesce(float_text(_double(text)), text)


def math_equal(a: Column, b: Column) -> Column:
    """Whether two of `math_form`'s texts mean the same; null means nothing.

    Numbers may differ by less than 1e-6; where one is no number, backslashes, braces and gaps don't count.
    """
    gap = F.abs(_double(a) - _double(b))
    loose = lambda s: F.regexp_replace(s, rf"[\\{{}}]|{GAP}", "")
    return F.coalesce((a == b) | F.coalesce(gap < 1e-6, loose(a) == loose(b)), F.lit(False))


def _double(text: Column) -> Column:
    """The double of what Python's float takes, else null."""
    return F.when(text.rlike(PYTHON_FLOAT), F.regexp_replace(text, "_", "").try_cast("double"))


def _child(grade: Callable[[str, str], float], pipe: Connection) -> None:
    """A grader's own process: pairs in, scores or errors out, until the pipe ends."""
    while True:
        try:
            pair = pipe.recv()
        except EOFError:
            os._exit(0)
        try:
            said = ("ok", float(grade(*pair)), None)
        except TimeoutError as e:
            said = ("timeout", type(e).__name__, str(e))
        except BaseException as e:  # noqa: BLE001  a grader's failure is a result, an exit too
            said = ("error", type(e).__name__, str(e))
        pipe.send(said)


class Grader:
    """A grader with a limit in seconds that interrupts it, whatever it does.

    Calls go to a child process. One that gives no answer within the limit is killed, and the next call
    starts another: a grader that hangs, even outside Python, costs its limit and no more. `run` gives score, correct,
    status (ok, timeout, or error), error_type and error_message; a process that ends by itself is an error.
    """

    def __init__(self, grade: Callable[[str, str], float], limit: float) -> None:
        if not (math.isfinite(limit) and limit > 0):
            raise ValueError("a grader's limit is finite and positive")
        self.grade, self.limit = grade, limit
        self.process = self.pipe = None

    def _started(self) -> Connection:
        if self.process is None or not self.process.is_alive():
            self.close()
            fork = multiprocessing.get_context("fork")  # the grader needs no pickling
            self.pipe, other = fork.Pipe()
            self.process = fork.Process(target=_child, args=(self.grade, other), daemon=True)
            self.process.start()
            other.close()
        return self.pipe

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
        self.process = self.pipe = None

    def run(self, output: str | None, gold: str | None) -> dict:
        out = {"score": 0.0, "correct": False, "status": "ok", "error_type": None, "error_message": None}
        pipe = self._started()
        try:
            pipe.send((output or "", gold or ""))
            if not pipe.poll(self.limit):
                self.close()
                return out | {"status": "timeout", "error_type": "TimeoutError", "error_message": f"no grade within {self.limit:g} s"}
            status, value, message = pipe.recv()
        except (EOFError, OSError):
            self.close()
            return out | {"status": "error", "error_type": "ChildProcessError", "error_message": "the grader's process ended"}
        if status == "ok":
            return out | {"score": value, "correct": value > 0.5}
        return out | {"status": status, "error_type": value, "error_message": message.replace("\n", " ")[:300]}


def grade_status(rows: DataFrame, output: str, gold: str, grade: Callable[[str, str], float], limit: float = 30.0) -> DataFrame:
    """rows with `grade`, a struct of score, correct, status, error_type and error_message. A task has one child process at a time."""

    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = Grader(grade, limit)
        try:
            for a, b in parts:
                yield pd.DataFrame([own.run(x, y) for x, y in zip(a, b, strict=True)], columns=GRADE.fieldNames())
        finally:
            own.close()

    return rows.withColumn("grade", F.pandas_udf(batches, GRADE)(output, gold))


def scored(rows: DataFrame, ids: str, scorer: Callable[[list[list[int]]], list[float]], batch: int = 64) -> DataFrame:
    """rows with `score`: token lists go to the scorer in batches sorted by length, so padding stays small."""
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(frames):
        for pdf in frames:
            order = sorted(range(len(pdf)), key=lambda i: len(pdf[ids].iat[i]))
            out = [0.0] * len(pdf)
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                for i, s in zip(some, scorer([list(pdf[ids].iat[i]) for i in some]), strict=True):
                    out[i] = float(s)
            yield pdf.assign(score=out)

    return rows.mapInPandas(run, schema)
