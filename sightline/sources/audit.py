"""Hash-chained logs: one JSON object a line, each with the hash of the line before and its own."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64  # fixed value: what the first line's prev is
TYPES = {"header": {"input": str}, "frame": {"size": int}, "footer": {"status": str}}


def canonical(record: dict) -> str:
    """The one text of a record: keys sorted, no spaces, ASCII; a number that isn't finite is an error."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), allow_nan=False)


def chained(payloads: list[dict], prev: str = GENESIS, seq: int = 0) -> list[str]:
    """The log lines of payloads, after a line with hash prev."""
    lines = []
    for k, payload in enumerate(payloads, seq):
        record = payload | {"seq": k, "prev": prev}
        prev = hashlib.sha256((prev + canonical(record)).encode()).hexdigest()
        lines.append(canonical(record | {"hash": prev}))
    return lines


def write_logs(payloads: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """key, number (from 1) and line: the payloads (JSON objects) of each key as a log. A hash needs the one before, so a log is one task's work."""

    def kernel(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lines = chained([json.loads(x) for x in rows.sort_values(order)[payload]])
        return pd.DataFrame({key: name[0], "number": range(1, len(lines) + 1), "line": lines})

    return payloads.select(key, order, payload).groupBy(key).applyInPandas(kernel, f"{key} {dict(payloads.dtypes)[key]}, number long, line string")


SAID = "struct<json: boolean, seq: long, prev: string, type: string, stored: string, computed: string>"


def parsed(lines: pa.Array) -> pa.Array:
    """What a line says, and the hash that it should have."""
    out = []
    for text in lines.to_pylist():
        try:
            record = json.loads(text)
            seq, stored = record["seq"], record.pop("hash")
            prev = record.get("prev", "")
            own = hashlib.sha256((str(prev) + canonical(record)).encode()).hexdigest()
            out.append({"json": True, "seq": int(seq), "prev": str(prev), "type": record.get("type"), "stored": str(stored), "computed": own})
        except (ValueError, KeyError, TypeError, AttributeError):
            out.append({"json": False, "seq": None, "prev": None, "type": None, "stored": None, "computed": None})
    return pa.array(out, pa.struct([("json", pa.bool_()), ("seq", pa.int64()), ("prev", pa.string()), ("type", pa.string()), ("stored", pa.string()), ("computed", pa.string())]))


def verify_logs(lines: DataFrame, key: str) -> DataFrame:
    """key, ok, checked (lines before the first problem) and that problem, of logs (key, number, line); blank lines are skipped.

    In this order a line is bad JSON, its hash isn't that of what it says, its prev isn't the hash before, its seq isn't its place, a header stands anywhere but first or
    something else does, a footer isn't last. Each test looks at a line and its neighbours. A missing value never passes for an equal one.
    """
    w = Window.partitionBy(key).orderBy("number")
    rows = lines.filter(F.trim("line") != "").withColumn("number", F.row_number().over(w)).withColumn("p", F.arrow_udf(parsed, SAID)("line")).select(key, "number", "p.*")
    rows = rows.withColumns({"_before": F.when(F.col("number") == 1, F.lit(GENESIS)).otherwise(F.lag("stored").over(w)), "_last": F.lead("number").over(w).isNull()})
    differ = lambda a, b: ~a.eqNullSafe(b)
    said = lambda what: F.concat(F.lit(f"{what} at seq "), F.col("seq").cast("string"))
    header = F.coalesce(F.col("type") == "header", F.lit(False))
    problem = (
        F.when(~F.col("json"), F.concat(F.lit("bad json at line "), F.col("number").cast("string")))
        .when(differ(F.col("computed"), F.col("stored")), said("hash mismatch")).when(differ(F.col("prev"), F.col("_before")), said("prev mismatch"))
        .when(differ(F.col("seq"), F.col("number") - 1), said("seq mismatch")).when((F.col("seq") == 0) != header, said("header misplaced"))
        .when(F.coalesce(F.col("type") == "footer", F.lit(False)) & ~F.col("_last"), said("footer not last"))
    )
    rows = rows.withColumn("_problem", problem)
    first = F.min(F.when(F.col("_problem").isNotNull(), F.struct("number", F.col("_problem").alias("what"))))
    out = rows.groupBy(key).agg(F.count("*").alias("_n"), first.alias("_first"))
    return out.select(key, F.col("_first").isNull().alias("ok"), F.coalesce(F.col("_first.number") - 1, F.col("_n")).cast("long").alias("checked"), F.coalesce("_first.what", F.lit("")).alias("problem"))


def valid_records(lines: DataFrame) -> Column:
    """Whether a line has what its type asks for, each of its kind: seq, prev, hash and the fields of TYPES."""
    record = F.from_json("line", "seq long, prev string, hash string, type string, input string, size long, status string")
    hexed = lambda c: record[c].rlike("^[0-9a-f]{64}$")
    own = {"header": record["input"], "frame": record["size"], "footer": record["status"]}
    typed = F.lit(False)
    for kind, value in own.items():
        typed = typed | ((record["type"] == kind) & value.isNotNull())
    return F.coalesce((record["seq"] >= 0) & hexed("prev") & hexed("hash") & typed, F.lit(False))
