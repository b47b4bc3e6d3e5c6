"""Writers: guarded, routed, appended, and small reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import strip
from corvane.sources.jsonl import exists


def guard(spark, paths: list[str], force: bool = False) -> None:
    """All outputs are looked at before any is written."""
    there = [p for p in paths if exists(spark, p)]
    if there and not force:
        raise FileExistsError(f"already there: {', '.join(there)}")


def overwrite(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def routed(df: DataFrame, route: str | Column, path: str, fmt: str = "parquet") -> None:
    """One pass, a folder per route, instead of a pass per predicate."""
    out = df if isinstance(route, str) else df.withColumn("route", route)
    out.write.mode("overwrite").partitionBy(route if isinstance(route, str) else "route").format(fmt).save(path)


def corpus_lines(df: DataFrame, text: str) -> DataFrame:
    """(value): one document a line, line feeds as spaces, empty ones left out."""
    return df.select(F.replace(strip(F.col(text)), F.lit("\n"), F.lit(" ")).alias("value")).where("value <> ''")


def write_corpus(df: DataFrame, text: str, path: str) -> None:
    corpus_lines(df, text).write.mode("overwrite").text(path)


def replace_json(path: str, value: object) -> None:
    """A small state file replaced as a whole: written beside, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent, suffix=".part")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(name, target)


def report_json(df: DataFrame) -> str:
    """The rows of a small aggregate as a JSON array."""
    return "[" + ",".join(r.value for r in df.select(F.to_json(F.struct("*")).alias("value")).collect()) + "]"


def report_markdown(df: DataFrame) -> str:
    """The rows of a small aggregate as a table."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.collect()]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])
