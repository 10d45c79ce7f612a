"""Readers of the JSON inputs and writers of results and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id INT, genre STRING, audience STRING, prompt STRING, budget INT, asks ARRAY<STRING>, assumed ARRAY<STRING>, source STRING"
CHECKPOINT = "spec STRING, budget INT, asks ARRAY<STRING>"
CASE = "name STRING, expect STRING, why STRING, text STRING, item STRUCT<prompt: STRING, audience: STRING, budget: INT, asks: ARRAY<STRING>>, needs_judge BOOLEAN, needs_judge_why STRING"
SUMMARY = "model STRING, backend STRING, condition STRING, judge_model STRING, judge_backend STRING, n INT, errors INT, score DOUBLE, clarity_avg DOUBLE, slop_per_1k DOUBLE, avg_words BIGINT, cost_usd DOUBLE"

RUN = "id INT, genre STRING, response STRING, judge STRING, cost_usd DOUBLE, seconds DOUBLE, error STRING"


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores where the scan makes fewer tasks than these (one large row group, small files); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _struct(ddl: str) -> str:
    return "STRUCT<" + ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in _top(ddl)) + ">"


def _top(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The prompt items of {"prompts": [...]}."""
    return spark.read.schema(f"prompts ARRAY<{_struct(ITEM)}>").json(path, multiLine=True).select(F.inline("prompts"))


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """One row per problem and checkpoint (from 1 on)."""
    schema = f"problems ARRAY<STRUCT<id: STRING, genre: STRING, audience: STRING, assumed: ARRAY<STRING>, checkpoints: ARRAY<{_struct(CHECKPOINT)}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("problems"))
    return rows.select("id", "genre", "audience", "assumed", F.posexplode("checkpoints").alias("pos", "c")).select(
        "id", "genre", "audience", "assumed", (F.col("pos") + 1).alias("checkpoint"), "c.*"
    )


def read_controls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: control cases and (better, worse, why) pairs; a file without pairs has none."""
    root = spark.read.schema(f"cases ARRAY<{_struct(CASE)}>, pairs ARRAY<ARRAY<STRING>>").json(path, multiLine=True)
    pair = root.select(F.explode("pairs").alias("p")).select(*(F.col("p")[i].alias(n) for i, n in enumerate(("better", "worse", "why"))))
    return root.select(F.inline("cases")), pair


def _with_condition(rows: DataFrame, condition: str) -> DataFrame:
    return rows.where(F.col("summary").isNotNull() & (F.coalesce("summary.condition", F.lit("default")) == condition))


def read_results(spark: SparkSession, glob: str, condition: str = "default") -> DataFrame:
    """Summaries of saved runs with that condition; files without a summary are skipped."""
    rows = spark.read.schema(f"summary {_struct(SUMMARY)}").json(glob, multiLine=True)
    return _with_condition(rows, condition).select("summary.*")


def read_runs(spark: SparkSession, glob: str, condition: str = "default") -> DataFrame:
    """The saved rows of those files, with model; the judge's answer is its JSON text."""
    rows = spark.read.schema(f"summary {_struct(SUMMARY)}, runs ARRAY<{_struct(RUN)}>").json(glob, multiLine=True)
    return _with_condition(rows, condition).select(F.col("summary.model").alias("model"), F.inline("runs"))


def read_words(spark: SparkSession, path: str | None) -> DataFrame:
    """A word list in capitals; no path gives an empty one."""
    if path is None:
        return spark.createDataFrame([], "word STRING")
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("word")).where("word <> ''").distinct()


def write_runs(rows: DataFrame, path: str, label: str = "label") -> None:
    """K1 and K2: result rows as JSON, a folder for each label (/ and : become _). An existing path is an error, so that no path is overwritten while it is read (K3)."""
    rows.withColumn(label, F.translate(label, "/:", "__")).write.partitionBy(label).json(path)


def result_files(summary: DataFrame, runs: DataFrame, label: str = "label") -> DataFrame:
    """K1, K2: (label, value): one JSON text {"summary": ..., "runs": [...]} for each label; / and : become _. A label's rows are one text, as its file is."""
    named = lambda df: df.withColumn(label, F.translate(label, "/:", "__"))
    heads = named(summary).select(label, F.struct(*(c for c in summary.columns if c != label)).alias("summary"))
    rows = named(runs).groupBy(label).agg(F.collect_list(F.struct(*(c for c in runs.columns if c != label))).alias("runs"))
    return heads.join(rows, label, "left").select(label, F.to_json(F.struct("summary", "runs")).alias("value"))


def write_results(summary: DataFrame, runs: DataFrame, path: str, label: str = "label") -> None:
    """K1, K2: a folder for each label with one file. An existing path is an error."""
    result_files(summary, runs, label).write.partitionBy(label).text(path)


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """K3: the numbers of the versions that were written whole."""
    path, files = _files(spark, root)
    names = [f.getPath().getName() for f in files.listStatus(path(root))] if files.exists(path(root)) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def write_version(df: DataFrame, root: str) -> str:
    """K3: writes the next version of a table beside the others and gives its path.

    It appears under its name only when whole, so a table can be read while its next version is
    made from it, and a failed job leaves nothing that latest() sees.
    """
    spark = df.sparkSession
    path, files = _files(spark, root)
    fresh, name = f"{root}/_making-{uuid.uuid4().hex}", f"{root}/v{max(versions(spark, root), default=0) + 1}"
    try:
        df.write.parquet(fresh)
        if not files.rename(path(fresh), path(name)):
            raise OSError(f"{name} was made meanwhile")
    finally:
        files.delete(path(fresh), True)
    return name


def latest(spark: SparkSession, root: str) -> DataFrame:
    """K3: the last version; ValueError if there is none."""
    known = versions(spark, root)
    if not known:
        raise ValueError(f"no version of a table in {root}")
    return spark.read.parquet(f"{root}/v{known[-1]}")


def publish(results: dict[str, Callable[[], None]], report: Callable[[], None], workers: int = 4) -> None:
    """Runs the jobs of all models side by side and reports only if none failed; RuntimeError names those that did."""
    with ThreadPoolExecutor(workers) as pool:
        jobs = {name: pool.submit(job) for name, job in results.items()}
        failed = {name: error for name, job in jobs.items() if (error := job.exception()) is not None}
    if failed:
        raise RuntimeError("no report, as these failed: " + "; ".join(f"{n}: {e}" for n, e in sorted(failed.items())))
    report()


def console_summary(summary: dict, errors: list[dict]) -> tuple[str, str]:
    """K6: what a run says in the end: its summary as JSON, and a line for each failed prompt."""
    return json.dumps(summary, indent=1), "".join(f"  prompt {e['id']}: {e['error']}\n" for e in errors)


def markdown(ranking: list[dict], columns: list[str]) -> str:
    """K4: a table of a few collected rows."""
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return head + "".join(f"| {' | '.join('' if r[c] is None else str(r[c]) for c in columns)} |\n" for r in ranking)


def _safe(text) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;")


def svg_bars(ranking: list[dict], name: str = "model", value: str = "score", width: int = 600) -> str:
    """K5: horizontal bars from the axis floor (five under the lowest value, at most 80; A8)."""
    floor = axis_floor([r[value] for r in ranking])
    body = "".join(
        f'<text x="0" y="{24 * i + 16}">{_safe(r[name])}</text><rect x="200" y="{24 * i + 4}" height="16" width="{max(0.0, (r[value] - floor) / (100 - floor)) * (width - 200):.1f}"/>'
        for i, r in enumerate(ranking)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{24 * len(ranking) + 8}">{body}</svg>'


#: Column heads of a leaderboard and marks of the first three.
HEADS = {"rule1": "Understand", "rule2": "Economy", "rule3": "Jargon", "rule4": "Imagery", "rule5": "Simple", "rule6": "Filler", "rule7": "Form"}
MEDALS = ("\U0001f947", "\U0001f948", "\U0001f949")


def leaderboard(rows: list[dict], full: int = 30) -> str:
    """A table for each number of prompts, most first, best score first; only full runs have medals."""
    out = ["# Leaderboard\n"]
    for n in sorted({r["n"] for r in rows}, reverse=True):
        group = sorted((r for r in rows if r["n"] == n), key=lambda r: (-r["score"], r["model"]))
        medals = MEDALS if n >= full else ()
        out.append(f"## Full run ({n} prompts)\n" if n >= full else f"## Smoke sample ({n} prompts), not comparable to a full run\n")
        lines = [{"Score": f"{medals[i] + ' ' if i < len(medals) else ''}**{r['score']}**", "Model": f"`{r['model']}`", "n": n, "Clarity": r["clarity"], "Slop/1k": r["slop"], "Words": r["n_words"]} | {h: f"{r.get(k) or 0:.1f}" for k, h in HEADS.items()} for i, r in enumerate(group)]
        out.append(markdown(lines, list(lines[0])))
    return "\n".join(out)


def axis_floor(scores: list[float]) -> float:
    """Five below the multiple of five under the lowest score, at most 80."""
    return min(80.0, min(scores, default=85.0) // 5 * 5 - 5)


def svg_scatter(rows: list[dict], x: str = "n_words", y: str = "rule2", name: str = "model", width: int = 600, height: int = 300) -> str:
    """K5: a dot with its name for each row, from 0 to the greatest x and from 0 to 10."""
    most = max((r[x] for r in rows), default=0) or 1
    dots = "".join(
        f'<circle cx="{40 + r[x] / most * (width - 160):.1f}" cy="{height - 20 - r[y] / 10 * (height - 40):.1f}" r="4"/><text x="{48 + r[x] / most * (width - 160):.1f}" y="{height - 16 - r[y] / 10 * (height - 40):.1f}">{_safe(r[name])}</text>'
        for r in rows
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{dots}</svg>'
