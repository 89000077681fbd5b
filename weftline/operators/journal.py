"""A resumable journal of external calls as append-only tables.

Attempts are appended and never rewritten; the current record of a call is its last attempt and the earlier ones are its
history. Idempotent inserts are anti-joins on the call id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.canon import string_json
from weftline.schemas import CALL
from weftline.session import drop_path, materialize

FINAL = ("ok", "not_evaluated")


def call_id(input_id: str = "input_id", repeat: str = "repeat", version: str = "judge_version"):
    """Digest of [input_id, version, repeat]."""
    return F.sha2(F.concat(F.lit("["), string_json(F.col(input_id)), F.lit(","), string_json(F.col(version)), F.lit(","), F.col(repeat).cast("string"), F.lit("]")), 256)


def planned(inputs: DataFrame, repeats: int, version: str) -> DataFrame:
    """(call_id, input_id, repeat, judge_version): every distinct input times every repeat."""
    d = inputs.filter("input_id IS NOT NULL").select("input_id").distinct().withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    d = d.withColumn("judge_version", F.lit(version))
    return d.select(call_id().alias("call_id"), "input_id", "repeat", "judge_version")


def pending(plan: DataFrame, journal: DataFrame, final: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Planned calls without a final record."""
    return plan.join(latest(journal).filter(F.col("runtime_status").isin(*final)).select("call_id"), "call_id", "left_anti")


def latest(journal: DataFrame, order: str = "attempt_no") -> DataFrame:
    """The current record of each call (ties by the record itself) and the number of earlier ones."""
    rest = [c for c in journal.columns if c != "call_id"]
    out = journal.groupBy("call_id").agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("__r"), (F.count("*") - 1).alias("n_previous"))
    return out.select("call_id", "__r.*", "n_previous")


def history(journal: DataFrame) -> DataFrame:
    """(call_id, attempt_no, runtime_status) of records that a later one replaced."""
    last = journal.groupBy("call_id").agg(F.max("attempt_no").alias("__last"))
    return journal.join(last, "call_id").filter("attempt_no < __last").select("call_id", "attempt_no", "runtime_status")


def insert_if_absent(journal: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose call the journal doesn't know; these are to be appended."""
    return rows.join(journal.select("call_id").distinct(), "call_id", "left_anti")


def guarded_merge(journal: DataFrame, trial: DataFrame) -> DataFrame:
    """Trial records to append: never over a final record."""
    return trial.join(latest(journal).filter(F.col("runtime_status").isin(*FINAL)).select("call_id"), "call_id", "left_anti")


def status_counts(journal: DataFrame) -> DataFrame:
    return latest(journal).groupBy("runtime_status").agg(F.count("*").alias("n"))


def attempts(journal: DataFrame) -> DataFrame:
    """(call_id, input_id, record_no, attempt_no, ...): every attempt of every record, earlier records included."""
    return journal.select("call_id", "input_id", F.col("attempt_no").alias("record_no"), F.posexplode("attempts").alias("attempt_no", "a")).select("call_id", "input_id", "record_no", "attempt_no", "a.*")


def usage(att: DataFrame) -> DataFrame:
    """(attempts, seconds, prompt_tokens, completion_tokens, total_tokens, p50, p95, mean_seconds); percentiles interpolate linearly."""
    return att.agg(
        F.count("*").alias("attempts"), F.sum("elapsed_seconds").alias("seconds"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.percentile("elapsed_seconds", 0.5).alias("p50_seconds"), F.percentile("elapsed_seconds", 0.95).alias("p95_seconds"), F.avg("elapsed_seconds").alias("mean_seconds"),
    )


def remaining(plan: DataFrame, journal: DataFrame, slack: float = 1.35, fixed: float = 2400.0) -> DataFrame:
    """(n_planned, n_final, n_remaining, mean_seconds, estimate_seconds): calls without a final record times the mean call time."""
    last = latest(journal)
    sec = F.aggregate("attempts", F.lit(0.0), lambda a, x: a + F.coalesce(x.elapsed_seconds, F.lit(0.0)))
    j = plan.select("call_id").join(last.select("call_id", "runtime_status", sec.alias("s")), "call_id", "left")
    r = j.agg(F.count("*").alias("n_planned"), F.count_if(F.col("runtime_status").isin(*FINAL)).alias("n_final"), F.avg("s").alias("mean_seconds"))
    r = r.withColumn("n_remaining", F.col("n_planned") - F.col("n_final"))
    return r.withColumn("estimate_seconds", F.col("n_remaining") * F.coalesce("mean_seconds", F.lit(0.0)) * slack + fixed)


def run_calls(todo: DataFrame, transport: Callable[[dict], dict], attempt_no: int, max_attempts: int = 3, retryable: tuple[int, ...] = (408, 429, 500, 502, 503, 504)) -> DataFrame:
    """Journal rows of calling `transport` once for each row of todo, retried on retryable statuses; runs in the executors.

    transport takes the row as a dict and returns {status, http_status, error_type, elapsed_seconds, usage, label}; an
    exception becomes an error record. Backoff belongs to the transport, so tests don't sleep.
    """

    def one(row: dict) -> dict:
        tried, status, error, label = [], "error", None, None
        for _ in range(max_attempts):
            try:
                r = transport(row)
            except Exception as x:  # noqa: BLE001
                r = {"status": "error", "error_type": type(x).__name__}
            u = r.get("usage") or {}
            status, error, label = r.get("status", "error"), r.get("error_type"), r.get("label")
            tried.append({"runtime_status": status, "elapsed_seconds": float(r.get("elapsed_seconds") or 0), "http_status": r.get("http_status"), "error_type": error, "prompt_tokens": u.get("prompt_tokens"), "completion_tokens": u.get("completion_tokens"), "total_tokens": u.get("total_tokens")})
            if status == "ok" or r.get("http_status") not in retryable:
                break
        return {"runtime_status": status, "error_type": error, "attempts": tried, "label": label}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [one(r) for r in f.to_dict("records")]
            for c in ("runtime_status", "error_type", "attempts", "label"):
                f[c] = [m[c] for m in made]
            f["attempt_no"], f["prompt_hash"] = attempt_no, None
            yield f[[x.name for x in CALL]]

    return todo.select("call_id", "input_id", "repeat", "judge_version").mapInPandas(run, CALL)


def reusable(plan: DataFrame, prior: DataFrame) -> DataFrame:
    """(call_id, prior_call_id, same_request): ok calls of another run that answer planned ones.

    plan: (call_id, input_id, repeat, judge_version, prompt_hash); prior: a journal. Input, repeat and version must agree; a
    call may be taken over only where same_request proves that the very same request was answered. Of several the smallest id.
    """
    p = latest(prior).filter("runtime_status = 'ok'").select("input_id", "repeat", "judge_version", F.col("call_id").alias("prior_call_id"), F.col("prompt_hash").alias("__h"))
    j = plan.select("call_id", "input_id", "repeat", "judge_version", "prompt_hash").join(p, ["input_id", "repeat", "judge_version"])
    same = F.coalesce(F.col("prompt_hash") == F.col("__h"), F.lit(False))
    g = j.groupBy("call_id").agg(F.max_by(F.struct("prior_call_id", same.alias("same")), F.struct(same.cast("int"), F.xxhash64("prior_call_id"))).alias("x"))
    return g.select("call_id", "x.prior_call_id", F.col("x.same").alias("same_request"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All records of a journal folder; none yet is an empty table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(CALL).parquet(path) if there else spark.createDataFrame([], CALL)


def run_resumable(plan: DataFrame, path: str, transport: Callable[[dict], dict], batch: int = 10_000, max_failures: int | None = None, progress: Callable[[int, int], None] | None = None) -> dict[str, int]:
    """Run the planned calls that have no final record yet, batch by batch, and append their records to the journal at path.

    The first call goes alone: if it fails nothing else is tried. A batch with more than max_failures failed calls is the
    last (an outage). progress(done, planned) is told after each batch. Returns calls by status, 'unattempted' among them;
    running again goes on where this stopped.
    """
    spark = plan.sparkSession
    planned_calls = plan.count()
    run_no = (read_journal(spark, path).agg(F.max("attempt_no")).first()[0] or 0) + 1
    size = 1
    while True:
        journal = read_journal(spark, path)
        now = journal.filter(F.col("attempt_no") == run_no).select("call_id")  # this run tries a call once
        todo = pending(plan, journal, FINAL).join(now, "call_id", "left_anti")
        todo, at = materialize(todo.orderBy("call_id").limit(size), "todo")
        tried = todo.count()
        if tried:
            run_calls(todo, transport, run_no).write.mode("append").parquet(path)
        drop_path(spark, at)
        last = read_journal(spark, path)
        failed = last.filter((F.col("attempt_no") == run_no) & ~F.col("runtime_status").isin(*FINAL)).count()
        done = plan.join(latest(last).select("call_id"), "call_id", "left_semi").count()
        if progress:
            progress(done, planned_calls)
        if not tried or (size == 1 and failed) or (max_failures is not None and failed > max_failures):
            out = {r["runtime_status"]: r["n"] for r in status_counts(last.join(plan.select("call_id"), "call_id", "left_semi")).collect()}
            return out | ({"unattempted": planned_calls - done} if planned_calls > done else {})
        size = batch


def append_scores(scores: DataFrame, path: str, key: str = "input_id", parts: int = 1, progress: Callable[[int, int], None] | None = None) -> int:
    """Append rows whose key the folder at path doesn't hold yet, in `parts` commits by key hash; returns the rows added.

    A run that broke off is repeated: what was committed stays, the rest is added. Of rows with one key one is kept.
    """
    spark, added = scores.sparkSession, 0
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i in range(parts):
        new = scores.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(parts)) == i)).dropDuplicates([key])
        if fs.exists(p):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new, at = materialize(new, "scores")
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        drop_path(spark, at)
        added += n
        if progress:
            progress(i + 1, parts)
    return added
