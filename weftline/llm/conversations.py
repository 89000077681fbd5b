"""Problem 7: conversations from message rows, read as an event log.

Every delivery of an event is a log entry; in order of arrival an entry is a create (first), a retry (same payload as one
seen before) or an edit (another payload), and a cancelled last version is a delete: the turn stays as a link, its text
goes. Folding by version gives one turn for each event, then the parent links order and validate the conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.hierarchy import climb
from weftline.operators.ranking import global_sequence
from weftline.session import drop_path, materialize

KEY = ("tenant_id", "trace_id", "event_id")
TRACE = ("tenant_id", "trace_id")
PAYLOAD = ("parent_id", "branch_id", "sequence", "role", "visibility", "text", "status", "language", "group_id", "event_ts")


def has_text(c: str) -> Column:
    """True where the text has a character that isn't Unicode white space; false for null."""
    return F.coalesce(F.col(c).rlike(r"[^\p{IsWhite_Space}]"), F.lit(False))


def fold_log(events: DataFrame, payload: tuple[str, ...] = PAYLOAD, keep: tuple[Column | str, ...] = PAYLOAD) -> DataFrame:
    """One turn for each event key: the kept columns of its last new version, n_deliveries, n_versions, edited.

    Versions are distinct payloads (all given columns, nulls equal) numbered by first arrival (received_ts, then payload
    hash); retries repeat a version and change nothing. Rows with a null in the key are ignored. Columns beside key,
    payload and received_ts are not looked at.
    """
    e = events.filter(" AND ".join(f"{k} IS NOT NULL" for k in KEY))
    # null positions go into the hash too: xxhash64 skips nulls, so a value that moves to the next column would collide
    digest = F.xxhash64(*payload, *[F.isnull(c) for c in payload])
    e = e.select(*KEY, "received_ts", digest.alias("__h"), F.struct(*keep).alias("__v"))
    versions = e.groupBy(*KEY, "__h").agg(F.first("__v").alias("__v"), F.min("received_ts").alias("__first"), F.count("*").alias("__n"))
    out = versions.groupBy(*KEY).agg(
        F.max_by("__v", F.struct("__first", "__h")).alias("__v"), F.sum("__n").alias("n_deliveries"), F.count("*").alias("n_versions")
    )
    return out.select(*KEY, "__v.*", "n_deliveries", "n_versions", (F.col("n_versions") > 1).alias("edited"))


def unanswered_traces(nodes: DataFrame) -> DataFrame:
    """(tenant_id, trace_id) with an asking node that has no reply below it; nodes: key, parent_id, asks, replies, without cycles.

    Replies climb by doubling: in round k a node knows of replies less than 2**k levels below and passes the news 2**k
    levels up. Traces whose questions are all answered leave after each round, so the deep rounds see few rows.
    """
    spark = nodes.sparkSession
    now = nodes.select(*KEY, F.col("parent_id").alias("up"), "asks", F.col("replies").alias("heard"))
    at = None
    while True:
        news = now.filter("heard AND up IS NOT NULL").select(*TRACE, F.col("up").alias("event_id")).distinct().withColumn("new", F.lit(True))
        told = now.join(news, list(KEY), "left").select(*KEY, "up", "asks", (F.col("heard") | F.coalesce("new", F.lit(False))).alias("heard"))
        further = now.select(*TRACE, F.col("event_id").alias("up"), F.col("up").alias("far"))
        told = told.join(further, [*TRACE, "up"], "left").select(*KEY, F.col("far").alias("up"), "asks", "heard")
        told, new_at = materialize(told, "heard")
        if at:
            drop_path(spark, at)
        at = new_at
        waiting = told.filter("asks AND NOT heard").select(*TRACE).distinct()
        if told.join(waiting, list(TRACE), "left_semi").filter("up IS NOT NULL").isEmpty():
            return waiting
        now = told.join(waiting, list(TRACE), "left_semi")


def judge(turns: DataFrame) -> DataFrame:
    """(tenant_id, trace_id, broken, empty, unanswered): one row for each trace; turns: key, parent_id, sequence, role, said, edited.

    broken: a parent that doesn't exist in the trace, a parent whose sequence is not smaller (null counts as not smaller),
    an edited event; a cycle always has a parent whose sequence is not smaller. empty: no user or assistant turn with
    text. unanswered: a user turn with text and no assistant turn with text among its descendants; false for broken
    traces, whose descendants aren't certain. Rows with null tenant or trace belong to no conversation.
    """
    role = lambda x: F.coalesce(F.col("said") & (F.col("role") == x), F.lit(False))
    own = turns.select(*KEY, "parent_id", "sequence", "edited", role("user").alias("asks"), role("assistant").alias("replies"))
    seq = own.select(*TRACE, F.col("event_id").alias("parent_id"), F.col("sequence").alias("__up"))
    late = F.col("parent_id").isNotNull() & ~F.coalesce(F.col("__up") < F.col("sequence"), F.lit(False))
    flags = own.join(seq, [*TRACE, "parent_id"], "left").groupBy(*TRACE).agg(F.max(F.col("edited") | late).alias("broken"), F.max(F.col("asks") | F.col("replies")).alias("__some"), F.max("asks").alias("__asks"))
    flags, _ = materialize(flags, "flags")
    whole, _ = materialize(own.join(flags.filter("NOT broken AND __asks").select(*TRACE), list(TRACE), "left_semi").select(*KEY, "parent_id", "asks", "replies"), "whole")
    waiting = unanswered_traces(whole).withColumn("__waiting", F.lit(True))
    return flags.join(waiting, list(TRACE), "left").select(*TRACE, "broken", (~F.col("__some")).alias("empty"), F.coalesce("__waiting", F.lit(False)).alias("unanswered"))


def verdicts(events: DataFrame) -> DataFrame:
    turns = fold_log(events, keep=("parent_id", "sequence", "role", has_text("text").alias("said")))
    turns, _ = materialize(turns.select(*KEY, "parent_id", "sequence", "role", "said", "edited"), "turns")
    return judge(turns)


def threads(turns: DataFrame) -> DataFrame:
    """(key, depth, thread, thread_sequence) of turns (key, parent_id, sequence) whose parents come before them.

    The first reply to a turn (smallest sequence, then event_id) goes on in its thread, every other one begins a thread of
    its own, named by its first event. Turns climb to their roots in doubling steps and stop looking at the nearest beginning.
    """
    s = ["__s0", "__s1"]
    first = turns.filter("parent_id IS NOT NULL").groupBy(F.col("tenant_id").alias("__s0"), F.col("trace_id").alias("__s1"), F.col("parent_id").alias("__p")).agg(F.min(F.struct("sequence", "event_id")).alias("__f"))
    e = turns.select(F.col("tenant_id").alias("__s0"), F.col("trace_id").alias("__s1"), F.col("event_id").alias("__n"), F.col("parent_id").alias("__p"), "sequence")
    e = e.join(first, [*s, "__p"], "left").select(*s, "__n", "__p", F.struct("sequence", F.col("__n").alias("event")).alias("__own"), (F.col("__f.event_id") == F.col("__n")).alias("__on"))
    e, _ = materialize(e, "threads")
    zero = F.lit(0).cast("long")
    done = e.filter("__p IS NULL").select(*s, "__n", F.col("__own").alias("__head"), zero.alias("__depth"))
    pending = e.filter("__p IS NOT NULL").select(*s, "__n", F.col("__p").alias("__anc"), F.when(~F.col("__on"), F.col("__own")).alias("__head"), F.lit(1).cast("long").alias("__depth"))
    blocks = climb(done, pending, s, {"__head": F.coalesce("__head", "u__head"), "__depth": F.col("__depth") + F.col("u__depth")})
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out.select(F.col("__s0").alias("tenant_id"), F.col("__s1").alias("trace_id"), F.col("__n").alias("event_id"), F.col("__depth").alias("depth"), F.col("__head.event").alias("thread"), F.col("__head.sequence").alias("thread_sequence"))


def conversations(events: DataFrame) -> DataFrame:
    """Turns of the surviving conversations: key, turn_no (from 1), thread, depth, parent_id, branch_id, sequence, role, text, deleted, n_versions.

    Threads follow each other by the place of their first event, turns inside a thread by sequence; a parent always precedes
    its replies because its sequence is smaller. The text of a deleted turn is null. Ranks come from a global range sort,
    so one huge trace is spread over many tasks.
    """
    turns, _ = materialize(fold_log(events).withColumn("said", has_text("text")), "turns")
    good = judge(turns).filter("NOT broken AND NOT empty AND NOT unanswered").select(*TRACE)
    kept, _ = materialize(turns.join(good, list(TRACE), "left_semi"), "kept")
    deleted = F.coalesce(F.col("status") == "cancelled", F.lit(False))
    placed = kept.join(threads(kept.select(*KEY, "parent_id", "sequence")), list(KEY))
    ranked = global_sequence(
        placed.select(*KEY, "thread_sequence", "thread", "depth", "parent_id", "branch_id", "sequence", "role", F.when(~deleted, F.col("text")).alias("text"), deleted.alias("deleted"), "n_versions"),
        [*TRACE, "thread_sequence", "thread", "sequence", "event_id"],
        "__seq",
    )
    first = ranked.groupBy(*TRACE).agg(F.min("__seq").alias("__base"))
    return ranked.join(first, list(TRACE)).select(
        *KEY, (F.col("__seq") - F.col("__base") + 1).alias("turn_no"), "thread", "depth", "parent_id", "branch_id", "sequence", "role", "text", "deleted", "n_versions"
    )
