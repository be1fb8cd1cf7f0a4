"""Rebuilding conversations from message rows.

Method: message rows are a stream. Keyed state buffers the messages of open sessions, whatever order they arrive in; a repeated id
keeps its earliest time. Event time is ``created_at`` with a watermark. When the watermark has passed a session's last message by
``gap`` (at an update of its state or by time-out) the session closes: its messages are put in order, validated and emitted as a
conversation with its verdict, and its state is freed. Late rows are never dropped: rows of a session that was closed before open it
anew and are emitted as a further fragment; so is a buffer that reaches FULL messages. The end of a bounded input closes what is
still open: those buffers are read from the state store.

State is keyed by a bucket of sessions, by hash, so that a call into Python serves many of them. A session that came out in one
fragment keeps the verdict of the stream. The few with several are put together and validated again, in parallel: ordering is by
range over (session, time, role), every range yields a summary of its stretch of a session, and summaries are joined in order, so a session of
any length works. A session known to be hot is spread over buckets by the hash of the message id, and thus comes in fragments.

Defined cases: rows without session_id are left out; a row without id is named by the hash of its content; a missing time sorts
first; roles other than user and assistant do not count; null content is a blank message; equal times order system, user,
assistant; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brookloom.session import scratch, staged

#: Rows of a session from which it is spread over buckets.
HOT = 20_000
#: Messages of a session at which its buffer is emitted unclosed.
FULL = 20_000
#: Message rows of a bucket.
EACH = 2_000
_FRAGMENT = "session_id string, closed boolean, empty boolean, missing_reply boolean, broken boolean, turns bigint, began bigint, ids array<string>, ats array<bigint>, roles array<string>, solids array<boolean>"
_PLACES = {"system": 0, "user": 1, "assistant": 2}
_COLUMNS = ["session_id", "id", "at", "role", "solid"]


def _name() -> Column:
    return F.coalesce("id", F.concat(F.lit("row-"), F.xxhash64("created_at", "role", "content").cast("string")))


def _messages(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("session_id").isNotNull()).select(
        "session_id",
        _name().alias("id"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        "role",
        F.coalesce(F.col("content").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("solid"),
    )


def _once(m: pd.DataFrame) -> pd.DataFrame:
    """In the order of conversations, a repeated id at its earliest time."""
    m = m.sort_values(["session_id", "id", "at"], kind="stable").drop_duplicates(["session_id", "id"])
    return m.assign(place=m["role"].map(_PLACES).fillna(3)).sort_values(["session_id", "at", "place", "id"])


def _fragments(m: pd.DataFrame, closed: bool) -> pd.DataFrame:
    """Validated conversations of messages from ``_once``, a row for each session."""
    sid, place, solid = m["session_id"].to_numpy(), m["place"].to_numpy(), m["solid"].to_numpy(dtype=bool)
    first = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(sid)]))
    c = np.flatnonzero((place == 1) | (place == 2))
    own, user = owner[c], place[c] == 1
    head = np.r_[True, own[1:] != own[:-1]] if len(c) else np.zeros(0, dtype=bool)
    tail = np.r_[own[1:] != own[:-1], True] if len(c) else head
    follows_answer, before_user = head | np.r_[False, ~user[:-1]], tail | np.r_[user[1:], False]

    def any_of(flag: np.ndarray) -> np.ndarray:
        return np.bincount(own[flag], minlength=len(first)) > 0

    at = m["at"].to_numpy()
    lists = {name: pd.Series(np.split(m[col].to_numpy(), first[1:]), dtype=object) for name, col in (("ids", "id"), ("ats", "at"), ("roles", "role"), ("solids", "solid"))}
    return pd.DataFrame(
        {
            "session_id": sid[first], "closed": closed, "empty": ~any_of(solid[c]), "missing_reply": any_of(user & before_user), "broken": any_of(~user & follows_answer),
            "turns": np.bincount(own, minlength=len(first)).astype(np.int64), "began": np.minimum.reduceat(at, first), **lists,
        }
    )


def _fold(gap_ms: int):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(state.get[0])] if state.exists else []
        rows = 0
        for b in () if state.hasTimedOut else batches:
            held.append(b[_COLUMNS])
            rows += len(b)
            if rows > FULL:  # a task never holds more than this and what was open
                held, rows = [_once(pd.concat(held))[_COLUMNS]], 0
                size = held[0].groupby("session_id")["id"].transform("size")
                if (size >= FULL).any():
                    yield _fragments(_once(held[0][size >= FULL]), False)
                    held = [held[0][size < FULL]]
        m = _once(pd.concat(held))
        if not len(m):
            return
        ends = m.groupby("session_id")["at"].transform("max") // 1000 + gap_ms
        shut = (ends <= state.getCurrentWatermarkMs()).to_numpy()
        if shut.any():
            yield _fragments(m[shut], True)
        if shut.all():
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(m[~shut][_COLUMNS], protocol=5),))
            state.setTimeoutTimestamp(max(int(ends[~shut].min()), state.getCurrentWatermarkMs() + 1))

    return fold


def fragments(stream: DataFrame, buckets: int, hot: DataFrame | None = None, delay: str = "1 hour", gap_ms: int = 6 * 3600_000) -> DataFrame:
    """The stream of closed conversations of a stream of message rows. ``hot``: (session_id, parts) of the sessions to spread.

    The watermark is taken from created_at. Spark would drop rows behind it before they reach the state, while here they belong to
    a session; so the column that carries the event time from there on is null, which is never behind.
    """
    rows = _messages(stream).withWatermark("created_at", delay)
    rows = rows.withColumn("parts", F.lit(1)) if hot is None else rows.join(hot, "session_id", "left")
    rows = rows.select(
        F.expr(f"cast(pmod(xxhash64(session_id, CASE WHEN parts > 1 THEN pmod(xxhash64(id), parts) END), {buckets}) as int)").alias("bucket"),
        "session_id",
        "id",
        F.coalesce(F.unix_micros("created_at"), F.lit(0)).alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        "solid",
        F.lit(None).cast("timestamp").alias("clock", metadata={"spark.watermarkDelayMs": 0}),
    )
    return rows.groupBy("bucket").applyInPandasWithState(_fold(gap_ms), _FRAGMENT, "open binary", "append", GroupStateTimeout.EventTimeTimeout)


def hot_sessions(rows: DataFrame, limit: int) -> DataFrame | None:
    found = staged(rows.groupBy("session_id").count().filter(F.col("count") > limit).select("session_id", F.ceil(F.col("count") / limit).cast("int").alias("parts")), "hot-sessions")
    return None if found.isEmpty() else found


def _source(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    """A stream of the files below a folder, or of a lone file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def run(spark: SparkSession, path: str, files_per_batch: int = 64, hot_limit: int = HOT, each: int = EACH, **limits) -> DataFrame:
    """The fragments of all sessions after the whole input has streamed."""
    rows = spark.read.parquet(path)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], _FRAGMENT)
    out = f"{scratch(spark)}/chats-{uuid.uuid4().hex}"
    query = (
        fragments(_source(spark, path, rows.schema, files_per_batch), max(1, n // each), hot_sessions(rows, hot_limit), **limits)
        .writeStream.format("parquet")
        .option("path", f"{out}/closed")
        .option("checkpointLocation", f"{out}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["open"]:
                yield _fragments(_once(pickle.loads(blob)), True)

    left = spark.read.format("statestore").load(f"{out}/state").select(F.col("value.groupState.open").alias("open")).filter("open is not null")
    return spark.read.schema(_FRAGMENT).parquet(f"{out}/closed").unionByName(staged(left.mapInPandas(close, _FRAGMENT), "chats-left"))


def messages_of(frags: DataFrame) -> DataFrame:
    """(session_id, id, at, role, solid) of fragments; an id that several fragments hold counts at its earliest time."""
    each = frags.select("session_id", F.explode(F.arrays_zip("ids", "ats", "roles", "solids")).alias("m")).select("session_id", "m.*")
    first = F.min_by(F.struct("roles", "solids"), "ats")
    return each.groupBy("session_id", "ids").agg(first.alias("m"), F.min("ats").alias("at")).select("session_id", F.col("ids").alias("id"), "at", F.col("m.roles").alias("role"), F.col("m.solids").alias("solid"))


def _counted(frags: DataFrame) -> DataFrame:
    verdict = F.struct("empty", "missing_reply", "broken", "turns", "began")
    return frags.groupBy("session_id").agg(F.count(F.lit(1)).alias("fragments"), F.bool_and("closed").alias("closed"), F.max(verdict).alias("v"))


def _in_pieces() -> Column:
    return (F.col("fragments") > 1) | ~F.col("closed")


def verdicts(frags: DataFrame) -> DataFrame:
    """One row for each session: that of the stream, or for sessions in several fragments that of all their messages."""
    counted = _counted(frags)
    whole = counted.filter(~_in_pieces()).select("session_id", "v.*")
    again = frags.join(counted.filter(_in_pieces()).select("session_id"), "session_id", "left_semi")
    return whole.unionByName(validated(messages_of(again)))


def _place() -> Column:
    return F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)


def ordered(messages: DataFrame) -> DataFrame:
    """Adds stretch and place: ranges of (session, time, role, id). A stretch lies in one partition; stretches rise with the order."""
    placed = messages.withColumn("place", _place())
    return placed.repartitionByRange("session_id", "at", "place", "id").withColumn("stretch", F.spark_partition_id())


def validated(messages: DataFrame) -> DataFrame:
    """One row for each session: empty, missing_reply, broken, turns, and the time of its first message."""
    order = ["at", "place", "id"]
    rows = ordered(messages)
    counting = rows.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("session_id", "stretch").orderBy(*order)
    key = F.struct(*order)
    pairs = counting.withColumn("before", F.lag("role").over(w))
    parts = pairs.groupBy("session_id", "stretch").agg(
        F.min_by("role", key).alias("head"),
        F.max_by("role", key).alias("tail"),
        F.bool_or("solid").alias("solid"),
        F.coalesce(F.bool_or((F.col("role") == "user") & (F.col("before") == "user")), F.lit(False)).alias("missing"),
        F.coalesce(F.bool_or((F.col("role") == "assistant") & (F.col("before") == "assistant")), F.lit(False)).alias("broken"),
        F.count(F.lit(1)).alias("n"),
    )
    # the stretches of a session are at most as many as partitions
    seam = Window.partitionBy("session_id").orderBy("stretch")
    joined = parts.withColumn("prior", F.lag("tail").over(seam)).withColumn("next", F.lead("head").over(seam))
    judged = joined.groupBy("session_id").agg(
        (~F.bool_or("solid")).alias("empty"),
        F.bool_or(F.col("missing") | ((F.col("tail") == "user") & (F.col("next").isNull() | (F.col("next") == "user")))).alias("missing_reply"),
        F.bool_or(F.col("broken") | ((F.col("head") == "assistant") & (F.col("prior").isNull() | (F.col("prior") == "assistant")))).alias("broken"),
        F.sum("n").alias("turns"),
    )
    everyone = messages.groupBy("session_id").agg(F.min("at").alias("began"))
    return everyone.join(judged, "session_id", "left").select(
        "session_id", F.coalesce("empty", F.lit(True)).alias("empty"), F.coalesce("missing_reply", F.lit(False)).alias("missing_reply"), F.coalesce("broken", F.lit(False)).alias("broken"), F.coalesce("turns", F.lit(0)).alias("turns"), "began"
    )


def reasons(sessions: DataFrame) -> DataFrame:
    """(session_id, reason), a row for each reason why a session is left out."""
    each = F.array(*(F.when(F.col(r), F.lit(r)) for r in ("empty", "missing_reply", "broken")))
    return sessions.select("session_id", F.explode(F.array_compact(each)).alias("reason"))


def conversations(frags: DataFrame, rows: DataFrame) -> DataFrame:
    """(session_id, turn, role, content) of the sound sessions, system messages included; turns count from 1."""
    sound = verdicts(frags).filter("not (empty or missing_reply or broken)").select("session_id")
    pieces = _counted(frags).filter(_in_pieces()).select("session_id")
    good = frags.join(sound, "session_id", "left_semi")
    whole = good.join(pieces, "session_id", "left_anti").select("session_id", F.posexplode(F.arrays_zip("ids", "roles")).alias("n", "m"))
    whole = whole.select("session_id", F.col("m.ids").alias("id"), F.col("m.roles").alias("role"), (F.col("n") + 1).cast("bigint").alias("turn"))
    # stored once: each further use of the ranges would sample bounds of its own, and stretches would not agree
    kept = staged(ordered(messages_of(good.join(pieces, "session_id", "left_semi"))), "ordered")
    below = Window.partitionBy("session_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = kept.groupBy("session_id", "stretch").agg(F.count(F.lit(1)).alias("n")).select("session_id", "stretch", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    inside = Window.partitionBy("session_id", "stretch").orderBy("at", "place", "id")
    joined = kept.withColumn("n", F.row_number().over(inside)).join(base, ["session_id", "stretch"]).select("session_id", "id", "role", (F.col("base") + F.col("n")).alias("turn"))
    texts = rows.select("session_id", _name().alias("id"), "created_at", "content")
    texts = texts.groupBy("session_id", "id").agg(F.min_by("content", "created_at").alias("content"))
    return whole.unionByName(joined).join(texts, ["session_id", "id"]).select("session_id", "turn", "role", "content")
