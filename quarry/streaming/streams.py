"""Structured Streaming forms of the append-only reads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """The ledger as a stream of Parquet files; the checkpoint's offsets are the poll cursor."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def dedup_events(stream: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """Consume-once: the first event of each key within the time to live."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", ttl)
    return timed.dropDuplicatesWithinWatermark(["event_id"])


def session_counts(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per user and session window."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


#: Kinds of bookkeeping that no delta has.
MACHINE = ("view", "signup")


def delta(events: DataFrame, prompts: DataFrame, pages: DataFrame, notes: DataFrame, agents: bool = False, body: int = 4000, wait: str = "1 hour") -> DataFrame:
    """(seq, kind, role, body): a stream of events (seq, at, kind, session, turn) with what was said, seen or noted at each.

    prompts (session, turn, role, said) and pages (seq, page) are tables, joined to each batch as it comes. notes (target,
    noted_at, note) is a stream of its own: an event waits for a note on it until `wait` after its time, and both sides'
    state is dropped as the watermarks pass that. Bookkeeping kinds are left out, and agents' rows unless asked for.
    """
    kept = events.filter(~F.col("kind").isin(*MACHINE)).withWatermark("at", "1 day")
    rows = kept.join(prompts, ["session", "turn"], "left").join(pages, "seq", "left")
    if not agents:
        rows = rows.filter(F.coalesce("role", F.lit("")) != "assistant")
    later = notes.withWatermark("noted_at", "1 day")
    near = (F.col("target") == F.col("seq")) & (F.col("noted_at") >= F.col("at")) & (F.col("noted_at") <= F.col("at") + F.expr(f"INTERVAL {wait}"))
    out = rows.join(later, near, "left")
    role = F.coalesce("role", F.when(F.col("page").isNotNull(), "page").when(F.col("note").isNotNull(), "note"))
    text = F.coalesce("said", "page", "note")
    return out.select("seq", "kind", role.alias("role"), F.when(F.length(text) > body, F.concat(F.substring(text, 1, body), F.lit("…"))).otherwise(text).alias("body"))


def in_steps(frames: list[DataFrame], folder: str) -> None:
    """Writes frames one after the other as one file each, the order in which a stream of the folder takes them."""
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(folder)


def at_once(frames: list[DataFrame], folder: str) -> int:
    """Writes frames as they are dealt, no task more than its part of one, and returns how many files a trigger of the folder has
    to take for all rows to come in one batch, in which their order doesn't matter."""
    for f in frames:
        f.write.mode("append").parquet(folder)
    return len(frames[0].sparkSession.read.parquet(folder).inputFiles())
