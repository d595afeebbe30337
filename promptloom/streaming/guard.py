"""The firewall over a stream of prompts, and the memory that follows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import firewall, memory, score


def prompts(spark: SparkSession, path: str, schema: str = "prompt_id long, text string", files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decisions(stream: DataFrame) -> DataFrame:
    """Analysis and decision of each prompt; stateless, so no watermark is needed."""
    seen = firewall.assess(stream.select("prompt_id", "text"))
    return seen.select("prompt_id", "text", "risk", "decision", F.size("findings").alias("n_findings"))


def remembered(prompts: DataFrame, known: memory.Backend, k: int = memory.NEIGHBOURS) -> DataFrame:
    """Decisions on prompts (prompt_id, text) that take into account how the most similar remembered ones fared.

    A prompt's nearest entries give its prior failure and win similarity; the first is the firewall's
    ``prior_failure_similarity``. Prompts without neighbours have 0. Adds vector, prior_failure_similarity,
    prior_win_similarity and the firewall's columns; prompt_id must be unique.
    """
    seen = prompts.select("prompt_id", "text", memory.hash_embed("text").alias("vector"))
    prior = memory.priors(known.query(seen.select("prompt_id", "vector"), k))
    names = {"prior_failure_similarity": "failed_before", "prior_win_similarity": "won_before"}
    df = seen.join(prior.withColumnsRenamed(names), "prompt_id", "left").fillna(0.0, list(names.values()))
    df = firewall.assess(df, {"prior_failure_similarity": "failed_before"})
    return df.drop("failed_before").withColumnRenamed("won_before", "prior_win_similarity")


def outcomes(decided: DataFrame) -> DataFrame:
    """What the memory keeps of decisions: their text's hash is the id, so a prompt that comes again takes its old place."""
    return decided.select(
        F.col("prompt_id").alias("seq"), F.sha2("text", 256).alias("id"), F.substring("text", 1, memory.PREVIEW).alias("preview"), "vector",
        F.lit(0.0).alias("composite"), (F.col("decision") == "allow").alias("accepted"), "decision", F.size("findings").alias("n_findings"), F.lit(0.0).alias("token_reduction"),
    )


def deciding_sink(known: memory.TableBackend, path: str) -> Callable[[DataFrame, int], None]:
    """A sink that decides each micro-batch with the memory as it was before, writes the decisions and remembers them.

    Decisions overwrite their batch's folder and the memory knows the last batch of this writer, so a batch that runs
    twice is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = f"{path}/batch={number}"
        remembered(batch, known).where("text is not null").write.mode("overwrite").parquet(out)
        known.upsert(outcomes(batch.sparkSession.read.parquet(out)), number, writer=path)

    return write


def analyses(stream: DataFrame) -> DataFrame:
    return score.analyze(stream.select("prompt_id", "text")).select("prompt_id", "tokens", "task_type", "composite", "tier")


def start(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Run with ``sink(batch, number)`` for every micro-batch; the checkpoint makes a restart go on where it stopped."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink whose batches each overwrite their own partition, so a batch that runs twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
