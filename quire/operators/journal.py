"""Model calls with a journal: what was answered is written before it is used and never asked again.

A prompt is known by its hash. Every round asks what the journal lacks an answer to, in waves of a bounded number of calls, and
each task's answers are in the journal as soon as the task ends, so a run that is killed loses at most the blocks of prompts
under way, and a repeated run asks for those only. Waves start a minute apart, which bounds the calls a minute over all tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.staging import staged

JOURNAL = "prompt_hash string, reply string, error string, round int"
#: Prompts of a task: the most that are asked twice after a failure.
BLOCK = 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """The journal: one row for each answer or failure; empty before the first."""
    try:
        return spark.read.schema(JOURNAL).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], JOURNAL)


def answers(journal: DataFrame) -> DataFrame:
    """prompt_hash and reply of every prompt that has an answer, the first one that it got."""
    return journal.filter("reply IS NOT NULL").groupBy("prompt_hash").agg(F.min_by("reply", F.struct("round", "reply")).alias("reply"))


def prompt_hash(prompt: str = "prompt"):
    return F.sha2(F.coalesce(prompt, F.lit("")), 256)


def _wave_of(n: int):
    return F.pmod(F.xxhash64("prompt_hash"), F.lit(n))


def waves(asked: DataFrame, n: int, per_minute: int | None) -> int:
    """So many waves, by the prompts' hashes, that none has over ``per_minute`` of the ``n`` prompts."""
    if not per_minute:
        return 1
    count = -(-n // per_minute)
    while asked.groupBy(_wave_of(count).alias("wave")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > per_minute:
        count += -(-count // 4)
    return count


def ask(
    prompts: DataFrame, client: Callable[[], Callable[[str], str]], path: str, rounds: int = 3, per_minute: int | None = None, block: int = BLOCK, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic
) -> DataFrame:
    """prompts (any columns, prompt among them) with prompt_hash and reply; a prompt that failed in every round has a null reply.

    ``client()`` is made once in a task and called with one prompt at a time. Equal prompts are asked once. A null prompt is an
    empty one.
    """
    spark = prompts.sparkSession
    wanted = staged(prompts.select(prompt_hash().alias("prompt_hash"), F.coalesce("prompt", F.lit("")).alias("prompt")).dropDuplicates(["prompt_hash"]), "prompts")

    def call(number: int):
        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, rows = client(), []
            for frame in frames:
                for key, prompt in zip(frame["prompt_hash"], frame["prompt"]):
                    try:
                        rows.append((key, model(prompt), None, number))
                    except Exception as e:  # one failed call is asked again in the next round
                        rows.append((key, None, f"{type(e).__name__}: {e}", number))
            yield pd.DataFrame(rows, columns=["prompt_hash", "reply", "error", "round"])

        return each

    for number in range(1, rounds + 1):
        done = read(spark, path).filter("reply IS NOT NULL").select("prompt_hash").distinct()
        asked = staged(wanted.join(done, "prompt_hash", "left_anti"), "asked")
        if not (n := asked.count()):
            break
        total = waves(asked, n, per_minute)
        for wave in range(total):
            began = clock()
            part = asked.filter(_wave_of(total) == wave).repartition(-(-n // (total * block)))
            # Answers of a finished task are there at once, not only when all have finished.
            part.mapInPandas(call(number), JOURNAL).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
            if per_minute and (wave + 1 < total or number < rounds):
                sleep(max(0.0, 60 - (clock() - began)))
    found = answers(read(spark, path))
    return prompts.withColumn("prompt_hash", prompt_hash()).join(found, "prompt_hash", "left")
