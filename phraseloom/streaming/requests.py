"""The query service as a stream: request lines in, JSON replies out.

Requests are joined with the index as it is when the stream starts.  Every micro-batch writes its replies to a folder named by its number, so a batch that runs again replaces its own
output, and each request has one reply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import words
from ..operators import service
from ..sources.corpus import Corpus


def parsed(lines: DataFrame) -> DataFrame:
    """pid and tokens of the lines ``qid;word word ...``; a line without a number is left out."""
    parts = F.split("value", ";", 2)
    return lines.select(parts[0].try_cast("long").alias("pid"), words(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("tokens")).where("pid is not null")


def replies(corpus: Corpus, requests: DataFrame, most: int = 10) -> DataFrame:
    """(pid, reply) for every request: a request without words is complete and has no ids, one with an unknown word is incomplete."""
    found = service.conjunctive_replies(corpus, requests, most)
    empty = F.to_json(F.struct(F.col("pid").alias("qid"), F.lit(True).alias("complete"), F.array().cast("array<long>").alias("ids")))
    return found.unionByName(requests.where(F.size("tokens") == 0).select("pid", empty.alias("reply")))


def serve(corpus: Corpus, requests: str, target: str, checkpoint: str, most: int = 10) -> StreamingQuery:
    """Answers what is new in the folder ``requests`` (text files) to ``target/batch=N`` (text, a reply a line), and stops when all of it is answered."""

    def answer(batch: DataFrame, number: int) -> None:
        replies(corpus, parsed(batch), most).select(F.col("reply").alias("value")).write.mode("overwrite").text(f"{target}/batch={number}")

    lines = corpus.spark.readStream.text(requests)
    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
