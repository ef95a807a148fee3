"""Incremental ingest and the request stream against the batch form."""

import json

from phraseloom.sources.corpus import Corpus
from phraseloom.streaming import ingest, requests


def test_batches_add_up(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for rows in ([(1, "a b a"), (2, None)], [(3, "B c")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        seen += rows
        ingest.ingest(spark, source, target, str(tmp_path / "state")).awaitTermination()
        expected = sorted(map(tuple, ingest.tokens_of(spark.createDataFrame(seen, "doc_id long, text string")).collect()))
        assert sorted(map(tuple, spark.read.parquet(target).select("term", "doc_id", "pos").collect())) == expected
    ingest.running_counts(spark, source, str(tmp_path / "counts"), "word_counts").awaitTermination()
    assert {r.term: r.cf for r in spark.table("word_counts").collect()} == {"a": 2, "b": 2, "c": 1}


def test_request_stream(spark, tmp_path):
    """One reply for each request, over two runs: known and unknown words, no words, a line that is no request."""
    corpus = Corpus(spark.createDataFrame([(1, "a b"), (2, "b c b"), (3, "A, c"), (70, "b c")], "doc_id long, text string"))
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    for name, text in (("one", "1;b c\n2;zzz b\n3;\nno request\n"), ("two", "4;A\n5;b\n6\n")):
        (tmp_path / "in" / name).write_text(text)
        requests.serve(corpus, *paths, most=2).awaitTermination()
    got = {x["qid"]: (x["complete"], x["ids"]) for x in (json.loads(r.value) for r in spark.read.text(paths[1]).collect())}
    assert got == {1: (True, [2, 70]), 2: (False, []), 3: (True, []), 4: (True, [1, 3]), 5: (True, [1, 2]), 6: (True, [])}
    assert spark.read.text(paths[1]).count() == 6
