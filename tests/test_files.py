"""Pattern, query and result files."""

from phraseloom.sources import patterns


def test_pattern_files(spark, tmp_path):
    rows = [(7, 2, 3, 10, 12, 2, 3, 99, 5, [4, 5, 6]), (8, -1, 1, 0, 0, 0, 0, 1, 1, [2])]
    frame = spark.createDataFrame(rows, "id long, bucket long, m long, sp long, ep long, ndoc long, nocc long, list_size_sum long, min_list_size long, tokens array<int>")
    patterns.write_patterns(frame.coalesce(1), str(tmp_path / "p"))
    assert sorted(map(tuple, patterns.read_patterns(spark, str(tmp_path / "p")).collect())) == rows


def test_old_pattern_file(spark, tmp_path):
    (tmp_path / "old").write_text("1;60;2;5;9;70;3,4\n0;3;1;1;2;3;9\n")
    got = [tuple(r) for r in patterns.read_old_patterns(spark, str(tmp_path / "old")).orderBy("id").collect()]
    assert got == [(1, 1, 60, 2, 5, 9, 70, [3, 4]), (2, 0, 3, 1, 1, 2, 3, [9])]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    """Two files, with empty lines, in one split each and in about twenty."""
    for name, n in (("x", 200), ("y", 57)):
        (tmp_path / name).write_text("".join("\n" if i % 9 == 0 else f"0;{i};2;5;9;70;3,4\n" for i in range(1, n + 1)))

    def ids():
        return sorted((r.file.rpartition("/")[2], r.number, r.value) for r in patterns.numbered_lines(spark, f"{tmp_path}/*").collect())

    one = ids()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "180b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert spark.read.text(f"{tmp_path}/x").rdd.getNumPartitions() >= 15 and ids() == one
        old = {r.id: r.ndoc for r in patterns.read_old_patterns(spark, f"{tmp_path}/x").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert old == {i: i for i in range(1, 201) if i % 9} and len(one) == 257


def test_queries_stop_at_unknown_words(spark, tmp_path):
    (tmp_path / "q").write_text("1;a b\n2;a zzz b\n3;zzz\n")
    dictionary = spark.createDataFrame([("a", 2), ("b", 3)], "term string, term_id long")
    got = {r.qid: (r.complete, r.ids, r.missing) for r in patterns.parse_queries(patterns.read_queries(spark, str(tmp_path / "q")), dictionary).collect()}
    assert got == {1: (True, [2, 3], []), 2: (False, [2], ["zzz"]), 3: (False, [], ["zzz"])}


def test_result_sheet(spark, tmp_path):
    frame = spark.createDataFrame([("align", 1, 2, 3, 4, 5, 6, 0, 7)], ", ".join(f"{c} {'string' if c == 'type' else 'long'}" for c in patterns.RESULT_FIELDS)).coalesce(1)
    patterns.write_results(frame, str(tmp_path / "r"))
    lines = [line for f in (tmp_path / "r").glob("part-*") for line in f.read_text().splitlines()]
    assert lines == [";".join(patterns.RESULT_FIELDS), "align;1;2;3;4;5;6;0;7"]
