"""Lineage of RDD jobs."""

import pytest

from whence.operators.rdd import LineageContext


@pytest.fixture
def lc(spark):
    return LineageContext(spark.sparkContext)


def ids(job, wanted):
    return [i for v, i in job.collectWithId() if wanted(v)]


def test_word_count(lc, tmp_path):
    (tmp_path / "t.txt").write_text("apple banana\napple\ncherry apple\ndate\n")
    counts = lc.textFile(str(tmp_path / "t.txt"), 2).flatMap(str.split).map(lambda w: (w, 1)).reduceByKey(lambda a, b: a + b)
    assert dict(counts.collect())["apple"] == 3
    back = counts.getLineage().filter(ids(counts, lambda kv: kv[0] == "apple")).goBack()
    assert back.show() == ["apple banana", "apple", "cherry apple"] and back.atSource
    assert back.goNext().collect() == sorted(counts.getLineage().filter(ids(counts, lambda kv: kv[0] in ("apple", "banana", "cherry"))).collect())


def test_join_is_traced_by_key(lc):
    a, b = lc.parallelize([(1, "x"), (2, "y"), (1, "z")], 2), lc.parallelize([(1, "p"), (2, "q")], 2)
    j = a.join(b)
    c = j.getLineage().filter(ids(j, lambda kv: kv[1] == ("x", "p")))
    assert c.goBack(0).show() == [(1, "x"), (1, "z")] and c.goBack(1).show() == [(1, "p")]
    g = a.cogroup(b)
    assert dict(g.collect())[2] == (["y"], ["q"])


def test_other_aggregations(lc):
    p = lc.parallelize([("a", 1), ("b", 2), ("a", 3)], 2)
    assert dict(p.groupByKey().mapValues(sorted).collect()) == {"a": [1, 3], "b": [2]}
    assert dict(p.aggregateByKey(0, lambda z, v: z + v, lambda x, y: x + y).collect()) == {"a": 4, "b": 2}
    assert dict(p.combineByKey(lambda v: [v], lambda c, v: [*c, v], lambda x, y: x + y).mapValues(len).collect()) == {"a": 2, "b": 1}
    d = lc.parallelize([1, 1, 2, 3], 2).distinct()
    assert sorted(d.collect()) == [1, 2, 3] and d.getLineage().filter(ids(d, lambda v: v == 1)).goBack().show() == [1, 1]
    assert {k: sorted(v) for k, v in lc.parallelize([1, 2, 3]).groupBy(lambda v: v % 2).collect()} == {0: [2], 1: [1, 3]}


def test_narrow_operations_and_union(lc, tmp_path):
    p = lc.parallelize([3, 1, 2], 2)
    assert p.sortBy(lambda v: v).collect() == [1, 2, 3]
    assert p.keyBy(lambda v: v % 2).sortByKey().keys().collect() == [0, 1, 1]
    assert sorted(p.mapPartitions(lambda it: (v * 10 for v in it)).collect()) == [10, 20, 30]
    assert sorted(p.keyBy(str).flatMapValues(lambda v: [v] * v).values().collect()) == [1, 2, 2, 3, 3, 3]
    u = p.union(lc.parallelize([9, 1], 1))
    got = u.getLineage().filter(ids(u, lambda v: v == 1))
    assert got.goBack(0).show() == [1] and got.goBack(1).show() == [1]
    assert sorted(p.zipPartitions([lc.parallelize([30, 10, 20], 2)], lambda a, b: [x + y for x, y in zip(a, b, strict=True)]).collect()) == [11, 22, 33]
    c = p.getLineage()
    assert c.filter([0, 1]).intersection(c.filter([1, 2])).collect() == [1] and c.goBackAll().goNextAll().collect() == [0, 1, 2]
    c.saveAsCSVFile(str(tmp_path / "csv"))
    p.saveAsTextFile(str(tmp_path / "txt"))
    with pytest.raises(ValueError):
        c.goBack()
    lc.releaseLineage()


def test_partition_functions_may_read_ahead_but_not_change_the_number(lc):
    p = lc.parallelize([3, 1, 2, 5], 2)
    doubled = p.mapPartitions(lambda it: [2 * v for v in list(it)])
    assert doubled.getLineage().filter(ids(doubled, lambda v: v == 2)).show() == [1]
    for wrong in (lambda it: [v for v in it if v > 2], lambda it: [v for v in it for _ in "ab"], lambda it: [next(iter(it))]):
        with pytest.raises(Exception, match="mapPartitionsWithIds"):
            p.mapPartitions(wrong).collect()
    twice = p.mapPartitionsWithIds(lambda it: ((i, v + k) for i, v in it for k in (0, 100)))
    assert sorted(twice.collect()) == [1, 2, 3, 5, 101, 102, 103, 105]
    assert twice.getLineage().filter(ids(twice, lambda v: v == 105)).show() == [5]
    with pytest.raises(Exception, match="more outputs"):
        p.zipPartitions([lc.parallelize([1, 2, 3, 4], 2)], lambda a, b: [*a, *b]).collect()
    third = p.zipPartitions([lc.parallelize([10, 20, 30, 40], 2), lc.parallelize([1, 1, 1, 1], 2)], lambda a, b, c: (x + y + z for x, y, z in zip(a, b, c, strict=True)))
    assert sorted(third.collect()) == [14, 22, 33, 46] and third.getLineage().filter(ids(third, lambda v: v == 46)).show() == [5]


def test_a_job_is_replayed_on_traced_records(lc):
    a, b = lc.parallelize([(1, "x"), (2, "y"), (1, "z")], 2), lc.parallelize([(1, "p"), (2, "q")], 2)
    job = a.join(b).mapValues(lambda v: v[0] + v[1]).mapPartitions(lambda it: list(it)).sortBy(lambda kv: kv[1])
    at = job.getLineage().filter(ids(job, lambda kv: kv[0] == 1))
    assert sorted(job.replayCollect(at.goBack(0))) == [(1, "xp"), (1, "zp")] and sorted(job.replayCollect()) == sorted(job.collect())
    assert job.replayCollect(at.goBack(0).filter([0]), at.goBack(1)) == [(1, "xp")] and at.goBack(1).replay().count() == 2
    words = lc.parallelize(["a b", "b c", "c"], 2).flatMap(str.split)
    counts = words.map(lambda w: (w, 1)).reduceByKey(lambda x, y: x + y)
    back = counts.getLineage().filter(ids(counts, lambda kv: kv[0] == "a")).goBack()
    assert sorted(back.replay().collect()) == [("a", 1), ("b", 1)]
    union = words.union(lc.parallelize(["z"], 1)).distinct().zipWithUniqueId().coalesce(1)
    assert sorted(v for v, _ in union.replayCollect()) == ["a", "b", "c", "z"]
    with pytest.raises(ValueError):
        counts.replay(counts.getLineage())


def test_walks_that_the_context_keeps(lc):
    with pytest.raises(ValueError):
        lc.getBackward()
    source = lc.parallelize([("a", 1), ("b", 2), ("a", 3)], 2)
    sums = source.reduceByKey(lambda x, y: x + y)
    top = sums.map(lambda kv: (kv[1] > 2, kv[0])).groupByKey()
    lc.getLineage(top)
    assert len(lc.getBackward().collect()) == 2
    assert lc.getBackward().show() == [("a", 1), ("b", 2), ("a", 3)] and len(lc.getForward().collect()) == 2 and len(lc.getForward().collect()) == 2
    assert lc.search(top, source) == [0, 0] and lc.search(top, top) == [] and lc.search(sums.join(source), source) in ([1], [0, 0])
    with pytest.raises(ValueError):
        lc.search(source, top)


def test_frontiers_of_any_size_give_the_same(lc, monkeypatch):
    from whence.operators import rdd

    counts = lc.parallelize(["a b", "b c", "c"], 2).flatMap(str.split).map(lambda w: (w, 1)).reduceByKey(lambda x, y: x + y)
    wanted = ids(counts, lambda kv: kv[0] in "bc")
    few = counts.getLineage().filter(wanted).goBack().show()
    monkeypatch.setattr(rdd, "SMALL_FRONTIER", 0)
    assert counts.getLineage().filter(wanted).goBack().show() == few == ["a b", "b c", "c"]


def test_hadoop_files_sorts_and_unique_ids(lc, tmp_path):
    (tmp_path / "t.txt").write_text("b 2\na 1\nc 3\n")
    lines = lc.hadoopFile(str(tmp_path / "t.txt"), "org.apache.hadoop.mapred.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text").values()
    pairs = lines.map(lambda s: tuple(s.split())).repartitionAndSortWithinPartitions(1)
    assert pairs.collect() == [("a", "1"), ("b", "2"), ("c", "3")]
    assert [v for _, v in pairs.getLineage().filter(ids(pairs, lambda kv: kv[0] == "a")).show()] == ["a 1"]
    unique = pairs.zipWithUniqueId()
    assert len({i for _, i in unique.collect()}) == 3
    kind = "org.apache.hadoop.mapred.SequenceFileOutputFormat"
    pairs.saveAsHadoopFile(str(tmp_path / "seq"), kind)
    conf = {"mapred.output.format.class": kind, "mapreduce.job.output.key.class": "org.apache.hadoop.io.Text", "mapreduce.job.output.value.class": "org.apache.hadoop.io.Text", "mapreduce.output.fileoutputformat.outputdir": str(tmp_path / "seq2")}
    pairs.saveAsHadoopDataset(conf)
    for out in ("seq", "seq2"):
        assert sorted(lc.sc.sequenceFile(str(tmp_path / out)).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_links_as_a_table(lc, spark, tmp_path):
    counts = lc.parallelize(["a", "b", "a"], 2).map(lambda w: (w, 1)).reduceByKey(lambda x, y: x + y)
    at = counts.getLineage()
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    at.saveAsDBTable(url, "app", "app", "links", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = spark.read.format("jdbc").options(url=url, dbtable="links", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").load()
    assert sorted(map(tuple, got.collect())) == sorted(at.pairs().collect()) and got.count() == 3
