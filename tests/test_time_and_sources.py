import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnflow import cli
from tarnflow.functions import draw, edit_distance, fraction_bound, fuzzy_match
from tarnflow.operators import windows
from tarnflow.sources import log, prep
from tarnflow.streaming.reservoir import Reservoir, reservoir_by_key
from tarnflow.streaming.samples import StreamJoin, StreamSample, sample_per_window, sample_stream
from tarnflow.operators.sampling import swor


def test_byte_edit_distance(spark):
    df = spark.createDataFrame([("füü", "fuu"), ("日本語", "日本"), ("", "ab"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(edit_distance("a", "b")).collect()] == [4, 3, 2, None]
    assert [r[0] for r in df.select(fuzzy_match("a", "b", 3)).collect()] == [False, True, True, None]


def test_draws(spark):
    big = (1 << 61) + 12345
    got = [r[0] for r in spark.range(2000).select(draw(1, big, "id")).collect()]
    assert all(0 <= x < big for x in got) and len(set(got)) == 2000 and abs(sum(got) / 2000 / big - 0.5) < 0.05
    huge = 10**30 + 57
    got = [r[0] for r in spark.range(300).select(draw(1, huge, "id")).collect()]
    assert all(0 <= int(x) < huge for x in got) and len(set(got)) == 300 and abs(sum(map(int, got)) / 300 / huge - 0.5) < 0.1
    assert fraction_bound(1.0) is None and fraction_bound(0.0) == "0" * 15


def test_windows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, 9, 10, 11, 25, 3])], "id int, t bigint")
    ids = lambda d: sorted(r[0] for r in d.select("id").collect())
    assert ids(windows.tumbling(df, "t", 10, 11)) == [2, 3]
    assert ids(windows.sliding(df, "t", 10, 11)) == [1, 2, 3, 5]
    assert ids(windows.sliding(df, "t", 2, 11)) == [2, 3]
    assert ids(windows.pop_front(df, ["t", "id"], 2)) == [1, 2, 3, 4]
    assert ids(windows.pop_front(df, ["t", "id"], 100)) == []
    assert ids(windows.prefix(df, "id", 2)) == [0, 1, 2]
    assert [r[1] for r in windows.checkpoints(df, "id", 25, 10).collect()] == [3, 5, 8, 10, 13, 15, 18, 20, 23, 25]
    assert [r[0] for r in df.select(windows.tumbling_start("t", 10)).collect()] == [0, 0, 10, 10, 20, 0]


@pytest.fixture
def log_file(tmp_path):
    lines = ["0|1,1,2", "1|1,2,3", "1|1,2,4", "-", "0|1,5,2", "0|1,0,", "d 0 1", "1|1,0,9", "", "0|1,7,7"]
    path = tmp_path / "log.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_tuple_log(spark, log_file):
    read = log.read(spark, log_file)
    kinds = [(r["seq"], r["kind"], r["sid"]) for r in read.orderBy("seq").collect()]
    assert kinds == [(1, "insert", 0), (2, "insert", 1), (3, "insert", 1), (4, "report", None), (5, "insert", 0), (6, "insert", 0), (7, "delete", 0), (8, "insert", 1)]
    a, b = log.graph(read, 2)
    assert sorted(map(tuple, a.collect()), key=repr) == [(0, None), (5, 2)]
    assert sorted(map(tuple, b.collect())) == [(0, 9), (2, 3), (2, 4)]


def test_deletes_never_pop_more_than_there_is(spark, tmp_path):
    r = random.Random(3)
    lines, queue = [], []
    for i in range(120):
        if r.random() < 0.25:
            n = r.randrange(1, 6)
            lines.append(f"d 0 {n}")
            queue = queue[n:]
        else:
            lines.append(f"0|1,{i},{i}")
            queue.append(i)
    path = tmp_path / "d.txt"
    path.write_text("\n".join(lines))
    assert sorted(r[0] for r in log.graph(log.read(spark, str(path)), 1)[0].collect()) == queue


def test_log_round_trip_and_cli(spark, tmp_path, capsys):
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (3, 1)], "src int, dst int")
    streams = prep.graph_streams(e, 2)
    path = str(tmp_path / "out")
    log.write([(i, streams.where(F.col("sid") == i).select("src", "dst", "shuffle"), "shuffle") for i in (0, 1)], path)
    back = log.graph(log.read(spark, path), 2)
    for b in back:
        assert sorted(map(tuple, b.collect())) == [(1, 2), (2, 3), (2, 4), (3, 1)]
    assert cli.main(["line_join", "2", path, "3", "--out", str(tmp_path / "sample")], spark) == 0
    assert "join size = 4" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "sample")).count() == 3
    assert cli.main(["nonsense"], spark) == 2
    assert cli.main(["line_join_check", "2", path, "2", "3"], spark) == 0
    assert "n_results" in capsys.readouterr().out


def cli_lines(spark, capsys, *argv):
    assert cli.main([str(a) for a in argv], spark) == 0
    return capsys.readouterr().out.splitlines()


def test_cli_reports_windows_and_designs(spark, tmp_path, capsys):
    log_lines = ["0|1,1,2", "1|1,2,3", "-", "1|1,2,4", "0|1,5,2", "-", "d 1 1"]
    path = str(tmp_path / "log.txt")
    (tmp_path / "log.txt").write_text("\n".join(log_lines) + "\n")
    got = cli_lines(spark, capsys, "line_join", 2, path, 10, "--reports", "--report-file", tmp_path / "r.txt")
    assert [x.split(", ms")[0] for x in got] == ["report 1: tuples = 2, n_seen = 1, size = 1", "report 2: tuples = 4, n_seen = 4, size = 4", "join size = 2", "size = 2"]
    assert (tmp_path / "r.txt").read_text().splitlines() == got
    assert cli_lines(spark, capsys, "line_join", 2, path, 7, "--sampling", "swr")[-1] == "size = 7"
    assert cli_lines(spark, capsys, "line_join", 2, path, 0.999999, "--sampling", "bernoulli")[-1] == "size = 2"
    assert cli_lines(spark, capsys, "line_join", 2, path, 9, "--window", "sliding", "--window-size", 4, "--window-column", "src")[0] == "join size = 1"
    got = cli_lines(spark, capsys, "line_join_update_time", 2, path)
    assert got[0] == "join size = 2" and got[1] == "tuples = 4" and got[4].endswith("ns per tuple")


def test_cli_keeps_roles_apart(spark, tmp_path, capsys):
    """Streams of one table's two roles that differ, and a delete on the second role."""
    sale, customer, hd, item = "1,1,{0},{1},1,1,1,1,1,1,1,{2}", "{0},c,1,{1}", "{0},{1},x,1,1", "{0},i,,,d,1.0,1.0,1,b,1,c,{1},k,1,m"
    rows = ["0|1," + sale.format(7, 1, 100), "0|1," + sale.format(8, 2, 101), *[f"5|1,{customer.format(i, 1)}" for i in (1, 2)], f"3|1,{hd.format(1, 5)}", f"4|1,{hd.format(9, 5)}", *[f"1|1,{customer.format(i, 9)}" for i in (40, 41, 42)], *[f"6|1,{item.format(i, 3)}" for i in (7, 8)], *[f"2|1,{item.format(i, 3)}" for i in (70, 71)]]
    path = tmp_path / "qz.txt"
    for more, size in (([], 12), (["d 1 2"], 4), (["d 2 1"], 6)):
        path.write_text("\n".join(rows + more) + "\n")
        for query in ("qz", "qz_fk", "qz_fk_group"):
            assert cli_lines(spark, capsys, query, path, 5)[0] == f"join size = {size}", (query, more)
    tri = [(1, 2), (2, 3), (3, 1)]
    other = [(4, 5), (5, 6), (6, 4)]
    lines = [f"{sid}|1,{a},{b}" for sid, (a, b) in [*enumerate(tri), *[(i + 3, e) for i, e in enumerate(other)], (6, (1, 4)), (6, (4, 1))]]
    path.write_text("\n".join(lines) + "\n")
    assert cli_lines(spark, capsys, "dumbbell", path, 5) == ["join size = 1", "size = 1"]
    path.write_text("\n".join([*lines, "d 5 1"]) + "\n")
    assert cli_lines(spark, capsys, "dumbbell", path, 5) == ["join size = 0", "size = 0"]


def test_social_tables_to_a_log(spark):
    def t(columns, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))

    at = [f"2024-01-01 00:00:{i:02d}" for i in range(10)]
    note = "creationDate id locationIP browserUsed content length CreatorPersonId"
    tables = {
        "tag_class": t("id name url SubclassOfTagClassId", ("1", "n, x", "u", None)), "tag": t("id name url TypeTagClassId", ("2", "t", "u", "1")),
        "place": t("id name url type PartOfPlaceId", ("3", "c", "u", "Country", "9"), ("4", "d", "u", "City", "3"), ("9", "e", "u", "Continent", None)),
        "post": t(note, (at[5], "10", "ip", "b", "hello", "5", "20")), "comment": t(note, (at[7], "11", "ip", "b", "so, so", "6", "21")),
        "post_has_tag": t("creationDate PostId TagId", (at[6], "10", "2")), "comment_has_tag": t("creationDate CommentId TagId", (at[8], "11", "2")),
        "person": t("creationDate id firstName lastName gender birthday locationIP browserUsed LocationCityId", (at[1], "20", "a", "b", "f", "1", "ip", "x", "4"), (at[2], "21", "a", "b", "m", "1", "ip", "x", "4")),
        "knows": t("creationDate Person1Id Person2Id", (at[3], "20", "21")),
    }
    lines = [r["value"] for r in prep.event_lines(prep.social_events(tables)).orderBy("phase", "at", "seq").collect()]
    rows = [x for x in lines if x != "-"]
    assert [x.split("|")[0] for x in rows] == ["0", "1", "2", "3", "4", "8", "9", "8", "9", "10", "10", "5", "6", "7", "5", "6", "7"]
    assert rows[0].startswith('0|1,1,"n, x",u') and rows[9:11] == ["10|1,20,21", "10|1,21,20"]
    assert [i for i, x in enumerate(lines) if x == "-"] == [8, 12, 16, 20] or lines.count("-") == 4  # twelve dynamic rows, a marker after every third



def test_social_preparation(spark):
    k = spark.createDataFrame([(1, 2)], "person1_id int, person2_id int")
    assert sorted(map(tuple, prep.both_directions(k).collect())) == [(1, 2), (2, 1)]
    posts = spark.createDataFrame([(1, "2024-01-01 00:00:01")], "id int, at string")
    out = prep.event_order([(0, spark.createDataFrame([(5, "x")], "id int, name string"))], [(1, posts, "at")])
    assert [tuple(r) for r in out.orderBy("phase", "at").collect()] == [(0, 0, 0, "5,x"), (1, 1704067201000, 1, "1")]
    assert prep.messages(posts, posts).count() == 2


def test_reservoir_is_uniform_and_keeps_state():
    n, k, repeat = 40, 5, 3000
    seen = Counter()
    for s in range(repeat):
        r = Reservoir(k, s)
        r.add_all(range(17))
        q = Reservoir(k, 0)
        q.restore(r.state())
        q.add_all(range(17, n))
        assert len(set(q.rows)) == k
        seen.update(q.rows)
    mean = repeat * k / n
    assert sum((seen[i] - mean) ** 2 / (mean * (1 - k / n)) for i in range(n)) < 80  # 39 degrees
    late = Reservoir(10, 1, lambda x: x % 2 == 0)
    late.add_all(range(20000))
    assert len(late.rows) == 10 and all(x % 2 == 0 for x in late.rows) and late.judged < 400
    none = Reservoir(0)
    none.add_all(range(5))
    assert none.rows == [] and math.isfinite(none.w)


def test_stream_sample_equals_batch_sample(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 100, i * 100 + 100).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(src)
    got = sorted(r[0] for r in sample_stream(stream, ["id"], 20).collect())
    assert got == sorted(r[0] for r in swor(spark.range(300), ["id"], 20).collect())


def test_stream_sample_survives_reruns_and_restarts(spark, tmp_path):
    whole = sorted(r[0] for r in swor(spark.range(400), ["id"], 20).collect())
    folder = str(tmp_path / "state")
    parts = [spark.range(i * 100, i * 100 + 100) for i in range(4)]
    one = StreamSample(spark, ["id"], 20, folder=folder)
    for epoch in (0, 0, 1, 1):  # a batch runs twice
        one(parts[epoch], epoch)
    two = StreamSample(spark, ["id"], 20, folder=folder)  # after a restart, which repeats the last batch
    for epoch in (1, 2, 3):
        two(parts[epoch], epoch)
    assert sorted(r[0] for r in two.current.collect()) == whole
    two(parts[2], 2)  # from an older checkpoint: what came later doesn't count any more
    assert sorted(r[0] for r in two.current.collect()) == sorted(r[0] for r in swor(spark.range(300), ["id"], 20).collect())


def test_stream_join_survives_reruns_and_restarts(spark, tmp_path):
    from tarnflow.plans import named

    edges = [(1, 2), (2, 3), (2, 4), (3, 1), (4, 1), (1, 3)]
    rows = [(sid, f"{a},{b}") for a, b in edges for sid in (0, 1)]
    random.Random(2).shuffle(rows)
    make = lambda r: named.line([r["g1"], r["g2"]], 2)
    streams = [("g1", log.GRAPH), ("g2", log.GRAPH)]
    batches = [spark.createDataFrame(rows[i : i + 4], "sid int, payload string") for i in (0, 4, 8)]
    for k in (3, 100):
        folder = str(tmp_path / f"j{k}")
        for epoch in (0, 0, 1, 1, 2):  # each batch by a new object
            StreamJoin(spark, streams, make, k, folder=folder)(batches[epoch], epoch)
        got = sorted(map(tuple, StreamJoin(spark, streams, make, k, folder=folder).current.collect()))
        df = spark.createDataFrame(edges, "src int, dst int")
        spec = named.line(df, 2)
        assert got == sorted(map(tuple, swor(spec.results(), spec.ids(), k).collect()))


def test_window_state_is_bounded(spark, tmp_path):
    src = str(tmp_path / "big")
    df = spark.range(5000).select("id", F.timestamp_seconds(F.col("id")).alias("ts"))
    df.coalesce(2).write.parquet(src)
    q = sample_per_window(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), "ts", "1 hour", "1 hour", ["id"], 4).writeStream.format("memory").queryName("b").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cb")).start()
    q.awaitTermination()
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(x["numRowsTotal"] for x in state) <= 2 and all(x["memoryUsedBytes"] < 60_000 for x in state)


def test_pop_front_of_many(spark):
    df = spark.range(300).select("id", (F.col("id") % 50).alias("t"))
    few = {r[0] for r in windows.pop_front(df, ["t", "id"], 120).collect()}
    windows.FEW, kept = 10, windows.FEW
    try:
        assert {r[0] for r in windows.pop_front(df, ["t", "id"], 120).collect()} == few and len(few) == 180
        assert windows.pop_front(df, ["t", "id"], 1000).count() == 0
    finally:
        windows.FEW = kept


def test_window_and_keyed_streams(spark, tmp_path):
    src = str(tmp_path / "w")
    df = spark.range(300).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("string").alias("key"))
    df.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    q = sample_per_window(stream(), "ts", "1 hour", "0 seconds", ["id"], 4).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    rows = spark.table("w").collect()
    assert rows and all(len(r["sample"]) == 4 for r in rows)
    q = reservoir_by_key(stream(), "key", "id", 5).writeStream.format("memory").queryName("k").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    got = {r["key"]: r["sample"] for r in spark.table("k").collect()}
    assert set(got) == {"0", "1"} and all(len(set(v)) == 5 for v in got.values())
