"""Operators on small fixtures."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyflow.functions.hashing import folded_part
from keyflow.operators import match, merge, ordering, reduce, routing, stage
from keyflow.operators.match import KeyedInput
from keyflow.sources.config import FlowConfig
from keyflow.sources.lines import read_lines
from keyflow.sources.paths import PathTemplate


def side(spark, rows):
    return KeyedInput(spark.createDataFrame(rows, "k string, s int, v string"), F.col("k"), F.col("v"), F.col("s"))


def test_first_char_groups(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.concat(F.substring(F.lit("abcdefghijk"), (F.col("id") % 11 + 1).cast("int"), F.lit(1)), "id").alias("value"))
    found = {r.key: r["values"] for r in match.key_lists(rows.withColumn("key", F.substring("value", 1, 1))).collect()}
    assert len(found) == 11 and len(found["a"]) == 10 and sum(map(len, found.values())) == 100
    assert found["a"][:2] == ["a0", "a11"]


@pytest.mark.parametrize("run", [None, 2])
def test_zip_unequal(spark, run):
    a = side(spark, [("x", 1, "a1"), ("x", 2, "a2"), ("x", 9, "a3"), ("y", 1, "a4"), (None, 1, "n")])
    b = side(spark, [("x", 5, "b1"), ("x", 6, "b2"), ("z", 1, "b3"), (None, 1, "n")])
    found = match.zip_match([a, b], run=run).orderBy("key", "pos").collect()
    assert [(r.key, r.pos, r.value_0, r.value_1) for r in found] == [("x", 1, "a1", "b1"), ("x", 2, "a2", "b2")]
    left = {(r.key, r.kind): r.leftover for r in match.zip_leftover([a, b]).collect()}
    assert left == {("x", 0): 1, ("y", 0): 1, ("z", 1): 1}


def test_catch_all_shadows(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    found = match.typed_match(df, [("any", F.lit(True)), ("one", F.col("v") == 1)])
    assert {r.branch for r in found.collect()} == {"any"}


def test_unhandled_strict(spark):
    df = match.typed_match(spark.createDataFrame([(1,)], "v int"), [("two", F.col("v") == 2)])
    with pytest.raises(Exception, match="unhandled record"):
        match.unhandled(df, strict=True).collect()


def test_numbering_in_runs_is_the_same(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("s"))
    a = ordering.numbered(df, ["k"], ["s"]).collect()
    assert sorted(a) == sorted(ordering.numbered(df, ["k"], ["s"], run=7).collect())


def test_reduce_equals_fold(spark):
    rows = spark.range(50).select((F.col("id") % 4).alias("key"), F.col("id").alias("seq"), F.col("id").alias("value"))
    python = {r.key: r.value for r in reduce.fold_python(rows, lambda k, vs: sum(vs), T.LongType()).collect()}
    assert python == {r.key: r.t for r in reduce.fold(rows, F.sum("value").alias("t")).collect()}


def folded(key, parts):
    h = (key ^ (key >> 32)) & 0xFFFFFFFF
    width, x = parts.bit_length() - 1, 0
    for s in range(0, 32, width):
        x ^= h >> s
    x = x - (1 << 32) if x >> 31 else x
    return abs(x) % parts


@pytest.mark.parametrize("parts", [2, 7, 30])
def test_folded_part(spark, parts):
    keys = [0, 1, 5, 12345, 2**31 - 1, 2**31, 2**40 + 17, 999_999_937]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", folded_part(F.col("k"), parts).alias("p"))
    assert {r.k: r.p for r in df.collect()} == {k: folded(k, parts) for k in keys}


def test_bagging_share(spark):
    n = routing.to_bagged(spark.range(4000), 5, 3, F.col("id")).count()
    assert abs(n / 20000 - 0.632) < 0.02
    assert routing.to_all(spark.range(3), 4).count() == 12


def test_absent_counts_as_zero(spark):
    states = spark.createDataFrame([(0, {"a": 2, "b": 3}), (1, {"a": 5})], "part int, m map<string,int>")
    found = lambda op, absent="zero": {r.key: r.value for r in merge.maps(states, "m", op, 2, absent).collect()}
    assert found("multiply") == {"a": 10, "b": 0} and found("multiply", "skip") == {"a": 10, "b": 3}
    assert found("min") == {"a": 2, "b": 0} and found("add") == {"a": 7, "b": 3} and found("mean") == {"a": 3, "b": 1}
    doubles = spark.createDataFrame([(0, {"a": 2.0, "b": 3.0}), (1, {"a": 5.0})], "part int, m map<string,double>")
    assert {r.key: r.value for r in merge.maps(doubles, "m", "mean", 2).collect()} == {"a": 3.5, "b": 1.5}


def test_unsupported_merges(spark):
    for op, kind in (("mean", T.BooleanType()), ("add", T.StringType()), ("multiply", T.StringType())):
        with pytest.raises(merge.UnsupportedMerge):
            merge.scalar(op, "x", kind)


def test_stage_barrier(spark, tmp_path):
    seen = []
    first = stage.Stage(lambda df: df.where("id > 1"), "first")
    last = first.connects(stage.Stage(lambda df: df.agg(F.sum("id").alias("n")), "last")).with_handler(lambda df: seen.append(df.first().n))
    first.sync(spark.range(5), str(tmp_path / "out"))
    assert seen == [9] and last.name == "last" and first.elapsed > 0


def test_lines(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"a\r\nb\n\rc\rd")
    (tmp_path / "empty.txt").write_bytes(b"")
    assert [r.line for r in read_lines(spark, str(path), newline="pairs").collect()] == ["a", "", "b", "c", "d"]
    assert [r.line for r in read_lines(spark, str(path)).collect()] == ["a", "b", "", "c", "d"]
    assert read_lines(spark, str(tmp_path / "empty.txt"), newline="pairs").where("line <> ''").count() == 0


def test_paired_line_ends_by_brute_force(spark, tmp_path):
    draw, expected = random.Random(3), []
    for k in range(30):
        text = "".join(draw.choice(["a", "bc", "é", "\n", "\r"]) for _ in range(draw.randrange(1, 60)))
        (tmp_path / f"{k}.txt").write_bytes(text.encode())
        lines = re.split("\n\r|\n|\r", text)
        expected += lines[:-1] if lines[-1] == "" else lines
    found = read_lines(spark, str(tmp_path), newline="pairs")
    assert sorted(r.line for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("run", [3, 7, 1 << 16])
def test_split_point_by_brute_force(spark, run):
    from keyflow.functions.stats import split_point

    draw = random.Random(run)
    for keys in ([5], [-9, -1, 0, 3], sorted(draw.sample(range(-200, 200), 40))):
        counts = [(k, draw.randrange(1, 9)) for k in keys]
        half, cum, left = sum(n for _, n in counts) // 2, 0, None
        for k, n in counts:
            cum += n
            if cum >= half:
                break
            left = k
        expected = k if left is None else max(1, (k - left) // 2) + left
        assert split_point(spark.createDataFrame(counts, "key long, n long"), run).first().split == expected


@pytest.mark.parametrize("run_buckets", [1, 5, 1 << 16])
def test_debounced_in_runs(spark, run_buckets):
    from keyflow.operators.reduce import debounced

    draw, at, rows, gap = random.Random(5), 1_000_000, [], 0
    for seq in range(60):
        pause = draw.choice([0, 1, 3, 4, 9, 200])
        at, gap = at + pause, gap + (pause > 3 and seq > 0)
        rows.append((seq, at, gap))
    df = spark.createDataFrame(rows, "seq long, at long, expected long").withColumn("ts", F.timestamp_seconds("at"))
    df = df.unionByName(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("expected", F.lit(None).cast("long")))
    found = debounced(df, "ts", 3, run_buckets).collect()
    assert len(found) == 61 and all(r.gap == r.expected for r in found)


@pytest.mark.parametrize("run", [None, 2, "ranked"])
def test_numbering_of_nulls_ties_and_clashing_names(spark, run, monkeypatch):
    """Null keys and orders are numbered like others, null first; columns named like the helpers' stay."""
    rows = [(k, s, 7) for k in ("a", None) for s in (5, None, 3, 3, 9, -4)]
    df = spark.createDataFrame(rows, "k string, s long, run long")
    found = sorted(map(tuple, ordering.numbered(df, ["k"], ["s"], run=run).collect()), key=str)
    want = [(k, s, 7, i) for k in ("a", None) for i, s in enumerate([None, -4, 3, 3, 5, 9], 1)]
    assert found == sorted(want, key=str)


def test_ranked_runs_are_even(spark):
    """However far apart the values lie."""
    df = spark.range(2000).select((F.col("id") * F.col("id") * 1000).alias("s"))
    sizes = [r.n for r in df.groupBy(ordering.ranked_run(df, "s", 200)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 11 and max(sizes) < 260
    times = df.select(F.timestamp_seconds("s").alias("k"), F.lit(0).alias("g"))
    assert ordering.numbered(times, ["g"], ["k"], run="ranked").agg(F.max("pos")).first()[0] == 2000


def test_zip_of_other_types_and_null_values(spark):
    a = side(spark, [("x", 1, None), ("x", 2, "a2")])
    b = KeyedInput(spark.createDataFrame([("x", 1, {"m": 1}), ("x", 4, {"m": 2})], "k string, s int, v map<string,int>"), F.col("k"), F.col("v"), F.col("s"))
    for run in (None, 2):
        assert sorted((r.pos, r.value_0, r.value_1["m"]) for r in match.zip_match([a, b], run=run).collect()) == [(1, None, 1), (2, "a2", 2)]


def test_lists_and_chunks(spark):
    rows = spark.range(10).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.col("id").alias("value"))
    assert [r["values"] for r in match.key_chunks(rows, 4, run=3).orderBy("batch").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    with pytest.raises(Exception, match="over 9 values"):
        match.key_lists(rows, most=9).collect()


def test_builder_orders_inputs(spark):
    from keyflow.plans.builder import match_key

    a, b = (spark.createDataFrame([("x", s, f"{n}{s}") for s in (1, 2, 3)], "k string, s int, v string") for n in "ab")
    both = match_key(a, F.col("k"), F.col("s"), F.col("v")).or_(b, F.col("k"), F.col("s"), F.col("v"))
    for found in (both, both.in_runs(), both.in_runs(2)):
        assert [r["values"] for r in found.for_each_list(3).orderBy("batch").collect()] == [["a1", "b1", "a2"], ["b2", "a3", "b3"]]
        assert found.for_each_chunk(4).orderBy("batch").collect()[1]["values"] == ["a3", "b3"]


def test_reduce_in_chunks(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("key"), F.col("id").alias("seq"), (F.col("id") * 7919 % 1000).alias("value"))
    least = lambda k, vs: sorted(vs)[:4]
    whole = sorted(map(tuple, reduce.reduce(rows, [least], T.LongType()).collect()))
    assert whole == sorted(map(tuple, reduce.reduce(rows, [least], T.LongType(), chunk=13, run=10).collect())) and len(whole) == 12
    assert reduce.reduce(rows, [least], T.LongType(), least=167, chunk=13).select("key").distinct().count() == 2


@pytest.mark.parametrize("mean", [0.0, 0.5, 3.0, 100.0, 1000.0])
def test_poisson_means(spark, mean):
    from keyflow.functions.hashing import fraction, poisson

    r = spark.range(20_000).select(poisson(mean, fraction(5, F.col("id"))).alias("n")).agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).first()
    assert abs(r.m - mean) <= 5 * (mean / 20_000) ** 0.5 and abs(r.v - mean) <= 0.06 * mean


def test_string_hash(spark):
    from keyflow.functions.hashing import string_hash

    def slow(text):
        raw, h = text.encode("utf-16-le"), 0
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "little")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["", "a", "hello world", "ÄÖ", "北京", "a😀b", "x" * 100]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", string_hash(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in found} == {t: slow(t) for t in texts}


def test_selective_reads_once(spark):
    df = spark.range(6).withColumn("v", F.when(F.col("id") < 5, F.col("id")))
    rules = [(F.col("v") == 1, F.lit(3)), (F.col("v") > 2, routing.all_parts(2))]
    found = routing.selective(df, rules, F.array(F.lit(7), F.lit(8)))
    assert sorted((r.id, r.part) for r in found.collect()) == [(0, 7), (0, 8), (1, 3), (2, 7), (2, 8), (3, 0), (3, 1), (4, 0), (4, 1), (5, 7), (5, 8)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_nested_merges_by_brute_force(spark):
    """Maps of maps of arrays, pair by pair as a tree would, over partitions that lack keys and positions."""
    rng = random.Random(4)
    state = lambda: {k: {j: [rng.randint(-3, 5) for _ in range(rng.randint(0, 3))] for j in rng.sample("pqr", rng.randint(0, 3))} for k in rng.sample("abc", rng.randint(0, 3))}
    states = [state() for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(states)), "part int, m map<string,map<string,array<int>>>")
    paths = {(k, j, i) for s in states for k, x in s.items() for j, xs in x.items() for i in range(len(xs))}
    at = lambda s, p: (s.get(p[0], {}).get(p[1], []) + [0] * 9)[p[2]]
    mean = lambda vs: merge.tree([(v, 1) for v in vs], lambda a, b: (int(a[0] * (a[1] / (a[1] + b[1])) + b[0] * (b[1] / (a[1] + b[1]))), a[1] + b[1]))[0]
    product = lambda vs: __import__("math").prod(vs)
    for op, f in (("add", sum), ("multiply", product), ("max", max), ("min", min), ("mean", mean)):
        found = merge.merged(df, "m", op, 5)
        assert found.columns == ["key", "key_2", "pos_3", "value"] and found.schema["value"].dataType == T.IntegerType()
        assert {(r.key, r.key_2, r.pos_3): r.value for r in found.collect()} == {p: f([at(s, p) for s in states]) for p in paths}


def test_boolean_arrays_and_lists(spark):
    df = spark.createDataFrame([(0, [True, False]), (1, [True, False, True])], "part int, b array<boolean>")
    assert [r.value for r in merge.arrays(df, "b", "add", 2).orderBy("pos").collect()] == [True, False, True]
    assert [r.value for r in merge.arrays(df, "b", "multiply", 2).orderBy("pos").collect()] == [True, False, False]
    maps = spark.createDataFrame([(1, {"k": ["c"]}), (0, {"k": ["a", "b"]})], "part int, m map<string,array<string>>")
    assert [r.value for r in merge.map_lists(maps, "m").orderBy("key", "seq").collect()] == ["a", "b", "c"]
    with pytest.raises(merge.UnsupportedMerge):
        merge.merged(df.select("part"), "part", "add", 2)


def test_copies_and_hooks(spark):
    begun = merge.copies(spark, 3, {"n": 5}, {"seen": 0}, lambda df: df.withColumn("own", F.col("part") * 2))
    assert sorted(map(tuple, begun.collect())) == [(0, 5, 0, 0), (1, 5, 0, 2), (2, 5, 0, 4)]
    one = stage.single(lambda df: df.agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n")))
    spread = stage.Stage(lambda df: df.agg(F.countDistinct("part").alias("parts")), "spread", key=F.col("id"), parts=4, restored=lambda df: df.where("id < 50"))
    assert tuple(one.plan(spark.range(9))["single"].first()) == (1, 9) and spread.plan(spark.range(100))["spread"].first()[0] == 4


def test_stages_have_their_own_names_and_results(spark, tmp_path):
    seen, runs = {}, spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: runs.add(1) or x, "long")
    first = stage.Stage(lambda df: df.where("id > 1").select(count("id").alias("id")), "first").with_handler(lambda df: seen.update(first=df.count()))
    first.connects(stage.Stage(lambda df: df.agg(F.sum("id").alias("n")), "sum")).with_handler(lambda df: seen.update(sum=df.first().n))
    first.connects(stage.Stage(lambda df: df.agg(F.max("id").alias("n")), "max"))
    found = first.sync(spark.range(5), str(tmp_path / "out"))
    assert seen == {"first": 3, "sum": 9} and found["max"].first().n == 4 and set(found) == {"sum", "max"} and runs.value == 3
    first.connects(stage.Stage(lambda df: df, "max"))
    with pytest.raises(ValueError, match="max"):
        first.sync(spark.range(5))


def test_replay_and_each_part(spark, tmp_path):
    from keyflow.sources.lines import replay

    spark.range(3).write.parquet(str(tmp_path / "saved"))
    assert replay(spark.range(10, 12), str(tmp_path / "saved")).count() == 5
    assert [r.part for r in routing.for_each_part(spark, 3).orderBy("part").collect()] == [0, 1, 2]


@pytest.mark.parametrize("newline", ["spark", "pairs"])
@pytest.mark.parametrize("alphabet", ["a\n", "a\r", "aé\n\r"])
def test_lines_by_bytes(spark, tmp_path, newline, alphabet):
    """LF-only, CR-only and mixed files, in ranges of a few bytes and by count; the session's settings stay."""
    from keyflow.sources.lines import ENDS

    draw, expected = random.Random(newline + alphabet), []
    for k in range(12):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 50))).encode()
        (tmp_path / f"{k}.txt").write_bytes(text)
        lines = re.split(ENDS[newline], text)
        expected += [x.decode() for x in (lines[:-1] if lines[-1] == b"" else lines)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for options in ({"split_bytes": 1}, {"split_bytes": 3}, {"split_bytes": 1 << 20}, {"split_count": 4}):
        assert sorted(r.line for r in read_lines(spark, str(tmp_path), newline, **options).collect()) == sorted(expected)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_settings_are_read(spark, tmp_path):
    from keyflow.plans.builder import configured, match_key
    from keyflow.sources.lines import read_configured

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "h1-3000").write_bytes(b"a\r\nb")
    config = FlowConfig(partitions=4, batch_run=2, newline="pairs", split_bytes=2)
    template = PathTemplate(str(tmp_path), "app", "h1", 3000)
    assert sorted(r.line for r in read_configured(spark, "logs/%h", config, template).collect()) == ["", "a", "b"]
    df = spark.createDataFrame([("x", s, f"v{s}") for s in range(5)], "k string, s int, v string")
    found = configured(match_key(df, F.col("k"), F.col("s"), F.col("v")), config).for_each_list(2).collect()
    assert len(found) == 2 and {0 <= r.part < 4 for r in found} == {True}


def test_streams_of_strings_and_completions(spark, tmp_path):
    from keyflow.streaming.stateful import completions, stream_batches

    df = spark.range(40).select(F.concat(F.lit("k"), F.col("id") % 2).alias("key"), F.col("id").alias("seq"), F.concat(F.lit("v"), "id").alias("value"))
    for k in range(2):
        df.where(F.expr(f"seq div 20 = {k}")).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_batches(source(), 3).writeStream.format("parquet").option("path", f"{tmp_path}/b").option("checkpointLocation", f"{tmp_path}/cb").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/b").select("key", "values").collect())) == sorted(map(str, match.key_batches(df, 3).select("key", "values").collect()))
    completions(source(), lambda b: b.groupBy("key").agg(F.count("*").alias("n")), f"{tmp_path}/c", f"{tmp_path}/cc").awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/c").select("key", "n", "completion").collect()
    assert sorted(map(tuple, found)) == [("k0", 10, 0), ("k0", 10, 1), ("k1", 10, 0), ("k1", 10, 1)]


def test_sessions_and_windows_equal_batch(spark, tmp_path):
    from keyflow.streaming.stateful import stream_fold, stream_sessions

    df = spark.createDataFrame([("a", t, 1.0) for t in (0, 5, 9, 100, 104, 500)] + [("b", 3, 2.0), ("b", 1000, 2.0)], "key string, t long, value double").select("key", F.timestamp_seconds("t").alias("ts"), "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stream_sessions(source, "ts", "10 seconds", "0 seconds").writeStream.format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.n) for r in spark.table("sessions").collect()} >= {("a", 3), ("a", 2), ("b", 1)}
    q = stream_fold(source, "ts", "1 hour", "60 seconds", F.sum("value").alias("total")).writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.total) for r in spark.table("windows").collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)]


def test_paths_and_config():
    t = PathTemplate("/base", "myapp", "h1", 3000, dt.datetime(2020, 7, 26, 23, 59, tzinfo=dt.timezone.utc))
    assert t.expand("%a/%h/x") == f"myapp-20-07-26-{86340000:07x}/h1-3000/x" and t.get("y") == "/base/y"
    c, rest = FlowConfig().with_properties({"keyflow.partitions": "1_000"}).with_arguments(["--absent", "skip", "file"])
    assert (c.partitions, c.absent, rest) == (1000, "skip", ["file"]) and c.changed() == {"partitions": 1000, "absent": "skip"}


def test_streams_equal_batch(spark, tmp_path):
    from keyflow.streaming.stateful import stream_batches, stream_zip

    df = spark.range(200).select((F.col("id") % 3).alias("key"), (F.col("id") % 2).cast("int").alias("kind"), F.col("id").alias("seq"), F.col("id").alias("value"))
    for k in range(4):
        df.where(F.expr(f"seq div 50 = {k}")).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    for name, make in (("z", lambda s: stream_zip(s, 2)), ("b", lambda s: stream_batches(s.select("key", "seq", "value"), 5))):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    zipped = match.zip_match([KeyedInput(df.where(f"kind = {k}"), F.col("key"), F.col("value"), F.col("seq")) for k in (0, 1)])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/z").collect())) == sorted((r.key, r.value_0, r.value_1) for r in zipped.collect())
    assert spark.read.parquet(f"{tmp_path}/b").count() == match.key_batches(df.select("key", "seq", "value"), 5).count()


def test_reduce_deals_by_ranges(spark):
    """No group of its own for each key or chunk, and keys of all kinds: null, NaN, beyond doubles; values with nulls."""
    import datetime as dt

    rows = spark.createDataFrame([(k, s, None if k == 2 and s == 3 else (1 << 60) + s) for k in (None, 1, 2, (1 << 60) + 1, (1 << 60) + 2) for s in range(40)], "key long, seq long, value long").repartition(3)
    last = lambda k, vs: [v for v in vs if v == v][-2:]
    want = sorted([(k, i, v) for k in (None, 1, (1 << 60) + 1, (1 << 60) + 2) for i, v in enumerate([(1 << 60) + 38, (1 << 60) + 39])], key=str)
    for chunk in (None, 1, 7, 40, 1000):
        found = reduce.reduce(rows, [last], T.LongType(), chunk=chunk)
        assert not {"FlatMapGroupsInPandas", "Window"} & set(found._jdf.queryExecution().toString().replace("(", " ").split())
        assert sorted((tuple(r) for r in found.collect() if r.key != 2), key=str) == want
        assert [r.idx for r in found.where("key = 2").orderBy("idx").collect()] == [0, 1]
    odd = spark.createDataFrame([(float("nan"), 1, dt.datetime(2024, 1, 1)), (float("nan"), 2, dt.datetime(2024, 1, 2)), (0.0, 1, dt.datetime(2024, 1, 3)), (-0.0, 2, None)], "key double, seq long, value timestamp")
    for chunk in (None, 1, 5):
        found = reduce.reduce(odd, [lambda k, vs: [max(v for v in vs if v is not None and v == v)] if any(v == v and v is not None for v in vs) else []], T.TimestampType(), chunk=chunk).collect()
        assert sorted(r.value.day for r in found) == [2, 3]
    sizes = reduce.reduce(rows, [lambda k, vs: [len(vs)]], T.LongType(), least=41)
    assert sizes.count() == 0 and reduce.reduce(rows.limit(0), [last], T.LongType(), chunk=3).count() == 0


def test_poisson_compares_without_lists(spark):
    """A usual mean has plain comparisons, no list that is filtered for each draw; the numbers are those of the list."""
    from keyflow.functions.hashing import fraction, poisson, steps_below
    from keyflow.operators import routing

    drawn = spark.range(3).select(poisson(3.0, fraction(5, F.col("id"))).alias("n"))
    assert "lambda" not in drawn._jdf.queryExecution().toString()
    for n, leaves in ((0, 4), (1, 4), (61, 64), (200, 4), (200, 64), (64, 64)):
        steps = sorted((7 * k % 23) / 23 for k in range(n))
        rows = spark.range(-2, 60).select((F.when(F.col("id") > -2, F.col("id")) / 46.0).alias("u"))
        for r in rows.select("u", steps_below(steps, F.col("u"), leaves).alias("n")).collect():
            assert r.n == sum(r.u is not None and s <= r.u for s in steps)
    for mean in (0.0, 2.0, 150.0, 400.0):
        whole = spark.range(300).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("part"))
        whole = whole.withColumn("times", poisson(mean, fraction(9, F.col("part"), F.col("id")))).where("times > 0")
        assert sorted(whole.collect()) == sorted(routing.to_poisson(spark.range(300), 3, mean, 9, F.col("id")).select("id", "part", "times").collect())
