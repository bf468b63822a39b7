import gzip
import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import Dataset, Session
from weftline.apps import workloads
from weftline.functions import compat
from weftline.plans.shapes import map_reduce, plan_of


@pytest.fixture(scope="module")
def w(spark):
    return Session(spark)


def test_fifteen_ints(w):
    g = w.from_seq(list(range(1, 16)), "value int").group_by("value % 5")
    assert {k: sorted(v) for k, v in g.collect().items()}[0] == [5, 10, 15]
    assert g.count() == 5
    assert sorted(g.keys().collect()) == [0, 1, 2, 3, 4]
    assert dict(tuple(r) for r in g.reduce_groups("sum").collect()) == {0: 30, 1: 18, 2: 21, 3: 24, 4: 27}
    assert dict(tuple(r) for r in g.reduce_groups(operator.add).collect()) == {0: 30, 1: 18, 2: 21, 3: 24, 4: 27}
    bang = g.map_values(F.concat(F.expr("cast(value as string)"), F.lit("!")).alias("s")).collect()
    assert sorted(bang[1]) == ["1!", "11!", "6!"]
    bang = g.map_values(lambda v: f"{v}!", schema="s string").collect()
    assert sorted(bang[1]) == ["1!", "11!", "6!"]


def test_reduce_and_characters(w):
    assert w.from_seq(range(1, 1001)).repartition(2).reduce("sum").collect() == [500500]
    assert w.from_seq(range(1, 1001)).repartition(5).reduce(operator.add).collect() == [500500]
    words = w.from_seq("hello world this is my simple dataset of strings".split(), "value string")
    chars = words.repartition(3).flat_map(list, schema="value string").filter(lambda c: c != "s")
    assert chars.count() == 34
    assert words.flat_map(F.split("value", "")).filter("value != 's'").count() == 34


def test_empty_and_limits(w):
    none = w.from_seq(range(1, 5)).filter("value > 9")
    assert none.reduce("sum").collect() == [] == none.reduce(operator.add).collect()
    assert none.group_by("value").collect() == {} and none.group_by("value").count() == 0
    some = w.from_seq(range(1, 9)).repartition(4)
    assert some.filter("value = 3").reduce(operator.add).collect() == [3]
    assert some.collect(-1) == [] and len(some.collect(3)) == 3 and some.first_n(-2, "value").collect() == []
    assert len(some.group_by("value % 3").collect(limit=2)) == 2
    assert len(some.group_by("value % 3").collect(limit=9)) == 3


def test_first_n(w):
    some = w.from_seq(range(1, 100)).repartition(5)
    assert some.largest_n(3, "value").collect() == [99, 98, 97]
    assert some.smallest_n(2, "value").collect() == [1, 2]
    assert some.first_n(3, lambda a, b: a > b).collect() == [99, 98, 97]
    assert "TakeOrderedAndProject" in plan_of(some.largest_n(3, "value").df)


def test_groups_opaque(w):
    g = w.from_seq(range(1, 11)).group_by(lambda v: v % 3, schema="k int")
    assert sorted(map(tuple, g.map_groups(lambda k, vs: (k, sum(vs)), schema="k int, s long").collect())) == [(0, 18), (1, 22), (2, 15)]
    assert sorted(g.flat_map_groups(lambda k, vs: [k] * (len(list(vs)) - 2), schema="value int").collect()) == [0, 1, 1, 2]
    assert g.count() == 3
    with pytest.raises(ValueError):
        w.from_seq(range(3)).map(lambda v: v)
    out = map_reduce(w.from_seq(["a b a"], "value string"), str.split, lambda x: x, lambda k, vs: (k, len(list(vs))), schema="k string, n int", key_schema="k string", mapped_schema="value string")
    assert sorted(map(tuple, out.collect())) == [("a", 2), ("b", 1)]


def test_null_keys_group_together(w):
    g = w.from_seq([(None, 1), (None, 2), ("a", 3)], "k string, v int").group_by("k")
    assert g.count() == 2
    assert dict(tuple(r) for r in g.reduce_groups("sum", "v").collect()) == {None: 3, "a": 3}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), max_size=30), st.integers(1, 8))
def test_lanes_agree(w, data, parts):
    ds = w.from_seq(data, "value long").repartition(parts)
    assert sorted(ds.map(F.expr("value * 2")).collect()) == sorted(ds.map(lambda v: v * 2, schema="value long").collect()) == sorted(v * 2 for v in data)
    assert sorted(ds.filter("value > 0").collect()) == sorted(ds.filter(lambda v: v > 0).collect())
    assert ds.reduce("max").collect() == ds.reduce(max).collect() == ([max(data)] if data else [])
    assert ds.largest_n(4, "value").collect() == ds.first_n(4, lambda a, b: a > b).collect() == sorted(data, reverse=True)[:4]
    by = lambda g: dict(tuple(r) for r in g.collect())
    assert by(ds.group_by("value % 7").reduce_groups("sum")) == by(ds.group_by("value % 7").reduce_groups(operator.add))


def test_plans(w, spark):
    df = w.table("/root/testdata/sf0.001", "lineitem").group_by("l_returnflag").reduce_groups("sum", "l_linenumber").df
    plan = plan_of(df)
    assert plan.count("HashAggregate") == 2 and "Python" not in plan and "Arrow" not in plan
    scan = plan_of(w.table("/root/testdata/sf0.001", "events").filter("value > 50").map("event_id").df)
    assert "GreaterThan(value,50" in scan and "ReadSchema: struct<event_id:bigint,value:double>" in scan


def test_text_files(w, tmp_path):
    body = "one two\r\nthree\rfour\n\n five"
    want = sorted(["one two", "three", "four", "", " five"])
    zipped = gzip.compress(body.encode())
    for name, content in {"a.txt": body.encode(), "a.gz": zipped, "a.csv.gzip": zipped, "hidden.txt": zipped, "plain.gz": body.encode()}.items():
        (tmp_path / name).write_bytes(content)
        assert sorted(w.local_text_file(str(tmp_path / name)).collect()) == want, name
        assert sorted(w.url_text_file(f"file://{tmp_path}/{name}").collect()) == want, name
    for name in ("empty.txt", "empty.gz"):
        (tmp_path / name).write_bytes(b"")
        assert w.local_text_file(str(tmp_path / name)).collect() == []
        assert w.url_text_file(f"file://{tmp_path}/{name}").collect() == []
    both = [str(tmp_path / "a.txt"), str(tmp_path / "hidden.txt")]
    assert w.multiple_local_text_files(both).count() == 10
    assert w.url_text_files([f"file://{p}" for p in both]).count() == 10
    assert w.multiple_local_text_files([]).count() == 0 == w.url_text_files([]).count()
    with pytest.raises(FileNotFoundError):
        w.local_text_file(str(tmp_path / "nothing"))
    with pytest.raises(OSError):
        w.url_text_file(f"file://{tmp_path}/nothing")


def test_java_strings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    split = lambda s: one(compat.java_split(F.lit(s), ","))
    assert [split(s) for s in ("a,b,,", ",,", "", "a", ",a")] == [["a", "b"], [], [""], ["a"], ["", "a"]]
    assert one(compat.java_trim(F.lit("\t a b \n\x01"))) == "a b"
    assert [one(compat.bucket(F.lit(v), 50)) for v in (-70, 70, 49)] == [-50, 50, 0]
    assert one(compat.option_int(F.lit("x"))) is None and one(compat.option_int(F.lit("99999999999"))) is None
    assert one(compat.strict_int(F.lit("-12"))) == -12
    with pytest.raises(Exception, match="not an integer"):
        one(compat.strict_int(F.lit(" 5 ")))
    assert str(one(compat.option_date(F.lit("5/7/2021")))) == "2021-05-07" and one(compat.option_date(F.lit("13/45/2021"))) is None


def test_apps(w):
    good = "05/07/2021,TX,10,5,,3,,,,,,,05/07/2021 01:02:03 PM,Agree,Not agree"
    lines = [good, good.replace("TX", "CA"), "date,state", good.replace(",10,", ",ten,"), good.replace("05/07/2021,TX", "99/99/2021,TX"), good.removesuffix("Not agree"), good]
    ds = w.from_seq(lines, "value string")
    assert dict(tuple(r) for r in workloads.covid_by_state(ds).collect()) == {"TX": 6, "CA": 3}
    pixels = w.from_seq(['t,u1,#fff,"10,70"', 't,u1,#fff,"60,70"', 't,u2,#fff,"10,20"', "a,b,c,d", "1,2,3,4,5,6,7", ""], "value string")
    rows = workloads.pixel_rows(pixels)
    assert [tuple(r) for r in workloads.top_users(rows).collect()] == [("u1", 2), ("u2", 1)]
    assert sorted(tuple(r) for r in workloads.squares(rows).collect()) == [(0, 0, 1), (0, 50, 1), (50, 50, 1)]
    people = w.from_seq(["A,B,30,May,1990,Austin,Texas", "", "C,D,31,June,1991,Reno,Nevada"], "value string")
    assert [r["first"] for r in workloads.persons_of(people).collect()] == ["A"]


def test_streaming_same_transforms(w, spark, tmp_path):
    from weftline.streaming import stream_parquet

    spark.range(10).write.parquet(str(tmp_path / "in"))
    ds = stream_parquet(spark, str(tmp_path / "in"), spark.range(1).schema).group_by("id % 2").agg(F.count(F.lit(1)).alias("n"))
    q = ds.df.writeStream.outputMode("complete").format("memory").queryName("halves").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.sql("select n from halves").collect()] == [5, 5]
    assert isinstance(ds, Dataset)


def test_names_that_helpers_might_use(w):
    rows = [(1, 2, 3, 4), (1, 5, 6, 7), (2, 8, 9, 10)]
    ds = w.from_seq(rows, "_k0 int, _rows int, _rn int, values int")
    assert sorted(map(tuple, ds.group_by("_k0").reduce_groups("sum", "_rows").collect())) == [(1, 7), (2, 8)]
    assert sorted(map(tuple, ds.group_by("_rn").reduce_groups(lambda a, b: a).collect())) == [(r[2], *r) for r in rows]
    assert ds.reduce("sum", "_rows", name="_rows").collect() == [15]
    assert sorted(r["_rn"] for r in ds.group_by("_k0").top_n_per_group(1, "_rn").collect()) == [3, 9]
    assert sorted(map(tuple, ds.group_by("_k0").map_values("_rows", "_k0").agg(F.sum("_rows").alias("_k1")).collect())) == [(1, 7), (2, 8)]
    assert sorted(len(v) for v in ds.group_by("_k0").collect().values()) == [1, 2]


def test_groups_stream_and_odd_keys_fold(w):
    nan = float("nan")
    ds = w.from_seq([(nan, 1), (nan, 2), (None, 3), (0.5, 4), (None, 5)], "k double, v int").repartition(3)
    found = ds.group_by("k").reduce_groups(lambda a, b: (max(a[0], b[0]) if a[0] is not None else None, a[1] + b[1]))
    assert sorted(r["v"] for r in found.collect()) == [3, 4, 8]
    # a function that does not read all of its group's rows
    first = w.from_seq(range(100)).group_by("value % 4").map_groups(lambda k, rows: (k, next(rows) % 4), schema="k long, m long")
    assert sorted(map(tuple, first.collect())) == [(k, k) for k in range(4)]


def test_shared_folder(spark):
    from types import SimpleNamespace

    from weftline.shared import forget, shared_path

    path = shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    forget(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    nothing = SimpleNamespace(get=lambda k, d=None: d)
    bare = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_path(bare, "x")


def test_words_with_control_characters(w):
    ds = w.from_seq(["\x01Ab ab\x02 c\x03d \x04 ... ΑΣ", "AB  ", ""], "value string")
    assert [tuple(r) for r in workloads.word_frequency(ds).collect()] == [("ab", 3), ("...", 1), ("c\x03d", 1), ("ας", 1)]
    assert sorted(map(tuple, workloads.word_lengths(ds).collect())) == [(2, 4)]  # what is not ASCII is no word character
