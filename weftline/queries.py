"""A query for each operator, over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.apps import workloads
from weftline.functions import compat
from weftline.operators.dataset import Dataset
from weftline.plans.shapes import map_reduce
from weftline.session import Session
from weftline.shared import shared_path


def _t(spark: SparkSession, d: str, name: str) -> Dataset:
    return Session(spark).table(d, name)


def _files(s: SparkSession, d: str, codec: str, lines: DataFrame) -> tuple[str, list[str]]:
    """lines as text files in the shared folder; the folder and the files."""
    out = shared_path(s, "lines")
    lines.write.option("compression", codec).text(out)
    return out, sorted(r.path for r in s.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("path").collect())


def _renamed(s: SparkSession, paths: list[str], name: Callable[[str], str]) -> list[str]:
    out = []
    for p in paths:
        old, new = s._jvm.org.apache.hadoop.fs.Path(p), s._jvm.org.apache.hadoop.fs.Path(name(p))
        old.getFileSystem(s._jsc.hadoopConfiguration()).rename(old, new)
        out.append(name(p))
    return out


def _halves(s, d):
    """documents.text by the parity of the id."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return [docs.filter(F.col("doc_id") % 2 == half).select("text") for half in (0, 1)]


def src_text_files(s, d):
    """documents.text through files of either sort, read back as lines."""
    paths = [p for codec, half in zip(("none", "gzip"), _halves(s, d), strict=True) for p in _files(s, d, codec, half)[1]]
    return Session(s).multiple_local_text_files(paths).map(F.col("value").alias("line")).df


def src_misnamed_gzip(s, d):
    """The same with names that are wrong: gzip as .txt, plain text as .gz."""
    plain, zipped = (_files(s, d, codec, half)[1] for codec, half in zip(("none", "gzip"), _halves(s, d), strict=True))
    paths = _renamed(s, plain, lambda p: f"{p}.gz") + _renamed(s, zipped, lambda p: p.removesuffix(".gz"))
    return Session(s).multiple_local_text_files(paths).map(F.col("value").alias("line")).df


def src_local_file(s, d):
    """The nations' names through one file."""
    return Session(s).local_text_file(_files(s, d, "none", s.read.parquet(f"{d}/nation.parquet").select("n_name").coalesce(1))[1][0]).map(F.col("value").alias("line")).df


def _url(path: str) -> str:
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def src_url_file(s, d):
    return Session(s).url_text_file(_url(_files(s, d, "gzip", s.read.parquet(f"{d}/nation.parquet").select("n_name").coalesce(1))[1][0])).map(F.col("value").alias("line")).df


def src_url_files(s, d):
    """documents.text through URLs of files of either sort."""
    paths = [p for codec, half in zip(("none", "gzip"), _halves(s, d), strict=True) for p in _files(s, d, codec, half)[1]]
    return Session(s).url_text_files([_url(p) for p in paths]).map(F.col("value").alias("line")).df


def src_text_lines(s, d):
    return _t(s, d, "documents").flat_map(F.split("text", "\n", -1), name="line").df


def map_expr(s, d):
    return _t(s, d, "lineitem").map("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).df


def flat_map_words(s, d):
    return _t(s, d, "documents").flat_map(compat.words("text"), name="word").df


def filter_rows(s, d):
    return _t(s, d, "events").filter("event_type = 'purchase' AND value > 50").map("event_id", "user_id", "value").df


def group_collect(s, d):
    named = _t(s, d, "nation").group_by("n_regionkey").map_groups(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
    return named.df


def grouped_count(s, d):
    """The action's number as a one-row frame, without running it here."""
    return _t(s, d, "events").group_by("user_id").keys().df.agg(F.count(F.lit(1)).alias("n"))


def count_rows(s, d):
    return _t(s, d, "lineitem").df.agg(F.count(F.lit(1)).alias("n"))


def map_reduce_shape(s, d):
    return map_reduce(_t(s, d, "documents"), compat.words("text"), F.substring("value", 1, 1).alias("initial"), F.count(F.lit(1)).alias("n")).df


# the opaque lane: Python functions with a schema


def fn_map(s, d):
    orders = _t(s, d, "orders").map("o_orderkey", "o_orderpriority")
    return orders.map(lambda r: (r.o_orderkey, int(r.o_orderpriority[0]), r.o_orderpriority[2:].title()), schema="o_orderkey long, level int, label string").df


def fn_flat_map(s, d):
    """The characters of names."""
    return _t(s, d, "customer").map("c_name").flat_map(list, schema="letter string").df


def fn_filter(s, d):
    return _t(s, d, "events").map("event_id", "event_type", "value").filter(lambda r: r.event_type == "purchase" and r.value > 50).df


def fn_reduce(s, d):
    return _t(s, d, "lineitem").map(F.col("l_linenumber").cast("long").alias("total")).reduce(lambda a, b: a + b).df


def fn_first_n(s, d):
    """By a strict less-than."""
    orders = _t(s, d, "orders").map("o_orderkey", "o_totalprice")
    return orders.first_n(30, lambda a, b: (-a.o_totalprice, a.o_orderkey) < (-b.o_totalprice, b.o_orderkey)).df


def _by_parity(s, d):
    return _t(s, d, "events").map("event_id", "user_id").group_by(lambda r: r.user_id % 7, schema="k long")


def fn_group_by(s, d):
    """A key function, and a function of each group's rows."""
    return _by_parity(s, d).map_groups(lambda k, rows: (k, sum(1 for _ in rows)), schema="k long, n long").df


def fn_map_values(s, d):
    grouped = _by_parity(s, d).map_values(lambda r: r.event_id % 10, schema="v long")
    return grouped.reduce_groups(lambda a, b: a + b).map(F.col("k"), F.col("v").alias("total")).df


def fn_reduce_groups(s, d):
    grouped = _t(s, d, "lineitem").map("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber")).group_by("l_returnflag").map_values("l_linenumber")
    return grouped.reduce_groups(lambda a, b: a + b).map("l_returnflag", F.col("l_linenumber").alias("total")).df


def flat_map_groups(s, d):
    """Each user's event ids that are even, and how many rows the user has."""

    def each(user, rows):
        n, even = 0, []
        for r in rows:
            n += 1
            if r.event_id % 2 == 0:
                even.append(r.event_id)
        return [(user, e, n) for e in even]

    return _t(s, d, "events").map("user_id", "event_id").group_by("user_id").flat_map_groups(each, schema="user_id long, event_id long, n long").df


# actions: their values as frames


def act_collect(s, d):
    rows = _t(s, d, "orders").map("o_orderkey", "o_totalprice").first_n(50, F.desc("o_totalprice"), F.asc("o_orderkey")).collect(20)
    return s.createDataFrame(rows, "o_orderkey long, o_totalprice double")


def act_count(s, d):
    return s.createDataFrame([(_t(s, d, "lineitem").count(),)], "n long")


def act_grouped_collect(s, d):
    """The whole map; and one of two groups, of which the size is told."""
    names = _t(s, d, "nation").group_by("n_regionkey").map_values("n_name")
    found, some = names.collect(), names.collect(2)
    return s.createDataFrame([(k, ",".join(sorted(v)), len(some)) for k, v in found.items()], "n_regionkey int, names string, some long")


def act_grouped_count(s, d):
    return s.createDataFrame([(_t(s, d, "events").group_by("user_id").count(),)], "n long")


# parse or drop: lines made of tables, some of them broken


def app_covid(s, d):
    """A line for each order; those of which the number is divisible by 7 have a bad count, by 11 a blank last field."""
    bad = "case when o_orderkey % 7 = 0 then 'many' else cast(o_orderkey % 1000 as string) end"
    last = "case when o_orderkey % 11 = 0 then '' else 'Agree' end"
    line = F.expr(f"concat_ws(',', date_format(o_orderdate, 'MM/dd/yyyy'), o_orderstatus, '10', '5', '', {bad}, '', '', '', '', '', '', date_format(o_orderdate, 'MM/dd/yyyy hh:mm:ss a'), 'Agree', {last})")
    return workloads.covid_by_state(_t(s, d, "orders").map(line.alias("value"))).df


def app_pixels(s, d):
    """A line for each line item; of return flag R with a field too few. Then the squares."""
    line = F.expr("""concat_ws(',', 't', l_suppkey, case when l_returnflag = 'R' then null else '#fff' end, concat('"', l_partkey), concat(l_orderkey, '"'))""")
    return workloads.squares(workloads.pixel_rows(_t(s, d, "lineitem").map(line.alias("value")))).df


def app_persons(s, d):
    """A line for each customer, blank for one in ten; every third is of Texas."""
    line = F.expr("case when c_custkey % 10 = 0 then '' else concat_ws(',', c_name, c_mktsegment, c_custkey % 90, 'May', 1990 + c_custkey % 10, 'Austin', case when c_custkey % 3 = 0 then 'Texas' else 'Nevada' end) end")
    return workloads.persons_of(_t(s, d, "customer").map(line.alias("value"))).df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src_from_seq": lambda s, d: Session(s).from_seq(range(1, 16), "value int").map(F.col("value").alias("v")).df,
    "src_text_lines": src_text_lines,
    "src_text_files": src_text_files,
    "src_misnamed_gzip": src_misnamed_gzip,
    "src_local_file": src_local_file,
    "src_url_file": src_url_file,
    "src_url_files": src_url_files,
    "map_expr": map_expr,
    "flat_map_words": flat_map_words,
    "filter": filter_rows,
    "repartition": lambda s, d: _t(s, d, "orders").map("o_orderkey").repartition(2).df,
    "reduce_sum": lambda s, d: _t(s, d, "lineitem").reduce("sum", "l_linenumber", name="total").df,
    "reduce_max": lambda s, d: _t(s, d, "events").reduce("max", "value", name="most").df,
    "first_n": lambda s, d: _t(s, d, "orders").map("o_orderkey", "o_totalprice").first_n(50, F.desc("o_totalprice"), F.asc("o_orderkey")).df,
    "largest_n": lambda s, d: _t(s, d, "orders").map("o_orderkey", "o_totalprice").largest_n(20, "o_totalprice", "o_orderkey").df,
    "first_n_by_asc": lambda s, d: _t(s, d, "customer").map("c_custkey", "c_acctbal").smallest_n(10, "c_acctbal", "c_custkey").df,
    "keys": lambda s, d: _t(s, d, "lineitem").group_by("l_returnflag").keys().df,
    "grouped_count": grouped_count,
    "group_collect": group_collect,
    "map_values_reduce": lambda s, d: _t(s, d, "events").group_by("event_type").map_values(F.lit(1).alias("one")).reduce_groups("sum", "one", name="n").df,
    "reduce_groups_sum": lambda s, d: _t(s, d, "lineitem").group_by("l_returnflag").reduce_groups("sum", "l_linenumber", name="total").df,
    "map_groups_count": lambda s, d: _t(s, d, "documents").group_by(F.expr("doc_id % 5").alias("k")).map_groups(F.count(F.lit(1)).alias("n")).df,
    "flat_map_groups_top2": lambda s, d: _t(s, d, "events").map("user_id", "event_id", "value").group_by("user_id").top_n_per_group(2, F.desc("value"), F.asc("event_id")).df,
    "count": count_rows,
    "map_reduce": map_reduce_shape,
    "app_word_freq_top100": lambda s, d: workloads.word_frequency(_t(s, d, "documents"), "text").df,
    "app_word_length": lambda s, d: workloads.word_lengths(_t(s, d, "documents"), "text").df,
    "app_top_users": lambda s, d: workloads.top_users(_t(s, d, "events"), "user_id").df,
    "app_subsquares": lambda s, d: workloads.squares(_t(s, d, "lineitem"), "l_partkey", "l_suppkey").df,
    "app_covid": app_covid,
    "app_pixels": app_pixels,
    "app_persons": app_persons,
    "fn_map": fn_map,
    "fn_flat_map": fn_flat_map,
    "fn_filter": fn_filter,
    "fn_reduce": fn_reduce,
    "fn_first_n": fn_first_n,
    "fn_group_by": fn_group_by,
    "fn_map_values": fn_map_values,
    "fn_reduce_groups": fn_reduce_groups,
    "flat_map_groups": flat_map_groups,
    "act_collect": act_collect,
    "act_count": act_count,
    "act_grouped_collect": act_grouped_collect,
    "act_grouped_count": act_grouped_count,
}

_WORDS = r"(select unnest(regexp_split_to_array(text, '[\s\x0B]+')) as word from documents)"

ORACLE_SQL: dict[str, str] = {
    "src_from_seq": "select cast(unnest(range(1, 16)) as integer) as v",
    "src_text_lines": "select unnest(string_split(text, chr(10))) as line from documents",
    "src_text_files": "select unnest(string_split(text, chr(10))) as line from documents",
    "src_misnamed_gzip": "select unnest(string_split(text, chr(10))) as line from documents",
    "src_local_file": "select n_name as line from nation",
    "src_url_file": "select n_name as line from nation",
    "src_url_files": "select unnest(string_split(text, chr(10))) as line from documents",
    "map_expr": "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem",
    "flat_map_words": f"select word from {_WORDS} where word <> ''",
    "filter": "select event_id, user_id, value from events where event_type = 'purchase' and value > 50",
    "repartition": "select o_orderkey from orders",
    "reduce_sum": "select cast(sum(l_linenumber) as bigint) as total from lineitem",
    "reduce_max": "select max(value) as most from events",
    "first_n": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50",
    "largest_n": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 20",
    "first_n_by_asc": "select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 10",
    "keys": "select distinct l_returnflag from lineitem",
    "grouped_count": "select count(distinct user_id) as n from events",
    "group_collect": "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey",
    "map_values_reduce": "select event_type, count(*) as n from events group by event_type",
    "reduce_groups_sum": "select l_returnflag, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_returnflag",
    "map_groups_count": "select doc_id % 5 as k, count(*) as n from documents group by 1",
    "flat_map_groups_top2": "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn <= 2",
    "count": "select count(*) as n from lineitem",
    "map_reduce": f"select substr(word, 1, 1) as initial, count(*) as n from {_WORDS} where word <> '' group by 1",
    "app_word_freq_top100": rf"select lower(regexp_replace(word, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) as word, count(*) as n from {_WORDS} where regexp_matches(word, '[^\x00-\x20]') group by 1 order by n desc, word limit 100",
    "app_word_length": rf"select cast(length(regexp_replace(word, '\W', '', 'g')) as integer) as len, count(*) as n from {_WORDS} where regexp_matches(word, '\w') group by 1",
    "app_top_users": "select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 50",
    "app_subsquares": "select l_partkey // 50 * 50 as x, l_suppkey // 50 * 50 as y, count(*) as n from lineitem group by 1, 2",
    "app_covid": "select o_orderstatus as state, cast(sum(o_orderkey % 1000) as bigint) as newCases from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 group by 1",
    "app_pixels": "select cast(l_partkey // 50 * 50 as integer) as x, cast(l_orderkey // 50 * 50 as integer) as y, count(*) as n from lineitem where l_returnflag <> 'R' group by 1, 2",
    "app_persons": """
        select c_name as first, c_mktsegment as last, cast(c_custkey % 90 as integer) as age, 'May' as month, cast(1990 + c_custkey % 10 as integer) as year, 'Austin' as city, 'Texas' as stateOrProvince
        from customer where c_custkey % 10 <> 0 and c_custkey % 3 = 0""",
    "fn_map": "select o_orderkey, cast(left(o_orderpriority, 1) as integer) as level, array_to_string(list_transform(string_split(substr(o_orderpriority, 3), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') as label from orders",
    "fn_flat_map": "select unnest(regexp_extract_all(c_name, '(?s).')) as letter from customer",
    "fn_filter": "select event_id, event_type, value from events where event_type = 'purchase' and value > 50",
    "fn_reduce": "select cast(sum(l_linenumber) as bigint) as total from lineitem",
    "fn_first_n": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 30",
    "fn_group_by": "select user_id % 7 as k, count(*) as n from events group by 1",
    "fn_map_values": "select user_id % 7 as k, cast(sum(event_id % 10) as bigint) as total from events group by 1",
    "fn_reduce_groups": "select l_returnflag, cast(sum(l_linenumber) as bigint) as total from lineitem group by 1",
    "flat_map_groups": "select user_id, event_id, n from (select user_id, event_id, count(*) over (partition by user_id) as n from events) where event_id % 2 = 0",
    "act_collect": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "act_count": "select count(*) as n from lineitem",
    "act_grouped_collect": "select n_regionkey, string_agg(n_name, ',' order by n_name) as names, cast(2 as bigint) as some from nation group by 1",
    "act_grouped_count": "select count(distinct user_id) as n from events",
}
