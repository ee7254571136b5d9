"""One query for each operator over the test tables, and its DuckDB equivalent."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.hashing import folded_part, string_hash
from .functions.stats import key_stats, merged_trees, split_point
from .operators import match, merge, reduce, routing, stage
from .operators.match import KeyedInput
from .operators.ordering import numbered
from .plans.builder import by_hash, match_key
from .sources.lines import read_table, split_lines
from .sources.shared import shared_dir

PARTS, RUN = 8, 4096
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def events(spark, sf_dir, *kinds: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events")
    return df.where(F.col("event_type").isin(*kinds)) if kinds else df


def of_kind(spark, sf_dir, *kinds: str) -> KeyedInput:
    return KeyedInput(events(spark, sf_dir, *kinds), F.col("user_id"), F.col("event_id"), F.col("event_id"))


def user_rows(spark, sf_dir, value: str = "value") -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col(value).alias("value"))


def folded_sql(key: str, parts: int = PARTS) -> str:
    """The folded partition of a key in [0, 2**31)."""
    width, shifts = parts.bit_length() - 1, []
    for s in range(width, 32, width):
        shifts.append(s)
    x = key
    for s in shifts:
        x = f"xor({x}, {key} >> {s})"
    return f"CAST(abs(({x}) % {parts}) AS INTEGER)"


def folded_signed_sql(key: str, parts: int = PARTS) -> str:
    """The folded partition of an unsigned 32-bit number, which is signed in the end."""
    width, x = parts.bit_length() - 1, key
    for s in range(width, 32, width):
        x = f"xor({x}, {key} >> {s})"
    return f"CAST(abs((CASE WHEN {x} >= 2147483648 THEN {x} - 4294967296 ELSE {x} END) % {parts}) AS INTEGER)"


S = "s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)"
P = folded_sql("user_id")

# -- matching ------------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'large' ELSE 'any' END AS branch, count(*) AS n FROM events GROUP BY 1")
def match_any(spark, sf_dir):
    rows = match.typed_match(events(spark, sf_dir), [("error", F.col("event_type") == "error"), ("large", F.col("value") > 50)], "any")
    return rows.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'big_purchase' END AS branch FROM events WHERE event_type = 'error' OR (event_type = 'purchase' AND value > 20)")
def typed_match(spark, sf_dir):
    rows = match.typed_match(events(spark, sf_dir), [("error", F.col("event_type") == "error"), ("big_purchase", (F.col("event_type") == "purchase") & (F.col("value") > 20))])
    return match.handled(rows).select("event_id", "branch")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def unhandled(spark, sf_dir):
    rows = match.typed_match(events(spark, sf_dir), [("view", F.col("event_type") == "view"), ("click", F.col("event_type") == "click")])
    return match.unhandled(rows).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS key, event_id AS seq, value FROM events WHERE user_id IS NOT NULL")
def key_each(spark, sf_dir):
    return match.key_each(KeyedInput(events(spark, sf_dir), F.col("user_id"), F.col("value"), F.col("event_id")))


@query(f"WITH {S} SELECT a.user_id AS key, CAST(a.rn AS INTEGER) AS pos, a.event_id AS value_0, b.event_id AS value_1 FROM s a JOIN s b ON a.user_id = b.user_id AND a.rn = b.rn AND b.event_type = 'click' WHERE a.event_type = 'view'")
def zip2(spark, sf_dir):
    return match.zip_match([of_kind(spark, sf_dir, "view"), of_kind(spark, sf_dir, "click")], run=RUN)


@query(f"WITH {S} SELECT a.user_id AS key, CAST(a.rn AS INTEGER) AS pos, a.event_id AS value_0, b.event_id AS value_1, c.event_id AS value_2 FROM s a JOIN s b ON a.user_id = b.user_id AND a.rn = b.rn AND b.event_type = 'click' JOIN s c ON a.user_id = c.user_id AND a.rn = c.rn AND c.event_type = 'purchase' WHERE a.event_type = 'view'")
def zip3(spark, sf_dir):
    return match.zip_match([of_kind(spark, sf_dir, k) for k in ("view", "click", "purchase")], run=RUN)


@query(f"WITH {S} SELECT a.user_id AS key, CAST(a.rn AS INTEGER) AS pos, a.event_id AS value_0, b.event_id AS value_1, c.event_id AS value_2, d.event_id AS value_3 FROM s a JOIN s b ON a.user_id = b.user_id AND a.rn = b.rn AND b.event_type = 'click' JOIN s c ON a.user_id = c.user_id AND a.rn = c.rn AND c.event_type = 'purchase' JOIN s d ON a.user_id = d.user_id AND a.rn = d.rn AND d.event_type = 'error' WHERE a.event_type = 'view'")
def zip4(spark, sf_dir):
    return match.zip_match([of_kind(spark, sf_dir, k) for k in ("view", "click", "purchase", "error")], run=RUN)


@query("WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders), e AS (SELECT user_id AS k, event_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT o.k AS key, CAST(o.rn AS INTEGER) AS pos, o.v AS value_0, e.v AS value_1 FROM o JOIN e ON o.k = e.k AND o.rn = e.rn")
def zip2_tables(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return match_key(orders, F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey")).or_(events(spark, sf_dir), F.col("user_id"), F.col("event_id"), F.col("event_id")).in_runs(RUN).for_each_tuple()


@query("WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY 1) SELECT user_id AS key, CAST(0 AS INTEGER) AS kind, a - least(a, b) AS leftover FROM c WHERE a > least(a, b) UNION ALL SELECT user_id, CAST(1 AS INTEGER), b - least(a, b) FROM c WHERE b > least(a, b)")
def zip_leftover(spark, sf_dir):
    return match.zip_leftover([of_kind(spark, sf_dir, "view"), of_kind(spark, sf_dir, "click")])


UNION = "u AS (SELECT o_custkey AS key, CAST(0 AS INTEGER) AS kind, o_orderkey AS seq, o_totalprice AS value FROM orders UNION ALL SELECT user_id, CAST(1 AS INTEGER), event_id, value FROM events)"


def union_rows(spark, sf_dir) -> DataFrame:
    orders = KeyedInput(read_table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderkey"))
    return match.key_union([orders, KeyedInput(events(spark, sf_dir), F.col("user_id"), F.col("value"), F.col("event_id"))])


@query(f"WITH {UNION} SELECT key, kind, count(*) AS n, round(sum(value), 2) AS total FROM u GROUP BY key, kind")
def key_union(spark, sf_dir):
    return union_rows(spark, sf_dir).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("WITH b AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS b FROM events) SELECT user_id AS key, b AS batch, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM b GROUP BY 1, 2 HAVING count(*) = 5")
def batch5(spark, sf_dir):
    found = match.key_batches(user_rows(spark, sf_dir, "event_id"), 5, run=RUN)
    return found.select("key", F.col("batch").cast("long").alias("batch"), F.array_join("values", ",").alias("ids"))


@query(f"WITH {UNION}, b AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY seq * 2 + kind) - 1) // 4 AS b, seq FROM u) SELECT key, b AS batch, CAST(sum(seq) AS BIGINT) AS total FROM b GROUP BY 1, 2 HAVING count(*) = 4")
def batch_union(spark, sf_dir):
    rows = union_rows(spark, sf_dir).select("key", (F.col("seq") * 2 + F.col("kind")).alias("seq"), F.col("seq").alias("value"))
    found = match.key_batches(rows, 4, run=RUN)
    return found.select("key", F.col("batch").cast("long").alias("batch"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT user_id AS key, count(*) % 5 AS tail FROM events GROUP BY 1 HAVING count(*) % 5 > 0")
def batch_tail(spark, sf_dir):
    rows = match.key_batches(user_rows(spark, sf_dir, "event_id"), 5, run=RUN, tails=True)
    return rows.where(F.size("values") < 5).select("key", F.size("values").cast("long").alias("tail"))


CHUNK = 1000
CH = f"ch AS (SELECT user_id AS key, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // {CHUNK} AS batch, * FROM events)"


@query(f"WITH {CH} SELECT key, batch, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM ch GROUP BY 1, 2")
def key_list(spark, sf_dir):
    """A key's list in order, in rows of bounded size."""
    found = match.key_chunks(user_rows(spark, sf_dir, "event_type"), CHUNK, run=RUN)
    return found.select("key", F.col("batch").cast("long").alias("batch"), F.array_join("values", ",").alias("kinds"))


FIVE = "f AS (SELECT user_id AS key, list_position(['view', 'click', 'purchase', 'error', 'signup'], event_type) - 1 AS kind, event_id FROM events), n AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY event_id) - 1) // 6 AS batch FROM f)"


@query(f"WITH {FIVE} SELECT key, batch, string_agg(kind || ':' || event_id, ',' ORDER BY event_id) AS items FROM n GROUP BY 1, 2 HAVING count(*) = 6")
def five_inputs(spark, sf_dir):
    """Five inputs have no tuples; their union goes on as batches that say where each value is from."""
    rows = match.key_union([of_kind(spark, sf_dir, k) for k in ("view", "click", "purchase", "error", "signup")])
    found = match.key_batches(rows.withColumn("value", F.concat_ws(":", "kind", "value")), 6, run=RUN, order=("seq", "kind"))
    return found.select("key", F.col("batch").cast("long").alias("batch"), F.array_join("values", ",").alias("items"))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'any' END AS branch, user_id AS sender, count(*) AS n FROM events GROUP BY 1, 2")
def match_sender(spark, sf_dir):
    rows = match.with_sender(events(spark, sf_dir), F.col("user_id"))
    return match.typed_match(rows, [("even", F.col("sender") % 2 == 0)], "any").groupBy("branch", "sender").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT user_id AS key, event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS side FROM events WHERE event_type IN ('view', 'click')) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY side, event_id) AS INTEGER) AS pos, event_id AS value FROM a")
def tree_merge(spark, sf_dir):
    view, click = (match.key_each(of_kind(spark, sf_dir, k)) for k in ("view", "click"))
    return merged_trees(view, click, run=RUN)


# -- reductions ----------------------------------------------------------------------------------------------------


@query("SELECT user_id AS key, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1")
def fold_sum(spark, sf_dir):
    return reduce.fold(user_rows(spark, sf_dir), F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS key, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def fold_minmax(spark, sf_dir):
    return reduce.fold(user_rows(spark, sf_dir), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"WITH {CH} SELECT key, batch, string_agg(left(event_type, 1), '' ORDER BY event_id) AS value FROM ch GROUP BY 1, 2")
def fold_concat(spark, sf_dir):
    """A key's letters end to end, in rows of bounded size."""
    found = match.key_chunks(user_rows(spark, sf_dir, "event_type").withColumn("value", F.substring("value", 1, 1)), CHUNK, run=RUN)
    return found.select("key", F.col("batch").cast("long").alias("batch"), F.array_join("values", "").alias("value"))


@query("SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS INTEGER) AS idx, event_id AS value FROM events QUALIFY idx < 5")
def reduce_python(spark, sf_dir):
    """A Python reduction of lists to lists, in chunks and then of their results: a key's five latest."""
    return reduce.reduce(user_rows(spark, sf_dir, "event_id"), [lambda key, values: sorted(values, reverse=True)[:5]], T.LongType(), chunk=CHUNK, run=RUN)


@query("SELECT user_id AS key, CAST(rn AS INTEGER) AS idx, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def reduce_top3(spark, sf_dir):
    return reduce.top(user_rows(spark, sf_dir), 3, F.desc("value"), F.col("seq"))


@query("SELECT user_id AS key, CAST(0 AS INTEGER) AS idx, CAST(sum(event_id) AS BIGINT) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def reduce_chain(spark, sf_dir):
    """Rows are filtered and summed in parts before the shuffle: no task holds a key's values."""
    sums = reduce.fold(user_rows(spark, sf_dir, "event_id").where("value % 3 = 0"), F.sum("value").alias("value"))
    return sums.select("key", F.lit(0).alias("idx"), "value")


@query("SELECT user_id AS key, arg_min(event_type, event_id) AS value FROM events GROUP BY 1")
def fold_first_only(spark, sf_dir):
    return reduce.first_only(user_rows(spark, sf_dir, "event_type"))


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 65")
def eventually_min(spark, sf_dir):
    return reduce.fold(user_rows(spark, sf_dir), F.count(F.lit(1)).alias("n"), least=65)


@query(f"SELECT part, key, CAST(row_number() OVER (PARTITION BY part ORDER BY key) AS INTEGER) AS rank FROM (SELECT DISTINCT {P} AS part, user_id AS key FROM events)")
def ordered_emit(spark, sf_dir):
    return reduce.ordered_emit(user_rows(spark, sf_dir), folded_part(F.col("key"), PARTS))


@query("SELECT arg_min(substr(p_name, 1, 1), p_partkey) AS key, count(*) AS n FROM part GROUP BY lower(substr(p_name, 1, 1))")
def custom_comparator(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").select(F.substring("p_name", 1, 1).alias("key"), F.col("p_partkey").alias("seq"))
    return reduce.canonical(rows, F.lower("key"), F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY event_id) > INTERVAL 300 SECOND THEN 1 ELSE 0 END AS nw FROM events), g AS (SELECT *, sum(nw) OVER (ORDER BY event_id) AS gap FROM e) SELECT CAST(gap AS BIGINT) AS gap, event_type AS key, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY 1, 2")
def partial_debounce(spark, sf_dir):
    rows = events(spark, sf_dir).select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("key"), "value")
    return reduce.debounced(rows, "ts", 300).groupBy("gap", "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


# -- routing -------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, {P} AS part FROM events")
def route_hash(spark, sf_dir):
    return routing.to_hash(events(spark, sf_dir), F.col("user_id"), PARTS, exact=True).select("event_id", "part")


@query(f"SELECT CAST(p AS INTEGER) AS part, count(*) AS n FROM events, range({PARTS}) AS r(p) GROUP BY 1")
def route_all(spark, sf_dir):
    return routing.to_all(events(spark, sf_dir), PARTS).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {folded_sql('user_id')} AS part, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2 UNION ALL SELECT CAST(p AS INTEGER), event_type, count(*) FROM events, range({PARTS}) AS r(p) WHERE event_type = 'error' GROUP BY 1, 2")
def route_selective(spark, sf_dir):
    hashed = routing.hash_part(F.col("user_id"), PARTS, exact=True)
    rows = routing.selective(events(spark, sf_dir), [(F.col("event_type") == "view", hashed), (F.col("event_type") == "error", routing.all_parts(PARTS))], hashed)
    return rows.groupBy("part", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _near(rows: DataFrame, n, mean: float, variance: float, spark, sf_dir) -> DataFrame:
    """part, near: whether each partition's number is within six standard deviations of what the distribution says."""
    total = events(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    found = stage.one_row(rows.groupBy("part").agg(n.alias("n")), total)
    return found.select("part", (F.abs(F.col("n") - F.col("total") * mean) <= 6 * F.sqrt(F.col("total") * variance)).alias("near"))


NEAR = f"SELECT CAST(p AS INTEGER) AS part, true AS near FROM range({PARTS}) AS r(p)"


@query(NEAR)
def route_random(spark, sf_dir):
    rows = routing.to_random_one(events(spark, sf_dir), PARTS, 1, F.col("event_id"))
    return _near(rows, F.count(F.lit(1)), 1 / PARTS, (1 - 1 / PARTS) / PARTS, spark, sf_dir)


@query(NEAR)
def route_bagging(spark, sf_dir):
    rows = routing.to_bagged(events(spark, sf_dir), PARTS, 1, F.col("event_id"))
    return _near(rows, F.count(F.lit(1)), 1 - math.exp(-1), math.exp(-1) * (1 - math.exp(-1)), spark, sf_dir)


@query(NEAR)
def route_poisson(spark, sf_dir):
    rows = routing.to_poisson(events(spark, sf_dir), PARTS, 3.0, 1, F.col("event_id"))
    return _near(rows, F.sum("times"), 3.0, 3.0, spark, sf_dir)


def _string_hash_sql(text: str) -> str:
    signed = f"list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)"
    return f"(CASE WHEN {signed} >= 2147483648 THEN {signed} - 4294967296 ELSE {signed} END)"


@query(f"WITH h AS (SELECT event_id, event_type || event_id AS t FROM events), k AS (SELECT event_id, {_string_hash_sql('t')} & 4294967295 AS h FROM h) SELECT event_id, {folded_signed_sql('h')} AS part FROM k")
def route_hash_string(spark, sf_dir):
    key = string_hash(F.concat("event_type", F.col("event_id").cast("string")))
    return events(spark, sf_dir).select("event_id", folded_part(key.bitwiseAND(0xFFFFFFFF), PARTS).alias("part"))


@query(f"SELECT CAST(p AS INTEGER) AS part, p * 10 AS start FROM range({PARTS}) AS r(p)")
def route_each_part(spark, sf_dir):
    return routing.for_each_part(spark, PARTS, (F.col("id") * 10).alias("start"))


@query("SELECT event_id, CAST(p AS INTEGER) AS part FROM (SELECT event_id, unnest([event_id % 4, event_id % 4 + 4]) AS p FROM events)")
def route_custom(spark, sf_dir):
    low = (F.col("event_id") % 4).cast("int")
    return routing.custom(events(spark, sf_dir), F.array(low, (low + 4).cast("int"))).select("event_id", "part")


# -- state merges --------------------------------------------------------------------------------------------------


def routed(spark, sf_dir) -> DataFrame:
    return routing.to_hash(events(spark, sf_dir), F.col("user_id"), PARTS, exact=True)


def by_type(spark, sf_dir, aggregate) -> DataFrame:
    """part, state: a map of a value by event type."""
    rows = routed(spark, sf_dir).groupBy("part", "event_type").agg(aggregate.alias("v"))
    return rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("state"))


def scalars(spark, sf_dir) -> DataFrame:
    return routed(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.bool_or(F.col("value") > 99).alias("any"), F.bool_and(F.col("value") > 0).alias("all"), F.max("event_type").alias("last"), F.countDistinct("user_id").alias("users"))


ST = f"r AS (SELECT *, {P} AS part FROM events), st AS (SELECT part, count(*) AS n, sum(value) AS v, bool_or(value > 99) AS \"any\", bool_and(value > 0) AS \"all\", max(event_type) AS last, count(DISTINCT user_id) AS users FROM r GROUP BY part)"


@query(f"WITH {ST} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(v), 2) AS v, bool_or(\"any\") AS \"any\" FROM st")
def merge_add_scalar(spark, sf_dir):
    st = scalars(spark, sf_dir)
    return st.agg(merge.scalar("add", "n", T.LongType()).alias("n"), F.round(merge.scalar("add", "v", T.DoubleType()), 2).alias("v"), merge.scalar("add", "any", T.BooleanType()).alias("any"))


@query(f"WITH {ST} SELECT CAST(product(users % 7 + 1) AS BIGINT) AS p, bool_and(\"all\") AS \"all\" FROM st")
def merge_mul_scalar(spark, sf_dir):
    st = scalars(spark, sf_dir).withColumn("u", (F.col("users") % 7 + 1))
    return st.agg(merge.scalar("multiply", "u", T.LongType()).alias("p"), merge.scalar("multiply", "all", T.BooleanType()).alias("all"))


@query(f"WITH {ST} SELECT round(avg(coalesce(v, 0)), 4) AS v FROM range({PARTS}) AS g(p) LEFT JOIN st ON st.part = g.p")
def merge_mean_double(spark, sf_dir):
    st = merge.every_part(scalars(spark, sf_dir).select("part", "v"), PARTS, v=0.0)
    return st.agg(F.round(merge.scalar("mean", "v", T.DoubleType()), 4).alias("v"))


def tree_mean_sql(values: list[str]) -> str:
    """The mean of whole numbers that aren't negative, cut at each node of the merge tree."""
    return merge.tree([(v, 1) for v in values], lambda a, b: (f"floor({a[0]} * {a[1] / (a[1] + b[1])!r} + {b[0]} * {b[1] / (a[1] + b[1])!r})", a[1] + b[1]))[0]


@query(f"WITH {ST} SELECT CAST({tree_mean_sql([f'coalesce(max(n) FILTER (part = {p}), 0)' for p in range(PARTS)])} AS BIGINT) AS value FROM st")
def merge_mean_int(spark, sf_dir):
    return merge.whole_mean(merge.every_part(scalars(spark, sf_dir).select("part", "n"), PARTS, n=0), "n")


@query(f"WITH r AS (SELECT {P} AS part, hour(ts) AS pos, count(*) * 7 AS n FROM events GROUP BY 1, 2) SELECT CAST(pos AS INTEGER) AS pos, CAST({tree_mean_sql([f'coalesce(max(n) FILTER (part = {p}), 0)' for p in range(PARTS)])} AS BIGINT) AS value FROM r GROUP BY pos")
def merge_mean_int_array(spark, sf_dir):
    return merge.arrays(hourly(spark, sf_dir, F.count(F.lit(1)) * 7, F.lit(0).cast("long")), "state", "mean", PARTS)


def hourly(spark, sf_dir, aggregate, empty) -> DataFrame:
    """part, state: an array of a value for each hour of the day."""
    rows = routed(spark, sf_dir).groupBy("part", F.hour("ts").alias("pos")).agg(aggregate.alias("v"))
    found = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return found.select("part", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.col("m")[h], empty)).alias("state"))


HR = f"hr AS (SELECT {P} AS part, hour(ts) AS pos, bool_or(value > 90) AS b FROM events GROUP BY 1, 2), hg AS (SELECT p AS part, h AS pos, coalesce(b, false) AS b FROM (SELECT DISTINCT {P} AS p FROM events) CROSS JOIN range(24) AS t(h) LEFT JOIN hr ON hr.part = p AND hr.pos = h)"


@query(f"WITH {HR} SELECT CAST(pos AS INTEGER) AS pos, bool_or(b) AS value FROM hg GROUP BY pos")
def merge_or_array(spark, sf_dir):
    return merge.arrays(hourly(spark, sf_dir, F.bool_or(F.col("value") > 90), F.lit(False)), "state", "add", PARTS)


@query(f"WITH {HR} SELECT CAST(pos AS INTEGER) AS pos, bool_and(b) AND count(*) = {PARTS} AS value FROM hg GROUP BY pos")
def merge_and_array(spark, sf_dir):
    return merge.arrays(hourly(spark, sf_dir, F.bool_or(F.col("value") > 90), F.lit(False)), "state", "multiply", PARTS)


@query(f"WITH r AS (SELECT event_type AS key, {P} AS part, hour(ts) AS pos, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT key, CAST(pos AS INTEGER) AS pos_2, CAST(sum(n) AS BIGINT) AS value FROM r GROUP BY 1, 2")
def merge_map_of_arrays(spark, sf_dir):
    """Maps of arrays, added by key and position."""
    rows = routed(spark, sf_dir).groupBy("part", "event_type", F.hour("ts").alias("pos")).agg(F.count(F.lit(1)).alias("v"))
    rows = rows.groupBy("part", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    rows = rows.select("part", "event_type", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.col("m")[h], F.lit(0))).alias("v"))
    states = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("state"))
    return merge.maps(states, "state", "add", PARTS).where("value > 0")


@query(f"WITH r AS (SELECT event_type AS key, {P} AS part, hour(ts) AS key_2, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT key, CAST(key_2 AS INTEGER) AS key_2, greatest(max(n), CASE WHEN count(*) < {PARTS} THEN 0 END) AS high FROM r GROUP BY 1, 2")
def merge_map_of_maps(spark, sf_dir):
    """Maps of maps: the greatest by both keys."""
    rows = routed(spark, sf_dir).groupBy("part", "event_type", F.hour("ts").alias("pos")).agg(F.count(F.lit(1)).alias("v"))
    rows = rows.groupBy("part", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("v"))
    states = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("state"))
    return merge.maps(states, "state", "max", PARTS).select("key", "key_2", F.col("value").alias("high"))


@query(f"WITH {ST} SELECT CAST(product(users % 5 + 2) AS BIGINT) AS p FROM st")
def merge_mul_long(spark, sf_dir):
    """Whole numbers' product is a whole number."""
    st = scalars(spark, sf_dir).withColumn("u", F.col("users") % 5 + 2)
    return st.agg(merge.scalar("multiply", "u", T.LongType()).alias("p"))


@query(f"WITH {ST} SELECT CAST(10 * {PARTS} + sum(n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS seen FROM st")
def state_copies(spark, sf_dir):
    """Copies begin with the original's `total`; `seen` is merged only."""
    begun = merge.copies(spark, PARTS, {"total": 10}, {"seen": 0})
    st = begun.join(scalars(spark, sf_dir).select("part", "n"), "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    st = st.select((F.col("total") + F.col("n")).alias("total"), (F.col("seen") + F.col("n")).alias("seen"))
    return st.agg(merge.scalar("add", "total", T.LongType()).alias("total"), merge.scalar("add", "seen", T.LongType()).alias("seen"))


@query(f"WITH {ST} SELECT max(n) AS high, min(n) AS low, max(last) AS last, min(last) AS first FROM st")
def merge_max_min_scalar(spark, sf_dir):
    st = scalars(spark, sf_dir)
    return st.agg(merge.scalar("max", "n", T.LongType()).alias("high"), merge.scalar("min", "n", T.LongType()).alias("low"), merge.scalar("max", "last", T.StringType()).alias("last"), merge.scalar("min", "last", T.StringType()).alias("first"))


@query(f"WITH {ST} SELECT arg_min(n, part) AS n FROM st WHERE n IS NOT NULL")
def merge_none(spark, sf_dir):
    return scalars(spark, sf_dir).agg(merge.scalar("none", "n", T.LongType()).alias("n"))


@query(f"WITH {ST} SELECT CAST(count(*) AS BIGINT) AS merged_count, string_agg(part, ',' ORDER BY part) AS parts FROM st")
def merge_count(spark, sf_dir):
    return merge.merge_count(scalars(spark, sf_dir)).select("merged_count", F.array_join("merged_parts", ",").alias("parts"))


@query(f"WITH {ST} SELECT CAST(sum(n * n) AS BIGINT) AS squares, max(n) AS high FROM st")
def merge_custom(spark, sf_dir):
    st = scalars(spark, sf_dir).select("part", (F.col("n") * F.col("n")).alias("squares"), F.col("n").alias("high"))
    return merge.custom(st, ["squares", "high"], lambda a, b: {"squares": a["squares"] + b["squares"], "high": max(a["high"], b["high"])}, "squares long, high long")


def array_states(spark, sf_dir) -> DataFrame:
    """part, state: sums of the embeddings' entries by position."""
    e = routing.to_hash(read_table(spark, sf_dir, "embeddings"), F.col("vec_id"), PARTS, exact=True)
    sums = e.select("part", F.posexplode("embedding").alias("pos", "x")).groupBy("part", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return sums.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("state"))


AR = f"a AS (SELECT {folded_sql('vec_id')} AS part, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), sm AS (SELECT part, pos, sum(CAST(x AS DOUBLE)) AS x FROM a GROUP BY 1, 2), gr AS (SELECT p AS part, q.pos, x FROM range({PARTS}) AS g(p) CROSS JOIN (SELECT DISTINCT pos FROM sm) q LEFT JOIN sm ON sm.part = p AND sm.pos = q.pos)"


def _array(op: str, digits: int = 4):
    def run(spark, sf_dir):
        return merge.arrays(array_states(spark, sf_dir), "state", op, PARTS).select("pos", (F.round("value", digits) + 0.0).alias("value"))

    return run


for _op, _sql in (("add", "sum(coalesce(x, 0))"), ("mul", "product(coalesce(x, 0))"), ("mean", "avg(coalesce(x, 0))"), ("max", "max(coalesce(x, 0))"), ("min", "min(coalesce(x, 0))")):
    QUERIES[f"merge_{_op}_array"] = _array({"mul": "multiply"}.get(_op, _op))
    ORACLES[f"merge_{_op}_array"] = f"WITH {AR} SELECT CAST(pos AS INTEGER) AS pos, round({_sql}, 4) + 0.0 AS value FROM gr GROUP BY pos"


MP = f"r AS (SELECT *, {P} AS part FROM events), m AS (SELECT part, event_type AS key, count(*) % 9 + 1 AS n FROM r GROUP BY 1, 2), mk AS (SELECT DISTINCT key FROM m), mg AS (SELECT p AS part, mk.key, n FROM range({PARTS}) AS g(p) CROSS JOIN mk LEFT JOIN m ON m.part = p AND m.key = mk.key)"


def _map(op: str):
    def run(spark, sf_dir):
        rows = routed(spark, sf_dir).groupBy("part", "event_type").agg((F.count(F.lit(1)) % 9 + 1).alias("v"))
        states = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("state"))
        return merge.maps(states, "state", op, PARTS).select("key", F.col("value").cast("double").alias("value"))

    return run


MEAN = tree_mean_sql([f"coalesce(max(n) FILTER (part = {p}), 0)" for p in range(PARTS)])
for _op, _sql in (("add", "sum(coalesce(n, 0))"), ("mul", "product(coalesce(n, 0))"), ("mean", MEAN), ("max", "max(coalesce(n, 0))"), ("min", "min(coalesce(n, 0))")):
    QUERIES[f"merge_{_op}_map"] = _map({"mul": "multiply"}.get(_op, _op))
    ORACLES[f"merge_{_op}_map"] = f"WITH {MP} SELECT key, CAST({_sql} AS DOUBLE) AS value FROM mg GROUP BY key"


@query(f"WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY {P}, event_id) - 1) // {CHUNK} AS batch, {P} AS part FROM events) SELECT batch, string_agg(event_id, ',' ORDER BY part, event_id) AS ids FROM r GROUP BY 1")
def merge_add_list(spark, sf_dir):
    """Lists end to end, in the order of partitions, in rows of bounded size."""
    rows = routed(spark, sf_dir).select("part", F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    placed = numbered(rows, ["part"], ["seq"], run=RUN).join(F.broadcast(before), "part").withColumn("batch", F.expr(f"(before + pos - 1) div {CHUNK}"))
    lists = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "value"))).alias("x"))
    return lists.select("batch", F.array_join(F.transform("x", lambda e: e["value"]), ",").alias("ids"))


@query("SELECT DISTINCT user_id AS value FROM events")
def merge_add_set(spark, sf_dir):
    states = routed(spark, sf_dir).groupBy("part").agg(F.collect_set("user_id").alias("state"))
    return merge.sets(states, "state")


@query(f"WITH r AS (SELECT event_type AS key, event_id, {P} AS part FROM events), n AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY part, event_id) - 1) // {CHUNK} AS batch FROM r) SELECT key, batch, string_agg(event_id, ',' ORDER BY part, event_id) AS ids FROM n GROUP BY 1, 2")
def merge_add_map_of_lists(spark, sf_dir):
    """Maps of lists: a key's lists end to end, in the order of partitions, in rows of bounded size."""
    rows = routed(spark, sf_dir).select(F.col("event_type").alias("key"), "part", F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    found = match.key_chunks(rows.withColumn("at", F.col("part").cast("long") * (1 << 40) + F.col("seq")), CHUNK, run=RUN, order=("at",))
    return found.select("key", F.col("batch").cast("long").alias("batch"), F.array_join("values", ",").alias("ids"))


@query("WITH v AS (SELECT unnest(['a b', 'b c']) AS m, unnest([0, 1]) AS part) SELECT unnest(string_split(m, ' ')) AS value FROM v")
def merge_lists_small(spark, sf_dir):
    states = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"])], "part int, state array<string>")
    return merge.lists(states, "state").select("value")


# -- stages --------------------------------------------------------------------------------------------------------


@query(f"WITH {ST} SELECT part, n, round(v, 2) AS v FROM st")
def collect_states(spark, sf_dir):
    return stage.collect_states(routed(spark, sf_dir), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))


@query("SELECT count(*) AS n, max(value) AS high FROM events")
def merged_state(spark, sf_dir):
    return stage.merged_state(routed(spark, sf_dir), F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))


def _half(name: str, src: str) -> str:
    return f"{name} AS (SELECT part, x / 2 + (SELECT avg(x) FROM {src}) / 2 AS x FROM {src})"


@query(f"WITH {ST}, s0 AS (SELECT part, CAST(n AS DOUBLE) AS x FROM st), {_half('s1', 's0')}, {_half('s2', 's1')}, {_half('s3', 's2')} SELECT part, round(x, 4) AS x FROM s3")
def share_state(spark, sf_dir):
    states = scalars(spark, sf_dir).select("part", F.col("n").cast("double").alias("x"))
    step = lambda s, m: stage.one_row(s, m).select("part", (F.col("x") / 2 + F.col("m") / 2).alias("x"))
    return stage.share_state(states, lambda s: s.agg(F.avg("x").alias("m")), step, 3).select("part", F.round("x", 4).alias("x"))


@query("WITH c AS (SELECT vec_id AS k, embedding AS e FROM embeddings WHERE vec_id < 10), d AS (SELECT v.vec_id, c.k, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: abs(CAST(v.embedding[i] AS DOUBLE) - CAST(c.e[i] AS DOUBLE)))) / len(v.embedding) AS dist FROM embeddings v, c), a AS (SELECT vec_id, arg_min(k, (dist, k)) AS k FROM d GROUP BY vec_id), x AS (SELECT a.k, pos - 1 AS pos, avg(CAST(v.embedding[pos] AS DOUBLE)) AS m FROM a JOIN embeddings v USING (vec_id), range(1, 65) AS g(pos) WHERE pos <= len(v.embedding) GROUP BY 1, 2) SELECT k, CAST(pos AS INTEGER) AS pos, round(m, 4) + 0.0 AS m FROM x")
def kmeans_step(spark, sf_dir):
    """One step of k-means by mean absolute distance: the 10 centroids, not the rows, are broadcast."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    centroids = e.where("vec_id < 10").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("k"), F.col("e").alias("c")))).alias("cs"))
    total = lambda c: F.aggregate(F.zip_with("e", c["c"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("e")
    nearest = F.array_min(F.transform("cs", lambda c: F.struct(total(c).alias("dist"), c["k"].alias("k"))))
    near = e.crossJoin(F.broadcast(centroids)).select(nearest["k"].alias("k"), "e")
    return near.select("k", F.posexplode("e").alias("pos", "x")).groupBy("k", "pos").agg((F.round(F.avg("x"), 4) + 0.0).alias("m"))


@query("SELECT CAST(pos - 1 AS INTEGER) AS pos, round(sum(CAST(embedding[pos] AS DOUBLE)), 4) AS total FROM embeddings, range(1, 65) AS g(pos) GROUP BY pos")
def vec_sum(spark, sf_dir):
    items = read_table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return items.groupBy("pos").agg(F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query("SELECT event_type AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS ratio FROM events GROUP BY 1")
def dist(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return stage.one_row(counts, total).select("key", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


@query("SELECT o_orderpriority AS key, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def pipeline2(spark, sf_dir):
    def project(items: DataFrame) -> DataFrame:
        items = items.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("key"))
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("key", "value")

    first = stage.Stage(project, "project")
    first.connects(stage.Stage(lambda df: reduce.fold(df, F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("revenue")), "fold"))
    return first.plan(read_table(spark, sf_dir, "lineitem"))["fold"]


@query("SELECT 'count' AS what, CAST(count(*) AS DOUBLE) AS x FROM events WHERE value > 10 UNION ALL SELECT 'sum', round(sum(value), 2) FROM events WHERE value > 10 UNION ALL SELECT 'kinds', count(DISTINCT event_type) FROM events WHERE value > 10")
def stage_fan_out(spark, sf_dir):
    """One stage with three followers: its result is computed once and written."""
    first = stage.Stage(lambda df: df.where("value > 10"), "filter", key=F.col("user_id"), parts=PARTS)
    for name, aggregate in (("count", F.count(F.lit(1)).cast("double")), ("sum", F.round(F.sum("value"), 2)), ("kinds", F.countDistinct("event_type").cast("double"))):
        first.connects(stage.Stage(lambda df, a=aggregate, n=name: df.agg(a.alias("x")).select(F.lit(n).alias("what"), "x"), name))
    found = first.sync(events(spark, sf_dir))
    return found["count"].unionByName(found["sum"]).unionByName(found["kinds"])


@query(f"WITH {ST} SELECT CAST(sum(n) AS BIGINT) AS n, max(n) AS high FROM st")
def merged_by(spark, sf_dir):
    """The merged state by a function of two states."""
    states = scalars(spark, sf_dir).select("part", "n", F.col("n").alias("high"))
    return stage.merged_by(states, lambda a, b: {"n": a["n"] + b["n"], "high": max(a["high"], b["high"])}, "n long, high long")


@query(r"WITH l AS (SELECT unnest(regexp_split_to_array('x' || coalesce(text, ''), '\n\r|\n|\r')) AS line FROM documents) SELECT CAST(length(line) % 16 AS INTEGER) AS bucket, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS letters FROM l GROUP BY 1")
def line_files(spark, sf_dir):
    """Files of lines, read in ranges of 64 KiB by the pairs dialect in a stage that starts from their path."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    read_table(spark, sf_dir, "documents").select(F.concat(F.lit("x"), F.coalesce("text", F.lit(""))).alias("value")).write.text(path)
    first = stage.Stage(lambda df: df.groupBy((F.length("line") % 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("letters")), "lengths")
    return first.start_reading(spark, path, newline="pairs", split_bytes=1 << 16)["lengths"]


@query(r"SELECT word AS key, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\W+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(spark, sf_dir):
    words = read_table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\W+")).alias("key")).where("key <> ''")
    return reduce.fold(words, F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, CAST(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\n\r|\n|\r') AS l FROM documents) WHERE len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END > 0")
def line_dialect(spark, sf_dir):
    return split_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH k AS (SELECT {P} AS part, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT part, CAST(sum(n) AS BIGINT) AS value_size, count(*) AS leaf_size, max(n) AS largest FROM k GROUP BY part")
def hist_stats(spark, sf_dir):
    return key_stats(routed(spark, sf_dir).select("part", F.col("user_id").alias("key")))


@query("WITH c AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1), m AS (SELECT key, sum(n) OVER (ORDER BY key) AS cum, (SELECT sum(n) FROM c) // 2 AS half FROM c), e AS (SELECT max(CASE WHEN cum < half THEN key END) AS l, min(CASE WHEN cum >= half THEN key END) AS r FROM m) SELECT CAST(CASE WHEN l IS NULL THEN r ELSE greatest(1, (r - l) // 2) + l END AS BIGINT) AS split FROM e")
def split_key(spark, sf_dir):
    return split_point(user_rows(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n")))


@query("WITH o AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders), e AS (SELECT user_id AS k, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT n_name AS key, count(*) AS n, round(sum(o.v + e.v), 2) AS total FROM o JOIN e ON o.k = e.k AND o.rn = e.rn JOIN customer ON c_custkey = o.k JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def lineage_sales(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    pairs = match_key(orders, F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice")).or_(events(spark, sf_dir), F.col("user_id"), F.col("event_id"), F.col("value")).in_runs(RUN).for_each_tuple()
    who = read_table(spark, sf_dir, "customer").join(F.broadcast(read_table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = pairs.join(who, pairs["key"] == F.col("c_custkey")).select(F.col("n_name").alias("key"), (F.col("value_0") + F.col("value_1")).alias("v"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query(f"SELECT user_id AS key, round(sum(value), 2) AS total, {P} AS part FROM events GROUP BY user_id")
def fold_dispatched(spark, sf_dir):
    return match_key(events(spark, sf_dir), F.col("user_id"), F.col("event_id"), F.col("value")).dispatch(by_hash(PARTS, exact=True)).fold(F.round(F.sum("value"), 2).alias("total"))
