"""Queries over the driver's tables, one or more an operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from arborframe.functions.translate import behave, slice_
from arborframe.operators import links
from arborframe.operators.frame import NestedFrame
from arborframe.sources.readers import group_by_prefix, nest, with_position

ITEM = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_items(spark, sf_dir, fields=ITEM, keep=("o_orderkey",)) -> NestedFrame:
    return nest(table(spark, sf_dir, "orders").select(*keep), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", list(fields))


def turns(spark, sf_dir) -> NestedFrame:
    rows = table(spark, sf_dir, "conversations")
    return NestedFrame(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))


def exploded(frame: NestedFrame, *keys: str, name: str = "items") -> DataFrame:
    return frame.df.select(*keys, F.inline(name))


def _items(n: str) -> list[str]:
    return ["l_linenumber", "l_partkey", "l_suppkey", *n.split()]


QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_quantity > 25")
def filter_nested(spark, d):
    return exploded(order_items(spark, d, _items("l_quantity")).filter("l_quantity > 25", at="items"), "o_orderkey")


@query("select o_orderkey, cast(count(l_quantity) as int) as n from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 25 group by o_orderkey")
def filter_keeps_empty(spark, d):
    return order_items(spark, d, _items("l_quantity")).filter(lambda x: x.l_quantity > 25, at="items").df.select("o_orderkey", F.size("items").alias("n"))


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem")
def define_nested(spark, d):
    out = order_items(spark, d, _items("l_extendedprice l_discount")).define("revenue", "l_extendedprice * (1 - l_discount)", at="items")
    return exploded(out, "o_orderkey").withColumn("revenue", F.round("revenue", 4))


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when l_linenumber % 2 <> 0 then l_quantity + 10 end as q from lineitem")
def define_nullable(spark, d):
    return exploded(order_items(spark, d, _items("l_quantity")).define("q", lambda x: x.l_quantity + 10 if x.l_linenumber % 2 != 0 else None, at="items"), "o_orderkey")


@query("""select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cast(row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as int) as i from lineitem""")
def index(spark, d):
    return exploded(order_items(spark, d, _items("l_quantity")).index("i", at="items"), "o_orderkey")


@query("select o_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey as up_custkey, o_orderstatus as up_status from lineitem join orders on l_orderkey = o_orderkey")
def parent(spark, d):
    out = order_items(spark, d, _items(""), ("o_orderkey", "o_custkey", "o_orderstatus")).parent("up", at="items")
    return exploded(out, "o_orderkey").select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("up.o_custkey").alias("up_custkey"), F.col("up.o_orderstatus").alias("up_status"))


@query("select o_custkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem join orders on l_orderkey = o_orderkey")
def flatten(spark, d):
    orders = order_items(spark, d, _items("l_quantity"), ("o_orderkey", "o_custkey")).df
    customers = NestedFrame(orders.groupBy("o_custkey").agg(F.collect_list("items").alias("items")))
    return exploded(customers.flatten("items"), "o_custkey")


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity not between 10 and 20 then l_quantity end as l_quantity from lineitem")
def tomask_range(spark, d):
    return exploded(order_items(spark, d, _items("l_quantity")).tomask("items/l_quantity", 10.0, 20.0), "o_orderkey")


@query("select event_id, case when event_id % 10 = 0 then null else value end as value from events")
def tomask_nan(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return NestedFrame(rows).tomask("value", float("nan")).df


@query("select p_partkey, nullif(p_size, 8) as p_size from part")
def tomask_eq(spark, d):
    return NestedFrame(table(spark, d, "part").select("p_partkey", "p_size")).tomask("p_size", 8).df


@query("select l_partkey as f0, l_quantity + 1 as f1 from lineitem where l_linenumber % 2 <> 0")
def map_dropnone(spark, d):
    return order_items(spark, d, ["l_linenumber", "l_partkey", "l_quantity"]).map(lambda x: (x.l_partkey, x.l_quantity + 1) if x.l_linenumber % 2 != 0 else None, at="items")


@query("select l_linenumber as number, l_extendedprice * l_discount as saved from lineitem")
def map_named(spark, d):
    return order_items(spark, d, ["l_linenumber", "l_extendedprice", "l_discount"]).map(lambda x: (x.l_linenumber, x.l_extendedprice * x.l_discount), at="items", names=["number", "saved"])


@query("select round(100 + sum(l_quantity), 2) as total, min(l_discount) as least from lineitem")
def reduce_nested(spark, d):
    frame = order_items(spark, d, ["l_quantity", "l_discount"])
    got = frame.reduces({"total": (100.0, lambda x, t: x.l_quantity + t), "least": (1.0, lambda x, t: min(x.l_discount, t))}, at="items")
    return spark.createDataFrame([(round(got["total"], 2), got["least"])], "total double, least double")


@query("select l_orderkey as o_orderkey, l_quantity from lineitem")
def split(spark, d):
    return order_items(spark, d, _items("l_quantity")).split("items/l_quantity").df.select("o_orderkey", F.explode("l_quantity").alias("l_quantity"))


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount from lineitem")
def merge(spark, d):
    out = order_items(spark, d, _items("l_quantity l_discount")).split("items/l_quantity", "items/l_discount").merge("items", "l_quantity", "l_discount")
    return exploded(out, "o_orderkey")


@query("select role from conversations")
def project_nested(spark, d):
    out = turns(spark, d).project("turns/role")
    return out.df.select(F.explode("role").alias("role"))


@query("select turn, text from conversations")
def keep_glob(spark, d):
    return turns(spark, d).keep("turns/t*").df.select(F.inline("turns"))


@query("select conv_id, turn, role from conversations")
def drop_nested(spark, d):
    return exploded(turns(spark, d).drop("*/text"), "conv_id", name="turns")


@query("select conv_id, turn, text, role as speaker from conversations")
def fieldname_nested(spark, d):
    return exploded(turns(spark, d).fieldname("speaker", at="turns/role"), "conv_id", name="turns")


@query("select count(*) as n, 'Turn' as name from conversations")
def recordname(spark, d):
    out = turns(spark, d).recordname("Turn", at="turns")
    return out.df.agg(F.sum(F.size("turns")).alias("n")).withColumn("name", F.lit(out.names[("turns",)]))


@query("select l_orderkey, l_linenumber, l_partkey, p_name, p_size from lineitem left join part on l_partkey = p_partkey")
def pointer(spark, d):
    return links.deref(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", table(spark, d, "part"), "p_partkey", ["p_name", "p_size"])


@query("select o_orderkey, o_orderpriority from orders")
def pointer_build(spark, d):
    rows, target = links.dictionary(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])
    return links.deref(rows, "_pos", target.withColumnRenamed("_pos", "_target"), "_target", ["o_orderpriority"]).drop("_pos")


@query("""with recursive p(depth, node) as (select 0, 1::bigint union all select depth + 1, (o_orderkey * 7 + 3) % 1000 from p join orders on o_orderkey = node where depth < 20)
    select * from p""")
def pointer_chain(spark, d):
    nodes = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7 + 3) % 1000).alias("next"))
    return links.chase(spark, nodes, "o_orderkey", "next", 1, 20)


@query("""select o_orderkey, cast(coalesce(sum(case when a.l_quantity < b.l_quantity then 1 else 0 end), 0) as bigint) as pairs
    from orders left join lineitem a on a.l_orderkey = o_orderkey left join lineitem b on b.l_orderkey = o_orderkey group by o_orderkey""")
def combinatorics(spark, d):
    def pairs(items):
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda t, x: t + F.size(F.filter(items, lambda y: x.l_quantity < y.l_quantity)))

    return order_items(spark, d, ["l_quantity"]).define("pairs", lambda r: pairs(r["items"])).df.select("o_orderkey", "pairs")


@query("select vec_id, u.i as i, embedding[u.i + 1] as x from embeddings, unnest(range(1, len(embedding), 2)) u(i)")
def slice_step(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", slice_(F.col("embedding"), 1, None, 2).alias("e"))
    return rows.select("vec_id", F.posexplode("e").alias("i", "x")).select("vec_id", (F.col("i") * 2 + 1).cast("bigint").alias("i"), "x")


@query("select vec_id, embedding[u.i] as x, u.i as i from embeddings, unnest(range(len(embedding) - 2, len(embedding) + 1)) u(i)")
def slice_tail(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), slice_(F.col("embedding"), -3, None, None).alias("e"))
    return rows.select("vec_id", "n", F.posexplode("e").alias("i", "x")).select("vec_id", "x", (F.col("n") - 2 + F.col("i")).cast("bigint").alias("i"))


@query("select vec_id, embedding[len(embedding)] as x from embeddings")
def reversed_list(spark, d):
    return NestedFrame(table(spark, d, "embeddings").select("vec_id", "embedding")).define("x", lambda r: reversed(r.embedding)[0]).df.select("vec_id", "x")


@query("select conv_id, bool_or(role = 'system') as x from conversations group by conv_id")
def contains(spark, d):
    frame = NestedFrame(turns(spark, d).df.select("conv_id", F.col("turns.role").alias("roles")))
    return frame.define("x", "'system' in roles").df.select("conv_id", "x")


@query("select conv_id, cast(count(*) filter (role = 'user') as int) as n from conversations group by conv_id")
def list_count(spark, d):
    frame = NestedFrame(turns(spark, d).df.select("conv_id", F.col("turns.role").alias("roles")))
    return frame.define("n", "roles.count('user')").df.select("conv_id", "n")


@query("""select conv_id, n, (sum(n) over (order by conv_id))::bigint as stop, (sum(n) over (order by conv_id) - n)::bigint as start
    from (select conv_id, count(*) as n from conversations group by conv_id)""")
def counts_to_offsets(spark, d):
    return links.counts_to_offsets(table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")), "n", "conv_id")


@query("select event_id, event_type, cast(row_number() over (partition by event_type order by event_id) - 1 as int) as offset from events")
def union_offsets(spark, d):
    return links.union_offsets(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("""select event_id, event_id % 3 <> 0 as is_float, case when event_id % 3 = 0 then user_id::double else value end as x from events""")
def union_case(spark, d):
    u = links.union((F.col("event_id") % 3 == 0, F.col("user_id")), (F.lit(True), F.col("value")))
    rows = table(spark, d, "events").select("event_id", u.alias("u"))
    return rows.select("event_id", links.case(F.col("u"), 1).alias("is_float"), links.common(F.col("u"), rows.schema["u"].dataType).alias("x"))


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1)::bigint as _pos from orders")
def rowpos(spark, d):
    return with_position(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("select cast(floor(l_extendedprice / 2500) as bigint) as bin, count(*) as n from lineitem group by 1")
def histogram_reduce(spark, d):
    bins = order_items(spark, d, ["l_extendedprice"]).map("floor(l_extendedprice / 2500)", at="items", names=["bin"])
    return bins.groupBy("bin").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey + 1 as c1, o_orderstatus as s from orders")
def prefix_grouping(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("Cust_key"), F.col("o_orderstatus").alias("Cust_status"))
    grouped = group_by_prefix(rows.withColumnRenamed("o_orderkey", "orderkey"))
    return grouped.define("c1", lambda r: r.Cust.key + 1).df.select(F.col("orderkey").alias("o_orderkey"), "c1", F.col("Cust.status").alias("s"))


@query("select l_orderkey as o_orderkey, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem where l_quantity > 25 group by 1")
def chain(spark, d):
    """Filter, define and fold in one lazy chain."""
    out = order_items(spark, d, ["l_quantity", "l_extendedprice", "l_discount"]).filter("l_quantity > 25", at="items").define("revenue", "l_extendedprice * (1 - l_discount)", at="items")
    rows = out.df.select("o_orderkey", F.explode("items.revenue").alias("r"))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("revenue"))


@query("select l_quantity + l_linenumber as f0 from lineitem where l_linenumber % 2 <> 0")
def map_scalar(spark, d):
    rows = NestedFrame(table(spark, d, "lineitem").select("l_quantity", "l_linenumber"))
    return rows.map(lambda x: x.l_quantity + x.l_linenumber if x.l_linenumber % 2 != 0 else None)


@query("select l_partkey as part, (l_linenumber * (l_linenumber + 1) // 2)::bigint as steps from lineitem where l_linenumber <> 3")
def map_python(spark, d):
    def steps(x):
        total = 0
        for i in range(x.l_linenumber + 1):
            total += i
        return (x.l_partkey, total) if x.l_linenumber != 3 else None

    return order_items(spark, d, ["l_linenumber", "l_partkey"]).map(steps, at="items", names=["part", "steps"])


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_linenumber in (2, 3, 5, 7)")
def filter_python(spark, d):
    def prime(x):
        n = x.l_linenumber
        while n > 1:
            n -= 1
            if n > 1 and x.l_linenumber % n == 0:
                return False
        return x.l_linenumber > 1

    return exploded(order_items(spark, d, _items("")).filter(prime, at="items"), "o_orderkey")


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 as rest from lineitem")
def define_python(spark, d):
    def rest(x):
        n = x.l_linenumber
        while n >= 3:
            n -= 3
        return n

    held = order_items(spark, d, _items("")).df.select("o_orderkey", F.struct("items").alias("deep"))
    return NestedFrame(held).define("rest", rest, at="deep/items", fieldtype="int").df.select("o_orderkey", F.inline("deep.items"))


@query("select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_linenumber > 1 and l_linenumber < 4")
def filter_same_line(spark, d):
    """Two functions of one parameter on one line."""
    return exploded(order_items(spark, d, _items("")).filter(lambda x: x.l_linenumber > 1, at="items").filter(lambda x: x.l_linenumber < 4, at="items"), "o_orderkey")


@query("select event_id from events where ((-event_id % 3) + 3) % 3 = 2")
def filter_statements(spark, d):
    """A function of several statements has Python's remainder."""

    def two(x):
        y = -x.event_id % 3
        return y == 2

    return NestedFrame(table(spark, d, "events").select("event_id")).filter(two).df


@query("""select event_id, floor(-event_id / 7)::bigint as quotient, event_id + 9007199254740993 as huge, (event_id - 50) * (event_id - 50) as square,
    (-event_id % 7 + 7) % 7 as rest from events""")
def exact_integers(spark, d):
    rows = NestedFrame(table(spark, d, "events").select("event_id"))
    rows = rows.define("quotient", "-event_id // 7").define("huge", "(event_id + 9007199254740993) // 1").define("square", "(event_id - 50) ** 2")
    return rows.define("rest", "-event_id % 7").df


@query("""select event_id, round(sqrt(abs(value)), 6) as a, round(exp(value / 1000), 6) as b, round(ln(abs(value) + 1), 6) as c, round(log10(abs(value) + 1), 6) as d,
    round(sin(value) + cos(value) + atan2(value, 2), 6) as e, ceil(value)::bigint as f, trunc(value)::bigint as g, round(degrees(value), 4) as h from events""")
def math_functions(spark, d):
    rows = NestedFrame(table(spark, d, "events").select("event_id", "value"))
    for name, text in {"a": "sqrt(abs(value))", "b": "exp(value / 1000)", "c": "log(abs(value) + 1)", "d": "log10(abs(value) + 1)", "e": "sin(value) + cos(value) + atan2(value, 2)", "f": "ceil(value)", "g": "trunc(value)", "h": "degrees(value)"}.items():
        rows = rows.define(name, text)
    return NestedFrame(rows.df.drop("value")).df.select("event_id", *[F.round(c, 4 if c == "h" else 6).alias(c) for c in "abcdeh"], "f", "g")


@query("""select o_orderkey, coalesce(sum(l_linenumber), 0)::bigint as total, coalesce(max(l_linenumber), -1) as most, coalesce(bool_or(l_linenumber > 4), false) as some,
    coalesce(bool_and(l_linenumber > 1), true) as whole from orders left join lineitem on o_orderkey = l_orderkey group by 1""")
def list_functions(spark, d):
    numbers = order_items(spark, d, ["l_linenumber"]).df.select("o_orderkey", F.col("items.l_linenumber").alias("l"))
    frame = NestedFrame(numbers).define("total", "sum(l)").define("most", lambda r: max(r.l) if len(r.l) > 0 else -1)
    return frame.define("some", lambda r: any(x > 4 for x in r.l)).define("whole", lambda r: all([x > 1 for x in r.l])).df.drop("l")


@query("""select conv_id, (2 * count(*) + 1)::int as n, (3 * count(*))::int as m, bool_or(role = 'tool') is not null as last from conversations group by 1""")
def list_concat(spark, d):
    frame = NestedFrame(turns(spark, d).df.select("conv_id", F.col("turns.role").alias("roles"), F.array(F.lit("end")).alias("tail")))
    frame = frame.define("n", lambda r: len(r.roles + r.roles + r.tail)).define("m", "len(roles * 3)").define("last", "(roles + tail)[-1] == 'end'")
    return frame.df.drop("roles", "tail")


@query("select conv_id, string_agg(role, '+' order by turn) as said from conversations where turn % 2 = 0 group by 1")
def comprehension(spark, d):
    frame = turns(spark, d).define("said", lambda r: [t.role for t in r.turns if t.turn % 2 == 0])
    return frame.df.select("conv_id", F.concat_ws("+", "said").alias("said")).where("said <> ''")


@query("select event_id, event_id % 3 = 0 and user_id = 7 as seven, event_id % 3 <> 0 or user_id = user_id as same from events")
def union_equal(spark, d):
    u = links.union((F.col("event_id") % 3 == 0, F.col("user_id")), (F.lit(True), F.col("event_type")))
    rows = table(spark, d, "events").select("event_id", u.alias("u"))
    dtype = rows.schema["u"].dataType
    u = F.col("u")
    return rows.select("event_id", links.equal(u, dtype, F.lit(7).cast("bigint"), T.LongType()).alias("seven"), links.equal(u, dtype, u, dtype).alias("same"))


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1)::bigint as at from orders")
def index_top(spark, d):
    return NestedFrame(table(spark, d, "orders").select("o_orderkey")).index("at").df


@query("select string_agg(c_mktsegment, ',' order by c_mktsegment) as segments, sum(n)::bigint as n from (select c_mktsegment, count(*) as n from customer group by 1)")
def reduce_combiner(spark, d):
    """A fold with no column form: a tally of kinds, combined in order of the partitions."""

    def seen(x, tally):
        return {**tally, x.c_mktsegment: tally.get(x.c_mktsegment, 0) + 1}

    def join(a, b):
        return {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}

    got = NestedFrame(table(spark, d, "customer").select("c_custkey", "c_mktsegment")).reduce({}, seen, combiner=join)
    return spark.createDataFrame([(",".join(sorted(got)), sum(got.values()))], "segments string, n bigint")


@query("""with recursive p(depth, node) as (select 0, 0::bigint union all select depth + 1, (o_orderkey + 1)::bigint from p join orders on o_orderkey = node where depth < 150)
    select * from p""")
def pointer_chain_long(spark, d):
    nodes = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + 1).alias("next"))
    return links.chase(spark, nodes, "o_orderkey", "next", 0, 150)


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) as net from lineitem where l_extendedprice * (1 - l_discount) > 50000")
def record_behavior(spark, d):
    """Records of a price and a discount know their net price."""
    behave(["l_extendedprice", "l_discount"], net=lambda r: r.l_extendedprice * (1 - r.l_discount))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_extendedprice", "l_discount").alias("p"))
    return NestedFrame(rows).filter(lambda r: r.p.net > 50000).define("net", lambda r: r.p.net).df.drop("p")
