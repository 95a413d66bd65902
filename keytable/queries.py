"""The query catalogue over the test tables, each with its DuckDB equivalent.

Every query is built from the package's operators; ``SQL`` states the same in DuckDB.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytable.functions import codec, geojson, props, spatial
from keytable.functions.codec import Padding
from keytable.model import PARTITION_KEY, ROW_KEY, Collection, Entity, schema_of
from keytable.operators import index as ix
from keytable.operators import relation, revision, spatial_index, write
from keytable.plans.predicate import m
from keytable.plans.query import Query, decode_key
from keytable.sources.context import Context
from keytable.streaming import upsert

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
SQL: dict[str, str] = {}


CUSTOMER = Entity("customer", schema_of("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")).with_keys(["c_mktsegment"], ["c_nationkey", "c_custkey"])
ORDERS = (
    Entity("orders", schema_of("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"))
    .with_keys(["o_orderpriority", "o_orderstatus"], ["o_orderkey"])
    .with_index("by_customer", ["o_custkey", "o_orderstatus"])
    .with_index("by_customer_full", ["o_custkey", "o_orderstatus"], covering=True, table="ordersByCustomer")
    .with_index("by_customer_pair", ["o_custkey"], ["o_orderstatus"])
)
LINEITEM = Entity("lineitem", schema_of("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")).with_keys(["l_orderkey"], ["l_linenumber"])
PART = Entity("part", schema_of("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")).with_keys(["p_brand"], ["p_partkey"])
SUPPLIER = Entity("supplier", schema_of("s_suppkey long, s_name string, s_nationkey int, s_acctbal double")).with_keys(["s_nationkey"], ["s_suppkey"])
NATION = Entity("nation", schema_of("n_nationkey int, n_name string, n_regionkey int")).with_keys(["n_regionkey"], ["n_nationkey"])
REGION = Entity("region", schema_of("r_regionkey int, r_name string")).with_keys(["r_regionkey"])
EVENTS = Entity("events", schema_of("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")).with_keys(["user_id"], ["event_id"])
EVENT_CODES = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "logout": 4}

NATIONS = Collection("nations", "nation", (("n_regionkey", "r_regionkey"),))
CUSTOMER_ORDERS = Collection("orders", "orders", (("o_custkey", "c_custkey"),))
ORDER_LINES = Collection("lines", "lineitem", (("l_orderkey", "o_orderkey"),))


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(spark, sf_dir, [CUSTOMER, ORDERS, LINEITEM, PART, SUPPLIER, NATION, REGION, EVENTS])


def root(spark: SparkSession, sf_dir: str, entity: Entity) -> Query:
    return context(spark, sf_dir).query(entity)


def query(sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def declare(function: QueryFunction) -> QueryFunction:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return declare


# --- scans and element operators -------------------------------------------------


@query("SELECT * FROM nation")
def scan_all(spark, sf):
    return root(spark, sf, NATION).df()


@query("SELECT * FROM customer WHERE c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 42) AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 42) AND c_custkey = 42")
def key_point(spark, sf):
    row = root(spark, sf, CUSTOMER).first(m("c_custkey") == 42)
    return root(spark, sf, CUSTOMER).find([row["c_mktsegment"]], [row["c_nationkey"], 42])


@query("SELECT * FROM customer WHERE c_custkey = 42")
def key_point_encoded(spark, sf):
    row = root(spark, sf, CUSTOMER).first(m("c_custkey") == 42)
    return root(spark, sf, CUSTOMER).find(row["c_mktsegment"], f"{row['c_nationkey']}__42")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey = 42")
def key_point_columns(spark, sf):
    return root(spark, sf, CUSTOMER).where(m("c_custkey") == 42).select("c_custkey", "c_acctbal").df()


@query("SELECT c_custkey, to_json(map {'c_name': c_name, 'c_mktsegment': c_mktsegment})::VARCHAR AS bag FROM customer")
def property_bag(spark, sf):
    rows = root(spark, sf, CUSTOMER).df()
    return rows.select("c_custkey", F.to_json(props.property_bag(rows, ["c_name", "c_mktsegment"])).alias("bag"))


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def key_leading(spark, sf):
    return root(spark, sf, CUSTOMER).where_key(c_mktsegment="BUILDING").df()


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE 'Customer#0000001%'")
def key_startswith(spark, sf):
    return root(spark, sf, CUSTOMER).where((m("c_mktsegment") == "BUILDING") & m("c_name").startswith("Customer#0000001")).df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def flagship(spark, sf):
    return root(spark, sf, ORDERS).where((m("o_orderpriority") == "1-URGENT") & (m("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice").df()


@query("SELECT * FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 7)")
def single_row(spark, sf):
    last = root(spark, sf, CUSTOMER).where(m("c_nationkey") == 7).df().agg(F.max("c_custkey")).first()[0]
    found = root(spark, sf, CUSTOMER).single(m("c_custkey") == last)
    return spark.createDataFrame([found], CUSTOMER.schema)


@query("SELECT * FROM customer ORDER BY c_mktsegment || '', c_nationkey::VARCHAR || '__' || c_custkey::VARCHAR LIMIT 1")
def first_row(spark, sf):
    found = root(spark, sf, CUSTOMER).ordered().first()
    return spark.createDataFrame([found], CUSTOMER.schema)


@query("SELECT * FROM customer WHERE c_custkey = -1")
def first_or_default_none(spark, sf):
    found = root(spark, sf, CUSTOMER).first_or_default(m("c_custkey") == -1)
    return spark.createDataFrame([found] if found else [], CUSTOMER.schema)


@query("SELECT * FROM customer ORDER BY c_mktsegment, c_nationkey::VARCHAR || '__' || c_custkey::VARCHAR LIMIT 10")
def take_ordered(spark, sf):
    return root(spark, sf, CUSTOMER).take(25).take(10).ordered().df()


@query("""SELECT * FROM (SELECT c_mktsegment AS "PartitionKey", c_nationkey::VARCHAR || '__' || c_custkey::VARCHAR AS "RowKey", * FROM customer) ORDER BY "PartitionKey", "RowKey" LIMIT 10 OFFSET 10""")
def page_2(spark, sf):
    page, token = root(spark, sf, CUSTOMER).page(10)
    return root(spark, sf, CUSTOMER).page(10, token(page.collect()))[0]


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def count_rows(spark, sf):
    return root(spark, sf, LINEITEM).where(m("l_returnflag") == "R").df().agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def from_table(spark, sf):
    return root(spark, sf, NATION).from_table("supplier").where(F.col("s_nationkey") == 3).df().select("s_suppkey", "s_name")


# --- predicates ------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_tax <> 0.02 AND l_linenumber <= 3 AND l_suppkey > 10")
def cmp_ops(spark, sf):
    q = root(spark, sf, LINEITEM).where((m("l_quantity") >= 45.0) & (m("l_discount") < 0.03) & (m("l_tax") != 0.02) & (m("l_linenumber") <= 3) & (m("l_suppkey") > 10))
    return q.select("l_orderkey", "l_linenumber", "l_quantity").df()


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (NOT (o_orderpriority = '1-URGENT') AND o_totalprice < 5000)")
def bool_ops(spark, sf):
    either = ((m("o_orderstatus") == "F") & (m("o_totalprice") > 200000.0)) | (~(m("o_orderpriority") == "1-URGENT") & (m("o_totalprice") < 5000.0))
    return root(spark, sf, ORDERS).where(either).select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'O' AND o_totalprice > 100000")
def chained_where(spark, sf):
    import datetime

    q = root(spark, sf, ORDERS).where(m("o_orderdate") >= datetime.datetime(1996, 1, 1))
    return q.where(m("o_orderstatus") == "O").where(m("o_totalprice") > 100000.0).select("o_orderkey").df()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49")
def bool_member(spark, sf):
    rows = root(spark, sf, LINEITEM).df().withColumn("returned", F.col("l_returnflag") == "R")
    flagged = Entity("flagged", rows.schema)
    return Query(flagged, lambda _: rows).where(m("returned").istrue() & (m("l_quantity") > 49.0)).select("l_orderkey", "l_linenumber").df()


@query("SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000500'")
def compare_to(spark, sf):
    return root(spark, sf, CUSTOMER).where(m("c_name").compare_to("Customer#000000500") > 0).select("c_custkey", "c_name").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(spark, sf):
    return root(spark, sf, ORDERS).where(m("o_orderpriority").isin(["1-URGENT", "2-HIGH"])).select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def not_in_list(spark, sf):
    return root(spark, sf, ORDERS).where(~m("o_orderpriority").isin(["1-URGENT", "2-HIGH"])).select("o_orderkey").df()


@query("SELECT o_orderkey FROM orders WHERE false")
def in_empty(spark, sf):
    return root(spark, sf, ORDERS).where(m("o_orderpriority").isin([])).select("o_orderkey").df()


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'blue')")
def startswith(spark, sf):
    return root(spark, sf, PART).where(m("p_name").startswith("blue")).select("p_partkey").df()


@query("SELECT p_partkey FROM part WHERE NOT starts_with(p_name, 'blue')")
def not_startswith(spark, sf):
    return root(spark, sf, PART).where(~m("p_name").startswith("blue")).select("p_partkey").df()


@query("SELECT p_partkey FROM part WHERE p_name IS NOT NULL")
def startswith_empty(spark, sf):
    return root(spark, sf, PART).where(m("p_name").startswith("")).select("p_partkey").df()


@query("SELECT p_partkey FROM part WHERE p_name IS NULL")
def is_null(spark, sf):
    return root(spark, sf, PART).where(m("p_name") == None).select("p_partkey").df()  # noqa: E711


@query("SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority || '__' || o_orderstatus, '1-URGENT__F') OR starts_with(o_orderpriority || '__' || o_orderstatus, '3-')")
def prefix_multi(spark, sf):
    return root(spark, sf, ORDERS).with_prefix("1-URGENT__F").with_prefix("3-").select("o_orderkey").df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' AND NOT (o_custkey <= 500 OR o_orderpriority = '5-LOW')")
def raw_filter(spark, sf):
    text = "o_totalprice gt 100000.0 and o_orderstatus eq 'F' and not (o_custkey le 500L or o_orderpriority eq '5-LOW')"
    return root(spark, sf, ORDERS).with_filter(text).with_filter("").select("o_orderkey", "o_totalprice").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
def raw_filter_dates(spark, sf):
    return root(spark, sf, ORDERS).with_filter("o_orderdate ge datetime'1997-01-01T00:00:00Z' and datetime'1997-02-01T00:00:00Z' gt o_orderdate").select("o_orderkey").df()


@query("SELECT o_orderkey, 'PartitionKey eq ''1-URGENT__F'' and o_totalprice gt 1000.0' AS filter FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 1000")
def filter_text(spark, sf):
    q = root(spark, sf, ORDERS).where((m("o_orderpriority") == "1-URGENT") & (m("o_orderstatus") == "F")).where(m("o_totalprice") > 1000.0)
    return q.select("o_orderkey", F.lit(q.filter_string()).alias("filter")).df()


# --- projections -----------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer")
def project_members(spark, sf):
    return root(spark, sf, CUSTOMER).select_struct({"id": "c_custkey", "name": "c_name", "twice": F.col("c_acctbal") * 2}).df()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def project_subtype(spark, sf):
    return root(spark, sf, NATION).project(schema_of("n_nationkey long, n_name string")).df()


@query("SELECT c_mktsegment, c_nationkey, c_custkey FROM customer")
def project_key_decode(spark, sf):
    stored = CUSTOMER.encode(root(spark, sf, CUSTOMER).df(), drop_members=True)
    return CUSTOMER.decode(stored).select("c_mktsegment", "c_nationkey", "c_custkey")


@query("SELECT p_partkey, p_name AS name, p_brand || '/' || p_type AS kind FROM part")
def project_computed(spark, sf):
    return root(spark, sf, PART).select("p_partkey", F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("kind")).df()


# --- keys ------------------------------------------------------------------------


@query("""SELECT c_mktsegment AS "PartitionKey", c_nationkey::VARCHAR || '__' || c_custkey::VARCHAR AS "RowKey", c_name FROM customer""")
def key_encode(spark, sf):
    return CUSTOMER.encode(root(spark, sf, CUSTOMER).df()).select(PARTITION_KEY, ROW_KEY, "c_name")


@query("""SELECT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, '') || '__' || o_orderstatus AS "PartitionKey", o_orderkey::VARCHAR AS "RowKey" FROM orders""")
def key_encode_null(spark, sf):
    rows = root(spark, sf, ORDERS).df().withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return ORDERS.encode(rows).select(PARTITION_KEY, ROW_KEY)


@query("""SELECT CASE WHEN length(s_nationkey::VARCHAR) >= 4 THEN s_nationkey::VARCHAR ELSE lpad(s_nationkey::VARCHAR, 4, '_') END AS "PartitionKey",
  CASE WHEN length(s_name) >= 12 THEN s_name ELSE rpad(s_name, 12, '_') END || '__' || CASE WHEN length(s_suppkey::VARCHAR) >= 8 THEN s_suppkey::VARCHAR ELSE lpad(s_suppkey::VARCHAR, 8, '_') END AS "RowKey" FROM supplier""")
def key_pad(spark, sf):
    padded = SUPPLIER.with_keys(["s_nationkey"], ["s_name", "s_suppkey"], {"s_nationkey": Padding(4), "s_name": Padding(12, "right"), "s_suppkey": Padding(8)})
    return padded.encode(root(spark, sf, SUPPLIER).df()).select(PARTITION_KEY, ROW_KEY)


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier")
def key_pad_decode(spark, sf):
    padded = SUPPLIER.with_keys(["s_nationkey", "s_suppkey"], padding={"s_nationkey": Padding(4), "s_suppkey": Padding(8)})
    return padded.decode(padded.encode(root(spark, sf, SUPPLIER).df(), drop_members=True)).select("s_nationkey", "s_suppkey", "s_acctbal")


@query("""SELECT to_base64(s_name::BLOB) AS "PartitionKey", s_suppkey::VARCHAR AS "RowKey", s_name FROM supplier""")
def key_base64(spark, sf):
    coded = SUPPLIER.with_keys(["s_name"], ["s_suppkey"]).with_base64("s_name")
    stored = coded.encode(root(spark, sf, SUPPLIER).df(), drop_members=True)
    return stored.join(coded.decode(stored).select("s_name", F.col("s_suppkey").cast("string").alias(ROW_KEY)), ROW_KEY).select(PARTITION_KEY, ROW_KEY, "s_name")


@query("""SELECT replace(p_brand, '#', '_') AS "PartitionKey", p_partkey::VARCHAR AS "RowKey", p_brand FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)""")
def key_transform(spark, sf):
    changed = PART.with_key_transform("p_brand", lambda s: str(s).replace("#", "_"), lambda c: F.replace(c, F.lit("#"), F.lit("_")), PARTITION_KEY)
    rows = root(spark, sf, PART).df()
    least = rows.agg(F.min("p_brand")).first()[0]
    return changed.encode(root(spark, sf, changed).where(m("p_brand") == least).df(), drop_members=True).select(PARTITION_KEY, ROW_KEY, "p_brand")


@query("""SELECT event_id, '0' || ((3155378975999999999 - 621355968000000000 - epoch_us(ts) * 10) - (3155378975999999999 - 621355968000000000 - epoch_us(ts) * 10) % 600000000)::VARCHAR AS bucket FROM events""")
def time_bucket_key(spark, sf):
    return root(spark, sf, EVENTS).select("event_id", codec.reverse_minute(F.col("ts")).alias("bucket")).df()


@query("SELECT c_custkey, c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def key_split(spark, sf):
    key = F.concat_ws("__", "c_mktsegment", F.col("c_nationkey").cast("string"))
    parts = decode_key(key, [T.StringType(), T.IntegerType()])
    return root(spark, sf, CUSTOMER).select("c_custkey", parts[0].alias("segment"), parts[1].alias("nation")).df()


# --- indexes ---------------------------------------------------------------------

_LAST = "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC) = 1"


def _by_date():
    return [F.col("o_orderdate"), F.col("o_orderkey").cast("string")]


@query(f"SELECT * FROM ({_LAST}) WHERE o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'F') AND o_orderstatus = 'F'")
def index_narrow(spark, sf):
    base = root(spark, sf, ORDERS).df()
    index = ix.find_index(ORDERS, "by_customer")
    customer = base.where("o_orderstatus = 'F'").agg(F.min("o_custkey")).first()[0]
    return ix.lookup(ORDERS, index, ix.derive(ORDERS, index, base, order=_by_date()), base, [customer, "F"])


@query(f"SELECT * FROM ({_LAST}) WHERE o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'O') AND o_orderstatus = 'O'")
def index_covering(spark, sf):
    base = root(spark, sf, ORDERS).df()
    index = ix.find_index(ORDERS, "by_customer_full")
    customer = base.where("o_orderstatus = 'O'").agg(F.min("o_custkey")).first()[0]
    return ix.lookup(ORDERS, index, ix.derive(ORDERS, index, base, order=_by_date()), base, [customer, "O"])


@query(f"""SELECT 'by_customer__' || o_custkey::VARCHAR || '__' || o_orderstatus AS "PartitionKey", '' AS "RowKey", o_orderpriority || '__' || o_orderstatus AS "RefPartitionKey", o_orderkey::VARCHAR AS "RefRowKey" FROM ({_LAST})""")
def index_last_write(spark, sf):
    base = root(spark, sf, ORDERS).df()
    return ix.derive(ORDERS, ix.find_index(ORDERS, "by_customer"), base, order=_by_date())


@query(f"""SELECT 'by_customer_pair__' || o_custkey::VARCHAR AS "PartitionKey", o_orderstatus AS "RowKey", o_orderpriority || '__' || o_orderstatus AS "RefPartitionKey", o_orderkey::VARCHAR AS "RefRowKey" FROM ({_LAST})""")
def index_pair(spark, sf):
    base = root(spark, sf, ORDERS).df()
    return ix.derive(ORDERS, ix.find_index(ORDERS, "by_customer_pair"), base, order=_by_date())


@query("""SELECT 'words__' || w AS "PartitionKey", p_partkey::VARCHAR AS "RefRowKey" FROM (SELECT max(p_brand || '#' || p_partkey::VARCHAR) AS x, w, max_by(p_partkey, (p_brand, p_partkey::VARCHAR)) AS p_partkey FROM (SELECT p_brand, p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w)""")
def index_split(spark, sf):
    rows = root(spark, sf, PART).df().withColumn("words", F.split("p_type", " "))
    tagged = Entity("part", rows.schema).with_keys(["p_brand"], ["p_partkey"]).with_index("words", ["words"], split=True)
    return ix.derive(tagged, tagged.indexes[0], rows).select(PARTITION_KEY, ix.REF_ROW)


@query(f"SELECT c_custkey AS probe_o_custkey, 'F' AS probe_o_orderstatus, l.* FROM customer JOIN ({_LAST}) l ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def index_join(spark, sf):
    base = root(spark, sf, ORDERS).df()
    index = ix.find_index(ORDERS, "by_customer")
    probes = root(spark, sf, CUSTOMER).df().select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    found = ix.join_by_index(ORDERS, ix.derive(ORDERS, index, base, order=_by_date()), base, probes, index)
    return found.select("probe_o_custkey", "probe_o_orderstatus", *base.columns)


@query("SELECT c_custkey, min(CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END)::INTEGER AS hit FROM customer WHERE c_acctbal > 5000 OR c_nationkey < 10 GROUP BY c_custkey")
def index_first_hit(spark, sf):
    base = root(spark, sf, CUSTOMER).df()
    rich = base.where("c_acctbal > 5000").select("c_custkey", F.lit(0).alias("hit"))
    near = base.where("c_nationkey < 10").select("c_custkey", F.lit(1).alias("hit"))
    return ix.first_hit([rich, near], ["c_custkey"])


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_by(spark, sf):
    return ix.distinct_by(root(spark, sf, ORDERS).df(), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


# --- relations -------------------------------------------------------------------


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def collection_join(spark, sf):
    c = context(spark, sf)
    return relation.join_children(c.table("region"), c.table("nation"), NATIONS).select("r_regionkey", "r_name", "n_nationkey", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(n), 0)::BIGINT AS lines FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey")
def collection_nested_count(spark, sf):
    c = context(spark, sf)
    orders = relation.count_children(c.table("orders").select("o_custkey", "o_orderkey"), c.table("lineitem"), ORDER_LINES, "n")
    sums = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"))
    return c.table("customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def collection_of_one(spark, sf):
    return relation.children_of(context(spark, sf).table("nation"), NATIONS, {"r_regionkey": 2})


@query("SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def collection_nested(spark, sf):
    c = context(spark, sf)
    nested = relation.nest_children(c.table("region"), c.table("nation"), NATIONS, ["n_name"])
    return nested.select("r_regionkey", F.array_join(F.transform("nations", lambda n: n["n_name"]), ",").alias("nations"))


# --- writes ----------------------------------------------------------------------


def _changes(base: DataFrame) -> DataFrame:
    """Changes to every tenth order, and new orders made of every hundredth."""
    changed = base.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 20 == 0, F.lit("X")))
    fresh = base.where("o_orderkey % 100 = 7").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    return changed.unionByName(fresh)


_CHANGES = """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 = 0 THEN 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 = 0
 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 = 7)"""


@query(f"SELECT coalesce(n.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, b.o_custkey) AS o_custkey, coalesce(n.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, b.o_totalprice) AS o_totalprice, coalesce(n.o_orderdate, b.o_orderdate) AS o_orderdate, coalesce(n.o_orderpriority, b.o_orderpriority) AS o_orderpriority FROM orders b FULL JOIN {_CHANGES} n ON n.o_orderkey = b.o_orderkey")
def upsert_merge(spark, sf):
    base = root(spark, sf, ORDERS).df()
    return write.merge(base, _changes(base), ["o_orderkey"])


@query(f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGES}) UNION ALL SELECT * FROM {_CHANGES}")
def upsert_replace(spark, sf):
    base = root(spark, sf, ORDERS).df()
    return write.replace(base, _changes(base), ["o_orderkey"])


@query(f"SELECT b.o_orderkey, b.o_custkey, coalesce(n.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, b.o_totalprice) AS o_totalprice, b.o_orderdate, b.o_orderpriority FROM orders b LEFT JOIN {_CHANGES} n ON n.o_orderkey = b.o_orderkey")
def update_existing(spark, sf):
    base = root(spark, sf, ORDERS).df()
    return write.update(base, _changes(base), ["o_orderkey"])


@query(f"SELECT * FROM orders UNION ALL SELECT * FROM {_CHANGES} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def insert_only(spark, sf):
    base = root(spark, sf, ORDERS).df()
    return write.insert(base, _changes(base), ["o_orderkey"], on_conflict="ignore")


@query("SELECT * FROM orders WHERE o_orderkey % 7 <> 0")
def delete_keys(spark, sf):
    base = root(spark, sf, ORDERS).df()
    return write.delete(base, base.where("o_orderkey % 7 = 0"), ["o_orderkey"])


@query("SELECT 7 AS s_nationkey, 900001::BIGINT AS s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey = 1")
def explicit_keys(spark, sf):
    rows = root(spark, sf, SUPPLIER).where(m("s_suppkey") == 1).df()
    return SUPPLIER.from_keys(rows, "7", "900001").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")


@query("SELECT * FROM orders WHERE NOT o_orderkey = 32")
def delete_by_key(spark, sf):
    return write.delete_by_key(root(spark, sf, ORDERS).df(), o_orderkey=32)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 2")
def change_set(spark, sf):
    base = root(spark, sf, ORDERS).df()
    twice = base.where("o_orderkey % 5 = 1").withColumn("o_totalprice", F.col("o_totalprice") * 2).select("o_orderkey", "o_totalprice")
    gone = base.where("o_orderkey % 5 in (1, 2)").select("o_orderkey", "o_totalprice")
    queued = write.changes(gone, write.DELETE, F.lit(1)).unionByName(write.changes(base.where("o_orderkey % 5 = 1"), write.ADD, F.lit(0)).select("o_orderkey", "o_totalprice", write.OP, write.SEQ))
    queued = queued.unionByName(write.changes(twice, write.MERGE, F.lit(2)))
    return write.apply(base, queued, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(spark, sf):
    rows = root(spark, sf, EVENTS).df()
    columns = [c for c in rows.columns if c != "user_id"]
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("x"))
    return last.select(*[F.col(f"x.{c}").alias(c) if c != "user_id" else F.col(c) for c in rows.columns])


@query("SELECT o_orderkey, o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5)::BIGINT AS batch FROM orders")
def write_batches(spark, sf):
    return write.batch_numbers(root(spark, sf, ORDERS).df().select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], 5)


@query("SELECT p_partkey, p_name, nullif(p_size, 1) AS p_size FROM part")
def default_dropped(spark, sf):
    return PART.with_defaults({"p_size": 1}).drop_defaults(root(spark, sf, PART).df()).select("p_partkey", "p_name", "p_size")


@query("SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'reduced:' || md5(text) ELSE text END AS text FROM documents")
def size_reducer(spark, sf):
    docs = context(spark, sf).table("documents")
    return docs.select("doc_id", props.reduce_size(F.col("text"), lambda c: F.concat(F.lit("reduced:"), F.md5(c)), 4000).alias("text"))


@query("SELECT doc_id, to_json(map {'source': source, 'lang': 'xx'})::VARCHAR AS extra FROM documents")
def additional_properties(spark, sf):
    docs = context(spark, sf).table("documents").select("doc_id", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("extra"))
    more = props.add_properties(docs, F.create_map(F.lit("lang"), F.lit("xx"), F.lit("doc_id"), F.lit("no")))
    return more.select("doc_id", F.to_json("extra").alias("extra"))


# --- revisions -------------------------------------------------------------------

_LAG = "lag(event_type) OVER w AS ot, lag(value) OVER w AS ov, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""SELECT user_id, event_id, CASE WHEN nth = 1 OR event_type IS DISTINCT FROM ot THEN event_type END AS event_type, CASE WHEN nth = 1 OR value IS DISTINCT FROM ov THEN value END AS value,
 concat_ws(',', CASE WHEN (nth = 1 AND event_type IS NOT NULL) OR (nth > 1 AND event_type IS DISTINCT FROM ot) THEN 'event_type' END, CASE WHEN (nth = 1 AND value IS NOT NULL) OR (nth > 1 AND value IS DISTINCT FROM ov) THEN 'value' END) AS changed
 FROM (SELECT *, {_LAG}) WHERE nth = 1 OR event_type IS DISTINCT FROM ot OR value IS DISTINCT FROM ov""")
def revision_diff(spark, sf):
    rows = root(spark, sf, EVENTS).df()
    return revision.diff_history(rows, ["user_id"], ["ts", "event_id"], ["event_type", "value"]).drop("ts")


@query(f"SELECT user_id, event_id FROM (SELECT *, {_LAG}) WHERE nth > 1 AND event_type IS DISTINCT FROM ot AND event_type <> 'click'")
def revision_veto(spark, sf):
    rows = root(spark, sf, EVENTS).df()
    changed = revision.diff_history(rows, ["user_id"], ["ts", "event_id"], ["event_type"], veto=(F.col("event_type") != "click") & (F.col("__nth") > 1))
    return changed.select("user_id", "event_id")


@query("SELECT user_id, replace('HEAD__' || user_id::VARCHAR, 'HEAD', 'REV') AS history FROM events GROUP BY user_id")
def revision_keys(spark, sf):
    rows = root(spark, sf, EVENTS).df().select("user_id").distinct()
    return rows.select("user_id", revision.revision_key(F.concat(F.lit("HEAD__"), F.col("user_id").cast("string"))).alias("history"))


@query("SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'o_totalprice' AS changed FROM orders WHERE o_orderkey % 10 = 0")
def revision_changes(spark, sf):
    base = root(spark, sf, ORDERS).df().select("o_orderkey", "o_totalprice", "o_orderpriority")
    changed = base.where("o_orderkey % 10 in (0, 1)").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return revision.diff_changes(base, changed, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "changed")


@query("SELECT user_id, event_id, event_type, value FROM events")
def revision_restore(spark, sf):
    rows = root(spark, sf, EVENTS).df()
    history = revision.diff_history(rows, ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    whole = revision.restore(history, ["user_id"], ["ts", "event_id"], ["event_type", "value"], versions=rows.select("user_id", "ts", "event_id"))
    return whole.select("user_id", "event_id", "event_type", "value")


# --- properties ------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_property(spark, sf):
    return root(spark, sf, EVENTS).select("event_id", props.parse_json(F.col("props"), "k int")["k"].alias("k")).df()


@query("SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"size\":' || p_size::VARCHAR || '}' AS stored FROM part")
def json_stored(spark, sf):
    item = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    binary = props.json_binary(item)
    back = props.parse_json(binary, "name string, size int", binary=True)
    return root(spark, sf, PART).select("p_partkey", props.json_text(back).alias("stored")).df()


@query("SELECT p_partkey, p_brand AS tags__brand, p_type AS tags__type, NULL::VARCHAR AS tags__none FROM part")
def tags_property(spark, sf):
    tagged = root(spark, sf, PART).select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("tags")).df()
    stored = props.map_to_columns(tagged, "tags", ["brand", "type", "none"])
    return props.map_to_columns(props.columns_to_map(stored, "tags"), "tags", ["brand", "type", "none"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'logout' THEN 4 END::INTEGER AS code, CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup', 'logout') THEN event_type END AS name FROM events")
def enum_property(spark, sf):
    code = props.enum_code(F.col("event_type"), EVENT_CODES)
    return root(spark, sf, EVENTS).select("event_id", code.alias("code"), props.enum_name(code, EVENT_CODES).alias("name")).df()


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def enum_filter(spark, sf):
    rows = root(spark, sf, EVENTS).df().withColumn("event_type", props.enum_code(F.col("event_type"), EVENT_CODES))
    coded = Entity("events", rows.schema).with_keys(["user_id"], ["event_id"]).with_enum("event_type", EVENT_CODES)
    return Query(coded, lambda _: rows).where(m("event_type") == "purchase").select("event_id").df()


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(.*)$', 1), '^([a-z]+://[^/?#]*)$', '\\1/') AS address FROM pages")
def uri_property(spark, sf):
    return context(spark, sf).table("pages").select("page_id", props.absolute_uri(F.col("url")).alias("address"))


# --- tiles -----------------------------------------------------------------------

_PLACE = "(c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85.0 AS lat"


def _places(spark, sf) -> DataFrame:
    return root(spark, sf, CUSTOMER).df().select("c_custkey", ((F.col("c_custkey") * 7919 % 36000) / 100.0 - 180.0).alias("lon"), ((F.col("c_custkey") * 104729 % 17000) / 100.0 - 85.0).alias("lat"))


def _px(level: str, lon: str = "lon") -> str:
    return f"CAST(trunc(least(greatest((least(greatest({lon}, -180.0), 180.0) + 180.0) / 360.0 * (256 * (1 << {level})) + 0.5, 0.0), 256 * (1 << {level}) - 1)) AS INTEGER)"


def _py(level: str, lat: str = "lat") -> str:
    sine = f"sin(least(greatest({lat}, -85.05112878), 85.05112878) * pi() / 180.0)"
    return f"CAST(trunc(least(greatest((0.5 - ln((1 + {sine}) / (1 - {sine})) / (4 * pi())) * (256 * (1 << {level})) + 0.5, 0.0), 256 * (1 << {level}) - 1)) AS INTEGER)"


_QUADKEY = "list_aggregate([(((tx >> (i - 1)) & 1) + 2 * ((ty >> (i - 1)) & 1))::VARCHAR FOR i IN range(12, 0, -1)], 'string_agg', '')"
_TILES = f"(SELECT c_custkey, {_px('12')} // 256 AS tx, {_py('12')} // 256 AS ty FROM (SELECT c_custkey, {_PLACE} FROM customer))"


@query(f"SELECT c_custkey, {_px('5')} AS x5, {_py('5')} AS y5, {_px('21')} AS x21, {_py('21')} AS y21, {_px('5')} // 256 AS tx, {_py('5')} // 256 AS ty FROM (SELECT c_custkey, {_PLACE} FROM customer)")
def tile_pixels(spark, sf):
    x, y = spatial.pixel_x(F.col("lon"), 5), spatial.pixel_y(F.col("lat"), 5)
    return _places(spark, sf).select("c_custkey", x.alias("x5"), y.alias("y5"), spatial.pixel_x(F.col("lon"), 21).alias("x21"), spatial.pixel_y(F.col("lat"), 21).alias("y21"), spatial.tile_of_pixel(x).alias("tx"), spatial.tile_of_pixel(y).alias("ty"))


@query(f"SELECT c_custkey, {_QUADKEY} AS quadkey FROM {_TILES}")
def quadkey(spark, sf):
    tx, ty = spatial.tile_of_pixel(spatial.pixel_x(F.col("lon"), 12)), spatial.tile_of_pixel(spatial.pixel_y(F.col("lat"), 12))
    return _places(spark, sf).select("c_custkey", tx.alias("tx"), ty.alias("ty")).select("c_custkey", spatial.quadkey(F.col("tx"), F.col("ty"), 12).alias("quadkey"))


@query(f"SELECT c_custkey, tx::INTEGER AS tx, ty::INTEGER AS ty FROM {_TILES}")
def quadkey_inverse(spark, sf):
    keys = quadkey(spark, sf)
    return keys.select("c_custkey", spatial.tile_x(F.col("quadkey")).alias("tx"), spatial.tile_y(F.col("quadkey")).alias("ty"))


@query(f"SELECT c_custkey, round(cos(least(greatest(lat, -85.05112878), 85.05112878) * (pi() / 180)) * (2 * pi() * 6378137.0) / (256 * (1 << 10)), 6) AS metres, round(2 * pi() * 6378137.0 / (256 * (1 << 10)), 6) AS at_equator FROM (SELECT c_custkey, {_PLACE} FROM customer)")
def ground_resolution(spark, sf):
    return _places(spark, sf).select("c_custkey", F.round(spatial.ground_resolution(F.col("lat"), 10), 6).alias("metres"), F.round(spatial.resolution(10), 6).alias("at_equator"))


@query(f"SELECT c_custkey, round(360.0 * ({_px('9')} / (256.0 * (1 << 9)) - 0.5), 6) AS lon, round(90.0 - 360.0 * atan(exp(-(0.5 - {_py('9')} / (256.0 * (1 << 9))) * 2 * pi())) / pi(), 6) AS lat FROM (SELECT c_custkey, {_PLACE} FROM customer)")
def pixel_inverse(spark, sf):
    x, y = spatial.pixel_x(F.col("lon"), 9), spatial.pixel_y(F.col("lat"), 9)
    return _places(spark, sf).select("c_custkey", F.round(spatial.longitude_of(x, 9), 6).alias("lon"), F.round(spatial.latitude_of(y, 9), 6).alias("lat"))


@query(f"SELECT c_custkey, tx * 256 AS px, round(360.0 * (tx * 256 / (256.0 * (1 << 12)) - 0.5), 6) AS minx, round(360.0 * (least((tx + 1) * 256, 256 * (1 << 12) - 1) / (256.0 * (1 << 12)) - 0.5), 6) AS maxx, round(90.0 - 360.0 * atan(exp(-(0.5 - ty * 256 / (256.0 * (1 << 12))) * 2 * pi())) / pi(), 6) AS maxy, round(tx * 256 * (2 * pi() * 6378137.0 / (256 * (1 << 12))) - pi() * 6378137.0, 4) AS metres FROM {_TILES}")
def tile_bounds(spark, sf):
    tx, ty = spatial.tile_of_pixel(spatial.pixel_x(F.col("lon"), 12)), spatial.tile_of_pixel(spatial.pixel_y(F.col("lat"), 12))
    tiles = _places(spark, sf).select("c_custkey", tx.alias("tx"), ty.alias("ty")).withColumn("e", spatial.tile_extent(F.col("tx"), F.col("ty"), 12))
    px = spatial.pixel_of_tile(F.col("tx"))
    return tiles.select("c_custkey", px.alias("px"), F.round("e.minx", 6).alias("minx"), F.round("e.maxx", 6).alias("maxx"), F.round("e.maxy", 6).alias("maxy"), F.round(spatial.pixels_to_metres(px, 12), 4).alias("metres"))


@query(f"SELECT c_custkey, round(cos(least(greatest(lat, -85.05112878), 85.05112878) * (pi() / 180)) * (2 * pi() * 6378137.0) / (256 * (1 << 3)) * (96 / 0.0254), 2) AS scale, (256 * (1 << 3))::BIGINT AS pixels FROM (SELECT c_custkey, {_PLACE} FROM customer)")
def map_scale(spark, sf):
    return _places(spark, sf).select("c_custkey", F.round(spatial.map_scale(F.col("lat"), 3, 96), 2).alias("scale"), spatial.map_size(3).alias("pixels"))


_BOXES = f"(SELECT c_custkey, lon AS minx, lat AS miny, least(lon + (c_custkey % 50) / 10.0, 180.0) AS maxx, least(lat + (c_custkey % 30) / 10.0, 85.0) AS maxy FROM (SELECT c_custkey, {_PLACE} FROM customer))"
_LEVEL = f"(SELECT *, coalesce(list_filter(range(1, 24), lambda z: {_px('z', 'minx')} // 256 <> {_px('z', 'maxx')} // 256 OR {_py('z', 'miny')} // 256 <> {_py('z', 'maxy')} // 256)[1] - 1, 23) AS z FROM {_BOXES})"
_KEYS = f"(SELECT *, CASE WHEN z = 0 THEN '' ELSE list_aggregate([((({_px('z', 'minx')} // 256 >> (i - 1)::INTEGER) & 1) + 2 * (({_py('z', 'maxy')} // 256 >> (i - 1)::INTEGER) & 1))::VARCHAR FOR i IN range(z, 0, -1)], 'string_agg', '') END AS key FROM {_LEVEL})"


def _boxes(spark, sf) -> DataFrame:
    return _places(spark, sf).select("c_custkey", F.col("lon").alias("minx"), F.col("lat").alias("miny"), F.least(F.col("lon") + (F.col("c_custkey") % 50) / 10.0, F.lit(180.0)).alias("maxx"), F.least(F.col("lat") + (F.col("c_custkey") % 30) / 10.0, F.lit(85.0)).alias("maxy"))


def _box_index(spark, sf) -> DataFrame:
    return spatial_index.derive(_boxes(spark, sf), F.struct("minx", "miny", "maxx", "maxy"))


@query(f"SELECT c_custkey, key FROM {_KEYS}")
def extent_quadkey(spark, sf):
    return _boxes(spark, sf).select("c_custkey", spatial.extent_quadkey(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("key"))


_QUERY_BOX = (5.0, 45.0, 20.0, 58.0)
_QUERY_KEY = spatial_index.query_key(_QUERY_BOX)


@query(f"SELECT c_custkey, rpad(key, 30, '_') AS tile FROM {_KEYS} WHERE starts_with(key, '{_QUERY_KEY}') OR key IN ({', '.join(repr(_QUERY_KEY[:n]) for n in range(len(_QUERY_KEY)))})")
def spatial_candidates(spark, sf):
    return spatial_index.candidates(_box_index(spark, sf), _QUERY_BOX).select("c_custkey", "tile")


@query(f"SELECT c_custkey FROM {_BOXES} WHERE minx <= {_QUERY_BOX[2]} AND maxx >= {_QUERY_BOX[0]} AND miny <= {_QUERY_BOX[3]} AND maxy >= {_QUERY_BOX[1]}")
def spatial_search(spark, sf):
    found = spatial_index.candidates(_box_index(spark, sf), _QUERY_BOX)
    return found.where(f"minx <= {_QUERY_BOX[2]} and maxx >= {_QUERY_BOX[0]} and miny <= {_QUERY_BOX[3]} and maxy >= {_QUERY_BOX[1]}").select("c_custkey")


@query(f"SELECT a.c_custkey AS a, b.c_custkey AS b FROM {_BOXES} a JOIN {_BOXES} b ON a.c_custkey < b.c_custkey AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy")
def spatial_join(spark, sf):
    rows = _boxes(spark, sf)
    side = lambda name: rows.select(F.col("c_custkey").alias(name), F.struct("minx", "miny", "maxx", "maxy").alias(f"{name}_box"))
    return spatial_index.join_overlapping(side("a"), side("b"), F.col("a_box"), F.col("b_box")).where("a < b").select("a", "b")


def _shapes(spark, sf) -> DataFrame:
    """The boxes as GeoJSON polygons."""
    boxes = _boxes(spark, sf)
    corner = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))
    return boxes.select("c_custkey", F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")).alias("shape"))


# a convex shape misses a box if the box is on the outer side of one of its edges
@query(f"""SELECT c_custkey FROM {_BOXES} WHERE minx <= 20 AND maxx >= 5 AND miny <= 58 AND maxy >= 45
 AND -8 * (miny - 45) - 13 * (minx - 20) >= 0 AND -7 * (miny - 58) + 13 * (maxx - 12) >= 0""")
def polygon_intersects(spark, sf):
    """Box polygons that intersect a triangle, by the index and the exact test."""
    shapes = _shapes(spark, sf)
    rows = spatial_index.derive(shapes, geojson.extent_column(F.col("shape")))
    triangle = '{"type":"Polygon","coordinates":[[[5,45],[20,45],[12,58],[5,45]]]}'
    return spatial_index.search(rows, ["c_custkey"], triangle, "shape").select("c_custkey")


@query(f"SELECT a.c_custkey AS a, b.c_custkey AS b FROM {_BOXES} a JOIN {_BOXES} b ON a.c_custkey < b.c_custkey AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy")
def geometry_join(spark, sf):
    """Pairs of polygons that intersect: by extent, and exactly."""
    rows = _shapes(spark, sf)
    side = lambda name: rows.select(F.col("c_custkey").alias(name), F.col("shape").alias(f"{name}_shape"))
    return spatial_index.join_intersecting(side("a"), side("b"), ("a_shape", "b_shape")).where("a < b").select("a", "b")


@query(f"SELECT c_custkey, minx, miny, maxx, maxy FROM {_BOXES}")
def geometry_stored(spark, sf):
    """Geometries to bytes and back, and their extents."""
    stored = _shapes(spark, sf).select("c_custkey", geojson.to_binary(F.col("shape")).alias("stored"))
    back = stored.select("c_custkey", geojson.extent_column(geojson.from_binary(F.col("stored"))).alias("e"))
    return back.select("c_custkey", "e.minx", "e.miny", "e.maxx", "e.maxy")


# --- what saves write --------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or 'file://' + tempfile.gettempdir()}/keytable-{uuid.uuid4().hex}"


def _saved(spark, sf) -> Context:
    """Orders in a folder of their own, after two saves: of every fifth row the price of the
    rows rises and every seventh row goes; then the customers of every 50th row become
    one. Both are changes that a save applies."""
    entity = (
        Entity("orders", ORDERS.schema).with_keys(["o_orderpriority"], ["o_orderkey"]).with_table("sales").with_index("by_customer", ["o_custkey"], table="salesByCustomer")
        .with_revision_tracking("coalesce(o_orderkey % 10 = 0, false)")
    )
    ctx = Context(spark, _scratch(spark), [entity])
    ctx.create_tables()
    rows = root(spark, sf, ORDERS).df()
    ctx.add("orders", rows).save()
    ctx.add("orders", rows.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), mode="merge")
    ctx.delete("orders", rows.where("o_orderkey % 7 = 0"))
    ctx.save()
    ctx.update("orders", rows.where("o_orderkey % 50 = 0").select("o_orderpriority", "o_orderkey", F.lit(1).cast("long").alias("o_custkey"))).save()
    return ctx


_AFTER = "(SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)"


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_AFTER}")
def context_save(spark, sf):
    return _saved(spark, sf).query("orders").select("o_orderkey", "o_custkey", "o_totalprice").df()


_KEY_ORDER = "o_orderpriority DESC, o_orderkey::VARCHAR DESC"


# after each save: first what it wrote, then whom the index had, then the largest key
@query(f"""WITH one AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority, o_orderkey::VARCHAR)) AS had FROM orders GROUP BY o_custkey),
two AS (SELECT o_custkey, o_orderkey AS had FROM (SELECT o.*, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey % 5 = 0 DESC, had IS NOT NULL DESC, {_KEY_ORDER}) AS nth
 FROM orders o LEFT JOIN one ON one.o_custkey = o.o_custkey AND had = o_orderkey WHERE o_orderkey % 7 <> 0) WHERE nth = 1)
SELECT o_custkey, o_orderkey FROM (SELECT a.*, row_number() OVER (PARTITION BY a.o_custkey ORDER BY o_orderkey % 50 = 0 DESC, had IS NOT NULL DESC, {_KEY_ORDER}) AS nth
 FROM {_AFTER} a LEFT JOIN two ON two.o_custkey = a.o_custkey AND had = o_orderkey) WHERE nth = 1""")
def context_index(spark, sf):
    """Whom the index refers to: the last written row of each customer."""
    ctx = _saved(spark, sf)
    hits = ctx.table("salesByCustomer").select(F.regexp_extract("PartitionKey", "__([0-9]*)$", 1).cast("long").alias("o_custkey"), F.col("RefRowKey").cast("long").alias("o_orderkey"))
    return hits


@query("""SELECT o_orderkey, 1::BIGINT AS save, concat_ws(',', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate') AS changed, false AS deleted FROM orders WHERE o_orderkey % 10 = 0
 UNION ALL SELECT o_orderkey, 2::BIGINT, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'o_totalprice' END, o_orderkey % 7 = 0 FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 10 = 0
 UNION ALL SELECT o_orderkey, 3::BIGINT, 'o_custkey', false FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey % 7 <> 0 AND o_custkey <> 1""")
def context_revisions(spark, sf):
    """What the saves changed of tracked rows."""
    rows = _saved(spark, sf).table("salesRevisions")
    saves = sorted(r["saved"] for r in rows.select("saved").distinct().collect())  # three
    number = F.array_position(F.array(*[F.lit(s) for s in saves]), F.col("saved"))
    return rows.select("o_orderkey", number.cast("long").alias("save"), "changed", "deleted")


@query("SELECT o_custkey, max(o_totalprice) AS top, count(*) AS n FROM orders WHERE o_custkey = 7 GROUP BY o_custkey")
def cascade_update(spark, sf):
    """A customer's update takes the rows of a collection along."""
    parent = CUSTOMER.with_collection("orders", "orders", {"o_custkey": "c_custkey"})
    ctx = Context(spark, _scratch(spark), [parent, Entity("orders", ORDERS.schema).with_keys(["o_custkey"], ["o_orderkey"])])
    ctx.create_tables()
    customers, orders = root(spark, sf, CUSTOMER).df(), root(spark, sf, ORDERS).df()
    ctx.add("customer", customers).save()
    ctx.update("customer", customers.where("c_custkey = 7"), {"orders": orders.where("o_custkey = 7")}).save()
    return ctx.collection("customer", "orders", {"c_custkey": 7}).groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) > 0 AS found, (SELECT count(*) FROM customer WHERE c_custkey < 0) > 0 AS missing")
def exists_rows(spark, sf):
    q = root(spark, sf, CUSTOMER)
    return spark.createDataFrame([(q.exists(m("c_acctbal") > 0.0), q.exists(m("c_custkey") < 0))], "found boolean, missing boolean")


@query("SELECT c_custkey, c_name || '/' || c_mktsegment || '/' || c_nationkey::VARCHAR AS title FROM customer")
def composite_property(spark, sf):
    """A property composed of the entity and of its bag of further columns."""
    rows = root(spark, sf, CUSTOMER).df().select("c_custkey", "c_name", F.col("c_mktsegment").alias("title__segment"), F.col("c_nationkey").alias("title__nation"))
    return props.compose_entity(rows, "title", lambda e, bag: F.concat_ws("/", e["c_name"], bag["segment"], bag["nation"])).select("c_custkey", "title")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def etag_check(spark, sf):
    """Rows whose tags are current or any; a stale tag would fail."""
    rows = root(spark, sf, CUSTOMER).df()
    sent = rows.where("c_custkey % 3 <> 0").withColumn("ETag", F.when(F.col("c_custkey") % 3 == 1, write.etag(rows)).otherwise(F.lit("*")))
    return write.check_etags(rows, sent, ["c_custkey"]).select("c_custkey")


@query("SELECT user_id, max(ts) AS ts, count(*) FILTER (false) AS late FROM events GROUP BY user_id")
def streamed_upsert(spark, sf):
    """A stream of events, the newest of each user first and older ones after, leaves the
    newest event of each user."""
    folder = _scratch(spark)
    rows = root(spark, sf, EVENTS).df()
    for part, those in enumerate((F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1)):
        rows.where(those).coalesce(1).write.parquet(f"{folder}/in/{part}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        upsert.run_available(upsert.upsert(stream, f"{folder}/out", ["user_id"], order="ts"), f"{folder}/state")
    return upsert.latest(spark, f"{folder}/out").select("user_id", "ts", F.lit(0).cast("long").alias("late"))
