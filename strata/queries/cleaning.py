"""Cleaning, schema checks, lookups and aggregates. The tables are clean, so dirt is added by key arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.checkpoints import scratch_path
from strata.operators import clean, quality, relate
from strata.queries.registry import query, table
from strata.sinks import gold


@query(
    "drop_missing",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0",
)
def drop_missing(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    dirty = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")))
    return clean.drop_missing(dirty, ["o_custkey"])


def _text_orders(spark, sf):
    """Orders as they land: everything is text, and every eleventh key is no number."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 11 == 0, "abc").otherwise(key.cast("string")).alias("id"),
        F.when(key % 13 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        (key % 2 == 0).cast("string").alias("even"),
    )


@query(
    "cast_lenient",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS id,
           CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS customer,
           o_orderdate AS created_at,
           o_orderkey % 2 = 0 AS even
    FROM orders
    """,
)
def cast_lenient(spark, sf):
    schema = {"id": "int", "customer": "float", "created_at": "datetime64[ns]", "even": "bool", "absent": "int"}
    return clean.cast_columns(_text_orders(spark, sf), schema, "lenient")


@query(
    "cast_strict",
    "SELECT o_orderkey, o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 11 <> 0",
)
def cast_strict(spark, sf):
    good = _text_orders(spark, sf).filter("id <> 'abc'").select("o_orderkey", "id", "created_at")
    return clean.cast_columns(good, {"id": "integer", "created_at": "datetime64[ns]"}, "strict")


@query(
    "standardize_dates",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS ordered
    FROM orders
    """,
)
def standardize_dates(spark, sf):
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    mixed = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 17 == 0, "n/a")
        .when(key % 3 == 0, F.date_format(at, "yyyy-MM-dd"))
        .when(key % 3 == 1, F.date_format(at, "MM/dd/yyyy"))
        .otherwise(F.date_format(at, "dd MMM yyyy"))
        .alias("ordered"),
    )
    return clean.standardize_dates(mixed, ["ordered"], ["yyyy-MM-dd", "MM/dd/yyyy", "dd MMM yyyy"])


@query(
    "derive_date_parts",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created_date,
           CAST(year(o_orderdate) AS INTEGER) AS created_year
    FROM orders
    """,
)
def derive_date_parts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    parts = clean.derive_date_parts(orders)
    return parts.select("o_orderkey", F.col("created_date").cast("string").alias("created_date"), "created_year")


@query(
    "filter_rows",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice > 1000
    """,
)
def filter_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return clean.filter_rows(orders, "o_orderstatus = 'F' and o_totalprice > 1000")


@query(
    "derive_columns",
    """
    SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS c, (l_partkey + l_suppkey) * 2 AS d
    FROM lineitem
    """,
)
def derive_columns(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return clean.derive_columns(lines, {"c": "l_partkey + l_suppkey", "d": "c * 2"}).drop("l_partkey", "l_suppkey")


@query("drop_duplicates_rows", "SELECT DISTINCT text, lang, source FROM documents")
def drop_duplicates_rows(spark, sf):
    return clean.drop_duplicates(table(spark, sf, "documents").select("text", "lang", "source"))


@query(
    "drop_duplicates_by_key",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    FROM (
      SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n
      FROM lineitem)
    WHERE n = 1
    """,
)
def drop_duplicates_by_key(spark, sf):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf, "lineitem").select(*columns, "l_shipdate")
    return clean.drop_duplicates(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).select(*columns)


@query(
    "project_to_schema",
    """
    SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone, CAST(c_nationkey AS DOUBLE) AS c_nationkey
    FROM customer
    """,
)
def project_to_schema(spark, sf):
    schema = {"c_custkey": "int", "c_name": "str", "c_phone": "str", "c_nationkey": "float"}
    return clean.project_to_schema(table(spark, sf, "customer"), schema, on_missing="null")


@query(
    "add_audit_columns",
    """
    SELECT o_orderkey, TIMESTAMP '2024-03-01 00:00:00' AS processed_date, '20240301000000' AS batch_id,
           'orders.parquet' AS source_file
    FROM orders
    """,
)
def add_audit_columns(spark, sf):
    orders = table(spark, sf, "orders")
    audited = clean.add_audit_columns(orders, "2024-03-01 00:00:00", "20240301000000", source_file=True)
    return audited.select("o_orderkey", "processed_date", "batch_id", "source_file")


# The wanted schema of customers: one column is absent, two have another type.
CUSTOMER_SCHEMA = {"c_custkey": "int", "c_phone": "str", "c_name": "int", "c_acctbal": "float", "c_nationkey": "str"}


@query(
    "check_schema",
    """
    SELECT m.*, t.n_rows FROM (SELECT count(*) AS n_rows FROM customer) t, (VALUES
      (2, 'c_phone', 'str', '', 'Missing column: c_phone'),
      (3, 'c_name', 'int', 'string', 'c_name: expected int, got string'),
      (5, 'c_nationkey', 'str', 'int', 'c_nationkey: expected str, got int')
    ) m(position, "column", expected, actual, message)
    """,
)
def check_schema(spark, sf):
    return quality.check_schema(table(spark, sf, "customer"), CUSTOMER_SCHEMA)


@query(
    "profile_schema",
    """
    WITH t AS (
      SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 11 = 0) AS bad_ids,
             count(*) FILTER (o_orderkey % 13 = 0) AS bad_customers
      FROM orders)
    SELECT 'id' AS "column", 'int' AS expected, 'string' AS actual, n_rows, CAST(0 AS BIGINT) AS nulls,
           bad_ids AS bad_values, 'abc' AS example FROM t
    UNION ALL
    SELECT 'customer', 'int', 'string', n_rows, 0, bad_customers, 'n/a' FROM t
    UNION ALL
    SELECT 'absent', 'str', NULL, n_rows, n_rows, 0, NULL FROM t
    """,
)
def profile_schema(spark, sf):
    schema = {"id": "int", "customer": "int", "absent": "str"}
    return quality.profile_schema(_text_orders(spark, sf), schema)


@query(
    "enrich",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_retailprice, p_partkey IS NOT NULL AS priced
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON l_partkey = p_partkey
    """,
)
def enrich(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    prices = table(spark, sf, "part").filter("p_partkey % 10 <> 0").withColumnRenamed("p_partkey", "l_partkey")
    return relate.enrich(lines, prices, "l_partkey", ["p_brand", "p_retailprice"], matched="priced")


GOLD_SQL = """
    SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS created_year, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderkey % 11 <> 0
    GROUP BY ALL
    """


@query("gold_aggregate", GOLD_SQL)
def gold_revenue(spark, sf):
    """The flagship: text orders, cleaned and typed, looked up and summed up per nation and year."""
    key = F.col("o_orderkey")
    landed = table(spark, sf, "orders").select(
        F.when(key % 11 == 0, "abc").otherwise(key.cast("string")).alias("id"),
        F.col("o_custkey").cast("string").alias("c_custkey"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )
    schema = {"id": "int", "c_custkey": "int", "amount": "float", "created_at": "datetime64[ns]"}
    silver = clean.drop_missing(clean.cast_columns(landed, schema, "lenient"), ["id"])
    silver = clean.derive_date_parts(clean.project_to_schema(silver, schema))
    customers = table(spark, sf, "customer")
    nations = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    located = relate.enrich(silver, customers, "c_custkey", ["c_nationkey"])
    named = relate.enrich(located, nations, "c_nationkey", ["n_name"])
    return relate.gold_aggregate(
        named,
        ["n_name", "created_year"],
        {"n_orders": "count(*)", "revenue": "cast(sum(cast(amount as decimal(18, 2))) as double)"},
    )


@query(
    "gold_increments",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS n_orders, count(o_clerk_code) AS n_coded,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, min(o_orderdate) AS first_order,
           max(o_totalprice) AS largest, round(avg(o_custkey), 6) AS mean_customer
    FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS o_clerk_code FROM orders)
    GROUP BY ALL
    """,
)
def gold_in_batches(spark, sf):
    """Batches of orders as they land; one was wrong and runs again, one runs again after its states were merged with others."""
    path, key = scratch_path(spark, "gold"), F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderdate", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.when(key % 3 == 0, F.col("o_custkey")).alias("code"),
        (key % 4).alias("batch"),
    )
    table_of = gold.Gold(
        ("year", "o_orderpriority"),
        {
            "n_orders": ("count", "*"), "n_coded": ("count", "code"), "revenue": ("sum", "cast(o_totalprice as decimal(18, 2))"),
            "first_order": ("min", "o_orderdate"), "largest": ("max", "o_totalprice"), "mean_customer": ("avg", "o_custkey"),
        },
    )
    gold.put_batch(path, orders.filter("batch < 2"), table_of, "1")
    for b in (0, 2, 3, 1):
        gold.put_batch(path, orders.filter(F.col("batch") == b), table_of, str(b))
    gold.compact_gold(spark, path, table_of)
    gold.put_batch(path, orders.filter("batch = 2"), table_of, "2")
    read = gold.read_gold(spark, path, table_of)
    return read.withColumns({"revenue": F.col("revenue").cast("double"), "mean_customer": F.round("mean_customer", 6)})
