"""Entity-level inputs derived from the driver tables (see FIXTURES.md).

Each builder is a DataFrame-API plan over the Parquet scans, so its work
grows with the tables; constants such as 1.6 only spread entities over the
bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.functions.fixed import REVENUE_SCENARIOS, EXPENSE_SCENARIOS, COMBINED_SCENARIOS
from ledgerlake.sources.tables import Tables


def _month(c) -> F.Column:
    return F.to_date(F.date_trunc("month", c))


def position_facts(t: Tables) -> DataFrame:
    """Per-customer fact columns before the rollup: flows from lines, balances from orders."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    balances = o.groupBy("o_custkey").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.lit(0.0))).alias("collected"),
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(F.lit(0.0))).alias("open_amt"))
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    p = t.part.select("p_partkey", "p_retailprice")
    flow = (li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(p, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy("o_custkey").agg(
                  F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                  F.sum(F.lit(1.6) * F.col("l_quantity") * F.col("p_retailprice")
                        + F.col("l_extendedprice") * F.col("l_tax")).alias("expenses")))
    c = t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    return (c.join(balances, F.col("entity_id") == balances.o_custkey, "left").drop("o_custkey")
             .join(flow, F.col("entity_id") == flow.o_custkey, "left").drop("o_custkey"))


def positions(t: Tables) -> DataFrame:
    """positions(entity_id, segment, revenue, expenses, liabilities, cash)."""
    from ledgerlake.operators.positions import rollup_positions
    f = position_facts(t).select(
        "entity_id", "segment", "revenue", "expenses",
        (F.coalesce(F.col("open_amt"), F.lit(0.0)) * 0.5).alias("liabilities"),
        F.col("collected").alias("cash"))
    return rollup_positions(f, by=["entity_id", "segment"])


def series(t: Tables) -> DataFrame:
    """series(entity_id, ds, y): monthly supplier revenue over all of lineitem."""
    li = t.lineitem
    return (li.groupBy(F.col("l_suppkey").alias("entity_id"), _month(F.col("l_shipdate")).alias("ds"))
              .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y")))


def supplier_flows(t: Tables) -> DataFrame:
    """supplier_flows(entity_id, ds, revenue, expenses) per supplier."""
    li = t.lineitem.select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return (li.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
              .groupBy(F.col("l_suppkey").alias("entity_id"), _month(F.col("l_shipdate")).alias("ds"))
              .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                   F.sum(F.lit(1.3) * F.col("l_quantity") * F.col("p_retailprice")
                         + F.col("l_extendedprice") * F.col("l_tax")).alias("expenses")))


def monthly_flows(t: Tables) -> DataFrame:
    """monthly_flows(entity_id, ds, revenue, expenses) per supplier nation."""
    li = t.lineitem.select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
                           "l_tax", "l_shipdate")
    return (li.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
              .join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
              .groupBy(F.col("s_nationkey").alias("entity_id"),
                       _month(F.col("l_shipdate")).alias("ds"))
              .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                   F.sum(F.lit(1.9) * F.col("l_quantity") * F.col("p_retailprice")
                         + F.col("l_extendedprice") * F.col("l_tax")).alias("expenses")))


def messy(t: Tables) -> DataFrame:
    """messy(row_id, amount_text, date_text, note, blank, revenue, expenses, cash): some rows are repeated, some
    amounts are in brackets or have exponents, some revenues are negative, some cash is beyond 1e10."""
    k = F.col("o_orderkey")
    price_text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    d = F.col("o_orderdate").cast("string")
    base = t.orders.select(
        k.alias("row_id"),
        F.when(k % 50 == 0, F.lit("n/a")).when(k % 11 == 0, F.lit(None).cast("string"))
         .when(k % 23 == 0, F.concat(F.lit("("), price_text, F.lit(")"))).when(k % 37 == 0, F.concat(price_text, F.lit("e2")))
         .when(k % 3 == 0, F.concat(F.lit("$"), price_text)).otherwise(price_text).alias("amount_text"),
        F.when(k % 3 == 0, F.substring(d, 1, 10))
         .when(k % 3 == 1, F.concat(F.substring(d, 6, 2), F.lit("/"), F.substring(d, 9, 2), F.lit("/"),
                                    F.substring(d, 1, 4)))
         .otherwise(F.substring(d, 1, 7)).alias("date_text"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("note"),
        F.lit(None).cast("string").alias("blank"),
        F.when(k % 97 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("revenue"),
        F.when(k % 13 == 0, F.col("o_totalprice") * 1.2).otherwise(F.col("o_totalprice") * 0.7).alias("expenses"),
        F.when(k % 1009 == 0, F.col("o_totalprice") * 1e6).when(k % 17 == 0, F.col("o_totalprice") * 2.0).otherwise(F.col("o_totalprice") * 0.1).alias("cash"))
    return base.unionByName(base.where(F.col("row_id") % 20 == 0))


def messy_all(t: Tables) -> DataFrame:
    """``messy`` and some rows whose every cell is NULL."""
    m = messy(t)
    return m.unionByName(m.where(F.col("row_id") % 500 == 0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in m.dtypes]))


def segment_pnl(t: Tables) -> DataFrame:
    """segment_pnl(entity_id, business, gov, adj_revenue, adj_ebitda) as dirty text."""
    j = (t.lineitem.select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
         .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
         .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")))
    g = j.groupBy("s_nationkey", "p_type").agg(
        F.sum(F.expr("CAST(l_quantity * 900 AS DECIMAL(18,2))")).alias("gov"),
        F.sum(F.expr("CAST(l_extendedprice AS DECIMAL(18,2))")).alias("rev"),
        F.sum(F.expr("CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity * 1700 AS DECIMAL(18,2))")).alias("ebitda"))
    rs = lambda c: F.concat(F.lit("Rs "), F.col(c).cast("string"))
    return g.select(
        F.col("s_nationkey").alias("entity_id"), F.col("p_type").alias("business"),
        rs("gov").alias("gov"), rs("rev").alias("adj_revenue"),
        F.when((F.col("s_nationkey") % 9 == 0) & (F.col("p_type") == "ECONOMY"), F.lit("-"))
         .otherwise(rs("ebitda")).alias("adj_ebitda"))


def esg_ratings(t: Tables) -> DataFrame:
    """esg_ratings(entity_id, environmental, social, governance): one row per rating."""
    return (t.lineitem.select("l_suppkey", "l_partkey", "l_discount")
            .join(t.supplier.select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("s_suppkey").alias("entity_id"),
                    (F.col("p_size").cast("double") / 50).alias("environmental"),
                    (1 - 5 * F.col("l_discount")).alias("social"),
                    ((F.col("s_acctbal") + 1000) / 11000).alias("governance")))


def scenarios(spark: SparkSession) -> DataFrame:
    """The default stress scenarios as a parameter table (fixed, 11 rows)."""
    rows = [(i + 1, n, r, e) for i, (n, r, e) in
            enumerate(REVENUE_SCENARIOS + EXPENSE_SCENARIOS + COMBINED_SCENARIOS)]
    return spark.createDataFrame(rows, "scenario_id int, name string, revenue_change int, expense_change int")


def questions(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    q = (F.when(k % 5 == 0, "What is my profit margin?").when(k % 5 == 1, "How long is our cash runway?")
          .when(k % 5 == 2, "Is our DEBT too high?").when(k % 5 == 3, "Profit and debt outlook?")
          .otherwise("What should we do next?"))
    return t.customer.select(k.alias("q_id"), k.alias("entity_id"), q.alias("question"))


def cells(t: Tables) -> DataFrame:
    """cells(doc_id, page, strategy, table_no, row_idx, col_idx, text): a raw cell grid per order.

    Some documents have more tables: one too short on an earlier page, a second one on the page, one on the next
    page, and the same page read by the other strategy.
    """
    # named doc_id before the lines are dealt out by it, so that the cells are known to lie by document
    li = t.lineitem.withColumnRenamed("l_orderkey", "doc_id")
    w = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = li.select("doc_id", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", (F.row_number().over(w) + 1).alias("row_idx"))
    headers = ["Line", "Part", "Quantity", "Flag"]
    cell = lambda r, i, text: F.struct(r.alias("row_idx"), F.lit(i).alias("col_idx"), text.alias("text"))
    # title row (row 0) and header row (row 1) go out with a document's first line, so the lines are dealt out once
    top = [cell(F.lit(0), i, F.lit("Order lines" if i == 0 else "  ")) for i in range(4)]
    top += [cell(F.lit(1), i, F.lit(h)) for i, h in enumerate(headers)]
    texts = [F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"),
             F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_returnflag"))]
    own = F.array(*[cell(F.col("row_idx"), i, text) for i, text in enumerate(texts)])
    grid = li.select("doc_id", F.explode(F.when(F.col("row_idx") == 2, F.concat(F.array(*top), own)).otherwise(own)).alias("c")).select(
        "doc_id", "c.row_idx", "c.col_idx", "c.text")
    k, row = F.col("doc_id"), F.col("row_idx")
    page, even = 1 + k % 30, k % 2 == 0
    strategy = F.when(even, "lattice").otherwise("stream")
    place = lambda p, s, n: F.struct(p.cast("bigint").alias("page"), s.alias("strategy"), F.lit(n).alias("table_no"))
    places = F.array(
        place(page, strategy, 0),
        F.when((k % 4 == 0) & (row <= 1), place(F.lit(0), F.lit("lattice"), 0)),
        F.when(k % 30 == 0, place(page, strategy, 1)),
        F.when(k % 25 == 0, place(page + 1, F.lit("stream"), 0)),
        F.when(k % 35 == 0, place(page, F.when(even, "stream").otherwise("lattice"), 0)))
    return grid.select("*", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("at")).select(
        "doc_id", "at.page", "at.strategy", "at.table_no", "row_idx", "col_idx",
        F.when((F.col("at.table_no") == 1) & (row == 1), F.upper("text")).otherwise(F.col("text")).alias("text"))


def features(t: Tables) -> DataFrame:
    """features(row_id, x1..x4); x2 has nulls."""
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_quantity").alias("x1"),
        F.when(F.col("l_orderkey") % 19 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("x2"),
        F.col("l_discount").alias("x3"), F.col("l_tax").alias("x4"))


def customer_series(t: Tables) -> DataFrame:
    """Monthly order value per customer: the growth input for health scores."""
    return (t.orders.groupBy(F.col("o_custkey").alias("entity_id"),
                             _month(F.col("o_orderdate")).alias("ds"))
            .agg(F.sum("o_totalprice").alias("y")))
