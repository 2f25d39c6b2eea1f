"""A corpus of reports made from the star schema, in which publishers disagree in known ways.

One document a publisher and nation. The truth table beside it says which figures a text states,
so results can be held against numbers instead of text. Nations are called `Nationa` to `Nationy`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.facts import BLOCKS_TYPE
from .shared import table

MONEY = "decimal(18,2)"


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, entity, fy, orders, final, net, tax, lines, customers, n): amounts of each nation and Indian fiscal year, exact decimals."""
    # scanned where they lie: a sum costs less than dealing the rows out
    scan = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = scan("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast(MONEY).alias("total"), (F.year("o_orderdate") + (F.month("o_orderdate") >= 4).cast("int")).alias("fy"))
    # whole numbers inside an order, those of more orders as two halves that cannot overflow: exact
    whole = lambda n: F.round(F.col(n) * 100).cast("long")
    net = whole("l_extendedprice") * (100 - whole("l_discount"))
    gross = net * (100 + whole("l_tax"))
    lines = scan("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), net.alias("net"), gross.alias("gross")).groupBy("o_orderkey").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"))
    halves = {f"{n}_{h}": F.shiftright(n, 32) if h == "high" else F.col(n).bitwiseAND(F.lit(0xFFFFFFFF)) for n in ("net", "gross") for h in ("high", "low")}
    # orders meet their lines once; what goes on is a row for each customer and year
    of_customer = orders.join(lines, "o_orderkey", "left").groupBy("o_custkey", "fy").agg(
        F.sum("total").alias("orders"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("total"))).alias("final"), F.count("*").alias("n"), *[F.sum(x).alias(k) for k, x in halves.items()])
    first = F.row_number().over(Window.partitionBy("o_custkey", "nation").orderBy("nation")) == 1  # a customer written twice is one
    customer = scan("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")).withColumn("first", first)
    sums = of_customer.join(customer, "o_custkey").groupBy("nation", "fy").agg(
        *[F.sum(n).cast("decimal(28,2)").alias(n) for n in ("orders", "final")], F.count_if("first").alias("customers"), F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in halves])
    part = lambda k: F.col(k).cast("decimal(20,0)")
    exact = lambda n, digits: F.when(F.col("fy").isNotNull(), ((part(f"{n}_high") * F.lit(Decimal(1 << 32)) + part(f"{n}_low")) * F.lit(Decimal(1).scaleb(-digits))).cast(MONEY))
    by_year = sums.select("nation", "fy", "orders", "final", "customers", "n", exact("net", 4).alias("net"), exact("gross", 6).alias("lines")).withColumn("tax", F.col("lines") - F.col("net"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.concat(F.lit("Nation"), F.chr(F.col("n_nationkey") + 97)).alias("entity"))
    return by_year.join(names, "nation")


def _millions(c: str) -> Column:
    return F.format_number(F.round(F.col(c) / 1_000_000, 2), 2)


def _documents(per_year: DataFrame) -> DataFrame:
    """(publisher, entity, text, blocks): texts are paragraphs, blocks are given only where a text has a layout."""
    f = per_year
    sentence = lambda head, amount: F.concat(F.lit(f"{head} stood at ₹ "), _millions(amount), F.lit(" million in FY"), F.col("fy").cast("string"), F.lit("."))
    said = {
        "ledger": sentence("Consolidated revenue from operations", "orders"), "lines": sentence("Consolidated revenue from operations", "lines"),
        "solo": F.when(F.col("final").isNotNull(), sentence("Standalone revenue from operations", "final")),
        "prices": F.concat(F.lit("CPI inflation was "), F.format_number(F.col("n") % 90 / 10 + 1, 1), F.lit(" per cent in FY"), F.col("fy").cast("string"), F.lit(".")),
    }
    opening = F.concat_ws(" ", F.lit("Notes about"), *[F.col("entity")] * 6)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("fy", c.alias("x")))), lambda s: s["x"])
    kept = lambda a: F.filter(a, lambda x: x.isNotNull())
    parts = f.groupBy("entity").agg(
        *[in_order(x).alias(n) for n, x in said.items()],
        in_order(F.concat(F.lit("₹"), F.format_number(F.round(F.col("orders") / 100_000, 0), 0), F.lit(" lakh"))).alias("tile"),
        in_order(F.concat(F.lit("FY"), F.col("fy").cast("string"), F.lit(" Revenue from Services YoY"))).alias("tile_label"),
        in_order(F.concat(F.lit("FY"), F.col("fy").cast("string"))).alias("years"), F.max(F.struct("fy", "orders"))["orders"].alias("orders"),
        *[in_order(_millions(n)).alias(f"t_{n}") for n in ("net", "tax", "lines")],
        in_order(F.format_number("customers", 0)).alias("t_customers"), in_order(F.format_number(F.col("n") % 90 / 10 + 1, 1)).alias("t_rate"),
    )
    named = lambda label, cells: F.concat_ws("\n", F.lit(label), F.col(cells))
    tables = F.array(opening, F.array_join("years", "\n"), named("Revenue from operations (₹ in million)", "t_net"), named("Other income (₹ in million)", "t_tax"), named("Total income (₹ in million)", "t_lines"))
    counts = F.array(opening, F.array_join("years", "\n"), named("Team size", "t_customers"), named("CPI inflation", "t_rate"))
    tiles = F.concat(F.array(opening), F.flatten(F.transform(F.arrays_zip("tile", "tile_label"), lambda z: F.array(z["tile"], z["tile_label"]))))
    plain = {n: F.concat(F.array(opening), kept(F.col(n))) for n in said} | {"undated": F.array(opening, F.concat(F.lit("Revenue from operations stood at ₹ "), _millions("orders"), F.lit(" million.")))}
    made = [(n, p, False) for n, p in plain.items()] + [("deck", tiles, True), ("table", tables, True), ("counts", counts, True)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("publisher"), p.alias("parts"), F.lit(b).alias("laid_out")) for n, p, b in made])).alias("d")
    rows = parts.select("entity", each).select("entity", "d.*")
    text = F.array_join("parts", "\n\n")
    # the opening is no block: tiles would read it as a label
    block = F.transform(F.slice("parts", 2, F.size("parts")), lambda p, i: F.struct((i + 1).cast("int").alias("block_no"), p.alias("text"), (i * 1000).cast("int").alias("char_start"), (i * 1000).cast("int").alias("char_end")))
    return rows.select("publisher", "entity", text.alias("text"), F.when(F.col("laid_out"), block).otherwise(F.array().cast(BLOCKS_TYPE)).cast(BLOCKS_TYPE).alias("blocks"))


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, document_name, ingest_seq, page, text, blocks): one page a document; ingest_seq is the order of names."""
    docs = _documents(figures(spark, sf_dir)).withColumn("document_name", F.concat("publisher", F.lit("-"), F.lower("entity"), F.lit(".txt")))
    publishers = ["counts", "deck", "ledger", "lines", "prices", "solo", "table", "undated"]
    rank = F.array_position(F.array(*map(F.lit, publishers)), F.col("publisher")) * 100 + F.ascii(F.substring(F.col("entity"), 7, 1)) - 97
    return docs.select(F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(16)).alias("document_id"), "document_name", rank.cast("long").alias("ingest_seq"), F.lit(1).alias("page"), "text", "blocks", "publisher")
