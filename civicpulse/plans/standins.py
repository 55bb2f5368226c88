"""The test tables, projected to the tables the operators take.

Money is kept as a decimal, so that sums do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.functions.dates import month_label, utc_day
from civicpulse.functions.fixed_values import SUMMARY_PREFIXES
from civicpulse.operators.regions import region_code_table

# Codes of four of the five regions: the fifth is on no map.
MAP_CODES = {"AFRICA": "R0", "AMERICA": "R1", "ASIA": "R2", "EUROPE": "R3"}
# What a response starts with, by conversation turn: a phrase to remove, or nothing.
RESPONSE_OPENINGS = [*SUMMARY_PREFIXES, ""]
# The longitude from which a point of a boundary feature counts as unreadable.
UNREADABLE_FROM = 0.25


# Columns of the test tables: given here, so that no file is opened to find them.
TABLE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select("n_nationkey", "n_name", F.col("r_name").alias("region"))


def trend_long(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders as interest: priority is the topic, the customer's region the place."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    regions = _nation_regions(spark, sf_dir)
    return placed.join(regions, placed.c_nationkey == regions.n_nationkey).select(
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("topic_name"),
        "region",
        F.initcap("region").alias("region_name"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("interest_value"),
        F.col("o_orderkey").alias("row_id"),
    )


def shipment_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity as interest: (date, region, value) by the supplier's region."""
    lineitem = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(
        F.sum("l_quantity").alias("quantity")
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
    regions = _nation_regions(spark, sf_dir)
    return placed.join(regions, placed.s_nationkey == regions.n_nationkey).select(
        F.to_date("l_shipdate").alias("date"), "region", F.col("quantity").alias("interest_value")
    )


def topic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("event_type").alias("topic"), F.to_date("ts").alias("date")
    ).agg(F.count("*").alias("value"))


def region_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and nation of the user."""
    # Counted per user first: the join then sees one row per user and type.
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").count()
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = users.join(customer, users.user_id == customer.c_custkey)
    regions = _nation_regions(spark, sf_dir)
    return (
        placed.join(regions, placed.c_nationkey == regions.n_nationkey)
        .groupBy(F.col("event_type").alias("topic"), F.col("n_name").alias("region"))
        .agg(F.sum("count").alias("interest"))
    )


def related_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type, kind (by value) and property."""
    kind = F.when(F.col("value") >= 10, "rising").otherwise("top")
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("topic"),
            kind.alias("kind"),
            F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("query"),
        )
        .agg(F.count("*").alias("value"))
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        created.alias("created_at"),
        utc_day(created).alias("day"),
        month_label(created).alias("month"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        F.concat("props", F.lit("\nno. "), F.col("event_id").cast("string")).alias("text"),
        F.round(F.col("value") * 100).cast("long").alias("likes"),
        F.col("user_id").alias("reposts"),
        F.col("event_id").alias("replies"),
    )


def map_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shape per region."""
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("region_code"),
        F.col("r_name").alias("region_name"),
    )


def map_codes(spark: SparkSession) -> DataFrame:
    return region_code_table(spark, MAP_CODES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as boundary features: every two numbers are a point of a ring.

    Even vectors are multi-polygons of two rings, odd ones polygons of the first ring; the label
    gives the code, so codes repeat. Coordinates are text, as in a file.
    """
    vector = F.col("embedding")

    def point(i: Column) -> Column:
        lon, lat = vector[2 * i].cast("double"), vector[2 * i + 1].cast("double")
        # Some points lack a coordinate, some have one that is no finite number.
        odd = F.col("vec_id") % 5
        whole = (
            F.when((i == 3) & (odd == 1), F.array(lon))
            .when((i == 5) & (odd == 2), F.array(lon, F.lit(float("nan"))))
            .when((i == 6) & (odd == 3), F.array(F.lit(float("inf")), lat))
            .otherwise(F.array(lon, lat))
        )
        return F.when(lon < UNREADABLE_FROM, whole)

    number = F.floor(F.size(vector) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), number - 1), point)
    cut = (F.col("vec_id") % 17 + 8).cast("int")
    first = F.slice("points", 1, cut)
    second = F.slice("points", cut + 1, F.size("points"))
    multi = F.col("vec_id") % 2 == 0
    label = F.col("label").cast("string")
    return table(spark, sf_dir, "embeddings").withColumn("points", points).select(
        F.lit("embeddings").alias("file_name"),
        F.col("vec_id").alias("feature_pos"),
        F.create_map(
            F.lit("CTRY24CD"), F.when(F.col("label") < 5, F.concat(F.lit("R"), label)).otherwise(""),
            F.lit("RGN24CD"), F.concat(F.lit("R"), label),
            F.lit("RGN24NM"), F.concat(F.lit("Region "), F.col("vec_id").cast("string")),
        ).alias("properties"),
        F.struct(
            F.when(multi, "MultiPolygon").otherwise("Polygon").alias("type"),
            F.when(multi, F.to_json(F.array(F.array(first), F.array(second))))
            .otherwise(F.to_json(F.array(first)))
            .alias("coordinates"),
        ).alias("geometry"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: copies of a text share its URL."""
    return table(spark, sf_dir, "documents").select(
        F.md5("text").alias("url"),
        F.col("lang").alias("title"),
        F.col("source").alias("search_query"),
        F.col("doc_id").alias("pos"),
    )


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles, each found by two searches."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    found = table(spark, sf_dir, "pages").select("url", title.alias("title"), F.col("page_id").alias("pos"))
    twice = F.array(
        F.struct(F.lit("broad").alias("search_query"), F.col("title")),
        F.struct(F.lit("narrow").alias("search_query"), F.concat(F.lit("Narrow: "), "title").alias("title")),
    )
    return found.select("url", "pos", F.inline(twice))


def _body(text: Column) -> Column:
    content = F.struct(F.lit("text").alias("type"), text.alias("text"))
    return F.to_json(F.struct(F.array(content).alias("content")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as responses; one in eight has no opening phrase."""
    openings = F.array(*[F.lit(p) for p in RESPONSE_OPENINGS])
    opening = F.get(openings, (F.col("turn") % len(RESPONSE_OPENINGS)).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.format_string("%d/%d", "conv_id", "turn").alias("url"),
        _body(F.concat(opening, F.lit(" \n"), "text", F.lit("\n"))).alias("body"),
    )


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for every page, made of its title."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        "url", _body(F.concat(F.lit(f"{SUMMARY_PREFIXES[0].upper()} "), title)).alias("body")
    )


def label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for every labelled document."""
    text = F.concat(F.lit(f"{SUMMARY_PREFIXES[4]} quality "), F.col("quality").cast("string"))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("url"), _body(text).alias("body")
    )


def speech_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML document per conversation turn, one speech per line of its text."""

    def escape(text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    speech = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit('<speech line="'), i.cast("string"), F.lit('" turn="own"><p>'), escape(line),
            F.lit("<i>aside</i> after</p><p>second</p></speech>"),
        ),
    )
    return table(spark, sf_dir, "conversations").select(
        F.format_string("%d-%d.xml", "conv_id", "turn").alias("file_name"),
        F.concat(
            F.format_string('<debate conv="%d" turn="%d" role="%s"><group>', "conv_id", "turn", "role"),
            F.array_join(speech, ""), F.lit("</group></debate>"),
        ).alias("content"),
    )
