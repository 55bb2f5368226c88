"""Registered queries: each runs one operator over whole test tables.

Ranked reports keep their limit, everything else returns all rows. Nested results are flattened,
so that they can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.functions import dates
from civicpulse.functions.fixed_values import REFERENCE_EVENTS
from civicpulse.operators import (
    frames,
    geo,
    news,
    posts,
    profile,
    quality,
    regions,
    reshape,
    rollup,
    series,
    speeches,
    states,
    topk,
)
from civicpulse.plans import reports, standins
from civicpulse.session import literal_table, prepare, scratch_path
from civicpulse.sources.articles import read_articles
from civicpulse.sources.boundaries import read_boundaries, with_polygons
from civicpulse.sources.posts import read_posts
from civicpulse.sources.sinks import write_table
from civicpulse.sources.speeches import read_speeches
from civicpulse.sources.staged import read_loads, stage, write_load
from civicpulse.sources.trends import merge_trend_dir, read_counts, read_trend_long

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# One event within the dates of the series, one after them.
TIMELINE_EVENTS = [("Mid January", "2024-01-15"), *REFERENCE_EVENTS]
# A topic and a day with rows at every scale but the smallest.
SELECTED_TOPIC, SELECTED_DAY = "1-URGENT", "1997-07-10"
# A topic and a day whose only rows (at scale 0.01) are in the region that is on no map.
UNMAPPED_TOPIC, UNMAPPED_DAY = "2-HIGH", "1996-03-21"
# Size of files that one task reads whole.
ROWS_PER_FILE = 100_000


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)

    QUERIES[run.__name__] = prepared
    return run


# Regions ---------------------------------------------------------------------------------------


@query
def region_values_mean(spark, sf_dir):
    return regions.region_values(standins.trend_long(spark, sf_dir), "mean")


@query
def region_values_sum(spark, sf_dir):
    return regions.region_values(standins.trend_long(spark, sf_dir), "sum")


@query
def region_values_latest(spark, sf_dir):
    trends = standins.trend_long(spark, sf_dir)
    return regions.region_values(trends, "latest", keys=["topic_name"], tie="row_id")


@query
def region_values_latest_of_day(spark, sf_dir):
    return regions.region_values(standins.trend_long(spark, sf_dir), "latest")


@query
def select_topic_day(spark, sf_dir):
    orders = standins.table(spark, sf_dir, "orders")
    # The day as a range of times reaches the scan; a cast of the time column would not.
    start = F.lit(SELECTED_DAY).cast("timestamp_ntz")
    day = (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < start + F.expr("interval 1 day"))
    trends = standins.trend_long(spark, sf_dir, orders.filter(day))
    selected = regions.select_trends(trends, SELECTED_TOPIC, SELECTED_DAY)
    return topk.preview(selected, ["region", "row_id"])


@query
def region_lookup(spark, sf_dir):
    values = regions.region_values(standins.trend_long(spark, sf_dir), "mean")
    return regions.region_lookup(values, standins.map_codes(spark))


@query
def region_map_values(spark, sf_dir):
    values = regions.region_values(standins.trend_long(spark, sf_dir), "sum")
    return regions.region_map_values(values, standins.map_codes(spark))


@query
def choropleth(spark, sf_dir):
    return reports.region_map(
        standins.trend_long(spark, sf_dir), standins.map_shapes(spark, sf_dir), standins.map_codes(spark)
    )


@query
def choropleth_by_name(spark, sf_dir):
    values = regions.region_values(standins.trend_long(spark, sf_dir), "sum")
    named = values.withColumnRenamed("region", "region_name")
    return regions.choropleth_table(standins.map_shapes(spark, sf_dir), named, on="region_name")


@query
def choropleth_selected(spark, sf_dir):
    """A day with regions on and off the map, and one with no region on it."""
    trends, shapes = standins.trend_long(spark, sf_dir), standins.map_shapes(spark, sf_dir)
    chosen = [(SELECTED_TOPIC, SELECTED_DAY), (UNMAPPED_TOPIC, UNMAPPED_DAY)]
    mixed, unmapped = (
        reports.selected_map(trends, shapes, standins.map_codes(spark), topic, day).withColumn("day", F.lit(day))
        for topic, day in chosen
    )
    return mixed.unionByName(unmapped)


@query
def mapped_values(spark, sf_dir):
    """Every second row names its region by the code."""
    trends, codes = standins.trend_long(spark, sf_dir), standins.map_codes(spark)
    code = F.element_at(F.create_map(*[F.lit(x) for pair in standins.MAP_CODES.items() for x in pair]), F.col("region"))
    either = F.when(F.col("row_id") % 2 == 0, F.coalesce(code, F.col("region"))).otherwise(F.col("region"))
    trends = trends.withColumn("region", either)
    mean, total = (regions.mapped_values(trends, codes, how) for how in ("mean", "sum"))
    latest = regions.mapped_values(trends, codes, "latest", keys=["topic_name"], tie="row_id")
    named = [df.withColumn("how", F.lit(how)) for df, how in ((mean, "mean"), (total, "sum"), (latest, "latest"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def preview_topic(spark, sf_dir):
    trends = standins.trend_long(spark, sf_dir)
    return topk.preview(trends.filter(F.col("topic_name") == SELECTED_TOPIC), ["region", "row_id"])


# Reshape and quality ---------------------------------------------------------------------------


@query
def melt_measures(spark, sf_dir):
    lineitem = standins.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"
    )
    return reshape.melt_regions(
        lineitem,
        regions=["l_quantity", "l_discount", "l_tax"],
        ids=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        region_column="measure",
    )


@query
def union_columns(spark, sf_dir):
    customer = standins.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = standins.table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    nation = standins.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return reshape.union_sources(customer, supplier, nation)


def _untyped_trends(spark, sf_dir):
    number = F.col("event_id")
    value = (
        F.when(number % 10 == 0, "bad").when(number % 11 == 0, "NaN")
        .otherwise(F.col("value").cast("string"))
    )
    return standins.table(spark, sf_dir, "events").select(
        F.when(number % 13 == 0, "no date").otherwise(F.to_date("ts").cast("string")).alias("date"),
        F.col("event_type").alias("Program"),
        F.when(number % 7 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id") % 20)).alias("region"),
        value.alias("value"),
        number.alias("row_id"),
    )


@query
def lenient_cast(spark, sf_dir):
    return quality.normalise_trends(quality.missing_cells(_untyped_trends(spark, sf_dir)))


@query
def lenient_cast_clamped(spark, sf_dir):
    return quality.normalise_trends(quality.missing_cells(_untyped_trends(spark, sf_dir)), clamp=True)


@query
def date_labels(spark, sf_dir):
    day = F.to_date("o_orderdate")
    label = dates.month_label(day)
    return standins.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.week_start(day).alias("week_start"),
        dates.week_end(day).alias("week_end"),
        dates.month_key(day).alias("month_key"),
        label.alias("month_label"),
        dates.month_number(F.upper(label)).cast("long").alias("month_number"),
        dates.month_first(day).alias("month_first"),
        dates.month_next(day).alias("month_next"),
        dates.long_date(day).alias("long_date"),
        dates.iso_date(day).alias("iso_date"),
        dates.iso_minute(F.col("o_orderdate")).alias("iso_minute"),
    )


# Series ----------------------------------------------------------------------------------------


@query
def series_summary(spark, sf_dir):
    return series.series_summary(standins.topic_series(spark, sf_dir))


@query
def trend_direction(spark, sf_dir):
    return series.trend_direction(standins.topic_series(spark, sf_dir))


@query
def timeline(spark, sf_dir):
    return series.timeline_table(standins.topic_series(spark, sf_dir), TIMELINE_EVENTS)


@query
def annotate_events(spark, sf_dir):
    statistics = series.series_statistics(standins.topic_series(spark, sf_dir))
    return series.annotate_events(statistics, TIMELINE_EVENTS)


@query
def weekly_series(spark, sf_dir):
    return series.weekly_series(standins.trend_long(spark, sf_dir))


@query
def weekly_series_sparse(spark, sf_dir):
    return series.weekly_series(standins.trend_long(spark, sf_dir), dense=False)


@query
def monthly_rollup(spark, sf_dir):
    return rollup.monthly_rollup(_order_counts(spark, sf_dir))


def _order_counts(spark, sf_dir):
    orders = standins.table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("topic"), F.to_date("o_orderdate").alias("date")
    ).agg(F.count("*").alias("value"))


@query
def monthly_wide(spark, sf_dir):
    totals = rollup.monthly_rollup(standins.topic_series(spark, sf_dir))
    return rollup.monthly_wide(totals, ["click", "error", "purchase", "signup", "view"])


# Geography -------------------------------------------------------------------------------------


def _map_centroids(spark, sf_dir):
    return geo.centroids(with_polygons(standins.features(spark, sf_dir)))


@query
def centroids(spark, sf_dir):
    return _rounded_place(_map_centroids(spark, sf_dir))


def _rounded_place(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@query
def region_dimension(spark, sf_dir):
    return geo.region_dimension(standins.features(spark, sf_dir))


@query
def sparkline_series(spark, sf_dir):
    places = _map_centroids(spark, sf_dir)
    trends = standins.trend_long(spark, sf_dir)
    return _rounded_place(frames.sparkline_series(trends, places, standins.map_codes(spark)))


def _heat_points(spark, sf_dir):
    places = _map_centroids(spark, sf_dir)
    trends = standins.trend_long(spark, sf_dir)
    return frames.heat_points(trends, places, standins.map_codes(spark))


@query
def heat_frames_flat(spark, sf_dir):
    points = _rounded_place(_heat_points(spark, sf_dir))
    return points.withColumn("weight", F.round("weight", 6))


@query
def heat_frames(spark, sf_dir):
    built = frames.heat_frames(_heat_points(spark, sf_dir))
    codes = F.transform("points", lambda p: p["region_code"])
    peak = F.array_max(F.transform("points", lambda p: p["weight"]))
    return built.select(
        "topic_name", "week", "label", F.array_join(codes, ",").alias("codes"),
        F.size("points").cast("long").alias("n_points"), F.round(peak, 6).alias("peak"),
    )


# Profile ---------------------------------------------------------------------------------------


@query
def profile_trends(spark, sf_dir):
    return profile.profile_trends(standins.trend_long(spark, sf_dir))


@query
def region_pairs(spark, sf_dir):
    return profile.region_pairs(standins.trend_long(spark, sf_dir))


@query
def catalog_topics(spark, sf_dir):
    return profile.topic_catalog(standins.trend_long(spark, sf_dir))


@query
def catalog_dates(spark, sf_dir):
    return profile.date_catalog(standins.trend_long(spark, sf_dir))


@query
def coverage(spark, sf_dir):
    priorities = standins.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic_name"))
    segments = standins.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("topic_name"))
    requested = priorities.distinct().union(segments.distinct())
    trends = standins.trend_long(spark, sf_dir)
    return profile.coverage(trends, requested, standins.map_codes(spark))


@query
def series_summary_by_region(spark, sf_dir):
    trends = standins.trend_long(spark, sf_dir)
    daily = regions.region_values(trends, "sum")
    # Exact again, as a mean of doubles depends on the order of the rows.
    exact = daily.withColumn("value", F.col("interest_value").cast("decimal(28,2)"))
    return series.series_summary(exact, ["topic_name", "region"])


# Rankings --------------------------------------------------------------------------------------


@query
def top_regions(spark, sf_dir):
    return topk.top_regions(standins.region_interest(spark, sf_dir))


@query
def top_queries(spark, sf_dir):
    return topk.top_queries(standins.related_queries(spark, sf_dir))


@query
def top_posts(spark, sf_dir):
    all_posts = standins.posts(spark, sf_dir)
    # Every day of a topic, and the one after, which has no posts.
    span = all_posts.groupBy("topic").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = F.explode(F.sequence("first", F.date_add("last", 1)))
    requests = span.select("topic", days.alias("day"))
    return posts.top_posts(requests, all_posts).drop("created_at")


@query
def topic_report(spark, sf_dir):
    requested = standins.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    unseen = standins.table(spark, sf_dir, "region").select(F.col("r_name").alias("topic"))
    report = reports.topic_report(
        standins.topic_series(spark, sf_dir),
        standins.region_interest(spark, sf_dir),
        standins.related_queries(spark, sf_dir),
        requested=requested.union(unseen),
    )

    def listed(column: str, name: str, value: str):
        text = F.transform(column, lambda r: F.concat(r[name], F.lit("="), r[value].cast("string")))
        return F.array_join(text, ";").alias(column)

    return report.select(
        "topic", "geography", "average_interest", "peak_interest", "peak_date_label",
        "current_interest", "trend", "error", listed("top_regions", "region", "interest"),
        listed("top_queries", "query", "value"), listed("rising_queries", "query", "value"),
    )


# News and speeches -----------------------------------------------------------------------------


@query
def dedupe_articles(spark, sf_dir):
    return news.dedupe_articles(standins.articles(spark, sf_dir), queries=["src3", "src1"])


@query
def html_text(spark, sf_dir):
    return news.extract_text(standins.table(spark, sf_dir, "pages")).drop("error")


@query
def summary_requests(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents")
    # One text in ten is blank.
    content = F.when(F.col("doc_id") % 10 == 3, " \n ").otherwise(F.col("text"))
    return news.summary_requests(
        documents.select(F.col("doc_id").cast("string").alias("url"), content.alias("content"))
    )


@query
def summary_requests_of_all_texts(spark, sf_dir):
    """Every text, and as many articles without one, which get no request."""
    documents = standins.table(spark, sf_dir, "documents")
    blank = documents.select((-F.col("doc_id") - 1).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, " \n ").alias("text"))
    articles = documents.select("doc_id", "text").union(blank)
    return news.summary_requests(articles.select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content")))


@query
def clean_summaries(spark, sf_dir):
    return news.clean_summaries(standins.responses(spark, sf_dir))


@query
def attach_summaries(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("url"), F.col("source").alias("headline")
    )
    return news.attach_summaries(documents, standins.label_responses(spark, sf_dir))


@query
def news_digest(spark, sf_dir):
    pages = standins.table(spark, sf_dir, "pages")
    texts = reports.article_text(standins.page_articles(spark, sf_dir), pages, ["narrow", "broad"])
    return reports.news_digest(texts, standins.page_responses(spark, sf_dir))


@query
def speech_rows(spark, sf_dir):
    parsed = speeches.parse_speeches(standins.speech_documents(spark, sf_dir))
    return speeches.promote_attributes(parsed, ["conv", "line", "role", "turn"]).drop("error")


# Files: tables are written below the shared folder and read back -------------------------------


@query
def trend_dir_file(spark, sf_dir):
    """Two wide tables, each written on its own, merged by file name."""
    by_topic = {
        "orders": standins.trend_long(spark, sf_dir),
        "shipments": standins.shipment_trends(spark, sf_dir),
    }
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    topics, paths = {}, []
    for topic, trends in by_topic.items():
        wide = rollup.only_listed(trends, "region", names).groupBy("date").pivot("region", names).agg(F.sum("interest_value"))
        path = scratch_path(spark, topic)
        write_table(wide, path, "csv")
        written = spark.read.text(path).inputFiles()
        topics.update({name.rsplit("/", 1)[-1]: topic for name in written})
        paths.append(path)
    return merge_trend_dir(spark, paths, topics, names).drop("region_name")


@query
def trend_long_file(spark, sf_dir):
    renamed = {"topic_name": "Program", "interest_value": "value"}
    trends = standins.trend_long(spark, sf_dir).drop("region_name").withColumnsRenamed(renamed)
    path = scratch_path(spark, "trend-long")
    write_table(trends, path, "csv", partition_by=["region"])
    return read_trend_long(spark, path).withColumn("row_id", F.col("row_id").cast("long"))


def _post_cells(spark, sf_dir):
    """Some cells of likes are no count, and some times are no time."""
    number = F.col("replies")
    likes = (
        F.when(number % 7 == 0, "1e30").when(number % 7 == 1, "x").when(number % 7 == 2, "NaN")
        .otherwise(F.col("likes").cast("string"))
    )
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    created = F.when(number % 11 == 0, "soon").otherwise(time)
    return standins.posts(spark, sf_dir).drop("day").withColumns({"likes": likes, "created_at": created})


@query
def posts_file(spark, sf_dir):
    path = scratch_path(spark, "posts")
    write_table(_post_cells(spark, sf_dir), path, "csv", rows_per_file=ROWS_PER_FILE)
    return read_posts(spark, path).withColumn("created_at", dates.iso_minute(F.col("created_at")))


@query
def posts_large_file(spark, sf_dir):
    """All posts in one file, which every task reads a part of."""
    path = scratch_path(spark, "posts-large")
    write_table(_post_cells(spark, sf_dir).coalesce(1), path, "csv")
    read = read_posts(spark, path, large_files=True)
    return read.withColumn("created_at", dates.iso_minute(F.col("created_at")))


@query
def counts_file(spark, sf_dir):
    topics = ["click", "error", "purchase", "signup", "view"]
    series_rows = rollup.only_listed(standins.topic_series(spark, sf_dir), "topic", topics)
    wide = series_rows.groupBy("date").pivot("topic", topics).agg(F.sum("value"))
    path = scratch_path(spark, "counts")
    write_table(wide.withColumn("isPartial", F.lit(False)), path, "csv")
    return read_counts(spark, path)


def _feature_text():
    return F.concat(
        F.lit('{"properties":'), F.to_json("properties"), F.lit(',"geometry":{"type":"'), F.col("geometry.type"),
        F.lit('","coordinates":'), F.col("geometry.coordinates"), F.lit("}}"),
    )


@query
def boundaries_file(spark, sf_dir):
    """Feature collections of one feature each, one per line."""
    line = F.concat(F.lit('{"features":['), _feature_text(), F.lit("]}"))
    path = scratch_path(spark, "boundaries")
    standins.features(spark, sf_dir).select(line).write.text(path)
    read = read_boundaries(spark, path, multi_line=False)
    # Lines of a file have no order, so the name of a feature gives it.
    place = read.withColumn("order", F.split(F.col("properties")["RGN24NM"], " ")[1].cast("long"))
    return _rounded_place(geo.centroids(place, order=["order"]))


@query
def boundaries_large_file(spark, sf_dir):
    """One collection in one file, its features in order, which every task reads a part of."""
    features = standins.features(spark, sf_dir)
    line = F.concat(F.lit(","), _feature_text())
    edges = [(-2, '{"type":"FeatureCollection","features":[null'), (2**62, "]}")]
    lines = features.select("feature_pos", line.alias("line")).union(literal_table(spark, edges, ["feature_pos", "line"]))
    path = scratch_path(spark, "boundaries-large")
    lines.coalesce(1).sortWithinPartitions("feature_pos").select("line").write.text(path)
    return _rounded_place(geo.centroids(read_boundaries(spark, path, large_files=True)))


@query
def articles_file(spark, sf_dir):
    """One response per document, with none, one or two articles, in a folder per search query."""
    documents = standins.table(spark, sf_dir, "documents")
    numbers = F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    found = F.transform(numbers, lambda i: F.struct(
        F.concat(F.lit("https://news.example/"), F.col("doc_id"), F.lit("/"), i).alias("url"), F.col("text").alias("title")
    ))
    path = scratch_path(spark, "articles")
    responses = documents.select(F.col("source").alias("search_query"), found.alias("articles"))
    responses.write.partitionBy("search_query").json(path)
    return read_articles(spark, path, multi_line=False).select("search_query", "pos", "url", "title")


@query
def articles_of_all_texts_file(spark, sf_dir):
    """Every text is a title, in responses of one to three articles."""
    documents = standins.table(spark, sf_dir, "documents")
    numbers = F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)
    found = F.transform(numbers, lambda i: F.struct(
        F.concat(F.lit("https://news.example/"), F.col("doc_id"), F.lit("/"), i).alias("url"), F.col("text").alias("title")
    ))
    path = scratch_path(spark, "articles-all")
    responses = documents.select(F.col("source").alias("search_query"), found.alias("articles"))
    responses.write.partitionBy("search_query").json(path)
    return read_articles(spark, path, multi_line=False).select("search_query", "pos", "url", "title")


def _speeches_written(spark, sf_dir, name, files):
    """Path of conversation turns as speeches; ``files`` makes the writer's partitions and rows per file."""
    speech = standins.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"),
        F.col("text").alias("p"),
    )
    path = scratch_path(spark, name)
    writer = files(speech).format("xml")
    writer.option("rootTag", 'debate source="turns"').option("rowTag", "speech").save(path)
    return path


@query
def speeches_file(spark, sf_dir):
    path = _speeches_written(spark, sf_dir, "speeches", lambda df: df.write.option("maxRecordsPerFile", ROWS_PER_FILE))
    return speeches.promote_attributes(
        read_speeches(spark, path), ["source", "conv", "turn", "role"]
    ).select("source", "conv", "turn", "role", "data")


@query
def speeches_large_file(spark, sf_dir):
    """All speeches in one file, parsed once as a stream; its attributes become columns unnamed."""
    path = _speeches_written(spark, sf_dir, "speeches-large", lambda df: df.coalesce(1).write)
    read = speeches.promote_all_attributes(read_speeches(spark, path, large_files=True))
    return read.select("source", "conv", "turn", "role", "data")


@query
def table_sink(spark, sf_dir):
    values = regions.region_values(standins.trend_long(spark, sf_dir), "sum")
    path = scratch_path(spark, "sink")
    write_table(values, path, "parquet", partition_by=["topic_name"])
    return spark.read.parquet(path)


# Loads: the rows come in parts, and results are merged ---------------------------------------------

# Bounds of the dates of three loads of orders.
ORDER_LOADS = {"first": ("0001-01-01", "1993-12-31"), "second": ("1994-01-01", "1996-06-05"), "third": ("1996-06-06", "9999-12-31")}


def _loads(df, bounds):
    """The loads by name; the second one comes again at the end, as a run that is repeated does."""
    parts = [(name, df.where(F.col("date").between(F.lit(low), F.lit(high)))) for name, (low, high) in bounds.items()]
    return [*parts, parts[1]]


@query
def weekly_series_by_loads(spark, sf_dir):
    path, keys = scratch_path(spark, "weekly-states"), ["topic_name", "region"]
    for name, part in _loads(standins.trend_long(spark, sf_dir), ORDER_LOADS):
        states.add_load(spark, path, name, states.weekly_states(part, keys))
    return states.weekly_from_states(states.read_states(spark, path, keys), keys)


@query
def monthly_rollup_by_loads(spark, sf_dir):
    path = scratch_path(spark, "monthly-states")
    for name, part in _loads(_order_counts(spark, sf_dir), ORDER_LOADS):
        states.add_load(spark, path, name, states.monthly_states(part))
    return states.monthly_from_states(states.read_states(spark, path, ["topic"]))


@query
def profile_by_loads(spark, sf_dir):
    """Few regions and topics, so the sketches are exact."""
    path = scratch_path(spark, "profiles")
    for name, part in _loads(standins.trend_long(spark, sf_dir), ORDER_LOADS):
        write_load(states.profile_sketch(part), path, name)
    return states.profile_from_sketches(read_loads(spark, path))


@query
def staged_sink(spark, sf_dir):
    """Region values by loads; an attempt at one of them broke off before."""
    path = scratch_path(spark, "staged")
    values = regions.region_values(standins.trend_long(spark, sf_dir), "sum")
    loads = _loads(values, ORDER_LOADS)
    stage(loads[0][1], path, loads[0][0])
    for name, part in loads:
        write_load(part, path, name, partition_by=["topic_name"])
    return read_loads(spark, path).drop("load")
