"""Scans and sinks: every query writes the given tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as tx
from parlance.functions.numbers import rounded
from parlance.operators import filters, joins
from parlance.plans.inputs import DATED, GRID_RESULTS, MESSAGES, POSTS, grid_results, messages, posts, r6, table, with_ctes
from parlance.plans.registry import query
from parlance.schemas import EXPERIMENT_LOG, RAW_MESSAGE
from parlance.session import saved, scratch_path
from parlance.sources import messages as src
from parlance.sources import sinks
from parlance.sources.runlog import parse_run_log


def raw_messages(spark, sf):
    """Documents in the 16 columns of a raw dump."""
    have = messages(spark, sf).withColumns(
        {
            "user_id": F.length("text").cast("long"),
            "bot_flag": F.col("lang") == "fr",
            "views": F.length("text"),
            "media_type": F.lit("text\twith tab"),
        }
    )
    columns = [
        (F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_MESSAGE
    ]
    return have.select(*columns, "group_name")


def write_dump(df, path, partition=("group_name",)):
    (
        df.write.partitionBy(*partition)
        .option("header", True)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("compression", "gzip")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


@query(
    "a01_dump_scan",
    with_ctes(
        MESSAGES,
        select="""SELECT id, group_name, md5(text) AS text_hash, "timestamp", length(text) AS views, lang = 'fr' AS
        bot_flag, concat('text', chr(9), 'with tab') AS media_type FROM messages""",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "dump") + "/extracted"
    write_dump(raw_messages(spark, sf), path)
    rows = src.add_lineage(src.read_dump(spark, path))
    return rows.select("id", "group_name", F.md5("text").alias("text_hash"), "timestamp", "views", "bot_flag", "media_type")


@query("a02_corrupt_files", with_ctes(MESSAGES, select="SELECT id, group_name FROM messages"))
def _(spark, sf):
    """A dump that also holds files which are called gzip and are not."""
    path = scratch_path(spark, "mixed") + "/extracted"
    write_dump(raw_messages(spark, sf), path)
    for source in table(spark, sf, "documents").select("source").filter("source is not null").distinct().take(5):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/group_name=bad-{source['source']}/broken.csv.gz")
        with_content = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        with_content.write(bytearray(b"this is no gzip file"))
        with_content.close()
    return src.add_lineage(src.read_dump(spark, path, ignore_corrupt=True)).select("id", "group_name")


MALFORMED_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("group_name", T.StringType())])


def malformed_dump(spark, sf):
    path = scratch_path(spark, "malformed")
    bad = F.when(F.col("lang") == "de", F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id").cast("string"))
    rows = messages(spark, sf).select(bad.alias("id"), "group_name")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return path


@query("a03_drop_malformed", with_ctes(MESSAGES, select="SELECT id, group_name FROM messages WHERE lang <> 'de'"))
def _(spark, sf):
    return src.read_dump(spark, malformed_dump(spark, sf), MALFORMED_SCHEMA, malformed="drop")


@query(
    "a03_quarantine_malformed",
    with_ctes(
        MESSAGES,
        select="""SELECT concat('x', id, chr(9), group_name) AS line FROM messages WHERE lang = 'de'""",
    ),
)
def _(spark, sf):
    rows = src.read_dump(spark, malformed_dump(spark, sf), MALFORMED_SCHEMA, malformed="quarantine")
    return saved(rows, "quarantine").filter(F.col(src.BAD_RECORD).isNotNull()).select(F.col(src.BAD_RECORD).alias("line"))


@query(
    "a04_lineage",
    """SELECT page_id, regexp_extract(p, '/extracted/([^/]+)/', 1) AS group_name,
    regexp_extract(p, 'channel_(\\d+)-', 1) AS channel_id FROM (SELECT page_id, concat('file:', CASE WHEN
    url LIKE 'https%' THEN '/extracted/' ELSE '/other/' END, split_part(url, '/', 3), '/channel_', page_id, '-messages.tsv.gz')
    AS p FROM pages)""",
)
def _(spark, sf):
    folder = F.when(F.col("url").startswith("https"), "/extracted/").otherwise("/other/")
    path = F.concat(
        F.lit("file:"), folder, F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/channel_"), F.col("page_id"),
        F.lit("-messages.tsv.gz"),
    )
    return table(spark, sf, "pages").select("page_id", path.alias("p")).select(
        "page_id", src.group_from_path(F.col("p")).alias("group_name"), src.channel_from_path(F.col("p")).alias("channel_id")
    )


@query(
    "a05_allow_list",
    with_ctes(
        MESSAGES,
        select="""SELECT id, group_name FROM messages WHERE group_name IN (
        SELECT source FROM documents d JOIN labels l USING (doc_id) GROUP BY source HAVING avg(toxic) > 0.1)""",
    ),
)
def _(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    groups = labelled.groupBy("source").agg(F.avg("toxic").alias("share")).filter("share > 0.1")
    return src.keep_allowed(messages(spark, sf), groups.select("source")).select("id", "group_name")


@query("a06_batched_conversion", with_ctes(MESSAGES, select="SELECT group_name, count(*) AS n FROM messages GROUP BY 1"))
def _(spark, sf):
    base = scratch_path(spark, "batches")
    write_dump(raw_messages(spark, sf), base + "/extracted")
    paths = src.list_dump(spark, base + "/extracted")
    read = lambda s, batch: src.add_lineage(src.read_dump(s, batch))
    half = paths[: len(paths) // 2]
    for some in (half, paths):  # the second run goes on behind the first
        sinks.convert_in_batches(spark, some, read, base + "/out", base + "/ledger", 8)
    return src.load_tables(spark, base + "/out").groupBy("group_name").agg(F.count("*").alias("n"))


@query(
    "a07_projected_scan",
    "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents",
)
def _(spark, sf):
    path = f"{sf}/documents.parquet"
    return src.load_tables(spark, path, ["doc_id", "lang"]).unionByName(src.load_tables(spark, [path], ["doc_id", "lang"]))


def dated_messages(spark, sf):
    return filters.add_period(messages(spark, sf)).select("id", "group_name", "year", "month")


@query("a08_append_by_period", with_ctes(MESSAGES, DATED, select="SELECT * FROM dated UNION ALL SELECT * FROM dated"))
def _(spark, sf):
    path = scratch_path(spark, "append")
    sinks.append_by_period(dated_messages(spark, sf), path)
    sinks.append_by_period(dated_messages(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "a09_overwrite_periods",
    with_ctes(MESSAGES, DATED, select="SELECT id + CASE WHEN month = 3 THEN 1000 ELSE 0 END AS id, group_name, year, month FROM dated"),
)
def _(spark, sf):
    path = scratch_path(spark, "overwrite")
    rows = dated_messages(spark, sf)
    sinks.overwrite_periods(rows, path)
    sinks.overwrite_periods(rows.filter("month = 3").withColumn("id", F.col("id") + 1000), path)
    return spark.read.parquet(path)


@query("a10_pending_periods", with_ctes(MESSAGES, DATED, select="SELECT id, year, month FROM dated WHERE month > 4"))
def _(spark, sf):
    rows = dated_messages(spark, sf)
    return sinks.pending_periods(rows, rows.filter("month <= 4")).select("id", "year", "month")


@query(
    "a11_pending_rows",
    with_ctes(MESSAGES, select="SELECT id FROM messages WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))"),
)
def _(spark, sf):
    done = messages(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")
    return sinks.pending_rows(messages(spark, sf), done, ["text"]).select("id")


@query(
    "a12_resume_by_period",
    with_ctes(MESSAGES, DATED, select="""SELECT year, month, count(*) AS "rows", 'done' AS status FROM dated GROUP BY 1, 2"""),
)
def _(spark, sf):
    path = scratch_path(spark, "resume")
    rows = dated_messages(spark, sf)
    sinks.overwrite_periods(rows.filter("month <= 6"), path)
    sinks.resume_by_period(rows, path, lambda todo: todo)
    return sinks.period_ledger(spark.read.parquet(path))


@query(
    "a12_isolated_periods",
    with_ctes(
        MESSAGES, DATED,
        select="""SELECT year, month, CASE WHEN month = 9 THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN month = 9 THEN 0 ELSE count(*) END AS "rows" FROM dated WHERE month > 6 GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    """Months one by one behind a finished half year; one of them fails, the others are written."""
    path = scratch_path(spark, "isolated")
    rows = dated_messages(spark, sf)
    sinks.overwrite_periods(rows.filter("month <= 6"), path)

    def transform(part):
        return part.filter(F.when(F.col("month") == 9, F.raise_error(F.lit("bad month"))).otherwise(F.lit(True)))

    ledger = sinks.run_by_period(rows, path, transform)
    written = sinks.period_ledger(spark.read.parquet(path)).select("year", "month", "rows")
    return ledger.join(written, ["year", "month"], "left").select(
        "year", "month", "status", F.coalesce("rows", F.lit(0)).alias("rows")
    )


@query("a13_compact", with_ctes(POSTS, select="SELECT id, group_name, 2 AS files FROM posts"))
def _(spark, sf):
    path = scratch_path(spark, "compact")
    sinks.write_compact(posts(spark, sf).repartition(6).select("id", "group_name"), path, 2)
    rows = spark.read.parquet(path).withColumn("__file", F.col("_metadata.file_path"))
    files = rows.select(F.count_distinct("__file")).scalar()
    return rows.select("id", "group_name", files.cast("int").alias("files"))


@query(
    "a14_json_records",
    with_ctes(
        MESSAGES,
        select="""SELECT concat('{"group_name":"', group_name, '","n":', count(*), '}') AS value
        FROM messages GROUP BY group_name""",
    ),
)
def _(spark, sf):
    return sinks.json_records(messages(spark, sf).groupBy("group_name").agg(F.count("*").alias("n")))


@query(
    "a14_keyed_json",
    with_ctes(
        POSTS,
        "p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total FROM posts GROUP BY 1)",
        select="""SELECT concat('{', string_agg(concat('"', day, '":{"total":', total, '}'), ',' ORDER BY day), '}')
        AS value FROM p""",
    ),
)
def _(spark, sf):
    days = posts(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"))
    return sinks.keyed_json(days, "day")


@query(
    "a15_experiment_log",
    """SELECT model, fold, accuracy, 'none' AS dataset FROM (SELECT l_returnflag AS model,
    l_linenumber AS fold, CAST(count(*) AS DOUBLE) AS accuracy FROM lineitem GROUP BY 1, 2)
    UNION ALL SELECT 'O' , 0, count(*)::DOUBLE, 'orders' FROM orders""",
)
def _(spark, sf):
    path = scratch_path(spark, "log")
    n = F.count("*").alias("accuracy")
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold"))
    sinks.append_log(runs.agg(n), path, EXPERIMENT_LOG)
    extra = table(spark, sf, "orders").agg(n).select("*", F.lit("O").alias("model"), F.lit(0).alias("fold"))
    sinks.append_log(extra.withColumn("dataset", F.lit("orders")), path, EXPERIMENT_LOG)
    log = sinks.read_log(spark, path, EXPERIMENT_LOG).fillna("none", ["dataset"])
    return log.select("model", "fold", "accuracy", "dataset")


@query(
    "a16_clean_join_sink",
    with_ctes(
        MESSAGES,
        select="""SELECT m.id, year(t) AS year, month(t) AS month, md5(trim(regexp_replace(regexp_replace(text,
        'http\\S+|www.\\S+', '', 'g'), '\\s+', ' ', 'g'))) AS text_hash FROM (SELECT *,
        make_timestamp("timestamp" * 1000000) AS t FROM messages) m JOIN labels l ON m.id = l.doc_id WHERE l.quality = 1""",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "clean-join")
    labels = table(spark, sf, "labels").filter("quality = 1").withColumnRenamed("doc_id", "id")
    joined = joins.join_labels(filters.add_period(messages(spark, sf)), labels, ["id"])
    sinks.overwrite_periods(joined.withColumn("text", tx.light_clean(F.col("text"))), path)
    return spark.read.parquet(path).select("id", "year", "month", F.md5("text").alias("text_hash"))


LOG_PARAMETERS = ["n_neighbors", "min_cluster_size", "prediction_data"]


def run_log_lines(spark, sf):
    """The log a parameter search over the line items would leave: one file per model, some
    combinations failed, some cut off."""
    grid = grid_results(spark, sf)
    order = F.col("n_neighbors") * 1000 + F.col("min_cluster_size") * 10
    combo = F.format_string(
        "[%d/350] {'n_neighbors': %d, 'min_cluster_size': %d, 'prediction_data': True}",
        (F.col("n_neighbors") * 50 + F.col("min_cluster_size")), F.col("n_neighbors"), F.col("min_cluster_size"),
    )
    number = lambda c: F.coalesce(rounded(F.col(c), 4).cast("string"), F.lit("nan"))
    failed, cut = F.col("min_cluster_size") == 7, F.col("min_cluster_size") == 13
    rows = F.when(cut, F.array(combo)).when(failed, F.array(combo, F.lit("   -> Falhou: bad size"))).otherwise(
        F.array(
            combo,
            F.format_string("   -> Outliers (ruído): %d (12.5%%)", "n_topics"),
            F.concat(F.lit("   -> Silhoueta: "), number("silhouette")),
            F.concat(F.lit("   -> Diversidade: "), number("diversity")),
            F.concat(F.lit("   -> Coerência (c_v): "), number("coherence_cv")),
        )
    )
    body = grid.select(F.col("embedding_model").alias("file"), order.alias("base"), F.posexplode(rows).alias("step", "value"))
    heads = grid.select("embedding_model").distinct().select(
        F.col("embedding_model").alias("file"), F.lit(0).alias("base"), F.lit(0).alias("step"),
        F.concat(F.lit("[1/3] Modelo de embedding: "), "embedding_model").alias("value"),
    )
    line = (F.col("base") + F.col("step")).cast("long")
    return body.unionByName(heads).select("file", F.floor(line / 128).alias("block"), line.alias("line"), "value")


@query(
    "a17_parse_run_log",
    with_ctes(
        GRID_RESULTS,
        select=f"""SELECT embedding_model, n_neighbors * 50 + min_cluster_size AS combo_idx, CAST(n_neighbors AS VARCHAR)
        AS n_neighbors, CAST(min_cluster_size AS VARCHAR) AS min_cluster_size, 'true' AS prediction_data,
        CASE WHEN min_cluster_size = 7 THEN -1 ELSE n_topics END AS n_outliers,
        CASE WHEN min_cluster_size = 7 THEN 'none' WHEN silhouette IS NULL THEN 'NaN' ELSE
        CAST({r6('floor(silhouette * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE')} AS VARCHAR) END AS silhouette,
        CASE WHEN min_cluster_size = 7 THEN 'bad size' ELSE 'none' END AS error
        FROM grid_results WHERE min_cluster_size <> 13""",
    ),
)
def _(spark, sf):
    parsed = parse_run_log(run_log_lines(spark, sf), LOG_PARAMETERS)
    return parsed.select(
        "embedding_model", "combo_idx", *LOG_PARAMETERS, F.coalesce("n_outliers", F.lit(-1)).alias("n_outliers"),
        F.coalesce(F.col("silhouette").cast("string"), F.lit("none")).alias("silhouette"),
        F.coalesce("error", F.lit("none")).alias("error"),
    )


@query("a17_read_run_log_files", with_ctes(GRID_RESULTS, select="SELECT count(*) AS combos FROM grid_results WHERE min_cluster_size <> 13"))
def _(spark, sf):
    path = scratch_path(spark, "runlog")
    lines = saved(run_log_lines(spark, sf), "lines")
    ordered = lines.repartition("file").sortWithinPartitions("file", "line")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    parsed = parse_run_log(src.read_lines(spark, path), LOG_PARAMETERS)
    return parsed.agg(F.count("*").alias("combos"))
