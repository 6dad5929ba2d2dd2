"""Readers and writers: page-count logs, tweets as JSON or TSV, target sheets, graph labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import strings as S

URL = r"[-A-Za-z0-9_~!*();@,./%]+"
PAGE_LINE = rf"^[a-z.]+ {URL} [0-9]+ [0-9]+$"
TWEET = "id long, created_at string, text string, coordinates struct<type:string,coordinates:array<double>>, user struct<screen_name:string,description:string,lang:string,location:string,time_zone:string>"
TWEET_TSV = "tweet_id long, created_at timestamp, text string, user_screen_name string, user_description string, user_lang string, user_location string, user_time_zone string, lon double, lat double, geom_src string"


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines (project, url, count, bytes, hour) of hourly page-count files; bad lines are left out, cut files give what they hold."""
    lines = spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "pagecounts-*.gz").text(path)
    f = F.split("value", " ")
    return lines.where(F.col("value").rlike(PAGE_LINE)).select(f[0].alias("project"), f[1].alias("url"), F.try_to_number(f[2], F.lit("9999999999999999")).cast("long").alias("count"), f[3].try_cast("long").alias("bytes"), N.file_hour(F.input_file_name()).alias("hour")).where("count is not null")


def classify(json: F.Column) -> F.Column:
    """What a line of a tweet stream is."""
    out = F.when(F.coalesce(F.trim(json), F.lit("")).rlike("^[0-9a-fA-F]*$"), "nothing")
    for key in ("delete", "limit", "scrub_geo", "status_withheld", "text", "warning"):
        out = out.when(F.get_json_object(json, f"$.{key}").isNotNull(), key)
    return out.otherwise("unknown")


def tweets_json(spark: SparkSession, path: str) -> DataFrame:
    """Tweets of a file of JSON lines; control objects and broken lines are left out."""
    lines = spark.read.text(path).where(classify(F.col("value")) == "text")
    return tweet_rows(lines.select(F.from_json("value", TWEET).alias("t")).select("t.*"))


def tweet_rows(t: DataFrame) -> DataFrame:
    point = F.col("coordinates.coordinates")
    return t.select(
        F.col("id").alias("tweet_id"), N.tweet_time(F.col("created_at")).alias("created_at"), S.text_clean(F.col("text")).alias("text"), F.col("user.screen_name").alias("user_screen_name"), S.text_clean(F.col("user.description")).alias("user_description"),
        F.col("user.lang").alias("user_lang"), S.text_clean(F.col("user.location")).alias("user_location"), F.col("user.time_zone").alias("user_time_zone"), F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"), F.when(point.isNotNull(), "co").alias("geom_src"),
    )


def tweets_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tweets of tab-separated files without a header; nothing between tabs is null."""
    return spark.read.csv(path, sep="\t", quote="", schema=TWEET_TSV, nullValue="", timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]")


def write_tsv(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Tab-separated text without quotes, null as nothing, optionally a folder for each value of ``by``."""
    w = df.write.mode(mode).option("sep", "\t").option("quote", "").option("nullValue", "").option("emptyValue", "")
    (w.partitionBy(by) if by else w).csv(path)


def json_glued(spark: SparkSession, path: str, most: int = 16, failures: int = 10) -> DataFrame:
    """JSON objects (column ``json``) whose text may be broken over up to ``most`` further lines of a file.

    Lines come with their file and row, and a file's lines are put in order by one shuffle; files are as large as their writer rotates them. A file with more than
    ``failures`` objects that can't be read is an error.
    """
    import json

    import pyarrow as pa

    def glue(batches):
        name, held, failed = None, [], 0
        for b in batches:
            out = []
            for file, line in zip(b.column("file").to_pylist(), b.column("line").to_pylist()):
                if file != name:
                    name, held, failed = file, [], 0
                if not held and not line.startswith("{"):
                    continue
                held.append(line)
                try:
                    json.loads("".join(held))
                except ValueError:
                    if len(held) > most:
                        held, failed = [], failed + 1
                        if failed > failures:
                            raise ValueError(f"too many objects of {file} can't be read") from None
                    continue
                out.append("".join(held))
                held = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["json"])

    return _numbered(spark, path).repartition("file").sortWithinPartitions("file", "row").mapInArrow(glue, "json string")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their files and their order in these: a file is read by one task if it is compressed, else in runs whose order is that of their first bytes."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("row"), F.col("value").alias("line"))


def target_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows (target, day, y) of a sheet saved as CSV: a date column, then one for each target; blanks have null y."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    day, *names = wide.columns
    names = [n for n in names if not n.startswith("_")]
    return wide.unpivot([day], names, "target", "y").select("target", F.to_date(day).alias("day"), F.col("y").try_cast("double").alias("y"))


def graph_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (root, article) of GML files named by their roots."""
    lines = spark.read.text(path).withColumn("root", F.regexp_extract(F.input_file_name(), r"([^/]+)\.gml$", 1))
    return lines.select("root", F.regexp_extract("value", r'label "(.+)"', 1).alias("article")).where("article <> ''")


def sine(spark: SparkSession, start: str, step: str, count: int, wavelength: float, phase: float = 0.0) -> DataFrame:
    """A sine wave of ``count`` periods."""
    import math

    return spark.range(count).select(F.expr(f"TIMESTAMP '{start}' + id * INTERVAL {step}").alias("period"), F.sin((F.col("id") + phase) * (2 * math.pi / wavelength)).alias("value"))


def noise(spark: SparkSession, count: int, kind: str, seed: int = 0, level: float = 1.0, pulses: list[tuple[int, int]] | None = None) -> DataFrame:
    """Normal, constant, linear or pulse noise by position."""
    i = F.col("id")
    on = F.lit(False)
    for a, n in pulses or []:
        on = on | ((i >= a) & (i < a + n))
    made = {"normal": F.randn(seed) * level, "constant": F.lit(level), "linear": i * level / max(count - 1, 1), "pulse": F.when(on, level).otherwise(0.0)}
    return spark.range(count).select(i.alias("i"), made[kind].cast("double").alias("value"))


def write_fragments(frags: DataFrame, path: str) -> None:
    """Store series by month and shard; only the months in ``frags`` are replaced."""
    frags.repartition("fragment", "shard").sortWithinPartitions("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fragment", "shard").parquet(path)


def validated(names: DataFrame, name: str) -> DataFrame:
    """File names with the month of their hour and whether it is that of the last file with a time."""
    rows = names.select(F.col(name).alias("name")).withColumn("hour", F.when(F.col("name").rlike(r"\d{8}-\d{6}"), N.file_hour(F.col("name"))))
    rows = rows.withColumn("month", N.month_of(F.col("hour")))
    last = rows.where("month IS NOT NULL").agg(F.max_by("month", "name").alias("last"))
    return rows.crossJoin(F.broadcast(last)).select("name", "month", F.coalesce(F.col("month") == F.col("last"), F.lit(False)).alias("valid"))


def sorted_prefix(lines: DataFrame, file: str, row: str, line: str) -> DataFrame:
    """The lines of each file before the first that is less than the one ahead of it."""
    from pyspark.sql.window import Window

    falls = lines.withColumn("_falls", F.col(line) < F.lag(line).over(Window.partitionBy(file).orderBy(row)))
    first = falls.where("_falls").groupBy(file).agg(F.min(row).alias("_first"))
    return falls.join(first, file, "left").where(F.col("_first").isNull() | (F.col(row) < F.col("_first"))).select(*lines.columns)


def project_ok(project: F.Column, stamp: F.Column) -> F.Column:
    """Whether a project's name is one that files of that time have."""
    old = stamp <= F.lit("2015-01-15 00:00:00").cast("timestamp")
    return F.when(old, project.rlike(r"^[a-z]+(\.[a-z]+)?$")).otherwise(project.rlike(r"^[a-z.]+$"))


def geojson(rows: DataFrame, keys: list[str], order: str, lon: F.Column, lat: F.Column, properties: list[str]) -> DataFrame:
    """A collection of points of each key as GeoJSON text, in the given order."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), feature.alias("f")))).alias("held"))
    return held.select(*keys, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("held", lambda x: x["f"]).alias("features"))).alias("json"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of tab-separated files up to each file's first blank line; nothing between tabs is null."""
    from pyspark.sql import types as T

    lines = _numbered(spark, path).withColumn("blank", F.trim("line") == "")
    first = lines.where("blank").groupBy("file").agg(F.min("row").alias("stop"))
    kept = lines.join(first, "file", "left").where(F.col("stop").isNull() | (F.col("row") < F.col("stop")))
    parts = F.split("line", "\t")
    fields = T._parse_datatype_string(schema).fields
    return kept.select(*[F.nullif(F.get(parts, F.lit(k)), F.lit("")).try_cast(f.dataType).alias(f.name) for k, f in enumerate(fields)])


def month_folder(spark: SparkSession, path: str) -> DataFrame:
    """Counts (ngram, day, n) of a folder of page-count files: ``project article`` with '_' for an encoded space."""
    rows = page_counts(spark, path)
    name = F.concat_ws(" ", "project", F.replace("url", F.lit("%20"), F.lit("_")))
    return rows.groupBy(name.alias("ngram"), F.to_date("hour").alias("day")).agg(F.sum("count").alias("n"))


def vectors_tsv(spark: SparkSession, path: str, truth: DataFrame | None = None) -> DataFrame:
    """Rows (name, period, v) of a wide sheet of series by period, ``$norm`` stripped from the names.

    Inner gaps are interpolated, outer ones 0; with ``truth`` (a column ``period``) only its periods are kept.
    """
    from ..operators import series as R

    wide = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    period, *names = wide.columns
    clean = wide.toDF(period, *[n.removesuffix("$norm") for n in names])
    long = clean.unpivot([period], clean.columns[1:], "name", "v").select("name", F.to_date(period).alias("period"), F.col("v").try_cast("double").alias("v"))
    long = R.interpolate(long.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), ["name"], "period", "v")
    return long.join(truth.select("period").distinct(), "period", "left_semi") if truth is not None else long


def trends_csv(spark: SparkSession, path: str, scale: float = 1e7, most: float = 2 / 3) -> DataFrame:
    """Rows (kind, name, day, v) of a sheet of search shares: columns of more than ``most`` zeros are left out, a name that ends in ')' is a topic."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    day, *names = wide.columns
    long = wide.unpivot([day], names, "name", "v").select("name", F.to_date(day).alias("day"), (F.col("v").try_cast("double") / scale).alias("v"))
    kept = long.groupBy("name").agg(F.avg((F.coalesce("v", F.lit(0.0)) == 0).cast("int")).alias("zeros")).where(F.col("zeros") <= most).select("name")
    return long.join(kept, "name").select(F.when(F.endswith("name", F.lit(")")), "topic").otherwise("raw").alias("kind"), "name", "day", "v")


def keywords(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """The distinct keywords of a file, sorted, and an MD5 of them. Such a list is short: a stream takes a few hundred."""
    import hashlib

    words = sorted(r[0] for r in spark.read.text(path).select(S.keyword(F.col("value")).alias("k")).where("k IS NOT NULL").distinct().collect())
    return words, hashlib.md5("\n".join(words).encode()).hexdigest()
