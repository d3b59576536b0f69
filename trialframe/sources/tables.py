"""Reading and writing experiment files."""

from __future__ import annotations

import csv
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.sources.scratch import saved

#: The columns of the input format, and one that files may lack.
TELEMETRY = {"time": "timestamp", "image_name": "string", **{f"action.{i}": "double" for i in range(6)}}
OPTIONAL = {"power": "double"}
#: Files up to which what is known of each is broadcast.
BROADCAST_FILES = 200_000
_WIDER = {("int", "bigint"): "bigint", ("int", "double"): "double", ("bigint", "double"): "double", ("float", "double"): "double", ("int", "float"): "double", ("bigint", "float"): "double"}


def experiment_of(path: str | Column) -> Column:
    """The number after /E in a path; null without one."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"/E(\d+)", 1).try_cast("long")


def zone_of(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"zone(\d+)", 1).try_cast("long")


def file_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(_file, _header): the first line of each file that has one.

    Every split of a file is a task of its own, which ends after its first rows, so of
    large files little is read. Where the session keeps Spark from dealing splits out
    singly, tasks go on to the end instead.
    """
    cost, most = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    before = spark.conf.get(cost)
    spark.conf.set(cost, most)  # a split fills a task
    alone = spark.conf.get(cost) == most
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("_header"))

    def first_lines(batches):
        last = None
        for batch in batches:
            new = [i for i, (f, at) in enumerate(zip(batch.column("_file").to_pylist(), batch.column("at").to_pylist())) if at == 0 and f != last and (last := f)]
            if new:
                yield batch.take(pa.array(new)).select(["_file", "_header"])
            if alone and batch.num_rows:
                return

    try:
        return saved(lines.mapInArrow(first_lines, "_file string, _header string"), "headers")
    finally:
        spark.conf.set(cost, before)


def columns_of(header: str) -> list[str]:
    """The names in a header line, without quotes, blanks around them and a byte order mark."""
    return [name.strip() for name in next(csv.reader([header.removeprefix("\ufeff")]), [])]


def read_telemetry(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw telemetry of any number of zones, with experiment and zone of each file's path.

    Columns go by the names in each file's header, in whatever order they stand; other
    columns are left out. A file without power has nulls there, one without any other
    of the format's columns is an error that names it and what it lacks. Only the
    different headers come to the driver; all files are then read in one pass, whose
    places are looked up by file. Files without rows give none; values that cannot be
    read as their type are null.
    """
    headers = file_headers(spark, paths)
    different = [r[0] for r in headers.select("_header").distinct().collect()]
    wanted = TELEMETRY | OPTIONAL
    layouts = {}
    for header in different:
        names = columns_of(header)
        if missing := [c for c in TELEMETRY if c not in names]:
            example = headers.where(F.col("_header") == header).first()[0]
            raise ValueError(f"{example} has no column {', '.join(missing)}")
        layouts[header] = [names.index(c) if c in names else None for c in wanted]
    width = max((len(columns_of(h)) for h in different), default=len(wanted))
    cells = [f"_cell_{i}" for i in range(width)]
    raw = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in cells)).csv(paths).withColumn("_file", F.col("_metadata.file_path"))
    if len(set(map(tuple, layouts.values()))) <= 1:  # the usual case: one layout
        places = next(iter(layouts.values()), list(range(len(TELEMETRY))) + [None])
        values = [F.lit(None) if k is None else F.col(cells[k]) for k in places]
    else:
        rows = [(header, *places) for header, places in layouts.items()]
        at = [f"_at_{i}" for i in range(len(wanted))]
        table = spark.createDataFrame(rows, "_header string, " + ", ".join(f"{c} int" for c in at))
        by_file = headers.join(F.broadcast(table), "_header").drop("_header")
        if headers.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
            by_file = F.broadcast(by_file)
        raw = raw.join(by_file, "_file")
        values = [F.get(F.array(*cells), F.col(c)) for c in at]  # null without a place
    df = raw.select(*[v.try_cast(kind).alias(name.replace(".", "_")) for v, (name, kind) in zip(values, wanted.items())], "_file")
    return df.withColumns({"experiment": experiment_of("_file"), "zone": zone_of("_file"), "directory": F.regexp_replace("_file", "/[^/]*$", "")}).drop("_file")


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """All rows by column name; what a frame lacks is null, number types are widened."""
    kinds: dict[str, str] = {}
    for f in frames:
        for name, kind in f.dtypes:
            have = kinds.get(name, kind)
            kinds[name] = have if have == kind else _WIDER.get((have, kind)) or _WIDER.get((kind, have)) or "string"
    cast = [f.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def scan_processed(spark: SparkSession, root: str, experiments: list[int] | None = None, zones: list[int] | None = None) -> DataFrame:
    """All E*_Z*.parquet files under ``root``, at any depth, of the named experiments and zones."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "E*_Z*.parquet").option("mergeSchema", True).parquet(root)
    return file_predicate(df, F.col("_metadata.file_name"), experiments, zones)


def file_predicate(df: DataFrame, name: Column, experiments: list[int] | None = None, zones: list[int] | None = None) -> DataFrame:
    """Rows whose file name, E<experiment>_Z<zone>, is of the named experiments and zones."""
    for group, wanted in ((1, experiments), (2, zones)):
        if wanted is not None:
            df = df.where(F.regexp_extract(name, r"E(\d+)_Z(\d+)", group).try_cast("long").isin(*wanted))
    return df


def read_time_zones(spark: SparkSession, paths: str, default: str = "America/Edmonton") -> DataFrame:
    """(directory, timezone) of each config.json."""
    schema = T.StructType([T.StructField("timezone", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).json(paths)
    return raw.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("directory"), F.coalesce("timezone", F.lit(default)).alias("timezone"))


def attach_time_zones(df: DataFrame, zones: DataFrame, default: str = "America/Edmonton") -> DataFrame:
    return df.join(zones, "directory", "left").withColumn("timezone", F.coalesce("timezone", F.lit(default)))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("ZONE int, PPFD_ELEC int, COLOR string, PPFD_SUN int").csv(path)


def read_spectra(spark: SparkSession, paths: str) -> DataFrame:
    """(zone, wavelength, red, white, blue) from files zone<N>_<colour>.txt of two numbers a line."""
    name = F.col("_metadata.file_name")
    rows = spark.read.text(paths).select(F.regexp_extract(name, r"zone(\d+)_", 1).try_cast("long").alias("zone"), F.lower(F.regexp_extract(name, r"zone\d+_(\w+)\.", 1)).alias("colour"), F.split(F.trim("value"), r"[\s,;]+").alias("p"))
    numbers = rows.select("zone", "colour", F.get("p", F.lit(0)).try_cast("double").alias("wavelength"), F.get("p", F.lit(1)).try_cast("double").alias("v")).where("wavelength is not null and v is not null")
    return numbers.groupBy("zone", "wavelength").pivot("colour", ["red", "white", "blue"]).agg(F.first("v"))


def harvest_long(df: DataFrame, key: str) -> DataFrame:
    """(zone, biomass): mean of each zone's column of a wide sheet, its average row left out."""
    zones = [c for c in df.columns if c != key]
    long = df.where(F.upper(F.col(key).cast("string")) != "AVG").unpivot([key], zones, "column_name", "v")
    return long.groupBy(F.regexp_extract("column_name", r"(\d+)", 1).try_cast("long").alias("zone")).agg(F.avg(F.col("v").try_cast("double")).alias("biomass"))


def image_manifest(spark: SparkSession, paths: str) -> DataFrame:
    """(path, image_name, image_hash, n_bytes, time, side) of image files; names give the time and the camera's side, null where they do not."""
    files = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("image_name"), F.md5("content").alias("image_hash"), F.col("length").alias("n_bytes"), image_time(name).alias("time"), image_side(name).alias("side"))


def image_time(name: Column) -> Column:
    """The instant in a name like 2025-01-31T093000-0700_left.png; without an offset it is UTC, without a time null."""
    stamp = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}T\d{6})", 1)
    offset = F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}T\d{6}([+-]\d{4}|Z)", 1)
    return F.try_to_timestamp(F.when(stamp != "", F.concat(stamp, F.when(offset == "", F.lit("Z")).otherwise(offset))), F.lit("yyyy-MM-dd'T'HHmmssXX"))


def image_side(name: Column) -> Column:
    """``left`` or ``right``, as the name ends; else null."""
    side = F.lower(F.regexp_extract(name, r"(?i)[_-](left|right)\.\w+$", 1))
    return F.when(side != "", side)


def image_quality(df: DataFrame, decode, content: str = "content") -> DataFrame:
    """``brightness`` of each image by ``decode`` (bytes to an array of grey values); -1 where it fails."""
    @F.pandas_udf("double")
    def brightness(data: pd.Series) -> pd.Series:
        def one(x):
            try:
                return float(decode(x).mean())
            except Exception:  # an unreadable image is a value, not an error
                return -1.0

        return data.map(one)

    return df.withColumn("brightness", brightness(content)).withColumn("image_hash", F.md5(content))


# -- sinks

#: Rows in one file of a zone, at most, and zones up to which a list of them is broadcast.
FILE_ROWS, BROADCAST_ZONES = 4 << 20, 200_000


def write_zones(df: DataFrame, path: str, mode: str = "overwrite", file_rows: int = FILE_ROWS) -> None:
    """Parquet by experiment and zone; only the partitions that ``df`` has are replaced.

    Rows are dealt out by zone and then by size: small zones share a task, a large one
    has several, and no file has more than ``file_rows`` rows.
    """
    balanced = df.hint("rebalance", F.col("experiment"), F.col("zone"))
    balanced.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows).partitionBy("experiment", "zone").parquet(path)


_MANIFEST = "_zones"


def _file_system(spark: SparkSession, path: str):
    """(file system, its path) of a place that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete manifests, ascending."""
    fs, at = _file_system(spark, f"{path}/{_MANIFEST}/*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName()) for f in fs.globStatus(at) or [])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, zone, n_images): which zones ``refresh_zones`` has written to ``path``, and from how many images."""
    schema, known = "experiment long, zone long, n_images long", _generations(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{_MANIFEST}/{known[-1]}") if known else spark.createDataFrame([], schema)


def _write_manifest(zones: DataFrame, path: str) -> None:
    """A new generation of the manifest, beside the old one until it is complete."""
    spark = zones.sparkSession
    known = _generations(spark, path)
    zones.write.mode("overwrite").parquet(f"{path}/{_MANIFEST}/{known[-1] + 1 if known else 0}")
    for old in known:
        fs, at = _file_system(spark, f"{path}/{_MANIFEST}/{old}")
        fs.delete(at, True)


def refresh_zones(source: DataFrame, wanted: DataFrame, path: str, compute) -> DataFrame:
    """Computes the zones of ``wanted`` (experiment, zone, n_images) that ``path`` does not hold from as many images, and replaces them there.

    ``compute`` makes the rows of the stale zones from their rows of ``source``, and sees
    no others; all other zones' files stay as they are. A zone for which it gives no rows
    loses its files. Stale zones leave the manifest before anything is replaced and come
    back after it, so a run that is lost half way is done again by the next. Null counts
    equal no count. Returns the stale zones; rows of other zones that ``compute`` gives
    are an error.
    """
    spark = source.sparkSession
    keys = ["experiment", "zone"]
    before = saved(read_manifest(spark, path), "manifest")
    stale = saved(stale_zones(wanted.select(*keys, "n_images"), before), "stale")
    if not stale.limit(1).count():
        return stale
    zones = stale.select(*keys).distinct()
    if zones.limit(BROADCAST_ZONES + 1).count() <= BROADCAST_ZONES:
        zones = F.broadcast(zones)
    rows = saved(compute(source.join(zones, keys, "left_semi")), "refreshed")
    made = saved(rows.select(*keys).distinct(), "made")
    if other := made.join(zones, keys, "left_anti").limit(1).collect():
        raise ValueError(f"rows of a zone that was not asked for: {other[0]}")
    others = before.join(zones, keys, "left_anti")
    _write_manifest(others, path)
    write_zones(rows, path)
    for zone in zones.join(made, keys, "left_anti").toLocalIterator():  # one after another; their folders are known to the driver anyway
        fs, at = _file_system(spark, f"{path}/experiment={zone[0]}/zone={zone[1]}")
        fs.delete(at, True)
    _write_manifest(others.unionByName(stale), path)
    return stale


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, min double, max double, mean double, std double").json(path)


def stale_zones(wanted: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("experiment", "zone", "n_images")) -> DataFrame:
    """Zones to compute: those of ``wanted`` without a row of the same keys, image count included, in ``done``; ``refresh_zones`` computes them."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def storage_profile(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(column_name, compressed, uncompressed, ratio, share) over the footers of Parquet files; tasks read each file's end only."""
    files = spark.read.format("binaryFile").load(paths).select("path")  # without the content, which is then not read

    def footers(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                yield pd.DataFrame([(c.path_in_schema, c.total_compressed_size, c.total_uncompressed_size) for g in range(meta.num_row_groups) for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))], columns=["column_name", "c", "u"])

    sums = files.mapInPandas(footers, "column_name string, c long, u long").groupBy("column_name").agg(F.sum("c").alias("compressed"), F.sum("u").alias("uncompressed"))
    total = sums.agg(F.sum("compressed").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).select("column_name", "compressed", "uncompressed", F.try_divide(F.col("uncompressed"), F.col("compressed")).alias("ratio"), F.try_divide(F.col("compressed"), F.col("_t")).alias("share"))


def parameter_report(params: dict[str, Column | float | str], df: DataFrame) -> DataFrame:
    """One row ``report``: the parameters as JSON."""
    return df.limit(1).select(F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in params.items()])).alias("report"))
