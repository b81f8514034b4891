"""Readers and writers of catalogues: CSV logs, JSON records, shards and slices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.ranges import running
from factloom.session import ensure_checkpoint_dir, prepare


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Columns position, subject, kind of a CSV log with a header (chapter, name, type).

    Names are trimmed; rows without one, or with no whole number as position, go; the kind is ``full`` by default.
    """
    raw = spark.read.schema("chapter string, name string, type string").csv(path, header=True)
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    rows = raw.select(F.trim("chapter").try_cast("int").alias("position"), F.trim("name").alias("subject"), F.when(kind == "", "full").otherwise(kind).alias("kind"))
    return rows.where("position is not null and subject <> ''")


def read_records(spark: SparkSession, path: str, shape: str, fields: str, wrapper: str | None = None, part: int = 1 << 26) -> DataFrame:
    """Columns name (of map-keyed files) and ``fields`` of JSON records; a byte order mark is passed over.

    ``shape`` is ``map`` (name -> record), ``wrapped`` (an object with a list under ``wrapper``) or ``list``. Entries
    that are no objects are skipped. Files of over ``part`` bytes are read in parts, see ``_entries``; smaller ones are a row each.
    """
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    large = sizes.where(F.col("length") > part).limit(1).count() > 0
    if large:
        entries = _entries(spark, path, wrapper if shape == "wrapped" else None)
    else:
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\uFEFF", "").alias("j"))
        if shape == "map":
            entries = text.select(F.explode(F.from_json("j", "map<string,string>")).alias("_n", "_r"))
        else:
            body = F.get_json_object("j", f"$.{wrapper}") if shape == "wrapped" else F.col("j")
            entries = text.select(F.lit(None).cast("string").alias("_n"), F.explode(F.from_json(body, "array<string>")).alias("_r"))
    rows = entries.where(F.trim("_r").startswith("{")).select("_n", F.from_json("_r", fields).alias("_s"))
    return rows.select(F.col("_n").alias("name"), "_s.*") if shape == "map" else rows.select("_s.*")


def _entries(spark: SparkSession, path: str, wrapper: str | None) -> DataFrame:
    """Columns _n (the key, in a map) and _r of the entries of large JSON files: those of the outermost map or list, or of the list
    under the key ``wrapper`` of the outermost map.

    Files are read as pieces that end at commas, which Spark splits by bytes. Whether a piece begins inside a string
    depends on the number of quotes before it, and then how deep it lies on the brackets before it: both are running sums over ranges
    of pieces. A piece that follows a comma at the entries' depth begins an entry, and the pieces of an entry are put together again.
    """
    spark = prepare(spark)
    ensure_checkpoint_dir(spark)
    raw = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # pieces in the order of their bytes: splits of a file by where they begin, pieces of a split by their number
    starts = raw.groupBy("_file", "_block").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_file", "_block", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    rows = raw.join(F.broadcast(starts), ["_file", "_block"])  # a row for each split
    rows = rows.select("_file", (F.col("_from") + F.col("_id") - F.col("_least")).alias("at"), F.when(F.col("_from") + F.col("_id") - F.col("_least") == 0, F.regexp_replace("value", "^\\uFEFF", "")).otherwise(F.col("value")).alias("v"))
    # without escaped characters a quote opens or closes a string
    bare = F.regexp_replace("v", r"\\.", "")
    rows = rows.withColumn("_q", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))))
    outside = lambda text: F.regexp_replace(text, r'"[^"]*("|$)', "")
    depth = lambda text: F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))
    rows = rows.withColumns({"_open": depth(outside(bare)), "_inside": depth(outside(F.concat(F.lit('"'), bare)))}).checkpoint()
    rows = running(rows, ["_file"], "at", "_q", "_quotes").withColumn("_in", (F.col("_quotes") - F.col("_q")) % 2 == 1)
    rows = rows.withColumn("_net", F.when(F.col("_in"), F.col("_inside")).otherwise(F.col("_open")))
    rows = running(rows, ["_file"], "at", "_net", "_after").withColumn("_deep", F.col("_after") - F.col("_net"))
    level = 2 if wrapper else 1
    # entries begin after commas at their depth, and where their depth is entered
    entered = (F.col("_deep") < level) & (F.col("_after") >= level) | (F.col("_deep") < level) & (F.length(outside(F.col("v"))) > 0)
    rows = rows.withColumn("_new", F.when(~F.col("_in") & (F.col("_deep") <= level) | entered, 1).otherwise(0).cast("long"))
    rows = running(rows, ["_file"], "at", "_new", "_entry")
    whole = rows.groupBy("_file", "_entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), ",").alias("_t"), F.min("at").alias("at"), F.min_by("_deep", "at").alias("_deep"))
    if wrapper:
        # the list under the key: from the piece that opens it to the one that closes it
        opens = F.col("_t").rlike(rf'^[{{\s]*"{wrapper}"\s*:\s*\[')
        marks = whole.where(F.col("_deep") < level).select("_file", "at", opens.alias("_on"))
        first = marks.where("_on").groupBy("_file").agg(F.min("at").alias("_a"))
        last = marks.join(first, "_file").where("at > _a").groupBy("_file").agg(F.min("at").alias("_b"))
        whole = whole.join(F.broadcast(first), "_file").join(F.broadcast(last), "_file", "left").where("at >= _a and (_b is null or at < _b)")  # a row for each file
        text = F.regexp_replace("_t", rf'^[{{\s]*"{wrapper}"\s*:\s*\[', "")
    else:
        text = F.when(F.col("_deep") < level, F.regexp_replace("_t", r"^\s*[\[{]", "")).otherwise(F.col("_t"))
    return _closed(whole.withColumn("_x", text))


def _closed(entries: DataFrame) -> DataFrame:
    """Columns _n and _r of entries (_x, text after its opening bracket): what closes more brackets than it opens is cut off."""
    key = r'^\s*("(?:[^"\\]|\\.)*")\s*:'
    keyed = F.col("_x").rlike(key)
    value = F.trim(F.when(keyed, F.regexp_replace("_x", key, "")).otherwise(F.col("_x")))
    name = F.when(keyed, F.from_json(F.concat(F.lit("["), F.regexp_extract("_x", key, 1), F.lit("]")), "array<string>")[0])
    # an object is the shortest beginning that the parser takes whole: the parser stops where it ends
    return entries.select(name.alias("_n"), value.alias("_r"))


#: The file in a folder of versions that names the one to read.
CURRENT = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that was last swapped in."""
    jvm, at, fs = _fs(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(at, CURRENT))
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}/{name}"


def _swapped_in(spark: SparkSession, path: str, write) -> None:
    """``write(folder)`` into a new version; then a pointer is renamed over the old one, and other versions are deleted.

    Until the pointer is renamed, readers have the old version; a write that fails leaves it so, and its folder is deleted.
    """
    jvm, at, fs = _fs(spark, path)
    of = lambda name: jvm.org.apache.hadoop.fs.Path(at, name)
    version = f"v-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{version}")
        staged = of(f"_{version}")
        stream = fs.create(staged, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, of(CURRENT), options)
    except BaseException:
        fs.delete(of(version), True)
        fs.delete(of(f"_{version}"), True)
        raise
    for status in fs.listStatus(at):
        if status.getPath().getName() not in (version, CURRENT):
            fs.delete(status.getPath(), True)


def write_shard(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order of rows, columns and array items, written beside the old version and then swapped in.

    A job that fails while it writes leaves the old version, and a shard may be written from itself. ``read_shard`` reads it.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*[F.sort_array(c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in sorted(df.columns)])
    _swapped_in(df.sparkSession, path, lambda to: rows.repartitionByRange(*order).sortWithinPartitions(*order).write.json(to))


def read_shard(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The rows of a shard's current version."""
    return spark.read.schema(fields).json(current(spark, path))


def publish_slices(df: DataFrame, key: str, slim: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Writes an index of the ``slim`` columns and the rows in slices by a hash of the key; returns the manifest.

    Columns bucket, rows and bytes. Slices hold many keys each, so that their number doesn't grow with the keys. Index and
    slices are swapped in together, as by ``write_shard``; ``read_slices`` reads them.
    """
    rows = df.withColumn("bucket", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets)).cast("int"))

    def write(to: str) -> None:
        rows.select(key, *slim).write.parquet(f"{to}/index")
        rows.repartition("bucket").write.partitionBy("bucket").json(f"{to}/slices")

    _swapped_in(df.sparkSession, out, write)
    return slice_manifest(rows, df.columns)


def read_slices(spark: SparkSession, out: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """The current index, and the current rows with their bucket."""
    at = current(spark, out)
    return spark.read.parquet(f"{at}/index"), spark.read.schema(f"{fields}, bucket int").json(f"{at}/slices")


def slice_manifest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns bucket, rows and bytes (of the rows as JSON)."""
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*columns)))).alias("bytes"))
