"""File scans: pruning by file name, delimited observations, station and configuration tables, map ways."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.functions import text

from .store import small, written

#: Places of file splits are broadcast up to this many (about 100 bytes each).
MAX_SPLITS = 500_000

#: Microgram factors of mass units; mole units also need the molar mass.
MASS = {"kg": 1e9, "g": 1e6, "mg": 1e3, "ug": 1.0}
#: Molar masses in g/mol.
MOLAR = {"NO2": 46.0055, "NO": 30.0061, "O3": 47.9982, "SO2": 64.066, "CO": 28.01}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_time(name: Column, position: int = -1) -> Column:
    """The start time in a name split at underscores, as ``2024-01-05T06-00-00Z``; null if there is none."""
    stamp = F.regexp_replace(F.element_at(F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_"), position), r"(\d{2})-(\d{2})-(\d{2})Z$", "$1:$2:$3")
    return text.parsed_time(F.regexp_replace(stamp, "Z$", "")).cast("timestamp_ntz")


def spans_overlap(start: Column, hours: float, first: Column, last: Column) -> Column:
    return (start <= last) & (start + F.make_dt_interval(F.lit(0), F.lit(int(hours))) >= first)


def name_box(name: Column) -> Column:
    """``(latmin, latmax, lonmin, lonmax)`` from four decimals in a name."""
    nums = F.regexp_extract_all(name, F.lit(r"(-?\d+\.\d+)"), 1)
    part = lambda k, n: F.element_at(nums, k).cast("double").alias(n)
    return F.when(F.size(nums) >= 4, F.struct(part(1, "latmin"), part(2, "latmax"), part(3, "lonmin"), part(4, "lonmax")))


def boxes_overlap(a: Column, latmin, latmax, lonmin, lonmax) -> Column:
    return (a["latmin"] <= latmax) & (a["latmax"] >= latmin) & (a["lonmin"] <= lonmax) & (a["lonmax"] >= lonmin)


def pruned(spark: SparkSession, folder: str, first: str, last: str, hours: float, pattern: str = "*") -> list:
    """Paths of the folder (and its year folders) whose names say that they overlap the span; empty files are left out. Only names and
    sizes are read, by Spark's own file listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    start = file_time(file_name(F.col("path")))
    ok = (F.col("length") > 0) & spans_overlap(start, hours, F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    return [r.path for r in found.filter(ok).select("path").orderBy("path").collect()]  # file names only


def checked_observations(spark: SparkSession, paths, indices=(0, 1, 2, 3, 4, 5), scale: float = 1.0) -> DataFrame:
    """``;``-separated rows of lat, lon, id, time, variable and value at the given indices, all of them: ``reason`` says why a row
    can't be used (``columns``, ``time``, ``place`` or ``value``) and is null if it can; ``line`` is what was read."""
    part = lambda k: F.trim(F.get("cells", k))
    rows = spark.read.text(paths).select(F.col("value").alias("line"), F.split("value", ";").alias("cells"), F.col("_metadata.file_path").alias("source_file"))
    lat, lon, sid, ts, var, value = map(part, indices)
    out = rows.select(
        var.alias("var"), text.clean_id(sid).alias("source_id"), lat.try_cast("double").alias("lat"), lon.try_cast("double").alias("lon"), text.parsed_time(ts).cast("timestamp_ntz").alias("ts"), (value.try_cast("double") * scale).alias("value"), "source_file", "line", (F.size("cells") > max(indices)).alias("_whole")
    )
    reason = F.when(~F.col("_whole"), "columns").when(F.col("ts").isNull(), "time").when(F.col("lat").isNull() | F.col("lon").isNull(), "place").when(F.col("value").isNull(), "value")
    return out.withColumn("reason", reason).drop("_whole")


def long_observations(spark: SparkSession, paths, indices=(0, 1, 2, 3, 4, 5), scale: float = 1.0) -> DataFrame:
    """The rows of ``checked_observations`` that can be used."""
    return checked_observations(spark, paths, indices, scale).filter("reason is null").drop("reason", "line")


def rejected(checked: DataFrame) -> DataFrame:
    """Counts of unusable rows by file and reason, for the log of a scan."""
    return checked.filter("reason is not null").groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("example"))


def wide_observations(spark: SparkSession, paths, id_column: str, time_column: str, variables: list) -> DataFrame:
    """A table with a header, one observation for each known variable's column."""
    df = spark.read.option("sep", ";").option("header", "true").csv(paths)
    have = [v for v in variables if v in df.columns]
    rows = df.unpivot([id_column, time_column], have, "var", "value")
    return rows.select("var", text.clean_id(F.col(id_column)).alias("source_id"), text.parsed_time(F.col(time_column)).cast("timestamp_ntz").alias("ts"), F.col("value").try_cast("double").alias("value")).filter("value is not null and ts is not null")


def open_data(spark: SparkSession, paths) -> DataFrame:
    """Simple features of an open-data XML feed: one row a measurement; NaN and what doesn't parse left out, ids made from coordinates."""
    rows = spark.read.format("xml").option("rowTag", "BsWfsElement").schema("Location string, Time string, ParameterName string, ParameterValue string").load(paths)
    pos = F.split(F.trim("Location"), r"\s+")
    number = lambda x: x.try_cast("double")
    out = rows.select(F.col("ParameterName").alias("var"), number(F.get(pos, 0)).alias("lat"), number(F.get(pos, 1)).alias("lon"), text.parsed_time(F.regexp_replace("Time", "Z$", "")).cast("timestamp_ntz").alias("ts"), number(F.trim("ParameterValue")).alias("value"))
    return out.filter(~F.isnan("value")).dropna(subset=["value", "lat", "lon", "ts"]).withColumn("source_id", text.coordinate_id(F.col("lat"), F.col("lon")))


def stations(spark: SparkSession, paths) -> DataFrame:
    """Station metadata: 16 ``;``-separated columns, of which some are maps or lists."""
    names = ["source_id", "lat", "lon", "imprecision", "height_m", "tz", "scalers", "alias1", "alias2", "clearances", "auto_offset", "banned", "hidden", "type_imprecision", "custom", "rest"]
    df = spark.read.option("sep", ";").schema(", ".join(f"`{n}` string" for n in names)).csv(paths)
    number = lambda n: F.col(n).try_cast("double").alias(n)
    amounts = lambda n: F.transform_values(text.pairs(F.col(n)), lambda k, v: v.try_cast("double")).alias(n)
    tz = F.split("tz", ",")
    return df.filter("source_id is not null").select(
        "source_id", number("lat"), number("lon"), number("imprecision"), number("height_m"), tz[0].try_cast("int").alias("tz"), F.coalesce(F.get(tz, 1).try_cast("int"), tz[0].try_cast("int")).alias("tz_summer"),
        amounts("scalers"), "alias1", "alias2", F.split("clearances", ",").alias("clearances"), (F.lower("auto_offset") == "true").alias("auto_offset"), F.split("banned", ",").alias("banned"), (F.lower("hidden") == "true").alias("hidden"), amounts("type_imprecision"), "custom",
    )


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """``(path, file, line, row, value)``: each line of text files with its number in the file and, files being in the order of their paths, in all of them.

    Lines keep their order within a split of a file, so numbers within a split are shifted by the counts of the splits before it: a table with a row a split."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    lines = written(lines)
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = lambda w: F.sum("n").over(w) - F.col("n")
    files = written(splits.groupBy("path").agg(F.sum("n").alias("n")))
    files = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("file"), before(Window.orderBy("path")).alias("above"))  # a row a file
    places = splits.select("path", "start", "first", before(Window.partitionBy("path").orderBy("start")).alias("shift")).join(files, "path")
    placed = lines.join(small(written(places), MAX_SPLITS), ["path", "start"])
    line = F.col("id") - F.col("first") + F.col("shift")
    return placed.select("path", "file", line.alias("line"), (F.col("above") + line).alias("row"), "value")


def configuration(spark: SparkSession, path: str, numbers=()) -> DataFrame:
    """A table with a header in each of its files, with ``row``, each row's number from 0 over all files in the order of their names (that of a variable or category), and
    the ``numbers`` as doubles."""
    columns = spark.read.option("sep", ";").option("header", "true").csv(path).columns
    rows = numbered_lines(spark, path).filter("line > 0")
    cells = F.from_csv("value", F.lit(", ".join(f"`{c}` string" for c in columns)), {"sep": ";"})
    rows = rows.select((F.col("row") - F.col("file") - 1).alias("row"), cells.alias("c"))
    return rows.select("row", *[F.col(f"c.`{c}`").try_cast("double").alias(c) if c in numbers else F.col(f"c.`{c}`") for c in columns])


def sparse_lines(lines: DataFrame, most: int = 10_000, step: int = 4) -> DataFrame:
    """Numbered lines, of files with over ``most`` every ``step``-th only."""
    long = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("path").alias("_path"))
    found = lines.join(F.broadcast(long), F.col("path") == F.col("_path"), "left")  # a row a long file
    return found.filter(F.col("_path").isNull() | ((F.col("line") + 1) % step == 0)).drop("_path")


def road_weather(spark: SparkSession, paths, box, most: int = 10_000) -> DataFrame:
    """``(file, line, source_id, ts, lat, lon, name, value)`` of road-station lines ``id;time;lat;lon;name=value,name=value`` inside a box; long files are thinned."""
    lines = sparse_lines(numbered_lines(spark, paths), most).withColumn("cells", F.split("value", ";"))
    part = lambda k: F.trim(F.get("cells", k))
    rows = lines.select("file", "line", text.clean_id(part(0)).alias("source_id"), text.parsed_time(part(1)).cast("timestamp_ntz").alias("ts"), part(2).try_cast("double").alias("lat"), part(3).try_cast("double").alias("lon"), F.explode(text.pairs(part(4))).alias("name", "value"))
    return rows.withColumn("value", F.col("value").try_cast("double")).dropna(subset=["ts", "lat", "lon", "value"]).filter(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))


def emission_rows(spark: SparkSession, folder: str, first: str, last: str, box) -> DataFrame:
    """Cells of the emission inventories of a folder that overlap a span of days and a box (latmin, latmax, lonmin, lonmax).

    An inventory's name is ``TYPE_id_category_height m_tmin_tmax_latmin_latmax_lonmin_lonmax.ext``, its lines ``h;w;pollutant;rate``; it may be a
    file or a folder of parts. Names alone decide what is read: the filters on them prune the files.
    """
    kind = "h long, w long, pollutant string, rate double"
    rows = spark.read.option("sep", ";").option("recursiveFileLookup", "true").schema(kind).csv(folder)
    tags = F.split(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[a-z]+(?:/part-[^/]*)?$", 1), "_")
    number = lambda k: F.get(tags, k).try_cast("double")
    inside = (F.get(tags, 4) <= last) & (F.get(tags, 5) >= first) & (number(6) <= box[1]) & (number(7) >= box[0]) & (number(8) <= box[3]) & (number(9) >= box[2])
    named = rows.select("*", F.get(tags, 0).alias("type"), F.get(tags, 1).alias("emitter"), F.get(tags, 2).try_cast("long").alias("cat"), F.regexp_replace(F.get(tags, 3), "m$", "").try_cast("double").alias("height_m"), inside.alias("_inside"))
    return named.filter("_inside").drop("_inside").dropna(subset=["h", "w", "rate"])


def grid_points(headers: DataFrame, cells: DataFrame, box) -> DataFrame:
    """Gridded fields as points: ``headers(grid_id, var, ts, latmin, latmax, lonmin, lonmax, n_rows, n_columns)`` that meet the box, joined with
    ``cells(grid_id, h, w, value)``; row 0 is the north edge, values stand for cell centres. Missing values are left out."""
    near = headers.filter((F.col("latmin") <= box[1]) & (F.col("latmax") >= box[0]) & (F.col("lonmin") <= box[3]) & (F.col("lonmax") >= box[2]))
    rows = cells.filter("value is not null and not isnan(value)").join(near, "grid_id")
    lat = F.col("latmax") - (F.col("h") + 0.5) * (F.col("latmax") - F.col("latmin")) / F.col("n_rows")
    lon = F.col("lonmin") + (F.col("w") + 0.5) * (F.col("lonmax") - F.col("lonmin")) / F.col("n_columns")
    points = rows.select("grid_id", "var", "ts", "h", "w", lat.alias("lat"), lon.alias("lon"), "value")
    return points.filter(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))


def maintenance(spark: SparkSession, paths, seen: DataFrame = None) -> DataFrame:
    """Road actions from JSON lines; rows that ``seen`` has are left out."""
    kind = "id string, event string, time string, lon double, lat double"
    rows = spark.read.text(paths).select(F.from_json("value", kind).alias("j")).select("j.*").dropDuplicates()
    action = F.coalesce(*[F.when(F.col("event") == code, name) for code, name in [("1", "plough"), ("2", "salt"), ("3", "sand"), ("4", "sweep"), ("5", "grade"), ("6", "wash")]], F.lit("other"))
    rows = rows.select("id", action.alias("action"), text.parsed_time(F.col("time")).cast("timestamp_ntz").alias("ts"), "lon", "lat")
    return rows if seen is None else rows.join(seen, ["id", "action", "ts"], "left_anti")


def ways(spark: SparkSession, paths) -> DataFrame:
    """Map ways from XML: id, node references and tags."""
    df = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>").load(paths)
    return df.select(F.col("_id").alias("way_id"), F.transform("nd", lambda x: x["_ref"]).alias("nodes"), F.coalesce(F.map_from_arrays(F.transform("tag", lambda x: x["_k"]), F.transform("tag", lambda x: x["_v"])), F.create_map().cast("map<string, string>")).alias("tags"))


def to_micrograms(value: Column, unit: Column, substance: Column) -> Column:
    """Mass or moles per cubic metre as micrograms."""
    out = F.lit(None).cast("double")
    for u, f in MASS.items():
        out = F.when(unit == u, value * f).otherwise(out)
    molar = F.lit(None).cast("double")
    for s, m in MOLAR.items():
        molar = F.when(substance == s, F.lit(m)).otherwise(molar)
    return F.when(unit == "mole", value * molar * 1e6).otherwise(out)
