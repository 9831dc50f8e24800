"""Readers of the text and table formats; every one is a Spark scan over many files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid import schemas
from driftgrid.plans.lineage import cut
from driftgrid.plans.skew import shuffled

COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'     # commas outside quotes


def read_tracks(spark: SparkSession, path) -> DataFrame:
    """Track CSV files of the current or the older, shorter layout; missing columns are null."""
    # The reader fills absent trailing columns with null when a row is shorter than the schema.
    return spark.read.schema(schemas.TRACKS).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def read_lines(spark: SparkSession, glob, blank: bool = True) -> DataFrame:
    """(file, block, line_no, value): text lines with an order within their file.

    Inside a block line_no has no gaps; without blank, lines of white space are neither kept nor counted.
    """
    text = spark.read.text(glob)
    return (text if blank else text.filter(F.trim("value") != "")).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value"))


def _fields(line="value") -> Column:
    return F.transform(F.split(line, COMMA), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))


def _last_wins(df: DataFrame, keys, packed: str) -> DataFrame:
    """Keep the last line per key; an aggregate, so repeated keys combine map-side."""
    return (df.groupBy(*keys).agg(F.max_by(packed, F.struct("file", "block", "line_no")).alias(packed)))


def read_census(spark: SparkSession, glob) -> DataFrame:
    """(pop_id, step, size, lambda, trait_index, n) of census files named <anything>.<pop>.csv.

    Step, size and growth are read by position, `Trait Index k` columns by header; rows with fewer
    than six fields are skipped and a later row of the same step replaces an earlier one.
    """
    lines = read_lines(spark, glob).withColumns({
        "pop_id": F.regexp_extract("file", r"\.(\d+)\.csv(?:/part-[^/]*)?$", 1).try_cast("int"), "f": _fields()})
    lines = lines.filter(F.col("pop_id").isNotNull())
    header = (lines.filter(F.get("f", F.lit(1)).try_cast("int").isNull() & (F.size("f") >= 6)).groupBy("pop_id").agg(F.max("f").alias("h")))
    rows = lines.filter((F.size("f") >= 6) & F.get("f", F.lit(1)).try_cast("int").isNotNull()).withColumn("step", F.get("f", F.lit(1)).cast("int"))
    kept = _last_wins(rows, ["pop_id", "step"], "f").join(header, "pop_id")
    trait = F.filter(F.transform("h", lambda h, i: F.struct(F.regexp_extract(h, r"^Trait Index\s+(\d+)", 1).try_cast("int").alias("k"),
                                                           F.get("f", i).try_cast("long").alias("n"))), lambda s: s["k"].isNotNull())
    return (kept.select("pop_id", "step", F.get("f", F.lit(2)).cast("long").alias("size"), F.get("f", F.lit(5)).cast("double").alias("lambda"),
                        F.explode_outer(trait).alias("t"))
            .select("pop_id", "step", "size", "lambda", F.col("t.k").alias("trait_index"), F.col("t.n").alias("n")))


def read_probe(spark: SparkSession, glob, acc_names: DataFrame) -> DataFrame:
    """(pop_id, step, agent_id, acc, value): Run, Time Step, Population, Individual, then values.

    acc_names(pop_id, idx, acc) names the columns, default Acc<idx>; text that is no number is 0.
    """
    lines = read_lines(spark, glob).withColumn("f", _fields())
    rows = lines.filter((F.size("f") >= 4) & F.get("f", F.lit(1)).try_cast("int").isNotNull()).withColumns({
        "pop_id": F.get("f", F.lit(2)).cast("int"), "step": F.get("f", F.lit(1)).cast("int"), "agent_id": F.get("f", F.lit(3)).cast("long")})
    kept = _last_wins(rows, ["pop_id", "step", "agent_id"], "f")
    long = kept.select("pop_id", "step", "agent_id", F.posexplode(F.slice("f", F.lit(5), F.greatest(F.size("f") - 4, F.lit(0)))).alias("idx", "raw"))
    out = long.join(acc_names.select("pop_id", "idx", "acc"), ["pop_id", "idx"], "left")
    return out.select("pop_id", "step", "agent_id", F.coalesce("acc", F.concat(F.lit("Acc"), F.col("idx").cast("string"))).alias("acc"),
                      F.coalesce(F.col("raw").try_cast("double"), F.lit(0.0)).alias("value"))


def read_census_log(spark: SparkSession, glob) -> DataFrame:
    """(step, pop_id, size) of the CEN lines of a log; the last line of a step and population wins."""
    rows = (read_lines(spark, glob).filter(F.col("value").startswith("CEN")).withColumn("f", F.transform(F.split("value", ","), lambda x: F.trim(x)))
            .filter(F.size("f") >= 4))
    rows = rows.select("file", "block", "line_no", F.get("f", F.lit(1)).cast("int").alias("step"), F.get("f", F.lit(2)).cast("int").alias("pop_id"),
                       F.get("f", F.lit(3)).cast("long").alias("size"))
    return _last_wins(rows, ["step", "pop_id"], "size")


def read_barrier_text(spark: SparkSession, glob, n_hexagons: int | None = None) -> DataFrame:
    """(hex_id, edge, class_id, class_name, p1, p2) from C and E lines; an undefined class has name ''."""
    text = spark.read.text(glob).select(F.trim("value").alias("v"))
    part = F.split("v", r"\s+")
    c = (text.filter(F.col("v").startswith("C ")).select(part.alias("p"), F.regexp_extract("v", '"([^"]*)"', 1).alias("class_name"))
         .select(F.get("p", F.lit(1)).cast("int").alias("class_id"), F.get("p", F.lit(2)).cast("double").alias("p1"),
                 F.get("p", F.lit(3)).cast("double").alias("p2"), "class_name").dropDuplicates(["class_id"]))
    e = (text.filter(F.col("v").startswith("E ")).select(part.alias("p"))
         .select(F.get("p", F.lit(1)).cast("long").alias("hex_id"), F.get("p", F.lit(2)).cast("int").alias("edge"), F.get("p", F.lit(3)).cast("int").alias("class_id")))
    out = e.join(c, "class_id", "left").select("hex_id", "edge", "class_id", F.coalesce("class_name", F.lit("")).alias("class_name"), "p1", "p2")
    if n_hexagons is not None:
        from driftgrid.operators.checks import barrier_ids, raise_on
        raise_on(barrier_ids(out, n_hexagons), "hex ids out of range")
        raise_on(out.filter((F.col("edge") < 0) | (F.col("edge") > 5)), "edges out of 0..5")
    return out


def read_edge_outcomes(spark: SparkSession, path, cells: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, p_mort, p_defl, p_trans) for edges whose endpoints are known cells.

    Raises on missing columns, probabilities that do not sum to one, and endpoints that are not
    neighbours. A repeated edge keeps its last row.
    """
    from driftgrid.operators.checks import probabilities_sum, raise_on
    have = set(spark.read.option("header", True).csv(path).columns)
    missing = {"from_h3", "to_h3", "mortality", "deflection", "transmission"} - have
    if missing:
        raise ValueError(f"edge file lacks columns {sorted(missing)}; has {sorted(have)}")
    raw = spark.read.option("header", True).csv(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"),
        F.trim("from_h3").alias("from_id"), F.trim("to_h3").alias("to_id"),
        *[F.col(c).cast("double").alias(n) for c, n in (("mortality", "p_mort"), ("deflection", "p_defl"), ("transmission", "p_trans"))])
    ids = cells.select(F.col("cell_id").cast("string").alias("id"))
    known = raw.join(shuffled(ids.withColumnRenamed("id", "from_id")), "from_id", "left_semi").join(shuffled(ids.withColumnRenamed("id", "to_id")), "to_id", "left_semi")
    raise_on(probabilities_sum(known, ["p_mort", "p_defl", "p_trans"]), "edge probabilities do not sum to 1")
    if edges is not None:
        nb = edges.select(F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"))
        raise_on(known.join(shuffled(nb), ["from_id", "to_id"], "left_anti"), "edge endpoints are not neighbours")
    packed = known.withColumn("p", F.struct("p_mort", "p_defl", "p_trans"))
    return _last_wins(packed, ["from_id", "to_id"], "p").select("from_id", "to_id", "p.*")


def file_name(path: str) -> str:
    """Last part of a path written on either kind of system."""
    return path.replace("\\", "/").rsplit("/", 1)[-1]


def read_matrix_csv(spark: SparkSession, path) -> DataFrame:
    """(row, col, value) of a numeric matrix; a first line that is not numeric is a header, blank lines do not count.

    A large file is read by many tasks, one per block. Lines are numbered inside their block; a block's numbers start after
    the lines of the blocks before it in its file, one counted row per block. The lines are checkpointed between the two passes,
    since a block must not be cut anew when executors come or go.
    """
    lines = cut(read_lines(spark, path, blank=False))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"), F.min_by("value", "line_no").alias("line"))
    numeric = F.forall(F.split("line", ","), lambda x: F.trim(x).try_cast("double").isNotNull())
    in_file = Window.partitionBy("file").orderBy("block")
    header = F.when(F.first(numeric).over(in_file), 0).otherwise(1)
    starts = blocks.select("file", "block", (F.sum("n").over(in_file) - F.col("n") - F.col("first") - header).alias("shift"))
    rows = lines.join(starts, ["file", "block"]).select((F.col("line_no") + F.col("shift")).alias("row"), "value").filter("row >= 0")
    return (rows.select("row", F.posexplode(F.split("value", ",")).alias("col", "v"))
            .select("row", F.col("col").cast("long").alias("col"), F.trim("v").cast("double").alias("value")))


def read_layer_csv(spark: SparkSession, path) -> DataFrame:
    """(cell_id, value); file ids count from one."""
    return (spark.read.schema(schemas.LAYER).option("header", True).csv(path)
            .select((F.col("Hex ID") - 1).alias("cell_id"), F.col("Score").alias("value")))


RENAME = {"thetao": "tos", "so": "sos", "uo": "uo", "vo": "vo", "zos": "zos"}


def read_gridded(spark: SparkSession, path, start=None, end=None, variables=None, rename=None) -> DataFrame:
    """(time, lat, lon, var, value) of long parquet forcing; time and variable filters reach the scan."""
    names = rename if rename is not None else RENAME
    df = spark.read.schema(schemas.GRIDDED).parquet(path)
    if start is not None:
        df = df.filter(F.col("time") >= start)
    if end is not None:
        df = df.filter(F.col("time") < end)
    if variables is not None:
        df = df.filter(F.col("var").isin(list(variables)))
    return df.withColumn("var", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("var")), F.col("var")))


def grid_index(df: DataFrame) -> DataFrame:
    """Add gi, the latitude number from the south, and gj, the longitude number from the west.

    Distinct coordinates of a grid are few compared with its values.
    """
    from pyspark.sql import Window
    lat = df.select("lat").distinct().withColumn("gi", (F.row_number().over(Window.orderBy("lat")) - 1).cast("long"))
    lon = df.select("lon").distinct().withColumn("gj", (F.row_number().over(Window.orderBy("lon")) - 1).cast("long"))
    return df.join(lat, "lat").join(lon, "lon")
