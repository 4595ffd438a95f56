"""S-6: the star published in versions, so that a landing is merged whole or not at all.

Every publish writes new folders (``<table>/commit=<id>/...``) and never touches old ones. A
version is one small JSON file that names the live folders of all tables; it is created last, so
a reader sees the star before a landing or after it, and a writer that stops half-way leaves
only folders that no version names (``drop_unreferenced`` removes them). One writer at a
time: a version's file is created exclusively, and a second writer from the same version fails.

Besides airports, flights and aircraft a version holds four tables that make a merge cost what
the landing holds, not what history holds:

* ``requests``: which partitions of the fact hold rows of a request (airport, window start),
  by window month. It tells which partitions lose rows when the request is answered again.
* ``sightings``: the first sight of each registration inside each request, by window month. It
  replaces a first sight whose request was answered anew.
* ``delays``: the daily rollup A-9, partitioned like the fact.
* ``sketches``: mergeable distinct counts of each day (``operators.sketches``), likewise.

Merging a landing. A request with a window start owns the rows it brought; answering it again
replaces exactly these. Rows without a window start belong to no request: they are added,
and nothing replaces them. Partitions that lose a row are rewritten without it; partitions that
only gain rows get one more folder, and are put together once they have ``MAX_FOLDERS``.
Airports are merged by code. The rollup is computed again for the partitions that changed;
a day that lost its last flight is gone with the partition's old folder. The aircraft dimension
takes the least of the old first sights that still stand, the landing's, and, for those
whose request was replaced, the sightings left.

The driver handles names of folders and partitions, as for any partitioned table, never rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightops import schemas
from flightops.functions import expressions as X
from flightops.operators.cluster import clustered
from flightops.operators.rollups import airport_delays_daily
from flightops.operators.sketches import daily_sketches
from flightops.session import new_scratch_path

VERSIONS = "versions"
COMMIT = "commit"
WINDOW_MONTH = "window_month"
#: Folders of one partition before a merge puts them together.
MAX_FOLDERS = 8
OWNER = ["airport", "window_from"]
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class VersionConflict(RuntimeError):
    """Another writer has published since the version that a merge started from."""


@dataclass(frozen=True)
class Version:
    """What one version file holds: live folders and schema of each table."""
    number: int
    partition_by: str
    live: dict[str, list[str]]
    schemas: dict[str, dict]
    base: int = 0


# ------------------------------------------------------------------------------ files

def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[1:-5]) for n in names(spark, f"{root}/{VERSIONS}") if n.startswith("v") and n.endswith(".json")]


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The version with this number, or the last complete one; None where there is none. A file
    cut off by a writer's death doesn't parse and doesn't count."""
    for n in [number] if number is not None else sorted(_numbers(spark, root), reverse=True):
        fs, where = _fs(spark, f"{root}/{VERSIONS}/v{n:09d}.json")
        if not fs.exists(where):
            continue
        stream = fs.open(where)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Version(**json.loads(text))
        except ValueError:
            continue
    return None


def commit(spark: SparkSession, root: str, version: Version) -> Version:
    """Make a prepared version the star's last one."""
    taken = _numbers(spark, root)
    last = read_version(spark, root)
    if (last.number if last else 0) != version.base:
        raise VersionConflict(f"started from version {version.base}, now there is {last.number if last else 0}")
    version = replace(version, number=max(taken, default=0) + 1)
    fs, where = _fs(spark, f"{root}/{VERSIONS}/v{version.number:09d}.json")
    out = fs.create(where, False)
    try:
        out.write(bytearray(json.dumps(version.__dict__), "utf-8"))
    finally:
        out.close()
    return version


def drop_unreferenced(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove version files but the last ``keep``, and commits that none of these names. Only
    when no writer is at work. Returns what was removed."""
    numbers = sorted(_numbers(spark, root))[-keep:]
    kept = [v for n in numbers if (v := read_version(spark, root, n)) is not None]
    gone = [f"{VERSIONS}/v{n:09d}.json" for n in _numbers(spark, root) if n not in numbers]
    for table in sorted({t for v in kept for t in v.live}):
        used = {folder.split("/")[0] for v in kept for folder in v.live.get(table, [])}
        gone += [f"{table}/{c}" for c in names(spark, f"{root}/{table}") if c.startswith(f"{COMMIT}=") and c not in used]
    for name in gone:
        remove(spark, f"{root}/{name}")
    return gone


# ------------------------------------------------------------------------------ tables

def read_table(spark: SparkSession, root: str, version: Version, table: str,
               partitions: set[str] | None = None) -> DataFrame:
    """A table of a version; ``partitions`` (folder names such as ``flight_month=1995-03``) reads
    those alone."""
    schema = T.StructType.fromJson(version.schemas[table])
    folders = [f for f in version.live[table] if partitions is None or f.split("/")[-1] in partitions]
    if not folders:
        return spark.createDataFrame([], schema)
    with_commit = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])
    return (spark.read.schema(with_commit).option("basePath", f"{root}/{table}")
            .parquet(*[f"{root}/{table}/{f}" for f in folders]).drop(COMMIT))


def _write(df: DataFrame, root: str, table: str, partition_by: str | None = None) -> list[str]:
    """Write one commit of a table; its live folders."""
    name = f"{COMMIT}={uuid.uuid4().hex}"
    if table == "flights":
        # the request stands in the order too: exchanged once
        df = _owned(clustered(df.drop(*OWNER), partition_by))
    elif partition_by and table != "sightings":   # these come dealt
        df = df.hint("rebalance", partition_by)
    writer = df.write.option("partitionOverwriteMode", "static").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/{table}/{name}")
    if not partition_by:
        return [name]
    return [f"{name}/{p}" for p in names(df.sparkSession, f"{root}/{table}/{name}") if p.startswith(f"{partition_by}=")]


def partition_name(column: str) -> Column:
    """The folder name of a partition value (a date, or a text without special characters)."""
    return F.concat(F.lit(f"{column}="), F.coalesce(F.col(column).cast("string"), F.lit(_NO_VALUE)))


def _distinct(df: DataFrame, column: Column) -> set[str]:
    return {r[0] for r in df.select(column).distinct().collect()}


def _window_month(df: DataFrame) -> DataFrame:
    return df.withColumn(WINDOW_MONTH, F.substring("window_from", 1, 7))


def _sights(flights: DataFrame) -> DataFrame:
    """Every sight of a registration: order and values, and the request."""
    reg = F.col("aircraft_reg")
    values = F.struct("aircraft_model", "airline_name")
    first = F.struct(F.col(schemas.SEEN_ORDER).alias("seen"), values.alias("values")).alias("first")
    return flights.where(reg.isNotNull() & (reg != "")).select("aircraft_reg", first, *OWNER)


def _sightings(flights: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """First sight of each registration inside each request, and the ``kept`` ones of an earlier
    version as they are. One exchange, by month and airport: it deals them for the aggregation and
    for the folders as well. The request stands beside the order there, so the order goes without it."""
    sights = _window_month(_sights(flights)).withColumn("_new", F.lit(True))
    if kept is not None:
        sights = sights.unionByName(kept.withColumn("_new", F.lit(False)))
    seen, values = F.col("first.seen"), F.col("first.values")
    fields = sights.schema["first"].dataType["seen"].dataType.fieldNames()
    rest = [f for f in fields if f not in OWNER]
    if rest:
        sights = sights.withColumn("first", F.struct(F.struct(*[seen[f].alias(f) for f in rest]).alias("seen"), values.alias("values")))
    found = (sights.repartition(WINDOW_MONTH, "airport").groupBy("aircraft_reg", *OWNER, WINDOW_MONTH, "_new")
             .agg(F.min("first").alias("first")))
    if rest:
        whole = F.struct(*[(F.col(f) if f in OWNER else seen[f]).alias(f) for f in fields])
        found = found.withColumn("first", F.struct(whole.alias("seen"), values.alias("values")))
    return found.select("aircraft_reg", *OWNER, "first", WINDOW_MONTH)


def _dimension(sights: DataFrame) -> DataFrame:
    """Sightings -> the aircraft dimension, with the sight that each row comes from."""
    best = sights.groupBy("aircraft_reg").agg(F.min(F.struct("first", *OWNER)).alias("_best"))
    values = F.col("_best.first.values")
    return best.select(
        "aircraft_reg", values["aircraft_model"].alias("aircraft_model"),
        X.manufacturer(values["aircraft_model"]).alias("manufacturer"),
        values["airline_name"].alias("airline_name"), "_best.first", *[F.col(f"_best.{c}") for c in OWNER])


def _owned(flights: DataFrame) -> DataFrame:
    """Flights with their request as columns."""
    order = F.col(schemas.SEEN_ORDER)
    kind = dict(flights.dtypes).get(schemas.SEEN_ORDER, "")
    if "window_from" not in kind:
        raise ValueError(f"flights need the request they came with ({schemas.SEEN_ORDER})")
    return flights.withColumns({c: order[c] for c in OWNER})


def _index(flights: DataFrame, partition_by: str) -> DataFrame:
    return _window_month(flights.where(F.col("window_from").isNotNull()).select(
        *OWNER, partition_name(partition_by).alias("partition")).distinct())


def _described(tables: dict[str, DataFrame]) -> dict[str, dict]:
    return {name: json.loads(df.schema.json()) for name, df in tables.items()}


def _check_grain(partition_by: str) -> None:
    if partition_by not in (schemas.FLIGHT_DATE, schemas.FLIGHT_MONTH):
        raise ValueError(f"versions are partitioned by {schemas.FLIGHT_DATE} or {schemas.FLIGHT_MONTH}")


# ------------------------------------------------------------------------------ publishing

def prepare_replace(spark: SparkSession, root: str, airports: DataFrame, flights: DataFrame,
                    partition_by: str = schemas.FLIGHT_MONTH) -> Version:
    """Write a whole star; ``commit`` makes it the last version."""
    _check_grain(partition_by)
    last = read_version(spark, root)
    flights = _owned(flights)
    live = {"airports": _write(airports, root, "airports"), "flights": _write(flights, root, "flights", partition_by)}
    known = {"airports": airports, "flights": flights}
    version = Version(0, partition_by, live, _described(known), last.number if last else 0)
    written = read_table(spark, root, version, "flights")
    parts = {"requests": (_index(written, partition_by), WINDOW_MONTH), "sightings": (_sightings(written), WINDOW_MONTH)}
    for name, (df, by) in parts.items():
        live[name] = _write(df, root, name, by)
        known[name] = df
    for name, roll in ROLLUPS.items():
        known[name] = roll(written, partition_by)
        live[name] = _write(known[name], root, name, partition_by)
    sights = read_table(spark, root, replace(version, live=live, schemas=_described(known)), "sightings")
    known["aircraft"] = _dimension(sights)
    live["aircraft"] = _write(known["aircraft"], root, "aircraft")
    return replace(version, live=live, schemas=_described(known))


def _rollup(flights: DataFrame, partition_by: str) -> DataFrame:
    """The daily rollup of whole partitions, with their partition column."""
    daily = airport_delays_daily(flights)
    day = F.col("delay_date")
    return daily.withColumn(partition_by, day if partition_by == schemas.FLIGHT_DATE else F.date_format(day, "yyyy-MM"))


def _day_sketches(flights: DataFrame, partition_by: str) -> DataFrame:
    daily = daily_sketches(flights)
    if partition_by == schemas.FLIGHT_DATE:
        return daily
    return daily.withColumn(partition_by, F.date_format(schemas.FLIGHT_DATE, "yyyy-MM"))


#: Tables made of whole partitions of the fact: their groups never cross a partition.
ROLLUPS = {"delays": _rollup, "sketches": _day_sketches}


def _renewed(live: list[str], touched: set[str], written: list[str]) -> list[str]:
    return [f for f in live if f.split("/")[-1] not in touched] + written


def touched_partitions(spark: SparkSession, root: str, last: Version, owners: DataFrame) -> set[str]:
    """Partitions of the fact that hold rows of these requests, from the index of their months."""
    months = _distinct(owners, partition_name(WINDOW_MONTH))
    index = read_table(spark, root, last, "requests", months)
    return _distinct(index.join(owners, OWNER, "left_semi"), F.col("partition"))


def prepare_merge(spark: SparkSession, root: str, flights: DataFrame, airports: DataFrame | None = None,
                  answered: DataFrame | None = None) -> Version:
    """Write what a landing changes; ``commit`` makes it the last version. ``answered`` (airport,
    window_from) names the requests of the landing, so that an answer without flights
    replaces too; without it those that hold a flight count. Rows and requests without a
    window start are added and replace nothing."""
    last = read_version(spark, root)
    if last is None:
        raise ValueError(f"no version to merge into at {root}")
    by = last.partition_by
    staged = new_scratch_path(spark, "landing")
    _owned(flights).write.option("compression", "zstd").parquet(staged)
    new = spark.read.schema(_owned(flights).schema).parquet(staged)
    owners = new.select(*OWNER)
    if answered is not None:
        owners = owners.unionByName(answered.select(*OWNER))
    owners_path = new_scratch_path(spark, "owners")
    _window_month(owners.where(F.col("window_from").isNotNull() & F.col("airport").isNotNull())
                  .distinct()).write.parquet(owners_path)
    owners = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in (*OWNER, WINDOW_MONTH)])).parquet(owners_path)
    months = _distinct(owners, partition_name(WINDOW_MONTH))

    # the fact: partitions that lose rows are rewritten, others only gain a folder
    gains = _distinct(new, partition_name(by))
    loses = touched_partitions(spark, root, last, owners)
    crowded = {p for p in gains if sum(f.endswith(f"/{p}") for f in last.live["flights"]) >= MAX_FOLDERS}
    stays = read_table(spark, root, last, "flights", loses | crowded).join(owners, OWNER, "left_anti")
    live = dict(last.live)
    live["flights"] = _renewed(live["flights"], loses | crowded, _write(
        stays.unionByName(new, allowMissingColumns=True), root, "flights", by))
    # tables by window month: the landing's months are rewritten, rows without a window only added
    fresh = {"requests": lambda kept: kept.unionByName(_index(new, by).select(*kept.columns)),
             "sightings": lambda kept: _sightings(new, kept)}
    for name, joined in fresh.items():
        kept = read_table(spark, root, last, name, months).join(owners, OWNER, "left_anti")
        live[name] = _renewed(live[name], months, _write(joined(kept), root, name, WINDOW_MONTH))
    now = replace(last, number=0, live=live, base=last.number)
    # the rollups: whole partitions that changed, read from their live folders
    changed = gains | loses | crowded
    for name, roll in ROLLUPS.items():
        live[name] = _renewed(live[name], changed, _write(
            roll(read_table(spark, root, now, "flights", changed), by), root, name, by))
    # the dimension: first sights that stand, the landing's, and what is left of replaced ones
    old = read_table(spark, root, last, "aircraft")
    stand = old.join(owners, OWNER, "left_anti").select("aircraft_reg", "first", *OWNER)
    retracted = old.join(owners, OWNER, "left_semi").select("aircraft_reg")
    sights = stand.unionByName(_sights(new).select(*stand.columns))   # the least of all: grouped once
    if not retracted.isEmpty():
        left = read_table(spark, root, now, "sightings").join(retracted, "aircraft_reg", "left_semi")
        sights = sights.unionByName(left.select(*stand.columns))
    live["aircraft"] = _write(_dimension(sights), root, "aircraft")
    if airports is not None:
        code = F.coalesce("iata_code", "icao_code")
        given = airports.select(code.alias("_code")).distinct()
        kept = read_table(spark, root, last, "airports").withColumn("_code", code)
        kept = kept.join(given, "_code", "left_anti").drop("_code")
        live["airports"] = _write(kept.unionByName(airports), root, "airports")
    for path in (staged, owners_path):
        remove(spark, path)
    return now
