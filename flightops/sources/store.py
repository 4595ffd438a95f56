"""The published star schema: airports, aircraft, flights as Parquet tables.

Reports read the published tables, as the reference's dashboard reads its database
file: the derivation (joins over the raw inputs, the aircraft dimension) runs once, and
the written tables also cut lineage, so a lost executor recomputes from Parquet, not from
the raw inputs.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops import schemas
from flightops.operators import joins
from flightops.operators.dims import aircraft_dimension
from flightops.session import new_scratch_path
from flightops.sources import fixture, versions
from flightops.sources.sinks import publish_table


@dataclass
class Star:
    airports: DataFrame
    flights: DataFrame
    aircraft: DataFrame
    rows: dict[str, int] = field(default_factory=dict)
    path: str | None = None
    bounded: dict[str, bool] = field(default_factory=dict)   # size checks made so far

    def _sized(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if name not in self.bounded:
            self.bounded[name] = (self.rows.get(name, 0) <= joins.BROADCAST_MAX_ROWS
                                  and joins.has_bounded_size(table))
        return joins.sized_broadcast(table, bounded=self.bounded[name])

    @property
    def airports_dim(self) -> DataFrame:
        """Airports, broadcast-hinted when its bytes (checked once) are within bound."""
        return self._sized("airports")

    @property
    def aircraft_dim(self) -> DataFrame:
        return self._sized("aircraft")


def publish_star(spark: SparkSession, airports: DataFrame, flights: DataFrame, path: str,
                 aircraft: DataFrame | None = None,
                 flights_partition_by: str | None = schemas.FLIGHT_DATE,
                 mode: str = "replace", answered: DataFrame | None = None) -> Star:
    """Write the three tables below ``path`` and return them opened from Parquet.

    ``mode="replace"`` replaces all tables. ``mode="merge"`` adds a landing as a new version
    (``versions``): of the flights on disk, exactly those of the re-landed requests (polled
    airport and window start) are replaced, whatever day they depart on; rows without a window
    start are added; airports are merged by code. A star published plainly is taken over as its
    first version, with one rewrite; from then on ``path`` is read by version, and a replace
    makes a version too. Versions need ``flights_partition_by``.
    ``answered`` (airport, window_from) names the requests of the landing, so that an answer
    without flights replaces too; without it only requests that hold a flight count.

    ``flights_partition_by``: ``flight_date`` (default) gives one folder per day, the
    right grain when a day holds many row groups and jobs re-land or prune by day.
    ``None`` writes the rows in the partitions they arrive in (one file per task), the
    right choice when days are sparse: no folder per day, no extra shuffle.

    The aircraft dimension is derived from the *written* flights when not given, so the
    derivation of flights is not run twice.
    """
    if mode not in ("replace", "merge"):
        raise ValueError(f"mode must be 'replace' or 'merge', not {mode!r}")
    if mode == "merge" or versions.read_version(spark, path) is not None:
        return publish_version(spark, airports, flights, path, flights_partition_by, mode, answered)
    publish_table(airports, f"{path}/airports")
    landed = flights
    if flights_partition_by and "window_from" in dict(flights.dtypes).get(schemas.SEEN_ORDER, ""):
        order = F.col(schemas.SEEN_ORDER)
        landed = flights.withColumns({c: order[c] for c in ("airport", "window_from")})
    publish_table(landed, f"{path}/flights", partition_by=flights_partition_by)
    written_flights = spark.read.parquet(f"{path}/flights")
    if aircraft is None:
        aircraft = aircraft_dimension(written_flights)
    publish_table(aircraft, f"{path}/aircraft")
    return open_star(spark, path)


def publish_version(spark: SparkSession, airports: DataFrame, flights: DataFrame, path: str,
                    partition_by: str, mode: str = "merge", answered: DataFrame | None = None) -> Star:
    """Publish a whole star, or merge a landing, as the next version at ``path``."""
    if versions.read_version(spark, path) is None and mode == "merge":
        plain = versions.names(spark, f"{path}/flights")
        if plain:
            before = {t: spark.read.parquet(f"{path}/{t}") for t in ("airports", "flights")}
            versions.commit(spark, path, versions.prepare_replace(spark, path, before["airports"], before["flights"], partition_by))
        else:
            mode = "replace"
    prepared = (versions.prepare_merge(spark, path, flights, airports, answered) if mode == "merge"
                else versions.prepare_replace(spark, path, airports, flights, partition_by))
    versions.commit(spark, path, prepared)
    return open_star(spark, path)


def open_star(spark: SparkSession, path: str, version: int | None = None) -> Star:
    """The star at ``path``: its last version (or the one given), else its plain tables."""
    found = versions.read_version(spark, path, version)
    if found is not None:
        tables = {name: versions.read_table(spark, path, found, name) for name in ("airports", "flights", "aircraft")}
        tables["aircraft"] = tables["aircraft"].select(*schemas.AIRCRAFT_COLUMNS)
        rows = {name: tables[name].count() for name in ("airports", "aircraft")}
        return Star(tables["airports"], tables["flights"], tables["aircraft"], rows, path)
    tables = {name: spark.read.parquet(f"{path}/{name}")
              for name in ("airports", "flights", "aircraft")}
    # Proven row counts for the broadcast decisions, dimensions only (the fact is never
    # broadcast). Parquet counts come from file footers: no column data is read.
    rows = {name: tables[name].count() for name in ("airports", "aircraft")}
    return Star(tables["airports"], tables["flights"], tables["aircraft"], rows, path)


def publish_from_landing(spark: SparkSession, airport_docs_path: str, envelopes_path: str,
                         path: str, flights_partition_by: str | None = schemas.FLIGHT_DATE,
                         mode: str = "replace") -> Star:
    """The production path: landed airport documents and flight envelopes -> published
    star (airports, flights partitioned by day, aircraft by first sight in poll order)."""
    from flightops.sources import landing

    airports = landing.airports_from_docs(landing.read_airport_docs(spark, airport_docs_path))
    envelopes = landing.read_envelopes(spark, envelopes_path)
    return publish_star(spark, airports, landing.flights_from_envelopes(envelopes), path,
                        flights_partition_by=flights_partition_by, mode=mode,
                        answered=landing.answered_requests(envelopes))


def fixture_star(spark: SparkSession, sf_dir: str) -> Star:
    """Lazy (unpublished) star over the driver tables; the aircraft dimension is derived
    from the lazy flights plan."""
    flights = fixture.flights(spark, sf_dir)
    return Star(fixture.airports(spark, sf_dir), flights, aircraft_dimension(flights))


_PUBLISHED: dict[tuple[str, str], Star] = {}
_LOCK = threading.Lock()


def warehouse(spark: SparkSession, sf_dir: str) -> Star:
    """The fixture star for ``sf_dir``, published once per application below the shared
    scratch folder and reused by every report of that application.

    The fixture spans about seven years with a few hundred flights per day at most, so
    daily folders would be thousands of tiny files; it is published without date folders
    (see ``publish_star``)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        star = _PUBLISHED.get(key)
        if star is None:
            path = new_scratch_path(spark, "star")
            star = publish_star(spark, fixture.airports(spark, sf_dir),
                                fixture.flights(spark, sf_dir), path,
                                flights_partition_by=None)
            _PUBLISHED[key] = star
        return star
