"""flightops: flight-operations analytics as Spark DataFrame jobs.

Layout
------
* ``functions``  scalar column expressions (time parsing, delays, manufacturer, percentages)
* ``sources``    landed JSON / CSV readers, the flight-shaped fixture over the driver tables,
                 the published star schema and sinks
* ``operators``  dimension build, constraint audit, profiling, daily rollups, sized joins
* ``plans``      the report and dashboard queries
* ``streaming``  12-hour collection windows and incremental, de-duplicating ingest

Every public function takes and returns DataFrames; nothing is collected to the driver.
"""

__version__ = "0.1.0"
