"""statline: play-by-play sports statistics as Spark DataFrame jobs.

Every public function takes DataFrames (or a SparkSession plus paths) and
returns DataFrames; nothing is collected to the driver and no Python code
runs per row.  Sub-packages:

* ``sources``   scans, adapters over the shared test tables, CSV/HTML sources, sinks
* ``functions`` column-level building blocks (position translation, array folds)
* ``operators`` the relational operators (sessions, scoring, stats, top-k, rosters)
* ``plans``     composite jobs and the registry of named queries
"""

__version__ = "0.1.0"
