"""Named queries over the shared test tables.

Each entry takes ``(spark, data_dir)`` and returns a DataFrame whose columns
match the SQL of the same name in :mod:`statline.plans.oracle`.  Session arrays
are reported as sizes, sums and min/max ids, and by ``ordered_game_sessions``
element by element.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.functions.arrays import collect_distinct, fold_sums, null_safe_array_union, within
from statline.operators import positions as P
from statline.operators import predict as PR
from statline.operators import rosters as R
from statline.operators import scoring as SC
from statline.operators import sessions as S
from statline.operators import stats as ST
from statline.operators import summaries as SM
from statline.operators import topk as T
from statline.plans import fixtures as FX
from statline.plans import jobs as J
from statline.plans.store import Store, fingerprint
from statline.session import scratch_path
from statline.sources import html_tables as H
from statline.sources import rejects as RJ
from statline.sources import schedule as SCH
from statline.sources import sinks as K
from statline.sources.play_views import TARGET_YEAR, play_tables
from statline.sources.tables import table
from statline.sources.warehouse import (
    PlayTables,
    save_warehouse,
    stored_points,
    warehouse_tables,
)

Query = Callable[[SparkSession, str], DataFrame]


def points(t: PlayTables) -> DataFrame:
    """player_game_points as the downstream jobs read it (flat path)."""
    return SC.player_game_points_flat(t)


def season_stats(spark: SparkSession, d: str) -> DataFrame:
    t = play_tables(spark, d)
    return ST.season_stats(points(t), t.games)


def yearly(t: PlayTables) -> DataFrame:
    return ST.scored_in(ST.player_yearly_stats(ST.season_stats(points(t), t.games)), TARGET_YEAR)


def groups(t: PlayTables) -> DataFrame:
    return P.position_groups(yearly(t), P.normalized_positions(t.players), TARGET_YEAR)


def year_groups(t: PlayTables) -> DataFrame:
    """Position groups of the target year's scorers, without other seasons."""
    return P.scorer_groups(ST.year_scorers(points(t), t.games, TARGET_YEAR),
                           P.normalized_positions(t.players))


def top(t: PlayTables, best: bool) -> DataFrame:
    return T.top_players(year_groups(t), best=best)


def _session_summary(kind: str, by_game: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = play_tables(spark, d)
        nested = S.sessions(t, kind, by_game=by_game)
        keys = ["player", "gid"] if by_game else ["player"]
        arr = F.col(kind)
        pids = F.transform(arr, lambda x: x["pid"])
        if kind == "fgxp":
            per_part = nested.select(
                *keys, F.size(arr).alias("n"), fold_sums(arr, ["dist"])["dist"].alias("dist"),
                F.array_distinct(F.transform(arr, lambda x: x["fgxp"])).alias("kinds"),
                F.array_min(pids).alias("lo"), F.array_max(pids).alias("hi"))
            return per_part.groupBy(*keys).agg(
                F.sum("n").cast("bigint").alias("n_plays"), F.sum("dist").alias("dist"),
                F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).cast("bigint")
                .alias("kinds"),
                F.min("lo").alias("first_pid"), F.max("hi").alias("last_pid"))
        fields = ["yds", "td", "conv"] + (["intcpt"] if kind == "passes" else [])
        sums = fold_sums(arr, fields)
        per_part = nested.select(*keys, F.size(arr).alias("n"),
                                 *[sums[f].alias(f) for f in fields],
                                 F.array_min(pids).alias("lo"), F.array_max(pids).alias("hi"))
        return per_part.groupBy(*keys).agg(
            F.sum("n").cast("bigint").alias("n_plays"),
            *[F.sum(f).alias(f) for f in ["yds", "td", "conv"]],
            F.min("lo").alias("first_pid"), F.max("hi").alias("last_pid"),
            *([F.sum("intcpt").alias("intcpt")] if kind == "passes" else []))
    return run


def _size(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.size(c))


def session_report(s: DataFrame, by_game: bool) -> DataFrame:
    """Size, yards (distance for kicks) and least and greatest play id of each
    array, per player (and game)."""
    sums, least, greatest, names = [], [], [], []
    for kind in S.KINDS:
        amount = "dist" if kind == "fgxp" else "yds"
        pids = F.transform(kind, lambda x: x["pid"])
        sums += [(_size(kind).cast("bigint"), f"n_{kind}"),
                 (fold_sums(kind, [amount])[amount].cast("bigint"), f"{amount}_{kind}")]
        least.append((F.array_min(pids), f"first_{kind}"))
        greatest.append((F.array_max(pids), f"last_{kind}"))
        names += [f"n_{kind}", f"{amount}_{kind}", f"first_{kind}", f"last_{kind}"]
    if by_game:
        return S.add_up(s, sums, least, greatest).select("player", "gid", *names)
    return s.groupBy("player").agg(
        *[f(value).alias(name) for f, cols in ((F.sum, sums), (F.min, least), (F.max, greatest))
          for value, name in cols]).select("player", *names)


def _scoring_sessions(by_game: bool, method: str = "union") -> Query:
    return lambda spark, d: session_report(
        S.scoring_sessions(play_tables(spark, d), by_game=by_game, method=method), by_game)


def _top(best: bool) -> Query:
    return lambda spark, d: top(play_tables(spark, d), best)


def _rosters(best: bool, strict: bool, unordered: bool) -> Query:
    return lambda spark, d: R.rosters(top(play_tables(spark, d), best), strict=strict,
                                      unordered=unordered)


def _prediction(t: PlayTables) -> DataFrame:
    return PR.player_prediction(points(t), t.games, t.players)


def prediction_extract(spark: SparkSession, d: str) -> DataFrame:
    t = play_tables(spark, d)
    return PR.prediction_extract(_prediction(t), t.players)


def sql_player_game_points(spark: SparkSession, d: str) -> DataFrame:
    """Points from ``spark.sql`` over the per-game session view, with the
    registered SQL scoring functions (sums per part, formulas on totals)."""
    from statline.functions.sql import register_sql_functions

    register_sql_functions(spark)
    view = f"scoring_game_sessions_{uuid.uuid4().hex[:12]}"
    S.scoring_sessions(play_tables(spark, d), by_game=True).createOrReplaceTempView(view)
    scored = spark.sql(f"""
        SELECT player, gid,
               passing_points(sum(p.yds), sum(p.intcpt), sum(p.td), sum(p.conv)) AS passing,
               running_points(sum(r.yds), sum(r.td), sum(r.conv)) AS rushing,
               running_points(sum(c.yds), sum(c.td), sum(c.conv)) AS receiving
        FROM (SELECT player, gid, pass_sums(passes) AS p, run_sums(rushes) AS r,
                     run_sums(receptions) AS c
              FROM {view}) folded
        GROUP BY player, gid""")
    # the plan holds the sessions; the name would stand among the tables of every database
    spark.catalog.dropTempView(view)
    return scored


def within_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Scalar in-row query (``within``) per player-game session: yards per kind."""
    s = S.scoring_sessions(play_tables(spark, d), by_game=True)
    per_part = s.select("player", "gid", *[
        within(arr, ["yds"], lambda t: t["yds"]).alias(f"{arr}_yds")
        for arr in ("passes", "rushes", "receptions")])
    return per_part.groupBy("player", "gid").agg(
        *[F.sum(f"{arr}_yds").alias(f"{arr}_yds") for arr in ("passes", "rushes", "receptions")])


def positions_per_game(spark: SparkSession, d: str) -> DataFrame:
    """collect_distinct: sorted distinct roster positions of the players with
    points in each game (a set bounded by the position vocabulary)."""
    t = play_tables(spark, d)
    pos = P.normalized_positions(t.players)
    pts = points(t).select(F.col("player").alias("player_id"), "gid")
    return (pts.join(pos, "player_id").groupBy("gid")
            .agg(F.array_join(collect_distinct("position"), ",").alias("positions")))


def passer_receiver_plays(spark: SparkSession, d: str) -> DataFrame:
    """array_union: distinct play ids a player took part in as passer or
    receiver, per player-game.  Only the two kinds read are built."""
    s = S.scoring_sessions(play_tables(spark, d), by_game=True, kinds=("passes", "receptions"))
    pids = {a: F.transform(a, lambda x: x["pid"]) for a in ("passes", "receptions")}
    u = null_safe_array_union(F.when(F.col("passes").isNotNull(), pids["passes"]),
                              F.when(F.col("receptions").isNotNull(), pids["receptions"]))
    return (s.filter(F.col("passes").isNotNull() | F.col("receptions").isNotNull())
            .select("player", "gid", F.size(u).alias("n"))
            .groupBy("player", "gid").agg(F.sum("n").cast("bigint").alias("plays")))


def schedule_csv(spark: SparkSession, d: str) -> DataFrame:
    """Schedule lines rendered from orders, written as headerless CSV text
    (one folder per season) and read back with the schedule schema."""
    path = scratch_path(spark, "schedule")
    SCH.write_schedule(FX.render_schedule(table(spark, d, "orders"), table(spark, d, "customer"),
                                           table(spark, d, "nation")), path)
    return SCH.read_schedule(spark, path).select(
        "week", "weekday", F.date_format("game_date", "yyyy-MM-dd").alias("game_date"),
        "team", "opponent", "season")


def _supplier_pages(spark: SparkSession, d: str) -> DataFrame:
    return FX.render_supplier_pages(table(spark, d, "supplier"), table(spark, d, "nation"),
                                   table(spark, d, "region"))


def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return H.table_rows(_supplier_pages(spark, d)).select(*H.CELL_COLUMNS, "team")


def html_table_rows_pages(spark: SparkSession, d: str) -> DataFrame:
    """The extractor over the shared ``pages``, with tables in many spellings
    at the end of each page (the pages themselves hold none)."""
    pages = FX.pages_with_tables(table(spark, d, "pages"))
    return H.table_rows(pages).select("page_id", "table_no", "row_no", *H.CELL_COLUMNS, "team")


# --- sinks: write to a fresh folder in the shared directory, read back -------

def sink_injury_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "injuries")
    K.write_csv(html_table_rows(spark, d), path)
    schema = ", ".join(f"{c} string" for c in (*H.CELL_COLUMNS, "team"))
    return spark.read.schema(schema).csv(path)


def sink_player_yearly_stats(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "yearly")
    K.write_player_yearly_stats(yearly(play_tables(spark, d)), path)
    return ST.flatten_yearly(spark.read.parquet(path))


def sink_json_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "yearly-json")
    K.write_json_lines(yearly(play_tables(spark, d)), path)
    return ST.flatten_yearly(K.read_json_lines(spark, path, K.PLAYER_YEARLY_STATS))


def sink_rosters(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "rosters")
    K.write_rosters(R.rosters(top(play_tables(spark, d), True)), path)
    return spark.read.parquet(path)


def sink_position_groups(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "positions")
    K.write_position_groups(groups(play_tables(spark, d)), path)
    back = K.read_json_lines(spark, path, K.PLAYER_YEARLY_STATS)
    return back.select("slot", F.col("playerId").alias("player_id"),
                       ST.year_mean(TARGET_YEAR).alias("mean"),
                       ST.year_variance(TARGET_YEAR).alias("variance"))


def sink_position_counts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "position-counts")
    counts = P.position_counts(P.normalized_positions(play_tables(spark, d).players))
    K.write_key_counts(counts, "position", "players", path)
    return K.read_key_counts(spark, path, "position", "players")


def sink_create_if_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS twice: the second write is skipped, so the
    table holds the rows once."""
    path = scratch_path(spark, "ctas")
    stats = season_stats(spark, d)
    K.create_table_as(stats, path, if_not_exists=True)
    K.create_table_as(stats, path, if_not_exists=True)
    return spark.read.parquet(path)


def sink_create_table(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE AS, and again: the second one must be refused, and the
    table still holds the rows of the first."""
    path = scratch_path(spark, "ctas")
    K.create_table_as(season_stats(spark, d), path)
    try:
        K.create_table_as(spark.range(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


def season_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Seasons of a player as a map: key test and lookup of the target year."""
    nested = ST.player_yearly_stats(season_stats(spark, d))
    seasons = ST.stats_by_year_map()
    entry = F.element_at("seasons", F.lit(TARGET_YEAR))
    return (nested.select("playerId", seasons.alias("seasons"))
            .filter(F.map_contains_key("seasons", TARGET_YEAR))
            .select(F.col("playerId").alias("player_id"),
                    F.size("seasons").cast("bigint").alias("n_seasons"),
                    entry["totalGamesPlayed"].alias("games"),
                    entry["totalStats"]["mean"].alias("mean")))


def warehouse_target_year_scorers(spark: SparkSession, d: str) -> DataFrame:
    """The stats job over a warehouse: the adapter's tables saved as tables of
    a database, loaded by name, scored, summarised, written and read back."""
    database = _database()
    save_warehouse(play_tables(spark, d), database, scratch_path(spark, "warehouse"))
    t = warehouse_tables(spark, database)
    return ST.flatten_yearly(J.stats_job(points(t), t.games, t.players,
                                         scratch_path(spark, "stats_job"), TARGET_YEAR))


def play_job_tables(spark: SparkSession, d: str) -> DataFrame:
    """The ten session tables that the play job writes, read back: plays, and
    least and greatest play id, of each player (and game) in each table."""
    out = scratch_path(spark, "play_job")
    J.play_job(play_tables(spark, d), out)
    found = None
    for name, (kind, by_game) in J.SESSION_TABLES.items():
        back = spark.read.parquet(f"{out}/{name}")
        for array in S.KINDS if kind == "all" else (kind,):
            pids = F.transform(array, lambda x: x["pid"])
            n, lo, hi = F.size(array).cast("bigint"), F.array_min(pids), F.array_max(pids)
            there = back.filter(F.col(array).isNotNull())
            rows = (S.add_up(there, [(n, "n_plays")], [(lo, "first_pid")], [(hi, "last_pid")])
                    if by_game else there.groupBy("player").agg(
                F.sum(n).alias("n_plays"), F.min(lo).alias("first_pid"),
                F.max(hi).alias("last_pid")))
            part = (rows.select(F.lit(name).alias("table_name"), F.lit(array).alias("kind"), "player",
                            (F.col("gid") if by_game else F.lit(None)).cast("bigint").alias("gid"),
                            "n_plays", "first_pid", "last_pid"))
            found = part if found is None else found.unionByName(part)
    return found


def sink_prediction_extract(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "extract")
    t = play_tables(spark, d)
    K.write_position_extract(PR.prediction_extract(_prediction(t), t.players), path)
    return K.read_position_extract(spark, path).select(
        "player", "seas", "totalPts", "stddev", "pos1")


def ordered_game_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every per-game session element by element: the play ids of its arrays,
    in the order in which they stand there."""
    s = S.scoring_sessions(play_tables(spark, d), by_game=True).filter(F.col("gid").isNotNull())
    return s.select("player", "gid", *[
        F.array_join(F.transform(k, lambda x: x["pid"]), " ").alias(f"{k}_pids") for k in S.KINDS])


def merged_season_stats(spark: SparkSession, d: str) -> DataFrame:
    """Season statistics from stored moments: the points arrive in three
    batches of one stored table, two are compacted, the third is added, all are
    merged."""
    t = play_tables(spark, d)
    half = F.pmod(F.xxhash64("player", "gid"), F.lit(3))
    stored = scratch_path(spark, "points")
    K.create_table_as(points(t), stored)
    all_points = spark.read.parquet(stored).withColumn("_batch", half)
    first, then = scratch_path(spark, "moments"), scratch_path(spark, "moments")
    for i in range(2):
        SM.add(all_points.filter(F.col("_batch") == i).drop("_batch"), t.games, first, f"week-{i}")
    SM.compact(spark, first, then)
    SM.add(all_points.filter(F.col("_batch") == 2).drop("_batch"), t.games, then, "week-2")
    return SM.season_stats(spark, then)


def _spoiled_schedule(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = scratch_path(spark, "schedule")
    SCH.write_schedule(FX.render_spoiled_schedule(
        table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")), path)
    return RJ.read_schedule(spark, path)


def schedule_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no schedule lines, with their reasons, through the reject sink."""
    path = scratch_path(spark, "rejects")
    bad = _spoiled_schedule(spark, d)[1]
    RJ.write(bad, path)
    back = K.read_json_lines(spark, f"{path}/records", bad.schema)
    return back.select("season", "line", F.array_join(RJ.REASONS, ",").alias("reasons"))


def schedule_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The good lines of a file with bad ones."""
    return _spoiled_schedule(spark, d)[0].select(
        "week", "weekday", F.date_format("game_date", "yyyy-MM-dd").alias("game_date"),
        "team", "opponent", "season")


def game_id_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Games whose id or season is no number, as they came."""
    bad = RJ.games(FX.spoiled_games(table(spark, d, "orders")))[1]
    return bad.select("gid", "seas", F.array_join(RJ.REASONS, ",").alias("reasons"))


def _database() -> str:
    return f"statline_{uuid.uuid4().hex[:12]}"


def named_table_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The play and prediction jobs through named tables: plays saved as a
    database, session tables, points and prediction made as tables of another
    one, each read by its name."""
    source, target = _database(), _database()
    save_warehouse(play_tables(spark, d), source, scratch_path(spark, "warehouse"))
    t = warehouse_tables(spark, source)
    store = Store(spark, scratch_path(spark, "jobs"), database=target)
    J.play_job(t, store)
    J.prediction_job(stored_points(spark, f"{target}.player_game_points"), t.games, t.players, store)
    return spark.table(f"{target}.player_prediction")


def resumed_prediction_job(spark: SparkSession, d: str) -> DataFrame:
    """The prediction job, ended after its first step with the second one half
    written, then started again; a third start finds all done."""
    t = play_tables(spark, d)
    stored = scratch_path(spark, "points")
    K.create_table_as(points(t), stored)
    pts, folder = spark.read.parquet(stored), scratch_path(spark, "jobs")
    store = Store(spark, folder, resume=fingerprint([pts, t.games, t.players], year=TARGET_YEAR))
    store.create("season_prediction", lambda: PR.player_prediction(pts, t.games, t.players))
    begun = store.path("prediction_by_position/_temporary/0")
    spark.range(1).write.parquet(begun)
    for _ in range(2):
        J.prediction_job(pts, t.games, t.players, store)
    return K.read_position_extract(spark, store.path("prediction_by_position")).select(
        "player", "seas", "totalPts", "stddev", "pos1")


def roster_job_output(spark: SparkSession, d: str) -> DataFrame:
    """Stats and roster job from stored points, their outputs read back."""
    t = play_tables(spark, d)
    folder = scratch_path(spark, "jobs")
    J.roster_job(J.stats_job(points(t), t.games, t.players, folder, TARGET_YEAR), t.players, folder,
                 TARGET_YEAR)
    return spark.read.parquet(f"{folder}/rosters")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "season_stats": season_stats,
        "target_year_scorers": lambda s, d: ST.flatten_yearly(yearly(play_tables(s, d))),
        "normalized_positions": lambda s, d: P.normalized_positions(play_tables(s, d).players),
        "position_counts": lambda s, d: P.position_counts(
            P.normalized_positions(play_tables(s, d).players)),
        "position_groups": lambda s, d: year_groups(play_tables(s, d)),
        "top_by_position": _top(True),
        "lowest_by_position": _top(False),
        "rosters": _rosters(True, True, False),
        "rosters_reference": _rosters(False, False, False),
        "rosters_unordered": _rosters(True, True, True),
        "scoring_sessions": _scoring_sessions(False),
        "scoring_game_sessions": _scoring_sessions(True),
        "scoring_game_sessions_joined": _scoring_sessions(True, "join"),
        "player_game_points": lambda s, d: SC.player_game_points(play_tables(s, d)),
        "player_game_points_flat": lambda s, d: SC.player_game_points_flat(play_tables(s, d)),
        "sql_player_game_points": sql_player_game_points,
        "player_prediction": lambda s, d: _prediction(play_tables(s, d)),
        "prediction_extract": prediction_extract,
    }
    q.update({
        "within_scalar": within_scalar,
        "collect_distinct": positions_per_game,
        "array_union": passer_receiver_plays,
        "schedule_csv": schedule_csv,
        "html_table_rows": html_table_rows,
        "html_table_rows_pages": html_table_rows_pages,
        "sink_injury_csv": sink_injury_csv,
        "sink_player_yearly_stats": sink_player_yearly_stats,
        "sink_json_records": sink_json_records,
        "sink_rosters": sink_rosters,
        "sink_position_groups": sink_position_groups,
        "sink_position_counts": sink_position_counts,
        "sink_create_if_not_exists": sink_create_if_not_exists,
        "sink_create_table": sink_create_table,
        "season_map_lookup": season_map_lookup,
        "warehouse_target_year_scorers": warehouse_target_year_scorers,
        "play_job_tables": play_job_tables,
        "sink_prediction_extract": sink_prediction_extract,
        "ordered_game_sessions": ordered_game_sessions,
        "merged_season_stats": merged_season_stats,
        "schedule_rejects": schedule_rejects,
        "schedule_accepted": schedule_accepted,
        "game_id_rejects": game_id_rejects,
        "named_table_jobs": named_table_jobs,
        "resumed_prediction_job": resumed_prediction_job,
        "roster_job_output": roster_job_output,
    })
    for kind, name in (("passes", "pass"), ("rushes", "rush"), ("receptions", "reception"),
                       ("fgxp", "kick")):
        q[f"{name}_sessions"] = _session_summary(kind, False)
        q[f"{name}_game_sessions"] = _session_summary(kind, True)
    return q
