"""DuckDB SQL oracle: every registered query written independently in SQL over
the same parquet tables (pre-registered as views by the checker).

The play-table views are redefined here in SQL from the raw tables, so the
oracle shares no code with the Spark side.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The adapter's injections, the raw positions by part key, the
# placeholder player, the roster limits and the scoring divisors.
PLACEHOLDER = "XX-0000"
POSITIONS = ("RB", "QB", "DB", "DL", "K", "LB", "OL", "TE", "WR", "LS", None)
ROSTER_POSITION = {"RB": "RB", "QB": "QB", "DB": "DEF", "DL": "DEF", "K": "K", "LB": "DEF",
                   "OL": "OFF", "TE": "TE", "WR": "WR", "LS": "LS"}
LIMITS = {"RB": 5, "QB": 5, "WR": 5, "DEF": 5, "K": 3, "TE": 4, "WR/TE/RB": 4}
# ---------------------------------------------------------------------------


def _case(of: str, values: dict) -> str:
    arms = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items())
    return f"CASE {of} {arms} END"


_RAW_POSITION = _case("p_partkey % 11", {i: p for i, p in enumerate(POSITIONS) if p})
_POSITION = f"coalesce({_case('pos1', ROSTER_POSITION)}, '')"
_LIMIT = _case("slot", LIMITS)

# Every line item is a play.  ``touched`` says per play what the side tables
# hold of it: how often each matches (a left join repeats a play that often).
VIEWS = f"""
plays AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pid, l_returnflag AS how,
         CASE WHEN l_orderkey % 89 <> 0 THEN l_orderkey END AS gid,
         CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS actor,
         CASE WHEN l_suppkey % 23 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS receiver,
         CAST(l_quantity AS INTEGER) AS amount, l_linestatus AS kick_type, l_tax > 0 AS made,
         l_discount >= 0.08::DOUBLE AS scored, l_discount = 0.01::DOUBLE AS converted,
         l_discount = 0.02::DOUBLE AS lost
  FROM lineitem),
touched AS (
  SELECT pid, count(*) AS n, count(*) FILTER (scored) AS n_scored,
         count(*) FILTER (converted) AS n_converted,
         count(*) FILTER (lost AND how = 'A') AS n_int, count(*) FILTER (lost AND how = 'N') AS n_fumble
  FROM plays GROUP BY pid),
games AS (
  SELECT CASE WHEN o_orderkey = 7 THEN 0 ELSE o_orderkey END AS gid,
         CAST(year(o_orderdate) AS INTEGER) AS seas FROM orders),
players AS (SELECT CAST(p_partkey AS VARCHAR) AS player, {_RAW_POSITION} AS pos1 FROM part),
cored AS (
  SELECT p.* EXCLUDE (gid), c.gid FROM plays p JOIN (SELECT pid, gid FROM plays) c USING (pid)),
enriched AS (
  SELECT x.*, t.n_int, t.n_fumble, CASE WHEN t.n_scored > 0 THEN 6 ELSE 0 END AS td,
         CAST(t.n_converted > 0 AS INTEGER) AS conv,
         greatest(t.n_scored, 1) * greatest(t.n_converted, 1) AS copies
  FROM cored x JOIN touched t USING (pid)),
pass_plays AS (
  SELECT actor AS player, gid, pid, amount AS yds, CAST(n_int > 0 AS INTEGER) AS intcpt, td, conv
  FROM enriched, unnest(range(copies * greatest(n_int, 1))) u(i) WHERE how = 'A' AND actor IS NOT NULL),
reception_plays AS (
  SELECT receiver AS player, gid, pid, amount AS yds, td, conv
  FROM enriched, unnest(range(copies)) u(i) WHERE how = 'A' AND receiver IS NOT NULL AND n_int = 0),
rush_plays AS (
  SELECT actor AS player, gid, pid, amount AS yds, td, conv
  FROM enriched, unnest(range(copies)) u(i) WHERE how = 'N' AND actor IS NOT NULL AND n_fumble = 0),
kick_plays AS (
  SELECT actor AS player, gid, pid, kick_type AS fgxp, amount AS dist
  FROM cored WHERE how = 'R' AND made AND actor IS NOT NULL),
stacked AS (
  SELECT player, gid, yds AS p_yds, intcpt AS p_int, td AS p_td, conv AS p_conv,
         NULL AS r_yds, NULL AS r_td, NULL AS r_conv, NULL AS c_yds, NULL AS c_td, NULL AS c_conv
  FROM pass_plays
  UNION ALL
  SELECT player, gid, NULL, NULL, NULL, NULL, yds, td, conv, NULL, NULL, NULL FROM rush_plays
  UNION ALL
  SELECT player, gid, NULL, NULL, NULL, NULL, NULL, NULL, NULL, yds, td, conv FROM reception_plays
  UNION ALL
  SELECT player, gid, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM kick_plays),
points AS (
  SELECT player, gid,
         CAST(sum(p_yds) // 25 - 2 * sum(p_int) + 2 * sum(p_conv) + 4 * sum(p_td) AS BIGINT)
           AS passing,
         CAST(sum(r_yds) // 10 + 6 * sum(r_td) + 2 * sum(r_conv) AS BIGINT) AS rushing,
         CAST(sum(c_yds) // 10 + 6 * sum(c_td) + 2 * sum(c_conv) AS BIGINT) AS receiving
  FROM stacked GROUP BY player, gid),
recs AS (
  SELECT player AS player_id, coalesce(gid, 0) AS gid,
         CAST(coalesce(passing, 0) AS BIGINT) AS pa, CAST(coalesce(rushing, 0) AS BIGINT) AS ru,
         CAST(coalesce(receiving, 0) AS BIGINT) AS re
  FROM points),
seasons AS (SELECT coalesce(gid, -9) AS gid, coalesce(seas, -9) AS season FROM games),
moments AS (
  SELECT player_id, season, count(*) AS n,
         sum(pa) AS s_pa, sum(pa * pa) AS ss_pa, sum(ru) AS s_ru, sum(ru * ru) AS ss_ru,
         sum(re) AS s_re, sum(re * re) AS ss_re
  FROM recs JOIN seasons USING (gid) GROUP BY player_id, season),
season_stats AS (
  SELECT player_id, season, CAST(n AS BIGINT) AS games,
         CAST(s_pa AS DOUBLE) / CAST(n AS DOUBLE) AS passing_mean,
         CASE WHEN n > 1 THEN CAST(n * ss_pa - s_pa * s_pa AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)
              ELSE 0.0 END AS passing_variance,
         CAST(s_ru AS DOUBLE) / CAST(n AS DOUBLE) AS rushing_mean,
         CASE WHEN n > 1 THEN CAST(n * ss_ru - s_ru * s_ru AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)
              ELSE 0.0 END AS rushing_variance,
         CAST(s_re AS DOUBLE) / CAST(n AS DOUBLE) AS receiving_mean,
         CASE WHEN n > 1 THEN CAST(n * ss_re - s_re * s_re AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)
              ELSE 0.0 END AS receiving_variance
  FROM moments),
season_totals AS (
  SELECT *, passing_mean + rushing_mean + receiving_mean AS total_mean,
         passing_variance + rushing_variance + receiving_variance AS total_variance
  FROM season_stats),
scorers AS (
  SELECT * FROM season_totals s
  WHERE s.player_id IN (SELECT player_id FROM season_totals
                        WHERE season = 2000 AND games <> 0 AND total_mean <> 0)),
norm_positions AS (
  SELECT player_id, position FROM (
    SELECT coalesce(player, '') AS player_id, {_POSITION} AS position FROM players)
  WHERE position NOT IN ('OFF', 'LS')),
scorer_target AS (
  SELECT player_id, total_mean AS mean, total_variance AS variance
  FROM scorers WHERE season = 2000),
pos_groups AS (
  SELECT p.position AS slot, p.player_id, t.mean, t.variance
  FROM norm_positions p JOIN scorer_target t USING (player_id)
  WHERE p.position IN ('RB', 'QB', 'TE', 'K', 'DEF', 'WR')
  UNION ALL
  SELECT 'WR/TE/RB' AS slot, p.player_id, t.mean, t.variance
  FROM norm_positions p JOIN scorer_target t USING (player_id)
  WHERE p.position IN ('WR', 'TE', 'RB')),
top_best AS (
  SELECT * FROM (
    SELECT slot, player_id, mean, variance,
           row_number() OVER (PARTITION BY slot ORDER BY mean DESC, player_id ASC) AS rank
    FROM pos_groups)
  WHERE rank <= {_LIMIT}),
top_low AS (
  SELECT * FROM (
    SELECT slot, player_id, mean, variance,
           row_number() OVER (PARTITION BY slot ORDER BY mean ASC, player_id ASC) AS rank
    FROM pos_groups)
  WHERE rank <= {_LIMIT}),
prediction AS (
  SELECT player, seas, CAST(s AS BIGINT) AS totalPts,
         sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) AS stddev, pos1
  FROM (
    SELECT pgp.player, players.pos1, games.seas, count(*) AS n,
           sum(x) AS s, sum(x * x) AS ss
    FROM (SELECT player, gid,
                 CAST(coalesce(passing, 0) + coalesce(rushing, 0) + coalesce(receiving, 0)
                      AS BIGINT) AS x
          FROM points) pgp
    LEFT JOIN games ON pgp.gid = games.gid
    LEFT JOIN players ON players.player = pgp.player
    GROUP BY pgp.player, players.pos1, games.seas))
"""


def _with(body: str) -> str:
    return "WITH " + VIEWS.strip() + "\n" + body.strip()


def _sessions(plays: str, by_game: bool, extra: str) -> str:
    keys = "player, gid" if by_game else "player"
    return _with(f"""
SELECT {keys}, CAST(count(*) AS BIGINT) AS n_plays, {extra}
FROM {plays} GROUP BY {keys}""")


_RUN = ("CAST(sum(yds) AS BIGINT) AS yds, CAST(sum(td) AS BIGINT) AS td, "
        "CAST(sum(conv) AS BIGINT) AS conv, min(pid) AS first_pid, max(pid) AS last_pid")
_PASS = _RUN + ", CAST(sum(intcpt) AS BIGINT) AS intcpt"
_KICK = ("CAST(sum(dist) AS BIGINT) AS dist, CAST(count(DISTINCT fgxp) AS BIGINT) AS kinds, "
         "min(pid) AS first_pid, max(pid) AS last_pid")


def _rosters(top: str, strict: bool, unordered: bool) -> str:
    ne = "<" if unordered else "<>"
    te = " AND te.player_id <> flex.player_id" if strict else ""
    slots = [("qb", "QB"), ("rb1", "RB"), ("rb2", "RB"), ("wr1", "WR"), ("wr2", "WR"),
             ("k", "K"), ("def", "DEF"), ("te", "TE"), ("flex", "WR/TE/RB")]
    froms = ",\n     ".join(f"(SELECT * FROM {top} WHERE slot = '{g}') {n}" for n, g in slots)
    mean = " + ".join(f"{n}.mean" for n, _ in slots)
    var = " + ".join(f"{n}.variance" for n, _ in slots)
    return _with(f"""
SELECT qb.player_id AS qb, rb1.player_id AS rb1, rb2.player_id AS rb2, wr1.player_id AS wr1,
       wr2.player_id AS wr2, te.player_id AS te, k.player_id AS k, flex.player_id AS flex,
       def.player_id AS def, {mean} AS meanTotal, {var} AS varianceTotal
FROM {froms}
WHERE rb1.player_id {ne} rb2.player_id AND wr1.player_id {ne} wr2.player_id
  AND rb1.player_id <> flex.player_id AND rb2.player_id <> flex.player_id
  AND wr1.player_id <> flex.player_id AND wr2.player_id <> flex.player_id{te}""")


def _session_combo(by_game: bool) -> str:
    """Each kind summarised on its own, then joined on all keys of any kind."""
    keys = ["player", "gid"] if by_game else ["player"]
    cols, joins, names = [], [], []
    for name, source, amount in (("passes", "pass_plays", "yds"), ("rushes", "rush_plays", "yds"),
                                 ("receptions", "reception_plays", "yds"),
                                 ("fgxp", "kick_plays", "dist")):
        names.append(f"SELECT {', '.join(keys)} FROM {source}")
        same = " AND ".join(f"k.{x} IS NOT DISTINCT FROM {name}.{x}" for x in keys)
        joins.append(f"""LEFT JOIN (SELECT {', '.join(keys)}, count(*) AS n, sum({amount}) AS s,
                        min(pid) AS lo, max(pid) AS hi FROM {source} GROUP BY ALL) {name} ON {same}""")
        cols += [f"CAST({name}.n AS BIGINT) AS n_{name}", f"CAST({name}.s AS BIGINT) AS {amount}_{name}",
                 f"{name}.lo AS first_{name}", f"{name}.hi AS last_{name}"]
    return _with(f"""
SELECT {', '.join('k.' + x for x in keys)}, {', '.join(cols)}
FROM ({' UNION '.join(names)}) k
{chr(10).join(joins)}""")


def _page_rows() -> str:
    """Rows of the tables appended to each page, written out: the page's id
    stands in them, so no HTML is read here."""
    tables = (("double", 0), ("single", 0), ("bare", 0), ("nested", 1))
    nested = """
SELECT page_id, 3 AS table_no, 0 AS row_no, '1' AS c1, '2' AS c2, '3' AS c3, '4' AS c4, '5' AS c5,
       '6' AS c6, 'Team & ' || page_id AS team FROM pages"""
    return "\nUNION ALL\n".join([nested] + [f"""
SELECT page_id, {i} AS table_no, {row} AS row_no, CAST(page_id AS VARCHAR) AS c1, '{kind}' AS c2,
       'c' AS c3, 'd' || chr(8217) || 's' AS c4, chr(233) AS c5, 'f' AS c6, 'Team & ' || page_id AS team
FROM pages""" for i, (kind, row) in enumerate(tables)])


_SCHEDULE = """
  SELECT *, concat_ws(',', CASE WHEN digit IN (5, 9) THEN 'w' ELSE '' END || week, weekday,
                      CASE WHEN digit IN (7, 9) THEN 'Smarch 13' ELSE day END, team, '', opponent) AS line
  FROM (SELECT o_orderkey % 10 AS digit, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INTEGER) AS week,
               strftime(o_orderdate, '%a') AS weekday, strftime(o_orderdate, '%B %-d') AS day,
               strftime(o_orderdate, '%Y-%m-%d') AS game_date, c_name AS team, n_name AS opponent,
               CAST(year(o_orderdate) AS INTEGER) AS season
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _ordered_sessions() -> str:
    kinds = {"passes": "pass_plays", "rushes": "rush_plays", "receptions": "reception_plays",
             "fgxp": "kick_plays"}
    rows = " UNION ALL ".join(f"SELECT player, gid, pid, '{k}' AS kind FROM {v}" for k, v in kinds.items())
    lists = ", ".join(f"string_agg(pid, ' ' ORDER BY pid) FILTER (kind = '{k}') AS {k}_pids" for k in kinds)
    return _with(f"""
SELECT player, gid, {lists}
FROM ({rows}) WHERE gid IS NOT NULL AND player IS NOT NULL GROUP BY player, gid""")


def _play_job() -> str:
    sources = {"passes": "pass_plays", "rushes": "rush_plays", "receptions": "reception_plays",
               "fgxp": "kick_plays"}
    parts = []
    for kind, source in sources.items():
        for table in (kind, "all"):
            for suffix, gid in (("", "NULL"), ("_by_game", "gid")):
                parts.append(f"""
SELECT 'sessions_{table}{suffix}' AS table_name, '{kind}' AS kind, player,
       CAST({gid} AS BIGINT) AS gid, CAST(count(*) AS BIGINT) AS n_plays, min(pid) AS first_pid,
       max(pid) AS last_pid
FROM {source} GROUP BY player{', gid' if suffix else ''}""")
    return _with("\nUNION ALL\n".join(parts))


def oracle_sql() -> dict[str, str]:
    points = "SELECT player, gid, passing, rushing, receiving FROM points"
    q = {
        "season_stats": _with("SELECT * FROM season_totals"),
        "target_year_scorers": _with("SELECT * FROM scorers"),
        "normalized_positions": _with("SELECT player_id, position FROM norm_positions"),
        "position_counts": _with("""
SELECT position, CAST(count(*) AS BIGINT) AS players FROM norm_positions GROUP BY position"""),
        "position_groups": _with("SELECT slot, player_id, mean, variance FROM pos_groups"),
        "top_by_position": _with(
            "SELECT slot, CAST(rank AS INTEGER) AS rank, player_id, mean, variance FROM top_best"),
        "lowest_by_position": _with(
            "SELECT slot, CAST(rank AS INTEGER) AS rank, player_id, mean, variance FROM top_low"),
        "rosters": _rosters("top_best", strict=True, unordered=False),
        "rosters_reference": _rosters("top_low", strict=False, unordered=False),
        "rosters_unordered": _rosters("top_best", strict=True, unordered=True),
        "pass_sessions": _sessions("pass_plays", False, _PASS),
        "pass_game_sessions": _sessions("pass_plays", True, _PASS),
        "rush_sessions": _sessions("rush_plays", False, _RUN),
        "rush_game_sessions": _sessions("rush_plays", True, _RUN),
        "reception_sessions": _sessions("reception_plays", False, _RUN),
        "reception_game_sessions": _sessions("reception_plays", True, _RUN),
        "kick_sessions": _sessions("kick_plays", False, _KICK),
        "kick_game_sessions": _sessions("kick_plays", True, _KICK),
        "scoring_sessions": _session_combo(False),
        "scoring_game_sessions": _session_combo(True),
        "scoring_game_sessions_joined": _session_combo(True),
        "player_game_points": _with(points),
        "player_game_points_flat": _with(points),
        "sql_player_game_points": _with(points),
        "player_prediction": _with("SELECT * FROM prediction"),
        "prediction_extract": _with("""
SELECT players.player, p.seas, p.totalPts, p.stddev, p.pos1
FROM prediction p JOIN players ON players.player = p.player
WHERE p.pos1 IN ('WR', 'RB', 'QB', 'TE')"""),
    }
    html_rows = """
SELECT CAST(s_suppkey AS VARCHAR) AS c1, s_name AS c2, n_name AS c3,
       CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS c4, r_name AS c5,
       'good & active' AS c6, n_name AS team
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_acctbal >= 0"""
    q.update({
        "within_scalar": _with("""
SELECT player, gid, CAST(sum(p_yds) AS BIGINT) AS passes_yds,
       CAST(sum(r_yds) AS BIGINT) AS rushes_yds, CAST(sum(c_yds) AS BIGINT) AS receptions_yds
FROM stacked GROUP BY player, gid"""),
        "collect_distinct": _with("""
SELECT p.gid, string_agg(DISTINCT n.position, ',' ORDER BY n.position) AS positions
FROM points p JOIN norm_positions n ON n.player_id = p.player GROUP BY p.gid"""),
        "array_union": _with("""
SELECT player, gid, CAST(count(DISTINCT pid) AS BIGINT) AS plays
FROM (SELECT player, gid, pid FROM pass_plays
      UNION ALL SELECT player, gid, pid FROM reception_plays) u
GROUP BY player, gid"""),
        "schedule_csv": """
SELECT CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INTEGER) AS week,
       strftime(o_orderdate, '%a') AS weekday, strftime(o_orderdate, '%Y-%m-%d') AS game_date,
       c_name AS team, n_name AS opponent, CAST(year(o_orderdate) AS INTEGER) AS season
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
        "html_table_rows": html_rows,
        "html_table_rows_pages": _page_rows(),
        "sink_injury_csv": html_rows,
        "sink_player_yearly_stats": q["target_year_scorers"],
        "sink_json_records": q["target_year_scorers"],
        "sink_rosters": q["rosters"],
        "sink_position_groups": q["position_groups"],
        "sink_position_counts": q["position_counts"],
        "sink_create_if_not_exists": q["season_stats"],
        "sink_create_table": _with("SELECT *, true AS refused FROM season_totals"),
        "season_map_lookup": _with("""
SELECT t.player_id, s.n_seasons, CAST(t.games AS INTEGER) AS games, t.total_mean AS mean
FROM season_totals t JOIN (SELECT player_id, CAST(count(*) AS BIGINT) AS n_seasons
                           FROM season_totals GROUP BY player_id) s USING (player_id)
WHERE t.season = 2000"""),
        "warehouse_target_year_scorers": q["target_year_scorers"],
        "play_job_tables": _play_job(),
        "sink_prediction_extract": q["prediction_extract"],
        "ordered_game_sessions": _ordered_sessions(),
        "merged_season_stats": q["season_stats"],
        "schedule_rejects": f"""
SELECT season, CASE WHEN digit = 3 THEN line || ',late' ELSE line END AS line,
       CASE digit WHEN 3 THEN 'fields' WHEN 5 THEN 'week' WHEN 7 THEN 'date' ELSE 'week,date' END AS reasons
FROM ({_SCHEDULE}) WHERE digit IN (3, 5, 7, 9)""",
        "schedule_accepted": f"""
SELECT week, weekday, game_date, team, opponent, season FROM ({_SCHEDULE}) WHERE digit NOT IN (3, 5, 7, 9)""",
        "game_id_rejects": """
SELECT gid, seas, concat_ws(',', CASE WHEN gid LIKE 'G%' THEN 'gid: no bigint' END,
                            CASE WHEN seas = 'spring' THEN 'seas: no int' END) AS reasons
FROM (SELECT CASE o_orderkey % 50 WHEN 1 THEN 'G' || o_orderkey WHEN 2 THEN NULL
             ELSE CAST(o_orderkey AS VARCHAR) END AS gid,
             CASE WHEN o_orderkey % 70 = 1 THEN 'spring'
             ELSE CAST(year(o_orderdate) AS VARCHAR) END AS seas FROM orders)
WHERE gid LIKE 'G%' OR seas = 'spring'""",
        "named_table_jobs": q["player_prediction"],
        "resumed_prediction_job": q["prediction_extract"],
        "roster_job_output": q["rosters"],
    })
    return q
