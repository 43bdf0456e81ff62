"""Season prediction against a brute-force join-then-group in Python."""

import math
from collections import defaultdict

from statline.operators import predict as PR

POINTS = [("p1", 1, 3, None, 1), ("p1", 2, 0, 2, None), ("p1", 1, 4, 4, 4),
          ("p2", 1, None, None, None), (None, 2, 1, 1, 1), ("p3", 9, 5, 0, 0)]
GAMES = [(1, 2000), (2, 2001)]
PLAYERS = [("p1", "WR"), ("p1", "WR"), ("p2", "QB"), ("p2", "RB"), (None, "K")]


def _brute():
    games = dict(GAMES)
    groups = defaultdict(list)
    for player, gid, a, b, c in POINTS:
        x = (a or 0) + (b or 0) + (c or 0)
        seas = games.get(gid)
        matches = [pos for p, pos in PLAYERS if p is not None and p == player] or [None]
        for pos in matches:
            groups[(player, pos, seas)].append(x)
    out = []
    for (player, pos, seas), xs in groups.items():
        n, m = len(xs), sum(xs) / len(xs)
        out.append((player, seas, sum(xs), math.sqrt(sum((v - m) ** 2 for v in xs) / n), pos))
    return sorted(out, key=str)


def test_prediction_matches_brute_force(spark):
    points = spark.createDataFrame(
        POINTS, "player string, gid int, passing int, rushing int, receiving int")
    games = spark.createDataFrame(GAMES, "gid int, seas int")
    players = spark.createDataFrame(PLAYERS, "player string, pos1 string")
    got = sorted((tuple(r) for r in PR.player_prediction(points, games, players).collect()),
                 key=str)
    want = _brute()
    assert [g[:3] + (g[4],) for g in got] == [w[:3] + (w[4],) for w in want]
    for g, w in zip(got, want):
        assert abs(g[3] - w[3]) < 1e-12
    extract = PR.prediction_extract(PR.player_prediction(points, games, players), players)
    # p1 is listed twice in players: each WR row appears twice in the extract
    assert extract.filter("player = 'p1'").count() == 2 * 2
