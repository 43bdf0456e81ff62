import random

import pytest


def passages(seed: int) -> list[tuple]:
    """Small documents with shared passages, copies, repeated ids, null and
    empty texts, and one long repetitive text."""
    r = random.Random(seed)
    voc = ["a", "b", "the", "é", "xyzzy", "longlonglong"]
    voc += [f"w{i}" for i in range(r.choice([3, 40, 400]))]
    shared = [[r.choice(voc) for _ in range(r.randint(20, 60))] for _ in range(4)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice(voc) for _ in range(r.randint(0, 40))]
            if r.random() < 0.6:
                p, a = r.choice(shared), r.randint(0, 10)
                w += p[a:a + r.randint(5, 60)]
        rows.append((r.choice([d, d, d, max(0, d - 1)]), " ".join(w)))
    rows += [(100, None), (101, ""), (102, "z" * 700), (None, rows[3][1]), (103, "z" * 500),
             rows[5], (104, rows[7][1]), (3, rows[8][1] + "\n q"), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(params=[0, 1, 2])
def passage_rows(request):
    return passages(request.param)
