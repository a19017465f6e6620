"""Tasks with one dataset at most, against plain loops."""

import random

from folioscope.plans import gap_queries


def test_one_dataset_gaps_without_meeting(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([*range(150), None]), f"t{rng.randrange(160)}", rng.choice([None, None, None, "a", "a", "b"])) for _ in range(260)]

    def fail(*_):
        raise AssertionError("every task meets every dataset of its papers")

    monkeypatch.setattr(gap_queries, "cooccurrence", fail, raising=False)
    known = [r for r in rows if r[0] is not None]
    of_paper, of_task, want = {}, {}, {}
    for p, _, d in known:
        of_paper.setdefault(p, set()).update({d} - {None})
    for p, task, _ in known:
        of_task.setdefault(task, set()).update(of_paper[p])
    for p, task, _ in known:
        if len(of_task[task]) <= 1:
            key = (task, next(iter(of_paper[p]), None))
            want[key] = (min(p, want.get(key, (p,))[0]), len(of_task[task]))
    found = gap_queries.one_dataset_gaps(spark.createDataFrame(rows, "paper_id long, task string, dataset string")).collect()
    assert {(r.task, r.dataset): (r.paper_id, r.n_tested) for r in found} == want and len(found) == len(want) and len({n for _, n in want.values()}) == 2
