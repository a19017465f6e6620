"""Tables in versions, kept answers, rates, staged runs, streams with state, boxes and folders, against plain computations."""

import os
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import plans
from folioscope.operators.layout import merged_boxes
from folioscope.operators.lookup import find_folders
from folioscope.plans.runner import Runner, Stage
from folioscope.sources.answers import AnswerTable, accepted, normalised
from folioscope.sources.providers import ask_within_rate
from folioscope.sources.versions import Versions
from folioscope.streaming.coverage import gain_of, new_entities
from folioscope.streaming.upserts import merge_batch, run_upserts

from .test_queries import SF

PAIR = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_versions_count_once_committed(spark, tmp_path):
    table = Versions(spark, f"{tmp_path}/t", PAIR)
    assert table.complete() == [] and table.read().count() == 0
    table.write(spark.createDataFrame([(1, "a")], PAIR), 1)
    table.write(spark.createDataFrame([(2, "b")], PAIR), 2)
    os.remove(f"{tmp_path}/t/v{2:012d}/_SUCCESS")  # as if the writer had been killed
    os.makedirs(f"{tmp_path}/t/other")
    assert table.complete() == [1] and [tuple(r) for r in table.read(1).collect()] == [(1, "a")]
    table.write(spark.createDataFrame([(3, "c")], PAIR), 2)
    assert table.complete() == [1, 2] and table.read(1, 2).count() == 2


class Counting:
    """Answers and writes down what it was asked; fails from some question on."""

    def __init__(self, log, fail_after=None):
        self.log, self.fail_after = Path(log), fail_after

    def answer(self, prompts):
        out = []
        for p in prompts:
            with self.log.open("a") as f:
                f.write(p + "\n")
            if self.fail_after is not None and len(self.asked()) > self.fail_after:
                raise RuntimeError("killed")
            out.append(None if "none" in p else '"' + p.upper() + ' C" ')
        return out

    def asked(self):
        return self.log.read_text().splitlines() if self.log.exists() else []


def test_answers_are_asked_once(spark, tmp_path):
    log = f"{tmp_path}/log"
    names = spark.createDataFrame([(n,) for n in [" Squad ", "squad", "GLUE", "none here", "", "  ", None, "known"]], "raw string").repartition(3)
    rule = F.when(F.col("raw") == "known", "by rule")
    first, second = (sorted(normalised(names, "dataset", "raw", rule, AnswerTable(spark, f"{tmp_path}/answers"), lambda: Counting(log)).collect(), key=str) for _ in range(2))
    assert first == second and sorted(Counting(log).asked()) == ["glue", "none here", "none here", "squad"]  # without an answer: asked again
    assert {r.raw: r.canonical for r in first} == {" Squad ": "squad c", "squad": "squad c", "GLUE": "glue c", "none here": "none here", "": "", "  ": "  ", None: None, "known": "by rule"}


def test_a_killed_run_keeps_its_slices(spark, tmp_path):
    table, log = AnswerTable(spark, f"{tmp_path}/answers"), f"{tmp_path}/log"
    questions = spark.createDataFrame([("metric", f"q{i}") for i in range(60)], "kind string, question string")
    with pytest.raises(Exception, match="killed"):
        table.fill(questions, lambda: Counting(log, fail_after=35), slices=6, batch=1)
    kept = table.known().count()
    assert 0 < kept < 60
    before = len(Counting(log).asked())
    assert table.fill(questions, lambda: Counting(log), slices=6) == 60 - kept == len(Counting(log).asked()) - before
    assert table.fill(questions, lambda: Counting(log), slices=6) == 0
    rows = sorted(map(tuple, table.known().collect()))
    table.compact()
    assert len(table.versions.complete()) == 1 and sorted(map(tuple, table.known().collect())) == rows and len(rows) == 60


def test_which_answers_are_accepted(spark):
    cases = {' "BLEU" ': "bleu", "'x'": "x", "": None, "a\nb": None, "y" * 80: None, "y" * 79: "y" * 79, None: None}
    found = spark.createDataFrame([(a,) for a in cases], "a string").select("a", accepted(F.col("a")).alias("c")).collect()
    assert {r.a: r.c for r in found} == cases


class Flaky:
    """Answers a prompt at its n-th attempt, n being its number."""

    def __init__(self, log):
        self.log = Path(log)

    def answer(self, prompts):
        with self.log.open("a") as f:
            f.write(prompts[0] + "\n")
        seen = self.log.read_text().splitlines().count(prompts[0])
        if seen < int(prompts[0]):
            raise ConnectionError
        return ["ok"]


@pytest.mark.parametrize("tasks", [1, 3])
def test_rate_and_attempts(spark, tmp_path, tasks):
    log, waits = f"{tmp_path}/log", Path(f"{tmp_path}/waits")

    def wait(seconds):
        with waits.open("a") as f:
            f.write(f"{seconds}\n")

    rows = spark.createDataFrame([(i, str(n) if n else None) for i, n in enumerate([1, 2, 3, 7, 0])], "k long, p string").repartition(13)
    found = ask_within_rate(rows, "k", "p", lambda: Flaky(log), tasks=tasks, wait=wait).collect()
    assert {r.p: (r.answer, r.attempts) for r in found} == {"1": ("ok", 1), "2": ("ok", 2), "3": ("ok", 3), "7": (None, 6), None: (None, 0)}
    asked = len(Path(log).read_text().splitlines())
    times = [float(x) for x in waits.read_text().split()]
    assert asked == 1 + 2 + 3 + 6  # 12 a minute, over all tasks, and a longer pause before each further round
    assert sorted(times) == sorted([5.0 * tasks] * asked + [15.0, 30.0, 45.0, 60.0, 75.0])


def stages(spark, log, broken=()):
    def made(name, rows):
        def make(got):
            with open(log, "a") as f:
                f.write(name + "\n")
            if name in broken:
                raise RuntimeError(f"{name} broke")
            return rows(got)

        return make

    base = lambda got: spark.createDataFrame([(i, str(i)) for i in range(10)], PAIR)
    return [
        Stage("read", PAIR, made("read", base)),
        Stage("even", PAIR, made("even", lambda got: got["read"].where("k % 2 = 0")), ("read",)),
        Stage("odd", PAIR, made("odd", lambda got: got["read"].where("k % 2 = 1")), ("read",)),
        Stage("both", PAIR, made("both", lambda got: got["even"].unionByName(got["odd"])), ("even", "odd")),
    ]


@pytest.mark.parametrize("broken", ["read", "even", "odd", "both"])
def test_a_run_goes_on_after_a_crash(spark, tmp_path, broken):
    log = f"{tmp_path}/log"
    status = lambda runner: {r.stage: r.status for r in runner.run().collect()}
    first = status(Runner(spark, f"{tmp_path}/run", stages(spark, log, (broken,))))
    assert first[broken] == "failed" and first["both"] != "done"
    if broken == "even":
        assert first == {"read": "done", "even": "failed", "odd": "done", "both": "skipped"}
    runner = Runner(spark, f"{tmp_path}/run", stages(spark, log))
    second = status(runner)
    assert all(s == ("done before" if first[n] == "done" else "done") for n, s in second.items())
    made = open(log).read().split()
    assert all(made.count(n) == (2 if n == broken else 1) for n in first)
    assert sorted(r.k for r in runner.output(runner.stages[-1]).collect()) == list(range(10))


def test_a_hard_stage_ends_the_run(spark, tmp_path):
    made = stages(spark, f"{tmp_path}/log", ("even",))
    hard = [Stage(s.name, s.schema, s.make, s.needs, soft=False) for s in made]
    with pytest.raises(RuntimeError, match="even broke"):
        Runner(spark, f"{tmp_path}/run", hard).run()
    with pytest.raises(ValueError):
        Runner(spark, f"{tmp_path}/run", [made[1], made[0]])


def in_files(frame, path, n, order):
    """The rows in n files that a stream reads one after another."""
    rows = frame.orderBy(order).collect()
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        out = frame.sparkSession.createDataFrame(part, frame.schema).coalesce(1)
        out.write.mode("append").parquet(path)
        files = [f for f in Path(path).glob("part-*") if not f.name.startswith("part-0000-")]
        for f in files:
            if f.stat().st_mtime and not f.name.startswith("done"):
                f.rename(f.with_name(f"done-{i:03d}.parquet"))
        os.utime(f"{path}/done-{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return frame.sparkSession.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_coverage_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"e{min(rng.randrange(40), rng.randrange(40))}", rng.randrange(12), i) for i in range(300)] + [(None, 1, 300), ("x", None, 301)]
    stream = in_files(spark.createDataFrame(rows, "entity string, paper long, place long"), f"{tmp_path}/in", 5, "place")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = new_entities(stream)
    seen.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    first, mine = {}, {}
    for entity, paper, _ in rows:
        if entity is not None and paper is not None:
            first.setdefault(entity, paper)
            mine.setdefault(paper, set()).add(entity)
    want = {p: (len(es), sum(first[e] == p for e in es)) for p, es in mine.items()}
    found = gain_of(spark.read.schema(seen.schema).parquet(f"{tmp_path}/out")).collect()
    assert {r.paper: (r.n_entities, r.n_new) for r in found} == want


@pytest.mark.parametrize("last", [True, False])
def test_upserts_of_a_stream(spark, tmp_path, last):
    rng = random.Random(3)
    rows = [(rng.randrange(20) if rng.random() > 0.1 else None, i, f"v{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "k long, at long, v string")
    table = Versions(spark, f"{tmp_path}/table", frame.schema)
    found = run_upserts(in_files(frame, f"{tmp_path}/in", 4, "at"), table, ["k"], ["at"], f"{tmp_path}/state", last=last)
    want = {}
    for k, at, v in rows:
        want[k] = (at, v) if last else want.get(k, (at, v))
    assert {r.k: (r.at, r.v) for r in found.collect()} == want and len(table.complete()) == 2
    before = sorted(map(str, found.collect()))
    merge_batch(table, ["k"], ["at"], last)(spark.createDataFrame([(1, 999, "again")], frame.schema), 3)  # a batch that is replayed
    merge_batch(table, ["k"], ["at"], last)(spark.createDataFrame([(1, 999, "again")], frame.schema), 0)
    assert sorted(map(str, table.read(table.complete()[-1]).collect())) == before


def merge_in_turn(boxes, margin=10.0):
    """One box after another takes in what it overlaps, again and again until a pass changes nothing."""
    left, changed = list(boxes), True
    while changed:
        changed, out = False, []
        while left:
            own, rest = left.pop(0), []
            for b in left:
                if own[1] - margin < b[3] and b[1] < own[3] + margin and own[2] - margin < b[4] and b[2] < own[4] + margin:
                    own, changed = (min(own[0], b[0]), min(own[1], b[1]), min(own[2], b[2]), max(own[3], b[3]), max(own[4], b[4])), True
                else:
                    rest.append(b)
            left = rest
            out.append(own)
        left = out
    return left


def test_boxes_merge_to_the_end(spark):
    rng = random.Random(6)
    pages = {}
    for page in range(25):
        pages[page] = [(i, x := rng.uniform(-50, 900), y := rng.uniform(-50, 900), x + rng.uniform(1, 120), y + rng.uniform(1, 60)) for i in range(rng.randint(0, 40))]
    pages[99] = [(i, i * 12.0, i * 12.0, i * 12.0 + 8, i * 12.0 + 8) for i in range(60)]  # a chain
    rows = [(p, *b) for p, bs in pages.items() for b in bs]
    found = merged_boxes(spark.createDataFrame([*rows, (1, 77, None, 0.0, 1.0, 1.0)], "page long, id long, x0 double, y0 double, x1 double, y1 double"), "page", "id").collect()
    assert sorted(map(tuple, found)) == sorted((p, *b) for p, bs in pages.items() for b in merge_in_turn(bs))


def test_boxes_that_meet_by_rounding_from_one_side_only(spark):
    """Within the margin as one of them is widened and, by rounding, not as the other is: such boxes merge, and the rounds end."""
    rng, one_sided = random.Random(1), []
    while len(one_sided) < 20:
        low = rng.uniform(20, 900)
        high = next((h for h in (low - 10, math.nextafter(low - 10, 0), math.nextafter(low - 10, 1e9)) if (low - 10 < h) != (low < h + 10)), None)
        if high is not None:
            one_sided.append((low, high))
    rows = [(p, k, *box) for p, (low, high) in enumerate(one_sided) for k, box in ((p % 2, (high - 5, 0.0, high, 9.0)), (1 - p % 2, (low, 0.0, low + 5, 9.0)))]
    found = merged_boxes(spark.createDataFrame([*rows, (99, 1, 0.0, 0.0, 1.0, 1.0)], "page long, id long, x0 double, y0 double, x1 double, y1 double"), "page", "id").collect()
    assert sorted(map(tuple, found)) == sorted([*((p, 0, high - 5, 0.0, low + 5, 9.0) for p, (low, high) in enumerate(one_sided)), (99, 1, 0.0, 0.0, 1.0, 1.0)])


def test_figure_boxes(spark):
    from folioscope.plans.registry import Tables
    from folioscope.plans.store_queries import drawings

    pages = {}
    for r in drawings(Tables(spark, SF)).collect():
        if 100 < (r.x1 - r.x0) * (r.y1 - r.y0) < 0.8 * 480_000:
            pages.setdefault(r.page, []).append((r.id, r.x0, r.y0, r.x1, r.y1))
    want = [(p, b[0], b[1] - 5, b[2] - 5, b[3] + 5, b[4] + 5) for p, bs in pages.items() for b in merge_in_turn(bs) if b[3] - b[1] > 50 and b[4] - b[2] > 50]
    found = plans.QUERIES["figure_boxes"](spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 10


def test_folders(spark):
    wanted = spark.createDataFrame([(s,) for s in ["bert", "gpt", "vit", "x9", "nothing", "", None, "bert"]], "s string")
    folders = spark.createDataFrame([("bert", None), ("bert_2018", "a"), ("gpt_b", "b"), ("gpt_a", "c"), ("zz", "x9"), ("yy", "x9"), (None, "vit"), ("", "vit")], "f string, i string")
    found = {r.stem: (r.folder, r.rule) for r in find_folders(wanted, "s", folders, "f", "i").collect()}
    assert found == {"bert": ("bert", "exact"), "gpt": ("gpt_a", "prefix"), "x9": ("yy", "inside")}
    assert find_folders(wanted.where("false"), "s", folders, "f", "i").count() == 0
