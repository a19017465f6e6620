"""A session: agents in the order that the routes give, each adding to a shared state. Control flow stays on the driver; what
the agents do is DataFrame work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENTS = ("reader", "comparator", "critic", "gap_detector", "writer")


def merge_state(state: dict, update: dict) -> dict:
    """Later values win; lists grow."""
    return state | {k: state[k] + v if isinstance(v, list) and isinstance(state.get(k), list) else v for k, v in update.items()}


def next_agent(last: str | None, state: dict, choose: Callable[[list[str], dict], str] | None = None) -> str | None:
    """The reader first; with two papers or more, the comparator, critic and gap detector in an order that ``choose`` may set,
    each once; then the writer."""
    if last is None:
        return "reader"
    if last == "writer":
        return None
    if state.get("n_papers", 0) < 2:
        return "writer"
    left = [a for a in AGENTS[1:-1] if a not in state["fired"]]
    if not left:
        return "writer"
    return choose(left, state) if choose else left[0]


def run_session(agents: dict[str, Callable[[dict], dict]], state: dict, choose: Callable[[list[str], dict], str] | None = None) -> dict:
    """Run agents until the routes end; an agent that fails leaves its error in the state and the session goes on."""
    state, last = {"fired": [], "errors": []} | state, None
    while (name := next_agent(last, state, choose)) is not None:
        try:
            state = merge_state(state, agents[name](state))
        except Exception as e:  # one agent's failure must not end the session
            state = merge_state(state, {"errors": [f"{name}: {e}"]})
        state = merge_state(state, {"fired": [name]})
        last = name
    return state


def pending(items: DataFrame, outputs: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, step) of every step whose output lacks an item: what a checkpointed runner still has to do."""
    parts = [items.select(key).distinct().join(done.select(key).distinct(), key, "left_anti").withColumn("step", F.lit(step)) for step, done in outputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
