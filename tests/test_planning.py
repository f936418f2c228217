"""Plans with verbs on hand-made scenes and random ones, against a replay and an exhaustive search."""

import itertools
import random

import pytest

from stepfold.operators import planning as P
from stepfold.operators.state import REQUIRED_STATES

VERBS = [("unscrew", "screw", "fastened", "loosened"), ("remove", "screw", "loosened", "removed"), ("open", "clip", "closed", "open"), ("release", "clip", "closed", "open"), ("displace", "bracket", "installed", "displaced"), ("remove", "bracket", "installed", "removed"), ("remove", "bracket", "displaced", "removed"), ("remove", "board", "installed", "removed"), ("open", "latch", "closed", "open")]
START = {"screw": "fastened", "clip": "closed", "bracket": "installed", "board": "installed", "latch": "closed"}
EDGE = "machine int, target string, type string, blocker string, mode string, necessity string, status string"
#: verbs that each kind of edge gates
GATED = {"fastened_by": {"remove", "displace", "open"}, "locked_by": {"remove", "displace", "open"}, "covered_by": {"remove", "displace", "open", "unscrew", "disconnect", "release"}, ("blocked_by", "physical_path"): {"remove", "displace"}, ("blocked_by", "cable_tension"): {"remove"}, ("blocked_by", "tool_access"): {"remove", "displace", "open", "unscrew", "disconnect", "release"}}


def edge(target, kind, blocker, mode=None, necessity="required", status="accepted"):
    return (target, kind, blocker, mode, necessity, status)


def plans(spark, scenes, goals=None, attached=None):
    """{(machine, goal): (relaxed, [(verb, key)])} of scenes [(parts, edges)], all machines at once."""
    cls = lambda key: key.split(".")[0]
    state = [(m, k, cls(k), s or START[cls(k)]) for m, (parts, _) in enumerate(scenes) for k, s in parts.items()]
    wanted = [(m, k) for m, k, *_ in state if goals is None or k in goals]
    now = spark.createDataFrame(state, "machine int, key string, cls string, state string")
    edges = spark.createDataFrame([(m, *e) for m, (_, es) in enumerate(scenes) for e in es], EDGE)
    left = None if attached is None else spark.createDataFrame(attached, "machine int, key string, parent string")
    steps = P.removal_plans(now, edges, spark.createDataFrame(VERBS, "verb string, cls string, from string, to string"), spark.createDataFrame(wanted, "machine int, goal string"), ["machine"], left).orderBy("step").collect()
    out = {}
    for r in steps:
        out.setdefault((r.machine, r.goal), (r.relaxed, []))[1].append((r.verb, r.key, r["from"], r.to))
    return out


def gates(e, verb):
    target, kind, blocker, mode, necessity, status = e
    return status == "accepted" and target != blocker and verb in GATED.get(kind, GATED.get((kind, mode), set()))


def legal(parts, edges, state, key, verb, frm, soft):
    if state[key] != frm:
        return False
    for e in edges:
        if e[0] == key and gates(e, verb) and (soft or e[4] == "required") and e[2] in state:
            if state[e[2]] not in [*REQUIRED_STATES[e[1]], "removed"]:
                return False
    return True


def reachable(parts, edges, goal, soft):
    """By exhaustive search over all states."""
    keys = sorted(parts)
    start = tuple(parts[k] or START[k.split(".")[0]] for k in keys)
    seen, todo = {start}, [start]
    while todo:
        now = todo.pop()
        state = dict(zip(keys, now))
        if state[goal] == "removed":
            return True
        for k, (verb, cls, frm, to) in itertools.product(keys, VERBS):
            if cls == k.split(".")[0] and legal(parts, edges, state, k, verb, frm, soft):
                after = tuple(to if x == k else s for x, s in zip(keys, now))
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
    return False


def replays(parts, edges, steps, goal, soft):
    state = {k: s or START[k.split(".")[0]] for k, s in parts.items()}
    for verb, key, frm, to in steps:
        if not legal(parts, edges, state, key, verb, frm, soft):
            return False
        state[key] = to
    return state[goal] == "removed"


def test_hand_made_scenes(spark):
    two = {"bracket.1": None, "bracket.2": None, "screw.1": None}
    sits = [edge("bracket.1", "fastened_by", "screw.1"), edge("screw.1", "blocked_by", "bracket.1", "physical_path")]
    tool = [edge("bracket.1", "fastened_by", "screw.1"), edge("screw.1", "blocked_by", "bracket.1", "tool_access")]
    clip = {"board.1": None, "clip.1": None, "screw.1": None, "bracket.1": None}
    ways = [edge("board.1", "locked_by", "clip.1"), edge("clip.1", "fastened_by", "screw.1"), edge("screw.1", "covered_by", "board.1")]
    scenes = [
        (two, sits),  # no deadlock: nothing gates unscrewing
        (two, tool),  # a deadlock
        (two, [edge("bracket.1", "blocked_by", "bracket.2", "physical_path"), edge("bracket.2", "blocked_by", "bracket.1", "physical_path")]),
        (two, [*tool[:1], edge("screw.1", "blocked_by", "bracket.1", "tool_access", "recommended")]),  # a preference is dropped
        (two, [*tool[:1], edge("screw.1", "blocked_by", "bracket.1", "tool_access", "required", "rejected")]),
        (clip, ways),  # opening waits for the screw, releasing does not
        (clip, [*ways, edge("clip.1", "covered_by", "board.1")]),  # both ways are gated
        ({"board.1": None, "latch.1": None}, [edge("board.1", "fastened_by", "latch.1")]),  # a latch is never removed nor loosened
        (two, [edge("bracket.1", "blocked_by", "bracket.2", "physical_path", "recommended")]),  # a preference that holds
        (two, [edge("bracket.1", "fastened_by", "gone.1")]),  # a blocker without a state
        ({"bracket.1": "removed", "screw.1": "loosened"}, []),
    ]
    got = plans(spark, scenes)
    verbs = {k: (r, [s[:2] for s in steps]) for k, (r, steps) in got.items()}
    assert verbs[0, "bracket.1"] == (False, [("unscrew", "screw.1"), ("remove", "bracket.1")])
    assert (1, "bracket.1") not in got and (1, "bracket.2") in got
    assert (2, "bracket.1") not in got and (2, "bracket.2") not in got
    assert verbs[3, "bracket.1"] == (True, [("unscrew", "screw.1"), ("remove", "bracket.1")])
    assert verbs[4, "bracket.1"][0] is False
    assert verbs[5, "board.1"] == (False, [("release", "clip.1"), ("remove", "board.1")])
    assert (6, "board.1") not in got and (7, "board.1") not in got
    assert verbs[8, "bracket.1"] == (False, [("displace", "bracket.2"), ("remove", "bracket.1")])
    assert verbs[9, "bracket.1"] == (False, [("remove", "bracket.1")])
    assert (10, "bracket.1") not in got and verbs[10, "screw.1"] == (False, [("remove", "screw.1")])


def test_attached_parts_leave_with_their_parent(spark):
    parts = {"bracket.1": None, "latch.1": None, "screw.1": None}
    got = plans(spark, [(parts, [edge("bracket.1", "fastened_by", "screw.1")])], ["latch.1"], [(0, "latch.1", "bracket.1")])
    assert [s[:2] for s in got[0, "latch.1"][1]] == [("unscrew", "screw.1"), ("remove", "bracket.1")]


def random_scene(rng):
    parts = {f"{c}.{i}": rng.choice([None] * 6 + ["removed"]) for c, n in (("screw", 2), ("clip", 1), ("bracket", 2), ("board", 1), ("latch", 1)) for i in range(n)}
    kinds = [("fastened_by", None), ("locked_by", None), ("covered_by", None), ("blocked_by", "physical_path"), ("blocked_by", "tool_access"), ("blocked_by", "cable_tension")]
    fits = {"fastened_by": "screw", "locked_by": ("clip", "latch"), "covered_by": ("bracket", "board"), "blocked_by": ("bracket", "board", "screw")}
    edges = []
    for _ in range(rng.randint(2, 9)):
        kind, mode = rng.choice(kinds)
        a, b = rng.sample(sorted(parts), 2)
        if b.startswith(fits[kind]):
            edges.append(edge(a, kind, b, mode, rng.choice(["required", "required", "recommended"]), rng.choice(["accepted"] * 5 + ["rejected"])))
    return parts, edges


def test_random_scenes_against_exhaustive_search(spark):
    rng = random.Random(20)
    scenes = [random_scene(rng) for _ in range(60)]
    got = plans(spark, scenes)
    n = 0
    for m, (parts, edges) in enumerate(scenes):
        for goal, was in parts.items():
            if was == "removed":
                assert (m, goal) not in got
                continue
            strict, loose = reachable(parts, edges, goal, True), reachable(parts, edges, goal, False)
            assert ((m, goal) in got) == (strict or loose), (parts, edges, goal)
            if (m, goal) in got:
                relaxed, steps = got[m, goal]
                assert relaxed == (not strict) and steps[-1][3] == "removed"
                assert replays(parts, edges, steps, goal, not relaxed), (parts, edges, goal, steps)
                n += len(steps) > 1
    assert n > 50


def test_unsound_plans_are_found(spark):
    state = spark.createDataFrame([(0, "board.1", "board", "installed"), (0, "screw.1", "screw", "fastened")], "machine int, key string, cls string, state string")
    edges = spark.createDataFrame([(0, *edge("board.1", "fastened_by", "screw.1"))], EDGE)
    rows = [("ok", 0, "screw.1", "unscrew", "fastened", "loosened"), ("ok", 1, "board.1", "remove", "installed", "removed"), ("early", 0, "board.1", "remove", "installed", "removed"), ("jump", 0, "screw.1", "remove", "loosened", "removed"), ("short", 0, "screw.1", "unscrew", "fastened", "loosened")]
    steps = spark.createDataFrame([(0, *r) for r in rows], "machine int, goal string, step int, key string, verb string, from string, to string")
    assert {r.goal for r in P.unsound(steps, state, edges, ["machine"]).collect()} == {"early", "jump", "short"}


def test_corruptions_are_certain(spark):
    parts = {"board.1": None, "screw.1": None, "screw.2": None, "bracket.1": None}
    state = spark.createDataFrame([(m, k, k.split(".")[0], START[k.split(".")[0]]) for m in range(3) for k in parts], "machine int, key string, cls string, state string")
    hold = [edge("board.1", "fastened_by", "screw.1"), edge("board.1", "fastened_by", "screw.2"), edge("board.1", "blocked_by", "bracket.1", "physical_path", "recommended")]
    edges = [(0, *e) for e in hold] + [(1, *e) for e in hold[2:]] + [(2, *e) for e in hold] + [(2, *edge("screw.1", "covered_by", "bracket.1"))]
    plan = [("screw.1", "unscrew", "loosened"), ("screw.2", "unscrew", "loosened"), ("board.1", "remove", "removed")]
    logs = spark.createDataFrame([(m, m * 10, i, *p) for m in range(3) for i, p in enumerate(plan)], "machine int, log int, pos int, key string, verb string, to string")
    out = P.certain_corruptions(logs, state, spark.createDataFrame(edges, EDGE), ["log"], ["machine"]).collect()
    assert [(r.machine, r.log) for r in out] == [(0, 0)]  # a preference alone breaks nothing; a log that does not hold says nothing
    (r,) = out
    at = r.corrupted.index("remove board.1")
    late = {"screw.1", "screw.2"} - {a.split()[1] for a in r.corrupted[:at]}
    assert sorted(a for a in r.corrupted) == sorted(f"{v} {k}" for k, v, _ in plan) and r.first_error == at
    assert r.broken == sorted(f"fastened_by(board.1, {k})" for k in late) and late


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_rearrangements_are_all_there(spark, n):
    logs = spark.createDataFrame([(7, i, f"k{i}", "remove", "removed") for i in range(n)], "log int, pos int, key string, verb string, to string")
    found = {}
    for r in P.rearrangements(logs, ["log"]).orderBy("pos").collect():
        found.setdefault(r.tag, []).append(int(r.key[1:]))
    want = {}
    for i in range(n - 1):
        want[f"swap{i}"] = [*range(i), i + 1, i, *range(i + 2, n)]
    for j, i in itertools.product(range(n), repeat=2):
        if abs(i - j) >= 2:
            rest = [k for k in range(n) if k != j]
            want[f"move{j}to{i}"] = [*rest[:i], j, *rest[i:]]
    assert found == want


def test_rounds_go_over_numbers_alone(spark, monkeypatch):
    """Names are kept as often for a long chain of waiting parts as for a short one."""
    kept, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: kept.append(df.columns) or cut(df))
    named = {"key", "part", "verb", "from", "to", "state"}
    seen = {}
    for n in (3, 6):
        kept.clear()
        chain = {f"board.{i:02}": None for i in range(n)}
        found = plans(spark, [(chain, [edge(f"board.{i:02}", "covered_by", f"board.{i + 1:02}") for i in range(n - 1)])], ["board.00"])
        assert [k for _, k, *_ in found[0, "board.00"][1]] == sorted(chain, reverse=True)
        seen[n] = sum(bool(named & set(c)) for c in kept), len(kept)
    assert seen[3][0] == seen[6][0] and seen[3][1] < seen[6][1]


def test_no_rearranged_log_is_kept(spark, monkeypatch):
    """A log of n actions has about n rearrangements an action; what is kept has a row an action."""
    kept, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    parts = [f"screw.{i}" for i in range(8)] + ["screw.0", "board.1"]  # one screw is turned twice
    steps = [("unscrew", "loosened")] * 8 + [("remove", "removed")] * 2
    state = spark.createDataFrame([(0, k, k.split(".")[0], START[k.split(".")[0]]) for k in sorted(set(parts))], "machine int, key string, cls string, state string")
    edges = spark.createDataFrame([(0, *edge("board.1", "fastened_by", "screw.0")), (0, *edge("screw.0", "covered_by", "board.1", status="rejected"))], EDGE)
    logs = spark.createDataFrame([(0, 7, i, k, *s) for i, (k, s) in enumerate(zip(parts, steps))], "machine int, log int, pos int, key string, verb string, to string")
    (r,) = P.certain_corruptions(logs, state, edges, ["log"], ["machine"]).collect()
    at = r.corrupted.index("remove board.1")
    assert r.first_error == at and not {"unscrew screw.0", "remove screw.0"} & set(r.corrupted[:at]) and r.broken == ["fastened_by(board.1, screw.0)"]
    assert sorted(r.corrupted) == sorted(f"{v} {k}" for k, (v, _) in zip(parts, steps)) and max(df.count() for df in kept) == len(parts)
