"""Whole records on hand-made moments."""

import json

from stepfold.operators import records as V

BOX = "step int, key string, x0 long, y0 long, x1 long, y1 long, visibility string, verified boolean"


def scene(spark):
    state = spark.createDataFrame([(s, k, c, v) for s in (1, 2) for k, c, v in (("psu.1", "psu", "installed"), ("screw.1", "screw", "tight" if s == 1 else "removed"), ("lid.1", "cover", "closed"))], "step int, key string, cls string, state string")
    edges = spark.createDataFrame([(s, "psu.1", t, b, None, "accepted") for s in (1, 2) for t, b in (("fastened_by", "screw.1"), ("covered_by", "lid.1"))], "step int, target string, type string, blocker string, mode string, status string")
    boxes = spark.createDataFrame([(1, "psu.1", 0, 0, 9, 9, "visible", True), (1, "screw.1", 1, 1, 3, 3, "visible_tiny", True), (2, "lid.1", 2, 2, 4, 4, "visible", False)], BOX)
    frames = spark.createDataFrame([(1, False), (2, False)], "step int, verified boolean")
    return state, edges, boxes, frames


def test_feasibility(spark):
    state, edges, boxes, frames = scene(spark)
    cases = spark.createDataFrame([(1, "unscrew", "screw.1", "demonstrated"), (1, "remove", "psu.1", "blocked_by_graph"), (1, "unscrew", "psu.1", "failed_attempt"), (2, "remove", "screw.1", "inapplicable"), (2, "remove", "lid.1", "failed_attempt"), (2, "remove", "gone.1", "demonstrated")], "step int, verb string, key string, truth string")
    got = {(r.step, r.truth): r for r in V.feasibility(cases, state, edges, boxes, frames, ["step"], ["{}?"]).collect()}
    assert set(got) == {(1, "demonstrated"), (1, "blocked_by_graph"), (1, "failed_attempt"), (2, "inapplicable")}  # what no edge explains, and what is no part, is not asked
    yes, no = got[1, "demonstrated"], got[1, "blocked_by_graph"]
    assert yes.question == "unscrew screw.1?" and json.loads(yes.answer) == {"feasible": True, "blockers": [], "reason": None} and yes.negative is None and yes.verified
    assert json.loads(no.answer) == {"feasible": False, "blockers": ["lid.1", "screw.1"], "reason": "violates_edge"} and no.negative == "blocked_by_graph"
    assert [t.op for t in no.chain] == ["observe", *["recall_relation", "observe", "check_precondition"] * 2] and [t.subject for t in no.chain][2::3] == ["lid.1", "screw.1"]
    assert [(e.key, e.box) for e in no.evidence] == [("psu.1", [0, 0, 9, 9]), ("screw.1", [1, 1, 3, 3])] and no.verified
    assert json.loads(got[1, "failed_attempt"].answer)["blockers"] == ["lid.1"]  # a cover gates every verb, a screw does not
    late = got[2, "inapplicable"]
    assert json.loads(late.answer)["reason"] == "state" and late.chain[-1].op == "check_precondition" and not late.evidence and not late.verified
    assert V.feasibility(cases.limit(0), state, edges, boxes, frames, ["step"], ["{}?"]).count() == 0


def test_bounded_sets(spark):
    _, _, boxes, frames = scene(spark)
    sets = spark.createDataFrame([(1, "unscrew:screw.1", "remove:psu.1", "unscrew:screw.1,open:lid.1"), (2, "open:lid.1", "", "open:lid.1")], "step int, must_include string, must_not_include string, permitted string")
    got = {r.step: r for r in V.bounded(sets, boxes, frames, ["step"], ["what now?"]).collect()}
    assert json.loads(got[1].answer) == {"must_include": ["unscrew:screw.1"], "must_not_include": ["remove:psu.1"], "permitted_upper_bound": ["unscrew:screw.1", "open:lid.1"]}
    assert json.loads(got[2].answer)["must_not_include"] == [] and [e.key for e in got[2].evidence] == ["lid.1"] and not got[2].verified and got[1].verified


def test_pointing_and_abstaining(spark):
    rows = [(1, "screw.1", "screw", "tight", 5, "visible"), (1, "screw.2", "screw", "tight", 1, "visible"), (1, "psu.1", "psu", "installed", 7, "visible"), (1, "fan.1", "fan", "installed", 7, "occluded_full"), (1, "ram.1", "ram", "installed", 3, "out_of_view"), (1, "ram.2", "ram", "installed", 3, "too_small"), (1, "ram.3", "ram", "installed", 4, "too_small"), (2, "psu.1", "psu", "installed", 7, "visible")]
    df = spark.createDataFrame([(s, k, c, v, x, x, x + 2, x + 2, see, True) for s, k, c, v, x, see in rows], "step int, key string, cls string, state string, x0 long, y0 long, x1 long, y1 long, visibility string, verified boolean")
    seen = df.where("visibility = 'visible'")
    phrases = {(r.step, json.loads(r.answer)["instance"]): (r.question, r.truth) for r in V.pointed(seen, ["step"], 10, ["where is {}?"]).collect()}
    assert phrases == {(1, "psu.1"): ("where is the psu?", "class"), (1, "screw.1"): ("where is the right screw?", "place"), (1, "screw.2"): ("where is the left screw?", "place"), (2, "psu.1"): ("where is the psu?", "class")}
    out = V.abstaining(df, ["step"], 2, ["state of {}?"]).collect()
    assert {r.step for r in out} == {1}  # a moment without a hidden part says nothing
    yes, no = [r for r in out if r.negative is None], [r for r in out if r.negative]
    assert len(yes) == len(no) == 2 and all(r.chain[-1].op == "abstain" and not r.evidence and json.loads(r.answer) == {"answerable": False, "state": None} for r in no)
    assert all(r.evidence and json.loads(r.answer)["answerable"] for r in yes) and len({r.id for r in out}) == 4
