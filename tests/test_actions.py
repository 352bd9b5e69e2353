import pytest

from veilspark.functions.actions import navigate_reason
from veilspark.operators.actions import validate_actions
from veilspark.operators.next_action import HISTORY, IDLE_REASON, plan_snapshots
from veilspark.operators.sanitize import ELEMENT
from veilspark.operators.sessions import session_outcomes, session_steps

STATES = [
    (1, "el_001", "button", None, "submit", False, True), (1, "el_002", "input", None, "text", False, True),
    (1, "el_003", "input", None, "checkbox", False, True), (1, "el_004", "select", None, None, False, True),
    (1, "el_005", "p", None, None, False, True), (1, "el_006", "button", None, None, True, True),
    (1, "el_007", "button", None, None, False, False),
]
HERE = "http://site.example.com/a"
ACTIONS = [
    ("CLICK", "el_001", None, None), ("TYPE", "el_002", "", None), ("CHECK", "el_003", None, None),
    ("SELECT", "el_004", "x", None), ("SCROLL", "el_005", None, None), ("DONE", None, None, None),
    ("WAIT", None, None, None), ("NAVIGATE", None, "/b", HERE), ("click", "el_001", None, None),
    ("CLICK", "el_999", None, "unknown target"), ("CLICK", "el_005", None, "not clickable"),
    ("EVAL", "el_001", None, "unsupported"), (None, "el_001", None, "unsupported"),
    ("TYPE", "el_001", "x", "not a text control"), ("TYPE", "el_002", None, "needs a value"),
    ("SELECT", "el_002", "x", "not a select"), ("CHECK", "el_002", None, "not checkable"),
    ("CLICK", "el_006", None, "disabled"), ("CLICK", "el_007", None, "hidden"),
    ("NAVIGATE", None, "http://evil.example.com/", "cross-origin"), ("CLICK", "button", None, "bad target"),
    ("CLICK", " EL_001 ", None, "unknown target"), ("NAVIGATE", None, "", "needs a URL"),
]


def test_validation(spark):
    states = spark.createDataFrame(
        STATES, "scan_id int, id string, tag string, role string, input_type string, disabled boolean, visible boolean"
    )
    rows = [(i, 1, a, t, v, HERE) for i, (a, t, v, _) in enumerate(ACTIONS)]
    log = spark.createDataFrame(rows, "i int, scan_id int, action string, target string, value string, current_url string")
    got = {r.i: r for r in validate_actions(log, states).collect()}
    for i, (_, _, _, want) in enumerate(ACTIONS):
        expected = None if want == HERE else want
        assert got[i].valid == (expected is None), got[i]
        assert expected is None or expected in got[i].reason


@pytest.mark.parametrize("value,current,strict,compat", [
    ("http://a.example/x", "http://a.example/", True, True), ("http://a.example:80/", "http://A.example/", True, True),
    ("https://a.example/", "http://a.example/", False, False), ("//a.example/x", "http://a.example/", True, True),
    ("file:///x", "file:///y", True, True), ("http://", "http://a.example/", False, False),
    ("http://a b/", "http://a.example/", False, False), ("/x", None, False, True),
    ("data:x", "about:blank", False, True), ("javascript:x", "http://a.example/", False, False),
    ("http://user@a.example/", "http://a.example/", True, True), ("http://[::1]x/", "http://a.example/", False, False),
])
def test_navigation(spark, value, current, strict, compat):
    df = spark.createDataFrame([(value, current)], "v string, c string")
    row = df.selectExpr(f"{navigate_reason('v', 'c')} AS s", f"{navigate_reason('v', 'c', True)} AS k").first()
    assert (row.s is None, row.k is None) == (strict, compat)


def plan(spark, elements, goal, history=None):
    names = [f.split(":")[0] for f in ELEMENT[len("struct<"):-1].split(",")]
    els = [tuple(({n: None for n in names} | e)[n] for n in names) for e in elements]
    df = spark.createDataFrame([(els, goal, history)], f"elements array<{ELEMENT}>, goal string, history {HISTORY}")
    return plan_snapshots(df).first()["next"]


def test_form_in_four_steps(spark):
    goal = "Submit Verified Profile"
    def past(*targets, reason="Next page"):
        return [(i, ("CLICK", t, None, reason), True, None) for i, t in enumerate(targets)]
    one = [{"id": "el_001", "tag": "input", "label": "Full Name"}, {"id": "el_005", "tag": "button", "text": "Continue to Step 2"}]
    last = [{"id": "el_002", "tag": "button", "text": "Back"}, {"id": "el_003", "tag": "button", "text": "Submit Verified Profile"}]
    done = [{"id": "el_001", "tag": "div", "text": "Verification Complete! All done."}]
    assert plan(spark, one, goal).target == "el_005"
    assert plan(spark, one, goal, past("el_005")).target == "el_005"
    assert plan(spark, last, goal, past("el_005", "el_005")).target == "el_003"
    assert plan(spark, last, goal, past("el_003", reason="Final step: el_003")).action == "DONE"
    assert plan(spark, done, goal, past("el_005")).action == "DONE"
    assert plan(spark, done, goal).reason == IDLE_REASON
    assert plan(spark, [], goal).action == "WAIT"
    assert plan(spark, one, "go to /x").value == "/x"
    assert plan(spark, one, None).reason == IDLE_REASON


def records(spark, *rows):
    """(session, action, reason, blocked, valid, success) in order."""
    data = [(s, i, a, r, b, v, ok, None) for i, (s, a, r, b, v, ok) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "session_id int, record_id int, action string, reason string, blocked boolean, valid boolean, "
              "success boolean, network_error string"
    )
    return df.selectExpr("*", "timestamp_seconds(record_id) AS ts", "'el_001' AS target")


def test_session_ends(spark):
    step = ("CLICK", "r", False, True, True)
    rows = [
        (1, *step), (1, "DONE", "r", False, True, True), (1, *step),
        (2, "WAIT", IDLE_REASON, False, True, True), (3, *step), (3, "CLICK", "r", False, False, True),
        (4, *step), (4, "CLICK", "r", True, True, True), (5, "CLICK", "r", False, True, False),
        *[(6, *step)] * 14, (7, "WAIT", "other", False, True, True), *[(8, *step)] * 9, (8, "DONE", "r", False, True, True),
        *[(9, *step)] * 10, (9, "DONE", "r", False, True, True),
    ]
    got = {r.session_id: (r.status, r.step_count, r.response) for r in session_outcomes(session_steps(records(spark, *rows))).collect()}
    assert got == {
        1: ("completed", 1, "success"), 2: ("idle", 0, "error"), 3: ("rejected", 2, "rejected"),
        4: ("blocked", 1, "blocked"), 5: ("failed", 1, "error"), 6: ("max_steps_reached", 10, "error"),
        7: ("running", 1, "error"), 8: ("completed", 9, "success"), 9: ("max_steps_reached", 10, "error"),
    }


def test_only_the_head_of_a_session_is_shuffled(spark):
    plan_text = session_steps(records(spark, (1, "CLICK", "r", False, True, True)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan_text


def test_stages_and_stop_reasons(spark):
    from veilspark.operators.sessions import session_stages, session_steps

    plain = dict(action="CLICK", target="el_001", reason="r", blocked=False, network_error=None, valid=True, rejection=None, success=True)
    ends = {
        1: dict(blocked=True), 2: dict(network_error="timeout"), 3: dict(action="DONE"), 4: dict(action="DONE", reason=""),
        5: dict(action="WAIT", reason="no actionable target found"), 6: dict(valid=False, rejection="disabled target"),
        7: dict(success=False), 8: {},
    }
    rows = []
    for session, end in ends.items():
        for i in range(3):
            rows.append({"session_id": session, "record_id": i, "ts": i, **plain, **(end if i == 1 else {})})
    rows += [{"session_id": 9, "record_id": i, "ts": i, **plain} for i in range(12)]
    df = spark.createDataFrame(rows, "session_id int, record_id int, ts int, action string, target string, reason string, blocked boolean, network_error string, valid boolean, rejection string, success boolean")
    got = {}
    for r in session_stages(session_steps(df)).orderBy("session_id", "seq").collect():
        got.setdefault(r.session_id, []).append((r.seq, r.stage, r.status, r.step, r.stop_reason))
    for session, stages in got.items():
        assert stages[:2] == [(0, "tab_query", "success", 0, None), (1, "initial_perception", "success", 0, None)]
        assert [s[0] for s in stages] == list(range(len(stages))) and all(s[4] is None for s in stages[:-1])
    assert {k: v[-1][2:] for k, v in got.items()} == {
        1: ("blocked", 1, "payload blocked by the gate"), 2: ("error", 1, "network error: timeout"), 3: ("completed", 1, "r"),
        4: ("completed", 1, "goal reached"), 5: ("idle", 1, "no actionable target"), 6: ("rejected", 2, "action rejected: disabled target"),
        7: ("failed", 2, "execution failed"), 8: ("success", 3, None), 9: ("max_steps_reached", 10, "max steps reached"),
    }
