from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sightline import constants as K
from sightline.operators import scoring

ROWS = st.dictionaries(st.sampled_from([*K.CHECK_IDS, "unknown"]), st.tuples(st.integers(-20, 130), st.booleans()), min_size=1)


def frame(spark, scans):
    rows = [(i, c, s, "error" if e else "pass") for i, checks in enumerate(scans) for c, (s, e) in checks.items()]
    return spark.createDataFrame(rows, "scan_id long, check_id string, score int, status string")


def by_hand(checks):
    used = [(c, s) for c, (s, e) in checks.items() if not e and c in K.CHECKS]
    weight = sum(K.CHECKS[c][2] for c, _ in used)
    if not weight:
        overall = 0
    else:
        overall = int(sum(K.CHECKS[c][2] * max(0, min(100, s)) for c, s in used) / weight + 0.5)
    level = 0 if overall <= 20 else 1 if overall <= 50 else 2 if overall <= 75 else 3
    scores = {c: s for c, (s, e) in checks.items() if not e}
    while level and any(scores.get(c, 50) < 50 for n in range(1, level + 1) for c in K.LEVEL_GATES[n]):
        level -= 1
    return overall, level


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROWS, min_size=1, max_size=12))
def test_scores_and_levels(spark, scans):
    got = {r["scan_id"]: r for r in scoring.scan_scores(frame(spark, scans)).collect()}
    for i, checks in enumerate(scans):
        assert (got[i]["overall_score"], got[i]["readiness_level"]) == by_hand(checks)
        assert 0 <= got[i]["overall_score"] <= 100 and got[i]["transactional"] is None


def test_weights_sum_to_one_hundred():
    assert sum(v[2] for v in K.CHECKS.values()) == 100


def test_added_and_removed_checks(spark):
    checks = frame(spark, [{"robots-txt": (0, False), "llms-txt": (40, False)}, {"robots-txt": (10, False), "performance": (5, False)}])
    pairs = spark.createDataFrame([(0, 1)], "before_id long, after_id long")
    got = {r["check_id"]: (r["change"], r["percent"]) for r in scoring.check_deltas(checks, pairs).collect()}
    assert got == {"robots-txt": ("improved", None), "llms-txt": ("removed", None), "performance": ("added", None)}


def test_illegal_transitions(spark):
    rows = [(1, 1, "requested"), (1, 2, "approved"), (1, 3, "completed"), (2, 1, "failed"), (2, 2, "approved")]
    h = spark.createDataFrame(rows, "id long, d int, status string").selectExpr("id", "timestamp_seconds(d) AS t", "status")
    got = {(r["id"], r["previous_status"], r["from_terminal"]) for r in scoring.illegal_transitions(h, K.PAYOUT_TRANSITIONS, "id", ["t"]).collect()}
    assert got == {(1, "approved", False), (2, "failed", True)}
