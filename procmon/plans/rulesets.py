"""Label rule sets of the fixture logs (FIXTURES.md, "Rules and labels on EL1")."""

from __future__ import annotations

from procmon.functions.rules import Count, Follows, Present, RuleSet

EL1_ACTIVITIES = ("click", "view", "purchase", "signup", "error")
EL1_GATEWAYS = ("x1", "x2", "x3", "x4")

EL1_RULES = RuleSet(
    activities=EL1_ACTIVITIES,
    gateways=EL1_GATEWAYS,
    rules=(
        Follows("x1", "view", "purchase", taken=1, not_taken=0),
        Present(
            "x2",
            (
                ((("signup", True), ("error", False)), 0),
                ((("signup", False), ("error", True)), 1),
                ((("signup", False), ("error", False)), 2),
                ((("signup", True), ("error", True)), 3),
            ),
        ),
        Count("x3", "purchase", (("==", 1, 0), (">", 1, 1))),
        Follows("x4", "click", "click", taken=1),
    ),
    defaults={"x4": 0},
)

# the same rules as plain data
EL1_RULES_DICT = {
    "activities": list(EL1_ACTIVITIES),
    "gateways": list(EL1_GATEWAYS),
    "defaults": {"x4": 0},
    "rules": [
        {"kind": "follows", "gateway": "x1", "a": "view", "b": "purchase", "taken": 1, "not_taken": 0},
        {
            "kind": "present",
            "gateway": "x2",
            "cases": [
                [{"signup": True, "error": False}, 0],
                [{"signup": False, "error": True}, 1],
                [{"signup": False, "error": False}, 2],
                [{"signup": True, "error": True}, 3],
            ],
        },
        {"kind": "count", "gateway": "x3", "activity": "purchase", "cases": [["==", 1, 0], [">", 1, 1]]},
        {"kind": "follows", "gateway": "x4", "a": "click", "b": "click", "taken": 1},
    ],
}

# DuckDB statement of the same target table (NULL = undefined)
EL1_TARGETS_SQL = """ev AS (
  SELECT case_id, activity AS act, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt, lead(activity) OVER w AS nxt,
         row_number() OVER w AS nr
  FROM el1 WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
tg AS (
  SELECT case_id,
    """ + ",\n    ".join(
    f"CAST(sum(CASE WHEN act = '{a}' AND dt IS NOT NULL THEN dt END) AS DOUBLE) / "
    f"count(CASE WHEN act = '{a}' AND dt IS NOT NULL THEN 1 END) / CAST(1000000 AS DOUBLE) AS {a}"
    for a in EL1_ACTIVITIES
) + """,
    CAST(arg_max(CASE WHEN act = 'view' AND nxt = 'purchase' THEN 1 WHEN act = 'view' AND nxt <> 'purchase' THEN 0 END, nr)
         FILTER (WHERE act = 'view' AND nxt IS NOT NULL) AS INTEGER) AS x1,
    CAST(CASE WHEN bool_or(act = 'signup') AND NOT bool_or(act = 'error') THEN 0
              WHEN NOT bool_or(act = 'signup') AND bool_or(act = 'error') THEN 1
              WHEN NOT bool_or(act = 'signup') AND NOT bool_or(act = 'error') THEN 2
              WHEN bool_or(act = 'signup') AND bool_or(act = 'error') THEN 3 END AS INTEGER) AS x2,
    CAST(CASE WHEN count_if(act = 'purchase') = 1 THEN 0 WHEN count_if(act = 'purchase') > 1 THEN 1 END AS INTEGER) AS x3,
    CAST(arg_max(1, nr) FILTER (WHERE act = 'click' AND nxt = 'click') AS INTEGER) AS x4
  FROM ev GROUP BY case_id)"""
