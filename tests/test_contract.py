"""The registry: every query has a name, most have SQL, the flagship runs."""
import __spark_entry__ as E


def test_registry_and_entry(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 140
    core = {n for n in q if not n.startswith("op") and n != "pipeline"}  # the optional operators have their own tests
    assert core - set(o) == {"quality_summary", "ensemble_forecast", "direction_forecast", "volume_forecast", "next_session_forecast",
                               "multi_horizon_forecast", "trained_hit_prob"}
    rows = E.entry(spark).collect()
    assert rows and all(0 <= r["technical_score"] <= 100 for r in rows)
