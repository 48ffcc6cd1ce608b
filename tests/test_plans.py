"""Plan shape checks: the scale properties the design relies on."""

from innkeep.plans.directory import HotelAnswers
from innkeep.registry import QUERIES, load_all

load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_directory_is_topk_then_broadcast_semi_joins(fx):
    df = HotelAnswers(fx).hotel_directory(1)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(fx):
    plan = _plan(fx.rooms().select("hotel_id", "room_number", "price_per_night"))
    # rooms come from part: only the columns the projection needs are read
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in plan


def test_filters_reach_the_scan(fx):
    plan = _plan(QUERIES["ingest_maintenance"](fx).select("request_seq")) + _plan(fx.maintenance())
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan


def test_aggregates_are_partial_before_shuffle(fx):
    plan = _plan(QUERIES["agg_review_summary"](fx))
    assert "partial_avg" in plan and "partial_count" in plan


def test_no_cartesian_products_anywhere(fx):
    for key in ["join_left_chain", "agg_nest_bookings", "audit_constraints", "validate_bookings", "sort_price_asc"]:
        plan = _plan(QUERIES[key](fx))
        assert "CartesianProduct" not in plan, key
        assert "BroadcastNestedLoopJoin" not in plan, key


def test_single_partition_exchanges_only_above_bounded_inputs(fx):
    """No unaggregated data goes through one task: every single-partition
    exchange sits on a partial aggregate or on global_rank's one-row-per-
    partition table."""
    import importlib.util
    import os
    spec = importlib.util.spec_from_file_location(
        "plan_audit", os.path.join(os.path.dirname(__file__), "..", "scripts", "plan_audit.py"))
    audit = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(audit)
    for key in ["hotel_directory", "hotel_admin_search", "booking_history", "sort_price_asc", "update_maintenance",
                "ingest_bookings", "audit_constraints", "agg_last_id", "validate_hotels"]:
        df = QUERIES[key](fx)
        df.write.format("noop").mode("overwrite").save()
        bad = [c for c, ok in audit.single_partition_inputs(df) if not ok]
        assert not bad, (key, bad)
