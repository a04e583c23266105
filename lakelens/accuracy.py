"""How well questions are bound to columns: own questions over the test lake with the tables and columns they mean."""

from __future__ import annotations

from lakelens.plans.engine import Engine

#: (question, data set, metric column, dimension column or null)
QUESTIONS = (
    ("average account balance of customers by market segment", "customer", "c_acctbal", "c_mktsegment"),
    ("total order price by order status", "orders", "o_totalprice", "o_orderstatus"),
    ("maximum order price by priority", "orders", "o_totalprice", "o_orderpriority"),
    ("average discount by return flag", "lineitem", "l_discount", "l_returnflag"),
    ("total quantity by line status", "lineitem", "l_quantity", "l_linestatus"),
    ("average tax per return flag", "lineitem", "l_tax", "l_returnflag"),
    ("average retail price by brand", "part", "p_retailprice", "p_brand"),
    ("maximum part size by part type", "part", "p_size", "p_type"),
    ("average value by event type", "events", "value", "event_type"),
    ("number of events by user", "events", "event_id", "user_id"),
    ("average balance of suppliers by nation key", "supplier", "s_acctbal", "s_nationkey"),
    ("total extended price by return flag", "lineitem", "l_extendedprice", "l_returnflag"),
    ("top 5 market segments by account balance", "customer", "c_acctbal", "c_mktsegment"),
    ("top 3 brands by retail price", "part", "p_retailprice", "p_brand"),
    ("lowest total price by order priority", "orders", "o_totalprice", "o_orderpriority"),
    ("average qty by returnflag", "lineitem", "l_quantity", "l_returnflag"),
    ("mean order total by status", "orders", "o_totalprice", "o_orderstatus"),
    ("minimum acctbal by mktsegment", "customer", "c_acctbal", "c_mktsegment"),
    ("average rebate by line status", "lineitem", "l_discount", "l_linestatus"),
    ("median retail price by type of part", "part", "p_retailprice", "p_type"),
    ("total value of events by kind of event", "events", "value", "event_type"),
    ("how many orders per customer", "orders", "o_orderkey", "o_custkey"),
    ("average price of line items by ship mode", "lineitem", "l_extendedprice", None),
    ("total sales by market segment of the customer", "orders", "o_totalprice", "c_mktsegment"),
    ("average supplier credit by nation", "supplier", "s_acctbal", "n_name"),
)


def measure(engine: Engine) -> dict[str, float]:
    """Shares of the questions whose data set, metric, dimension, and all of these, are the ones meant."""
    right = {"table": 0, "metric": 0, "dimension": 0, "binding": 0}
    for question, dataset, metric, dimension in QUESTIONS:
        binding, _, _ = engine.plan_for(engine.parse(question))
        ok = {
            "table": binding.dataset_id == dataset,
            "metric": metric in [b.column for b in binding.of("metric")[:1]],
            "dimension": dimension in ([b.column for b in binding.of("dimension")] or [None]),
        }
        for k, v in ok.items():
            right[k] += v
        right["binding"] += all(ok.values())
    return {k: round(v / len(QUESTIONS), 3) for k, v in right.items()}
