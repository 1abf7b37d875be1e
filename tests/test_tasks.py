"""Every task graph compiles and runs on tiny tables with its column names."""

import random
from datetime import datetime, timedelta

import pytest

from relpoint.plans.compiler import compile_graph
from relpoint.plans.site_history import site_frames
from relpoint.plans.tasks import TASKS, task_cutoffs, task_frame, task_graph, task_labels

START = datetime(2020, 1, 1)
CUTS = [START + timedelta(days=40), START + timedelta(days=60)]

# Extra columns beyond keys and clocks, by table: name -> type.
EXTRA = {
    "event_attendees": "status string",
    "results": "statusId int, position double",
    "qualifying": "position int",
    "standings": "points double",
    "review": "product_id bigint, rating double, verified boolean, summary string",
    "VisitStream": "is_click int",
    "transactions": "price double, sales_channel_id int",
    "SearchStream": "IsClick int, Position int",
    "AdsInfo": "Price double",
    "posts": "PostTypeId int, Tags string",
    "votes": "VoteTypeId int",
    "outcome_analyses": "outcome_id bigint, p_value double, p_value_modifier string",
    "outcomes": "outcome_type string",
    "reported_event_totals": "event_type string, subjects_affected int, subjects_at_risk int",
    "drop_withdrawals": "count int",
    "studies": "enrollment int, number_of_arms int, number_of_groups int, study_type string, phase string, "
    "enrollment_type string, source_class string, plan_to_share_ipd string, has_dmc boolean, "
    "is_fda_regulated_drug boolean, is_fda_regulated_device boolean, is_unapproved_device boolean, "
    "is_ppsd boolean, is_us_export boolean, fdaaa801_violation boolean",
    "designs": "allocation string, intervention_model string, observational_model string, primary_purpose string, "
    "time_perspective string, masking string, subject_masked boolean, caregiver_masked boolean, "
    "investigator_masked boolean, outcomes_assessor_masked boolean",
    "eligibilities": "sampling_method string, gender string, minimum_age string, maximum_age string, "
    "healthy_volunteers string, gender_based boolean, adult boolean, child boolean, older_adult boolean",
    "interventions": "mesh_term string",
    "conditions": "mesh_term string",
    "sponsors": "name string, agency_class string",
    "sponsors_studies": "lead_or_collaborator string",
    "facilities": "city string, country string",
    "site_history": "study_count bigint, latest_phase string",
}


def tiny_tables(spark, task, rows=30, seed=2):
    rng = random.Random(seed)
    columns = {}
    for node in task.nodes:
        table = columns.setdefault(node.table, {})
        table.setdefault(node.pk, "bigint")
        if node.time:
            table[node.time] = "timestamp_ntz"
        for key in node.options.get("context_keys", ()):
            table.setdefault(key, "bigint")
    prefix = {n.prefix: n for n in task.nodes}
    for parent, pk, child, ck, _ in task.edges:
        columns[prefix[parent].table].setdefault(pk, "bigint")
        columns[prefix[child].table].setdefault(ck, "bigint")
    looked_up = {prefix[c].table for _, _, c, _, reduce in task.edges if not reduce} | {task.nodes[0].table}
    tables = {}
    for name, found in columns.items():
        for item in filter(None, EXTRA.get(name, "").split(", ")):
            column, kind = item.split(" ")
            found.setdefault(column, kind)
        own = next(n.pk for n in task.nodes if n.table == name)
        data = []
        for i in range(8 if name in looked_up else rows):
            row = []
            for column, kind in found.items():
                if column == own and (name in looked_up or own.lower() == "id"):
                    row.append(i)
                elif kind == "timestamp_ntz":
                    row.append(START + timedelta(hours=rng.randrange(80 * 24)))
                elif kind == "string":
                    row.append(rng.choice(["yes", "no", "Primary", None]))
                elif kind == "boolean":
                    row.append(rng.choice([True, False, None]))
                elif kind == "double":
                    row.append(rng.choice([None, 0.01, 0.5, 3.0]))
                else:
                    row.append(rng.randrange(1 if column == "PostTypeId" else 0, 2 if column == "PostTypeId" else 8))
            data.append(tuple(row))
        tables[name] = spark.createDataFrame(data, ", ".join(f"`{c}` {t}" for c, t in found.items()))
    if task.label and task.label.fallback:
        # The price is the product's: reviews have none.
        prices = [(i, rng.choice([None, 0.5, 3.0, 12.25])) for i in range(7)]
        tables["product"] = spark.createDataFrame(prices, "product_id bigint, price double")
    return tables


def test_there_are_21_tasks():
    assert len(TASKS) == 21
    for name in ("stack_user_badge",):
        windows = [n.options["windows"] for n in TASKS[name].nodes]
        assert windows == [(7, 30, 90, 180, 365, 730, 1825, 3650)] * 9


def test_samplers():
    schedule = [START + timedelta(days=30 * i) for i in range(46)]
    sizes = {name: len(task_cutoffs(name, schedule)) for name in TASKS}
    assert sizes["stack_post_votes"] == 15 and sizes["f1_driver_top3"] == 6 and sizes["trial_site_success"] == 5
    assert sizes["hm_item_sales"] == 46


def windowed(name, columns):
    """Each node's windows show in the names of its columns."""
    for node in TASKS[name].nodes:
        for days in node.options.get("windows", ()):
            if node.prefix != TASKS[name].entity:
                assert any(c.startswith(f"{node.prefix.lower()}_") and f"_{days}d" in c for c in columns), (node.prefix, days)


@pytest.mark.parametrize("name", sorted(TASKS))
def test_task_runs(spark, name):
    tables = tiny_tables(spark, TASKS[name])
    df = task_frame(name, tables, CUTS, compile_graph(task_graph(name, tables, CUTS)))
    assert len(df.columns) == len(set(df.columns)) > 3
    windowed(name, df.columns)
    rows = df.collect()
    keys = [(r[0], r[1]) for r in rows]
    assert rows and len(keys) == len(set(keys)) and {c for c, _ in keys} <= set(CUTS)


@pytest.mark.parametrize("name", [n for n, t in TASKS.items() if t.label])
def test_labels(spark, name):
    task, tables = TASKS[name], tiny_tables(spark, TASKS[name], rows=400)
    label, horizon = task.label, timedelta(days=task.horizon_days)
    events = [r.asDict() for r in tables[label.table].collect()]
    got = {(r[0], r[1]): r["target"] for r in task_labels(name, tables, CUTS).collect()}
    expected = {}
    for c in CUTS:
        for key in {e[label.key] for e in events if e[label.key] is not None}:
            own = [e for e in events if e[label.key] == key]
            inside = [e for e in own if c < e[label.time] <= c + horizon]
            if task.active and not any(e[label.time] <= c for e in own):
                continue
            if label.kind == "churn":
                expected[c, key] = int(not inside)
            elif label.kind == "sum":
                price = {r["product_id"]: r["price"] or 0 for r in tables["product"].collect()}
                expected[c, key] = sum(price.get(e["product_id"], 0) for e in inside)
            else:
                hits = [e for e in inside if label.where is None or e["is_click"] == 1]
                if hits:
                    expected[c, key] = len({e[label.value] for e in hits} - {None})
    assert got == pytest.approx(expected) and expected


def test_own_price_comes_first(spark):
    at = CUTS[0] + timedelta(days=1)
    review = [(1, 1, CUTS[0], None), (1, 1, at, 2.5), (1, 2, at, None), (1, 3, at, None), (1, None, at, 4.0)]
    tables = {
        "review": spark.createDataFrame(review, "customer_id bigint, product_id bigint, review_time timestamp_ntz, price double"),
        "product": spark.createDataFrame([(1, 100.0), (2, 8.0)], "product_id bigint, price double"),
    }
    got = [(r[1], r["target"]) for r in task_labels("amazon_user_ltv", tables, CUTS[:1]).collect()]
    assert got == [(1, 2.5 + 8.0 + 0 + 4.0)]


def test_site_success_frames(spark):
    tables = {k: v for k, v in tiny_tables(spark, TASKS["trial_study_outcome"]).items()}
    rows = site_frames(tables, CUTS).collect()
    assert {r["cutoff"] for r in rows} == set(CUTS)
    assert any(r["hst_study_count"] for r in rows)
    assert all(r["hst_has_dmc_share"] is None or 0 <= r["hst_has_dmc_share"] <= 1 for r in rows)
