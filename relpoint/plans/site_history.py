"""Study history of a facility at one cutoff: bridges, latest records, bounded star."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relpoint.functions.scalars import day_difference, differs_or_null, indicator, ratio
from relpoint.functions.timegrid import timestamp_literal
from relpoint.operators.history import collapse_bridge, latest_record, latest_value, star
from relpoint.operators.labels import before
from relpoint.plans.tasks import task_frame

# Study, design and eligibility columns of the history.
STUDY_NUMBERS = ("enrollment", "number_of_arms", "number_of_groups")
STUDY_TEXT = ("study_type", "phase", "enrollment_type", "source_class", "plan_to_share_ipd")
STUDY_FLAGS = (
    "has_dmc", "is_fda_regulated_drug", "is_fda_regulated_device", "is_unapproved_device", "is_ppsd",
    "is_us_export", "fdaaa801_violation",
)
DESIGN_TEXT = (
    "allocation", "intervention_model", "observational_model", "primary_purpose", "time_perspective", "masking",
)
DESIGN_FLAGS = ("subject_masked", "caregiver_masked", "investigator_masked", "outcomes_assessor_masked")
ELIGIBILITY_TEXT = ("sampling_method", "gender", "minimum_age", "maximum_age", "healthy_volunteers")
ELIGIBILITY_FLAGS = ("gender_based", "adult", "child", "older_adult")


def study_history(tables: Mapping[str, DataFrame], cutoff: datetime) -> DataFrame:
    """One row per visible facility/study relation with study-grain summaries."""

    def seen(table: str) -> DataFrame:
        return before(tables[table], "date", cutoff, inclusive=True)

    def bridge(table: str, key: str, count: str, modes: dict) -> DataFrame:
        dimension = tables[table].withColumnRenamed(key, "__pk")
        return collapse_bridge(seen(f"{table}_studies"), dimension, "nct_id", key, "__pk", {count: F.col(key)}, modes)

    analyses, outcomes = seen("outcome_analyses"), tables["outcomes"]
    primary = outcomes.where("outcome_type = 'Primary'").select(F.col("id").alias("outcome_id"))
    tested = analyses.join(primary, "outcome_id").where(
        differs_or_null(F.col("p_value_modifier"), ">") & F.col("p_value").between(0, 1)
    )
    per_date = tested.groupBy("nct_id", "date").agg(F.min(indicator(F.col("p_value") < 0.05)).alias("success"))
    summaries = [
        latest_record(seen("designs"), "nct_id", "date", "id", (*DESIGN_TEXT, *DESIGN_FLAGS)).drop("date", "id"),
        latest_record(seen("eligibilities"), "nct_id", "date", "id", (*ELIGIBILITY_TEXT, *ELIGIBILITY_FLAGS)).drop(
            "date", "id"
        ),
        bridge("interventions", "intervention_id", "intervention_count", {"intervention_mesh": F.col("mesh_term")}),
        bridge("conditions", "condition_id", "condition_count", {"condition_mesh": F.col("mesh_term")}),
        bridge(
            "sponsors",
            "sponsor_id",
            "sponsor_count",
            {
                "sponsor_name": F.col("name"),
                "sponsor_class": F.col("agency_class"),
                "sponsor_role": F.col("lead_or_collaborator"),
            },
        ),
        per_date.groupBy("nct_id").agg(
            F.count(F.lit(1)).alias("dated_outcomes"), F.avg("success").alias("success_share")
        ),
        seen("reported_event_totals").groupBy("nct_id").agg(
            F.count(F.lit(1)).alias("reported_event_count"),
            F.sum("subjects_affected").alias("subjects_affected"),
            F.sum("subjects_at_risk").alias("subjects_at_risk"),
        ),
    ]
    studies = before(tables["studies"], "start_date", cutoff, inclusive=True).select(
        "nct_id", *STUDY_NUMBERS, *STUDY_TEXT, *STUDY_FLAGS
    )
    relation = seen("facilities_studies").select("id", "nct_id", "facility_id", "date")
    return star(relation, studies, "nct_id", summaries)


def site_history(tables: Mapping[str, DataFrame], cutoff: datetime) -> DataFrame:
    """Facility grain: volumes, shares, latest values and the weighted success rate."""
    rows = study_history(tables, cutoff)
    order = (F.col("date"), F.col("id"))
    hi = timestamp_literal(cutoff + timedelta(days=1), rows.schema["date"].dataType)
    aggs = [F.countDistinct("nct_id").alias("study_count")]
    for c in STUDY_NUMBERS:
        aggs += [F.avg(c).alias(f"{c}_avg"), F.max(c).alias(f"{c}_max")]
    texts = (*STUDY_TEXT, *DESIGN_TEXT, *ELIGIBILITY_TEXT)
    texts += ("intervention_mesh", "condition_mesh", "sponsor_name", "sponsor_class", "sponsor_role")
    aggs += [latest_value(F.col(c), *order).alias(f"{c}_latest") for c in texts]
    for c in (*STUDY_FLAGS, *DESIGN_FLAGS, *ELIGIBILITY_FLAGS):
        aggs.append(F.avg(indicator(F.col(c))).alias(f"{c}_share"))
    sums = ("intervention_count", "condition_count", "sponsor_count", "dated_outcomes")
    aggs += [F.sum(c).alias(c) for c in (*sums, "reported_event_count", "subjects_affected", "subjects_at_risk")]
    weighted = F.sum(F.col("success_share") * F.col("dated_outcomes"))
    aggs.append(ratio(weighted, F.sum("dated_outcomes")).alias("success_share"))
    aggs.append(day_difference(hi, F.max("date")).alias("age_days"))
    return rows.groupBy("facility_id").agg(*aggs)


def site_frames(tables: Mapping[str, DataFrame], cutoffs: Sequence[datetime]) -> DataFrame:
    """Facility frames of a handful of cutoffs, one bounded history each."""
    parts = [
        task_frame("trial_site_success", {**tables, "site_history": site_history(tables, c)}, [c])
        for c in cutoffs
    ]
    return reduce(DataFrame.unionByName, parts)
