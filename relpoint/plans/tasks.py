"""The 21 prediction tasks as graphs over their public datasets.

A task names its entity, the relations below it and how each one is compressed, the
cutoffs it trains on and, where public code defines one, its label. ``task_graph``
binds a task to tables the caller has loaded (any case of column names);
``task_frame`` also applies the task's entity filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relpoint.operators.labels import Measure, active_by, label_table, window_measures
from relpoint.plans.compiler import FrozenPlan, frame
from relpoint.plans.cutoffs import even_sample, stratified_sample, stride_sample
from relpoint.sources.tables import pick_column, with_amount
from relpoint.spec import BASE_STATS, FAMILIES, CompressionGraph, Edge, Relation


@dataclass(frozen=True)
class Node:
    """A role: source table, prefix, key, clock, and compression options.

    A table without a key of its own names the key it is reduced by, and says so.
    """

    table: str
    prefix: str
    pk: str
    time: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)
    own_key: bool = True


@dataclass(frozen=True)
class Label:
    """Measure of a table's rows per entity in ``(cutoff, cutoff + horizon]``.

    ``kind`` is that of the measure, or ``churn``: 1 without any row. ``where`` is SQL over the table.
    ``fallback`` (table, key, amount) names where an amount is taken from if the row itself has none.
    """

    table: str
    key: str
    time: str
    kind: str
    value: str | None = None
    where: str | None = None
    fallback: tuple[str, str, str] | None = None


@dataclass(frozen=True)
class Task:
    """Edges are (parent prefix, parent key, child prefix, child key, reduce).

    ``sampler`` chooses training cutoffs from a schedule: stratified or even with a limit, or a stride.
    """

    nodes: tuple[Node, ...]
    edges: tuple[tuple[str, str, str, str, bool], ...]
    hops: int
    horizon_days: int | None
    inclusive: bool = True
    lookback_days: int | None = None
    active: tuple[tuple[str, str, str], ...] = ()
    sampler: tuple[str, int] | None = None
    label: Label | None = None

    @property
    def entity(self) -> str:
        return self.nodes[0].prefix


# Categories of every node: at most so many values of a column, if it hasn't more than the threshold.
CATEGORIES = {"stats": BASE_STATS, "top_k": 5, "cardinality_threshold": 50}

# Tables, keys, clocks, windows and limits of the tasks.
STACK_WINDOWS = (7, 30, 90, 180, 365, 730, 1825, 3650)
SHOP_WINDOWS = (1, 7, 30, 90, 365)
TRIAL_WINDOWS = (30, 90, 180, 365)
EVENT_WINDOWS = (7, 30, 90)
RACE_WINDOWS = (30, 90, 365)
AD_WINDOWS = (1, 4, 14)
AMAZON_HORIZON, AVITO_HORIZON, EVENT_HORIZON, HM_HORIZON = 91, 4, 7, 7
STACK_CUTOFFS, RACE_STRIDE, SITE_CUTOFFS = ("stratified", 15), ("stride", 10), ("even", 5)


def _amazon(entity: str, churn: bool) -> Task:
    nodes = {
        "customer": Node("customer", "cust", "customer_id"),
        "product": Node("product", "prod", "product_id"),
    }
    key = f"{entity}_id"
    review = Node("review", "rev", key, "review_time", {"columns": ("rating", "verified")}, own_key=False)
    edge = (nodes[entity].prefix, key, "rev", key, True)
    # A review is worth its own price, else that of its product.
    worth = {} if churn else {"value": "price", "fallback": ("product", "product_id", "price")}
    label = Label("review", key, "review_time", "churn" if churn else "sum", **worth)
    active = (("review", key, "review_time"),)
    return Task((nodes[entity], review), (edge,), 1, AMAZON_HORIZON, active=active, label=label)


def _avito_user(clicks: bool) -> Task:
    def ad(prefix: str) -> tuple[Node, ...]:
        return (
            Node("AdsInfo", prefix, "AdID"),
            Node("Category", f"{prefix}cat", "CategoryID"),
            Node("Location", f"{prefix}loc", "LocationID"),
        )

    def below(prefix: str) -> tuple[tuple[str, str, str, str, bool], ...]:
        return (
            (prefix, "CategoryID", f"{prefix}cat", "CategoryID", False),
            (prefix, "LocationID", f"{prefix}loc", "LocationID", False),
        )

    nodes = (
        Node("UserInfo", "usr", "UserID"),
        Node("VisitStream", "vis", "AdID", "ViewDate", own_key=False),
        Node("SearchInfo", "si", "SearchID", "SearchDate"),
        Node("SearchStream", "ss", "SearchID", "SearchDate", own_key=False),
        *ad("visad"),
        *ad("ssad"),
    )
    edges = (
        ("usr", "UserID", "vis", "UserID", True),
        ("usr", "UserID", "si", "UserID", True),
        ("vis", "AdID", "visad", "AdID", True),
        ("si", "SearchID", "ss", "SearchID", True),
        ("ss", "AdID", "ssad", "AdID", True),
        *below("visad"),
        *below("ssad"),
    )
    # A visit that led to a click has a flag ``is_click``; see the as-of flag for how to make one.
    label = Label("VisitStream", "UserID", "ViewDate", "nunique", "AdID", "is_click = 1" if clicks else None)
    return Task(nodes, edges, 3, AVITO_HORIZON, label=label)


def _avito_ad() -> Task:
    stream = {"families": FAMILIES, "windows": AD_WINDOWS, "columns": ("HistCTR", "ObjectType"), "top_k": 1}
    nodes = (
        Node("AdsInfo", "ad", "AdID"),
        Node("SearchStream", "ss", "SearchID", "SearchDate", stream, own_key=False),
        Node("Category", "cat", "CategoryID"),
        Node("Location", "loc", "LocationID"),
    )
    edges = (
        ("ad", "AdID", "ss", "AdID", True),
        ("ad", "CategoryID", "cat", "CategoryID", False),
        ("ad", "LocationID", "loc", "LocationID", False),
    )
    return Task(nodes, edges, 2, AVITO_HORIZON)


def _event(same_user: bool = False, rich_interest: bool = False) -> Task:
    wide = {"families": FAMILIES, "windows": EVENT_WINDOWS, "context_keys": ("event",)}
    attendees = {
        **wide,
        "columns": ("status",),
        "annotations": {"is_attending": "{status} IN ('yes', 'maybe')", "is_declined": "{status} = 'no'"},
    }
    interest = {**(wide if rich_interest else {}), "columns": ("invited", "interested", "not_interested")}
    nodes = [
        Node("users", "usr", "user_id", "joinedAt"),
        Node("event_attendees", "att", "event", "start_time", attendees, own_key=False),
        Node("event_interest", "int", "event", "timestamp", interest, own_key=False),
        Node("user_friends", "frd", "user", own_key=False),
        Node("events", "evt", "event_id", "start_time"),
        Node("events", "attevt", "event_id", "start_time"),
        Node("events", "intevt", "event_id", "start_time"),
    ]
    edges = [
        ("usr", "user_id", "att", "user_id", True),
        ("usr", "user_id", "int", "user", True),
        ("usr", "user_id", "frd", "user", True),
        ("usr", "user_id", "evt", "user_id", True),
        ("att", "event", "attevt", "event_id", False),
        ("int", "event", "intevt", "event_id", False),
    ]
    if same_user:
        nodes.append(Node("users", "attusr", "user_id", "joinedAt"))
        edges.append(("att", "user_id", "attusr", "user_id", False))
    return Task(tuple(nodes), tuple(edges), 3, EVENT_HORIZON)


def _f1(main: str, annotations: Mapping[str, str], horizon: int) -> Task:
    keys = ("raceId", "constructorId")
    rich = {"families": FAMILIES, "windows": RACE_WINDOWS, "context_keys": keys, "annotations": annotations}
    nodes = [
        Node("drivers", "drv", "driverId"),
        Node("results", "res", "resultId", "date", rich if main == "res" else {}),
        Node("standings", "std", "driverStandingsId", "date"),
    ]
    edges = [("drv", "driverId", "res", "driverId", True), ("drv", "driverId", "std", "driverId", True)]
    if main == "qua":
        nodes.append(Node("qualifying", "qua", "qualifyId", "date", rich))
        edges.append(("drv", "driverId", "qua", "driverId", True))
    for parent in dict.fromkeys(("res", main)):
        race, circuit, team = f"{parent}rac", f"{parent}cir", f"{parent}con"
        nodes += [
            Node("races", race, "raceId", "date"),
            Node("circuits", circuit, "circuitId"),
            Node("constructors", team, "constructorId"),
        ]
        edges += [
            (parent, "raceId", race, "raceId", False),
            (race, "circuitId", circuit, "circuitId", False),
            (parent, "constructorId", team, "constructorId", False),
        ]
    return Task(tuple(nodes), tuple(edges), 3, horizon, sampler=RACE_STRIDE)


def _hm_customer() -> Task:
    sales = {
        "families": ("base", "temporal"),
        "windows": SHOP_WINDOWS,
        "columns": ("price", "sales_channel_id"),
        "cardinality_threshold": 5,
        "top_k": 2,
    }
    nodes = (
        Node("customer", "cust", "customer_id"),
        Node("transactions", "txn", "customer_id", "t_dat", sales, own_key=False),
        Node("article", "art", "article_id", None, {"cardinality_threshold": 5, "top_k": 2}),
    )
    edges = (
        ("cust", "customer_id", "txn", "customer_id", True),
        ("txn", "article_id", "art", "article_id", True),
    )
    return Task(nodes, edges, 2, HM_HORIZON)


def _hm_article() -> Task:
    nodes = (
        Node("article", "art", "article_id"),
        Node("transactions", "txn", "article_id", "t_dat", own_key=False),
    )
    return Task(nodes, (("art", "article_id", "txn", "article_id", True),), 3, HM_HORIZON)


# Source columns of the question-and-answer site.
STACK_COLUMNS = {
    "users": ("Id", "DisplayName", "Location", "ProfileImageUrl", "WebsiteUrl", "AboutMe", "CreationDate"),
    "posts": ("Id", "OwnerUserId", "PostTypeId", "ParentId", "Title", "Tags", "Body", "CreationDate"),
    "badges": ("Id", "UserId", "Class", "Name", "Date"),
    "votes": ("Id", "PostId", "VoteTypeId", "UserId", "CreationDate"),
    "comments": ("Id", "PostId", "Text", "CreationDate", "UserId", "ContentLicense"),
    "postHistory": (
        "Id", "PostHistoryTypeId", "PostId", "RevisionGUID", "CreationDate", "UserId", "Text", "Comment",
        "ContentLicense",
    ),
    "postLinks": ("Id", "CreationDate", "PostId", "RelatedPostId", "LinkTypeId"),
}


def _stack_node(table: str, prefix: str, windows: bool = False, filters: tuple[str, ...] = ()) -> Node:
    time = "Date" if table == "badges" else "CreationDate"
    options = {"columns": STACK_COLUMNS[table], "filters": filters}
    if windows:
        options |= {"families": ("base", "temporal"), "windows": STACK_WINDOWS}
    return Node(table, prefix, "Id", time, options)


def _stack_badge() -> Task:
    nodes = (
        _stack_node("users", "user", True, ("{Id} is not null",)),
        _stack_node("posts", "post", True),
        _stack_node("badges", "bad", True),
        _stack_node("votes", "voteu", True),
        _stack_node("comments", "commu", True),
        _stack_node("postHistory", "ph", True),
        _stack_node("postLinks", "plink", True),
        _stack_node("votes", "votep", True),
        _stack_node("comments", "commp", True),
    )
    edges = (
        ("user", "Id", "post", "OwnerUserId", True),
        ("user", "Id", "voteu", "UserId", True),
        ("user", "Id", "commu", "UserId", True),
        ("user", "Id", "bad", "UserId", True),
        ("post", "Id", "ph", "PostId", True),
        ("post", "Id", "plink", "PostId", True),
        ("post", "Id", "votep", "PostId", True),
        ("post", "Id", "commp", "PostId", True),
    )
    return Task(nodes, edges, 4, None, inclusive=False, lookback_days=3650, sampler=STACK_CUTOFFS)


def _stack_engagement() -> Task:
    nodes = (
        _stack_node("users", "user", filters=("{Id} != -1",)),
        _stack_node("posts", "post"),
        _stack_node("votes", "vote"),
        _stack_node("comments", "comm"),
        _stack_node("votes", "pvote"),
        _stack_node("comments", "pcomm"),
        _stack_node("users", "pcu"),
        _stack_node("badges", "pcbad"),
    )
    edges = (
        ("user", "Id", "post", "OwnerUserId", True),
        ("user", "Id", "vote", "UserId", True),
        ("user", "Id", "comm", "UserId", True),
        ("post", "Id", "pvote", "PostId", True),
        ("post", "Id", "pcomm", "PostId", True),
        ("pcomm", "UserId", "pcu", "Id", True),
        ("pcu", "Id", "pcbad", "UserId", True),
    )
    active = (
        ("posts", "OwnerUserId", "CreationDate"),
        ("votes", "UserId", "CreationDate"),
        ("comments", "UserId", "CreationDate"),
    )
    settings = {"inclusive": False, "lookback_days": 3650, "active": active, "sampler": STACK_CUTOFFS}
    return Task(nodes, edges, 3, None, **settings)


def _stack_votes() -> Task:
    kept = ("{PostTypeId} = 1", "{OwnerUserId} is not null", "{OwnerUserId} != -1")
    nodes = (
        _stack_node("posts", "post", filters=kept),
        _stack_node("votes", "vote"),
        _stack_node("comments", "comm"),
        _stack_node("postHistory", "ph"),
        _stack_node("postLinks", "plink"),
        _stack_node("users", "user"),
        _stack_node("badges", "bad"),
    )
    edges = (
        ("post", "Id", "vote", "PostId", True),
        ("post", "Id", "comm", "PostId", True),
        ("post", "Id", "ph", "PostId", True),
        ("post", "Id", "plink", "PostId", True),
        ("post", "OwnerUserId", "user", "Id", True),
        ("user", "Id", "bad", "UserId", True),
    )
    return Task(nodes, edges, 4, None, inclusive=False, lookback_days=3650, sampler=STACK_CUTOFFS)


def _trial(rich: bool, horizon: int | None) -> Task:
    """``rich`` gives every dated relation all families; else only the two result tables."""
    wide = {"families": FAMILIES, "windows": TRIAL_WINDOWS}
    plain: dict = wide if rich else {}
    analyses = {
        **wide,
        "context_keys": ("nct_id", "outcome_id"),
        "annotations": {"is_significant": "{p_value} >= 0 AND {p_value} <= 0.05"},
    }
    totals = {
        **wide,
        "context_keys": ("nct_id",),
        "annotations": {"is_serious_or_death": "{event_type} IN ('serious', 'deaths')"},
    }
    dated = (
        ("outcomes", "out", plain),
        ("outcome_analyses", "oa", analyses),
        ("drop_withdrawals", "drw", plain),
        ("reported_event_totals", "evt", totals),
        ("designs", "dsg", plain),
        ("eligibilities", "eli", plain),
    )
    bridges = (
        ("interventions", "ist", "intv", "intervention_id"),
        ("conditions", "cst", "cond", "condition_id"),
        ("facilities", "fst", "fac", "facility_id"),
        ("sponsors", "sst", "spn", "sponsor_id"),
    )
    nodes = [Node("studies", "std", "nct_id", "start_date", {"filters": ("{nct_id} is not null",)})]
    edges = []
    for table, prefix, options in dated:
        nodes.append(Node(table, prefix, "id", "date", options))
        edges.append(("std", "nct_id", prefix, "nct_id", True))
    for table, prefix, dimension, key in bridges:
        nodes.append(Node(f"{table}_studies", prefix, "id", "date", plain))
        nodes.append(Node(table, dimension, key))
        edges.append(("std", "nct_id", prefix, "nct_id", True))
        edges.append((prefix, key, dimension, key, True))
    return Task(tuple(nodes), tuple(edges), 2, horizon)


def _site() -> Task:
    """Facility with its study history, see ``relpoint.plans.site_history``."""
    nodes = (
        Node("facilities", "fac", "facility_id", None, {"columns": ("city", "state", "zip", "country")}),
        Node("site_history", "hst", "facility_id"),
    )
    return Task(nodes, (("fac", "facility_id", "hst", "facility_id", False),), 2, None, sampler=SITE_CUTOFFS)


TASKS: dict[str, Task] = {
    "amazon_user_churn": _amazon("customer", True),
    "amazon_item_churn": _amazon("product", True),
    "amazon_user_ltv": _amazon("customer", False),
    "amazon_item_ltv": _amazon("product", False),
    "avito_user_visits": _avito_user(False),
    "avito_user_clicks": _avito_user(True),
    "avito_ad_ctr": _avito_ad(),
    "event_user_attendance": _event(same_user=True),
    "event_user_ignore": _event(rich_interest=True),
    "event_user_repeat": _event(rich_interest=True),
    "f1_driver_dnf": _f1("res", {"did_not_finish": "{statusId} != 1"}, 30),
    "f1_driver_top3": _f1("qua", {"is_top3": "{position} <= 3"}, 30),
    "f1_driver_position": _f1("res", {}, 60),
    "hm_user_churn": _hm_customer(),
    "hm_item_sales": _hm_article(),
    "stack_user_badge": _stack_badge(),
    "stack_user_engagement": _stack_engagement(),
    "stack_post_votes": _stack_votes(),
    "trial_study_outcome": _trial(True, 365),
    "trial_study_adverse": _trial(False, None),
    "trial_site_success": _site(),
}


def task_graph(
    name: str, tables: Mapping[str, DataFrame], cutoffs: Sequence[datetime], **overrides: object
) -> CompressionGraph:
    """Bind a task to loaded tables. ``overrides`` are fields of CompressionGraph."""
    task = TASKS[name]
    keys: dict[str, list[str]] = {n.prefix: [] for n in task.nodes}
    for parent, parent_key, child, child_key, _ in task.edges:
        keys[parent].append(parent_key)
        keys[child].append(child_key)
    relations, resolved = [], {}
    for node in task.nodes:
        df = tables[node.table]
        actual = {k: pick_column(df.columns, [k]) for k in (*keys[node.prefix], node.pk)}
        resolved |= {(node.prefix, k): v for k, v in actual.items()}
        options = {**CATEGORIES, "unique_pk": node.own_key, **node.options}
        if "columns" in options:
            found = (pick_column(df.columns, [c], required=False) for c in options["columns"])
            options["columns"] = tuple(c for c in found if c)
        if "context_keys" in options:
            options["context_keys"] = tuple(pick_column(df.columns, [c]) for c in options["context_keys"])
        time = None if node.time is None else pick_column(df.columns, [node.time])
        relations.append(Relation(node.prefix, df, actual[node.pk], node.prefix, time, **options))
    edges = tuple(
        Edge(parent, child, resolved[parent, pk], resolved[child, ck], reduce)
        for parent, pk, child, ck, reduce in task.edges
    )
    settings = {
        "inclusive": task.inclusive,
        "lookback_days": task.lookback_days,
        "hops_back": task.hops,
        **overrides,
    }
    return CompressionGraph(task.entity, tuple(relations), edges, tuple(cutoffs), **settings)


def task_cutoffs(name: str, schedule: Sequence[datetime]) -> list[datetime]:
    """Training cutoffs that the task takes from a whole schedule; all without a sampler."""
    sampler, cutoffs = TASKS[name].sampler, sorted(set(schedule))
    if sampler is None:
        return cutoffs
    kind, n = sampler
    return {"stratified": stratified_sample, "even": even_sample, "stride": stride_sample}[kind](cutoffs, n)


def task_labels(
    name: str, tables: Mapping[str, DataFrame], cutoffs: Sequence[datetime], keys: DataFrame | None = None
) -> DataFrame:
    """(cutoff, entity, target) of a task that has a label.

    ``keys`` (cutoff, entity) are the rows wanted: those active at the cutoff unless given, or those with
    an event in the window for a task without an activity filter.
    """
    task = TASKS[name]
    label = task.label
    if label is None:
        raise ValueError(f"{name}: its label is not defined in public code")
    events = tables[label.table]
    key, time = (pick_column(events.columns, [c]) for c in (label.key, label.time))
    if label.fallback is not None:
        events, value = _with_worth(events, label, tables)
    else:
        value = None if label.value is None else F.col(pick_column(events.columns, [label.value]))
    events = events if label.where is None else events.where(label.where)
    kind = "count" if label.kind == "churn" else label.kind
    horizon = timedelta(days=task.horizon_days)
    found = window_measures(events, key, time, cutoffs, horizon, [Measure("target", kind, value)])
    if keys is None:
        keys = _active_keys(task, tables, cutoffs)
    if keys is not None:
        entity = next(c for c in keys.columns if c != "cutoff")
        found = label_table(keys, entity, found, key, ["target"])
    if label.kind == "churn":
        found = found.withColumn("target", (F.col("target") == 0).cast("int"))
    return found


def _with_worth(events: DataFrame, label: Label, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, Column]:
    """Events with the amount that the label sums: their own, else that of the row they refer to, else 0."""
    table, key, amount = label.fallback
    dimension = tables[table]
    found = with_amount(
        events,
        dimension,
        pick_column(events.columns, [key]),
        pick_column(dimension.columns, [key]),
        "__worth",
        pick_column(events.columns, [label.value], required=False),
        pick_column(dimension.columns, [amount]),
    )
    return found, F.col("__worth")


def _active_keys(task: Task, tables: Mapping[str, DataFrame], cutoffs: Sequence[datetime]) -> DataFrame | None:
    if not task.active:
        return None
    sources = [
        (tables[t], pick_column(tables[t].columns, [k]), pick_column(tables[t].columns, [c]))
        for t, k, c in task.active
    ]
    return active_by(sources, cutoffs)


def task_frame(
    name: str,
    tables: Mapping[str, DataFrame],
    cutoffs: Sequence[datetime],
    frozen: FrozenPlan | None = None,
    keys: DataFrame | None = None,
    **overrides: object,
) -> DataFrame:
    """Feature frame of a task. Without keys, tasks with an activity filter keep active entities."""
    task, graph = TASKS[name], task_graph(name, tables, cutoffs, **overrides)
    if keys is None:
        keys = _active_keys(task, tables, graph.cutoffs)
    return frame(graph, frozen, keys)
