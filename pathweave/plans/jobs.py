"""Whole batch jobs: scan, link or enrich, write.

Every job takes the paths and dates it works on; windows, keys and orders are
the constants below.  Jobs return nothing but the table they write.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import values as v
from ..functions.clock import lag_columns
from ..operators import daily_state, encode, identity, paths, sequence, sessions
from ..operators import lookback as lb
from ..operators.dedup import keep_first
from ..operators.skew import skew_join
from ..sources import lookups, scan, sinks
from .session import configure

TOUCH_SIDE = lb.Side("event_ts", "event_dt", ("event_id",))
OUTCOME_SIDE = lb.Side("created_time", "created_dt", ("transaction_id", "item_id"))
SESSION_SIDE = lb.Side("sess_start_timestamp", "sess_session_start_dt", ("sess_guid", "sess_session_skey"))
REGISTRATION_SIDE = lb.Side("reg_user_cre_ts", "reg_user_cre_dt", ("reg_user_id",))

CHECKOUT_KEYS = (
    lb.Key("uid", "user_id", "buyer_id", "id"),
    lb.Key("did", "device_id", "cko_device_id", "device"),
    lb.Key("cguid", "cguid", "bbowa_cguid"),
    lb.Key("xid", "incdata_id", "cko_incdata_id"),
)
SESSION_KEYS = (
    lb.Key("uid", "user_id", "sess_parent_uid", "id"),
    lb.Key("did", "device_id", "sess_device_id", "device"),
    lb.Key("cguid", "cguid", "sess_cguid"),
    lb.Key("xid", "incdata_id", "sess_incdata_id"),
)
REGISTRATION_KEYS = (
    lb.Key("did", "device_id", "reg_device_id", "device"),
    lb.Key("cguid", "cguid", "reg_cguid"),
    lb.Key("xid", "incdata_id", "reg_incdata_id"),
)

DEVICE_ORDER = ("device_type_level1", "device_type_level2", "experience_level1", "experience_level2")
CLICK_ORDER = (*DEVICE_ORDER, "flex_column_1", "flex_column_3")


def order_of(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns of an ordering that ``df`` has, nulls first."""
    return [F.col(c).asc_nulls_first() for c in columns if c in df.columns]


def link_touches(
    touches: DataFrame, anchors: DataFrame, keys: Sequence[lb.Key], window: lb.Window, anchor: lb.Side
) -> DataFrame:
    """Link by ``keys``; of several copies of a touch the first by device and experience is kept."""
    return lb.link(touches, anchors, keys, window, TOUCH_SIDE, anchor, tie_break=order_of(touches, CLICK_ORDER))


def organic_touches(session_table: DataFrame) -> DataFrame:
    """Sessions that came from organic traffic, in the shape of touches."""
    organic = session_table.where(F.col("traffic_source_id").isin(*v.ORGANIC_TRAFFIC_SOURCES))
    session_id = F.concat(*[F.col(c).cast("string") for c in ("session_skey", "guid", "site_id", "cobrand")])

    def given(column: str, kind: str = "string") -> Column:
        return (F.col(column) if column in session_table.columns else F.lit(None)).cast(kind)

    def empty(kind: str = "string") -> Column:
        return F.lit(None).cast(kind)

    columns = {
        "guid": F.col("guid"),
        "cguid": F.col("cguid"),
        "user_id": F.col("parent_uid"),
        "event_id": session_id,
        "event_id_type": F.lit(5),
        "event_type_id": F.lit(v.ORGANIC_SESSION),
        "channel_id": F.lit(0),
        "channel_name": F.lit("organic"),
        "rotation_id": empty("bigint"),
        "rotation_name": empty(),
        "campaign_id": empty("bigint"),
        "campaign_name": empty(),
        "event_dt": F.col("session_start_dt"),
        "event_ts": F.col("start_timestamp"),
        "incdata_id": empty(),
        "cluster_id": empty(),
        "device_id": given("device_type"),
        "experience_level1": given("experience_level1"),
        "experience_level2": given("experience_level2"),
        "device_type_level1": F.col("device_type_level1"),
        "device_type_level2": F.col("device_type_level2"),
        "flex_column_1": given("lndg_page_id"),
        "flex_column_2": empty(),
        "flex_column_3": empty(),
        "flex_column_4": empty(),
        "flex_column_5": given("gr_cnt", "bigint"),
        "flex_column_6": given("vi_cnt", "bigint"),
        "data_source": F.lit("organic"),
        "dt": F.col("session_start_dt"),
    }
    return organic.select(*[column.alias(name) for name, column in columns.items()])


def export_organic_touches(spark: SparkSession, sessions_path: str, out: str, start: str, end: str) -> None:
    """Organic touches as text for a warehouse load, one directory per day, with a manifest."""
    days = scan.in_range(scan.scan(spark, sessions_path), start, end, "session_start_dt")
    sinks.write_days_tsv(organic_touches(days), out, null="\\N")


def backfill_organic_touches(spark: SparkSession, sessions_path: str, out: str, start: str, end: str) -> list[str]:
    """Export just the days of the range that ``out`` does not have, or not as its manifest says; returns them."""
    written = scan.partition_days(spark, out, "dt")
    if sinks.exists(spark, f"{sinks.manifest_path(out)}/dt=*") and not written.isEmpty():
        written = written.join(sinks.damaged_days(spark, out), "dt", "left_anti")
    missing = sorted(str(r["dt"]) for r in scan.missing_days(written, start, end, "dt").collect())
    if missing:
        table = scan.scan(spark, sessions_path)
        kind = table.schema["session_start_dt"].dataType  # the literals take the column's type, so that the filter reaches the files
        days = table.where(F.col("session_start_dt").isin(*[F.lit(day).cast("date").cast(kind) for day in missing]))
        sinks.write_days_tsv(organic_touches(days), out, null="\\N")
    return missing


def correlate_checkouts(
    spark: SparkSession,
    touches_path: str,
    checkouts_path: str,
    out: str,
    checkout_start: str,
    checkout_end: str,
    data_source: str,
    touch_start: str,
    touch_end: str | None = None,
) -> None:
    """Touches linked to the checkouts of some days."""
    configure(spark)
    checkouts = scan.in_range(scan.scan(spark, checkouts_path), checkout_start, checkout_end)
    renamed = {"device_id": "cko_device_id", "incdata_id": "cko_incdata_id", "incdata_dqscore": "cko_incdata_dqscore"}
    checkouts = checkouts.drop("dt").withColumnsRenamed(renamed)
    touches = scan.in_range(scan.scan(spark, touches_path), touch_start, touch_end or checkout_end)
    touches = touches.where(F.col("data_source") == data_source) if "data_source" in touches.columns else touches
    touches = touches.drop("dt", "data_source")
    linked = link_touches(touches, checkouts, CHECKOUT_KEYS, lb.CHECKOUT, OUTCOME_SIDE).withColumns(
        {
            "event_id": F.col("event_id").cast("string"),
            **lag_columns("bbowa_event_timestamp", "event_ts", "bbowa", "is_before_bbowa"),
            **lag_columns("created_time", "event_ts", "cko", "is_before_checkout"),
            "data_source": F.lit(data_source),
            "ck_dt": F.col("created_dt"),
            "mktng_dt": F.col("event_dt"),
        }
    )
    sinks.write_partitioned(linked, out, ["data_source", "ck_dt", "mktng_dt"])


def correlate_intents(
    spark: SparkSession, touches_path: str, checkouts_path: str, out: str, checkout_start: str, checkout_end: str
) -> None:
    """Touches linked to the purchase intents behind the checkouts of some days."""
    configure(spark)
    checkouts = scan.in_range(scan.scan(spark, checkouts_path), checkout_start, checkout_end).drop("dt")
    checkouts = checkouts.withColumnsRenamed({"device_id": "cko_device_id", "incdata_id": "cko_incdata_id"})
    checkouts = checkouts.withColumn("bbowa_dt", F.to_date("bbowa_event_timestamp"))
    first = scan.day_offset(checkout_start, -40)
    touches = scan.in_range(scan.scan(spark, touches_path), first, F.lit(checkout_end)).drop("dt")
    intent = lb.Side("bbowa_event_timestamp", "bbowa_dt", ("transaction_id", "item_id", "created_dt"))
    linked = link_touches(touches, checkouts, CHECKOUT_KEYS, lb.INTENT, intent).withColumns(
        {
            **lag_columns("bbowa_event_timestamp", "event_ts", "bbowa"),
            "ck_dt": F.col("created_dt"),
            "mktng_dt": F.col("event_dt"),
        }
    )
    sinks.write_partitioned(linked.drop("bbowa_dt"), out, ["ck_dt", "mktng_dt"])


def correlate_registrations(
    spark: SparkSession,
    touches_path: str,
    registrations_path: str,
    out: str,
    start: str,
    end: str,
    touch_start: str,
) -> None:
    """Touches linked to the registrations of some days, one row per touch and new user."""
    configure(spark)
    users = scan.in_range(scan.scan(spark, registrations_path), start, end).drop("dt")
    touches = scan.in_range(scan.scan(spark, touches_path), touch_start, end).drop("dt")
    order = [F.col("device_id").desc(), *order_of(touches, ("experience_level2", "flex_column_3", "flex_column_1"))]
    linked = lb.link(
        touches, labels.prefixed(users, "reg_"), REGISTRATION_KEYS, lb.REGISTRATION, TOUCH_SIDE, REGISTRATION_SIDE,
        tie_break=order,
    ).withColumns(
        {
            **lag_columns("reg_user_cre_ts", "event_ts", "reg"),
            "reg_dt": F.col("reg_user_cre_dt"),
            "mktng_dt": F.col("event_dt"),
        }
    )
    sinks.write_partitioned(linked, out, ["reg_dt", "mktng_dt"])


def correlate_sessions(
    spark: SparkSession,
    touches_path: str,
    sessions_path: str,
    out: str,
    start: str,
    end: str,
    touch_start: str,
    cohort: str,
    keys: Sequence[str] = ("uid", "did", "cguid", "xid"),
    cookie_map_path: str | None = None,
    device_map_path: str | None = None,
    fraction: float | None = None,
    seed: int = 0,
    intents: DataFrame | None = None,
) -> None:
    """Clicks linked to the sessions of a cohort.

    ``cohort`` is one of ``first``, ``nonfirst``, ``unsigned``, ``anonymous``
    (which needs the two identity maps) or ``all``.  ``fraction`` samples the
    sessions.  ``intents`` adds the user's intent counts to each row.
    """
    configure(spark)
    days = scan.in_range(scan.scan(spark, sessions_path), start, end).drop("dt")
    if cohort == "anonymous":
        if cookie_map_path is None or device_map_path is None:
            raise ValueError("the anonymous cohort needs both identity maps")
        chosen = identity.anonymous(
            days, scan.scan(spark, cookie_map_path), scan.scan(spark, device_map_path), sessions.SESSION_KEYS
        )
    elif cohort == "all":
        chosen = days
    else:
        chosen = sessions.cohort(days, cohort)
    if fraction is not None:
        chosen = scan.bernoulli_sample(chosen, fraction, seed, sessions.SESSION_KEYS)
    touches = scan.in_range(scan.scan(spark, touches_path), touch_start, end).drop("dt")
    clicks = touches.where(F.col("event_type_id").isin(*v.SESSION_CLICKS))
    used = [k for k in SESSION_KEYS if k.name in keys]
    linked = link_touches(clicks, labels.prefixed(chosen, "sess_"), used, lb.SESSION, SESSION_SIDE).withColumns(
        {
            **{c.removeprefix("_"): e for c, e in lag_columns("sess_start_timestamp", "event_ts", "").items()},
            "session_type": F.lit(cohort),
            "sess_dt": F.col("sess_session_start_dt"),
            "mktng_dt": F.col("event_dt"),
        }
    )
    if intents is not None:
        counts = sessions.conditional_counts(
            intents.where(F.col("user_id") > 0), ["user_id"], sessions.intent_conditions(), total="num_bbowa"
        ).withColumnRenamed("user_id", "bbowa_user")
        linked = skew_join(linked, counts, [("sess_parent_uid", "bbowa_user")], how="left", spread_by=["event_id"])
    sinks.write_partitioned(linked, out, ["session_type", "sess_dt", "mktng_dt"])


def dedupe_clicks(spark: SparkSession, linked_path: str, out: str, start: str, end: str) -> None:
    """One row per click and checkout."""
    configure(spark)
    clicks = scan.in_range(scan.scan(spark, linked_path), start, end, "ck_dt").where(
        F.col("event_type_id").isin(*v.SESSION_CLICKS)
    )
    order = [*order_of(clicks, CLICK_ORDER), F.col("event_ts")]
    sinks.write_partitioned(keep_first(clicks, ["event_id", "item_id", "transaction_id"], order), out, ["ck_dt"])


def update_dashboard_state(spark: SparkSession, linked_path: str, state_path: str, start: str, end: str) -> None:
    """Summarise the outcomes of some days for the dashboard tables; days that the state has are replaced."""
    configure(spark)
    linked = scan.in_range(scan.scan(spark, linked_path), start, end, "ck_dt")
    clicks = linked.where(F.col("event_type_id").isin(*v.DASHBOARD_CLICKS)).withColumns(
        {"channel_name": F.coalesce("channel_name", F.lit("Unassigned")), "day_diff": F.datediff("ck_dt", "mktng_dt")}
    )
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("ck_dt"))
    daily_state.replace_days(daily_state.day_summary(clicks, days, "ck_dt", "channel_name"), state_path, "ck_dt")


def score_specificity(spark: SparkSession, items_path: str, out: str, start: str, end: str) -> None:
    """Category breadth and specificity of each session."""
    configure(spark)
    items = scan.in_range(scan.scan(spark, items_path), start, end)
    sinks.write_partitioned(sessions.with_specificity(sessions.category_breadth(items)), out, ["dt"])


def session_features(
    spark: SparkSession,
    sessions_path: str,
    checkouts_path: str,
    intents_path: str,
    specificity_path: str,
    items_path: str,
    registrations_path: str,
    out: str,
    start: str,
    end: str,
) -> None:
    """Sessions with checkout totals, intents, specificity, registrations and item counts."""
    configure(spark)
    key, key_cobrand = list(sessions.SESSION_KEYS), list(sessions.SESSION_KEYS_COBRAND)
    in_days = scan.in_range(scan.scan(spark, sessions_path), start, end)
    checkouts = scan.in_range(scan.scan(spark, checkouts_path), start, scan.day_offset(end, 2))
    checkouts = checkouts.withColumnsRenamed({f"sess_{c}": c for c in key_cobrand})
    intents = scan.in_range(scan.scan(spark, intents_path), start, scan.day_offset(end, 1))
    specificity = scan.in_range(scan.scan(spark, specificity_path), start, end).drop("dt")
    items = scan.in_range(scan.scan(spark, items_path), start, end)
    users = scan.in_range(scan.scan(spark, registrations_path), start, end)
    rich = sessions.enrich(
        keep_first(in_days, key_cobrand, [*order_of(in_days, DEVICE_ORDER), F.col("start_timestamp")]),
        [
            (sessions.checkout_totals(checkouts), key_cobrand),
            (
                sessions.conditional_counts(intents, key_cobrand, sessions.intent_conditions(), total="num_bbowa"),
                key_cobrand,
            ),
            (specificity, key),
            (sessions.registration_counts(users), key),
            (sessions.conditional_counts(items, key, sessions.vertical_conditions()), key),
        ],
    )
    sinks.write_partitioned(rich, out, ["dt"])


def resolve_sessions(
    spark: SparkSession,
    sessions_path: str,
    out: str,
    start: str,
    end: str,
    user_map: str | None = None,
    device_map: str | None = None,
    cookie_map: str | None = None,
) -> None:
    """Sessions with their person ids, by whichever maps are given (strongest first)."""
    configure(spark)
    rows = scan.in_range(scan.scan(spark, sessions_path), start, end)
    maps = [
        identity.IdentityMap(name, column, kind, scan.scan(spark, path), key)
        for name, column, kind, path, key in (
            ("uid", "parent_uid", "id", user_map, "incdata_srcid"),
            ("did", "device_id", "device", device_map, "ident_attr_value_txt"),
            ("cguid", "cguid", "text", cookie_map, "ident_attr_value_txt"),
        )
        if path is not None
    ]
    key = [*sessions.SESSION_KEYS_COBRAND]
    found = identity.resolve_identity(rows, maps, key)
    once = keep_first(found, [*key, "incdata_id"], [*order_of(found, DEVICE_ORDER), F.col("start_timestamp")])
    sinks.write_partitioned(once, out, ["dt"])


def resolve_items(
    spark: SparkSession, items_path: str, out: str, start: str, end: str, user_map: str, cookie_map: str
) -> None:
    """Viewed items with a person id where one is known."""
    configure(spark)
    rows = scan.in_range(scan.scan(spark, items_path), start, end)
    key = ["guid", "session_skey", "item_id", "seqnum"]
    maps = [
        identity.IdentityMap("uid", "user_id", "id", scan.scan(spark, user_map), "incdata_srcid"),
        identity.IdentityMap("cguid", "cguid", "text", scan.scan(spark, cookie_map), "ident_attr_value_txt"),
    ]
    found = identity.resolve_identity(rows, maps, key, unresolved=None)
    once = keep_first(found, key, [*order_of(found, DEVICE_ORDER), F.col("incdata_id")])
    sinks.write_partitioned(once, out, ["dt"])


def items_before_sessions(
    spark: SparkSession, items_path: str, sessions_path: str, out: str, start: str, end: str, item_start: str
) -> None:
    """Items a visitor viewed in the two weeks before each session."""
    configure(spark)
    items = scan.in_range(scan.scan(spark, items_path), item_start, end).drop("dt")
    anchors = labels.prefixed(scan.in_range(scan.scan(spark, sessions_path), start, end).drop("dt"), "sess_")
    keys = (lb.Key("uid", "user_id", "sess_parent_uid", "id"), lb.Key("cguid", "cguid", "sess_cguid"))
    view = lb.Side("event_timestamp", "session_start_dt", ("item_id", "event_timestamp"))
    linked = lb.link(items, anchors, keys, lb.ITEM_VIEW, view, SESSION_SIDE, tie_break=[F.col("seqnum")])
    sinks.write_partitioned(linked.withColumn("sess_dt", F.col("sess_session_start_dt")), out, ["sess_dt"])


def valid_matches(linked: DataFrame) -> DataFrame:
    """Links to a complete outcome, impressions left out."""
    complete = F.col("transaction_id").isNotNull() & F.col("item_id").isNotNull()
    return linked.where(complete & (F.col("event_type_id") != v.IMPRESSION))


def count_pairs(spark: SparkSession, linked_path: str, out: str, ordered: bool) -> None:
    """Co-occurring channels per path length as text, one line per length."""
    configure(spark)
    touches = paths.path_touches(scan.scan(spark, linked_path))
    pairs = paths.ordered_pairs(touches) if ordered else paths.unordered_pairs(touches)
    sinks.write_tsv(paths.serialise_pairs(pairs), out)


def encode_channels(spark: SparkSession, linked_path: str, encoder_out: str, out: str, checkout_day: str | None = None) -> None:
    """Channel bitmask of each checkout and the encoder it uses."""
    configure(spark)
    linked = scan.scan(spark, linked_path, basePath=linked_path)
    if checkout_day is not None:
        linked = linked.where(F.col("ck_dt") == checkout_day)
    named = labels.with_defaults(linked.select(*paths.OUTCOME, "channel_name"), {"channel_name": "Unassigned"})
    rows = named.distinct()
    encoder = store_encoder(encode.mask_encoder(rows, "channel_name"), encoder_out)
    masks = encode.channel_masks(rows, encoder, "channel_name")
    # one number up to 63 channels, then one per 63 with commas between
    sinks.write_tsv(masks.withColumn("channel_mask", F.array_join(F.col("mask_words").cast("array<string>"), ",")).drop("mask_words"), out)


def encode_tokens(
    spark: SparkSession, linked_path: str, encoder_out: str, out: str, intent: str | None = None
) -> None:
    """0/1 string of channel#event#device tokens of each checkout.

    ``intent`` keeps only touches ``before`` or ``after`` the purchase intent.
    """
    configure(spark)
    linked = by_intent(scan.scan(spark, linked_path), intent)
    rows = linked.select(*paths.OUTCOME, labels.channel_token().alias("token")).distinct()
    encoder = store_encoder(encode.frequency_encoder(rows, "token"), encoder_out)
    sinks.write_tsv(encode.presence_strings(rows, encoder, "token"), out)


def by_intent(linked: DataFrame, intent: str | None) -> DataFrame:
    """Touches before or after the purchase intent, or all of them."""
    rules = {None: F.lit(True), "before": F.col("bbowa_sec_diff") > 0, "after": F.col("bbowa_sec_diff") <= 0}
    if intent not in rules:
        raise ValueError(f"unknown part of a path {intent!r}; use 'before', 'after' or None")
    return linked.where(rules[intent])


def store_encoder(encoder: DataFrame, path: str) -> DataFrame:
    """Write an encoder as text and go on from a stored copy, so that every use ranks alike."""
    kept = sinks.stage(encoder, path.rstrip("/") + "_parquet")
    sinks.write_tsv(kept, path)
    return kept


CURRENT = ("event_type", "event_device", "channel_name", "sub_channel")
TRANSACTION = ("fm_buyer_type_desc", "is_first_purchase", "bbowa_device")


def path_steps(linked: DataFrame, big_rocks: DataFrame) -> DataFrame:
    """Valid links with the labels used in transition graphs."""
    named = lookups.with_lookup(valid_matches(linked), big_rocks, "rotation_id")
    return named.select(
        *paths.OUTCOME,
        F.coalesce("fm_buyer_type_desc", F.lit("unknown")).alias("fm_buyer_type_desc"),
        F.coalesce("is_first_purchase", F.lit(0)).alias("is_first_purchase"),
        labels.outcome_device().alias("bbowa_device"),
        "event_ts",
        "event_id",
        labels.event_label(style="no_impression").alias("event_type"),
        F.coalesce("device_type_level1", F.lit("unassigned")).alias("event_device"),
        F.coalesce("channel_name", F.lit("unassigned")).alias("channel_name"),
        labels.sub_channel().alias("sub_channel"),
    )


def transition_edges(spark: SparkSession, linked_path: str, big_rocks_path: str, steps_out: str, out: str) -> None:
    """Weighted transitions between consecutive touches; the labelled touches are kept in ``steps_out``."""
    configure(spark)
    rows = path_steps(scan.scan(spark, linked_path), lookups.read_tsv_lookup(spark, big_rocks_path))
    rows = sinks.stage(rows, steps_out)
    steps = sequence.with_neighbours(rows, CURRENT)
    sinks.write_parquet(sequence.weighted_edges(steps, TRANSACTION, CURRENT), out)


def event_lists(spark: SparkSession, linked_path: str, big_rocks_path: str, out: str, paid_only: bool = False) -> None:
    """Chronological events of each checkout with their neighbours, one row each; paths of any length."""
    configure(spark)
    rows = path_steps(scan.scan(spark, linked_path), lookups.read_tsv_lookup(spark, big_rocks_path))
    if paid_only:
        rows = rows.where(~F.col("channel_name").isin(*v.ORGANIC_CHANNELS))
    sinks.write_parquet(
        sequence.chrono_steps(rows, ("channel_name", "sub_channel"), attributes=TRANSACTION), out
    )


def mobile_only(spark: SparkSession, linked_path: str, out: str) -> None:
    """Links of checkouts that were reached from mobile devices alone."""
    configure(spark)
    sinks.write_parquet(paths.exact_device_outcomes(valid_matches(scan.scan(spark, linked_path))), out)


def match_followers(listings: DataFrame, followers: DataFrame) -> DataFrame:
    """Listings of a seller and category with everybody following both."""
    return skew_join(
        listings, followers, [("slr_id", "flwd_user_id"), ("elig_leaf_categ_id", "leaf_categ_id")]
    )
