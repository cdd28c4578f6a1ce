"""Volumes, shares and look-back curves."""

from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import curves, daily_state, sets
from ..sources.sinks import scratch, stage
from . import bindings as b
from .link_queries import merged, merged_sql
from .registry import query, with_views


def _dashboard_clicks(df):
    return df.where(F.col("event_type_id").isin(*v.DASHBOARD_CLICKS))


@query(
    "daily_volume",
    with_views("SELECT event_dt, channel_id, channel_name, count(*) AS no_events FROM touch GROUP BY ALL", "touch"),
)
def daily_volume(spark, sf):
    return curves.volume(b.touches(spark, sf), ["event_dt", "channel_id", "channel_name"]).orderBy("event_dt", F.desc("no_events"))


_SHARE = "SELECT event_dt, channel_name, count(*) AS no_events, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY event_dt), 6) AS prop FROM touch {} GROUP BY event_dt, channel_name"


@query("daily_share", with_views(_SHARE.format(""), "touch"))
def daily_share(spark, sf):
    return curves.daily_share(b.touches(spark, sf)).withColumn("prop", F.round("prop", 6))


@query("daily_share_known", with_views(_SHARE.format("WHERE channel_name IS NOT NULL"), "touch"))
def daily_share_known(spark, sf):
    return curves.daily_share(b.touches(spark, sf), drop_missing=True).withColumn("prop", F.round("prop", 6))


@query("daily_by_strategy", merged_sql("SELECT event_dt, join_strategy, count(*) AS no_events FROM merged GROUP BY ALL"))
def daily_by_strategy(spark, sf):
    return curves.volume(merged(spark, sf), ["event_dt", "join_strategy"])


@query(
    "unassigned_share",
    with_views(
        "SELECT event_dt, round(count(*) FILTER (channel_id IS NULL) / count(*)::DOUBLE, 6) AS prop FROM touch GROUP BY event_dt", "touch"
    ),
)
def unassigned_share(spark, sf):
    return curves.missing_share(b.touches(spark, sf)).withColumn("prop", F.round("prop", 6))


@query(
    "relative_importance",
    merged_sql(
        """SELECT t.event_dt, t.channel_name, round(t.p, 6) AS prop_evts_txns, round(w.p, 6) AS prop_evts, round(t.p / w.p, 6) AS ratio FROM
           (SELECT event_dt, channel_name, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY event_dt) AS p FROM merged
            WHERE created_dt = DATE '2024-01-20' GROUP BY event_dt, channel_name) t
           LEFT JOIN (SELECT event_dt, channel_name, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY event_dt) AS p FROM touch GROUP BY event_dt, channel_name) w
           ON t.event_dt = w.event_dt AND t.channel_name IS NOT DISTINCT FROM w.channel_name"""
    ),
)
def relative_importance(spark, sf):
    tied = merged(spark, sf).where(F.col("created_dt") == F.lit("2024-01-20").cast("date"))
    table = curves.relative_importance(tied, b.touches(spark, sf))
    return table.withColumns({c: F.round(c, 6) for c in ("prop_evts_txns", "prop_evts", "ratio")})


_LAGS = {
    "cnts": "SELECT channel_name, day_diff, count(*) AS cnt FROM merged WHERE event_type_id IN (1,5,7) GROUP BY ALL",
}


def _lag_counts(spark, sf):
    return curves.lag_counts(_dashboard_clicks(merged(spark, sf)), ["channel_name"], F.col("day_diff"))


_CURVE = """SELECT coalesce(channel_name, 'isNA') AS channel_name, day_diff, cnt, {p} AS prcnt,
    CAST(sum(cnt) OVER w AS BIGINT) AS cumm_cnt, {c} AS cumm_prcnt
    FROM (SELECT *, cnt * 100.0::DOUBLE / sum(cnt) OVER (PARTITION BY channel_name) AS raw FROM cnts)
    WINDOW w AS (PARTITION BY channel_name ORDER BY day_diff ROWS UNBOUNDED PRECEDING)"""


@query(
    "lookback_curve",
    merged_sql(_CURVE.format(p="round(raw, 6)", c="round(sum(raw) OVER w, 6)"), extra=_LAGS),
)
def lookback_curve(spark, sf):
    curve = curves.lookback_curve(_lag_counts(spark, sf))
    return curve.withColumns({c: F.round(c, 6) for c in ("prcnt", "cumm_prcnt")})


@query(
    "lookback_curve_rounded",
    merged_sql(
        _CURVE.format(p="round(raw, 1)", c="round(sum(round(raw, 1)) OVER w, 1)").replace(
            "cnt * 100.0::DOUBLE / sum(cnt) OVER (PARTITION BY channel_name)", "cnt / sum(cnt) OVER (PARTITION BY channel_name) * 100.0::DOUBLE"
        ),
        extra=_LAGS,
    ),
)
def lookback_curve_rounded(spark, sf):
    return curves.lookback_curve(_lag_counts(spark, sf), digits=1).withColumn("cumm_prcnt", F.round("cumm_prcnt", 1))




_EXCLUDED = ", ".join(f"'{c}'" for c in v.DASHBOARD_EXCLUDED)


@query("excluded_channels", merged_sql(f"SELECT channel_name FROM cnts GROUP BY channel_name HAVING sum(CASE WHEN day_diff <= 61 THEN cnt END) < 2020 OR channel_name IN ({_EXCLUDED})", extra=_LAGS))
def excluded_channels(spark, sf):
    return curves.low_volume(_lag_counts(spark, sf), 2020, fixed=v.DASHBOARD_EXCLUDED)


@query(
    "curve_without_excluded",
    merged_sql(
        """SELECT channel_name, day_diff, cnt FROM cnts WHERE channel_name IS NULL OR channel_name NOT IN
           (SELECT channel_name FROM cnts WHERE channel_name IS NOT NULL GROUP BY channel_name HAVING sum(CASE WHEN day_diff <= 61 THEN cnt END) < 2020)""",
        extra=_LAGS,
    ),
)
def curve_without_excluded(spark, sf):
    counts = _lag_counts(spark, sf)
    return sets.without(counts, curves.low_volume(counts, 2020), "channel_name")


_WINDOWS = {"d1": 1, "d7": 7, "d14": 14, "d30": 30}
_CLICKED = "(SELECT *, coalesce(channel_name, 'Unassigned') AS chan FROM merged WHERE event_type_id IN (1,5,7))"


def _clicked(spark, sf):
    return _dashboard_clicks(merged(spark, sf)).withColumn("channel_name", F.coalesce("channel_name", F.lit("Unassigned")))


@query(
    "avg_clicks_by_window",
    merged_sql(
        "SELECT chan AS channel_name, "
        + ", ".join(
            f"round(count(*) FILTER (day_diff <= {d}) / nullif(count(DISTINCT transaction_id) FILTER (day_diff <= {d}), 0)::DOUBLE, 6) AS {n}"
            for n, d in _WINDOWS.items()
        )
        + f" FROM {_CLICKED} GROUP BY chan"
    ),
)
def avg_clicks_by_window(spark, sf):
    table = curves.average_clicks(_clicked(spark, sf), _WINDOWS)
    return table.withColumns({c: F.round(c, 6) for c in _WINDOWS})


@query(
    "avg_clicks_all_channels",
    merged_sql(
        "SELECT bbowa_site, "
        + ", ".join(
            f"round(count(*) FILTER (day_diff <= {d}) / nullif(count(DISTINCT transaction_id) FILTER (day_diff <= {d}), 0)::DOUBLE, 6) AS {n}"
            for n, d in _WINDOWS.items()
        )
        + f" FROM (SELECT *, site_id AS bbowa_site FROM {_CLICKED}) GROUP BY bbowa_site"
    ),
)
def avg_clicks_all_channels(spark, sf):
    by_site = _clicked(spark, sf).withColumnRenamed("site_id", "bbowa_site")
    table = curves.average_clicks(by_site, _WINDOWS, by=["bbowa_site"])
    return table.withColumns({c: F.round(c, 6) for c in _WINDOWS})


_NO_SEGMENT = "coalesce(fm_buyer_type_desc, '') NOT IN (" + ", ".join(f"'{s}'" for s in v.SEGMENTS) + ")"


@query(
    "avg_clicks_by_segment",
    merged_sql(
        "SELECT chan AS channel_name, "
        + ", ".join(
            f"""round(count(*) FILTER (fm_buyer_type_desc = '{s}') / nullif(count(DISTINCT transaction_id) FILTER (fm_buyer_type_desc = '{s}'), 0)::DOUBLE, 6) AS "{s}" """
            for s in v.SEGMENTS
        )
        + f""", round(count(*) FILTER ({_NO_SEGMENT}) / nullif(count(DISTINCT transaction_id) FILTER ({_NO_SEGMENT}), 0)::DOUBLE, 6) AS unknown"""
        + f" FROM {_CLICKED} GROUP BY chan"
    ),
)
def avg_clicks_by_segment(spark, sf):
    table = curves.average_clicks_by(_clicked(spark, sf), "fm_buyer_type_desc", v.SEGMENTS)
    return table.withColumns({s: F.round(F.col(f"`{s}`"), 6) for s in (*v.SEGMENTS, "unknown")})


def _cumulated(by: str) -> dict[str, str]:
    columns = f"{by}, " if by else ""
    partition = f"PARTITION BY {by} " if by else ""
    return {
        f"first_{by or 'all'}": f"""SELECT {columns}day_diff, count(*) AS no_txns FROM
            (SELECT {columns}transaction_id, item_id, min(day_diff) AS day_diff FROM (SELECT *, chan AS channel FROM {_CLICKED}) GROUP BY ALL) GROUP BY ALL""",
        f"cum_{by or 'all'}": f"""SELECT {columns}day_diff, no_txns, CAST(sum(no_txns) OVER ({partition}ORDER BY day_diff) AS BIGINT) AS cumm_txns,
            CAST(sum(no_txns) OVER ({partition.strip()}) AS BIGINT) AS last_txns FROM first_{by or 'all'}""",
    }


@query(
    "cumulative_outcomes",
    merged_sql(
        "SELECT day_diff, no_txns, cumm_txns, round(cumm_txns * 100.0::DOUBLE / last_txns, 6) AS pct_of_last FROM cum_all", extra=_cumulated("")
    ),
)
def cumulative_outcomes(spark, sf):
    return curves.cumulative_outcomes(_clicked(spark, sf)).withColumn("pct_of_last", F.round("pct_of_last", 6))


@query(
    "cumulative_by_channel",
    merged_sql("SELECT channel AS channel_name, day_diff, no_txns, cumm_txns FROM cum_channel", extra=_cumulated("channel")),
)
def cumulative_by_channel(spark, sf):
    return curves.cumulative_outcomes(_clicked(spark, sf), ["channel_name"]).drop("pct_of_last")


@query(
    "pct_of_last_lag",
    merged_sql(
        "SELECT channel AS channel_name, day_diff, round(cumm_txns * 100.0::DOUBLE / last_txns, 6) AS pct_of_last FROM cum_channel", extra=_cumulated("channel")
    ),
)
def pct_of_last_lag(spark, sf):
    table = curves.cumulative_outcomes(_clicked(spark, sf), ["channel_name"])
    return table.select("channel_name", "day_diff", F.round("pct_of_last", 6).alias("pct_of_last"))


def _daily_totals(spark, sf):
    """The state after three writes: all days by one key only, then two halves of the days as they are."""
    clicked = _clicked(spark, sf).select("transaction_id", "item_id", "created_dt", "channel_name", "day_diff", "join_strategy")
    clicked, out = stage(clicked), scratch(spark, "state")
    days = b.outcomes(spark, sf).select("created_dt").distinct()
    early = F.col("created_dt") < "2024-01-15"
    for rows, some in ((clicked.where("join_strategy = 'uid'"), days), (clicked, days.where(early)), (clicked, days.where(~early))):
        daily_state.replace_days(daily_state.day_summary(rows, some, "created_dt", "channel_name"), out, "created_dt")
    return daily_state.totals(spark, out, "created_dt")


@query(
    "daily_state_by_channel",
    merged_sql("SELECT channel AS channel_name, day_diff, no_txns, cumm_txns FROM cum_channel", extra=_cumulated("channel")),
)
def daily_state_by_channel(spark, sf):
    return daily_state.cumulative_outcomes(_daily_totals(spark, sf), "channel_name").drop("pct_of_last")


@query(
    "daily_state_overall",
    merged_sql(
        "SELECT day_diff, no_txns, cumm_txns, round(cumm_txns * 100.0::DOUBLE / last_txns, 6) AS pct_of_last FROM cum_all", extra=_cumulated("")
    ),
)
def daily_state_overall(spark, sf):
    return daily_state.cumulative_outcomes(_daily_totals(spark, sf)).withColumn("pct_of_last", F.round("pct_of_last", 6))


@query(
    "daily_state_avg_clicks",
    merged_sql(
        "SELECT chan AS channel_name, "
        + ", ".join(
            f"round(count(*) FILTER (day_diff <= {d}) / nullif(count(DISTINCT transaction_id) FILTER (day_diff <= {d}), 0)::DOUBLE, 6) AS {n}"
            for n, d in _WINDOWS.items()
        )
        + f" FROM {_CLICKED} GROUP BY chan"
    ),
)
def daily_state_avg_clicks(spark, sf):
    table = daily_state.average_clicks(_daily_totals(spark, sf), _WINDOWS, "channel_name")
    return table.withColumns({c: F.round(c, 6) for c in _WINDOWS})


_FILLED = {
    **_cumulated("channel"),
    **_cumulated(""),
    "filled": """SELECT c.channel AS channel_name, CAST(d.day_diff AS INT) AS day_diff,
        CAST(sum(coalesce(f.no_txns, 0)) OVER (PARTITION BY c.channel ORDER BY d.day_diff) AS BIGINT) AS cumm_txns
        FROM (SELECT DISTINCT channel FROM first_channel) c CROSS JOIN (SELECT unnest(range(0, 26)) AS day_diff) d
        LEFT JOIN first_channel f ON f.channel = c.channel AND f.day_diff = d.day_diff""",
    "filled_all": """SELECT d.day_diff, CAST(sum(coalesce(f.no_txns, 0)) OVER (ORDER BY d.day_diff) AS BIGINT) AS cumm_txns
        FROM (SELECT unnest(range(0, 26)) AS day_diff) d LEFT JOIN first_all f ON f.day_diff = d.day_diff""",
}


def _filled(spark, sf, by=("channel_name",)):
    firsts = curves.first_lags(_clicked(spark, sf), by, "day_diff")
    every_lag = curves.fill_lags(firsts, by, "no_txns", last=25)
    return curves.running(every_lag, "no_txns", by, name="cumm_txns")


@query(
    "pct_of_all",
    merged_sql(
        "SELECT channel_name, f.day_diff, f.cumm_txns, round(f.cumm_txns * 100.0::DOUBLE / a.cumm_txns, 6) AS pct_of_all FROM filled f JOIN filled_all a ON f.day_diff = a.day_diff",
        extra=_FILLED,
    ),
)
def pct_of_all(spark, sf):
    table = curves.pct_of_all(_filled(spark, sf), _filled(spark, sf, by=()))
    return table.select("channel_name", "day_diff", "cumm_txns", F.round("pct_of_all", 6).alias("pct_of_all"))


@query(
    "baseline_normalised",
    merged_sql(
        """SELECT channel_name, f.day_diff, round(f.cumm_txns * 100.0::DOUBLE / b.cumm_txns, 6) AS cumm_prcnt FROM filled f
           JOIN (SELECT channel_name, cumm_txns FROM filled WHERE day_diff = 7) b USING (channel_name) WHERE f.day_diff BETWEEN 1 AND 20
           AND channel_name IN ('Display', 'epn', 'marketing_emails', 'Natural Search', 'Paid Search', 'Paid Social', 'site_emails', 'Social Media')""",
        extra=_FILLED,
    ),
)
def baseline_normalised(spark, sf):
    shown = _filled(spark, sf).where(F.col("channel_name").isin(*v.BASELINE_CHANNELS))
    return curves.baseline_normalised(shown, 7, 1, 20).withColumn("cumm_prcnt", F.round("cumm_prcnt", 6))


@query(
    "baseline_by_site",
    merged_sql(
        """SELECT a.channel AS channel_name, a.site_id, a.day_diff, round(a.cumm * 100.0::DOUBLE / b.cumm, 6) AS cumm_prcnt FROM sitecum a
           JOIN (SELECT channel, site_id, cumm FROM sitecum WHERE day_diff = 3) b ON a.channel = b.channel AND a.site_id = b.site_id WHERE a.day_diff BETWEEN 0 AND 14""",
        extra={
            "sitefirst": f"""SELECT channel, site_id, day_diff, count(*) AS n FROM (SELECT chan AS channel, site_id, transaction_id, min(day_diff) AS day_diff
                FROM {_CLICKED} WHERE bbowa_device_type IN ('PC', 'PC: Touch') GROUP BY ALL) GROUP BY ALL""",
            "sitecum": "SELECT channel, site_id, day_diff, CAST(sum(n) OVER (PARTITION BY channel, site_id ORDER BY day_diff) AS BIGINT) AS cumm FROM sitefirst",
        },
    ),
)
def baseline_by_site(spark, sf):
    on_pc = _clicked(spark, sf).where(F.col("bbowa_device_type").isin("PC", "PC: Touch"))
    cumulated = curves.cumulative_outcomes(on_pc, ["channel_name", "site_id"])
    table = curves.baseline_normalised(cumulated, 3, 0, 14, by=["channel_name", "site_id"])
    return table.withColumn("cumm_prcnt", F.round("cumm_prcnt", 6))


@query(
    "subchannel_curve",
    merged_sql(
        """SELECT a.sub_channel, a.day_diff, round(a.cumm * 100.0::DOUBLE / b.cumm, 6) AS cumm_prcnt FROM subcum a
           JOIN (SELECT sub_channel, cumm FROM subcum WHERE day_diff = 5) b USING (sub_channel) WHERE a.day_diff BETWEEN 0 AND 25""",
        "rotation",
        extra={
            "subfirst": """SELECT sub_channel, day_diff, count(*) AS n FROM (SELECT big_rock AS sub_channel, transaction_id, item_id, min(day_diff) AS day_diff
                FROM merged JOIN rotation USING (rotation_id) WHERE channel_name = 'Display' GROUP BY ALL) GROUP BY ALL""",
            "subcum": "SELECT sub_channel, day_diff, CAST(sum(n) OVER (PARTITION BY sub_channel ORDER BY day_diff) AS BIGINT) AS cumm FROM subfirst",
        },
    ),
)
def subchannel_curve(spark, sf):
    display = merged(spark, sf).where(F.col("channel_name") == "Display")
    named = display.join(b.rotation_lookup(spark, sf), "rotation_id").withColumnRenamed("big_rock", "sub_channel")
    cumulated = curves.cumulative_outcomes(named, ["sub_channel"])
    return curves.baseline_normalised(cumulated, 5, 0, 25, by=["sub_channel"]).withColumn("cumm_prcnt", F.round("cumm_prcnt", 6))


_SPREAD_WINDOWS = (1, 3, 7, 14, 25)
_NCH = {
    "nch": " UNION ALL ".join(
        f"SELECT site_id, {w} AS window_days, transaction_id, count(DISTINCT channel_name) AS n_channels FROM merged WHERE day_diff <= {w} GROUP BY site_id, transaction_id HAVING count(DISTINCT channel_name) > 0"
        for w in _SPREAD_WINDOWS
    ),
}


def _histogram(spark, sf):
    return curves.channels_within(merged(spark, sf), _SPREAD_WINDOWS, ["site_id"])


@query(
    "channels_per_path",
    merged_sql(
        """SELECT site_id, window_days, round(avg(n_channels), 6) AS mean, round(stddev_samp(n_channels), 6) AS stddev,
           round(greatest(1.0, avg(n_channels) - stddev_samp(n_channels)), 6) AS low, round(avg(n_channels) + stddev_samp(n_channels), 6) AS high
           FROM nch GROUP BY site_id, window_days""",
        extra=_NCH,
    ),
)
def channels_per_path(spark, sf):
    spread = curves.channel_spread(_histogram(spark, sf), ["site_id"]).withColumnRenamed("window", "window_days")
    return spread.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "low", "high")})


@query(
    "channels_cumfrac",
    merged_sql(
        """SELECT site_id, window_days, n_channels, n_paths, round(sum(n_paths) OVER (PARTITION BY site_id, window_days ORDER BY n_channels)
           / sum(n_paths) OVER (PARTITION BY site_id, window_days)::DOUBLE, 6) AS cumul_frac
           FROM (SELECT site_id, window_days, n_channels, count(*) AS n_paths FROM nch GROUP BY ALL)""",
        extra=_NCH,
    ),
)
def channels_cumfrac(spark, sf):
    fractions = curves.channel_fractions(_histogram(spark, sf), ["site_id"]).withColumnRenamed("window", "window_days")
    return fractions.withColumn("cumul_frac", F.round("cumul_frac", 6))


_DAILY_CLICKS = "SELECT event_dt, coalesce(channel_name, 'Unassigned') AS channel_name, count(*) AS no_events FROM touch WHERE event_type_id IN (1,5,7) GROUP BY ALL"


def _daily_clicks(spark, sf):
    clicks = _dashboard_clicks(b.touches(spark, sf))
    return curves.volume(clicks, ["event_dt", F.coalesce("channel_name", F.lit("Unassigned")).alias("channel_name")])


@query(
    "dense_grid",
    with_views(
        """SELECT d.event_dt, c.channel_name, coalesce(no_events, 0) AS no_events FROM (SELECT DISTINCT event_dt FROM daily) d
           CROSS JOIN (SELECT DISTINCT channel_name FROM daily) c LEFT JOIN daily USING (event_dt, channel_name)""",
        "touch", extra={"daily": _DAILY_CLICKS},
    ),
)
def dense_grid(spark, sf):
    return curves.dense_grid(_daily_clicks(spark, sf))


_PIVOT = (*v.BASELINE_CHANNELS, "Paid Search - Brand", "Unassigned")
_OTHER = "channel_name NOT IN (" + ", ".join(f"'{c}'" for c in _PIVOT) + ")"


@query(
    "pivot_daily",
    with_views(
        "SELECT event_dt, " + ", ".join(f"""CAST(coalesce(sum(no_events) FILTER (channel_name = '{c}'), 0) AS BIGINT) AS "{c}" """ for c in _PIVOT)
        + f", CAST(coalesce(sum(no_events) FILTER ({_OTHER}), 0) AS BIGINT) AS other FROM daily GROUP BY event_dt",
        "touch", extra={"daily": _DAILY_CLICKS},
    ),
)
def pivot_daily(spark, sf):
    return curves.pivot_wide(_daily_clicks(spark, sf), ["event_dt"], "channel_name", _PIVOT, "no_events")


@query(
    "unpivot_curve",
    with_views(
        """SELECT d.event_dt, c.channel_name, coalesce(no_events, 0) AS no_events FROM (SELECT DISTINCT event_dt FROM daily) d
           CROSS JOIN (SELECT unnest(["""
        + ", ".join(f"'{c}'" for c in _PIVOT)
        + ", 'other']) AS channel_name) c LEFT JOIN named USING (event_dt, channel_name)",
        "touch",
        extra={"daily": _DAILY_CLICKS, "named": f"SELECT event_dt, CASE WHEN {_OTHER} THEN 'other' ELSE channel_name END AS channel_name, CAST(sum(no_events) AS BIGINT) AS no_events FROM daily GROUP BY ALL"},
    ),
)
def unpivot_curve(spark, sf):
    return curves.unpivot_long(pivot_daily(spark, sf), ["event_dt"], [*_PIVOT, "other"], "channel_name", "no_events")
