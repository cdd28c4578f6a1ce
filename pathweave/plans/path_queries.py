"""Paths, pairs of channels, encodings and transitions."""

from pyspark.sql import functions as F

from ..functions import labels
from ..functions import values as v
from ..operators import encode, paths, sequence
from . import bindings as b
from .jobs import CURRENT, TRANSACTION, by_intent, path_steps
from .link_queries import merged, merged_sql
from .registry import query

_TOUCHES = {
    "pt": """SELECT transaction_id, item_id, event_id, coalesce(channel_name, 'Unassigned') AS channel_name, min(event_ts) AS event_ts
        FROM merged GROUP BY ALL""",
    "plen": "SELECT transaction_id, item_id, count(DISTINCT event_id) AS path_length FROM pt GROUP BY ALL",
}


def _touches(spark, sf):
    return paths.path_touches(merged(spark, sf))


@query(
    "path_build",
    merged_sql("SELECT transaction_id, item_id, path_length, event_ts, event_id, channel_name FROM pt JOIN plen USING (transaction_id, item_id)", extra=_TOUCHES),
)
def path_build(spark, sf):
    return paths.with_lengths(_touches(spark, sf)).select(*paths.OUTCOME, "path_length", "event_ts", "event_id", "channel_name")


@query(
    "path_build_100",
    merged_sql(
        """SELECT transaction_id, item_id, path_length,
           string_agg(cast(event_id AS VARCHAR) || ':' || channel_name, ';' ORDER BY event_ts, event_id, channel_name) AS path
           FROM pt JOIN plen USING (transaction_id, item_id) WHERE path_length <= 100 GROUP BY transaction_id, item_id, path_length""",
        extra=_TOUCHES,
    ),
)
def path_build_100(spark, sf):
    built = paths.build_paths(_touches(spark, sf), 100)
    text = F.transform("touches", lambda t: F.concat_ws(":", t["event_id"].cast("string"), t["channel_name"]))
    return built.select(*paths.OUTCOME, "path_length", F.array_join(text, ";").alias("path"))


def _pairs_sql(unordered: bool, limit: int | None = None) -> dict[str, str]:
    one, two = ("least(a.channel_name, b.channel_name)", "greatest(a.channel_name, b.channel_name)") if unordered else ("a.channel_name", "b.channel_name")
    return {
        **_TOUCHES,
        "pairs": f"""SELECT path_length, {one} AS channel_1, {two} AS channel_2, count(*) AS n FROM pt a
        JOIN pt b ON a.transaction_id = b.transaction_id AND a.item_id = b.item_id
             AND (a.event_ts, a.event_id, a.channel_name) < (b.event_ts, b.event_id, b.channel_name)
        JOIN plen ON plen.transaction_id = a.transaction_id AND plen.item_id = a.item_id
        {"" if limit is None else f"WHERE path_length <= {limit}"} GROUP BY ALL""",
    }


_PAIR_COLUMNS = "SELECT path_length, channel_1, channel_2, n FROM pairs"


@query("pairs_unordered", merged_sql(_PAIR_COLUMNS, extra=_pairs_sql(True)))
def pairs_unordered(spark, sf):
    return paths.unordered_pairs(_touches(spark, sf))


@query("pairs_unordered_60", merged_sql(_PAIR_COLUMNS, extra=_pairs_sql(True, 60)))
def pairs_unordered_60(spark, sf):
    return paths.unordered_pairs(_touches(spark, sf), 60)


@query("pairs_ordered", merged_sql(_PAIR_COLUMNS, extra=_pairs_sql(False)))
def pairs_ordered(spark, sf):
    return paths.ordered_pairs(_touches(spark, sf))


@query("pairs_ordered_1000", merged_sql(_PAIR_COLUMNS, extra=_pairs_sql(False, 1000)))
def pairs_ordered_1000(spark, sf):
    return paths.ordered_pairs(_touches(spark, sf), 1000)


@query(
    "pairs_serialised",
    merged_sql(
        """SELECT path_length, string_agg('(' || channel_1 || ',' || channel_2 || ') -> ' || cast(n AS VARCHAR), ';' ORDER BY channel_1, channel_2) AS coocurence_pairs
           FROM pairs GROUP BY path_length""",
        extra=_pairs_sql(False),
    ),
)
def pairs_serialised(spark, sf):
    return paths.serialise_pairs(pairs_ordered(spark, sf))


@query("pairs_parsed", merged_sql(_PAIR_COLUMNS, extra=_pairs_sql(True)))
def pairs_parsed(spark, sf):
    return paths.parse_pairs(paths.serialise_pairs(pairs_unordered(spark, sf)))


def _asymmetry_sql(where: str) -> str:
    return merged_sql(
        """SELECT c1.c AS channel_1, c2.c AS channel_2, coalesce(a.n, 0) AS occurence, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference,
           CAST(sign(coalesce(a.n, 0) - coalesce(b.n, 0)) AS INT) AS comparison,
           round((coalesce(a.n, 0) - coalesce(b.n, 0)) / greatest(coalesce(a.n, 0) + coalesce(b.n, 0), 1)::DOUBLE, 6) AS relative_difference
           FROM ch c1 CROSS JOIN ch c2 LEFT JOIN tot a ON a.channel_1 = c1.c AND a.channel_2 = c2.c
           LEFT JOIN tot b ON b.channel_1 = c2.c AND b.channel_2 = c1.c""",
        extra={
            **_pairs_sql(False),
            "tot": f"SELECT channel_1, channel_2, CAST(sum(n) AS BIGINT) AS n FROM pairs {where} GROUP BY ALL",
            "ch": "SELECT channel_1 AS c FROM tot UNION SELECT channel_2 FROM tot",
        },
    )


def _asymmetry(spark, sf, path_length=None):
    table = paths.pair_asymmetry(pairs_ordered(spark, sf), path_length)
    return table.withColumn("relative_difference", F.round("relative_difference", 6))


@query("pair_asymmetry", _asymmetry_sql(""))
def pair_asymmetry(spark, sf):
    return _asymmetry(spark, sf)


@query("pair_asymmetry_40", _asymmetry_sql("WHERE path_length = 40"))
def pair_asymmetry_40(spark, sf):
    return _asymmetry(spark, sf, 40)


_TOKEN = """coalesce(channel_name, 'unassigned') || '#' ||
    CASE WHEN event_type_id IN (1,5,7,8) THEN 'click' WHEN event_type_id = 4 THEN 'impression' WHEN event_type_id = 6 THEN 'open' ELSE 'undefined' END
    || '#' || CASE WHEN event_type_id = 4 AND channel_id = 1 AND device_type_level1 IS NULL THEN 'PC' ELSE coalesce(device_type_level1, 'unknown') END"""


def _token_views(where: str = "") -> dict[str, str]:
    return {
        "tok": f"SELECT DISTINCT transaction_id, item_id, {_TOKEN} AS token FROM merged {where}",
        "enc": "SELECT token, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS INT) AS n FROM tok GROUP BY token",
    }


def _tokens(spark, sf, intent=None):
    rows = by_intent(merged(spark, sf), intent)
    return rows.select(*paths.OUTCOME, labels.channel_token().alias("token")).distinct()


@query("token_encoder", merged_sql("SELECT token, cnt, n FROM enc", extra=_token_views()))
def token_encoder(spark, sf):
    return encode.frequency_encoder(_tokens(spark, sf), "token")


_MASK_VIEWS = {
    "chan": "SELECT DISTINCT transaction_id, item_id, coalesce(channel_name, 'Unassigned') AS channel_name FROM merged",
    "enc": "SELECT channel_name, CAST(row_number() OVER (ORDER BY count(*) DESC, channel_name) - 1 AS INT) AS n FROM chan GROUP BY channel_name",
    "masks": "SELECT transaction_id, item_id, CAST(sum(1::BIGINT << n) AS BIGINT) AS channel_mask FROM chan JOIN enc USING (channel_name) GROUP BY transaction_id, item_id",
}


def _channels(spark, sf):
    rows = merged(spark, sf).select(*paths.OUTCOME, "channel_name")
    return labels.with_defaults(rows, {"channel_name": "Unassigned"}).distinct()


@query("mask_encoder", merged_sql("SELECT channel_name, n, 1::BIGINT << n AS mask FROM enc", extra=_MASK_VIEWS))
def mask_encoder(spark, sf):
    return encode.mask_encoder(_channels(spark, sf), "channel_name").drop("word")


@query("channel_mask", merged_sql("SELECT transaction_id, item_id, channel_mask FROM masks", extra=_MASK_VIEWS))
def channel_mask(spark, sf):
    rows = _channels(spark, sf)
    return encode.channel_masks(rows, encode.mask_encoder(rows, "channel_name"), "channel_name").drop("mask_words")


@query(
    "mask_matrix",
    merged_sql(
        """SELECT channel_mask, n_paths, channel_name, CAST((channel_mask >> n) & 1 AS INT) AS present
           FROM (SELECT channel_mask, count(*) AS n_paths FROM masks GROUP BY channel_mask) CROSS JOIN enc
           WHERE channel_name NOT IN (""" + ", ".join(f"'{c}'" for c in v.MATRIX_EXCLUDED) + ")",
        extra=_MASK_VIEWS,
    ),
)
def mask_matrix(spark, sf):
    rows = _channels(spark, sf)
    encoder = encode.mask_encoder(rows, "channel_name")
    masks = encode.channel_masks(rows, encoder, "channel_name")
    return encode.mask_matrix(masks, encoder, "channel_name", excluded=v.MATRIX_EXCLUDED).drop("mask_words")


_PRESENCE = """SELECT o.transaction_id, o.item_id, string_agg(CASE WHEN t.token IS NULL THEN '0' ELSE '1' END, '' ORDER BY e.n) AS presence
    FROM (SELECT DISTINCT transaction_id, item_id FROM tok) o CROSS JOIN enc e
    LEFT JOIN tok t ON t.transaction_id = o.transaction_id AND t.item_id = o.item_id AND t.token = e.token GROUP BY o.transaction_id, o.item_id"""


def _presence(spark, sf, intent=None):
    rows = _tokens(spark, sf, intent)
    return encode.presence_strings(rows, encode.frequency_encoder(rows, "token"), "token")


@query("presence_string", merged_sql(_PRESENCE, extra=_token_views()))
def presence_string(spark, sf):
    return _presence(spark, sf)


@query("presence_pre_intent", merged_sql(_PRESENCE, extra=_token_views("WHERE bbowa_sec_diff > 0")))
def presence_pre_intent(spark, sf):
    return _presence(spark, sf, "before")


@query("presence_post_intent", merged_sql(_PRESENCE, extra=_token_views("WHERE bbowa_sec_diff <= 0")))
def presence_post_intent(spark, sf):
    return _presence(spark, sf, "after")


_STEPS = {
    "info": """SELECT m.transaction_id, m.item_id, coalesce(fm_buyer_type_desc, 'unknown') AS fm_buyer_type_desc, coalesce(is_first_purchase, 0) AS is_first_purchase,
        CASE WHEN bbowa_device_type IS NULL THEN 'unknown' WHEN bbowa_device_type IN ('PC', 'PC: Touch') THEN 'PC' WHEN bbowa_device_type = 'Phone' THEN 'Mobile'
             WHEN bbowa_device_type = 'Tablet' THEN 'Tablet' ELSE 'others' END AS bbowa_device, m.event_ts, m.event_id,
        CASE WHEN event_type_id IN (1,5,7,8) THEN 'click' WHEN event_type_id = 6 THEN 'open' ELSE 'undefined' END AS event_type,
        coalesce(device_type_level1, 'unassigned') AS event_device, coalesce(channel_name, 'unassigned') AS channel_name,
        CASE WHEN channel_name = 'epn' THEN flex_column_1 WHEN channel_name = 'Display' THEN big_rock ELSE '' END AS sub_channel
        FROM merged m LEFT JOIN rotation USING (rotation_id) WHERE event_type_id <> 4""",
    "steps": """SELECT *, lead(event_type) OVER w AS next_event_type, lead(event_device) OVER w AS next_event_device,
        lead(channel_name) OVER w AS next_channel_name, lead(sub_channel) OVER w AS next_sub_channel, lag(channel_name) OVER w AS previous_channel_name,
        rank() OVER (PARTITION BY transaction_id, item_id ORDER BY event_ts) AS forward_step,
        rank() OVER (PARTITION BY transaction_id, item_id ORDER BY event_ts DESC) AS backward_step
        FROM info WINDOW w AS (PARTITION BY transaction_id, item_id ORDER BY event_ts, event_id)""",
}


def _info(spark, sf):
    return path_steps(merged(spark, sf), b.rotation_lookup(spark, sf))


@query(
    "path_neighbours",
    merged_sql(
        "SELECT transaction_id, event_id, previous_channel_name, next_channel_name, forward_step, backward_step FROM steps", "rotation", extra=_STEPS
    ),
)
def path_neighbours(spark, sf):
    return sequence.with_neighbours(_info(spark, sf), CURRENT).select(
        "transaction_id", "event_id", F.col("previous.channel_name").alias("previous_channel_name"),
        F.col("next.channel_name").alias("next_channel_name"), "forward_step", "backward_step",
    )


@query(
    "weighted_edges",
    merged_sql(
        """SELECT fm_buyer_type_desc, is_first_purchase, bbowa_device, event_type, event_device, channel_name, sub_channel,
           next_event_type, next_event_device, next_channel_name, next_sub_channel, backward_step AS step, count(*) AS weight FROM steps GROUP BY ALL""",
        "rotation", extra=_STEPS,
    ),
)
def weighted_edges(spark, sf):
    edges = sequence.weighted_edges(sequence.with_neighbours(_info(spark, sf), CURRENT), TRANSACTION, CURRENT)
    return edges.select("transaction.*", "current.*", *[F.col(f"next.{c}").alias(f"next_{c}") for c in CURRENT], "step", "weight")


@query(
    "chrono_events",
    merged_sql(
        """SELECT transaction_id, item_id, fm_buyer_type_desc, is_first_purchase, bbowa_device, path_length, event_id, channel_name, sub_channel,
           previous_channel_name, next_channel_name, backward_step, forward_step
           FROM steps JOIN (SELECT transaction_id, item_id, count(DISTINCT event_id) AS path_length FROM info GROUP BY ALL) USING (transaction_id, item_id)""",
        "rotation", extra=_STEPS,
    ),
)
def chrono_events(spark, sf):
    steps = sequence.chrono_steps(_info(spark, sf), ("channel_name", "sub_channel"), attributes=TRANSACTION)
    return steps.drop("event_ts", "previous_sub_channel", "next_sub_channel")


@query(
    "chrono_events_100",
    merged_sql(
        """SELECT transaction_id, item_id, fm_buyer_type_desc, is_first_purchase, bbowa_device, count(DISTINCT event_id) AS path_length,
           string_agg(concat_ws('|', cast(event_id AS VARCHAR), channel_name, coalesce(previous_channel_name, '-'), cast(backward_step AS VARCHAR),
           coalesce(next_channel_name, '-'), cast(forward_step AS VARCHAR)), ';' ORDER BY event_ts, event_id) AS events
           FROM steps GROUP BY ALL HAVING count(DISTINCT event_id) <= 100""",
        "rotation", extra=_STEPS,
    ),
)
def chrono_events_100(spark, sf):
    lists = sequence.chrono_events(_info(spark, sf), ("channel_name", "sub_channel"), 100, attributes=TRANSACTION)
    text = F.transform(
        "mktng_events",
        lambda e: F.concat_ws(
            "|", e["event_id"].cast("string"), e["channel_name"], F.coalesce(e["previous_channel_name"], F.lit("-")),
            e["backward_step"].cast("string"), F.coalesce(e["next_channel_name"], F.lit("-")), e["forward_step"].cast("string"),
        ),
    )
    return lists.select(*paths.OUTCOME, *TRANSACTION, "path_length", F.array_join(text, ";").alias("events"))


_PAID = "channel_name NOT IN ('organic', 'site_emails')"


@query(
    "paid_events",
    merged_sql(
        f"""SELECT transaction_id, item_id, path_length, event_ts, event_id, channel_name FROM info
            JOIN (SELECT transaction_id, item_id, count(DISTINCT event_id) AS path_length FROM info WHERE {_PAID} GROUP BY ALL) USING (transaction_id, item_id)
            WHERE {_PAID}""",
        "rotation", extra=_STEPS,
    ),
)
def paid_events(spark, sf):
    paid = _info(spark, sf).where(~F.col("channel_name").isin("organic", "site_emails"))
    return paths.with_lengths(paid).select(*paths.OUTCOME, "path_length", "event_ts", "event_id", "channel_name")


@query(
    "paid_events_100",
    merged_sql(
        """SELECT transaction_id, count(DISTINCT event_id) AS path_length, string_agg(channel_name, ';' ORDER BY event_ts, event_id) AS channels
           FROM info WHERE channel_name NOT IN ('organic', 'site_emails') GROUP BY transaction_id HAVING count(DISTINCT event_id) <= 100""",
        "rotation", extra=_STEPS,
    ),
)
def paid_events_100(spark, sf):
    paid = _info(spark, sf).where(~F.col("channel_name").isin("organic", "site_emails"))
    built = paths.build_paths(paid, 100)
    return built.select("transaction_id", "path_length", F.array_join("touches.channel_name", ";").alias("channels"))
