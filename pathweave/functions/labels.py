"""Labels, defaults and simple derived columns of a touch or an outcome."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as v

# style -> (click label, impression label, open label, anything else)
_EVENT_STYLES = {
    "click_open": ("click", "open", "open", "unknown"),
    "full": ("click", "impression", "open", "undefined"),
    "no_impression": ("click", "undefined", "open", "undefined"),
}


def event_label(
    event_type: str = "event_type_id",
    style: str = "full",
    clicks: Sequence[int] = v.PATH_CLICKS,
) -> Column:
    """Name of an event type.

    ``click_open`` calls impressions "open" too, ``full`` keeps them apart and
    ``no_impression`` leaves them undefined.
    """
    if style not in _EVENT_STYLES:
        raise ValueError(f"unknown label style {style!r}; use one of {sorted(_EVENT_STYLES)}")
    click, impression, opened, other = _EVENT_STYLES[style]
    code = F.col(event_type)
    return (
        F.when(code.isin(*clicks), click)
        .when(code == v.IMPRESSION, impression)
        .when(code == v.OPEN, opened)
        .otherwise(other)
    )


def channel_event(
    event_type: str = "event_type_id",
    channel: str = "channel_name",
    clicks: Sequence[int] = v.PATH_CLICKS,
) -> Column:
    """``click_<channel>`` / ``open_<channel>``, or plain ``unknown``."""
    label = event_label(event_type, "click_open", clicks)
    return F.when(label == "unknown", label).otherwise(
        F.concat_ws("_", label, F.coalesce(channel, F.lit("Unassigned")))
    )


def touch_device(
    device: str = "device_type_level1",
    event_type: str = "event_type_id",
    channel_id: str = "channel_id",
    only_missing: bool = True,
) -> Column:
    """Device of a touch; display impressions count as PC.

    With ``only_missing`` that holds only where the device is not known.
    """
    display = (F.col(event_type) == v.IMPRESSION) & (F.col(channel_id) == 1)
    if only_missing:
        display = display & F.col(device).isNull()
    return F.when(display, "PC").otherwise(F.coalesce(device, F.lit("unknown")))


def outcome_device(device: str = "bbowa_device_type") -> Column:
    label = F.when(F.col(device).isNull(), "unknown")
    for raw, name in v.OUTCOME_DEVICES.items():
        label = label.when(F.col(device) == raw, name)
    return label.otherwise("others")


def sub_channel(
    channel: str = "channel_name",
    partner: str = "flex_column_1",
    big_rock: str = "big_rock",
) -> Column:
    return (
        F.when(F.col(channel) == "epn", F.col(partner))
        .when(F.col(channel) == "Display", F.col(big_rock))
        .otherwise("")
    )


def channel_token(
    channel: str = "channel_name",
    event_type: str = "event_type_id",
    device: str = "device_type_level1",
    channel_id: str = "channel_id",
) -> Column:
    """``channel#event#device``."""
    return F.concat_ws(
        "#",
        F.coalesce(channel, F.lit("unassigned")),
        event_label(event_type, "full"),
        touch_device(device, event_type, channel_id),
    )


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls column by column; a default is cast to its column's type."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(d).cast(types[c])) for c, d in defaults.items()}
    )


def prefixed(df: DataFrame, prefix: str, only: Sequence[str] | None = None) -> DataFrame:
    """Rename columns with a prefix, all of them or just ``only``."""
    return df.withColumnsRenamed({c: prefix + c for c in (df.columns if only is None else only)})
