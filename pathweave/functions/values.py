"""Fixed values the results depend on, stated plainly."""

# Event type codes.
ROVER_CLICK = 1
IMPRESSION = 4
EMAIL_CLICK = 5
OPEN = 6
SIMULATED_CLICK = 7
ORGANIC_SESSION = 8

PATH_CLICKS = (1, 5, 7, 8)
SESSION_CLICKS = (1, 5, 8)
DASHBOARD_CLICKS = (1, 5, 7)

# Device id that stands for "no device".
ZERO_DEVICE = "00000000-0000-0000-0000-000000000000"
MIN_DEVICE_LENGTH = 35

# Channel lookup (id, name).
CHANNELS = (
    (1, "Display"),
    (2, "Paid Search"),
    (3, "Natural Search"),
    (6, "epn"),
    (9, "Shopping Comparison"),
    (13, "Social Media"),
    (15, "Partner Integration"),
    (16, "Others"),
    (18, "Exclusion"),
    (19, "Unassigned"),
    (23, "Partner Integration - Organic"),
    (25, "Paid Search - Brand"),
    (26, "Natural Search - Gbase"),
    (27, "Shopping Comparison  - SDC"),
    (28, "Non-IM Mktg Initiatives"),
    (32, "Programmatic"),
    (33, "Paid Social"),
    (40, "marketing_emails"),
    (50, "site_emails"),
)

# Channels left out of the dashboards.
DASHBOARD_EXCLUDED = (
    "NULL",
    "isNA",
    "Natural Search - Gbase",
    "Others",
    "Non-IM Mktg Initiatives",
    "Exclusion",
    "Paid Seach . Brand",
    "Affiliate",
    "Unassigned",
    "Shopping Comparison",
    "Shopping Comparison  - SDC",
    "Shopping Comparison - SDC",
    "Programmatic",
    "Series 20",
)

# Channels left out of the co-occurrence matrix.
MATRIX_EXCLUDED = (
    "Affiliate",
    "Shopping Comparison  - SDC",
    "Natural Search - Gbase",
    "Others",
    "Exclusion",
    "Programmatic",
    "Non-IM Mktg Initiatives",
    "Paid Search . Brand",
)

# Channels shown in the baseline-normalised curves.
BASELINE_CHANNELS = (
    "Display",
    "epn",
    "marketing_emails",
    "Natural Search",
    "Paid Search",
    "Paid Social",
    "site_emails",
    "Social Media",
)

# Channels dropped from "paid" paths.
ORGANIC_CHANNELS = ("organic", "site_emails")

# Output column -> business vertical.
VERTICALS = {
    "num_fashion": "Fashion",
    "num_home_garden": "Home & Garden",
    "num_electronics": "Electronics",
    "num_collectibles": "Collectibles",
    "num_parts_acc": "Parts & Accessories",
    "num_vehicles": "Vehicles",
    "num_lifestyle": "Lifestyle",
    "num_bu_industrial": "Business & Industrial",
    "num_media": "Media",
    "num_real_estate": "Real Estate",
    "num_unknown": "Unknown",
}

# Output column -> meta category id.
META_CATEGORIES = {
    "num_clothes_shoes_acc": 11450,
    "num_home_furniture": 11700,
    "num_cars_motors_vehic": 9800,
    "num_cars_p_and_acc": 131090,
    "num_sporting_goods": 888,
    "num_toys_games": 220,
    "num_health_beauty": 26395,
    "num_mob_phones": 15032,
    "num_business_ind": 12576,
    "num_baby": 2984,
    "num_jewellry_watches": 281,
    "num_computers": 58058,
    "num_modellbau": 22128,
    "num_antiquities": 353,
    "num_sound_vision": 293,
    "num_video_games_consoles": 1249,
}

# Output column -> purchase-intent code.
INTENTS = {
    "num_watch": "Watch",
    "num_ask": "Ask",
    "num_ac": "AC",
    "num_bo": "BO",
    "num_bb": "BB",
}

# Highest breadth of specificity buckets 1-4; anything else is bucket 5.
BREADTH_CUTS = {
    "num_meta": (1, 2, 4, 7),
    "num_lv2": (1, 3, 6, 12),
    "num_lv3": (2, 5, 8, 15),
    "num_lv4": (2, 5, 8, 15),
}
SPECIFICITY_BUCKETS = 5

# Outcome device names.
OUTCOME_DEVICES = {
    "PC": "PC",
    "PC: Touch": "PC",
    "Phone": "Mobile",
    "Tablet": "Tablet",
}

# Buyer segments.
SEGMENTS = (
    "Uber Loyals",
    "Frequent High Spenders",
    "Frequent Low/Mid Spenders",
    "Infrequent High Spenders",
    "Infrequent Mid Spenders",
    "Infrequent Low Spenders",
    "New",
    "Reactivated",
)

# Traffic sources that make a session an organic touch.
ORGANIC_TRAFFIC_SOURCES = (1, 2, 3)
