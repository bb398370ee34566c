"""Scalar column builders (all JVM-side built-in expressions, no UDFs).

Every function takes column names or ``Column`` objects and returns a
``Column``; they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the original project's constants.
# ---------------------------------------------------------------------------
# Amenity keyword flags, case-insensitive regex over the amenities text.
KEY_AMENITIES = {
    "has_wifi": "wifi|internet",
    "has_kitchen": "kitchen",
    "has_ac": "air conditioning",
    "has_gym": "gym|fitness",
    "has_parking": "parking",
    "has_pool": "pool",
    "has_washer": "washer",
    "has_dryer": "dryer",
    "has_elevator": "elevator",
    "has_doorman": "doorman",
    "has_pets_allowed": "pets allowed",
}
# Older feature notebook variant: adds a dishwasher flag.
KEY_AMENITIES_WITH_DISHWASHER = {
    "has_wifi": "wifi|internet",
    "has_kitchen": "kitchen",
    "has_ac": "air conditioning",
    "has_gym": "gym|fitness",
    "has_parking": "parking",
    "has_pool": "pool",
    "has_dishwasher": "dishwasher",
    "has_washer": "washer",
    "has_dryer": "dryer",
    "has_elevator": "elevator",
    "has_doorman": "doorman",
    "has_pets_allowed": "pets allowed",
}
RESPONSE_TIME_MAP = {"within an hour": 1, "within a few hours": 2, "within a day": 3, "a few days or more": 4}
# Room type codes of the feature builder; unknown -> 1.
ROOM_TYPE_MAP = {"Shared room": 0, "Hotel room": 1, "Private room": 2, "Entire home/apt": 3}
# Room type codes of the sentiment determinants.
ROOM_TYPE_DETERMINANT_MAP = {"Entire home/apt": 3, "Private room": 2, "Shared room": 1, "Hotel room": 2}
# Room code decoding of the question tools (unknown -> 'Unknown').
ROOM_CODE_DECODE = {1: "Shared room", 2: "Private room", 3: "Entire home", 4: "Hotel room"}
# Room code decoding of the dashboard.
ROOM_CODE_LABEL = {0: "Shared room", 1: "Hotel room", 2: "Private room", 3: "Entire home/apt"}
MONTH_NAMES = {1: "Jan", 2: "Feb", 3: "Mar", 4: "Apr", 5: "May", 6: "Jun",
               7: "Jul", 8: "Aug", 9: "Sep", 10: "Oct", 11: "Nov", 12: "Dec"}
BOROUGH_LETTERS = {"B": "Brooklyn", "M": "Manhattan", "Q": "Queens", "K": "Brooklyn",
                   "S": "Staten Island", "X": "Bronx"}
# Property type simplification: first matching substring wins, else 'Other'.
PROPERTY_RULES = [("entire", "Entire home"), ("private", "Private room"),
                  ("shared", "Shared room"), ("hotel", "Hotel room")]
HOST_FEATURES = ("is_superhost", "host_response_rate_f", "host_acceptance_rate_f",
                 "host_response_time_ord", "host_identity_verified_f", "has_license")
EARTH_RADIUS_KM = 6371.0
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_price(c) -> Column:
    """F1: '$1,087.00' -> 1087.0; anything unparsable -> null."""
    return _try_double(F.regexp_replace(_c(c), r"[$,]", ""))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def to_number(c) -> Column:
    """text -> double, bad -> null."""
    return _try_double(_c(c))


def parse_percent(c) -> Column:
    """'97%' -> 0.97."""
    return _try_double(F.trim(F.regexp_replace(_c(c), "%", ""))) / F.lit(100.0)


def parse_bathrooms(c) -> Column:
    """any text containing 'half' -> 0.5, else first [0-9.]+ run, else null."""
    low = F.lower(_c(c))
    num = _try_double(F.nullif(F.regexp_extract(low, r"[0-9.]+", 0), F.lit("")))
    return F.when(low.contains("half"), F.lit(0.5)).otherwise(num)


def count_quoted(c) -> Column:
    """number of "quoted" items in a JSON-list text; null -> 0."""
    return F.coalesce(F.regexp_count(_c(c), F.lit('"[^"]+"')), F.lit(0))


def json_array_len(c) -> Column:
    """length of a JSON array text; null or bad JSON -> 0."""
    return F.coalesce(F.json_array_length(_c(c)), F.lit(0))


def keyword_flag(c, pattern: str) -> Column:
    """1 if the lower-cased text matches the regex, null -> 0."""
    return F.coalesce(F.lower(_c(c)).rlike(pattern), F.lit(False)).cast("int")


def keyword_flags(c, patterns: dict | None = None) -> dict[str, Column]:
    return {k: keyword_flag(c, p) for k, p in (patterns or KEY_AMENITIES).items()}


def lookup(c, mapping: dict, default=None) -> Column:
    """Literal map lookup; missing -> default (null when not given)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[_c(c)]
    return out if default is None else F.coalesce(out, F.lit(default))


def ordinal_map(c, mapping: dict | None = None) -> Column:
    """F8: lower-cased key -> ordinal (response time); unknown -> null."""
    return lookup(F.lower(_c(c)), mapping or RESPONSE_TIME_MAP)


def ordinal_default(c, mapping: dict | None = None, default=1) -> Column:
    """key -> code with default (room type: unknown -> 1)."""
    return lookup(c, mapping or ROOM_TYPE_MAP, default)


def tf_flag(c) -> Column:
    """F10 first form: 't' -> 1 else 0 (null -> 0)."""
    return F.coalesce((_c(c) == "t").cast("int"), F.lit(0))


def tf_map(c) -> Column:
    """F10 second form: {'t': 1, 'f': 0}, others -> null."""
    return F.when(_c(c) == "t", 1).when(_c(c) == "f", 0)


def presence_flag(c) -> Column:
    """F11."""
    return _c(c).isNotNull().cast("int")


def simplify_category(c, rules=PROPERTY_RULES, other="Other") -> Column:
    """ordered substring rules over the lower-cased text, null -> Other."""
    low = F.lower(_c(c))
    out = F.when(_c(c).isNull(), F.lit(other))
    for needle, label in rules:
        out = out.when(low.contains(needle), F.lit(label))
    return out.otherwise(F.lit(other))


def feature_category(c) -> Column:
    """feature name -> display category (9 ordered rules)."""
    n = _c(c)
    return (F.when(n.isin("month", "seasonal_index"), "Seasonal")
            .when(n.startswith("boro_"), "Borough")
            .when(n.startswith("prop_"), "Property type")
            .when(n.contains("subway") | n.contains("lirr"), "Transit")
            .when(n.contains("poi") | n.contains("crime"), "Spatial (POI/crime)")
            .when(n.isin(*HOST_FEATURES), "Host")
            .when(n.startswith("has_") | (n == "amenity_count"), "Amenities")
            .when(n.contains("review"), "Reviews")
            .otherwise("Property"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance, atan2 form, R = 6371.0 km."""
    la1, lo1, la2, lo2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def month_name(c) -> Column:
    """Month number -> 'Jan'..'Dec'."""
    return lookup(c, MONTH_NAMES)


def label_map(c, mapping: dict, unknown: str | None = "Unknown") -> Column:
    """integer/letter code -> label, unknown -> 'Unknown'."""
    return lookup(c, mapping, unknown)


def sentiment_label(c) -> Column:
    """F18."""
    return F.when(_c(c) > 0, "positive").when(_c(c) < 0, "negative").otherwise("neutral")


def segment_listing(positive_ratio) -> Column:
    """F19."""
    r = _c(positive_ratio)
    return F.when(r >= 0.9, "satisfactory").when(r >= 0.5, "moderate").otherwise("dissatisfactory")


def cut_bins(c, edges: list, labels: list) -> Column:
    """right-closed bins (lo, hi]; outside -> null."""
    x = _c(c)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def cut_order(c, edges: list) -> Column:
    """Bin order (0-based) of ``cut_bins``; outside -> null."""
    x = _c(c)
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def minmax_clip(c, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo) clipped to [0, 1]; constant column or null -> 0.5."""
    x = _c(c)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return F.when(hi == lo, F.lit(0.5)).when(x.isNull(), F.lit(0.5)).otherwise(scaled)


def abs_error(t, p) -> Column:
    return F.abs(_c(t) - _c(p))


def pct_error(t, p) -> Column:
    """absolute error as a percentage of the true value."""
    return abs_error(t, p) / _c(t) * 100


def short_id(c) -> Column:
    """'...' + last 6 characters of the id text."""
    s = _c(c).cast("string")
    return F.concat(F.lit("..."), F.substring(s, -6, 6))


def split_words(c) -> Column:
    """whitespace split without empty tokens."""
    return F.array_compact(F.filter(F.split(F.trim(_c(c)), r"\s+"), lambda w: w != ""))


def truncate_words(c, n: int) -> Column:
    """first n whitespace-separated words."""
    return F.array_join(F.slice(split_words(c), 1, n), " ")


def strip_prefix(c, prefix: str) -> Column:
    """F27."""
    return F.regexp_replace(_c(c), "^" + prefix, "")


def row_sum(cols: list) -> Column:
    """Row-wise sum over columns."""
    return reduce(lambda a, b: a + b, [_c(x) for x in cols])


def row_count_above(cols: list, t: float) -> Column:
    """Number of columns above a threshold."""
    return reduce(lambda a, b: a + b, [(_c(x) > t).cast("int") for x in cols])


def first_max_label(cols: list, labels: list | None = None) -> Column:
    """Label of the first column holding the row maximum."""
    labels = labels or cols
    g = F.greatest(*[_c(x) for x in cols]) if len(cols) > 1 else _c(cols[0])
    out = None
    for col, lab in zip(cols, labels):
        cond = _c(col) == g
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out
