"""Text columns: normalising, keyword categories and event names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, FractionalType, MapType, StructType

from tripflow.functions.numeric import any_of

# ---- fixed values -----------------------------------------------------------
# Ordered keyword lists; the first category with a hit wins.
CATEGORY_KEYWORDS = {
    "traffic_accident": (
        "accident", "vehicle", "trailer", "diesel", "overturn", "jack-knifed", "incident",
        "fire department", "police", "truck", "crash", "collision",
    ),
    "construction": (
        "construction", "repair", "break", "paving", "sealing", "pole", "power line", "tree",
        "bridge", "sinkhole", "drainage", "pothole", "maintenance", "roadwork", "manhole",
        "debris", "structure", "sewer", "building",
    ),
    "weather": ("rain", "snow", "weather", "wet", "wind", "sun glare", "storm"),
    "cultural": (
        "event", "game", "match", "sport", "concert", "holiday", "basketball", "baseball",
        "hockey", "soccer", "festival",
    ),
}

WEEKDAY_WORDS = (
    "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
)

# Venue -> capacity; None where no capacity can be given.
VENUE_CAPACITY = {
    "madison square garden": 20000,
    "barclays center": 18000,
    "citi field": 45000,
    "arthur ashe stadium": 23000,
    "yankee stadium": 55000,
    "forest hills stadium": 14000,
    "flushing meadows corona park": 40000,
    "pier 17": 3500,
    "the beacon theatre": 2100,
    "radio city music hall": 6000,
    "central park": None,
}

# Event group -> words that decide it, in order of precedence.
EVENT_GROUPS = {
    "music": ("concert",),
    "sports": (
        "basketball", "baseball", "football", "soccer", "hockey", "tennis", "wrestling",
    ),
    "shows": ("show", "comedy", "podcast", "play/show"),
    "open_air_events": ("race event", "race", "parade", "fair", "skating", "festival"),
}
# ---- end of fixed values ----------------------------------------------------

BLANKS = "[ \\t\\r\\n\\f]"


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A{BLANKS}+|{BLANKS}+\\z", "")


def normalize(text: Column) -> Column:
    """Lower case, no outer spaces, punctuation to spaces, runs of blanks to one space.

    Letters, marks, digits and connectors of every script count as word characters.
    """
    lowered = F.trim(F.lower(text))
    spaced = F.regexp_replace(lowered, "[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]", " ")
    return F.regexp_replace(spaced, "\\s+", " ")


def keyword_category(text: Column) -> Column:
    """First category with one of its keywords in the text, else ``other``.

    Plain substring tests: an alternation of literals costs far more on long texts.
    """
    chain = None
    for category, words in CATEGORY_KEYWORDS.items():
        hit = any_of([text.contains(word) for word in words])
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain.otherwise("other")


def _after_last_bracket(text: Column) -> Column:
    """Text after the last closing bracket; null without one."""
    return F.when(F.instr(text, ")") > 0, F.substring_index(text, ")", -1))


def notice_text(description: Column) -> Column:
    """The form in which names and venues are looked for."""
    return F.lower(strip_blanks(description))


def event_name(text: Column) -> Column:
    """Name of the event in the ``notice_text`` of a closure notice.

    Either the text between the last ")" and the word "closures" (when the notice
    speaks of the police decision), or the text between the last ")" and the first
    weekday word. A notice of the first kind without a bracket is tried as the second.
    """
    is_notice = (F.instr(text, "closures are") > 0) & (F.instr(text, "nypd") > 0)
    notice_part = _after_last_bracket(F.substring_index(text, "closures", 1))
    notice_name = strip_blanks(F.regexp_replace(notice_part, "\\.+\\z", ""))
    positions = [F.nullif(F.instr(text, w), F.lit(0)) for w in WEEKDAY_WORDS]
    first_day = F.least(*positions)
    dated_part = _after_last_bracket(
        F.when(first_day.isNotNull(), F.substring(text, F.lit(1), first_day - 1))
    )
    dated_name = strip_blanks(F.regexp_replace(dated_part, "[, ]+\\z", ""))
    return F.nullif(
        F.when(is_notice & notice_part.isNotNull(), notice_name).otherwise(dated_name),
        F.lit(""),
    )


def venue_in(text: Column) -> Column:
    """First venue of the list named in the ``notice_text``, else null."""
    return F.coalesce(
        *[F.when(F.instr(text, venue) > 0, F.lit(venue)) for venue in VENUE_CAPACITY]
    )


def is_venue(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(*VENUE_CAPACITY), F.lit(False))


def venue_level(name: Column) -> Column:
    """3 from 20,000 seats, 2 from 10,000, else 1; null without a known capacity."""
    known = {v: c for v, c in VENUE_CAPACITY.items() if c is not None}
    capacity = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(name)
    )
    return F.when(capacity >= 20000, 3).when(capacity >= 10000, 2).when(capacity < 10000, 1)


def event_group(subtype: Column) -> Column:
    """Group whose word list holds a word of the subtype, else the subtype itself."""
    lowered = F.lower(subtype)
    words = F.split(strip_blanks(lowered), BLANKS + "+")
    chain = None
    for group, members in EVENT_GROUPS.items():
        hit = F.arrays_overlap(words, F.array(*[F.lit(m) for m in members]))
        chain = F.when(hit, group) if chain is None else chain.when(hit, group)
    return chain.otherwise(lowered)


def address_key(address: Column, borough: Column, zip_code: Column) -> Column:
    """Geocoding text: street before the first comma, borough, state and zip."""
    street = strip_blanks(F.split_part(strip_blanks(address), F.lit(","), F.lit(1)))
    area = F.initcap(strip_blanks(borough))
    code = F.split_part(zip_code.cast("string"), F.lit("."), F.lit(1))
    return F.concat(street, F.lit(", "), area, F.lit(", NY "), code)


def url_tail(url: Column) -> Column:
    """Last path segment; null for a missing or empty address."""
    return F.when(F.length(url) > 0, F.element_at(F.split(url, "/"), -1))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def nested_nan_to_null(value: Column, kind: DataType) -> Column:
    """The same for every float inside structs, arrays and the values of maps; the type stays as it is."""
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        return nan_to_null(value)
    if not _has_float(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: nested_nan_to_null(item, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, item: nested_nan_to_null(item, kind.valueType))
    fields = [nested_nan_to_null(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def _has_float(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, MapType):
        return _has_float(kind.valueType)
    if isinstance(kind, StructType):
        return any(_has_float(f.dataType) for f in kind.fields)
    return isinstance(kind, FractionalType) and not isinstance(kind, DecimalType)


def nans_to_nulls(df: DataFrame) -> DataFrame:
    """All columns without NaN, at any depth."""
    return df.select(*[nested_nan_to_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
