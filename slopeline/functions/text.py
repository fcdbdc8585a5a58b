"""Column functions of text, time and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_id(aoi: Column) -> Column:
    """An id such as new-delhi or new_delhi as a title."""
    return F.concat_ws(" ", F.transform(F.split(aoi, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))))


def day_label(day: Column, today: Column) -> Column:
    """TODAY, TOMORROW, or the weekday's three letters."""
    ahead = F.datediff(day, today)
    return F.when(ahead == 0, "TODAY").when(ahead == 1, "TOMORROW").otherwise(F.upper(F.date_format(day, "EEE")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as a long."""
    # The hash's offset and prime.
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")) % F.lit(1 << 32))


def client_key(forwarded: Column, host: Column) -> Column:
    """The last named hop of a forwarding header, else the host, else unknown."""
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda h: F.trim(h)), lambda h: h != "")
    return F.coalesce(F.try_element_at(hops, F.lit(-1)), F.nullif(host, F.lit("")), F.lit("unknown"))


def caveat(label: Column, key: Column, note: str = " (modelled)") -> Column:
    """A note behind labels that speak of soil moisture, once."""
    about = F.contains(F.lower(F.concat_ws(" ", key, label)), F.lit("soil moisture")) | F.contains(F.lower(key), F.lit("soil_moisture"))
    return F.when(about & ~F.endswith(label, F.lit(note)), F.concat(label, F.lit(note))).otherwise(label)


def top_drivers(parts: Column, n: int = 2) -> Column:
    """The weightiest of (label, contribution) structs as one sentence."""
    order = lambda a, b: F.when(F.abs(a["x"]) > F.abs(b["x"]), -1).when(F.abs(a["x"]) < F.abs(b["x"]), 1).when(a["label"] < b["label"], -1).otherwise(1)
    return F.concat_ws(", ", F.transform(F.slice(F.array_sort(parts, order), 1, n), lambda p: F.concat(p["label"], F.lit(" ("), F.when(p["x"] >= 0, "+").otherwise("-"), F.abs(F.round(p["x"] * 100)).cast("long").cast("string"), F.lit("%)"))))


# What is recommended for a report.
HOLD = "Hold for manual evidence review; the photo quality or hazard relevance is too low for operational use."
LINK = "Link this evidence to %s and verify whether conditions have worsened before dispatching another team."
HIGH = "High-priority DDMA review: %s. Human authorisation is required before public action."
RESTRICT = "restrict access and dispatch an immediate field verification"
CLOSURE = "verify the closure immediately and update DDMA routing/road-isolation inputs"
PRIORITISE = "Prioritise field verification during the current operational shift and compare the location with the live risk map."
ACKNOWLEDGE = "Acknowledge the citizen report and queue it for routine field verification; do not alter alerts until an officer confirms it."


def recommendation(category: Column, urgency: Column, quality: Column, relevance: Column, duplicate: Column, hotspots: Column) -> Column:
    """What to do with a report: the first rule that holds."""
    return (
        F.when((relevance < 0.35) | (quality < 0.25), HOLD)
        .when(duplicate.isNotNull(), F.format_string(LINK, duplicate.cast("string")))
        .when(urgency >= 70, F.format_string(HIGH, F.when(category == "Blocked road", CLOSURE).otherwise(RESTRICT)))
        .when((urgency >= 45) | (hotspots >= 4), PRIORITISE)
        .otherwise(ACKNOWLEDGE)
    )


def dynamic_cost(base: Column, depth: Column, slope: Column, clearance: float) -> Column:
    """Seconds to pass an edge: more with flooding and slope; null where it can't be passed."""
    wet, steep = depth / (clearance - depth + 0.05), F.greatest(slope - 18, F.lit(0.0)) / 18
    return F.when(depth < clearance, base * (1 + 4 * wet * wet + 2.5 * steep))
