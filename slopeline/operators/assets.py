"""Assets, cards and samples: survival windows, cascade order, citations, positions, cards and CAP alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk as R
from . import joins as J


def survival_hours(label: Column, fuel_l: Column, load_kw: Column, battery_ah: Column, stored: Column, elapsed: Column) -> Column:
    """Hours an asset lasts without supply: hospitals by fuel and load, telecom towers by battery, others as stored."""
    # Litres per kWh; volts, depth of discharge and load of a tower.
    left = lambda hours: F.bround(F.greatest(F.lit(0.0), hours - F.greatest(F.lit(0.0), elapsed)), 2)
    fuel = F.when((fuel_l > 0) & (load_kw > 0), left(fuel_l / (0.28 * load_kw))).otherwise(F.coalesce(stored, F.lit(0.0)))
    tower = F.when(battery_ah > 0, left(48.0 * battery_ah * 0.80 / 1000.0 / 2.75)).otherwise(F.coalesce(stored, F.lit(0.0)))
    return F.when(label == "Hospital", fuel).when(label == "TelecomTower", tower).otherwise(F.coalesce(stored, F.lit(0.0)))


def cascade_order(impacted: DataFrame, trigger: str = "trigger") -> DataFrame:
    """Impacted assets with their place: nearest hop first, then the shortest survival, then the largest exposure."""
    order = [F.col("hop"), F.col("survival"), F.desc("exposure"), F.col("asset")]
    return impacted.withColumn("place", F.row_number().over(Window.partitionBy(trigger).orderBy(*order)))


def gate(recommendations: DataFrame, allowed: DataFrame, answer: str = "answer_id") -> tuple[DataFrame, DataFrame]:
    """(passing recommendations with their new rank, one status per answer).

    ``recommendations``: answer_id, rank, target, cited (array of node ids); ``allowed``: node. One without
    citations, or that names a node which is not allowed, is blocked; an answer that loses all is redacted.
    """
    named = F.array_union("cited", F.array("target"))
    each = recommendations.select(answer, "rank", F.explode(named).alias("node")).join(allowed.select("node").distinct().withColumn("_ok", F.lit(True)), "node", "left")
    ok = each.groupBy(answer, "rank").agg(F.bool_and(F.col("_ok").isNotNull()).alias("ok"))
    told = recommendations.join(ok, [answer, "rank"]).withColumn("ok", F.col("ok") & (F.size("cited") > 0))
    passed = told.where("ok").withColumn("new_rank", F.row_number().over(Window.partitionBy(answer).orderBy("rank"))).drop("ok")
    status = told.groupBy(answer).agg(F.count_if(~F.col("ok")).alias("blocked"), F.count_if("ok").alias("verified"))
    # States of a gated answer.
    return passed, status.withColumn("status", F.when(F.col("verified") > 0, "VERIFIED").when(F.col("blocked") > 0, "GUARDRAIL_REDACTED").otherwise("INSUFFICIENT_GRAPH_EVIDENCE"))


def nearest_per_kind(places: DataFrame, targets: DataFrame, cell: float = 0.05) -> DataFrame:
    """(place_id, kind, target_id): the nearest target of each kind in degrees; a kind without targets is left out.

    ``places``: place_id, lon, lat; ``targets``: target_id, kind, lon, lat. Kinds are few.
    """
    out = None
    for (kind,) in targets.select("kind").distinct().orderBy("kind").collect():  # hospitals, shelters and the like
        own = targets.where(F.col("kind") == kind).select("target_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
        near = J.nearest(places, own, key="place_id", site="target_id", cell=cell).select("place_id", F.lit(kind).alias("kind"), "target_id")
        out = near if out is None else out.unionByName(near)
    return out


def positions(villages: DataFrame, surveyed: DataFrame, exposure: DataFrame, centre: tuple[float, float], radius: float = 0.05) -> DataFrame:
    """(village_id, lon, lat, position_is_real): the surveyed place, else the exposure layer's, else a steady
    place on a ring around the centre by the hash of the id."""
    from ..functions.text import fnv1a

    a = surveyed.select("village_id", F.struct("lon", "lat").alias("_a"))
    b = exposure.select("village_id", F.struct("lon", "lat").alias("_b"))
    angle = F.radians((fnv1a(F.col("village_id").cast("string")) % 360).cast("double"))
    ring = F.struct((centre[0] + radius * F.cos(angle)).alias("lon"), (centre[1] + radius * F.sin(angle)).alias("lat"))
    out = villages.select("village_id").join(a, "village_id", "left").join(b, "village_id", "left")
    found = F.coalesce("_a", "_b")
    return out.select("village_id", F.coalesce(found, ring).alias("p"), found.isNotNull().alias("position_is_real")).select("village_id", "p.lon", "p.lat", "position_is_real")


# Classes of land cover in the order of the model's columns.
LAND_COVER = ("tree_cover", "shrubland", "grassland", "cropland", "built_up", "bare_sparse_vegetation", "snow_ice", "water", "herbaceous_wetland", "mangroves", "moss_lichen")
NUMERIC = ("elevation_m", "elevation_min_m", "elevation_max_m", "slope_mean_deg", "slope_max_deg", "twi_mean", "relief_m", "dist_to_road_m", "plan_curvature", "profile_curvature", "dist_to_fault_km", "lithology_class")
_LOOSE = ("plan_curvature", "profile_curvature", "dist_to_fault_km", "lithology_class")


def model_features(cells: DataFrame) -> DataFrame:
    """cell_id and the model's 25 columns in order: numbers (texts that are none become null), the aspect as
    sine and cosine, and an indicator per class of land cover (all 0 without a class)."""
    number = lambda c: F.col(c).try_cast("double") if c in _LOOSE else F.col(c).cast("double")
    aspect = F.radians(F.col("aspect_mean_deg").cast("double"))
    hot = [F.coalesce((F.col("land_cover_class") == c).cast("double"), F.lit(0.0)).alias(f"land_cover_{c}") for c in LAND_COVER]
    return cells.select("cell_id", *[number(c).alias(c) for c in NUMERIC], F.sin(aspect).alias("aspect_sin"), F.cos(aspect).alias("aspect_cos"), *hot)


def edge_cost(length: Column, p_blocked: Column, slope: Column, alpha: float, beta: float) -> Column:
    return length * (1.0 + alpha * p_blocked + beta * F.coalesce(slope, F.lit(0.0)))


def evolved(p: Column, factor: Column) -> Column:
    """A probability on a forecast day."""
    return R.clamp01(p * (0.72 + 0.28 * factor))


def evolved_eps(eps: Column, p: Column, worst: Column) -> Column:
    """A priority on a forecast day: its own risk gives way to the worst of the day."""
    return R.clamp01(eps - 0.35 * p + 0.35 * worst)


def canonical_json(columns: dict[str, Column]) -> Column:
    """A compact JSON object with its keys in order and nulls kept: what payload hashes are taken of."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def query_tokens(query: Column) -> Column:
    """Distinct words of at least three letters, stripped of marks at both ends, in lower case."""
    words = F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, r"^[?,.:;!]+|[?,.:;!]+$", ""))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.lower(w)))


# What adds to a node's relevance.
WEIGHTY = ("FloodZone", "Substation", "Hospital", "Culvert", "Bridge")
TROUBLED = ("INUNDATED", "ON_DG_BACKUP", "OFFLINE", "ON_BATTERY")


def relevance(tokens: Column, haystack: Column, label: Column, status: Column) -> Column:
    """Half a point per token found in a node's text, and what its label and status add."""
    text = F.lower(haystack)
    hits = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    return 0.5 * hits + F.when(label.isin(*WEIGHTY), 0.45).otherwise(0.1) + F.when(status.isin(*TROUBLED), 0.35).otherwise(0.0)


# Texts of cards, and CAP's words by stage.
HEADLINES = {"GREEN": "Monitor — No Action Needed", "YELLOW": "Prepare to Evacuate", "ORANGE": "Evacuation Ready", "RED": "Evacuate Now"}
NO_ROUTE = "No usable shelter route available — contact DDMA for guidance"
CAP_WORDS = {"GREEN": ("Future", "Minor", "Possible", ("Monitor",)), "YELLOW": ("Expected", "Moderate", "Likely", ("Prepare", "Monitor")), "ORANGE": ("Expected", "Severe", "Likely", ("Prepare",)), "RED": ("Immediate", "Extreme", "Observed", ("Evacuate",))}


def _by_stage(stage: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[stage]


def cards(rows: DataFrame, carry: tuple[str, ...], valid_hours: int = 6) -> DataFrame:
    """Action cards of (village_id, stage, p_fail, issued_at, shelter_name, avoid): headline, reason, validity,
    what to carry; without a shelter the card says that there is no route."""
    at = F.date_format("issued_at", "yyyy-MM-dd'T'HH:mm:ss")
    reason = F.concat(F.initcap(F.lower("stage")), F.lit(": modelled failure probability "), F.bround(F.col("p_fail") * 100).cast("long").cast("string"), F.lit("% for the slopes above this village."))
    return rows.select(
        F.concat_ws("-", F.lit("card"), F.col("village_id").cast("string"), at).alias("alert_id"), "village_id", "stage", _by_stage(F.col("stage"), HEADLINES).alias("headline"), reason.alias("reason"),
        F.coalesce("shelter_name", F.lit(NO_ROUTE)).alias("shelter_name"), F.when(F.col("shelter_name").isNotNull(), F.col("avoid")).otherwise(F.array().cast("array<string>")).alias("roads_to_avoid"),
        F.array(*map(F.lit, carry)).cast("array<string>").alias("what_to_carry"), "issued_at", (F.col("issued_at") + F.make_dt_interval(hours=F.lit(valid_hours))).alias("valid_until"),
    )


def _xml(tag: str, text: Column) -> Column:
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(f"<{tag}>"), safe, F.lit(f"</{tag}>"))


def cap_alert(offset: str = "+05:30", sender: str = "slopeline-ews") -> Column:
    """A CAP 1.2 alert of a card row (see ``cards``) as XML text, times with the given offset."""
    stage = F.col("stage")
    at = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
    word = lambda i: _by_stage(stage, {k: v[i] for k, v in CAP_WORDS.items()})
    response = _by_stage(stage, {k: "".join(f"<responseType>{r}</responseType>" for r in v[3]) for k, v in CAP_WORDS.items()})
    avoid = F.array_join("roads_to_avoid", ", ")
    told = F.concat(F.lit("Go to "), "shelter_name", F.lit("."), F.when(avoid != "", F.concat(F.lit(" Avoid: "), avoid, F.lit("."))).otherwise(""), F.when(F.size("what_to_carry") > 0, F.concat(F.lit(" Carry: "), F.array_join("what_to_carry", ", "), F.lit("."))).otherwise(""))
    pair = lambda tag, name, value: F.concat(F.lit(f"<{tag}>"), _xml("valueName", F.lit(name)), _xml("value", value), F.lit(f"</{tag}>"))
    village = F.col("village_id").cast("string")
    info = F.concat(
        _xml("language", F.lit("en-US")), F.lit("<category>Geo</category><category>Safety</category><event>Landslide</event>"), response, _xml("urgency", word(0)), _xml("severity", word(1)), _xml("certainty", word(2)),
        _xml("effective", at("issued_at")), _xml("expires", at("valid_until")), _xml("headline", F.col("headline")), _xml("description", F.col("reason")), _xml("instruction", told), pair("parameter", "stage", stage),
        pair("parameter", "shelter_name", F.col("shelter_name")), F.lit("<area>"), _xml("areaDesc", F.concat(F.lit("Village "), village)), pair("geocode", "village_id", village), F.lit("</area>"),
    )
    head = F.concat(_xml("identifier", F.col("alert_id")), _xml("sender", F.lit(sender)), _xml("sent", at("issued_at")), F.lit("<status>Actual</status><msgType>Alert</msgType><scope>Public</scope>"))
    return F.concat(F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), head, F.lit("<info>"), info, F.lit("</info></alert>"))


def latest_edges(edges: DataFrame, order: str) -> DataFrame:
    """The newest row of every edge_id: an edge that comes again replaces the one before."""
    rest = [c for c in edges.columns if c != "edge_id"]
    return edges.groupBy("edge_id").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("edge_id", "_row.*")


def fold_report(rows: DataFrame) -> DataFrame:
    """(block, n_train, n_test, n_test_pos, skipped): per spatial block as the test set; a fold whose training rows
    have one class only is skipped. ``rows``: block, y."""
    b = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("y") > 0).alias("n_test_pos"))
    total = F.broadcast(b.agg(F.sum("n_test").alias("n"), F.sum("n_test_pos").alias("pos")))
    train, pos = F.col("n") - F.col("n_test"), F.col("pos") - F.col("n_test_pos")
    return b.join(total).select("block", train.alias("n_train"), "n_test", "n_test_pos", ((pos == 0) | (pos == train)).alias("skipped"))


def negatives_pool(cells: DataFrame, positives: DataFrame) -> DataFrame:
    """Cells (cell_id, has_terrain, in_holdout) that may serve as negatives: with terrain, outside the buffer, no positive."""
    return cells.where("has_terrain AND NOT in_holdout").join(positives.where("cell_id is not null").select("cell_id").distinct(), "cell_id", "left_anti")
