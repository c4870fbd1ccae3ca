"""Scalar column expressions. All stay inside generated code; none is a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogue import TIERS

C = Column


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- patches, ladder, durations ----------------------------------------------------------------

def patch_key(patch: Column | str) -> Column:
    """'16.9' as a struct that sorts numerically."""
    parts = F.split(col(patch), r"\.")
    return F.struct(parts[0].cast("int").alias("major"),
                    F.coalesce(F.get(parts, F.lit(1)), F.lit("0")).cast("int").alias("minor"))


def aligned_patch(patch: Column | str) -> Column:
    """Game versions run 10 behind patch names: both become the patch name's numbers."""
    k = patch_key(patch)
    return F.struct(F.when(k["major"] >= 20, k["major"]).otherwise(k["major"] + 10).alias("major"),
                    k["minor"].alias("minor"))


def patch_number(patch: Column | str) -> Column:
    """Running number of a patch, 24 to a season."""
    k = patch_key(patch)
    return k["major"] * 24 + k["minor"]


def tier_bucket(tier: Column | str) -> Column:
    """The three apex tiers share one bucket."""
    t = F.upper(col(tier))
    return F.when(t.isin("MASTER", "GRANDMASTER", "CHALLENGER"), "MASTER_PLUS").otherwise(t)


def ladder_score(tier: Column | str, division: Column | str, lp: Column | str) -> Column:
    """400 points a tier, 100 a division, plus LP; apex tiers continue from 2800."""
    t = F.upper(col(tier))
    below_apex = F.array(*[F.lit(x) for x in TIERS[:7]])
    at = F.array_position(below_apex, t)
    div = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in ("IV", "III", "II", "I")]),
                                      F.coalesce(col(division), F.lit("IV"))), F.lit(1))
    div = F.when(div == 0, 1).otherwise(div)
    return (F.when(at > 0, 400 * (at - 1) + 100 * (div - 1) + col(lp)).otherwise(F.lit(2800) + col(lp))).cast("int")


def ladder_label(score: Column | str) -> Column:
    """The inverse of ``ladder_score`` as text."""
    s = F.round(col(score)).cast("int")
    low = F.greatest(s, F.lit(0))
    tier = F.element_at(F.array(*[F.lit(x.title()) for x in TIERS[:7]]),
                        F.least(F.floor(low / 400), F.lit(6)).cast("int") + 1)
    division = F.element_at(F.array(*[F.lit(d) for d in ("IV", "III", "II", "I")]),
                            F.floor(F.pmod(low, F.lit(400)) / 100).cast("int") + 1)
    return (F.when(s >= 2800, F.concat(F.lit("Master+ "), (s - 2800).cast("string"), F.lit(" LP")))
            .otherwise(F.concat(tier, F.lit(" "), division, F.lit(" "),
                                F.pmod(low, F.lit(100)).cast("string"), F.lit(" LP"))))


def duration_seconds(duration: Column | str, end_stamp: Column | str) -> Column:
    """Seconds when the end stamp exists, milliseconds before it was introduced."""
    d = col(duration)
    return F.when(col(end_stamp).isNotNull(), d).otherwise(F.floor(d / 1000)).cast("int")


# -- map --------------------------------------------------------------------------------------

# Map size, zone borders, lane centre lines.
MAP_X, MAP_Y = 14870.0, 14980.0
BASE, EDGE, BAND = 0.26, 0.15, 0.07
LANES = {
    "top": ((1100.0, 3500.0), (1100.0, MAP_Y - 1100), (MAP_X - 3500, MAP_Y - 1100)),
    "mid": ((3000.0, 3000.0), (MAP_X - 3000, MAP_Y - 3000)),
    "bot": ((3500.0, 1100.0), (MAP_X - 1100, 1100.0), (MAP_X - 1100, MAP_Y - 3500)),
}
LANE_WIDTH = 1000.0


def _zone_of_fraction(u: Column, v: Column) -> Column:
    return (F.when((u < BASE) & (v < BASE), "blue_base").when((u > 1 - BASE) & (v > 1 - BASE), "red_base")
            .when((u < EDGE) | (v > 1 - EDGE), "top_lane").when((v < EDGE) | (u > 1 - EDGE), "bot_lane")
            .when(F.abs(u - v) < BAND, "mid_lane").when(F.abs(u + v - 1) < BAND, "river")
            .when(u + v < 1, "blue_jungle").otherwise("red_jungle"))


def zone(x: Column | str, y: Column | str) -> Column:
    return _zone_of_fraction(col(x) / MAP_X, col(y) / MAP_Y)


def own_fraction(x: Column | str, y: Column | str, team: Column | str) -> tuple[Column, Column]:
    """Position as fractions of the map, seen from the team's side (red is reflected over the river)."""
    u, v, red = col(x) / MAP_X, col(y) / MAP_Y, col(team) == 200
    return F.when(red, 1 - v).otherwise(u), F.when(red, 1 - u).otherwise(v)


def own_zone(x: Column | str, y: Column | str, team: Column | str) -> Column:
    z = _zone_of_fraction(*own_fraction(x, y, team))
    return F.regexp_replace(F.regexp_replace(z, "^blue_", "own_"), "^red_", "enemy_")


def readable_zone(zone_name: Column | str, team: Column | str) -> Column:
    """'red_jungle' for a blue player reads 'enemy jungle'."""
    z, blue = col(zone_name), col(team) == 100
    side = F.when(z.startswith("blue_"), blue).when(z.startswith("red_"), ~blue)
    kind = F.regexp_extract(z, "(base|jungle)$", 1)
    return F.when(side.isNull(), F.translate(z, "_", " ")).otherwise(
        F.concat(F.when(side, "own ").otherwise("enemy "), kind))


def segment_distance(x: Column, y: Column, a: tuple, b: tuple) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    along = ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(x - a[0] - t * dx, 2) + F.pow(y - a[1] - t * dy, 2))


def path_distance(x: Column, y: Column, path: Sequence[tuple]) -> Column:
    parts = [segment_distance(x, y, a, b) for a, b in zip(path, path[1:])]
    return F.least(*parts) if len(parts) > 1 else parts[0]


def lane_at(x: Column | str, y: Column | str) -> Column:
    """The lane a position is on (nearest centre line within the lane width, outside both bases)."""
    x, y = col(x).cast("double"), col(y).cast("double")
    u, v = x / MAP_X, y / MAP_Y
    base = ((u < BASE) & (v < BASE)) | ((u > 1 - BASE) & (v > 1 - BASE))
    near = F.array_min(F.array(*[
        F.struct(path_distance(x, y, p).alias("d"), F.lit(-i).alias("o"), F.lit(n).alias("lane"))
        for i, (n, p) in enumerate(LANES.items())]))
    return F.when(~base & (near["d"] <= LANE_WIDTH), near["lane"])


# -- timers -----------------------------------------------------------------------------------

# Base death timer in seconds by level.
RESPAWN = (6, 6, 8, 8, 10, 12, 16, 21, 26, 32.5, 35, 37.5, 40, 42.5, 45, 47.5, 50, 52.5)


def respawn_seconds(level: Column | str, minute: Column | str) -> Column:
    """Death timer: the level's base, growing piecewise with the minute."""
    m = col(minute).cast("double")
    base = F.element_at(F.array(*[F.lit(float(s)) for s in RESPAWN]),
                        F.greatest(F.lit(1), F.least(F.lit(18), col(level))).cast("int"))
    extra = (F.when(m < 15, 0.0).when(m < 30, 0.0085 * (m - 15)).when(m < 45, 0.1275 + 0.006 * (m - 30))
             .otherwise(F.least(F.lit(0.5), 0.2175 + 0.029 * (m - 45))))
    return base * (1 + extra)


def next_spawn(last_taken: Column | str, first: float, again: float | None) -> Column:
    """When an objective is next up: its first spawn, or a fixed time after it was last taken."""
    last = col(last_taken)
    return F.when(last.isNull(), F.lit(first)).otherwise(last + again if again is not None else F.lit(None))


def minutes_until(spawn: Column, now: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), spawn - col(now)))


# -- buckets ----------------------------------------------------------------------------------

def bucket(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open buckets [edge, next edge); ``labels`` has one more entry than ``edges``."""
    v = col(value)
    out = F.when(v < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:]):
        out = out.when(v < e, label)
    return out.when(v.isNotNull(), labels[-1])


# Bucket edges and labels.
LENGTH_EDGES = (1200, 1500, 1800, 2100, 2400)
LENGTH_LABELS = ("under 20", "20-25", "25-30", "30-35", "35-40", "40+")
LEAD_EDGES = (-5000, -3000, -1500, -500, 500, 1500, 3000, 5000)
LEAD_LABELS = ("5k+ behind", "3-5k behind", "1.5-3k behind", "0.5-1.5k behind", "even",
               "0.5-1.5k ahead", "1.5-3k ahead", "3-5k ahead", "5k+ ahead")
COMFORT_EDGES = (1, 3, 10, 30)
COMFORT_LABELS = ("0", "1-2", "3-9", "10-29", "30+")


def stage(minute: Column | str) -> Column:
    """Ten-minute stage of a game, the last one open."""
    return F.least(F.floor(col(minute) / 10), F.lit(3)).cast("int")


# -- scores -----------------------------------------------------------------------------------

def percentile_in(value: Column | str, p10, p25, p50, p75, p90, sd) -> Column:
    """Where a value stands in a distribution stored as five quantiles.

    On a plateau of equal quantiles it is the plateau's middle, between quantiles it is linear, outside it
    continues with the neighbouring gap (15 points to a gap) and stops at 1 and 99.
    """
    v = col(value)
    q = [col(c) for c in (p10, p25, p50, p75, p90)]
    at = (10.0, 25.0, 50.0, 75.0, 90.0)
    sd = col(sd)
    tie_low = F.coalesce(*[F.when(v == c, F.lit(p)) for c, p in zip(q, at)])
    tie_high = F.coalesce(*[F.when(v == c, F.lit(p)) for c, p in reversed(list(zip(q, at)))])

    def gap(hi, lo):
        return F.when(hi - lo != 0, hi - lo).when(sd != 0, sd).otherwise(F.lit(1.0))

    out = (F.when(tie_low.isNotNull(), (tie_low + tie_high) / 2)
           .when(v < q[0], F.greatest(F.lit(1.0), 10 - 15 * (q[0] - v) / gap(q[1], q[0])))
           .when(v > q[4], F.least(F.lit(99.0), 90 + 15 * (v - q[4]) / gap(q[4], q[3]))))
    for i in range(4):
        inside = (v > q[i]) & (v < q[i + 1])
        out = out.when(inside, at[i] + (at[i + 1] - at[i]) * (v - q[i]) / F.when(inside, q[i + 1] - q[i]))
    return out.when(v.isNotNull(), F.lit(50.0))


def goodness(percentile: Column | str, higher_is_better: Column | str) -> Column:
    p = col(percentile)
    return F.when(col(higher_is_better), p).otherwise(100 - p)


def zscore(value: Column | str, mean: Column | str, sd: Column | str) -> Column:
    return F.when(col(sd) != 0, (col(value) - col(mean)) / col(sd)).otherwise(F.lit(0.0))


def ratio(num: Column | str, den: Column | str, otherwise: float = 0.0) -> Column:
    """Guarded division."""
    d = col(den)
    return F.when(d != 0, col(num) / d).otherwise(F.lit(otherwise))


def shrunk_rate(wins: Column | str, games: Column | str, k: float = 40.0, prior: Column | float = 0.5) -> Column:
    """A rate pulled to ``prior`` as if ``k`` games at it were added."""
    return (col(wins) + (F.lit(k) * prior)) / (col(games) + k)


def clear(gap: Column, se: Column, n: Column, min_n: int, k: float = 2.0) -> Column:
    """A difference counts beyond k standard errors and from a minimum of cases."""
    return F.coalesce((n >= min_n) & (F.abs(gap) > k * se), F.lit(False))


def logit(p: Column | str) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), col(p)))
    return F.ln(q / (1 - q))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def points(x: Column | str) -> Column:
    """A log-odds change as percentage points near an even game."""
    return 100 * (sigmoid(x) - 0.5)


# -- builds and text --------------------------------------------------------------------------

def first_maxed(order: Column | str, ranks: int = 5, letters: Sequence[str] = ("Q", "W", "E")) -> Column:
    """The letter that reaches ``ranks`` occurrences first."""
    first = F.array_min(F.filter(F.array(*[
        F.struct(_nth_position(order, k, ranks).alias("at"), F.lit(k).alias("k")) for k in letters]),
        lambda s: s["at"].isNotNull()))
    return first["k"]


def _nth_position(order: Column | str, letter: str, n: int) -> Column:
    text = F.coalesce(col(order), F.lit(""))
    chars = F.split(text, "")
    where = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
                     lambda i: F.substring(text, i, F.lit(1)) == letter)
    return F.get(where, F.lit(n - 1))


def max_order(order: Column | str, letters: Sequence[str] = ("Q", "W", "E"), seen: int | None = None, points: int = 5, least: int = 9) -> Column:
    """Letters in the order they reach ``points`` points, then the others by how many they have.

    ``seen`` looks at the first level-ups only; null below ``least`` of them."""
    text = col(order) if seen is None else F.substring(col(order), 1, seen)

    def place(i: int, letter: str) -> Column:
        reached = _nth_position(text, letter, points)
        has = F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
        return F.struct(reached.isNull().alias("late"), F.coalesce(reached, F.lit(0)).alias("at"), (-has).alias("short"), F.lit(i).alias("i"), F.lit(letter).alias("letter"))

    ordered = F.array_sort(F.array(*[place(i, k) for i, k in enumerate(letters)]))
    return F.when(F.length(text) >= least, F.array_join(F.transform(ordered, lambda s: s["letter"]), ""))


def nth_distinct(items: Column | str, n: int) -> Column:
    """The n-th different item in purchase order (from 1)."""
    return F.get(F.array_distinct(col(items)), F.lit(n - 1))


def core_items(items: Column | str, n: int = 3) -> Column:
    unique = F.array_distinct(col(items))
    return F.when(F.size(unique) >= n, F.slice(unique, 1, n))


def starting_set(items: Column | str, seconds: Column | str, until: int = 60) -> Column:
    """What was bought in the first minute, as a sorted set key; null if nothing."""
    early = F.filter(F.arrays_zip(col(items).alias("i"), col(seconds).alias("s")), lambda p: p["s"] <= until)
    bought = F.array_sort(F.transform(early, lambda p: p["i"]))
    return F.when(F.size(bought) > 0, bought)


def plain_name(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(name), "[^A-Za-z0-9]", ""))


# "E3" and "2v2" are not numbers; a number has plain digits, or groups of three after the first comma.
NOT_NUMBERS = r"(?i)\b(?:e\d+|\d+v\d+)\b"
NUMBER = r"(?<![\w.])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def written_numbers(text: Column | str) -> Column:
    """Numbers in a text with the decimals they are written with: array<struct<raw, value, decimals>>."""
    found = F.regexp_extract_all(F.regexp_replace(col(text), NOT_NUMBERS, " "), F.lit(f"({NUMBER})"), F.lit(1))

    def parse(raw):
        clean = F.replace(raw, F.lit(","), F.lit(""))
        dot = F.instr(clean, ".")
        return F.struct(raw.alias("raw"), clean.cast("double").alias("value"),
                        F.when(dot > 0, F.length(clean) - dot).otherwise(0).cast("int").alias("decimals"))

    return F.transform(found, parse)


def bit(mask: Column | str, i: int) -> Column:
    return F.getbit(col(mask), F.lit(i)) == 1


def md5_half(key: Column | str) -> Column:
    """0 or 1 by the lowest bit of the first md5 byte: a stable split in two."""
    return F.conv(F.substring(F.md5(col(key).cast("string").cast("binary")), 1, 2), 16, 10).cast("int") % 2


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    z, half = F.atanh(r), F.lit(1.96) / F.sqrt(n - 3)
    return F.tanh(z - half), F.tanh(z + half)
