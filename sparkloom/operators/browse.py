"""The browse page: parameters, semi-join filters, facets, extents, orders, caps, and all of it for one request."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.names import folded

ROWS, OUTLINE, NEWEST = 5000, 100, 20
WIDTH, HEIGHT, PADDING = 1000, 600, 16


def param_int(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if re.fullmatch(r"[0-9]+", text) else None


def param_date(text: str | None) -> date | None:
    try:
        return date.fromisoformat((text or "").strip())
    except ValueError:
        return None


def param_year(text: str | None) -> int | None:
    found = re.match(r"\d{4}", (text or "").strip())
    return int(found[0]) if found else None


def param_chapter(texts: list[str]) -> int | None:
    return next((int(t.strip()) for t in texts if re.fullmatch(r"[0-9]+", t.strip())), None)


def has_filters(params: dict[str, str], chapter: object = None) -> bool:
    names = ("q", "platform", "date_from", "date_to", "actor", "role", "level", "verband")
    return chapter is not None or any((params.get(n) or "").strip() for n in names)


def years_to_dates(low: int, high: int, first: int, last: int) -> tuple[str, str]:
    """A range of years as dates; the whole extent clears the filter."""
    return ("", "") if (low, high) == (first, last) else (f"{low:04d}-01-01", f"{high:04d}-12-31")


def in_dates(posted: Column, start: str | None, end: str | None) -> Column:
    """Whole days, both included; a malformed bound is ignored; undated rows drop out if there is a bound."""
    day, found = F.to_date(posted), F.lit(True)
    if low := param_date(start):
        found = found & (day >= F.lit(low))
    if high := param_date(end):
        found = found & (day <= F.lit(high))
    return found


def having(rows: DataFrame, key: str, others: DataFrame, other_key: str, condition: Column | None = None) -> DataFrame:
    """Rows for which some row of ``others`` meets the whole ``condition``: a semi join, so no row is doubled."""
    chosen = others if condition is None else others.filter(condition)
    return rows.join(chosen.select(F.col(other_key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def options(values: DataFrame, key: str, used: DataFrame, used_key: str, label: str) -> DataFrame:
    """The values that occur at all, by case-folded label."""
    return having(values, key, used, used_key).orderBy(folded(F.col(label)), key)


def pinned_first(rows: DataFrame, label: str, pinned: str = "Bund") -> DataFrame:
    return rows.orderBy(F.col(label) != pinned, label)


def deferred(rows: DataFrame, heavy: tuple[str, ...]) -> DataFrame:
    """``rows`` without heavy columns (geometries), so that no scan below reads them; absent ones are no error."""
    return rows.drop(*heavy)


def recalled(rows: DataFrame, key: str, source: DataFrame, heavy: tuple[str, ...]) -> DataFrame:
    """The heavy columns of ``source`` again, for the rows that are left."""
    return rows.join(source.select(key, *heavy), key, "left")


def facet(table: DataFrame, filters: dict[str, object], query: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Equality facets and a contains-search, without regard to case, over some columns."""
    for name, value in filters.items():
        table = table.filter(F.col(name) == F.lit(value))
    if query:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower())), F.lit(False))
        table = table.filter(found)
    return table


def newest_first(rows: DataFrame, posted: str, key: str, undated_first: bool) -> DataFrame:
    time = F.col(posted).desc_nulls_first() if undated_first else F.col(posted).desc_nulls_last()
    return rows.orderBy(time, F.col(key).desc())


def capped(rows: DataFrame, cap: int = ROWS) -> tuple[DataFrame, bool]:
    """(the first ``cap`` rows of an ordered frame, whether there are more): one row more is asked for, no full count."""
    return rows.limit(cap), rows.limit(cap + 1).count() > cap


def extents(points: DataFrame, x: str, y: str) -> DataFrame:
    return points.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def year_bounds(rows: DataFrame, posted: str) -> DataFrame:
    return rows.agg(F.year(F.min(posted)).alias("first_year"), F.year(F.max(posted)).alias("last_year"))


def on_canvas(points: DataFrame, bounds: DataFrame, x: str, y: str) -> DataFrame:
    """``points`` with px and py on the canvas, y upwards, to one decimal. ``bounds`` is one row."""
    def scaled(v: str, low: str, high: str, size: int) -> Column:
        span = F.coalesce(F.nullif(F.col(high) - F.col(low), F.lit(0.0)), F.lit(1.0))
        return (F.col(v) - F.col(low)) / span * (size - 2 * PADDING) + PADDING

    joined = points.crossJoin(F.broadcast(bounds))
    return joined.withColumn("px", F.round(scaled(x, "x_min", "x_max", WIDTH), 1)).withColumn("py", F.round(HEIGHT - scaled(y, "y_min", "y_max", HEIGHT), 1)).drop(*bounds.columns)


def actors_in_view(bridge: DataFrame, visible: DataFrame, key: str, actor: str) -> DataFrame:
    """actor, n: visible rows of each originator, most first."""
    return having(bridge, key, visible, key).select(actor, key).distinct().groupBy(actor).agg(F.count(key).alias("n"))


def neighbour_pairs(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """a, b, distance: pairs nearer than ``radius``. Points meet by equality of grid cells: one side in its own cell, the other there
    and in four of the eight around, as two cells that touch need to meet once. Both sides are dealt by cell: the planner takes the
    repeated side for as small as the points and would broadcast it."""
    cell = lambda c: F.floor(F.col(c) / radius)
    own = points.select(F.col(key).alias("p"), F.col(x).alias("px"), F.col(y).alias("py"), cell(x).alias("i"), cell(y).alias("j"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = own.select(F.col("p").alias("q"), F.col("px").alias("qx"), F.col("py").alias("qy"), "i", "j", F.explode(steps).alias("s"))
    near = near.select("q", "qx", "qy", (F.col("i") + F.col("s.i")).alias("i"), (F.col("j") + F.col("s.j")).alias("j"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("same"))
    met = own.join(near.hint("merge"), ["i", "j"]).filter(F.when(F.col("same"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q")))
    far = F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")))
    return met.withColumn("distance", far).filter(F.col("distance") < radius).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def fit_box(points: DataFrame, x: str, y: str, padding: float = 40.0, least: float = 120.0) -> DataFrame:
    """left, top, width, height of the padded bounding box, widened to the canvas's proportions and kept inside it."""
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    w, h = F.greatest(F.col("x1") - F.col("x0") + 2 * padding, F.lit(least)), F.greatest(F.col("y1") - F.col("y0") + 2 * padding, F.lit(least * HEIGHT / WIDTH))
    width = F.least(F.greatest(w, h * WIDTH / HEIGHT), F.lit(float(WIDTH)))
    box = box.withColumn("width", width).withColumn("height", F.col("width") * HEIGHT / WIDTH)
    left = F.greatest(F.lit(0.0), F.least((F.col("x0") + F.col("x1") - F.col("width")) / 2, WIDTH - F.col("width")))
    top = F.greatest(F.lit(0.0), F.least((F.col("y0") + F.col("y1") - F.col("height")) / 2, HEIGHT - F.col("height")))
    return box.select(left.alias("left"), top.alias("top"), "width", "height")


def circle_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, action: keep, insert or remove."""
    a = old.select(F.col(key).alias("__old")).distinct()
    b = new.select(F.col(key).alias("__new")).distinct()
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "remove").otherwise("keep")
    return a.join(b, F.col("__old") == F.col("__new"), "full_outer").select(F.coalesce("__old", "__new").alias(key), action.alias("action"))


@dataclass(frozen=True)
class Tables:
    """What a browse request reads. ``evidence`` (id, posted_at, platform, text, x, y, fit_at), ``originators`` (id, actor), ``actors`` (actor,
    name, verband), ``positions`` (actor, role, level), ``mentions`` (id, path); ``tokens`` (id, token, pos), the search index of the
    evidence's texts: without it a search reads every text."""

    evidence: DataFrame
    originators: DataFrame
    actors: DataFrame
    positions: DataFrame
    mentions: DataFrame
    tokens: DataFrame | None = None


class TopicCloud:
    """All results of one request as DataFrames over one lazily filtered set."""

    def __init__(self, tables: Tables, params: dict[str, str], chapter: list[str] | None = None) -> None:
        self.tables, self.params, self.chapter = tables, params, chapter

    def filtered(self) -> DataFrame:
        from sparkloom.operators.search import search, search_by_index
        from sparkloom.operators.tree import prefixes

        t, p = self.tables, {k: (v or "").strip() for k, v in self.params.items()}
        rows = t.evidence.filter(F.col("fit_at").isNotNull()).filter(in_dates(F.col("posted_at"), p.get("date_from"), p.get("date_to")))
        if p.get("platform"):
            rows = rows.filter(F.col("platform") == p["platform"])
        if p.get("actor") and (actor := param_int(p["actor"])) is not None:
            rows = having(rows, "id", t.originators, "id", F.col("actor") == actor)
        wanted = [F.col(c) == p[c] for c in ("role", "level") if p.get(c)]
        if wanted:
            # both have to hold for the same position
            held = t.positions
            for w in wanted:
                held = held.filter(w)
            rows = having(rows, "id", having(t.originators, "actor", held, "actor"), "id")
        if p.get("verband"):
            rows = having(rows, "id", having(t.originators, "actor", t.actors, "actor", F.col("verband") == p["verband"]), "id")
        if self.chapter:
            below = t.mentions.select("id", F.explode(prefixes(F.col("path"))).alias("node"))
            rows = having(rows, "id", below, "id", F.col("node") == F.array(*[F.lit(x) for x in self.chapter]))
        if p.get("q"):
            found = search(t.evidence, "id", "text", p["q"]) if t.tokens is None else search_by_index(t.tokens, "id", p["q"])
            rows = having(rows, "id", found, "id")
        return rows

    def run(self) -> dict[str, DataFrame]:
        rows = self.filtered()
        fitted = self.tables.evidence.filter(F.col("fit_at").isNotNull())
        ordered = newest_first(rows, "posted_at", "id", undated_first=True)
        shown = ordered.limit(ROWS + 1)
        return {
            "rows": shown, "outline": ordered.limit(OUTLINE), "points": on_canvas(shown, extents(fitted, "x", "y"), "x", "y").select("id", "px", "py"),
            "actors": actors_in_view(self.tables.originators, rows, "id", "actor"), "years": year_bounds(fitted, "posted_at"),
        }
