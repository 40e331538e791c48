"""Canals and schools from placemarks: parsed names, ids without collisions, lengths, and the index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralode.functions import geometry, projection, text
from terralode.operators.relational import first_wins

# Words that stand for a priority, and what a code and a length look like.
PRIORITIES = {
    "alta": "Alta", "media-alta": "Media-Alta", "media_alta": "Media-Alta", "media alta": "Media-Alta", "mediaalta": "Media-Alta", "media": "Media", "opcional": "Opcional",
    "largo plazo": "Largo plazo", "largo-plazo": "Largo plazo", "largo_plazo": "Largo plazo", "largoplazo": "Largo plazo",
}
CODE, LENGTH = r"^[A-Z]{1,3}\d{1,2}[A-Z]?$", r"^(\d[\d.]*)(?:,(\d+))?\s*m\b"


def priority(token: Column) -> Column:
    """The priority that a token stands for, if it is one and nothing else."""
    key = F.regexp_replace(F.lower(text.strip(token)), r"[\s\u00a0]+", " ")
    known = F.create_map([F.lit(x) for pair in PRIORITIES.items() for x in pair])
    return known[key]


def _chunk(state: Column, chunk: Column) -> Column:
    """One step over a name's chunks: what the chunk is, given what was found before."""
    digits = F.concat(F.replace(F.regexp_extract(chunk, LENGTH, 1), F.lit("."), F.lit("")), F.lit("."), F.regexp_extract(chunk, LENGTH, 2), F.lit("0"))
    length = F.when(chunk.rlike(LENGTH), digits.try_cast("double"))
    is_code = (state["n"] == 0) & chunk.rlike(CODE)
    is_length = ~is_code & state["declared_m"].isNull() & length.isNotNull()
    tail = text.strip(F.regexp_replace(chunk, LENGTH, ""))
    word = F.when(is_length, priority(tail)).otherwise(priority(chunk))
    is_level = ~is_code & state["priority"].isNull() & word.isNotNull()
    rest = F.when(is_length, F.when(tail != "", tail)).otherwise(chunk)
    left = F.when(is_code | is_level | rest.isNull(), F.slice(F.array(F.lit("")), 1, 0)).otherwise(F.array(rest))
    return F.struct(
        (state["n"] + 1).alias("n"), F.when(is_code, chunk).otherwise(state["code"]).alias("code"), F.when(is_length, length).otherwise(state["declared_m"]).alias("declared_m"),
        F.when(is_level, word).otherwise(state["priority"]).alias("priority"), F.concat(state["parts"], left).alias("parts"), (state["odd"] | (is_level & ~is_length & (state["n"] == 0))).alias("odd"),
    )


def parsed_name(name: Column) -> Column:
    """A struct (code, description, declared_m, priority, featured) of a name such as
    'N12 · Canal norte · 1.355,5 m · Alta ★'. What follows a star is ignored. Chunks are parted by '·': the first may
    be a code, any a length or a priority; the rest is the description, or else all that stands before the star. A code
    that stands later is found if there is no other; one in brackets, like (P12), goes before all. Without a priority,
    words of the name that hint at one count."""
    raw = text.strip(F.coalesce(name, F.lit("")))
    before = F.regexp_replace(F.substring_index(raw, "★", 1), r"[\s\u00a0]+$", "")
    none = F.lit(None)
    start = F.struct(
        F.lit(0).alias("n"), none.cast("string").alias("code"), none.cast("double").alias("declared_m"), none.cast("string").alias("priority"), F.slice(F.array(F.lit("")), 1, 0).alias("parts"), F.lit(False).alias("odd")
    )
    lower = F.lower(F.coalesce(name, F.lit("")))
    hinted = F.when(lower.contains("opcional") | lower.contains("sujeto a presupuesto"), "Opcional").when(lower.contains("largo plazo"), "Largo plazo")

    def whole(working: Column, found: Column, description: Column, late: Column) -> Column:
        without = description
        for one, two in (("· ", ""), ("", " ·"), ("", "")):
            without = F.replace(without, F.concat(F.lit(one), late, F.lit(two)), F.lit(""))
        without = F.regexp_replace(F.regexp_replace(text.strip(without), r"^\s*·\s*", ""), r"\s*·\s*$", "")
        return F.struct(
            F.coalesce(text.bracket_code(working), found["code"], late).alias("code"), F.when(late.isNotNull(), without).otherwise(description).alias("description"), found["declared_m"].alias("declared_m"),
            F.coalesce(found["priority"], hinted).alias("priority"), raw.contains("★").alias("featured"),
        )

    def parts(working: Column, chunks: Column, found: Column) -> Column:
        joined = F.array_join(found["parts"], " · ")
        late = F.when(~found["odd"] & found["code"].isNull(), F.get(F.filter(F.slice(chunks, 2, 1000), lambda c: c.rlike(CODE)), 0))
        both = F.struct(F.when(joined == "", text.strip(working)).otherwise(joined).alias("d"), late.alias("l"))
        return _named(both, lambda x: whole(working, found, x["d"], x["l"]))

    def chunked(working: Column) -> Column:
        chunks = F.filter(F.transform(F.split(working, "·"), text.strip), lambda c: c != "")
        return _named(chunks, lambda c: _named(F.aggregate(c, start, _chunk), lambda f: parts(working, c, f)))

    return _named(F.when(raw.contains("★"), before).otherwise(raw), chunked)


def _named(value: Column, body) -> Column:
    """What body makes of a value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def with_counters(rows: DataFrame, base: str, order: str) -> DataFrame:
    """The first of a base slug keeps it as its id; later ones get '-2', '-3' and so on."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("id", F.when(k == 1, F.col(base)).otherwise(F.concat_ws("-", base, k.cast("string"))))


def with_ids(rows: DataFrame, base: str, order: str, folder: str, source: str) -> DataFrame:
    """The first of a base slug in a source file keeps it as its id; later ones get '-folder-0', '-folder-1' and so on, of
    which those are passed over that stand before it already. That makes ids hang on all earlier ones of their file: a
    file, which a single task has parsed, is numbered by a single task, too."""

    def number(part: pd.DataFrame) -> pd.DataFrame:
        seen, counts, ids = set(), {}, []
        part = part.sort_values("o", kind="stable")
        for b, suffix in zip(part["b"], part["f"], strict=True):
            name = b
            while name in seen:
                k = counts[b] = counts.get(b, -1) + 1
                name = f"{b}-{suffix}-{k}" if suffix else f"{b}-{k}"
            seen.add(name)
            ids.append(name)
        return part.assign(id=ids)[["s", "o", "id"]]

    keys = rows.select(F.col(source).alias("s"), F.col(order).cast("long").alias("o"), F.col(base).alias("b"), text.slug(F.coalesce(folder, F.lit(""))).alias("f"))
    ids = keys.groupBy("s").applyInPandas(number, "s string, o long, id string")
    return rows.join(ids, rows[source].eqNullSafe(ids["s"]) & (rows[order] == ids["o"])).drop("s", "o")


def canals(placemarks: DataFrame, state: str) -> DataFrame:
    """Canals, the lines among placemarks (source, ord, name, folder, style, points), with geodesic lengths to a decimal."""
    lines = placemarks.where("geometry_type = 'LineString' and size(points) > 0").withColumn("n", parsed_name(F.col("name")))
    slugs = F.array(text.slug(F.coalesce("n.code", F.lit(""))), text.slug(F.when(F.col("n.description") != "", F.col("n.description")).otherwise(F.coalesce("name", F.lit("")))))
    base = F.array_join(F.filter(slugs, lambda s: s != ""), "-")
    rows = lines.withColumn("base", F.when(base != "", base).otherwise(F.concat(F.lit("canal-"), F.col("ord").cast("string"))))
    rows = with_ids(rows, "base", "ord", "folder", "source")
    length = F.round(geometry.line_length(F.col("points"), projection.geodesic), 1)
    return rows.select(
        "id", F.col("n.code").alias("codigo"), F.col("name").alias("nombre"), F.col("n.description").alias("descripcion"), F.lit(state).alias("estado"), length.alias("longitud_m"),
        F.col("n.declared_m").alias("longitud_declarada_m"), F.col("n.priority").alias("prioridad"), F.col("n.featured").alias("featured"), text.last_segment(F.col("folder")).alias("tramo_folder"), F.col("style").alias("source_style"), "points", "ord",
    )


#: Properties of a canal's feature, in their order.
PROPERTIES = ("id", "codigo", "nombre", "descripcion", "estado", "longitud_m", "longitud_declarada_m", "prioridad", "featured", "tramo_folder", "source_style")


def canal_features(canals: DataFrame) -> DataFrame:
    """(ord, json): a GeoJSON feature for each canal, with its eleven properties, nulls written out."""
    line = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*PROPERTIES).alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    return canals.select("ord", F.to_json(feature, {"ignoreNullFields": "false"}).alias("json"))


def canal_index(canals: DataFrame) -> DataFrame:
    """(estado, ord, json): a line of the index for each canal. A surveyed canal without a priority has no such field; a
    proposed one has it as null."""
    fields = ("id", "nombre", "codigo", "prioridad", "longitud_m", "featured", "estado")
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    short = F.to_json(F.struct(*(f for f in fields if f != "prioridad")), {"ignoreNullFields": "false"})
    return canals.select("estado", "ord", F.when((F.col("estado") == "relevado") & F.col("prioridad").isNull(), short).otherwise(whole).alias("json"))


def index_counts(canals: DataFrame) -> DataFrame:
    """Canals by state, and all, in one row."""
    is_ = lambda s: F.count_if(F.col("estado") == s)
    return canals.agg(is_("relevado").alias("relevados"), is_("propuesto").alias("propuestas"), F.count("*").alias("total"))


def parse_failures(canals: DataFrame) -> DataFrame:
    """One row (lines, failures, rate): names with a separator in which neither code, length nor priority was found; the
    rate of no lines is 0."""
    failed = F.col("nombre").contains("·") & F.col("codigo").isNull() & F.col("longitud_declarada_m").isNull() & F.col("prioridad").isNull()
    row = canals.agg(F.count("*").alias("lines"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failures"))
    return row.withColumn("rate", F.when(F.col("lines") > 0, F.col("failures") / F.col("lines")).otherwise(F.lit(0.0)))


def failure_rate(rows: DataFrame, parsed: Column) -> DataFrame:
    """The share of rows that couldn't be parsed; 0 of none."""
    return rows.agg(F.coalesce(F.avg(F.when(parsed.isNull(), 1.0).otherwise(0.0)), F.lit(0.0)).alias("rate"))


def described(placemarks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Placemarks with the description that the first mark of their name has in another scan, or else an empty one."""
    firsts = first_wins(descriptions.where("description is not null").select("name", "ord", F.col("description").alias("found")), "name", "ord")
    return placemarks.drop("description").join(firsts.select("name", F.col("found").alias("description")), "name", "left").withColumn("description", F.coalesce("description", F.lit("")))


def schools(placemarks: DataFrame) -> DataFrame:
    """Schools, the points among placemarks, with the labels that may be published and no others."""
    points = placemarks.where("geometry_type = 'Point' and size(points) > 0").withColumn("labels", text.labels(F.coalesce("description", F.lit(""))))
    label = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("")).alias(k)
    rows = with_counters(points.withColumn("base", text.slug(F.coalesce("name", F.lit("")))), "base", "ord")
    return rows.select("id", F.regexp_replace("name", r"^Esc\. ", "Escuela ").alias("nombre"), label("localidad"), label("ambito"), label("nivel"), F.get("points", 0).alias("point"), "ord")


def school_features(schools: DataFrame) -> DataFrame:
    """(ord, json): a GeoJSON feature for each school."""
    point = F.struct(F.lit("Point").alias("type"), F.array("point.x", "point.y").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("id", "nombre", "localidad", "ambito", "nivel").alias("properties"), point.alias("geometry"))
    return schools.select("ord", F.to_json(feature, {"ignoreNullFields": "false"}).alias("json"))
