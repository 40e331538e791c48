"""Column functions on text: keys, slugs, tokens, validators and labels. All of them stay in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of schools that may be published, as they stand in descriptions.
LABEL = r"(?iu)<b>\s*(Localidad|[ÁA]mbito|Nivel)\s*:\s*</b>\s*([^<]+?)\s*<br\s*/?>"
# What a phone number (after white space and punctuation) and an e-mail address look like.
PHONE = r"^(\+?54|0)?[1-9]\d{9,10}$"
_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
EMAIL = rf"^[a-zA-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})*$"
# Letters with marks of Spanish and its neighbours, and their plain letters.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def normal_key(c: Column) -> Column:
    """An account key without white space and dots; an empty one, or the word None, is null."""
    key = F.regexp_replace(c.cast("string"), r"[\s.]+", "")
    return F.when((key != "") & (key != "None"), key)


def trim_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def slug(c: Column, gap: str = "-") -> Column:
    """Lower case without marks; runs of anything but a-z and 0-9 become one gap, none at the ends."""
    plain = F.lower(F.translate(c, MARKED, PLAIN))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", gap), f"^{gap}+|{gap}+$", "")


def spanish_number(c: Column) -> Column:
    """The number in a token like '1.355,5 m': points group thousands, the comma is the decimal mark; null if none."""
    found = F.regexp_extract(c, r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)\s*m\b", 1)
    return F.when(found != "", F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def leading_code(c: Column) -> Column:
    """A code of one to three capitals, one or two digits and perhaps a capital at the start of a name."""
    return F.nullif(F.regexp_extract(c, r"^([A-Z]{1,3}\d{1,2}[A-Z]?)(?=\s|$)", 1), F.lit(""))


def bracket_code(c: Column) -> Column:
    """A code like (P12) or (N3a), wherever it stands."""
    return F.nullif(F.regexp_extract(c, r"\(([PN]\d+[a-z]?)\b", 1), F.lit(""))


def cuit(c: Column) -> Column:
    """Eleven digits as XX-XXXXXXXX-X; anything else as it is."""
    digits = F.regexp_replace(c, r"\D", "")
    shaped = F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 8), F.lit("-"), F.substring(digits, 11, 1))
    return F.when(F.length(digits) == 11, shaped).otherwise(c)


def cuit_check_digit(c: Column) -> Column:
    """The check digit of the first ten digits: weights 5432765432, modulo 11; 11 becomes 0 and 10 becomes 9."""
    total = sum(F.substring(c, i + 1, 1).try_cast("int") * w for i, w in enumerate((5, 4, 3, 2, 7, 6, 5, 4, 3, 2)))
    rest = 11 - total % 11
    return F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest).cast("int")


def is_phone(c: Column) -> Column:
    """An Argentine number of ten or eleven digits, perhaps after +54, 54 or 0; null isn't one."""
    return F.coalesce(F.regexp_replace(c, r"[\s\-().]", "").rlike(PHONE), F.lit(False))


def is_email(c: Column) -> Column:
    return F.coalesce((F.length(c) <= 254) & c.rlike(EMAIL), F.lit(False))


def is_cuit(c: Column) -> Column:
    """Eleven digits, plain or as XX-XXXXXXXX-X, with the right check digit."""
    digits = F.regexp_replace(c, "-", "")
    shaped = c.rlike(r"^(\d{2}-\d{8}-\d|\d{11})$")
    return F.coalesce(shaped & (F.substring(digits, 11, 1).try_cast("int") == cuit_check_digit(digits)), F.lit(False))


def labels(c: Column) -> Column:
    """A map of the labels of an HTML fragment that may be published; the first of each counts. Others are never read."""
    keys, values = (F.regexp_extract_all(c, F.lit(LABEL), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(F.transform(keys, lambda k: F.translate(F.lower(k), "á", "a")).alias("k"), values.alias("v"))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.filter(pairs, lambda p: p["k"] == k)[0]["v"]))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def last_segment(c: Column) -> Column:
    return F.try_element_at(F.filter(F.split(c, "/"), lambda x: x != ""), F.lit(-1))


def checklist(c: Column) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(c, r"\r?\n+"), lambda x: F.trim(x)), lambda x: x != "")


def soil_class(c: Column) -> Column:
    """The roman numeral I to VIII at the start."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(c)), "^(VIII|VII|VI|IV|III|II|I)", 1), F.lit(""))


def title_from_id(c: Column) -> Column:
    return F.initcap(F.replace(F.replace(c, F.lit("vt_"), F.lit("")), F.lit("_"), F.lit(" ")))


def _measure(c: Column, edge: float, small: str, large: str) -> Column:
    """Whole small units below the edge, else large ones with a decimal; a dash for what isn't finite, 0 below 0."""
    finite = F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    v = F.greatest(c, F.lit(0.0))
    text = F.when(v < edge, F.concat(F.floor(v + 0.5).cast("string"), F.lit(f" {small}"))).otherwise(F.format_string(f"%.1f {large}", v / edge))
    return F.when(finite, text).otherwise(F.lit(f"— {small}"))


def distance_text(m: Column) -> Column:
    """Metres below 1000, else kilometres with a decimal."""
    return _measure(m, 1000, "m", "km")


def area_text(m2: Column) -> Column:
    """Square metres below a hectare, else hectares with a decimal."""
    return _measure(m2, 10_000, "m²", "ha")


def length_text(computed: Column, declared: Column) -> Column:
    """A computed length in whole metres, and the declared one where the two differ when rounded."""
    metres = lambda c: F.concat(F.replace(F.format_number(c, 0), F.lit(","), F.lit(".")), F.lit(" m"))
    differ = F.coalesce(F.floor(computed + 0.5) != F.floor(declared + 0.5), F.lit(False))
    return F.when(differ, F.concat(metres(computed), F.lit(" · ("), metres(declared), F.lit(" declarada)"))).otherwise(metres(computed))


def file_name(c: Column, day: Column) -> Column:
    """A name for an export: a slug with underscores, and the day."""
    return F.concat_ws("_", slug(c, "_"), F.date_format(day, "yyyy-MM-dd"))


def feature_name(properties: Column, index: Column, label: str) -> Column:
    """The name of a feature: nombre, else name, else the label with its number; schools' names are written out."""
    found = F.coalesce(trim_to_null(properties["nombre"]), trim_to_null(properties["name"]), F.concat(F.lit(f"{label} "), (index + 1).cast("string")))
    return F.regexp_replace(found, r"^Esc\. ", "Escuela ")


def humanised(key: Column, names: dict[str, str]) -> Column:
    """The label of a key, or else the key with spaces and a capital."""
    known = F.create_map([F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")
    plain = F.replace(key, F.lit("_"), F.lit(" "))
    return F.coalesce(known[key], F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 20)))


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$ "), F.format_number(c, 2))


def coordinate_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lon)


def moment_text(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy HH:mm")


def data_url_bytes(c: Column) -> Column:
    """The bytes of a base64 data URL; null for anything else."""
    return F.when(c.rlike("^data:[^,]*;base64,"), F.unbase64(F.substring_index(c, ",", -1)))
