"""Names of people and organisations, and the free text of their functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import or_empty, strip

#: Spelling corrections of function texts, applied in this order.
CORRECTIONS = [
    ("Miglied", "Mitglied"),
    ("Bundestagsg", "Bundestags"),
    ("Bundestagts", "Bundestags"),
    ("Westafalen", "Westfalen"),
    ("Vorstans", "Vorstands"),
    ("Stellvertreternder", "Stellvertretender"),
    ("Stellverretender", "Stellvertretender"),
    ("Stellvertretetender", "Stellvertretender"),
    ("Vorsitzend des", "Vorsitzende des"),
    ("Vorsitzender das", "Vorsitzender des"),
    ("Berllin", "Berlin"),
]

#: Roles by the first pattern found in the lower-cased text; DEPUTY stands for the words before it.
DEPUTY = r"(?:stellvertretende\w*|stv\.?)\s+"
ROLES = [
    (DEPUTY + "bundessprecher", "Stellvertretende*r Bundessprecher*in"),
    ("bundessprecher", "Bundessprecher*in"),
    (DEPUTY + "bundesvorsitzende", "Stellvertretende*r Bundesvorsitzende*r"),
    ("bundesvorsitzende", "Bundesvorsitzende*r"),
    (DEPUTY + "landesvorsitzende", "Stellvertretende*r Landesvorsitzende*r"),
    ("landesvorsitzende", "Landesvorsitzende*r"),
    ("ehrenvorsitzende", "Ehrenvorsitzende*r"),
    (DEPUTY + "fraktionsvorsitzende", "Stellvertretende*r Fraktionsvorsitzende*r"),
    ("fraktionsvorsitzende", "Fraktionsvorsitzende*r"),
    (DEPUTY + "vorsitzende", "Stellvertretende*r Vorsitzende*r"),
    ("vorsitzende", "Vorsitzende*r"),
    (DEPUTY + r"parlamentarische\w*\s+geschäftsführer", "Stellvertretende*r parlamentarische*r Geschäftsführer*in"),
    (r"parlamentarische\w*\s+geschäftsführer", "Parlamentarische*r Geschäftsführer*in"),
    (DEPUTY + r"innenpolitische\w*\s+sprecher", "Stellvertretende*r innenpolitische*r Sprecher*in"),
    (r"innenpolitische\w*\s+sprecher", "Innenpolitische*r Sprecher*in"),
    (DEPUTY + "landessprecher", "Stellvertretende*r Landessprecher*in"),
    ("landessprecher", "Landessprecher*in"),
    (DEPUTY + "sprecher", "Stellvertretende*r Sprecher*in"),
    ("sprecher", "Sprecher*in"),
    ("kandidat", "Kandidat*in"),
    ("bürgermeister", "Bürgermeister*in"),
    ("stadtrat|stadträt", "Stadtrat*rätin"),
    ("kreisrat|kreisrät|kreistag", "Kreisrat*rätin"),
    ("gemeinderat|gemeinderät", "Gemeinderat*rätin"),
    ("bezirksrat|bezirksrät|bezirkstag", "Bezirksrat*rätin"),
    ("beirat|beirät", "Beirat*rätin"),
    (r"\bmd(b|l|a|ep|hb)\b|\bmep\b|abgeordnete", "Abgeordnete*r"),
    ("präsident", "Präsident*in"),
    ("generalsekretär", "Generalsekretär*in"),
    ("bundesschiedsrichter", "Bundesschiedsrichter*in"),
    ("vorstandsmitglied|mitglied.*vorstand|beisitzer", "Vorstandsmitglied"),
    ("einfaches mitglied", "Mitglied"),
]
#: Institutional levels by the first pattern found in the lower-cased text.
LEVELS = [
    (r"\bmdep\b|\bmep\b", "AfD-Europafraktion"),
    (r"\bmdb\b", "AfD-Bundespartei"),
    (r"\bmdl\b|\bmda\b|\bmdhb\b", "AfD-Landesverbände"),
    ("europ", "AfD-Europafraktion"),
    ("bund", "AfD-Bundespartei"),
    (r"kreis|bezirk|stadt|gemeinde|ortschaft|kommun|bürgermeister|bürgerschaft|\bkv\b|\bov\b|\bbv\b", "AfD-Kreisverbände"),
    ("abgeordnetenhaus", "AfD-Landesverbände"),
    ("land", "AfD-Landesverbände"),
]
#: The party token that names are compared without.
PARTY = "afd"


def normalize_name(x: Column) -> Column:
    """The form in which names are compared: lower case, ß as ss, no brackets, no party token, single spaces."""
    x = F.replace(F.lower(or_empty(x)), F.lit("ß"), F.lit("ss"))
    x = F.regexp_replace(x, r"\(.*?\)", " ")
    x = F.regexp_replace(x, rf"(?U)\b{PARTY}\b", " ")
    return F.trim(F.regexp_replace(x, "[^0-9a-zäöüß]+", " "))


def swap_comma_name(x: Column) -> Column:
    """'Last, First' as 'First Last'; a label without comma as it is."""
    last, first = F.regexp_extract(x, r"(?s)^([^,]*),", 1), F.regexp_extract(x, r"(?s)^[^,]*,(.*)$", 1)
    return F.when(x.contains(","), strip(F.concat(strip(first), F.lit(" "), strip(last)))).otherwise(x)


def drop_middle_names(x: Column) -> Column:
    """First and last word of a name of more than two."""
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) > 2, F.concat_ws(" ", words[0], F.element_at(words, -1))).otherwise(x)


def clean_function(x: Column) -> Column:
    x = F.regexp_replace(strip(F.regexp_replace(or_empty(x), r"(?U)\s+", " ")), r"\.+$", "")
    x = strip(x)
    for wrong, right in CORRECTIONS:
        x = F.replace(x, F.lit(wrong), F.lit(right))
    return x


def segments(x: Column) -> Column:
    """The single positions of a list of them, parted by commas and the word 'und'."""
    parts = F.transform(F.split(or_empty(x), r"(?U)\s*(?:,|\bund\b)\s*"), strip)
    return F.filter(parts, lambda s: s != "")


def first_match(x: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern is found in the lower-cased text; '' if none is."""
    text = F.lower(or_empty(x))
    found = F.when(F.lit(False), "")
    for pattern, name in rules:
        found = found.when(text.rlike(f"(?U){pattern}"), name)
    return found.otherwise("")


def role(x: Column) -> Column:
    return first_match(x, ROLES)


def level(x: Column) -> Column:
    return first_match(x, LEVELS)


def folded(x: Column) -> Column:
    """Case-folded for sorting by name: lower case, ß as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
