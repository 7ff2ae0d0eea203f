"""Names to codes: normalisation, candidates, alias tables and their lookup."""

from __future__ import annotations

import sys
import unicodedata
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names by which issuers and partners are known, and the names shown.
BANK_ALIASES = {
    "AMEX": ["amex", "american express", "membership rewards", "amex mr", "amex membership rewards", "american express membership rewards"],
    "CHASE": ["chase", "chase ultimate rewards", "ultimate rewards", "chase ur"],
    "CITI": ["citi", "citibank", "citi thankyou", "citi thankyou rewards", "thankyou rewards", "citi thankyou points"],
    "C1": ["capital one", "cap one", "capital one miles", "c1"],
    "BILT": ["bilt", "bilt rewards"],
    "WF": ["wells fargo", "wells fargo rewards", "wells"],
    "ESF": ["esfera", "banco do brasil esfera", "bb esfera"],
    "LIV": ["livelo", "livelo pontos"],
    "ROVE": ["rove", "rove miles", "rove rewards"],
}
PARTNER_ALIASES = {
    "AF": ["air france", "air france klm", "air france / klm flying blue", "air france/klm flying blue", "flying blue", "klm"],
    "AV": ["avianca", "avianca lifemiles", "lifemiles"],
    "AM": ["aeromexico", "aeromexico rewards", "aeromexico club premier", "aeromexico clubpremier", "club premier", "clubpremier"],
    "VS": ["virgin atlantic", "virgin atlantic flying club", "flying club", "virgin red", "virgin points"],
    "QR": ["qatar airways", "qatar airways avios", "qatar avios", "qatar privilege club", "qatar privilege club avios", "qatar airways privilege club"],
    "BA": ["british airways", "british airways avios", "ba avios"],
    "EI": ["aer lingus", "aer lingus aerclub", "aerclub", "aer lingus avios"],
    "CX": ["cathay pacific", "cathay pacific asia miles", "asia miles"],
    "NH": ["ana", "ana mileage club", "all nippon airways"],
    "G3": ["gol", "smiles", "smiles (gol)"],
    "LA": ["latam", "latam pass"],
    "AD": ["azul", "azul fidelidade", "tudoazul"],
    "BR": ["eva", "eva air", "eva airways", "infinity mileagelands", "eva air infinity mileagelands", "eva infinity mileagelands"],
    "QF": ["qantas", "qantas frequent flyer"],
    "JL": ["jal", "jmb", "japan airlines", "japan airlines mileage bank", "jal mileage bank", "jal (japan airlines) mileage bank", "japan airlines jal mileage bank"],
    "LH": ["lufthansa", "miles and more", "miles more", "lufthansa miles and more", "lufthansa miles more"],
    "AS": ["alaska", "alaska airlines", "atmos rewards", "alaska atmos rewards", "alaska mileage plan", "mileage plan", "alaska mileageplan", "mileageplan"],
    "AA": ["american", "american airlines", "aadvantage", "american aadvantage", "american airlines aadvantage"],
    "AC": ["air canada", "aeroplan", "air canada aeroplan"],
    "TK": ["turkish", "turkish airlines", "miles smiles", "turkish miles smiles", "turkish airlines miles & smiles"],
    "EK": ["emirates", "skywards", "emirates skywards"],
    "SQ": ["singapore", "singapore airlines", "krisflyer", "singapore krisflyer", "singapore airlines krisflyer"],
    "UA": ["united", "united airlines", "united mileageplus", "mileageplus"],
    "B6": ["jetblue", "jetblue airways", "jetblue trueblue", "trueblue"],
    "EY": ["etihad", "etihad airways", "etihad guest"],
    "IB": ["iberia", "iberia plus", "iberia avios", "iberia club"],
    "CM": ["copa", "copa airlines", "connectmiles", "connect miles", "copa connectmiles", "copa connect miles", "copa airlines connectmiles"],
    "TP": ["tap", "tap air portugal", "tap portugal", "miles&go", "tap miles&go", "tap miles & go", "tap miles and go", "miles and go"],
    "F9": ["frontier", "frontier miles", "frontier airlines", "frontier bonus miles"],
    "WN": ["southwest", "southwest airlines", "rapid rewards", "southwest rapid rewards"],
    "AI": ["air india", "maharaja club", "air india maharaja club", "flying returns"],
    "DL": ["delta", "delta air lines", "skymiles", "delta skymiles"],
    "AY": ["finnair", "finnair plus", "finnair plus+"],
    "HU": ["hainan", "hainan airlines", "fortune wings club"],
    "9W": ["intermiles", "jet airways intermiles", "jet airways"],
    "MH": ["malaysia", "malaysia airlines", "enrich", "malaysia enrich", "malaysia airlines enrich"],
    "SK": ["sas", "eurobonus", "sas eurobonus", "scandinavian airlines", "scandinavian airlines sas eurobonus"],
    "TG": ["thai", "thai airways", "royal orchid plus", "thai airways royal orchid plus"],
    "VN": ["vietnam airlines", "lotusmiles", "vietnam airlines lotusmiles"],
}
DISPLAY_NAMES = {
    "AF": "Air France / KLM Flying Blue", "AV": "Avianca LifeMiles", "AM": "Aeromexico Rewards", "VS": "Virgin Atlantic Flying Club",
    "QR": "Qatar Airways Avios", "BA": "British Airways Avios", "EI": "Aer Lingus AerClub", "CX": "Cathay Pacific Asia Miles",
    "NH": "ANA Mileage Club", "G3": "Smiles (GOL)", "LA": "LATAM Pass", "AD": "Azul Fidelidade", "BR": "EVA Infinity MileageLands",
    "QF": "Qantas Frequent Flyer", "JL": "Japan Airlines (JAL Mileage Bank)", "LH": "Lufthansa Miles & More", "AS": "Alaska Atmos Rewards",
    "AA": "American Airlines AAdvantage", "AC": "Air Canada Aeroplan", "TK": "Turkish Miles&Smiles", "EK": "Emirates Skywards",
    "SQ": "Singapore KrisFlyer", "UA": "United MileagePlus", "B6": "JetBlue TrueBlue", "EY": "Etihad Guest", "IB": "Iberia Avios",
    "CM": "Copa ConnectMiles", "TP": "TAP Miles&Go", "F9": "Frontier Miles", "WN": "Southwest Rapid Rewards", "AI": "Air India Maharaja Club",
    "DL": "Delta SkyMiles", "AY": "Finnair Plus", "HU": "Hainan Airlines", "9W": "Jet Airways InterMiles", "MH": "Malaysia Airlines Enrich",
    "SK": "Scandinavian Airlines (SAS) EuroBonus", "TG": "Thai Airways Royal Orchid Plus", "VN": "Vietnam Airlines LotusMiles",
}


def _accents() -> tuple[str, str]:
    """Every character that is one character and marks when decomposed, and those characters.

    By Python's table of Unicode; only Hangul syllables and a few signs decompose into several
    characters, and stay as they are.
    """
    marked, plain = [], []
    for c in map(chr, (*range(0xA0, 0xAC00), *range(0xE000, sys.maxunicode + 1))):  # without Hangul syllables and surrogates
        parts = unicodedata.normalize("NFD", c)
        if parts != c and unicodedata.category(c) != "Mn":
            bare = [x for x in parts if unicodedata.category(x) != "Mn"]
            if len(bare) == 1:
                marked.append(c)
                plain.append(bare[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()


def norm(name: Column) -> Column:
    """Lower case, no marks over letters, ``/ & . , ( ) -`` as spaces, single spaces."""
    plain = F.regexp_replace(F.translate(F.lower(name), _MARKED, _PLAIN), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[/&.,()-]", " "), r"[\s ]+", " "))


def name_candidates(name: Column) -> Column:
    """What a name may be known by, in order: with a closing parenthesis, the part before it and
    the part inside; else the whole, then its halves about `` - ``. Null and blank: none."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r"^[\s ]+|[\s ]+$", "")
    paren = r"^(.*?)\s*\(([^)]*)\)\s*$"
    halves = F.when(s.rlike(r"\s-\s"), F.transform(F.split(s, r"\s-\s"), norm)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(s == "", F.array().cast("array<string>"))
        .when(s.rlike(paren), F.array(norm(F.regexp_extract(s, paren, 1)), norm(F.regexp_extract(s, paren, 2))))
        .otherwise(F.concat(F.array(norm(s)), halves))
    )


def alias_table(spark: SparkSession, aliases: dict[str, list[str]]) -> DataFrame:
    """``alias, code``: each code is its own alias; of equal aliases the later entry holds."""
    rows = [(a, code, k) for k, (code, names) in enumerate(aliases.items()) for a in (code, *names)]
    table = spark.createDataFrame(rows, "raw string, code string, k int").withColumn("alias", norm(F.col("raw")))
    return table.groupBy("alias").agg(F.max_by("code", "k").alias("code"))


_pairs: dict[tuple[tuple[str, tuple[str, ...]], ...], list[tuple[str, str]]] = {}


def alias_map(spark: SparkSession, aliases: dict[str, list[str]]) -> Column:
    """The alias table as one literal map; alias tables are fixed and small, so each is made once."""
    entries = tuple((code, tuple(names)) for code, names in aliases.items())
    if entries not in _pairs:
        _pairs[entries] = [(r["alias"], r["code"]) for r in alias_table(spark, aliases).orderBy("alias").collect()]
    return F.create_map(*map(F.lit, chain.from_iterable(_pairs[entries])))


def resolved(name: Column, codes: Column) -> Column:
    """The code of the first candidate of ``name`` in the map ``codes``; null if none is."""
    return F.get(F.filter(F.transform(name_candidates(name), lambda c: F.try_element_at(codes, c)), lambda x: x.isNotNull()), F.lit(0))


def resolve_by_join(df: DataFrame, name: str, aliases: DataFrame, out: str, key: str) -> DataFrame:
    """The same lookup as a join, for alias tables of any size: ``key`` identifies a row of ``df``."""
    tried = df.select(key, F.posexplode(name_candidates(F.col(name))).alias("pos", "alias")).join(aliases, "alias")
    return df.join(tried.groupBy(key).agg(F.min_by("code", "pos").alias(out)), key, "left")


def display_name(code: Column) -> Column:
    """The name shown for a partner code; the code itself where there is none."""
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in DISPLAY_NAMES.items()))
    return F.coalesce(F.try_element_at(names, code), code)


def route_id(bank: Column, code: Column) -> Column:
    return F.concat_ws("-", F.lower(bank), F.lower(code))
