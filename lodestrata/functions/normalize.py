"""Key normalisers: Column in, Column out. All are built-in expressions, so they stay inside code generation and pushdown."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def bill_key(c: Column) -> Column:
    """Letters and digits only, upper case, without zeros between the letters and the number."""
    bare = F.upper(F.regexp_replace(_text(c), "[^A-Za-z0-9]", ""))
    return F.regexp_replace(bare, "^([A-Z]+)0+([0-9])", "$1$2")


def print_number(c: Column) -> Column:
    """`s00256a` as `S256A`; anything of another form in upper case."""
    up, form = F.upper(F.trim(_text(c))), "^([A-Z])([0-9]+)([A-Z]?)$"
    number = F.regexp_extract(up, form, 2)
    short = F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), F.lit("0"))
    return F.when(up.rlike(form), F.concat(F.regexp_extract(up, form, 1), short, F.regexp_extract(up, form, 3))).otherwise(F.upper(_text(c)))


def minted_id(number: Column, session: Column) -> Column:
    """session * 10^6, half a million more for the A series, plus the number."""
    form = "^([A-Z])([0-9]+)"
    n = F.coalesce(F.nullif(F.regexp_extract(number, form, 2), F.lit("")).cast("long"), F.lit(0).cast("long"))
    series = F.when(F.regexp_extract(number, form, 1) == "A", 500_000).otherwise(0)
    return session.cast("long") * 1_000_000 + series + n


def chamber(c: Column) -> Column:
    """H for assemblies, houses and lower houses; S for senates and upper houses; J for joint; else null."""
    first = F.upper(F.substring(_text(c), 1, 1))
    return F.when(first.isin("A", "H", "L"), "H").when(first.isin("S", "U"), "S").when(first == "J", "J")


def district(c: Column) -> Column:
    """Without a letter prefix and leading zeros; `?` where nothing is left."""
    bare = F.regexp_replace(F.upper(_text(c)), "^[A-Z]+-", "")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^0+([0-9A-Z])", "$1"), F.lit("")), F.lit("?"))


def district_code(number: Column, house: Column) -> Column:
    """8 and SENATE as `SD-008`; null for zero and non-numbers."""
    n = F.expr("try_cast(1 as int)") if number is None else number.try_cast("int")
    kind = F.when(F.upper(house) == "SENATE", "SD").when(F.upper(house) == "ASSEMBLY", "HD").otherwise("")
    text = n.cast("string")
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    return F.when(n != 0, F.concat(kind, F.lit("-"), padded))


def surname(c: Column) -> Column:
    """The part before a comma, or the last token without a generational suffix; letters and hyphens, upper case."""
    t = _text(c)
    last = F.regexp_replace(F.regexp_replace(F.trim(t), r"(?i)[ ,]+(JR|SR|II|III|IV|V)\.?$", ""), r"^.*\s", "")
    part = F.when(F.trim(t) == "", "").when(t.contains(","), F.split_part(t, F.lit(","), F.lit(1))).when(~t.rlike(r"\s"), t).otherwise(last)
    return F.upper(F.regexp_replace(part, "[^A-Za-z-]", ""))


#: How vote words are coded; anything else is O.
VOTES = {
    "Y": ("YEA", "AYE", "AYEWR", "Y", "YES"),
    "N": ("NAY", "NO", "N"),
    "X": ("NV", "ABD", "ABSTAIN", "NOT VOTING"),
    "A": ("ABSENT", "ABS", "EXC", "EXCUSED"),
}


def vote(c: Column) -> Column:
    up, out = F.upper(_text(c)), None
    for code, words in VOTES.items():
        out = F.when(up.isin(*words), code) if out is None else out.when(up.isin(*words), code)
    return out.otherwise("O")


def _accented() -> tuple[str, str]:
    """Lower-case letters that decompose into one letter and marks, and those letters."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        bare = "".join(p for p in parts if not unicodedata.combining(p))
        if len(bare) == 1 and bare != chr(code):
            pairs[chr(code)] = bare
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accented()


def strip_accents(c: Column) -> Column:
    """Lower case without accents: composed letters by a table, marks of their own dropped."""
    return F.trim(F.regexp_replace(F.translate(F.lower(_text(c)), ACCENTED, PLAIN), r"[\u0300-\u036f]", ""))


def state_code(c: Column) -> Column:
    """`US` for Congress in any of its names, otherwise the first two letters."""
    x = F.replace(F.upper(F.trim(_text(c))), F.lit("."), F.lit(""))
    bodies = ["HOUSE", "SENATE", "CONGRESS"]
    names = ["US", "U S", *bodies, *(f"{country} {body}" for country in ("US", "U S") for body in bodies)]
    return F.when(F.regexp_replace(x, r"\s+", " ").isin(*names), "US").otherwise(F.substring(x, 1, 2))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def lake_name(c: Column) -> Column:
    """CamelCase and spaces as snake_case."""
    split = F.regexp_replace(_text(c), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(split, "[^A-Za-z0-9]+", "_"), "^_|_$", ""))


def title_case(c: Column) -> Column:
    """Initial capitals, but for small joining words inside."""
    out = F.initcap(F.lower(_text(c)))
    for word in ("and", "of", "the", "for", "in", "to"):
        out = F.regexp_replace(out, rf"(?<=\s){word.capitalize()}(?=\s)", word)
    return out


#: Symbols of the elements by proton number; a neutron has none.
ELEMENTS = (
    "n H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg "
    "Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

#: What chamber codes stand for, and states whose lower house is no House.
CHAMBERS = {"S": "Senate", "A": "Assembly", "H": "House", "L": "Legislature", "C": "Council"}
LOWER_HOUSES = {"NY": "Assembly", "NJ": "Assembly", "CA": "Assembly", "NV": "Assembly", "WI": "Assembly", "NE": "Legislature", "DC": "Council", "US": "House"}


def chamber_name(c: Column) -> Column:
    """The chamber that a code's first letter stands for; other codes in upper case, null for none."""
    up = F.upper(_text(c))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in CHAMBERS.items() for x in pair]), F.left(up, F.lit(1)))
    return F.coalesce(named, F.nullif(up, F.lit("")))


def lower_house(state: Column) -> Column:
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in LOWER_HOUSES.items() for x in pair]), state)
    return F.coalesce(named, F.lit("House"))
