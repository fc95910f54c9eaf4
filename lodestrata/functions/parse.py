"""Identifiers and fields mined from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of federal bill numbers and how each is filed.
FILED_AS = {"HJRES": "HJR", "SJRES": "SJR", "HCONRES": "HCR", "SCONRES": "SCR", "HRES": "HR", "SRES": "SR", "HR": "HB", "S": "SB"}
#: A short run of words that may be such letters, and the number after it.
_LETTERED = r"(?<![A-Za-z.])((?:[A-Za-z]{1,7}\.?\s?){1,4})(\d{1,5})\b"


def _filed(words: Column) -> Column:
    """How a bill is filed whose letters end the run of words: the longest end that is known. What stands right before it must not be joined to it, and a lone S needs its stop."""
    kinds = F.map_from_arrays(F.array(*map(F.lit, FILED_AS)), F.array(*map(F.lit, FILED_AS.values())))
    parts = F.regexp_extract_all(words, F.lit(r"([A-Za-z]+\.?\s?)"), F.lit(1))

    def from_word(k: Column) -> Column:
        tail = F.array_join(F.slice(parts, k + 1, F.size(parts)), "")
        letters = F.upper(F.regexp_replace(tail, "[^A-Za-z]", ""))
        apart = (k == 0) | F.endswith(F.get(parts, k - 1), F.lit(" "))
        return F.when(apart & ((letters != "S") | tail.contains(".")), F.try_element_at(kinds, letters))

    ends = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), from_word)
    return F.get(F.array_compact(ends), F.lit(0))


def bill_mentions(c: Column) -> Column:
    """The distinct bills that a text names, in the order of their first mention."""
    runs, numbers = (F.regexp_extract_all(c, F.lit(_LETTERED), F.lit(g)) for g in (1, 2))
    named = F.zip_with(runs, numbers, lambda w, n: F.concat(_filed(w), n.cast("int").cast("string")))
    return F.array_distinct(F.array_compact(named))


def dollar_amounts(c: Column) -> Column:
    """Amounts such as $1,250.50 as numbers."""
    found = F.regexp_extract_all(c, F.lit(r"\$([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))


#: Where sites keep a person. Host, the path's segments before the identifier (* is any one; None: it may be anywhere in the link), and
#: what the identifier looks like. Of several links the first counts, and of several places the last one listed.
PERSON_LINKS = {
    "ballotpedia": [("ballotpedia.org", (), r".+")],
    "votesmart": [
        ("votesmart.org", ("candidate",), r"\d+"),
        ("votesmart.org", ("candidate", "biography"), r"\d+"),
        ("justfacts.votesmart.org", ("candidate", "*"), r"\d+"),
    ],
    "bioguide": [("bioguide.congress.gov", None, r"\b[A-Z]\d{6}"), ("", ("images", "congress", "*"), r"[A-Z]\d{6}(?=\.)")],
    "opensecrets": [("opensecrets.org", None, r"N\d{8}")],
    "fec": [("fec.gov", ("data", "candidate"), r"[A-Z0-9]{9}")],
    "wikipedia": [("en.wikipedia.org", ("wiki",), r".+")],
}
#: A link or a path: everything up to white space or a quotation mark around a slash.
_LINK = r"""([^\s"']+/[^\s"']+)"""


def _place(links: Column, host: str, before: tuple[str, ...] | None, shape: str) -> Column:
    """The identifier in the first of the links (arrays of segments, host first) that has one at this place."""

    def of(link: Column) -> Column:
        site = F.regexp_replace(F.lower(F.get(link, F.lit(0))), "^www[.]", "")
        if before is None:
            here, value = site == host, F.array_join(F.slice(link, 2, F.size(link)), "/")
            return F.when(here, F.nullif(F.regexp_extract(value, f"({shape})", 1), F.lit("")))
        steps = before if host else before[1:]
        here = site == (host or before[0])
        for k, step in enumerate(steps):
            here = here & (F.size(link) > k + 2 if step == "*" else F.lower(F.get(link, F.lit(k + 1))) == step)
        rest = F.array_join(F.slice(link, len(steps) + 2, F.size(link)), "/")
        return F.when(here, F.nullif(F.regexp_extract(rest, f"^({shape})", 1), F.lit("")))

    return F.get(F.array_compact(F.transform(links, of)), F.lit(0))


def external_ids(c: Column) -> dict[str, Column]:
    """The identifiers that links in a text hold. Names from paths are decoded; one that can't be stays as it is."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_LINK), F.lit(1))
    links = F.transform(found, lambda x: F.split(F.regexp_replace(x, "^[A-Za-z]+://", ""), "/"))
    out = {}
    for name, places in PERSON_LINKS.items():
        one = F.coalesce(*[_place(links, *p) for p in reversed(places)])
        if name in ("ballotpedia", "wikipedia"):
            one = F.coalesce(F.try_url_decode(F.replace(one, F.lit("+"), F.lit("%2B"))), one)
        out[name] = one.alias(name)
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.rtrim(x))
    handles = F.filter(lines, lambda x: F.startswith(F.ltrim(x), F.lit("twitter:")) & ~F.startswith(x, F.lit("t")))
    handle = F.split(F.trim(F.split_part(F.get(handles, F.lit(0)), F.lit("twitter:"), F.lit(2))), r"\s")[0]
    out["twitter"] = F.nullif(handle, F.lit("")).alias("twitter")
    return out


#: The kinds of a bill's versions.
VERSION_KINDS = ("Introduced", "Amended", "Enrolled", "Chaptered")


def version_kind(action: Column) -> Column:
    """The kind that an action begins with, or the action itself."""
    return F.coalesce(*[F.when(F.startswith(F.lower(action), F.lit(k.lower())), k) for k in VERSION_KINDS], action)


def version_code(url: Column) -> Column:
    """`ih` of a link to BILLS-118hr1ih.xml; empty where there is none."""
    name = F.lower(F.element_at(F.split(F.coalesce(url, F.lit("")), "/"), -1))
    stem, kind = F.substring_index(name, ".", 1), F.substring_index(name, ".", -1)
    parts = F.split(stem, "-")  # bills, then congress, type, number and code in one
    code = F.regexp_replace(F.get(parts, F.lit(1)), r"^\d+[a-z]+\d+", "")
    whole = (F.size(parts) == 2) & (parts[0] == "bills") & kind.isin("htm", "xml", "pdf") & code.rlike("^[a-z]+$") & ~code.eqNullSafe(F.get(parts, F.lit(1)))
    return F.when(whole, code).otherwise("")


def version_slot(url: Column, bill: Column) -> Column:
    """The slot of a bill's version: the bill and its code, or the bill alone where the link has none."""
    code = version_code(url)
    return F.concat_ws(":", bill.cast("string"), F.nullif(code, F.lit("")))


def authors(c: Column) -> Column:
    """Names between semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def nuclide(c: Column, symbols: Column) -> Column:
    """Mass number, symbol and neutrons of codes such as 137Cs; symbols: element symbols by proton number, from 0. Null for other codes."""
    form = r"^(\d{1,3})([A-Za-z]{1,2})$"
    mass, symbol = F.regexp_extract(c, form, 1).try_cast("int"), F.initcap(F.regexp_extract(c, form, 2))
    protons = F.array_position(symbols, symbol).cast("int") - 1
    return F.when(c.rlike(form) & (protons >= 0) & (mass >= protons), F.struct(protons.alias("z"), (mass - protons).alias("n"), mass.alias("a"), symbol.alias("symbol")))


def disallowed(rules: Column, path: Column) -> Column:
    """Whether a crawler's rule forbids the path. A rule without * is a prefix; else the part before the first * is, and what follows must be somewhere."""

    def forbids(rule: Column) -> Column:
        star = F.instr(rule, F.lit("*"))
        before, after = F.left(rule, star - 1), F.regexp_replace(rule.substr(star + 1, F.length(rule)), r"\$$", "")
        return F.when(star == 0, path.startswith(rule)).otherwise(path.startswith(before) & ((after == "") | path.contains(after)))

    return F.exists(rules, forbids)


def merged_answers(old: Column, new: Column) -> Column:
    """Two maps of answers as one; new ones win. A null map is an empty one."""
    old, new = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (old, new))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, new)


def answer_fields(c: Column, fence: str = "answers") -> Column:
    """`key: value` lines of the fenced blocks as a map, the last value of a key winning; `#done` lines are not keys."""
    blocks = F.regexp_extract_all(c, F.lit(rf"(?s)```{fence}\s*(.*?)```"), F.lit(1))
    lines = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda x: F.trim(x))
    pairs = F.filter(lines, lambda x: (F.instr(x, F.lit(":")) > 1) & ~x.startswith("#done"))
    entries = F.transform(
        pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(x.substr(F.instr(x, F.lit(":")) + 1, F.length(x))).alias("value"))
    )
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda l: l["key"] == e["key"]))
    return F.map_from_entries(last)


def answers_done(c: Column, fence: str = "answers") -> Column:
    blocks = F.regexp_extract_all(c, F.lit(rf"(?s)```{fence}\s*(.*?)```"), F.lit(1))
    lines = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda x: F.trim(x))
    done = F.transform(F.filter(lines, lambda x: x.startswith("#done")), lambda x: F.trim(x.substr(F.lit(6), F.length(x))))
    return F.array_distinct(F.filter(done, lambda x: x != ""))
