"""Functions on texts with the right answers spelt out."""

from collections.abc import Callable

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import normalize, parse, text
from lodestrata.operators import search

N = "\n"
CASES: dict[str, tuple[list, Callable[[Column], Column]]] = {}


def cases(name, rows, answer):
    CASES[name] = (rows, answer)


cases(
    "entity_cases",
    [
        ("a &amp; b &lt;c&gt; &quot;d&quot;", "a & b <c> \"d\""),
        ("&&#35;65; &#65; &&#108;t; &#x00000000000041;", "&#65; A &lt; A"),
        ("it&#8217;s &#x41;&#X42; &#128512;", "it\u2019s AB \U0001f600"),
        ("&amp;#8217; &#38;lt; &amp;amp; &#x26;amp;", "&#8217; &lt; &amp; &amp;"),
        ("&#0; &#55296; &#1114112; &unknown; &#xZZ;", "&#0; &#55296; &#1114112; &unknown; &#xZZ;"),
        ("&NBSP;&Sect;12 &mdash; &#x2014;", " \u00a712 \u2014 \u2014"),
        ("", ""),
        (None, None),
    ],
    text.decode_entities,
)
cases(
    "html_text_cases",
    [
        ("<p>One&#160;two</p><p>Three</p>", "One\u00a0two" + N + N + "Three"),
        ("a<br>b<br/>c", "a" + N + "b" + N + "c"),
        ("<p>keep <del>old</del><ins>new &#8212; text</ins></p>", "keep [-old-]{+new \u2014 text+}"),
        ("<script>var x = '<p>';</script>left", "left"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "1" + "\t" + "2"),
        ("<!-- <p>no</p> -->yes", "yes"),
        (None, None),
    ],
    text.html_to_text,
)
cases(
    "xml_text_cases",
    [
        ("<?xml version='1.0'?><bill><header>Sec. 1</header><text>A &amp; B &#167; 2</text></bill>", "Sec. 1" + N + N + "A & B \u00a7 2"),
        ("<!DOCTYPE bill><a><b>x</b><c>y</c></a>", "  x  y"), ("<paragraph>a<enum>(1)</enum>b &lt;c&gt;</paragraph>", "a" + N + "(1)" + N + "b <c>"),
        ("<text>one</text><!-- two --><text>three</text>", "one" + N + N + "three"),
        (None, None),
    ],
    text.xml_to_text,
)
cases(
    "accent_cases",
    [
        ("Å\u0159\u012bs\u0101 \u0150si \u0160t\u011bp\u00e1n", "arisa osi stepan"),
        ("e\u0301te\u0301 NOËL", "ete noel"),
        ("stra\u00dfe \u00f8re", "stra\u00dfe \u00f8re"),
        ("\u039a\u03ac\u03c4\u03c9", "\u03ba\u03b1\u03c4\u03c9"),
        (None, ""),
    ],
    normalize.strip_accents,
)
for _id, _rows in {
    "ballotpedia": [("see https://ballotpedia.org/Ann_O%27Hara now", "Ann_O'Hara"), ("ballotpedia.org/A%ZZ", "A%ZZ"), ("ballotpedia.org/A+B", "A+B"), ("none", None)],
    "votesmart": [("votesmart.org/candidate/biography/12/x", "12"), ("https://justfacts.votesmart.org/candidate/evaluations/345/y", "345"), ("votesmart.org/candidate/77", "77"), (None, None)],
    "bioguide": [("bioguide.congress.gov/search/bio/A000123", "A000123"), ("images/congress/450x550/B000456.jpg", "B000456"), ("bioguide a000123", None)],
    "twitter": [("id:" + N + "  twitter: Someone" + N, "Someone"), ("twitter: x", None)],
    "wikipedia": [("https://en.wikipedia.org/wiki/Jos%C3%A9_B", "Jos\u00e9_B"), ("de.wikipedia.org/wiki/X", None)],
}.items():
    cases(f"{_id}_cases", _rows, lambda c, _id=_id: parse.external_ids(c)[_id])
cases(
    "mention_cases",
    [
        ("H.R. 12 and H R 13, HR14", "HB12,HB13,HB14"),
        ("H.J.Res. 7; S.J. Res. 8; H. Con. Res. 9; S.Con.Res.10", "HJR7,SJR8,HCR9,SCR10"),
        ("S. 5 but not US 5 nor S 6", "SB5"),
        ("H.Res. 1, S. Res. 2, H.Res. 1 again", "HR1,SR2"),
        ("nothing", ""),
        (None, None),
    ],
    lambda c: F.array_join(parse.bill_mentions(c), ","),
)
cases(
    "version_kind_cases",
    [("Introduced 1/2", "Introduced"), ("AMENDED IN SENATE", "Amended"), ("enrolled", "Enrolled"), ("Chaptered by Secretary", "Chaptered"), ("Vetoed", "Vetoed"), (None, None)],
    parse.version_kind,
)
cases(
    "version_code_cases",
    [("https://x.gov/BILLS-118hr1ih.xml", "ih"), ("BILLS-117sjres22ENR.pdf", "enr"), ("BILLS-118hr1.xml", ""), ("y.htm", ""), (None, "")],
    parse.version_code,
)
cases("author_cases", [("Doe, J.; Roe, R. ;; Poe, E.", "Doe, J.|Roe, R.|Poe, E."), (" ; ", ""), (None, "")], lambda c: F.array_join(parse.authors(c), "|"))


def _nuclide(c: Column) -> Column:
    found = parse.nuclide(c, F.array(*map(F.lit, normalize.ELEMENTS)))
    return F.when(found.isNotNull(), F.concat_ws("/", *[found[f].cast("string") for f in ("z", "n", "a", "symbol")]))


cases(
    "nuclide_cases",
    [("14C", "6/8/14/C"), ("4HE", "2/2/4/He"), ("1n", None), ("3Xx", None), ("137CS", "55/82/137/Cs"), ("238u", "92/146/238/U"), ("C14", None), ("1234H", None), (None, None)],
    _nuclide,
)
cases("chamber_name_cases", [("s", "Senate"), ("Assembly", "Assembly"), ("H", "House"), ("L", "Legislature"), ("c", "Council"), ("x", "X"), ("", None), (None, None)], normalize.chamber_name)
cases("lower_house_cases", [("NY", "Assembly"), ("NE", "Legislature"), ("DC", "Council"), ("US", "House"), ("TX", "House"), (None, "House")], normalize.lower_house)
cases(
    "robots_cases",
    [("/private/x", "true"), ("/public", "false"), ("/a/b.pdf", "true"), ("/a/b.html", "false"), ("/search?q=1", "true"), ("/tmp", "true")],
    lambda c: parse.disallowed(F.array(*map(F.lit, ["/private", "/a/*.pdf$", "/search*", "/t*"])), c),
)
cases("shell_cases", [("You need to enable JavaScript to run this app.", "true"), ("You need to enable JavaScript to run this app." + "x" * 400, "false"), ("A bill", "false"), ("", "false")], text.is_shell)

cases(
    "stem_cases",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("taxes", "tax"), ("taxing", "tax"), ("house", "hous"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"),
        ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("", ""), (None, None),
    ],
    search.stemmed,
)

cases(
    "div_cases",
    [
        ('<div class="a"><div class="body x">one<div>two</div>three</div>four</div>', "one<div>two</div>three"),
        ("<DIV id=1 CLASS='body'></DIV>", ""),
        ('<div class="nobody">a</div>', None),
        ('<div class="body">open<div>more', "open<div>more"),
        (None, None),
    ],
    lambda c: text.div_by_class(c, "body"),
)



cases(
    "prose_cases",
    [
        ("# Head" + N + "a **bold** and *soft* `code`[1] [label](http://x)" + N * 3 + "- item" + N + "12. other" + N + "---" + N + "```" + N + "x = 1" + N + "```" + N + "end", "a bold and soft code label" + N + "item" + N + "other" + N + "end"),
        ("**a *b* c** #no heading" + N + "#hash", "a b c #no heading" + N + "#hash"),
        ("", ""),
        (None, None),
    ],
    text.plain_prose,
)
cases(
    "tag_cases",
    [
        ("<del>a<ins>b</ins></del>c", "[-a{+b+}-]c"),
        ("<del>a <p>b</del> c", "[-a" + N + "b-] c"),
        ("<u>no end", "no end"),
        ("</del>x", "x"),
        ("<ScRiPt>a</sCrIpT>b<style>no end", "bno end"),
        ("a < b > c", "a  c"),
        ("&<b>amp;</b>", "&"),
    ],
    text.html_to_text,
)


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, answer = CASES[name]
    given = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], "id int, given string")
    got = {r.id: r.got for r in given.select("id", answer(F.col("given")).cast("string").alias("got")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]
