import random

from pyspark.sql import functions as F

from lodestrata import plans
from lodestrata.functions import normalize, parse, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_bill_keys(spark):
    for raw, key in (("A00021", "A21"), ("HB00", "HB0"), ("s. 12-b", "S12B"), (None, "")):
        assert one(spark, normalize.bill_key(F.lit(raw))) == key


def test_surnames(spark):
    for raw, name in (("Barlas, Al", "BARLAS"), ("Joseph P. Addabbo Jr.", "ADDABBO"), ("JACKSON", "JACKSON"), ("  ", ""), (None, "")):
        assert one(spark, normalize.surname(F.lit(raw))) == name


def test_minted_ids(spark):
    assert one(spark, normalize.minted_id(F.lit("A00021"), F.lit(2025))) == 2025 * 10**6 + 500_021
    assert one(spark, normalize.minted_id(F.lit("x"), F.lit(1))) == 1_000_000


def test_districts(spark):
    assert one(spark, normalize.district(F.lit("SD-055"))) == "55"
    assert one(spark, normalize.district(F.lit("HD-004A"))) == "4A"
    assert one(spark, normalize.district(F.lit(None).cast("string"))) == "?"
    assert one(spark, normalize.district_code(F.lit("8"), F.lit("Senate"))) == "SD-008"
    assert one(spark, normalize.district_code(F.lit("0"), F.lit("Senate"))) is None


def test_bill_mentions(spark):
    said = "H.J.Res. 7, S. 12 and H.R. 0040; U.S. 2025 is none; S. 12 again"
    assert one(spark, parse.bill_mentions(F.lit(said))) == ["HJR7", "SB12", "HB40"]


def test_html_keeps_redlines(spark):
    html = "<head><title>x</title></head><p>old <del>gone</del> <ins>new</ins><del> </del></p><td>a</td>b &lt;tag&gt; &amp;lt;"
    assert one(spark, text.html_to_text(F.lit(html))) == "old [-gone-] {+new+}\na\tb <tag> &lt;"


def test_tidy_keeps_indentation(spark):
    assert one(spark, text.tidy(F.lit("\r\n\r\n  a \t\r\n\n\n\nb          c   d\n "))) == "  a\n\nb  c   d"


def test_numeric_entities(spark):
    row = spark.createDataFrame([("&#65;&#x42;&nope;&#0;&eacute;&sect;",)], "t string").select(text.decode_entities("t").alias("v")).first()
    assert row.v == "AB&nope;&#0;&eacute;§"


def test_sections_count_depth(spark):
    body = "<body><sec><title>A</title><sec><title>in</title></sec>x</sec><sec>y</sec></sec></body>"
    row = spark.createDataFrame([(body,), (None,)], "t string").select(text.top_sections("t").alias("v")).collect()
    assert [(s.title, s.xml) for s in row[0].v] == [("A", "<sec><title>A</title><sec><title>in</title></sec>x</sec>"), ("", "<sec>y</sec>")]
    assert row[1].v is None


def test_similarity(spark):
    array = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, similarity.jaccard(array(1, 2), array(2, 3))) == 1 / 3
    assert one(spark, similarity.overlap(array(1, 2, 3), array(3))) == 1 / 3
    assert abs(one(spark, similarity.cosine(array(1.0, 0.0), array(1.0, 1.0))) - 0.5**0.5) < 1e-12
    assert one(spark, similarity.cosine(array(0.0), array(1.0))) is None


def test_entities_by_pieces_are_those_of_the_pattern():
    """Random strings of what entities are made of: pieces between ampersands give what the pattern gives, and known ones aren't matched again."""
    rng = random.Random(5)
    parts = ["&", "#", "x", "X", ";", "amp", "LT", "65", "0041", "00000000000000000000000000000041", "d800", "110000", "nope", " ", "é", "&amp;", "&#65;"]
    for _ in range(5_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert text._decoded(s) == text._ENTITY.sub(text._character, s)
    was = len(text._pieces)
    assert text._decoded("&#66;" * 1_000) == "B" * 1_000 and len(text._pieces) <= was + 1


def test_entities_are_written_in_all_three_forms(spark, tmp_path, monkeypatch):
    """entity_round_trip writes hexadecimal, decimal and named entities, so that names are decoded too, those beyond the first code points among them."""
    whole = "".join(c * 6 for c in text.ENTITIES.values()) + "aé\0\U0001f600"
    spark.createDataFrame([(1, whole), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.text, r.once) for r in plans.QUERIES["entity_round_trip"](spark, str(tmp_path)).collect()} == {1: (whole, "&#65;"), 2: ("", "&#65;")}
    monkeypatch.setattr(text, "decode_entities", lambda c: c)
    written = {r.doc_id: r.text for r in plans.QUERIES["entity_round_trip"](spark, str(tmp_path)).collect()}[1]
    for name, c in text.ENTITIES.items():
        assert all(form in written for form in (f"&{name};", f"&#{ord(c)};", f"&#x0000{ord(c):X};"))
    assert text._decoded(written) == whole
