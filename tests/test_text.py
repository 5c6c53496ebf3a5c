import unicodedata

import pytest
from pyspark.sql import functions as F

from kinforge.functions import text

NAMES = [
    ("R&D Tools Corp.", "r and d tools"), ("Salt & Stone LLC", "salt and stone"), ("Mireille's Florist Inc", "mireille s florist"), ("Mireille's Florist GmbH", "mireille s florist"),
    ("Mireille's Florist Pty. Ltd.", "mireille s florist"), ("Mireille's Florist Pvt Limited", "mireille s florist"), ("Mireille's Florist S. L. SL", "mireille s florist s l"), ("Mireille's Florist Holdings Ltd Co", "mireille s florist holdings"),
    ("** Quill Ltd Bindery", "quill bindery"), ("Zap+ Couriers plc", "zap couriers"), ("\t Twin   Oaks \n", "twin oaks"), ("GmbH Käse Körner", "kase korner"),
    (">> Çelik Yapı", "celik yap"), ("Garçon Ñandú SARL", "garcon nandu"), (None, ""), ("\t ", ""), ("Ltd", "ltd"), ("Co Ltd", "ltd"), ("Nimbus Co Ltd", "nimbus"), ("Nimbus Holding Corp", "nimbus"), ("漢字会社", ""), ("ﬂour ＋ water", "flour water"),
    ("Inc LLC Ltd", "ltd"), ("Brook Inc Brook", "brook brook"), ("Brook Inc", "brook"),
]
ADDRESSES = [
    ("77 Fern Hollow, Flat 3-B, Eastwick, KT", "77 fern hollow flat 3 b eastwick kt"), ("Plot NO. -9/81, OLD QUARTER, North Quarter, Quarter", "plot no 9 81 old quarter north quarter quarter"),
    ("5 Kiln Yard & Mews, P.O. Box 12", "5 kiln yard and mews p o box 12"), (None, ""), ("", ""),
]


@pytest.mark.parametrize("make, cases", [(text.business_name, NAMES), (text.address, ADDRESSES)])
def test_golden(spark, make, cases):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [y for _, y in cases]


def test_words(spark):
    df = spark.createDataFrame([("Mireille's Florist & Cafe Pty. Ltd.", "31 Lantern Row, Ebbing Sands, QX 40913", "The Old Paper Mill of Ebbing Inn Co")], "a string, b string, c string")
    row = df.select(
        text.name_words(text.business_name(F.col("a"))).alias("a"),
        text.words_of(text.address(F.col("b"))).alias("b"),
        text.name_words(text.business_name(F.col("c")), 4, True).alias("c"),
        text.postal_code(F.col("b")).alias("p"),
    ).first()
    assert row.a == ["mireille", "florist", "and", "cafe"]
    assert row.b == ["31", "lantern", "row", "ebbing", "sands", "qx", "40913"]
    assert row.c == ["paper", "mill", "ebbing"]
    assert row.p == "40913"


def test_fold_agrees_with_decomposition_everywhere(spark):
    points = [p for p in range(0x80, 0x30000) if not 0xD800 <= p < 0xE000]
    texts = ["a" + "".join(map(chr, points[i : i + 64])) + "z" for i in range(0, len(points), 64)]
    got = [r.y for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(8).select("i", text.fold(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_analysis_name_may_lose_everything(spark):
    cases = [("Pvt Ltd", ""), ("Nimbus Spa", "nimbus"), ("Nimbus Pvt. Ltd.", "nimbus"), ("Nimbus Co Inc", "nimbus co"), ("", ""), (None, "")]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", text.analysis_name(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [y for _, y in cases]


def test_strip_takes_all_white_space(spark):
    assert spark.createDataFrame([("\t  In dia \n",)], "x string").select(text.country(F.col("x")).alias("y")).first().y == "in dia"


def test_suffixes_go_word_by_word(spark):
    """As patterns over the whole name would have it, without such patterns; custom suffixes may still be patterns."""
    import re
    from itertools import product

    words = ("inc", "ltd", "pvt", "holding", "corp", "oak", "incx", "and")
    names = ["", *(" ".join(w) for n in (1, 2, 3, 4) for w in product(words, repeat=n))]

    def plain(name):
        one = "(?:" + "|".join(text.SUFFIXES) + ")"
        name = re.sub(" (?:" + "|".join(text.MULTI_WORD_SUFFIXES) + ")$", "", name)
        name = re.sub(f"(?: {one})+$", "", re.sub(f"^(?:{one} )+", "", name))
        kept = name.split(" ")
        return " ".join(w for w in kept if w not in text.SUFFIXES) if len(kept) > 2 else name

    made = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.business_name(F.col("n")).alias("got"), text.business_name(F.col("n"), True, ("o.k",)).alias("custom"))
    assert "incorporated|" not in made.select("got")._jdf.queryExecution().toString()
    rows = made.collect()
    assert len(rows) == len(names) and all(r.got == plain(r.n) for r in rows)
    assert {r.custom for r in rows if r.n == "oak inc"} == {"inc"}
