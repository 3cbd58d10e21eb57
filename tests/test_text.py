import pytest

from kinweave.functions import text as T


def test_basic_and_fold():
    assert T.basic("  Café & Söhne, Inc. ") == "café and söhne inc"
    assert T.fold(T.basic("Straße Café")) == "strasse cafe"
    assert T.basic(None) == ""


def test_tokens_keys_and_legal_forms():
    assert T.key_of(T.name_tokens("Acme Global LLC")) == T.key_of(T.name_tokens("Global Acme"))
    assert T.name_tokens("Acme Intl LLC") == ["acme", "international"]
    assert T.name_tokens("The Co")
    assert T.legal_form("Acme Pvt Ltd") == "pvt ltd"


@pytest.mark.parametrize(
    "given,expected",
    [("M/s Foo Bar", "Foo Bar"), ("L.L.C.", "LLC"), ("A. Smith", "A. Smith"), ("St. Mary", "St. Mary"), (None, None), ("", "")],
)
def test_collapse_initials(given, expected):
    assert T.collapse_initials(given) == expected


def test_dotted_initials_are_joined():
    assert T.collapse_initials("S.K. Das").split() == ["SK", "Das"]


@pytest.mark.parametrize(
    "name,country,core,classes",
    [
        ("ab enterprises", "US", "ab enterprises", []), ("das brothers and co", "IN", "das brothers", ["AND_CO"]), ("acme private limited", "IN", "acme", ["PVT_LTD"]),
        ("acme pvt ltd", "IN", "acme", ["PVT_LTD"]), ("x sa", "ZZ", "x sa", []), ("x gmbh", "ZZ", "x", ["GMBH"]), ("sarl", "FR", "sarl", []),
    ],
)
def test_legal_forms_at_the_end(spark, name, country, core, classes):
    row = spark.range(1).select(T.legal_views(T.F.lit(name), T.F.lit(country)).alias("v")).select("v.*").first()
    assert (row["core_t"], row["legal_t"]) == (core, "+".join(classes))


def test_country_and_postal():
    assert [T.norm_country(c) for c in ("France", "Atlantis", "", None)] == ["FR", "ATLANTIS", None, None]
    assert T.norm_postal("SW1A 1AA") == "sw1a1aa"
    assert T.norm_postal(" ") is None


def test_phonetic_codes():
    assert T.metaphone("Thompson") == T.metaphone("thompson") != ""
    assert T.metaphone("knight") == T.metaphone("nite") == "NT"
    assert T.nysiis("Johnson") == T.nysiis("Jonson")
    assert T.metaphone("") == T.nysiis("123") == ""


def test_column_forms_match_plain_functions(spark):
    names = ["Acme Intl LLC", "the co", "Foo and Bar Grp Ltd", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    norm = T.ascii_norm(df.n)
    rows = df.select("n", T.clean_tokens(norm).alias("t"), T.token_key(T.clean_tokens(norm)).alias("k")).collect()
    for r in rows:
        if r["n"] is not None:
            assert r["t"] == T.name_tokens(r["n"])
            assert r["k"] == T.key_of(T.name_tokens(r["n"]))


def test_char_grams(spark):
    got = spark.createDataFrame([("ab cde f",)], "n string").select(T.char_grams(T.F.col("n"))).first()[0]
    assert got == [" ab", "ab ", " cd", "cde", "de ", " f "]


def test_name_views_take_nulls(spark):
    rows = spark.createDataFrame([("Acme Pvt Ltd", "IN"), (None, None)], "n string, c string").select(T.name_views(T.F.col("n"), T.F.col("c")).alias("v")).select("v.*").collect()
    assert rows[0]["legal_t"] == "PVT_LTD" and rows[0]["clean_t"] == "acme"
    assert rows[1]["name_clean"] == ""


def test_transliteration_takes_any_script(spark):
    rows = spark.createDataFrame([("Москва",), ("東京 Café",), ("plain",), (None,), ("",)], "n string")
    got = [r["l"] for r in T.transliterated(rows, "n", "l").collect()]
    assert got[0] == "Moskva" and got[1].isascii() and got[1].endswith("Cafe") and got[1] != " Cafe"
    assert got[2:] == ["plain", None, ""]
