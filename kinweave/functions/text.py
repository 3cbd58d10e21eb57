"""Names: normal forms, tokens, keys, legal forms, initials, phonetic codes.

Plain functions on strings hold the rules; ``name_views`` runs them all over a column in one Arrow pass. What Spark's own
expressions can say (tokens, keys, n-grams, set measures) is said with columns.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_initials, _honorific = re.compile(fixed.INITIALS), re.compile(fixed.HONORIFIC, re.I)


def basic(text: str | None) -> str:
    """Compatibility form, case folded, "&" spelt out, marks to blanks, single blanks."""
    if not isinstance(text, str):
        return ""
    spelt = unicodedata.normalize("NFKC", text).casefold().replace("&", " and ")
    return " ".join("".join(c if c == "_" or c.isalnum() else " " for c in spelt).split())


def fold(text: str) -> str:
    """Without accents."""
    parts = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    return "".join(filter(lambda c: not unicodedata.combining(c), parts))


def spelt_tokens(name: str | None) -> list[str]:
    return [fixed.ABBREVIATIONS.get(t, t) for t in fold(basic(name)).split()]


def name_tokens(name: str | None) -> list[str]:
    """Tokens without stop words and legal forms; where nothing is left, legal forms stay."""
    kept = [t for t in spelt_tokens(name) if t not in fixed.STOP]
    return [t for t in kept if t not in fixed.LEGAL] or kept


def legal_form(name: str | None) -> str:
    return " ".join(filter(fixed.LEGAL.__contains__, fold(basic(name)).split()))


def key_of(tokens: list[str]) -> str:
    return " ".join(sorted(set(tokens)))


def collapse_initials(text: str | None) -> str | None:
    """S.K. Das -> SK Das; an Indian "M/s" or "Messrs" in front goes; a single initial stays."""
    if not text:
        return text
    joined = _initials.sub(lambda m: "".join(c for c in m[0] if c != "." and not c.isspace()) + " ", _honorific.sub("", text))
    return joined.strip()


def norm_country(country: str | None) -> str | None:
    """Code of a known name; other names in upper case; null for none."""
    name = fold(basic(country))
    return fixed.COUNTRIES[name] if name in fixed.COUNTRIES else name.upper() or None


def norm_postal(code: str | None) -> str | None:
    return re.sub(r"[^0-9a-z]", "", fold(basic(code))) or None


def digits(text: str | None) -> str:
    return re.sub(r"\D", "", text or "")


# Phonetic codes.


def metaphone(word: str) -> str:
    """Metaphone code of an ASCII word, by the published rules; other characters are passed over."""
    w = re.sub(r"[^A-Z]", "", fold(word).upper())
    if not w:
        return ""
    for start, to in (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if w.startswith(start):
            w = to + w[len(start) :]
            break
    vowels, out, i = "AEIOU", [], 0
    while i < len(w):
        c, before, after = w[i], w[i - 1] if i else "", w[i + 1 : i + 2]
        i += 1
        if c == before and c != "C":
            continue
        if c in vowels:
            if i == 1:
                out.append(c)
        elif c == "B":
            if not (before == "M" and i == len(w)):
                out.append("B")
        elif c == "C":
            if after and after in "IEY":
                if before != "S":
                    out.append("X" if w[i : i + 2] == "IA" else "S")
            elif after == "H":
                out.append("K" if before == "S" else "X")
                i += 1
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if after == "G" and w[i + 1 : i + 2] in tuple("EIY") else "T")
        elif c == "G":
            if after == "H" and not (i + 1 < len(w) and w[i + 1] in vowels):
                i += 1
            elif after == "N":
                pass
            else:
                out.append("J" if after and after in "IEY" else "K")
        elif c == "H":
            if after and after in vowels and before not in tuple("CSPTG"):
                out.append("H")
        elif c in "FJLMNR":
            out.append(c)
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
            i += after == "H"
        elif c == "Q":
            out.append("K")
        elif c == "S":
            sh = after == "H" or w[i : i + 2] in ("IO", "IA")
            out.append("X" if sh else "S")
            i += after == "H"
        elif c == "T":
            if w[i : i + 2] in ("IA", "IO"):
                out.append("X")
            elif after == "H":
                out.append("0")
                i += 1
            elif w[i : i + 2] != "CH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after and after in vowels:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
    return "".join(out)


def nysiis(word: str) -> str:
    """NYSIIS code of an ASCII word, by the published rules."""
    w = re.sub(r"[^A-Z]", "", fold(word).upper())
    if not w:
        return ""
    for start, to in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(start):
            w = to + w[len(start) :]
            break
    for end, to in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(end):
            w = w[: -len(end)] + to
            break
    key, rest = w[0], list(w)
    for i in range(1, len(rest)):
        two, three = "".join(rest[i : i + 2]), "".join(rest[i : i + 3])
        if two == "EV":
            rest[i : i + 2] = "AF"
        elif rest[i] in "AEIOU":
            rest[i] = "A"
        elif rest[i] in "QZM":
            rest[i] = {"Q": "G", "Z": "S", "M": "N"}[rest[i]]
        elif two == "KN":
            rest[i] = "N"
        elif rest[i] == "K":
            rest[i] = "C"
        elif three == "SCH":
            rest[i : i + 3] = "SSS"
        elif two == "PH":
            rest[i : i + 2] = "FF"
        elif rest[i] == "H" and (rest[i - 1] not in "AEIOU" or (i + 1 < len(rest) and rest[i + 1] not in "AEIOU")):
            rest[i] = rest[i - 1]
        elif rest[i] == "W" and rest[i - 1] in "AEIOU":
            rest[i] = rest[i - 1]
        if rest[i] != key[-1]:
            key += rest[i]
    if len(key) > 1 and key.endswith("S"):
        key = key[:-1]
    if key.endswith("AY"):
        key = key[:-2] + "Y"
    if len(key) > 1 and key.endswith("A"):
        key = key[:-1]
    return key


VIEWS = "name_norm string, name_fold string, name_clean string, name_key string, legal string, spelt string, code string, name_mp string, name_ny string, name_mp_key string"


def name_views(name: Column, country: Column) -> Column:
    """Struct of all forms of a name (null: empty forms): those of VIEWS, and core_t, clean_t, key_t, legal_t by the country tables.

    Distinct pairs of a batch are worked out once; what the country tables say comes from expressions.
    """

    def views(n: str | None, c: str | None) -> tuple:
        norm, tokens = basic(n), name_tokens(n)
        mp, ny = [metaphone(t) for t in tokens], [nysiis(t) for t in tokens]
        return (norm, fold(norm), " ".join(tokens), key_of(tokens), legal_form(n), " ".join(spelt_tokens(n)), norm_country(c), " ".join(mp), " ".join(ny), key_of([x for x in mp if x]))

    @F.pandas_udf(VIEWS)
    def run(names: pd.Series, countries: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        rows = [memo.get(p) or memo.setdefault(p, views(*p)) for p in zip(names, countries, strict=True)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in VIEWS.split(", ")])

    forms = run(name, country)
    own = [x.split()[0] for x in VIEWS.split(", ") if x not in ("spelt string", "code string")]
    tables = legal_views(forms["spelt"], forms["code"])
    return F.struct(*[forms[c].alias(c) for c in own], *[tables[c].alias(c) for c in ("core_t", "clean_t", "key_t", "legal_t")])


def mapped(rule, c: Column) -> Column:
    """A rule from string to string (collapse_initials, norm_country, norm_postal, ...) over a column, in Arrow batches; each distinct value of a batch is read once."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values, use_na_sentinel=False)
        done = [rule(None if pd.isna(x) else x) for x in distinct]
        return pd.Series([done[k] for k in codes], dtype=object)

    return run(c)


# Columns.


def ok(c: Column) -> Column:
    """Usable: neither null nor empty."""
    return c.isNotNull() & (c != "")


def ascii_norm(c: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 to single blanks: the normal form where ASCII will do."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def char_grams(c: Column, n: int = 3) -> Column:
    """n-grams within words, each word between blanks; a shorter word is one gram. Repeats stay."""

    def of(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        last = F.greatest(F.length(padded) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(n)))

    return F.flatten(F.transform(words(c), of))


def without(tokens: Column, drop) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*sorted(drop)))


def spelt(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.ABBREVIATIONS.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def clean_tokens(c: Column) -> Column:
    kept = without(spelt(words(c)), fixed.STOP)
    core = without(kept, fixed.LEGAL)
    return F.when(F.size(core) > 0, core).otherwise(kept)


def token_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def legal_views(spelt_name: Column, code: Column, tables: dict = fixed.LEGAL_FORMS, passes: int = 2) -> Column:
    """Struct (core_t, clean_t, key_t, legal_t) of a spelt name by the table of its country code: without the legal forms at
    its end, without stop words too, the key of what is left, and the forms' classes in order.

    One pattern per country finds the longest form at the end, as a search meets the leftmost start first; the first token
    always stays. At most ``passes`` forms go.
    """

    def by_country(of) -> Column:
        out = of(tables["_generic"])
        for country, table in tables.items():
            out = out if country == "_generic" else F.when(code == country, of(table)).otherwise(out)
        return out

    ending = lambda table: r"(?<=\S) (" + "|".join(table) + ")$"
    core, classes = F.coalesce(spelt_name, F.lit("")), []
    for _ in range(passes):
        now = core
        classes.insert(0, by_country(lambda t: F.try_element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.regexp_extract(now, ending(t), 1))))  # noqa: B023
        core = by_country(lambda t: F.regexp_replace(now, ending(t), ""))  # noqa: B023
    left = without(words(core), fixed.STOP_WITH_TABLES)
    clean = F.when(F.size(left) > 0, left).otherwise(words(core))
    return F.struct(core.alias("core_t"), F.array_join(clean, " ").alias("clean_t"), token_key(clean).alias("key_t"), F.concat_ws("+", *classes).alias("legal_t"))


# Scripts.


def latin_table(spark, letters: list[str]) -> dict[str, str]:
    """Latin ASCII for each character, by the ICU rules that come with Spark; what they leave beyond ASCII is dropped."""
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII")
    return {c: "".join(x for x in icu.transliterate(c) if x.isascii()) for c in letters}


def transliterated(df, c: str, out: str):
    """Adds the column in ASCII letters: each distinct character beyond ASCII is looked up once, then mapped by expressions.

    The table holds characters, so that it is bounded by Unicode, not by the data. Null stays null.
    """
    beyond = F.regexp_replace(F.col(c), "[\\x{00}-\\x{7F}]", "")
    letters = [r[0] for r in df.select(F.explode(F.array_distinct(F.split(beyond, ""))).alias("x")).where("x <> ''").distinct().collect()]
    if not letters:
        return df.withColumn(out, F.col(c))
    table = latin_table(df.sparkSession, sorted(letters))
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    told = F.array_join(F.transform(F.split(F.col(c), ""), lambda x: F.coalesce(F.try_element_at(lookup, x), x)), "")
    return df.withColumn(out, F.when(F.col(c).rlike("[^\\x{00}-\\x{7F}]"), told).otherwise(F.col(c)))
