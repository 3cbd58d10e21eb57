"""The driver's tables in the roles that the operators need: entities, records, addresses, scored pairs. Whole tables and whole texts.

Labelled documents are entities and the others records; so are benchmark items and turns of conversations, and suppliers
and customers. For every view there is the SQL that says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_norm, words
from ..operators import retrieval as R


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # Documents: labelled ones (e, name, country) and others (r, name, country, source).

    def ent(self) -> DataFrame:
        docs = self.table("documents").join(self.table("labels").select("doc_id"), "doc_id", "left_semi")
        return docs.select(F.col("doc_id").alias("e"), ascii_norm(F.col("text")).alias("name"), F.col("lang").alias("country"), "text")

    def rec(self) -> DataFrame:
        docs = self.table("documents").join(self.table("labels").select("doc_id"), "doc_id", "left_anti")
        return docs.select(F.col("doc_id").alias("r"), ascii_norm(F.col("text")).alias("name"), F.col("lang").alias("country"), "source", "text")

    def truth(self) -> DataFrame:
        """(e, r): a record with the entity's very text."""
        text = F.md5("text").alias("text")  # whole texts needn't move
        return self.ent().select("e", text).join(self.rec().select("r", text), "text").select("e", "r")

    # Benchmark items and turns of conversations.

    def items(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("e"), ascii_norm(F.col("text")).alias("name"))

    def turns(self) -> DataFrame:
        return self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("r"), ascii_norm(F.col("text")).alias("name"), "role")

    # Suppliers and customers with the parts of an address.

    def _place(self, df: DataFrame, key: str, nation: str, balance: str, out: str) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey"), F.lower("n_name").alias("city"), F.lower("r_name").alias("core"))
        house = F.floor(F.abs(balance) / 100).cast("string")
        return df.join(F.broadcast(places), F.col(nation) == F.col("n_nationkey")).select(F.col(key).alias(out), house.alias("house"), "core", "city", F.lpad(house, 4, "0").alias("postal"))

    def suppliers(self) -> DataFrame:
        return self._place(self.table("supplier"), "s_suppkey", "s_nationkey", "s_acctbal", "e")

    def customers(self) -> DataFrame:
        return self._place(self.table("customer"), "c_custkey", "c_nationkey", "c_acctbal", "r")

    def addresses(self) -> DataFrame:
        """(r, line, country): one line of text for each customer."""
        line = F.concat_ws(", ", F.concat_ws(" ", "house", "core", F.lit("Street")), F.concat(F.lit("Suite "), F.substring("postal", 1, 3)), "city", F.concat(F.lit("FR "), "postal", F.lit("0")), F.lit("France"))
        return self.customers().select("r", line.alias("line"), F.lit("FR").alias("country"))

    # Scored pairs.

    def scored(self) -> DataFrame:
        """Users and their events: s from the value, true if a purchase."""
        return self.table("events").select(F.col("user_id").alias("e"), F.col("event_id").alias("r"), F.least(F.col("value") / 100, F.lit(1.0)).alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))

    def truth_counts(self) -> DataFrame:
        return self.scored().groupBy("e").agg(F.sum("y").alias("n_true"))

    def tied(self) -> DataFrame:
        """Suppliers and parts, with many equal scores."""
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("r")).agg((F.max("l_discount") * 10).alias("s"))

    # Vectors of documents, fitted on the entities.

    def word_space(self) -> R.Space:
        """Entity vectors, record vectors, (token, df, idf)."""
        return R.Space(self.ent(), self.rec(), words)

    def gram_space(self) -> R.Space:
        from ..functions.text import char_grams

        return R.Space(self.items(), self.turns(), char_grams)


# The same in SQL.

NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
ENT = f"ent AS (SELECT doc_id AS e, {NORM} AS name, lang AS country, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
REC = f"rec AS (SELECT doc_id AS r, {NORM} AS name, lang AS country, source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
TRUTH = "truth AS (SELECT e, r FROM ent JOIN rec USING (text))"
ITEMS = f"ent AS (SELECT item_id AS e, {NORM} AS name FROM benchmark)"
TURNS = f"rec AS (SELECT conv_id * 1000 + turn AS r, {NORM} AS name, role FROM conversations)"
WORD_TOKENS = "et AS (SELECT e AS id, token FROM (SELECT e, unnest(string_split(name, ' ')) AS token FROM ent) WHERE token <> ''), rt AS (SELECT r AS id, token FROM (SELECT r, unnest(string_split(name, ' ')) AS token FROM rec) WHERE token <> '')"


def _grams(side: str, key: str) -> str:
    return f"(SELECT {key} AS id, substr(w, i, 3) AS token FROM (SELECT {key}, w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM (SELECT {key}, ' ' || unnest(string_split(name, ' ')) || ' ' AS w FROM {side} WHERE name <> '')))"


GRAM_TOKENS = f"et AS {_grams('ent', 'e')}, rt AS {_grams('rec', 'r')}"
IDF = "n AS (SELECT count(*)::DOUBLE AS n FROM ent), dft AS (SELECT token, count(DISTINCT id) AS df FROM et GROUP BY token), idft AS (SELECT token, df, ln((1.0::DOUBLE + n) / (1 + df)) + 1 AS idf FROM dft, n)"


def _vectors(tokens: str, out: str) -> str:
    return (
        f"{out}0 AS (SELECT id, token, count(*) AS tf FROM {tokens} GROUP BY id, token), "
        f"{out}1 AS (SELECT id, a.token, (1 + ln(tf)) * coalesce(idf, ln(1.0::DOUBLE + n) + 1) AS w FROM {out}0 a LEFT JOIN idft USING (token), n), "
        f"{out} AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {out}1)"
    )


VECTORS = f"{IDF}, {_vectors('et', 'ew')}, {_vectors('rt', 'rw')}"
WORD_SPACE = f"{ENT}, {REC}, {WORD_TOKENS}, {VECTORS}"
GRAM_SPACE = f"{ITEMS}, {TURNS}, {GRAM_TOKENS}, {VECTORS}"


def cosines(floor: float) -> str:
    return f"cos AS (SELECT a.id AS e, b.id AS r, round(sum(a.w * b.w), 6) AS s FROM ew a JOIN rw b USING (token) GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 6) >= {floor})"


def _place(table: str, key: str, nation: str, balance: str, out: str) -> str:
    return f"(SELECT {key} AS {out}, floor(abs({balance}) / 100)::BIGINT::VARCHAR AS house, lower(r_name) AS core, lower(n_name) AS city, lpad(floor(abs({balance}) / 100)::BIGINT::VARCHAR, 4, '0') AS postal FROM {table} JOIN nation ON {nation} = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


SUPPLIERS = f"sup AS {_place('supplier', 's_suppkey', 's_nationkey', 's_acctbal', 'e')}"
CUSTOMERS = f"cus AS {_place('customer', 'c_custkey', 'c_nationkey', 'c_acctbal', 'r')}"
SCORED = "scored AS (SELECT user_id AS e, event_id AS r, least(value / 100, 1.0::DOUBLE) AS s, (event_type = 'purchase')::INT AS y FROM events)"
RANKED = (
    f"{SCORED}, ranked0 AS (SELECT *, row_number() OVER w AS rk, lead(s) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY e ORDER BY s DESC, r)), "
    "ranked AS (SELECT e, r, s, y, rk, max(s) OVER (PARTITION BY e) AS top, coalesce(max(CASE WHEN rk = 1 THEN nxt END) OVER (PARTITION BY e), '-inf'::DOUBLE) AS second FROM ranked0)"
)
TRUTHS = "truths AS (SELECT e, sum(y)::BIGINT AS n_true FROM scored GROUP BY e)"
TIED = "tied AS (SELECT l_suppkey AS e, l_partkey AS r, max(l_discount) * 10 AS s FROM lineitem GROUP BY l_suppkey, l_partkey)"
F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END"
