"""Fixture tables derived from the given tables; every formula has a twin in ``palisade.oracle.planted``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.dims.phrases import AHEAD_MS, CYCLE, EPOCH_MS, FUTURE, GAPS_MS, PHRASES
from palisade.sources.tables import spread, table


def phrase_bank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PHRASES, "k int, lang string, kind string, phrase string, truth_type string, truth_assessment string"
    )


def sent_ms() -> Column:
    """Time stamp of a turn; some are ahead of the clock."""
    gap = F.element_at(F.array(*[F.lit(g) for g in GAPS_MS]), (F.col("conv_id") % 4 + 1).cast("int"))
    return F.lit(EPOCH_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * gap + F.when(F.expr(FUTURE), AHEAD_MS).otherwise(0)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, ts_ms, direction, text, truth_type, truth_assessment; one row per spoken turn."""
    conv = spread(table(spark, folder, "conversations"), "conv_id", "turn").filter(F.col("role").isin("user", "assistant"))
    base = conv.select(
        "conv_id",
        "turn",
        sent_ms().alias("ts_ms"),
        F.when(F.col("role") == "user", "outbound").otherwise("inbound").alias("direction"),
        F.col("text").alias("raw"),
        ((F.col("conv_id") * 7 + F.col("turn")) % CYCLE).cast("int").alias("k"),
    )
    # The phrase bank is a fixed list of a few dozen rows, hence safe to broadcast.
    joined = base.join(F.broadcast(phrase_bank(spark)), "k", "left")
    return joined.select(
        "conv_id",
        "turn",
        "ts_ms",
        "direction",
        F.when(F.col("phrase").isNull(), F.col("raw"))
        .when(F.col("conv_id") % 2 == 0, F.col("phrase"))
        .otherwise(F.concat("raw", F.lit(". "), "phrase"))
        .alias("text"),
        "truth_type",
        F.coalesce("truth_assessment", F.lit("safe")).alias("truth_assessment"),
    )


# Item fields as SQL that both engines read the same way.
WATCHLIST_SQL = """
SELECT c_custkey AS item_id, category, label, real_value, decoy_value, c_custkey % 41 <> 11 AS enabled,
  CASE category
    WHEN 'MOTHER_MAIDEN_NAME' THEN 'дівоче прізвище' WHEN 'TAX_ID' THEN 'іпн' WHEN 'SECRET_WORD' THEN 'кодове слово'
    WHEN 'PASSPORT_ID' THEN 'номер паспорта' WHEN 'DATE_OF_BIRTH' THEN 'дата народження'
    WHEN 'FINANCIAL_PHONE' THEN 'номер телефону банку' WHEN 'FATHER_NAME' THEN 'по батькові' ELSE 'таємний пароль' END AS keyword
FROM (
  SELECT c_custkey, category, category || '-' || c_custkey AS label,
    CASE category
      WHEN 'MOTHER_MAIDEN_NAME' THEN concat(substr('КоШеБоМеСиГоЛиДуПаЖи', CAST(1 + 2 * (c_custkey % 10) AS INT), 2),
        substr('валебаримучошасорихо', CAST(1 + 2 * ((c_custkey // 10) % 10) AS INT), 2),
        substr('вкнмлрсдтж', CAST(1 + (c_custkey // 100) % 10 AS INT), 1), 'енко')
      WHEN 'TAX_ID' THEN CAST(3000000000 + (c_custkey * 7919) % 999999937 AS STRING)
      WHEN 'SECRET_WORD' THEN 'калина міст ' || c_custkey
      WHEN 'PASSPORT_ID' THEN 'АВ ' || lpad(CAST((c_custkey * 37) % 1000000 AS STRING), 6, '0')
      WHEN 'DATE_OF_BIRTH' THEN concat(lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), '.',
        lpad(CAST(1 + (c_custkey // 28) % 12 AS STRING), 2, '0'), '.', CAST(1950 + (c_custkey // 336) % 55 AS STRING))
      WHEN 'FINANCIAL_PHONE' THEN '+38067' || lpad(CAST((c_custkey * 7919) % 10000000 AS STRING), 7, '0')
      WHEN 'FATHER_NAME' THEN concat(substr('ОлегАндрІванЮрійЯків', CAST(1 + 4 * ((c_custkey // 8) % 5) AS INT), 4), 'ович', CAST(c_custkey AS STRING))
      ELSE 'токен-' || c_custkey END AS real_value,
    CASE category WHEN 'MOTHER_MAIDEN_NAME' THEN 'Оксана' WHEN 'TAX_ID' THEN '2987654321' WHEN 'SECRET_WORD' THEN 'Дніпро'
      WHEN 'PASSPORT_ID' THEN 'АА 654321' WHEN 'DATE_OF_BIRTH' THEN '01.01.1990' WHEN 'FINANCIAL_PHONE' THEN '+380679876543'
      WHEN 'FATHER_NAME' THEN 'Олександр' ELSE 'DecoyValue' END AS decoy_value
  FROM (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'MOTHER_MAIDEN_NAME' WHEN 1 THEN 'TAX_ID' WHEN 2 THEN 'SECRET_WORD'
      WHEN 3 THEN 'PASSPORT_ID' WHEN 4 THEN 'DATE_OF_BIRTH' WHEN 5 THEN 'FINANCIAL_PHONE' WHEN 6 THEN 'FATHER_NAME'
      ELSE 'CUSTOM' END AS category FROM {customer}))"""

# A fragment goes after the text of a document: the value of the customer with the same number, in several spellings,
# or payment data.
DOCUMENTS_SQL = """
SELECT doc_id, lang, source, CASE doc_id % 23
    WHEN 1 THEN concat(text, ' ', real_value)
    WHEN 2 THEN concat(text, ' (', upper(real_value), ').')
    WHEN 3 THEN concat(text, ' ', replace(real_value, '.', '-'), ' end')
    WHEN 4 THEN concat(text, ' ', replace(replace(real_value, 'и', 'і'), 'о', 'оо'), ' end')
    WHEN 5 THEN concat(text, ' ', substr(real_value, 1, 2), substr(real_value, 4), ' end')
    WHEN 6 THEN concat(text, ' ', substr(real_value, 1, 1), substr(real_value, 3, 1), substr(real_value, 2, 1), substr(real_value, 4))
    WHEN 7 THEN concat(text, ' card 4111 1111 1111 1111 cvv 452 valid until 08/28 ')
    WHEN 8 THEN concat(text, ' card 5500-0055-5555-5559, confirmation code 849213 ')
    WHEN 9 THEN concat(text, ' password: Qwerty2026 end')
    WHEN 10 THEN concat(text, ' phone: +380 67 123 45 67, mail olena.k@example.com, IBAN UA213223130000026007233566001')
    WHEN 11 THEN concat(text, ' Мене звати Олена Коваленко, адреса: вул. Садова, 12')
    WHEN 12 THEN concat(text, ' see https://shop.example.com/checkout/item77?user=olena and @some_handle')
    WHEN 13 THEN concat(text, ' at 50.45010, 30.52340 passport AB123456')
    ELSE text END AS text
FROM {documents} LEFT JOIN {items} ON item_id = doc_id"""


def watchlist(spark: SparkSession, folder: str) -> DataFrame:
    sql = WATCHLIST_SQL.replace("//", "div").replace("{customer}", "{c}")
    return spark.sql(sql, c=table(spark, folder, "customer"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    sql = DOCUMENTS_SQL.replace("{documents}", "{d}").replace("{items}", "{w}")
    return spark.sql(sql, d=spread(table(spark, folder, "documents"), "doc_id"), w=watchlist(spark, folder))
