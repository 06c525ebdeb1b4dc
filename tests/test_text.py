from pyspark.sql import functions as F

from palisade.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_normalisation(spark):
    assert one(spark, "о п л а т а", T.normalize_continuous) == "оплата"
    assert one(spark, "0лx", T.normalize_continuous) == "олх"
    assert one(spark, "Мій v1ber для 0плати", T.normalize_words) == "мій vіbеr для оплати"
    assert one(spark, "о п л а т а зараз", T.normalize_words) == "оплата зараз"


def test_fold_and_transliteration(spark):
    forms = {one(spark, v, T.canonical_fold) for v in ("Смирнова", "Смырнова", "Смірнова", "Смирноваа", "Cмирнова")}
    assert len(forms) == 1
    assert one(spark, "Смирнова", lambda c: T.cyrillic_to_latin(c)[1]) == "smirnova"
    assert one(spark, "Smirnova", T.latin_to_cyrillic) == "смірнова"


def test_urls(spark):
    assert one(spark, "olx-pay (крапка) com (крапка) ua", T.extract_urls) == ["https://olx-pay.com.ua"]
    assert one(spark, "secure [.] payment [.] com", T.extract_urls) == ["https://secure.payment.com"]
    assert one(spark, "звичайні слова без посилань", T.extract_urls) == []


def test_language(spark):
    assert one(spark, "ok", T.language_profile).primary == "uk"
    p = one(spark, "Please verify your card now", T.language_profile)
    assert (p.primary, p.script) == ("en", "latin")
