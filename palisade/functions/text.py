"""Column expressions for normalising and profiling text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.dims import language as L

PUNCT = "[\\-_.,!?'\"~*^‘’ʼ]"
WORD = r"[\p{L}\p{N}]"
NON_WORD_START = r"(?<![\p{L}\p{N}])"
NON_WORD_END = r"(?![\p{L}\p{N}])"


def whole_word(core: str) -> str:
    return f"{NON_WORD_START}(?:{core}){NON_WORD_END}"


def strip_invisible(c: Column) -> Column:
    return F.translate(c, L.INVISIBLE, "")


def map_lookalikes(lowered: Column, lang: Column | None) -> Column:
    mapped = F.translate(lowered, L.LOOKALIKE_FROM, L.LOOKALIKE_TO)
    return mapped if lang is None else F.when(lang == "en", lowered).otherwise(mapped)


def normalize_words(c: Column, lang: Column | None = None) -> Column:
    x = map_lookalikes(F.lower(strip_invisible(c)), lang)
    x = F.trim(F.regexp_replace(F.regexp_replace(x, PUNCT, ""), r"\s+", " "))
    # Runs of one-letter tokens become one word.
    return F.regexp_replace(x, r"(?<=(?:^|\s)\S)\s+(?=\S(?:\s|$))", "")


def normalize_continuous(c: Column, lang: Column | None = None) -> Column:
    x = F.regexp_replace(strip_invisible(F.lower(c)), "[\\s\\-_.,!?'\"~*^]", "")
    return map_lookalikes(x, lang)


def canonical_fold(c: Column) -> Column:
    x = F.translate(F.lower(F.trim(strip_invisible(c))), L.FOLD_FROM, L.FOLD_TO)
    x = F.regexp_replace(F.translate(x, "иїы", "ііі"), "йо", "ьо")
    return F.regexp_replace(F.regexp_replace(x, "['`’ʼ\"]", ""), r"(.)\1+", "$1")


def cyrillic_to_latin(c: Column) -> tuple[Column, Column]:
    """The two romanised spellings: и as y, and и as i."""
    x = F.lower(F.trim(c))
    for cyr, lat in L.CYR_TO_LAT.items():
        x = F.replace(x, F.lit(cyr), F.lit(lat))
    x = F.translate(x, L.CYR_SINGLE_FROM, L.CYR_SINGLE_TO)
    return F.translate(x, "и", "y"), F.translate(x, "и", "i")


def latin_to_cyrillic(c: Column) -> Column:
    x = F.lower(F.trim(c))
    for lat, cyr in L.LAT_DIGRAPHS:
        x = F.replace(x, F.lit(lat), F.lit(cyr))
    return F.translate(x, L.LAT_SINGLE_FROM, L.LAT_SINGLE_TO)


def once(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def count_chars(c: Column, char_class: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, char_class, ""))


def _votes(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def language_profile(c: Column) -> Column:
    """Struct(primary, languages, is_mixed, confidence, script, uk, en, ru)."""
    trimmed = F.trim(c)
    x = F.regexp_replace(trimmed, r"(?i)https?://[^\s]+", " ")
    x = F.trim(F.regexp_replace(x, r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+", " "))

    def facts(g: Column, words: Column) -> Column:
        x = g["x"]
        return F.struct(
            g["raw_len"].alias("raw_len"),
            F.length(x).alias("len"),
            F.length(F.regexp_replace(x, "[^A-Za-z]+", "")).alias("lat"),
            F.length(F.regexp_replace(x, "[^Ѐ-ӿ]+", "")).alias("cyr"),
            (
                count_chars(x, "[іІїЇєЄґҐ]")
                + 2 * count_chars(x, "(?<=[Ѐ-ӿ])['’ʼ](?=[Ѐ-ӿ])")
            ).alias("ukm"),
            count_chars(x, "[ыЫэЭъЪёЁ]").alias("rum"),
            _votes(words, L.UK_WORDS).alias("ukw"),
            _votes(words, L.RU_WORDS).alias("ruw"),
            _votes(words, L.EN_WORDS).alias("enw"),
        )

    def words(g: Column) -> Column:
        return F.filter(F.split(F.lower(g["x"]), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)

    given = F.struct(F.length(trimmed).alias("raw_len"), x.alias("x"))
    return once(once(given, lambda g: once(words(g), lambda w: facts(g, w))), _decide)


def _decide(f: Column) -> Column:
    lat, cyr, ukm, rum = f["lat"], f["cyr"], f["ukm"], f["rum"]
    ukw, ruw, enw = f["ukw"], f["ruw"], f["enw"]
    fallback = (f["raw_len"] < 3) | (f["len"] < 3)
    latin = (lat > 0) & (cyr == 0)
    cyrillic = (cyr > 0) & (lat <= 2)
    mixed = (cyr > 0) & (lat > 2)
    no_marks = cyrillic & (ukm == 0) & (rum == 0)
    both = cyrillic & (ukm > 0) & (rum > 0)

    def result(primary, languages, is_mixed, confidence, uk=0, en=0, ru=0):
        return F.struct(
            F.lit(primary).alias("primary"),
            F.lit(languages).alias("languages"),
            F.lit(is_mixed).alias("is_mixed"),
            (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("int").alias("confidence"),
            F.when(fallback, "none").when((cyr > 0) & (lat == 0), "cyrillic").when(latin, "latin")
            .when((lat > 0) & (cyr > 0), "mixed").otherwise("none").alias("script"),
            (ukm * 10 + uk).cast("int").alias("uk"),
            (lat * 2 + en).cast("int").alias("en"),
            (rum * 10 + ru).cast("int").alias("ru"),
        )

    zero = F.struct(
        F.lit("uk").alias("primary"), F.lit("uk,ru,en").alias("languages"), F.lit(False).alias("is_mixed"),
        F.lit(50).alias("confidence"), F.lit("none").alias("script"),
        F.lit(0).alias("uk"), F.lit(0).alias("en"), F.lit(0).alias("ru"),
    )
    v = {"uk": ukw * 15, "ru": ruw * 15}
    m = {"uk": ukw * 15, "en": enw * 15, "ru": ruw * 15}
    latin_heavy = mixed & (lat >= cyr * 1.5)
    return (
        F.when(fallback, zero)
        .when(latin, result("en", "en", False, F.least(F.lit(99), 70 + lat * 2), en=50))
        .when(both & (ukm >= rum), result("uk", "uk,ru", True, 85))
        .when(both, result("ru", "uk,ru", True, 85))
        .when(cyrillic & (ukm > 0), result("uk", "uk", False, F.least(F.lit(99), 75 + ukm * 8), uk=40))
        .when(cyrillic & (rum > 0), result("ru", "ru,uk", False, F.least(F.lit(99), 75 + rum * 8), ru=40))
        .when(no_marks & (ukw > ruw), result("uk", "uk,ru", False, 85, **v))
        .when(no_marks & (ruw > ukw), result("ru", "ru,uk", False, 85, **v))
        .when(no_marks, result("uk", "uk,ru", False, 60, **v))
        .when(latin_heavy & (ukm == 0) & (rum > 0), result("en", "en,ru,uk", True, 75, **m))
        .when(latin_heavy, result("en", "en,uk", True, 75, **m))
        .when(mixed & ((ukm > 0) | (ukw >= ruw)), result("uk", "uk,en", True, 75, **m))
        .when(mixed, result("ru", "ru,en,uk", True, 75, **m))
        .otherwise(result("uk", "uk", False, 80))
    )


_URL = (
    r"(?:(?:https?|ftp)://)?(?:www\.)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\s*\.\s*)+[a-z]{2,10}"
    r"(?:\s*/\s*[a-z0-9\-_?=&#%]*)*(?=\s|$)"
)
# Spelled-out dots.
DOT_MASKS = [
    r"\s*\[\s*\.\s*\]\s*", r"\s*\(\s*\.\s*\)\s*", r"\s*\[\s*dot\s*\]\s*", r"\s*\(\s*dot\s*\)\s*",
    r"\s*\(крапка\)\s*", r"\s*\[крапка\]\s*", r"\s+точка\s+",
]


def unmask_dots(c: Column) -> Column:
    x = F.lower(c)
    for mask in DOT_MASKS:
        x = F.regexp_replace(x, mask, ".")
    return F.regexp_replace(x, r"([a-z0-9])\s*-\s*([a-z0-9])", "$1-$2")


def extract_urls(c: Column) -> Column:
    found = F.regexp_extract_all(unmask_dots(c), F.lit(_URL), F.lit(0))

    def tidy(u: Column) -> Column:
        u = F.regexp_replace(F.regexp_replace(u, r"\s*\.\s*", "."), r"\s*/\s*", "/")
        return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))

    return F.transform(found, tidy)


def host_of(url: Column) -> Column:
    """Scheme, user part, port, path and a leading www. removed."""
    x = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    x = F.regexp_extract(x, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(x, r"^www\.", "")


def word_runs(words: Column, n: int) -> Column:
    """All runs of n neighbouring words; elements are read by position, so long texts cost linear time."""
    return F.when(
        F.size(words) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (n - 1)),
            lambda p: F.concat_ws(" ", *[F.element_at(words, p + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<string>"))
