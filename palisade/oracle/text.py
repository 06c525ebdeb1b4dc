"""DuckDB fragments for normalisation, written without look-around."""

from palisade.dims import language as L
from palisade.functions.text import DOT_MASKS
from palisade.oracle.sql import cte, lit, strlist


def norm_words(x: str, lang: str | None) -> str:
    low = f"lower(translate({x}, {lit(L.INVISIBLE)}, ''))"
    mapped = f"translate({low}, {lit(L.LOOKALIKE_FROM)}, {lit(L.LOOKALIKE_TO)})"
    if lang:
        mapped = f"CASE WHEN {lang} = 'en' THEN {low} ELSE {mapped} END"
    flat = f"trim(regexp_replace(regexp_replace({mapped}, '[\\-_.,!?''\"~*^‘’ʼ]', '', 'g'), '\\s+', ' ', 'g'))"
    padded = f"(' ' || replace({flat}, ' ', '  ') || ' ')"
    glued = f"replace(replace(regexp_replace({padded}, ' (\\S) ', chr(1) || '\\1' || chr(1), 'g'), chr(1) || chr(1), ''), chr(1), ' ')"
    return f"trim(regexp_replace({glued}, ' +', ' ', 'g'))"


def norm_continuous(x: str) -> str:
    y = f"regexp_replace(translate(lower({x}), {lit(L.INVISIBLE)}, ''), '[\\s\\-_.,!?''\"~*^]', '', 'g')"
    return f"translate({y}, {lit(L.LOOKALIKE_FROM)}, {lit(L.LOOKALIKE_TO)})"


# Pairs of one letter, so that only texts which hold one are taken apart.
_PAIRS = "|".join(
    ("\\" if chr(i) in "\\.+*?()|[]{}^$" else "") + chr(i) + ("\\" if chr(i) in "\\.+*?()|[]{}^$" else "") + chr(i)
    for r in (range(0x20, 0x7F), range(0xA1, 0x180), range(0x400, 0x500), range(0x2010, 0x2030))
    for i in r
)


def collapse(x: str) -> str:
    return f"CASE WHEN NOT regexp_matches({x}, {lit(_PAIRS)}) THEN {x} ELSE array_to_string(list_transform(list_filter(list_zip(string_split({x}, ''), [''] || string_split({x}, '')[:-2]), lambda p: p[1] <> p[2]), lambda p: p[1]), '') END"


def fold(x: str) -> str:
    y = f"translate(lower(trim(translate({x}, {lit(L.INVISIBLE)}, ''))), {lit(L.FOLD_FROM)}, {lit(L.FOLD_TO)})"
    y = f"regexp_replace(replace(translate({y}, 'иїы', 'ііі'), 'йо', 'ьо'), '[''`’ʼ\"]', '', 'g')"
    return collapse(y)


def to_latin(x: str, y_or_i: str) -> str:
    out = f"lower(trim({x}))"
    for cyr, lat in L.CYR_TO_LAT.items():
        out = f"replace({out}, {lit(cyr)}, {lit(lat)})"
    out = f"replace({out}, 'и', {lit(y_or_i)})"
    return f"translate({out}, {lit(L.CYR_SINGLE_FROM)}, {lit(L.CYR_SINGLE_TO)})"


def to_cyrillic(x: str) -> str:
    out = f"lower(trim({x}))"
    for lat, cyr in L.LAT_DIGRAPHS:
        out = f"replace({out}, {lit(lat)}, {lit(cyr)})"
    return f"translate({out}, {lit(L.LAT_SINGLE_FROM)}, {lit(L.LAT_SINGLE_TO)})"


def count(x: str, cls: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{cls}', '', 'g')))"


def urls(x: str) -> str:
    y = f"lower({x})"
    for mask in DOT_MASKS:
        y = f"regexp_replace({y}, {lit(mask)}, '.', 'g')"
    y = f"regexp_replace({y}, '([a-z0-9])\\s*-\\s*([a-z0-9])', '\\1-\\2', 'g')"
    found = (
        f"regexp_extract_all(replace(replace({y}, ' ', '  '), chr(10), chr(10)||chr(10)) || ' ', "
        "'((?:(?:https?|ftp)://)?(?:www\\.)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\s*\\.\\s*)+[a-z]{2,10}(?:\\s*/\\s*[a-z0-9\\-_?=&#%]*)*)\\s', 1)"
    )
    tidy = "regexp_replace(regexp_replace(u, '\\s*\\.\\s*', '.', 'g'), '\\s*/\\s*', '/', 'g')"
    return f"list_transform({found}, lambda u: CASE WHEN {tidy} LIKE 'http%' THEN {tidy} ELSE 'https://' || {tidy} END)"


def host(x: str) -> str:
    return (
        f"regexp_replace(regexp_extract(regexp_replace(lower(trim({x})), '^[a-z][a-z0-9+.-]*://', ''), "
        "'^(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '')"
    )


def votes(words: list[str]) -> str:
    return f"len(list_filter(words, lambda w: list_contains({strlist(words)}, w)))"


def language_facts(source: str, keys: str) -> str:
    cleaned = "trim(regexp_replace(regexp_replace(trim(text), '(?i)https?://[^\\s]+', ' ', 'g'), '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+', ' ', 'g'))"
    x = "x"
    apostrophes = (
        "(len(regexp_extract_all(regexp_replace(x, '([Ѐ-ӿ])', '\\1\\1', 'g'), "
        "'[Ѐ-ӿ][''’ʼ][Ѐ-ӿ]')))"
    )
    return f"""
SELECT {keys}, text, length(trim(text)) AS raw_len, length(x) AS len, {count(x, '[A-Za-z]')} AS lat,
  {count(x, '[Ѐ-ӿ]')} AS cyr, {count(x, '[іІїЇєЄґҐ]')} + 2 * {apostrophes} AS ukm, {count(x, '[ыЫэЭъЪёЁ]')} AS rum,
  {votes(L.UK_WORDS)} AS ukw, {votes(L.RU_WORDS)} AS ruw, {votes(L.EN_WORDS)} AS enw
FROM (SELECT *, list_filter(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2) AS words
      FROM (SELECT *, {cleaned} AS x FROM {source}))"""


def language_rows(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, text, split_part(d, '|', 1) AS primary_lang, split_part(d, '|', 2) AS languages,
  split_part(d, '|', 3) = '1' AS is_mixed, CAST(split_part(d, '|', 4) AS INTEGER) AS confidence,
  CASE WHEN raw_len < 3 OR len < 3 THEN 'none' WHEN cyr > 0 AND lat = 0 THEN 'cyrillic' WHEN lat > 0 AND cyr = 0 THEN 'latin'
    WHEN lat > 0 AND cyr > 0 THEN 'mixed' ELSE 'none' END AS script,
  CASE WHEN raw_len < 3 OR len < 3 THEN 0 ELSE CAST(ukm * 10 + CASE WHEN cyr > 0 AND lat <= 2 AND ukm > 0 AND rum = 0 THEN 40
    WHEN voted THEN ukw * 15 ELSE 0 END AS INTEGER) END AS uk_score,
  CASE WHEN raw_len < 3 OR len < 3 THEN 0 ELSE CAST(lat * 2 + CASE WHEN lat > 0 AND cyr = 0 THEN 50
    WHEN cyr > 0 AND lat > 2 THEN enw * 15 ELSE 0 END AS INTEGER) END AS en_score,
  CASE WHEN raw_len < 3 OR len < 3 THEN 0 ELSE CAST(rum * 10 + CASE WHEN cyr > 0 AND lat <= 2 AND rum > 0 AND ukm = 0 THEN 40
    WHEN voted THEN ruw * 15 ELSE 0 END AS INTEGER) END AS ru_score
FROM (SELECT *, (cyr > 0 AND lat <= 2 AND ukm = 0 AND rum = 0) OR (cyr > 0 AND lat > 2) AS voted,
  CASE WHEN raw_len < 3 OR len < 3 THEN 'uk|uk,ru,en|0|50'
   WHEN lat > 0 AND cyr = 0 THEN 'en|en|0|' || least(99, 70 + lat * 2)
   WHEN cyr > 0 AND lat <= 2 THEN CASE
     WHEN ukm > 0 AND rum = 0 THEN 'uk|uk|0|' || least(99, 75 + ukm * 8)
     WHEN rum > 0 AND ukm = 0 THEN 'ru|ru,uk|0|' || least(99, 75 + rum * 8)
     WHEN ukm > 0 THEN CASE WHEN ukm >= rum THEN 'uk' ELSE 'ru' END || '|uk,ru|1|85'
     WHEN ukw > ruw THEN 'uk|uk,ru|0|85' WHEN ruw > ukw THEN 'ru|ru,uk|0|85' ELSE 'uk|uk,ru|0|60' END
   WHEN cyr > 0 THEN CASE
     WHEN lat >= cyr * 1.5 THEN CASE WHEN ukm = 0 AND rum > 0 THEN 'en|en,ru,uk|1|75' ELSE 'en|en,uk|1|75' END
     WHEN ukm > 0 OR ukw >= ruw THEN 'uk|uk,en|1|75' ELSE 'ru|ru,en,uk|1|75' END
   ELSE 'uk|uk|0|80' END AS d
  FROM ({language_facts(source, keys)}))"""


cte("q_lang", language_rows("q_messages", "conv_id, turn, ts_ms, direction, truth_type, truth_assessment"))
cte("q_norm", f"SELECT *, {norm_words('text', 'primary_lang')} AS norm FROM q_lang")
