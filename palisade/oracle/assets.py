from palisade.operators import assets as A
from palisade.oracle.sql import lit

LUHN = """(length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
  CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT)
  ELSE CASE WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN CAST(substr(d, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(d, i, 1) AS INT) * 2 END END)) % 10 = 0)"""


def cards(x: str) -> str:
    runs = f"list_transform(regexp_extract_all({x}, {lit(A.CARD_RUN)}), lambda m: regexp_replace(m, '\\D', '', 'g'))"
    return f"list_distinct(list_filter({runs}, lambda d: {LUHN}))"


def _x(x: str, p: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {lit(p)}, {g}), '')"


def secrets(t: str) -> dict[str, str]:
    low = f"lower({t})"
    stated = f"regexp_replace(regexp_replace({_x(low, A.EXPIRY)}, '^([^-]*)-', '\\1/'), '^([^.]*)\\.', '\\1/')"
    alone = _x(low, A.EXPIRY_ALONE)
    m = lambda e: f"CAST(substr({e}, 1, 2) AS INT)"
    return {
        "cvv": _x(low, A.CVV),
        "expiry": f"CASE WHEN {m(stated)} BETWEEN 1 AND 12 THEN {stated} WHEN {m(alone)} BETWEEN 1 AND 12 AND CAST(substr({alone}, 4, 2) AS INT) BETWEEN 24 AND 39 THEN {alone} END",
        "otp": _x(low, A.OTP),
        "gps": f"nullif(trim(regexp_extract({low}, {lit(A.GPS)})), '')",
        "sabotage": _x(low, A.SABOTAGE, 0),
        "seed": f"coalesce(trim({_x(low, A.SEED, 0)}), trim({_x(low, A.SEED_ALONE)}))",
        "password": _x(t, A.PASSWORD),
    }


def lone(t: str) -> str:
    x = f"lower({t})"
    for p, r in ((A.CARD_RUN, " "), (A.EXPIRY_MARK, " "), (A.PHONE, " "), (A.LONG_NUMBER, "\\1 \\2"), (A.MONEY, " ")):
        x = f"regexp_replace({x}, {lit(p)}, '{r}', 'g')"
    found = f"list_filter(regexp_extract_all(regexp_replace({x}, '(\\D)', '\\1\\1', 'g'), '(?:^|\\D)([0-9]{{3,4}})(?:$|\\D)', 1), lambda d: NOT (length(d) = 4 AND CAST(d AS INT) BETWEEN 1920 AND 2050))"
    return f"CASE WHEN NOT regexp_matches(lower({t}), {lit(A.OTP)}) THEN ({found})[1] END"
