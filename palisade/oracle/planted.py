from palisade.dims.phrases import AHEAD_MS, CYCLE, EPOCH_MS, FUTURE, GAPS_MS, PHRASES
from palisade.oracle.sql import cte, values

cte("q_phrases", values(PHRASES, "k, lang, kind, phrase, truth_type, truth_assessment"))
cte(
    "q_messages",
    f"""
SELECT conv_id, turn,
  {EPOCH_MS} + conv_id * 3600000 + turn * (CASE conv_id % 4 WHEN 0 THEN {GAPS_MS[0]} WHEN 1 THEN {GAPS_MS[1]}
    WHEN 2 THEN {GAPS_MS[2]} ELSE {GAPS_MS[3]} END) + CASE WHEN {FUTURE} THEN {AHEAD_MS} ELSE 0 END AS ts_ms,
  CASE role WHEN 'user' THEN 'outbound' ELSE 'inbound' END AS direction,
  CASE WHEN p.phrase IS NULL THEN c.text WHEN conv_id % 2 = 0 THEN p.phrase ELSE c.text || '. ' || p.phrase END AS text,
  p.truth_type, coalesce(p.truth_assessment, 'safe') AS truth_assessment
FROM conversations c LEFT JOIN q_phrases p ON p.k = (conv_id * 7 + turn) % {CYCLE}
WHERE role IN ('user', 'assistant')""",
)

from palisade.sources.planted import DOCUMENTS_SQL, WATCHLIST_SQL  # noqa: E402

cte("q_watchlist", WATCHLIST_SQL.format(customer="customer"))
cte("q_documents", DOCUMENTS_SQL.format(documents="documents", items="q_watchlist"))
