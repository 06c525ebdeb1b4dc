from palisade.oracle.sql import cte
from palisade.sources import scored as S

_fill = dict(text="VARCHAR", ms="(epoch_us(ts) // 1000)", ts="1704067200000 + conv_id * 60000 + turn * 20000", labels="labels",
             events="events", conversations="conversations")
cte("q_predictions", S.PREDICTIONS.format(**_fill))
cte("q_runs", S.MODEL_RUNS.format(**_fill))
cte("q_votes", S.VOTES.format(**_fill))
cte("q_checks", S.CHECK_EVENTS.format(**_fill))
cte("q_lures", S.LURES.format(**_fill))
cte("q_external", S.EXTERNAL.format(**_fill))
