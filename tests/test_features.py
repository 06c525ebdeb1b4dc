import numpy as np

from palisade.operators import dataset as T


def _fnv(name, dims):
    h = 2166136261
    for ch in name:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h % dims


def test_features_are_hashed_and_summed_inside_the_row(spark):
    """one row per conversation holds its cells; names are not shuffled."""
    texts = {1: ["Pay now", None, "a Код 🙂 it's"], 2: [], 3: ["..."], 4: ["ﬁx"], None: ["lost"]}
    kept = spark.createDataFrame([*texts.items()], "id long, kept array<string>")
    named = spark.createDataFrame([(1, "object:identity", 5.0), (1, "object:identity", 5.0), (3, "request:x:y", 6.0)], "id long, name string, w double")
    tokens = {1: [["pay", "now"], None, ["a", "код", "its"]], 3: [[]], 4: [["fix"]]}
    want = {}
    for i, lists in tokens.items():
        sums = {}
        add = lambda name, w: sums.__setitem__(_fnv(name, 64), sums.get(_fnv(name, 64), 0.0) + w)
        for p, ts in enumerate(lists):
            cur = p == len(lists) - 1
            w = 1.0 if cur else 0.35
            for j, t in enumerate(ts or []):
                add(f"word:{t}", w)
                if j:
                    add(f"pair:{ts[j - 1]} {t}", w * 0.7)
                if cur:
                    add(f"latest:{t}", 0.5)
                for k in (3, 4):
                    for at in range(len(t) + 3 - k):
                        add(f"char:{f'^{t}$'[at:at + k]}", w * 0.2)
        for x in named.collect():
            if x.id == i:
                add(x.name, x.w)
        v = {k: np.log1p(x) for k, x in sums.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        want |= {(i, k): round(x / norm, 9) for k, x in v.items()}
    hashed = T.hashed_features(kept, named, 64)
    assert {(r.id, r.idx): round(r.value, 9) for r in hashed.collect()} == want
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join")  # cells leave the row only after the join, and nothing groups them
