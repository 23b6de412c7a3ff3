"""Roll-ups of scores against plain counting, with nulls, empty axes and merged histograms."""

import random
from collections import defaultdict

from sparkgauge.plans.rollup import roll_up, score_histogram

SHAPE = "source string, lang string, overall_score int, axis_scores array<struct<axis:string,score:int,check_count:int>>"


def plainly(rows, level):
    groups = defaultdict(list)
    for source, lang, overall, axes in rows:
        key = (source if "source" in level else None, lang if "lang" in level else None)
        groups[",".join(level), *key, "overall"].append(overall)
        for axis, score, n in axes:
            if n:
                groups[",".join(level), *key, axis].append(score)
    out = {}
    for key, scores in groups.items():
        scores.sort()
        pick = lambda q, s=scores: s[max(0, -(-len(s) * q // 100) - 1)]
        out[key] = (len(scores), sum(scores) / len(scores), pick(10), pick(50), pick(90))
    return out


def test_roll_up(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.randint(0, 100), [("cost", rng.randint(0, 100), rng.randint(0, 2)), ("clarity", 100, 1)]) for _ in range(300)]
    levels = [["source", "lang"], ["source"], ["lang"], []]
    df = spark.createDataFrame(rows, SHAPE)
    whole = score_histogram(df, ["source", "lang"])
    parts = [score_histogram(spark.createDataFrame(rows[i::3], SHAPE), ["source", "lang"]) for i in range(3)]
    wanted = {k: v for level in levels for k, v in plainly(rows, level).items()}
    for histograms in (whole, parts[0].union(parts[1]).union(parts[2])):
        found = roll_up(histograms, ["source", "lang"], levels).collect()
        got = {(r["level"], r["source"], r["lang"], r["axis"]): (r["documents"], r["mean"], r["p10"], r["p50"], r["p90"]) for r in found}
        assert got == wanted and len(found) == len(wanted)
    assert roll_up(score_histogram(df.filter("false"), ["source", "lang"]), ["source", "lang"], levels).count() == 0
