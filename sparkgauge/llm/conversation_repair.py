"""Conversation structure repair: the cheapest edits that make a conversation's roles fit ``(s?(ua)+)?``.

A conversation is optional system, then user and assistant by turns; its grammar has four states. Layers of cost are kept
as bitsets in the manner of Wu and Manber's search with errors: the layer of cost c at turn i has a bit for each state from
which the turns from i on can be brought to an end at a cost of c or less. Layers are worked out from the last turn to the first, each
from the layers of the turn after it by shifts of the bits; the first layer of turn 0 with the bit of the starting state
gives the cost. Read forwards, the same bits tell which edit may come next, and taking the least letter each time gives
the least audit.

Costs of the states of a turn are never more than 7 apart (a few inserts lead from one state to any other), so a turn needs
eight layers of four bits above the lowest cost: one 32-bit word, however long the conversation and dear its repair. There
are few different words, so what a kind of turn makes of a word is worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkgauge.llm.common import table

#: What edits cost; a truncated turn that isn't deleted costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States by bit: nothing yet, after the system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ACCEPTING = EMPTY | ASSISTANT
#: Layers that a turn's word holds, four bits each.
LAYERS = 8
#: A letter for each kind of turn: roles by initial (o for others), in capitals if truncated; x must be deleted.
KINDS = "suaoSUAOx"
_NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that may be inserted, or put in place of another, in a state.
_FITTING = {EMPTY: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
_ROLE = {"u": "user", "a": "assistant"}
#: White space and what else a text may consist of and be blank.
INK, END = r"[^\x20\x09-\x0D]", r"[.!?]"


def _before(letter: str, states: int) -> int:
    """The states from which a turn with that initial leads into ``states``."""
    return sum(q for (q, role), to in _NEXT.items() if role == letter and to & states)


def _closed(raw: list[int]) -> list[int]:
    """Layers of a turn with inserts before it, each as cheap as its layer says, and all that is cheaper."""
    out: list[int] = []
    for cost, states in enumerate(raw):
        if out:
            states |= out[-1]
        if cost >= INSERT:
            states |= _before("u", out[cost - INSERT]) | _before("a", out[cost - INSERT])
        out.append(states)
    return out


def _packed(layers: list[int]) -> tuple[int, int]:
    """(word, base): the LAYERS layers from the first that isn't empty, as one number, and that layer's cost."""
    base = next(i for i, states in enumerate(layers) if states)
    kept = (layers + [layers[-1]] * LAYERS)[base : base + LAYERS]
    return sum(states << (4 * i) for i, states in enumerate(kept)), base


def _layer(word: int, cost: int) -> int:
    return 0 if cost < 0 else word >> (4 * min(cost, LAYERS - 1)) & 15


_STEPS: dict[tuple[int, str], tuple[int, int]] = {}
_LAST = _packed(_closed([ACCEPTING] + [0] * LAYERS))[0]


def _step(word: int, kind: str) -> tuple[int, int]:
    """(word, rise): the layers of a turn of that kind, from those of the turn after it, and how much dearer its lowest is."""
    if (word, kind) not in _STEPS:
        raw, more, letter = [], TRUNCATED * kind.isupper(), kind.lower()
        for cost in range(LAYERS + DELETE):
            states = _layer(word, cost - DELETE)
            if letter != "x":
                states |= _before(letter, _layer(word, cost - KEEP - more))
                states |= _before("u", _layer(word, cost - REROLE - more)) | _before("a", _layer(word, cost - REROLE - more))
            raw.append(states)
        _STEPS[word, kind] = _packed(_closed(raw))
    return _STEPS[word, kind]


def cheapest_repair(kinds: str) -> tuple[int, str, list[tuple[int, str | None]]]:
    """(cost, audit, turns) for the letters of a conversation's turns.

    ``audit`` has a letter per edit in order, Delete, Insert, Keep or Rerole; of equally cheap ones it is the first in ASCII.
    ``turns`` are those of the repaired conversation: the place of a turn kept (-1: inserted) and its role if that is new.
    """
    words, bases = [_LAST], [0]
    for kind in reversed(kinds):
        word, rise = _step(words[-1], kind)
        words.append(word)
        bases.append(bases[-1] + rise)
    words.reverse()
    bases.reverse()

    def ends(at: int, state: int | None, left: int) -> bool:
        return state is not None and bool(_layer(words[at], left - bases[at]) & state)

    cost = next(c for c in range(bases[0], bases[0] + LAYERS) if ends(0, EMPTY, c))
    at, state, left, audit, turns = 0, EMPTY, cost, [], []
    while at < len(kinds) or not state & ACCEPTING:
        fitting = _FITTING[state]
        if at < len(kinds) and ends(at + 1, state, left - DELETE):
            audit.append("D")
            at, left = at + 1, left - DELETE
            continue
        if ends(at, _NEXT[state, fitting], left - INSERT):
            audit.append("I")
            turns.append((-1, _ROLE[fitting]))
            state, left = _NEXT[state, fitting], left - INSERT
            continue
        letter, more = kinds[at].lower(), TRUNCATED * kinds[at].isupper()
        if letter != "x" and ends(at + 1, _NEXT.get((state, letter)), left - KEEP - more):
            audit.append("K")
            turns.append((at, None))
            state, left = _NEXT[state, letter], left - KEEP - more
        else:
            audit.append("R")
            turns.append((at, _ROLE[fitting]))
            state, left = _NEXT[state, fitting], left - REROLE - more
        at += 1
    return cost, "".join(audit), turns


def _plans(kinds: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in kinds:
        found = [cheapest_repair(k) for k in batch]
        rows = [(c, a, [{"at": at, "role": role} for at, role in turns]) for c, a, turns in found]
        yield pd.DataFrame(rows, columns=["cost", "audit", "turns"])


_PLAN = "struct<cost:bigint,audit:string,turns:array<struct<at:int,role:string>>>"


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None,
) -> DataFrame:
    """A row per conversation: ``conv``, ``n_turns``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit`` and ``repaired``, an array of (role, text).

    Turns are ordered by turn (nulls first), then role and text. A null role or text is one space, so a null text is blank. A turn is
    blank without any character but white space, else a duplicate if its role and text occurred earlier in its conversation,
    else truncated if its last such character doesn't end a sentence. Blank turns and duplicates are deleted. ``illegal``
    counts neighbours whose initials aren't su, ua or au; a role with another initial, or none, is never kept. ``gaps`` are
    numbers missing between the least and greatest turn; null if they are over 2^63. Rows with a null conversation
    form one. Rows for which ``present`` doesn't hold only name their conversation, which may be left without a turn: zeros
    and empty results. An empty table gives an empty one; further columns aren't looked at.

    Rows are shuffled once, by conversation. A conversation is one row of the result, so its turns meet in one task; only a letter of
    each goes to Python, and its plan comes back.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("there"),
    ).repartition("conv")  # which both the window and the groups are happy with
    same = W.partitionBy("conv", "there", "role", F.sha2(F.encode("text", "UTF-8"), 256)).orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(~F.col("text").rlike(INK), "b").when(F.col("again"), "d").when(~F.col("text").rlike(rf"(?s){END}[\x20\x09-\x0D]*\z"), "t").otherwise("")
    # a first occurrence before its repetitions, which sort alike
    one = F.struct("turn", "role", "text", "again", fault.alias("fault"), _initial(F.col("role")).alias("initial"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("there"), one))).alias("turns"))

    def count(wanted: str) -> Column:
        return F.size(F.filter("turns", lambda t: t["fault"] == wanted)).cast("long")

    letter = lambda t: F.when(t["fault"].isin("b", "d"), "x").when(t["fault"] == "t", F.upper(t["initial"])).otherwise(t["initial"])
    pair = lambda i: F.concat(F.get("turns", i)["initial"], F.get("turns", i + 1)["initial"])
    places = F.when(F.size("turns") > 1, F.sequence(F.lit(0), F.size("turns") - 2)).otherwise(F.array().cast("array<int>"))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"].cast("decimal(20,0)")), lambda n: n.isNotNull())
    span = F.array_max("numbers") - F.array_min("numbers") + 1 - F.size(F.array_distinct("numbers"))
    told = grouped.select(
        "conv", "turns", F.size("turns").cast("long").alias("n_turns"), numbers.alias("numbers"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
        F.size(F.filter(places, lambda i: ~pair(i).isin("su", "ua", "au"))).cast("long").alias("illegal"), F.array_join(F.transform("turns", letter), "").alias("kinds"),
    ).withColumn("plan", F.pandas_udf(_plans, _PLAN)("kinds"))
    fixed = lambda p: F.struct(F.coalesce(p["role"], F.get("turns", p["at"])["role"]).alias("role"), F.when(p["at"] >= 0, F.get("turns", p["at"])["text"]).otherwise("").alias("text"))
    return told.select(
        "conv", "n_turns", F.when(F.size("numbers") == 0, F.lit(0).cast("long")).otherwise(span.try_cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        "plan.cost", "plan.audit", F.transform("plan.turns", fixed).alias("repaired"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` as the query has them: by a hash of conversation and turn some rows are dropped (``there`` is false),
    emptied, cut short, repeated or given to the user."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", END, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") != 0).alias("there"), copies.alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_conversations(damaged(table(spark, sf_dir, "conversations")), present=F.col("there"))
    told = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.encode(told, "UTF-8"), 256).alias("repaired_sha256"),
    )


# The cheapest way into each state (e, s, u, a), turn by turn: cost, audit and text so far, of which the least is kept. Inserts
# come before a turn and at the end: two at most lead anywhere.
_MIN = "list_min(list_filter([{}], lambda x: x IS NOT NULL))"


def _sql_more(state: str, cost: str, letter: str, line: str) -> str:
    return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _sql_inserts(source: str) -> str:
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    into_u = ", ".join(["u", *(_sql_more(q, "2", "I", user) for q in "esa")])
    first = f"SELECT conv_id, n, e, s, {_MIN.format(into_u)} AS u, a, a AS a0 FROM {source}"
    second = f"SELECT conv_id, n, e, s, u, {_MIN.format('a, ' + _sql_more('u', '2', 'I', assistant))} AS a FROM ({first})"
    return f"SELECT conv_id, n, e, s, {_MIN.format('u, ' + _sql_more('a', '2', 'I', user))} AS u, a FROM ({second})"


def _sql_turns() -> str:
    """From (e, s, u, a) with inserts done and a turn (r, t, i, must, short) to the next."""
    line = "r || ':' || t || chr(10)"
    keep = lambda q, i: f"CASE WHEN NOT must AND i = '{i}' THEN {_sql_more(q, 'short', 'K', line)} END"
    role = lambda q, name: f"CASE WHEN NOT must THEN {_sql_more(q, '2 + short', 'R', repr(name + ':') + ' || t || chr(10)')} END"
    gone = lambda q: _sql_more(q, "3", "D", "''")
    return (
        f"{gone('e')} AS e, {_MIN.format(', '.join([gone('s'), keep('e', 's')]))} AS s, "
        f"{_MIN.format(', '.join([gone('u'), *(keep(q, 'u') for q in 'esa'), *(role(q, 'user') for q in 'esa')]))} AS u, "
        f"{_MIN.format(', '.join([gone('a'), keep('u', 'a'), role('u', 'assistant')]))} AS a"
    )


_SQL_BLANK = "[\\x20\\x09-\\x0D]"
OP11_SQL = rf"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (
  SELECT k, 0 AS j, CAST(4294967295 AS UBIGINT) AS c FROM (SELECT DISTINCT k FROM z) UNION ALL
  SELECT k, j + 1, xor(c >> 8, list_reduce(list_prepend(xor(c, CAST(ascii(k[j + 1]) AS UBIGINT)) & 255, [CAST(0 AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE 0 END)))
  FROM crc WHERE j < length(k)
),
h AS (SELECT z.*, xor(c, CAST(4294967295 AS UBIGINT)) % 20 AS h FROM z JOIN crc USING (k) WHERE j = length(k)),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS r, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS t,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE h <> 0
),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t, copy) AS n, regexp_replace(t, '^{_SQL_BLANK}+|{_SQL_BLANK}+$', '', 'g') AS bare, left(r, 1) AS i FROM d),
g AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, r, t ORDER BY n) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au'), false) AS odd FROM f),
counts AS (
  SELECT conv_id, count(*) AS turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (odd) AS illegal FROM g GROUP BY conv_id
),
way AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS e, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS a
  FROM (SELECT DISTINCT conv_id FROM z) UNION ALL
  SELECT w.conv_id, w.n + 1, {_sql_turns()}
  FROM ({_sql_inserts('way')}) w JOIN (SELECT conv_id AS cid, n AS at, r, t, i, fault IN ('b', 'd') AS must, CAST(fault = 't' AS BIGINT) AS short FROM g) k ON k.cid IS NOT DISTINCT FROM w.conv_id AND k.at = w.n + 1
),
last AS (SELECT conv_id, {_MIN.format('e, a')} AS best FROM ({_sql_inserts('(SELECT w.* FROM way w LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.n = coalesce(k.turns, 0))')}))
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM last l LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM l.conv_id
"""
