"""Oracle SQL for kills, ranks, studies, the bestiary, files and text lines, from the base tables."""

from __future__ import annotations

from questlog.functions.catalogs import FORMULA_NAMES, RANK_COSTS, STAT_COEFFICIENTS
from questlog.plans.adapters import RARITIES, TRAINERS, TRAINER_NAMES
from questlog.plans.oracle_log import COUNTERS, DATES, GATED_X, IS_KILL, BOWS, LOG, REFLECT_X, STUDIED_X, counter_sql, text_list

_VERBS = ["killed", "slaughtered", "vanquished", "dispatched"]
_COLS = [f"{v}_count" for v in _VERBS] + ["assisted_kill_count", "assisted_slaughter_count", "assisted_vanquish_count", "assisted_dispatch_count"]
SOLO = "(" + " + ".join(_COLS[:4]) + ")"
HELP = "(" + " + ".join(_COLS[4:]) + ")"
TOTAL = f"({SOLO} + {HELP})"
VT = dict(zip(_VERBS, (f"({a} + {b})" for a, b in zip(_COLS[:4], _COLS[4:]))))
_T = text_list(TRAINER_NAMES)
_NT = len(TRAINER_NAMES)

RARITY = """CASE WHEN t LIKE '%common%' THEN 'Common' WHEN t LIKE '%medium%' THEN 'Medium' WHEN t LIKE '%rare%' THEN 'Rare'
  WHEN t LIKE '%unique%' OR t LIKE '%boss%' THEN 'Unique' WHEN t LIKE '%exotic%' THEN 'Exotic' WHEN t LIKE '%gm only%' THEN 'GM Only'
  WHEN t LIKE '%extinct%' THEN 'Unique' ELSE 'Unknown' END"""


def rarity(expr: str) -> str:
    return RARITY.replace("t LIKE", f"replace(lower({expr}), 'uncommon', '') LIKE")


def initcap(c: str) -> str:
    return f"upper({c}[1]) || lower({c}[2:])"


KILLS = f"""
WITH kev AS (
  SELECT 'Hero' || (o_custkey // 30) AS character, p_type || ' ' || p_brand AS creature,
    CASE WHEN l_linenumber = 6 THEN 'Fallen' WHEN l_linestatus = 'O' THEN 'AssistedKill' ELSE 'SoloKill' END AS kind,
    CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN 'dispatched' WHEN l_returnflag = 'A' THEN 'killed'
         WHEN l_returnflag = 'N' THEN 'slaughtered' ELSE 'vanquished' END AS verb,
    strftime(l_shipdate, '%Y-%m-%d') || ' ' || printf('%02d:00:00', l_orderkey % 24) AS date, l_orderkey * 8 + l_linenumber AS seq,
    (l_orderkey * 8 + l_linenumber) * 10000 + date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS line, l_linenumber AS nth, l_returnflag AS flag,
    CAST(floor(l_quantity) AS BIGINT) - 5 AS share
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
), lo AS (
  SELECT l.character, l.creature, l.share AS best_loot_value, l.creature || CASE l.flag WHEN 'A' THEN ' fur' WHEN 'N' THEN ' blood' ELSE ' mandibles' END AS best_loot_item
  FROM (SELECT *, line + CASE WHEN nth = 3 THEN -1 ELSE 5000 END AS at FROM kev WHERE nth <= 3 AND share > 0) l
  JOIN (SELECT character, creature, min(line) AS since FROM kev GROUP BY ALL) f USING (character, creature) WHERE l.at > f.since
  QUALIFY row_number() OVER (PARTITION BY l.character, l.creature ORDER BY l.share DESC, l.at, best_loot_item) = 1
), kb AS (
  SELECT CASE WHEN brand % 11 = 5 THEN 'Unseen ' ELSE '' END || p_type || ' ' || p_brand AS name,
    CASE WHEN brand % 10 = 0 THEN upper(p_type) WHEN brand % 7 = 0 THEN 'Ethereal' ELSE {initcap('p_type')} END AS family,
    ({text_list(RARITIES)})[(s + brand) % {len(RARITIES)} + 1] AS rarity, s * 20 AS value, brand % 6 = 0 AS is_seasonal
  FROM (SELECT p_type, p_brand, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS brand, max(p_size)::BIGINT AS s FROM part GROUP BY ALL)
), fam AS (
  SELECT lower(family) AS low, first(family ORDER BY n DESC, family) AS family_canonical
  FROM (SELECT family, count(*) AS n FROM kb GROUP BY family) GROUP BY 1
), kbl AS (
  SELECT kb.*, fam.family_canonical, {rarity('kb.rarity')} AS rarity_canonical FROM kb JOIN fam ON fam.low = lower(kb.family)
), k AS (
  SELECT a.*, CAST(coalesce(kb.value, 0) AS BIGINT) AS creature_value, coalesce(lo.best_loot_value, 0) AS best_loot_value, coalesce(lo.best_loot_item, '') AS best_loot_item
  FROM (SELECT character, creature, {COUNTERS}, CAST(count(*) FILTER (kind = 'Fallen') AS BIGINT) AS killed_by_count,
          first(date ORDER BY seq, date) FILTER ({IS_KILL}) AS date_first, max(date) FILTER ({IS_KILL}) AS date_last, {DATES}
        FROM kev GROUP BY ALL) a LEFT JOIN kb ON kb.name = a.creature LEFT JOIN lo ON lo.character = a.character AND lo.creature = a.creature
), people AS (
  SELECT 'Hero' || n AS character, CASE WHEN n % 10 = 1 THEN 'Hero' || (n - 1) WHEN n % 10 = 3 THEN 'Hero' || (n - 2) END AS merged_into,
    CAST(sum(c_nationkey % 3) AS BIGINT) AS logins, CAST(sum(c_nationkey) AS BIGINT) AS deaths, CAST(count(*) AS BIGINT) AS departs,
    CAST(sum(floor(c_acctbal)) AS BIGINT) AS coins_picked_up, max(c_name) AS start_date, ['Unknown', 'Ranger', 'Fighter', 'Healer'][n % 4 + 1] AS profession, n
  FROM (SELECT *, c_custkey // 30 AS n FROM customer) GROUP BY n
), mm AS (
  SELECT character AS name, coalesce(merged_into, character) AS target FROM people p
  WHERE merged_into IS NULL OR NOT EXISTS (SELECT 1 FROM people q WHERE q.character = p.merged_into AND q.merged_into IS NOT NULL)
)
"""
KILL_COLUMNS = ", ".join(["character", "creature", *_COLS, "killed_by_count", "date_first", "date_last",
                          *[f"date_{e}_{v}" for v in _VERBS for e in ("first", "last")], "creature_value"])


def freq(assisted: bool = True, merged: bool = False) -> str:
    """Definition by self-join: an hour with every hour less than two hours before it."""
    verbs = [f"{a} + {b}" if assisted else a for a, b in zip(_COLS[:4], _COLS[4:])]
    sums = ", ".join(f"sum({e}) AS {v}" for e, v in zip(verbs, _VERBS))
    text = lambda p: "concat_ws(' ', " + ", ".join(
        f"CASE WHEN {p}{v} > 0 THEN '{v}:' || {p}{v} END" for v in sorted(_VERBS)) + ")"
    source = "(SELECT h.* REPLACE (mm.target AS character) FROM hourly h JOIN mm ON mm.name = h.character)" if merged else "hourly"
    return KILLS + f"""
, hourly AS (SELECT character, creature, date[1:13] AS hour, {COUNTERS} FROM kev WHERE {IS_KILL} GROUP BY ALL)
, hrs AS (SELECT *, killed + slaughtered + vanquished + dispatched AS n, strptime(hour || ':00', '%Y-%m-%d %H:%M') AS at
          FROM (SELECT character, creature, hour, {sums} FROM {source} GROUP BY ALL))
, days AS (SELECT character, creature, hour[1:10] AS day, sum(n) AS n, {', '.join(f'sum({v}) AS {v}' for v in _VERBS)} FROM hrs GROUP BY ALL)
, bd AS (SELECT *, {text('')} AS verbs FROM days QUALIFY row_number() OVER (PARTITION BY character, creature ORDER BY n DESC, day) = 1)
, spans AS (SELECT r.character, r.creature, r.hour, min(l.hour) AS start, sum(l.n) AS n, {', '.join(f'sum(l.{v}) AS {v}' for v in _VERBS)}
            FROM hrs r JOIN hrs l ON l.character = r.character AND l.creature = r.creature AND l.at <= r.at AND l.at > r.at - INTERVAL 2 HOUR GROUP BY ALL)
, bs AS (SELECT *, {text('')} AS verbs FROM spans QUALIFY row_number() OVER (PARTITION BY character, creature ORDER BY n DESC, hour) = 1)
, f AS (SELECT bd.character, bd.creature, CAST(bd.n AS BIGINT) AS best_day_count, bd.day AS best_day_date, bd.verbs AS best_day_verbs,
          CAST(bs.n AS BIGINT) AS best_2h_count, bs.start || ':00' AS best_2h_start, bs.verbs AS best_2h_verbs
        FROM bd JOIN bs USING (character, creature) WHERE bd.n > 0)
"""


def argmax(metric: str, where: str = "true", source: str = "k", extra: str = "creature") -> str:
    return f"(SELECT character, {extra} AS name, {metric} AS n FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY character ORDER BY {metric} DESC, creature) = 1)"


STUFF = "(SELECT k.*, coalesce(kb.family, '') NOT IN ('', 'Ethereal') AS stuffable FROM k LEFT JOIN kb ON kb.name = k.creature)"
COIN = f"""(SELECT character, coalesce(max(creature_value) FILTER ({VT['killed']} >= 5 AND creature_value >= 50), 0) AS coin_level,
  coalesce(max(creature_value) FILTER ({VT['killed']} >= 1 AND creature_value > 0), 0) AS interim FROM k GROUP BY character)"""


def _extremes() -> str:
    facts = {
        "highest": ("creature_value", f"{TOTAL} > 0 AND creature_value > 0"),
        "highest_killed": ("creature_value", f"{VT['killed']} > 0 AND stuffable AND creature_value > 0"),
        **{f"highest_{v}": ("creature_value", f"{VT[v]} > 0 AND creature_value > 0") for v in _VERBS[1:]},
        "highest_solo": ("creature_value", f"{SOLO} > 0 AND creature_value > 0"), "most_killed": (TOTAL, f"{TOTAL} > 0"),
        "most_solo": (SOLO, f"{SOLO} > 0"), "best_loot": ("best_loot_value", "best_loot_value > 0"),
    }
    cols = ", ".join(f"{n}.name AS {n}, {n}.n AS {n}_n" for n in facts)
    joins = " ".join(f"LEFT JOIN {argmax(m, w, 's')} {n} ON {n}.character = c.character" for n, (m, w) in facts.items())
    return KILLS + f", s AS {STUFF} SELECT c.character, {cols} FROM (SELECT DISTINCT character FROM k) c {joins}"


SPINE = lambda src, col, keys="character": f"""(SELECT {keys}, strftime(unnest(generate_series(date_trunc('month', CAST(min({col})[1:10] AS DATE)),
  date_trunc('month', CAST(max({col})[1:10] AS DATE)), INTERVAL 1 MONTH)), '%Y-%m-%d') AS date FROM {src} WHERE {col} IS NOT NULL GROUP BY {keys})"""  # noqa: E731

_META = ", ".join(f"('{n}', {'NULL' if p is None else repr(p)}, {m}::DOUBLE, {text_list(c)}::VARCHAR[])" for n, p, m, c in TRAINERS)
_COEFF = ", ".join(f"('{s}', '{t}', {c})" for s, cs in STAT_COEFFICIENTS.items() for t, c in cs.items())
_COST = ", ".join(f"('{t}', {c})" for t, c in RANK_COSTS.items())
_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FORMULA_NAMES.items())

TRAINER_X = f"""
, meta(trainer, profession, multiplier, parts) AS (VALUES {_META})
, coeff(stat, trainer, c) AS (VALUES {_COEFF}), cost(trainer, c) AS (VALUES {_COST})
, ov AS (
  SELECT character, 'Atkus' AS trainer, 'override' AS rank_mode, NULL AS override_date, n + 1 AS modified_ranks FROM people WHERE n % 7 = 0
  UNION ALL SELECT character, 'Regia', 'override_until_date', '1/1/99', 3 FROM people WHERE n % 5 = 0
  UNION ALL SELECT character, 'Zeno', 'modifier', NULL, 2 FROM people WHERE n % 3 = 0
), ro AS (
  SELECT 'Hero' || (o_custkey // 30) AS character, ({_T})[o_orderkey % {_NT} + 1] AS trainer, o_orderstatus = 'O' AS learning,
    o_orderpriority = '1-URGENT' AS urgent, strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00' AS date, o_orderkey AS seq FROM orders
), counted AS (
  SELECT ro.* FROM ro LEFT JOIN ov USING (character, trainer)
  WHERE coalesce(rank_mode, '') <> 'override' AND NOT (coalesce(rank_mode, '') = 'override_until_date' AND date[1:10] <= '1999-01-01')
), tr0 AS (
  SELECT character, trainer, count(*) FILTER (NOT learning) AS ranks, 10 * count(*) FILTER (learning AND urgent) AS apply_learning_ranks,
    count(*) FILTER (learning AND NOT urgent) AS apply_learning_unknown_count, last(date ORDER BY seq) AS date_of_last_rank FROM counted GROUP BY ALL
), tr AS (
  SELECT character, trainer, coalesce(ranks, 0) AS ranks, coalesce(apply_learning_ranks, 0) AS apply_learning_ranks,
    coalesce(apply_learning_unknown_count, 0) AS apply_learning_unknown_count, coalesce(modified_ranks, 0)::BIGINT AS modified_ranks, date_of_last_rank,
    coalesce(rank_mode, 'modifier') AS rank_mode, override_date,
    CASE WHEN tr0.ranks IS NULL THEN 1.0 ELSE coalesce(meta.multiplier, 1.0) END::DOUBLE AS effective_multiplier, notes
  FROM tr0 FULL JOIN ov USING (character, trainer)
  FULL JOIN (SELECT character, 'Evus' AS trainer, 'note ' || character AS notes FROM people WHERE n % 4 = 0) USING (character, trainer)
  LEFT JOIN meta USING (trainer)
), tre AS (
  SELECT tr.*, CASE rank_mode WHEN 'override' THEN modified_ranks ELSE ranks + modified_ranks + apply_learning_ranks END AS effective,
    CASE trainer {_ALIAS} ELSE trainer END AS formula FROM tr
)
"""
TRAINED = KILLS + TRAINER_X
RACE_SP = 300 + 100 + 200 + 5000 // 3 + 400 + 3000 // 3 + 300 + 100 + 800 + 600


def _stat(s: str) -> str:
    return f"coalesce((SELECT sum((t.ranks + t.modified_ranks) * c.c) FROM tre t JOIN coeff c ON c.trainer = t.formula AND c.stat = '{s}' WHERE t.character = p.character), 0)"


FIGHTER = TRAINED + f""", st AS (
  SELECT character, {', '.join(_stat(s) + ' AS ' + s for s in STAT_COEFFICIENTS)},
    (SELECT sum(ranks + modified_ranks) FROM tre t WHERE t.character = p.character) AS trained,
    (SELECT sum((t.ranks + t.modified_ranks) * CAST(coalesce(m.multiplier, 1.0) AS DECIMAL(12,6))) FROM tre t LEFT JOIN meta m USING (trainer) WHERE t.character = p.character) AS eff,
    (SELECT sum((t.ranks + t.modified_ranks) * coalesce(c.c, 20)) FROM tre t LEFT JOIN cost c ON c.trainer = t.formula WHERE t.character = p.character) AS cst
  FROM (SELECT DISTINCT character FROM tre) p
), st2 AS (SELECT *, accuracy + 300 + (3 * (damage_max + 200) + damage_min + 100) // 4 AS offense FROM st)
SELECT character, CAST(trained AS BIGINT) AS trained_ranks, CAST(round(eff, 1) AS DOUBLE) AS effective_ranks, CAST(cst + {RACE_SP} AS BIGINT) AS slaughter_points,
  CAST(accuracy + 300 AS BIGINT) AS accuracy, CAST(greatest(damage_min + 100, 0) + 100 AS BIGINT) AS damage_min,
  CAST(greatest((damage_max + 200) * 3, 0) + 100 AS BIGINT) AS damage_max, CAST(offense AS BIGINT) AS offense, CAST(balance + 5000 AS BIGINT) AS balance,
  CAST(balance_regen + 400 AS BIGINT) AS balance_regen, (balance_regen + 400) / 6.0::DOUBLE AS balance_per_frame, CAST(health + 3000 AS BIGINT) AS health,
  CAST(health_regen + 100 AS BIGINT) AS health_regen, (health_regen + 100) / 100.0::DOUBLE AS health_per_frame, CAST(defense + 300 AS BIGINT) AS defense,
  CAST(spirit + 800 AS BIGINT) AS spirit, CAST(600 AS BIGINT) AS spirit_regen, 6.0::DOUBLE AS spirit_per_frame, CAST(heal_receptivity AS BIGINT) AS heal_receptivity,
  CAST((5 * greatest(offense, 200)) // 3 AS BIGINT) AS balance_per_swing,
  CAST(CASE WHEN heen < 50 THEN round((1066 * 49 - 436 * heen) / 49.0::DOUBLE) ELSE round(628 * 50 / heen::DOUBLE) END AS BIGINT) AS shieldstone_drain
FROM st2"""

DETECT = TRAINED + """, pr AS (
  SELECT character, m.profession, sum(ranks + modified_ranks) AS n, max(date_of_last_rank) AS last
  FROM tre JOIN meta m USING (trainer) WHERE trainer NOT IN ('Gossamer Decay', 'Bloodblade Decay', 'Champion Blade Decay') AND ranks + modified_ranks > 0 GROUP BY ALL
), dec AS (
  SELECT character, CASE trainer WHEN 'Gossamer Decay' THEN 'Ranger' WHEN 'Bloodblade Decay' THEN 'Bloodmage' ELSE 'Champion' END AS profession, sum(ranks + modified_ranks) AS d
  FROM tre WHERE trainer IN ('Gossamer Decay', 'Bloodblade Decay', 'Champion Blade Decay') GROUP BY ALL
), cand AS (
  SELECT character, profession, greatest(n - coalesce(d, 0), 0) AS n, coalesce(last, '') AS last, profession IN ('Ranger', 'Bloodmage', 'Champion') AS spec
  FROM pr LEFT JOIN dec USING (character, profession) WHERE profession IN ('Fighter', 'Healer', 'Mystic', 'Ranger', 'Bloodmage', 'Champion')
), det AS (
  SELECT c.character, coalesce(x.profession, 'Unknown') AS detected FROM (SELECT DISTINCT character FROM tre) c LEFT JOIN (
    SELECT character, profession FROM cand WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY character ORDER BY spec DESC, n DESC, CASE WHEN spec THEN last ELSE '' END DESC,
      list_position(['Ranger', 'Bloodmage', 'Champion', 'Fighter', 'Healer', 'Mystic'], profession)) = 1) x USING (character)
)"""

LASTYS = """
WITH RECURSIVE se AS (
  SELECT 'Hero' || (user_id // 5) AS character, event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, p_name || ' ' || p_partkey AS creature,
    CASE event_type WHEN 'click' THEN 'begin' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'abandon'
      ELSE CASE WHEN k < 50 THEN 'complete' ELSE 'study' END END AS op,
    CASE WHEN event_type = 'signup' THEN 'Movements' ELSE ['Movements', 'Befriend', 'Morph'][k % 3 + 1] END AS ty
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) JOIN part ON p_partkey = k % 50
), ctl AS (
  SELECT *, last_value(CASE WHEN op IN ('begin', 'finish', 'abandon') THEN op END IGNORE NULLS) OVER (
    PARTITION BY character, creature ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM se WHERE op <> 'complete'
), ok AS (
  SELECT character, seq, date, creature, op, ty FROM ctl WHERE NOT (op = 'progress' AND coalesce(before, '') = 'abandon')
), steps AS (
  SELECT character, op, creature || '|' || ty AS row_key, row_number() OVER (PARTITION BY character ORDER BY seq) AS i
  FROM (SELECT character, seq, op, creature, ty FROM ok WHERE op <> 'abandon' UNION ALL SELECT character, seq, op, '', '' FROM se WHERE op = 'complete')
), walk AS (
  SELECT character, 0::BIGINT AS i, []::VARCHAR[] AS open, []::VARCHAR[] AS seen, []::VARCHAR[] AS popped FROM (SELECT DISTINCT character FROM steps)
  UNION ALL
  SELECT w.character, s.i,
    CASE WHEN s.op = 'complete' THEN w.open[:len(w.open) - 1] WHEN s.op = 'finish' THEN list_filter(w.open, lambda x: x <> s.row_key)
         WHEN list_contains(w.seen, s.row_key) THEN w.open ELSE list_append(w.open, s.row_key) END,
    CASE WHEN s.op = 'complete' OR list_contains(w.seen, s.row_key) THEN w.seen ELSE list_append(w.seen, s.row_key) END,
    CASE WHEN s.op = 'complete' AND len(w.open) > 0 THEN list_append(w.popped, w.open[len(w.open)]) ELSE w.popped END
  FROM walk w JOIN steps s ON s.character = w.character AND s.i = w.i + 1
), pops AS (
  SELECT character, unnest(popped) AS row_key FROM (SELECT character, popped FROM walk QUALIFY row_number() OVER (PARTITION BY character ORDER BY i DESC) = 1)
), lastctl AS (
  SELECT character, creature, last(op ORDER BY seq) AS op, max(seq) AS seq, last(date ORDER BY seq) AS date FROM ok WHERE op IN ('abandon', 'begin') GROUP BY ALL
), la AS (
  SELECT r.character, r.creature, r.lasty_type, r.message_count, r.first_seen, r.last_seen,
    r.fin OR EXISTS (SELECT 1 FROM pops p WHERE p.character = r.character AND p.row_key = r.creature || '|' || r.lasty_type) AS finished, r.completed,
    CASE WHEN c.op = 'abandon' AND r.since < c.seq THEN c.date END AS abandoned
  FROM (SELECT character, creature, ty AS lasty_type, count(*) AS message_count, first(date ORDER BY seq) AS first_seen, last(date ORDER BY seq) AS last_seen,
          bool_or(op = 'finish') AS fin, last(date ORDER BY seq) FILTER (op = 'finish') AS completed, min(seq) AS since
        FROM ok WHERE op <> 'abandon' GROUP BY character, creature, ty) r LEFT JOIN lastctl c USING (character, creature)
)
"""
BEAST_X = f"""
, be AS (
  SELECT p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN upper(p_type) WHEN p_partkey % 10 = 3 THEN 'Extinct' ELSE {initcap('p_type')} END AS family,
    ({text_list(RARITIES)})[(p_size + p_partkey) % {len(RARITIES)} + 1] AS rarity, p_size::BIGINT AS value, p_partkey % 97 AS attack, (p_partkey % 7)::DOUBLE AS fps, p_partkey
  FROM part
)
"""
COSTS_X = BEAST_X + """
, lf AS (SELECT la.*, be.family FROM la LEFT JOIN be ON be.name = la.creature)
, placed AS (SELECT character, creature, lasty_type, row_number() OVER (PARTITION BY character, family, lasty_type ORDER BY completed NULLS FIRST, first_seen, creature) - 1 AS prior
             FROM lf WHERE finished AND family IS NOT NULL)
, done AS (SELECT character, family, lasty_type, count(*) AS n FROM lf WHERE finished GROUP BY ALL)
, tc AS (SELECT lf.*, greatest(1, CASE lf.lasty_type WHEN 'Befriend' THEN 10 ELSE 5 END - CASE WHEN family IS NULL THEN 0 ELSE coalesce(placed.prior, done.n, 0) END) AS cost
         FROM lf LEFT JOIN placed USING (character, creature, lasty_type) LEFT JOIN done USING (character, family, lasty_type))
, sc AS (SELECT character, creature, CAST(sum(CASE WHEN abandoned IS NULL THEN cost ELSE 0 END) AS BIGINT) AS cost FROM tc GROUP BY ALL)
, ss AS (SELECT *, CASE WHEN abandoned IS NOT NULL THEN 'abandoned' WHEN finished THEN 'completed' ELSE 'in_progress' END AS status FROM la)
"""
TARGETS_X = COSTS_X + """
, elig AS (SELECT * FROM be WHERE family NOT IN ('--', 'Uncategorized', 'EXTINCT', 'Extinct') AND (rarity LIKE 'Common%' OR rarity LIKE 'Medium%') AND value > 0)
, grid AS (SELECT c.character, e.* FROM (SELECT DISTINCT character FROM la) c, elig e)
, one AS (SELECT g.*,
    (SELECT status FROM ss WHERE ss.character = g.character AND ss.creature = g.name AND lasty_type = 'Movements') AS mov,
    (SELECT status FROM ss WHERE ss.character = g.character AND ss.creature = g.name AND lasty_type = 'Befriend') AS bef,
    (SELECT status FROM ss WHERE ss.character = g.character AND ss.creature = g.name AND lasty_type = 'Morph') AS mor,
    greatest(1, 5 - coalesce((SELECT n FROM done WHERE done.character = g.character AND done.family = g.family AND lasty_type = 'Movements'), 0)) AS fm,
    greatest(1, 10 - coalesce((SELECT n FROM done WHERE done.character = g.character AND done.family = g.family AND lasty_type = 'Befriend'), 0)) AS fb,
    greatest(1, 5 - coalesce((SELECT n FROM done WHERE done.character = g.character AND done.family = g.family AND lasty_type = 'Morph'), 0)) AS fo,
    (SELECT cost FROM tc WHERE tc.character = g.character AND tc.creature = g.name AND lasty_type = 'Movements') AS cm,
    (SELECT cost FROM tc WHERE tc.character = g.character AND tc.creature = g.name AND lasty_type = 'Befriend') AS cb,
    (SELECT cost FROM tc WHERE tc.character = g.character AND tc.creature = g.name AND lasty_type = 'Morph') AS co FROM grid g)
, mc AS (SELECT character, name AS creature, family, value, attack, fps,
    CASE WHEN bef = 'completed' THEN 'Befriend' WHEN mov = 'completed' THEN 'Movements' WHEN mov = 'in_progress' THEN 'Studying' ELSE 'None' END AS stage,
    CAST(CASE WHEN bef = 'completed' THEN coalesce(co, fo) WHEN mov = 'completed' THEN coalesce(cb, fb) + coalesce(co, fo)
      WHEN mov = 'in_progress' THEN coalesce(cm, fm) + coalesce(cb, fb) + coalesce(co, fo) ELSE fm + fb + fo END AS BIGINT) AS points_left
  FROM one WHERE coalesce(mor, '') <> 'completed')
"""
FAMILY_X = COSTS_X + """
, fp AS (SELECT g.character, g.family, g.total_creatures, g.representative, coalesce(m, 0) AS movements_completed, coalesce(b, 0) AS befriend_completed,
    coalesce(o, 0) AS morph_completed, m IS NOT NULL AS has_progress, CAST(least(50, 10 * coalesce(m, 0)) AS BIGINT) AS bonus_pct, 10 * coalesce(m, 0) >= 50 AS is_maxed
  FROM (SELECT c.character, f.* FROM (SELECT DISTINCT character FROM la) c, (SELECT family, count(*) AS total_creatures, min(name) AS representative FROM be GROUP BY 1) f) g
  LEFT JOIN (SELECT character, family, count(*) FILTER (status = 'completed' AND lasty_type = 'Movements') AS m, count(*) FILTER (status = 'completed' AND lasty_type = 'Befriend') AS b,
               count(*) FILTER (status = 'completed' AND lasty_type = 'Morph') AS o FROM ss JOIN be ON be.name = ss.creature GROUP BY ALL) d USING (character, family)
  WHERE m IS NOT NULL OR g.family NOT IN ('--', 'Uncategorized', 'EXTINCT', 'Extinct'))
"""


def with_kills(recursive: str) -> str:
    """Both CTE lists: KILLS' after the recursive one."""
    return recursive + KILLS.replace("\nWITH kev AS", ", kev AS", 1)


_NORM = "' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
_SPEECH = "(text ILIKE '* %' OR text ILIKE '%says, \"%' OR text ILIKE '%says in %')"
_CTX = """string_agg(y.text, '|' ORDER BY y.turn)"""

PLAN = """
WITH f AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, encode(text) AS content, octet_length(encode(text)) AS length, doc_id % 5 AS i FROM documents
), known AS (SELECT DISTINCT sha256(content) AS h FROM f WHERE i = 1), fresh AS (
  SELECT *, sha256(content) AS h, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS nth FROM f WHERE i = 0
), plan AS (
  SELECT path, CASE WHEN nth > 1 OR h IN (SELECT h FROM known) THEN 'duplicate' ELSE 'scan' END AS action, 0 AS off, length FROM fresh
  UNION ALL SELECT path, CASE WHEN i IN (1, 4) THEN 'skip' WHEN length // 2 = length OR length // 2 <= 0 THEN 'skip' WHEN i = 2 THEN 'tail' ELSE 'changed' END,
    CASE WHEN i = 2 AND length // 2 > 0 THEN length // 2 ELSE 0 END, length FROM f WHERE i > 0
)
"""

SETS = """
WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS item, unnest(string_split(text, chr(10))) AS line FROM documents),
l AS (SELECT item, line FROM w WHERE line <> ''),
fc AS (SELECT item, count(*) AS files FROM l GROUP BY item), s AS (SELECT DISTINCT item, line FROM l), n AS (SELECT item, count(*) AS n FROM s GROUP BY item),
c AS (SELECT x.item AS p, y.item AS q, count(*) AS common FROM s x JOIN s y USING (line) WHERE x.item < y.item GROUP BY ALL),
j AS (SELECT p, q, common, np.n + nq.n - common AS combined, fp.files AS fpf, fq.files AS fqf FROM c JOIN n np ON np.item = p JOIN n nq ON nq.item = q
      JOIN fc fp ON fp.item = p JOIN fc fq ON fq.item = q WHERE common * 2 >= np.n + nq.n - common)
"""

# each hit of the phrase in marks; twice, as neighbouring hits share the character between them
_MARK = r"'(^|[^\p{L}\p{N}>])(the[^\p{L}\p{N}]+of)($|[^\p{L}\p{N}<])', '\1<mark>\2</mark>\3', 'gi'"
_MARKED = f"regexp_replace(regexp_replace(text, {_MARK}), {_MARK})"

ORACLES = {
    "kill_table": KILLS + f"SELECT {KILL_COLUMNS} FROM k",
    "update_equals_rescan": KILLS + f"SELECT {KILL_COLUMNS} FROM k",
    "kill_values_aliased": KILLS + r""", sz AS (SELECT concat_ws(' ', p_type, p_brand) AS creature, max(p_size) AS s, max(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT)) AS b FROM part GROUP BY p_type, p_brand)
        SELECT k.character, k.creature, CAST(CASE WHEN b % 11 = 5 AND b % 2 = 1 THEN 7 ELSE s * 20 END AS BIGINT) AS creature_value, k.killed_count FROM k JOIN sz USING (creature)""",
    "kill_hourly_volume": KILLS + f"SELECT character, creature, date[1:13] AS hour, {COUNTERS} FROM kev WHERE {IS_KILL} GROUP BY ALL",
    "freq_best_day": freq() + "SELECT character, creature, best_day_count, best_day_date, best_day_verbs FROM f",
    "freq_best_day_solo": freq(False) + "SELECT character, creature, best_day_count, best_day_date, best_day_verbs FROM f",
    "freq_best_2h": freq() + "SELECT character, creature, best_2h_count, best_2h_start, best_2h_verbs FROM f",
    "freq_merged": freq(True, True) + "SELECT * FROM f",
    "kills_with_frequency": freq() + "SELECT k.character, k.creature, k.killed_count, f.best_day_count, f.best_2h_count FROM k LEFT JOIN f USING (character, creature)",
    "frequency_export": freq(False) + "SELECT * FROM f",
    "kills_export": freq() + f"""SELECT k.character, k.creature, CAST({VT['vanquished']} AS VARCHAR) AS vanquished, CAST({VT['killed']} AS VARCHAR) AS killed,
        CAST({VT['dispatched']} AS VARCHAR) AS dispatched, CAST({VT['slaughtered']} AS VARCHAR) AS slaughtered, CAST(killed_by_count AS VARCHAR) AS killed_by,
        CAST(creature_value AS VARCHAR) AS value, coalesce(date_first[1:10], '') AS first_kill, coalesce(date_last[1:10], '') AS last_kill,
        coalesce(CAST(best_day_count AS VARCHAR), '') AS best_day, coalesce(best_day_date, '') AS best_day_date, coalesce(CAST(best_2h_count AS VARCHAR), '') AS best_2h,
        coalesce(best_2h_start || '–' || printf('%02d:00', (CAST(best_2h_start[12:13] AS INT) + 2) % 24), '') AS best_2h_window
        FROM k LEFT JOIN f USING (character, creature)""",
    "kills_sorted": KILLS + "SELECT character, creature, creature_value FROM k QUALIFY row_number() OVER (PARTITION BY character ORDER BY creature_value DESC, creature) <= 10",
    "nemesis": KILLS + f"""SELECT character, name AS creature, n AS killed_by, 'all' AS variant FROM {argmax('killed_by_count', 'killed_by_count > 0')}
        UNION ALL SELECT character, name, n, 'without' FROM {argmax('killed_by_count', "killed_by_count > 0 AND lower(creature) NOT IN ('economy brand#1', 'standard brand#2')")}""",
    "highest_kill": KILLS + f"SELECT character, name AS creature, n AS score FROM {argmax(f'({SOLO} * creature_value)', 'creature_value > 0')}",
    "coin_level": KILLS + f"SELECT character, coin_level, CASE WHEN coin_level = 0 THEN interim ELSE 0 END AS coin_level_interim FROM {COIN}",
    "coin_level_stuffable": KILLS + f""", s AS {STUFF} SELECT c.character, b.name AS creature, b.n AS stuffable_level,
        coalesce(b.n, nullif(c.coin_level, 0), c.interim) AS shown_level
        FROM {COIN} c LEFT JOIN {argmax('creature_value', f"stuffable AND {VT['killed']} >= 5 AND creature_value > 0", 's')} b USING (character)""",
    "kill_extremes": _extremes(),
    "lowest_recent": KILLS + " UNION ALL ".join(f"""SELECT character, '{v}' AS verb, creature, creature_value FROM (
        SELECT *, row_number() OVER (PARTITION BY character ORDER BY date_last_{v} DESC, creature) AS rn FROM k WHERE {VT[v]} > 0 AND date_last_{v} IS NOT NULL AND creature_value >= 2)
        WHERE rn <= 20 QUALIFY row_number() OVER (PARTITION BY character ORDER BY creature_value, rn) = 1""" for v in _VERBS),
    "most_recent_kill": KILLS + " UNION ALL ".join(f"""SELECT character, '{r}' AS role, creature, date_last FROM k WHERE {c} > 0 AND date_last IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY character ORDER BY date_last DESC, creature) = 1""" for r, c in (("solo", SOLO), ("assisted", HELP))),
    "first_by_verb": KILLS + " UNION ALL ".join(f"SELECT character, creature, '{v}' AS verb, date_first_{v}[1:10] AS first_day FROM k WHERE {VT[v]} > 0 AND date_first_{v} IS NOT NULL" for v in _VERBS),
    "kill_totals": KILLS + f"""SELECT character, CAST(sum({SOLO}) AS BIGINT) AS solo, CAST(sum({HELP}) AS BIGINT) AS assisted, CAST(sum(killed_by_count) AS BIGINT) AS killed_by,
        {', '.join(f'CAST(sum({VT[v]}) AS BIGINT) AS {v}' for v in _VERBS)}, count(*) AS creatures FROM k GROUP BY character""",
    "kills_filtered": KILLS + """SELECT k.character, k.creature, k.killed_count FROM k LEFT JOIN kbl ON kbl.name = k.creature
        WHERE lower(coalesce(family_canonical, '')) = 'economy' AND coalesce(rarity_canonical, 'Unknown') = 'Common' AND NOT coalesce(is_seasonal, false)""",
    "kills_multi_filter": KILLS + """SELECT k.character, k.creature, k.killed_count FROM k JOIN kbl ON kbl.name = k.creature
        WHERE family_canonical IN ('Economy', 'Promo', 'Ethereal') AND rarity_canonical IN ('Common', 'Rare', 'Medium')""",
    "kill_facets": KILLS + """SELECT DISTINCT 'family' AS facet, family_canonical AS value, 0 AS rank FROM kbl WHERE name IN (SELECT creature FROM k)
        UNION ALL SELECT DISTINCT 'rarity', rarity_canonical, list_position(['Common', 'Medium', 'Rare', 'Unique', 'Exotic', 'GM Only', 'Unknown'], rarity_canonical) - 1 FROM kbl WHERE name IN (SELECT creature FROM k)""",
    **{f"breakdown_{by}": KILLS + f"""SELECT character, {by}, kills, creatures, round(100.0 * kills / nullif(sum(kills) OVER (PARTITION BY character), 0), 6)::DOUBLE AS share FROM (
        SELECT k.character, coalesce(kbl.{by}_canonical, 'Unknown') AS {by}, CAST(sum({TOTAL}) AS BIGINT) AS kills, count(*) AS creatures
        FROM k LEFT JOIN kbl ON kbl.name = k.creature GROUP BY ALL) WHERE kills > 0""" for by in ("family", "rarity")},
    "encountered": with_kills(LASTYS) + f"SELECT character, creature FROM k WHERE {TOTAL} + killed_by_count > 0 UNION SELECT character, creature FROM la",
    "bestiary_completion": KILLS + f""", seen AS (SELECT DISTINCT character, creature FROM k WHERE {TOTAL} + killed_by_count > 0)
        , who AS (SELECT DISTINCT character FROM seen), fams AS (SELECT family_canonical AS family, count(*) AS total FROM kbl GROUP BY 1 UNION ALL SELECT '*', count(*) FROM kbl)
        , met AS (SELECT character, family_canonical AS family, count(*) AS met FROM seen JOIN kbl ON kbl.name = seen.creature GROUP BY ALL
                  UNION ALL SELECT character, '*', count(*) FROM seen JOIN kbl ON kbl.name = seen.creature GROUP BY ALL)
        SELECT w.character, f.family, f.total, coalesce(met.met, 0) AS met, round(100.0 * coalesce(met.met, 0) / f.total, 1)::DOUBLE AS pct
        FROM who w CROSS JOIN fams f LEFT JOIN met ON met.character = w.character AND met.family = f.family""",
    "kills_merged": KILLS + f"""SELECT target AS character, creature, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in [*_COLS, 'killed_by_count'])}, min(date_first) AS date_first,
        max(date_last) AS date_last, max(creature_value) AS creature_value, {', '.join(f'min(date_first_{v}) AS date_first_{v}, max(date_last_{v}) AS date_last_{v}' for v in _VERBS)},
        max(best_loot_value) AS best_loot_value, first(best_loot_item ORDER BY best_loot_value DESC, best_loot_item) AS best_loot_item
        FROM k JOIN mm ON mm.name = k.character GROUP BY target, creature""",
    "rank_override_apply": TRAINED + "SELECT * FROM tr",
    "trainers_merged": TRAINED + """SELECT target AS character, trainer, CAST(sum(ranks) AS BIGINT) AS ranks, CAST(sum(modified_ranks) AS BIGINT) AS modified_ranks,
        CAST(sum(apply_learning_ranks) AS BIGINT) AS apply_learning_ranks, CAST(sum(apply_learning_unknown_count) AS BIGINT) AS apply_learning_unknown_count,
        max(date_of_last_rank) AS date_of_last_rank, coalesce(max(rank_mode) FILTER (name = target), 'modifier') AS rank_mode, max(override_date) FILTER (name = target) AS override_date,
        max(effective_multiplier) AS effective_multiplier, max(notes) FILTER (name = target) AS notes FROM tr JOIN mm ON mm.name = tr.character GROUP BY target, trainer""",
    "trainer_report": TRAINED + """SELECT character, trainer, m.profession, effective, round(effective * effective_multiplier, 1) AS weighted,
        list_position(['Fighter', 'Healer', 'Mystic', 'Ranger', 'Bloodmage', 'Champion', 'Language', 'Arts', 'Trades', 'Other'], coalesce(m.profession, 'Other'))::BIGINT AS profession_order
        FROM tre LEFT JOIN meta m USING (trainer)""",
    "zero_trainers": TRAINED + """SELECT character, trainer, coalesce(ranks, 0) AS ranks, coalesce(modified_ranks, 0) AS modified_ranks, coalesce(apply_learning_ranks, 0) AS apply_learning_ranks,
        profession, coalesce(effective_multiplier, multiplier, 1.0) AS effective_multiplier
        FROM (SELECT c.character, m.trainer, m.profession, m.multiplier FROM (SELECT DISTINCT character FROM tr) c, meta m) g FULL JOIN tr USING (character, trainer)""",
    "weighted_ranks": TRAINED + """SELECT character, CAST(sum(round(effective * effective_multiplier)) AS BIGINT) AS weighted_ranks FROM tre t
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT trainer, unnest(parts) AS part FROM meta) m JOIN tre a ON a.trainer = m.part
                          WHERE m.trainer = t.trainer AND a.character = t.character AND a.effective > 0) GROUP BY character""",
    "trainer_catalog": TRAINED + "SELECT character, trainer, ranks FROM tr WHERE lower(trainer) LIKE '%us%' AND trainer IN (SELECT trainer FROM meta WHERE profession = 'Fighter')",
    "fighter_stats": FIGHTER,
    "profession": DETECT + """, said AS (SELECT character, announced FROM (""" + LOG + """SELECT character, last(profession ORDER BY seq) AS announced FROM att
        WHERE kind = 'ProfessionAnnouncement' AND self GROUP BY character))
        SELECT p.character, det.detected, CASE WHEN n % 7 = 0 THEN 'Champion' WHEN announced IN ('Ranger', 'Bloodmage', 'Champion') THEN announced
          WHEN detected IN ('Ranger', 'Bloodmage', 'Champion') THEN detected WHEN announced <> 'Unknown' THEN announced ELSE coalesce(detected, 'Unknown') END AS profession
        FROM people p LEFT JOIN det USING (character) LEFT JOIN said USING (character)""",
    "top_trainers": TRAINED + """SELECT character, trainer, ranks + modified_ranks AS total, row_number() OVER (PARTITION BY character ORDER BY ranks + modified_ranks DESC, trainer) AS rank FROM tr
        WHERE date_of_last_rank IS NOT NULL AND ranks + modified_ranks > 0 QUALIFY rank <= 10""",
    "character_list": TRAINED + """SELECT character, logins, coalesce(t, 0) AS total_ranks FROM people LEFT JOIN (SELECT character, CAST(sum(ranks + modified_ranks + apply_learning_ranks) AS BIGINT) AS t FROM tr GROUP BY 1) USING (character)
        WHERE merged_into IS NULL AND logins > 0 AND t >= 1 AND profession <> 'Unknown'""",
    "merge_map": KILLS + "SELECT name, target FROM mm",
    "merge_members": KILLS + "SELECT character, coalesce(merged_into, '-') AS merged_into FROM people WHERE character = 'Hero0' OR merged_into = 'Hero0'",
    "merge_violations": TRAINED + """, q AS (SELECT character AS source, 'Hero' || (n - n % 4 + CASE WHEN n % 6 = 0 THEN 100000 ELSE 0 END) AS target FROM people)
        , x AS (SELECT q.*, s.merged_into AS s_into, t.character AS t, t.merged_into AS t_into,
            EXISTS (SELECT 1 FROM tr WHERE tr.character = source AND rank_mode <> 'modifier') AS s_mode, EXISTS (SELECT 1 FROM tr WHERE tr.character = target AND rank_mode <> 'modifier') AS t_mode
          FROM q JOIN people s ON s.character = source LEFT JOIN people t ON t.character = target)
        SELECT source, target, 'unknown target' AS reason FROM x WHERE t IS NULL UNION ALL SELECT source, target, 'target is merged' FROM x WHERE t_into IS NOT NULL
        UNION ALL SELECT source, target, 'target has rank overrides' FROM x WHERE t_mode UNION ALL SELECT source, target, 'merge into itself' FROM x WHERE source = target
        UNION ALL SELECT source, target, 'source has rank overrides' FROM x WHERE s_mode UNION ALL SELECT source, target, 'source is merged' FROM x WHERE s_into IS NOT NULL""",
    "character_merged": KILLS + """SELECT target AS character, CAST(sum(logins) AS BIGINT) AS logins, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(departs) AS BIGINT) AS departs,
        CAST(sum(coins_picked_up) AS BIGINT) AS coins_picked_up, min(start_date) AS start_date, count(*) AS members FROM people JOIN mm ON mm.name = people.character GROUP BY target""",
    "pets_merged": with_kills(LASTYS) + "SELECT DISTINCT target AS character, creature AS pet_name, creature FROM la JOIN mm ON mm.name = la.character WHERE lasty_type = 'Befriend' AND finished",
    "lastys_rollup": LASTYS + "SELECT * FROM la",
    "lastys_merged": with_kills(LASTYS) + """SELECT target AS character, creature, lasty_type, bool_or(finished) AS finished, CAST(sum(message_count) AS BIGINT) AS message_count,
        min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(completed) AS completed, max(abandoned) AS abandoned FROM la JOIN mm ON mm.name = la.character GROUP BY target, creature, lasty_type""",
    "study_states": LASTYS + COSTS_X + "SELECT character, creature, " + ", ".join(
        f"coalesce(max(status) FILTER (lasty_type = '{t}'), 'none') AS {t.lower()}_status, max(message_count) FILTER (lasty_type = '{t}') AS {t.lower()}_count, "
        f"max(coalesce(completed, abandoned, last_seen)) FILTER (lasty_type = '{t}') AS {t.lower()}_date" for t in ("Movements", "Befriend", "Morph")) + " FROM ss GROUP BY ALL",
    "study_costs": LASTYS + COSTS_X + "SELECT character, creature, cost FROM sc",
    "ranger_points": with_kills(LASTYS) + TRAINER_X + COSTS_X + """, pts AS (SELECT character, CAST(coalesce(sum(effective) FILTER (trainer = 'Duvin Beastlore'), 0)
        + floor(coalesce(sum(effective) FILTER (trainer = 'Gossamer'), 0) / 4) AS BIGINT) AS total FROM tre GROUP BY 1), sp AS (SELECT character, CAST(sum(cost) AS BIGINT) AS spent FROM sc GROUP BY 1)
        SELECT character, coalesce(total, 0) AS total, coalesce(spent, 0) AS spent, coalesce(total, 0) - coalesce(spent, 0) AS available FROM pts FULL JOIN sp USING (character)""",
    "family_progress": LASTYS + FAMILY_X + "SELECT * FROM fp",
    "families_near": LASTYS + FAMILY_X + "SELECT character, family, bonus_pct FROM fp WHERE NOT is_maxed AND movements_completed > 0",
    "morph_candidates": LASTYS + TARGETS_X + "SELECT character, creature, family, value, stage, points_left FROM mc",
    "top_targets": LASTYS + TARGETS_X + " UNION ALL ".join(f"""SELECT character, '{c}' AS category, creature, row_number() OVER (PARTITION BY character ORDER BY {o}, value DESC, creature) AS rank
        FROM mc WHERE value <= 40 AND {f} > 0 QUALIFY rank <= 20""" for c, o, f in (("value", "value DESC", "value"), ("attack", "attack DESC", "attack"), ("frames_per_swing", "fps", "fps"))),
    "coins_report": LOG + f""", cc AS (SELECT character, {counter_sql()} FROM att GROUP BY character)
        SELECT character, fur_coins + mandible_coins + blood_coins + bounty_coins + chest_coins + coins_picked_up + esteem AS net, fur_worth + mandible_worth + blood_worth AS loot_worth,
          0 AS casino_net, source, coins FROM cc, LATERAL (VALUES ('fur_coins', fur_coins), ('mandible_coins', mandible_coins), ('blood_coins', blood_coins), ('bounty_coins', bounty_coins),
          ('chest_coins', chest_coins), ('coins_picked_up', coins_picked_up), ('esteem', esteem)) v(source, coins) WHERE coins <> 0""",
    "equipment_report": LOG + f""", cc AS (SELECT character, {counter_sql()} FROM att GROUP BY character), fc AS (SELECT character, item, count(*) AS n FROM att WHERE kind = 'FishCaught' GROUP BY ALL)
        , fs AS (SELECT character, sum(n) AS n, string_agg(item || ':' || n, ', ' ORDER BY n DESC, item) AS catches FROM fc GROUP BY 1)
        SELECT character, round(100.0 * wood_taken / nullif(wood_taken + wood_useless, 0), 1)::DOUBLE AS wood_success, mimics_caught + 3 AS bag_slots,
          CAST(fishing_attempts + coalesce(n, 0) AS BIGINT) AS fishing_attempts, catches FROM cc LEFT JOIN fs USING (character)""",
    "character_summary": LOG + GATED_X + STUDIED_X + REFLECT_X + f""", cc AS (SELECT character, {counter_sql()} FROM att GROUP BY character)
        , d AS (SELECT *, max(seq) FILTER (kind = 'Depart') OVER (PARTITION BY character) AS s FROM att WHERE kind IN ('Depart', 'FirstDepart'))
        , dep AS (SELECT character, CAST(coalesce(max(amount) FILTER (seq = s), 0) + count(*) FILTER (kind = 'FirstDepart' AND seq > coalesce(s, -1)) AS BIGINT) AS departs FROM d GROUP BY character)
        , kk AS (SELECT character, creature, count(*) FILTER (kind = 'SoloKill') AS s, count(*) FILTER (kind = 'AssistedKill') AS a, count(*) FILTER (kind = 'Fallen') AS f
                 FROM att WHERE {IS_KILL} OR (kind = 'Fallen' AND self) GROUP BY ALL)
        , kt AS (SELECT character, CAST(sum(s) AS BIGINT) AS solo, CAST(sum(a) AS BIGINT) AS assisted, CAST(sum(f) AS BIGINT) AS killed_by, count(*) AS creatures FROM kk GROUP BY 1)
        , mk AS (SELECT character, creature AS most_killed FROM kk WHERE s + a > 0 QUALIFY row_number() OVER (PARTITION BY character ORDER BY s + a DESC, creature) = 1)
        , tt AS (SELECT character, trainer, count(*) FILTER (kind = 'TrainerRank') AS ranks, 10 * count(*) FILTER (kind = 'ApplyLearningRank' AND flag) AS al FROM ranks WHERE counted GROUP BY ALL)
        , ts AS (SELECT character, CAST(sum(ranks) AS BIGINT) AS ranks, CAST(round(sum((ranks + al) * CAST(CASE trainer WHEN 'Evus' THEN 1.1436 WHEN 'Swengus' THEN 1.0549 WHEN 'Gossamer' THEN 0.5 ELSE 1.0 END AS DECIMAL(12,6))), 1) AS DOUBLE) AS effective_ranks,
                   count(*) AS trainers FROM tt GROUP BY 1)
        , sl AS (SELECT character, count(DISTINCT creature || '|' || lasty_type) AS studies FROM (
                 SELECT character, creature, coalesce(lasty_type, 'Movements') AS lasty_type FROM studied WHERE kind <> 'StudyAbandon' UNION ALL SELECT character, creature, lasty_type FROM reflected) GROUP BY 1)
        SELECT cc.character, deaths, coalesce(departs, 0) AS departs, solo, assisted, killed_by, creatures, most_killed, ts.ranks, effective_ranks, trainers,
          round(100.0 * coalesce(departs, 0) / nullif(coalesce(departs, 0) + deaths, 0), 1)::DOUBLE AS depart_rate,
          round(100.0 * chains_broken / nullif(chains_broken + chains_used, 0), 1)::DOUBLE AS chain_break_rate, studies
        FROM cc LEFT JOIN dep USING (character) LEFT JOIN kt USING (character) LEFT JOIN mk USING (character) LEFT JOIN ts USING (character) LEFT JOIN sl USING (character)""",
    "update_delta": LOG + """SELECT character, CAST(count(*) FILTER (kind = 'Login') AS BIGINT) AS logins, CAST(count(*) FILTER (kind = 'Fallen' AND self) AS BIGINT) AS deaths
        FROM att WHERE date >= '2024-01-15' GROUP BY 1 HAVING count(*) FILTER (kind = 'Login') + count(*) FILTER (kind = 'Fallen' AND self) > 0""",
    "month_spine": KILLS + f"SELECT * FROM {SPINE('k', 'date_last')}",
    "cv_timeline_kill": KILLS + f""", s AS {STUFF}, c AS (SELECT character, creature, creature_value AS v, coalesce(date_first_killed, date_last_killed) AS k_at FROM s
          WHERE {VT['killed']} >= 5 AND stuffable AND coalesce(date_first_killed, date_last_killed) IS NOT NULL)
        , st AS (SELECT * FROM (SELECT *, k_at[1:10] AS date, coalesce(max(v) OVER (PARTITION BY character ORDER BY k_at, creature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high FROM c) WHERE v > high)
        , pt AS (SELECT character, date FROM st UNION SELECT character, date FROM {SPINE('st', 'date')})
        SELECT pt.character, pt.date, (SELECT max(v) FROM st WHERE st.character = pt.character AND st.date <= pt.date) AS kill_value,
          (SELECT first(creature ORDER BY v DESC) FROM st WHERE st.character = pt.character AND st.date = pt.date) AS kill_creature FROM pt""",
    "cv_timeline_rank": TRAINED + f""", s AS {STUFF}, c AS (SELECT character, creature, creature_value AS v, coalesce(date_first_killed, date_last_killed) AS k_at FROM s
          WHERE {VT['killed']} >= 5 AND stuffable AND coalesce(date_first_killed, date_last_killed) IS NOT NULL)
        , ks AS (SELECT * FROM (SELECT *, k_at[1:10] AS date, coalesce(max(v) OVER (PARTITION BY character ORDER BY k_at, creature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high FROM c) WHERE v > high)
        , tp AS (SELECT t.character, (ranks + modified_ranks) * coalesce(c.c, 20) AS points, date_of_last_rank[1:10] AS date, ranks + modified_ranks AS n
                 FROM tre t LEFT JOIN cost c ON c.trainer = t.formula)
        , dt AS (SELECT * FROM tp WHERE date IS NOT NULL AND n > 0)
        , ends AS (SELECT character, min(date) AS lo, max(date) AS hi FROM (SELECT character, date FROM dt UNION ALL SELECT character, date FROM ks) GROUP BY 1)
        , st AS (SELECT character, date, points FROM dt UNION ALL SELECT character, lo, 0 FROM ends
                 UNION ALL SELECT e.character, e.hi, r.rest FROM ends e JOIN (SELECT character, sum(points) - coalesce(sum(points) FILTER (date IS NOT NULL AND n > 0), 0) AS rest FROM tp GROUP BY 1) r
                   ON r.character = e.character WHERE rest / 150.0 > 0.01)
        , pt AS (SELECT character, date FROM st UNION SELECT character, date FROM {SPINE('st', 'date')})
        SELECT pt.character, pt.date, round(((SELECT sum(points) FROM st WHERE st.character = pt.character AND st.date <= pt.date) + {RACE_SP}) / 150.0::DOUBLE, 1) AS rank_value FROM pt""",
    "trainer_timeline": TRAINED + f""", tt AS (SELECT character, trainer, ranks + modified_ranks AS n, date_of_last_rank[1:7] || '-01' AS m FROM tr
          WHERE date_of_last_rank IS NOT NULL AND ranks + modified_ranks > 0 QUALIFY row_number() OVER (PARTITION BY character ORDER BY ranks + modified_ranks DESC, trainer) <= 10)
        , sp AS (SELECT * FROM {SPINE('tt', 'm')} UNION ALL SELECT character, strftime(CAST(min(m) AS DATE) - INTERVAL 1 MONTH, '%Y-%m-%d') FROM tt GROUP BY 1)
        SELECT sp.character, sp.date, tt.trainer, CASE WHEN sp.date >= tt.m THEN n ELSE 0 END AS ranks FROM sp JOIN tt USING (character)""",
    "studies_timeline": LASTYS + f""", dn AS (SELECT character, completed AS date, creature, lasty_type FROM la WHERE finished AND completed IS NOT NULL)
        , al AS (SELECT *, 0 AS filler FROM dn UNION ALL SELECT character, date, NULL, NULL, 1 FROM {SPINE('dn', 'date')} m
                 WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.character = m.character AND dn.date[1:10] = m.date))
        SELECT character, date, lasty_type, creature, {', '.join(f"CAST(count(*) FILTER (lasty_type = '{t}') OVER w AS BIGINT) AS {a}" for t, a in (('Movements', 'movements'), ('Befriend', 'befriends'), ('Morph', 'morphs')))}
        FROM al WINDOW w AS (PARTITION BY character ORDER BY date, filler, list_position(['Movements', 'Befriend', 'Morph'], lasty_type), creature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "stats_timeline": TRAINED + f""", tt AS (SELECT t.character, ranks + modified_ranks AS n, date_of_last_rank[1:7] || '-01' AS m, CAST(coalesce(meta.multiplier, 1.0) AS DECIMAL(12,6)) AS mult, coalesce(c.c, 20) AS cst
          FROM tre t LEFT JOIN meta USING (trainer) LEFT JOIN cost c ON c.trainer = t.formula WHERE date_of_last_rank IS NOT NULL AND ranks + modified_ranks > 0)
        SELECT sp.character, sp.date, CAST(sum(n) AS BIGINT) AS trained_ranks, CAST(floor(round(sum(n * mult), 1) + 0.5) AS BIGINT) AS effective_ranks,
          CAST(floor((sum(n * cst) + {RACE_SP}) / 150.0 + 0.5) AS BIGINT) AS slaughter_ranks FROM {SPINE('tt', 'm')} sp JOIN tt ON tt.character = sp.character AND tt.m <= sp.date GROUP BY ALL""",
    "checkpoint_timeline": BOWS + f""", tops AS (SELECT character, trainer FROM (SELECT character, trainer, max(rank_min) AS r FROM cps GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY character ORDER BY r DESC, trainer) <= 10)
        , ev2 AS (SELECT cps.character, trainer, date[1:10] AS date, last(rank_min ORDER BY cps.date, seq) AS r FROM cps JOIN tops USING (character, trainer) GROUP BY cps.character, trainer, date[1:10])
        , ds AS (SELECT character, date FROM ev2 UNION SELECT character, date FROM {SPINE('ev2', 'date')})
        , al AS (SELECT character, date FROM ds UNION ALL SELECT character, strftime(CAST(min(date[1:7] || '-01') AS DATE) - INTERVAL 1 MONTH, '%Y-%m-%d') FROM ds GROUP BY 1)
        SELECT al.character, tops.trainer, al.date, (SELECT last(r ORDER BY date) FROM ev2 e WHERE e.character = al.character AND e.trainer = tops.trainer AND e.date <= al.date) AS rank_min,
          CAST(EXISTS (SELECT 1 FROM ev2 e WHERE e.character = al.character AND e.trainer = tops.trainer AND e.date = al.date) AS BIGINT) AS is_event FROM al JOIN tops USING (character)""",
    "creature_lookup": "WITH z AS (SELECT 1)" + BEAST_X + """SELECT be.name AS creature, value, family, 'bestiary' AS source FROM be UNION ALL SELECT 'the ' || be.name, value, family, 'bestiary' FROM be
        UNION ALL SELECT 'Old ' || be.name, CASE WHEN p_partkey % 2 = 0 THEN value ELSE 0 END, CASE WHEN p_partkey % 2 = 0 THEN family END, CASE WHEN p_partkey % 2 = 0 THEN 'alias' END FROM be
        UNION ALL SELECT 'the Odd ' || be.name, CASE WHEN p_partkey % 2 = 1 THEN 2 * p_partkey ELSE 0 END, CASE WHEN p_partkey % 2 = 1 THEN 'Odd' END, CASE WHEN p_partkey % 2 = 1 THEN 'inline' END FROM be
        UNION ALL SELECT 'no ' || be.name, 0, NULL, NULL FROM be""",
    "trainer_lookup": f"""WITH meta(trainer, profession, multiplier, parts) AS (VALUES {_META}), e AS (SELECT event_id, ({_T})[event_id % {_NT} + 1] AS t, event_id % {_NT} AS i FROM events)
        SELECT event_id, CASE WHEN i < 10 THEN t END AS trainer, CASE WHEN i < 10 THEN profession END AS profession, CASE WHEN i < 10 THEN multiplier ELSE 1.0 END AS multiplier
        FROM e JOIN meta ON meta.trainer = e.t""",
    "alias_checks": """WITH a AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Old ' ELSE 'Odd ' END || p_name || ' ' || p_partkey AS log_name, p_partkey % 2 = 0 AS pointer, p_partkey FROM part)
        , gone AS (SELECT log_name FROM a WHERE pointer AND (p_name_ends(p_partkey)))
        SELECT log_name, 'missing target' AS problem FROM gone UNION ALL SELECT log_name || '~', 'missing target' FROM gone
        UNION ALL SELECT log_name, 'duplicate' FROM a WHERE p_partkey % 100 = 75""".replace("(p_name_ends(p_partkey))", "p_partkey >= 10 AND p_partkey % 50 = 0"),
    "canonical_family": "WITH z AS (SELECT 1)" + BEAST_X + """, n AS (SELECT family, count(*) AS n FROM be GROUP BY 1)
        SELECT n.family, (SELECT first(m.family ORDER BY m.n DESC, m.family) FROM n m WHERE lower(m.family) = lower(n.family)) AS canonical FROM n""",
    "canonical_rarity": "WITH z AS (SELECT 1)" + BEAST_X + f"SELECT name, {rarity('be.rarity')} AS rarity FROM be",
    "bestiary_table": "WITH z AS (SELECT 1)" + BEAST_X + f""", n AS (SELECT family, count(*) AS n FROM be GROUP BY 1)
        SELECT name, value, (SELECT first(m.family ORDER BY m.n DESC, m.family) FROM n m WHERE lower(m.family) = lower(be.family)) AS family_canonical, {rarity('be.rarity')} AS rarity_canonical FROM be""",
    "decode_lines": """WITH t AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents)
        SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS content FROM t""",
    "log_line_count": "SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') AS path, count(*) AS lines FROM conversations WHERE trim(text) <> '' GROUP BY conv_id",
    "log_search": f"""SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') AS path, turn AS line_no, role AS character_name FROM conversations WHERE {_NORM} LIKE '% de la %' AND NOT {_SPEECH}""",
    "log_search_context": f"""SELECT lpad(CAST(c.conv_id AS VARCHAR), 12, '0') AS path, c.turn AS line_no,
        coalesce((SELECT {_CTX} FROM conversations y WHERE y.conv_id = c.conv_id AND y.turn = c.turn - 1 AND trim(y.text) <> ''), '') AS context_before,
        coalesce((SELECT {_CTX} FROM conversations y WHERE y.conv_id = c.conv_id AND y.turn IN (c.turn + 1, c.turn + 2) AND trim(y.text) <> ''), '') AS context_after
        FROM conversations c WHERE {_NORM.replace('text', 'c.text')} LIKE '% the of %'""",
    "log_snippets": f"""WITH h AS (SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') AS path, turn AS line_no, {_MARKED} AS marked FROM conversations WHERE {_NORM} LIKE '% the of %'),
        p AS (SELECT path, line_no, string_split(marked, ' ') AS parts FROM h),
        f AS (SELECT *, len(parts) AS n, coalesce(nullif(list_position(list_transform(parts, lambda x: contains(x, '<mark>')), true), 0), 1) AS hit FROM p),
        w AS (SELECT *, greatest(1, least(hit - 32, n - 63)) AS lo FROM f)
        SELECT path, line_no, CASE WHEN lo > 1 THEN '...' ELSE '' END || array_to_string(parts[lo:lo + 63], ' ') || CASE WHEN lo + 63 < n THEN '...' ELSE '' END AS snippet FROM w""",
    "scan_plan": PLAN + "SELECT path, action, CAST(off AS BIGINT) AS offset FROM plan".replace("AS offset", 'AS "offset"'),
    "pending_files": PLAN + "SELECT path FROM plan WHERE action IN ('scan', 'tail')",
    "manifest_update": PLAN + """SELECT path, length AS byte_len, '2024-02-01 00:00:00' AS date_read FROM plan WHERE action IN ('scan', 'tail')
        UNION ALL SELECT f.path, CASE WHEN i = 1 THEN f.length WHEN i IN (2, 3) THEN f.length // 2 ELSE 0 END, '2024-01-01 00:00:00' FROM f JOIN plan USING (path) WHERE i > 0 AND action NOT IN ('scan', 'tail')""",
    "stream_hourly": LOG + """SELECT character, creature, date[1:13] AS hour, count(*) FILTER (kind = 'SoloKill') AS solo, count(*) FILTER (kind = 'AssistedKill') AS assisted
        FROM att WHERE kind IN ('SoloKill', 'AssistedKill') AND date <> '' GROUP BY ALL""",
    "majority_vote": """WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS item, turn AS doc_id, unnest(string_split(text, ' ')) AS line FROM conversations), d AS (SELECT DISTINCT * FROM l WHERE line <> '')
        , f AS (SELECT item, count(DISTINCT doc_id) AS files FROM d GROUP BY 1) SELECT item, line, files FROM d JOIN f USING (item) GROUP BY ALL HAVING count(*) >= ceil(files / 2.0)""",
    "jaccard_pairs": SETS + """, sig AS (SELECT item, string_agg(line, chr(10) ORDER BY line) AS sig FROM s GROUP BY 1)
        , rep AS (SELECT first(sig.item ORDER BY files DESC, sig.item) AS item FROM sig JOIN fc USING (item) GROUP BY sig)
        SELECT CASE WHEN fpf >= fqf THEN p ELSE q END AS a, CASE WHEN fpf >= fqf THEN q ELSE p END AS b, common, combined FROM j WHERE p IN (SELECT item FROM rep) AND q IN (SELECT item FROM rep)""",
    "jaccard_dedup": SETS.replace("WITH w AS", "WITH RECURSIVE w AS", 1) + """, o AS (SELECT item, row_number() OVER (ORDER BY files DESC, item) AS i FROM fc)
        , walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL
          SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM j WHERE (j.p = o.item AND list_contains(w2.kept, j.q)) OR (j.q = o.item AND list_contains(w2.kept, j.p)))
            THEN w2.kept ELSE list_append(w2.kept, o.item) END FROM walk w2 JOIN o ON o.i = w2.i + 1)
        SELECT unnest(kept) AS item FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)""",
    "discover_logs": """WITH u AS (SELECT DISTINCT user_id AS u FROM events), f AS (
          SELECT u, CASE u % 6 WHEN 0 THEN '/base/a/Hero' || u || '/CL Log 1' WHEN 1 THEN '/base/a/CL Log ' || u WHEN 2 THEN '/base/b/c/Hero' || u || '/CL Log 1'
            WHEN 3 THEN '/base/b/c/Hero' || u || '/deep/CL Log 1' WHEN 4 THEN '/base/b/.hidden/Hero' || u || '/CL Log 1' ELSE '/base/a/CL_Movies/CL Log ' || u END AS path FROM u)
        SELECT path, CASE WHEN u % 6 < 2 THEN '/base/a' ELSE '/base/b/c' END AS root, CASE WHEN u % 6 IN (0, 2) THEN 'Hero' || u END AS folder, u % 6 = 1 AS loose FROM f WHERE u % 6 < 3""",
    "bestiary_xml": "WITH z AS (SELECT 1)" + BEAST_X + "SELECT name, family, rarity, value, fps AS frames_per_swing, p_partkey % 6 = 0 AS is_seasonal, CASE WHEN attack > 0 THEN attack END AS attack FROM be",
    "bestiary_writer": "WITH z AS (SELECT 1)" + BEAST_X + "SELECT name, family, value, '20260520' AS version FROM be",
    "write_tables": KILLS + f"SELECT character, creature, date[1:13] AS hour, {COUNTERS} FROM kev WHERE {IS_KILL} GROUP BY ALL",
    "csv_export": KILLS + """SELECT '"' || creature || '",' || character || ',' || killed_count AS value FROM k""",
    "tail_scan": LOG + """SELECT path, line_no, character FROM att JOIN (SELECT path, (min(line_no) + max(line_no)) / 2.0 AS mid FROM ln GROUP BY path) USING (path)
        WHERE line_no >= mid""",
    "stream_attribute": LOG + "SELECT path, line_no, character FROM att",
    "import_characters": f"""WITH meta(trainer, profession, multiplier, parts) AS (VALUES {_META}), c AS (SELECT *, replace(c_name, '#', ' ') AS nm, c_custkey % 11 = 5 AS bad FROM customer)
        , t AS (SELECT o_custkey, ({_T})[o_orderkey % {_NT} + 1] AS trainer, count(*) + 1 AS eff FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
        , w AS (SELECT o_custkey, CAST(sum(round(eff * multiplier)) AS BIGINT) AS lvl FROM t JOIN meta USING (trainer)
                WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.o_custkey = t.o_custkey AND list_contains(meta.parts, x.trainer)) GROUP BY 1)
        SELECT nm AS character, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Fighter' ELSE 'Unknown' END AS profession, CAST(c_nationkey % 3 AS BIGINT) AS logins,
          CASE WHEN c_nationkey > 3 AND c_custkey > 0 THEN strftime(to_timestamp(c_custkey * 86400 + 978307200) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS start_date,
          CAST(floor(c_acctbal) AS BIGINT) AS coins_picked_up, coalesce(lvl, 0) AS coin_level FROM c LEFT JOIN w ON w.o_custkey = c_custkey
        WHERE NOT bad AND (c_mktsegment = 'BUILDING' OR c_nationkey % 3 > 0 OR c_custkey IN (SELECT o_custkey FROM orders))""",
    "import_kills": """WITH k AS (SELECT o_custkey, o_orderpriority AS creature, count(*) AS killed_count, count(*) FILTER (o_orderstatus = 'P') AS slaughtered_count, max(o_orderkey) AS lv,
          nullif(min(o_orderdate) FILTER (o_orderstatus = 'O'), TIMESTAMP '2001-01-01') AS dk, nullif(min(o_orderdate) FILTER (o_orderstatus = 'P'), TIMESTAMP '2001-01-01') AS ds,
          nullif(max(o_orderdate), TIMESTAMP '2001-01-01') AS dl FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
        SELECT replace(c_name, '#', ' ') AS character, creature, killed_count, slaughtered_count, CASE WHEN creature = '1-URGENT' THEN 77 ELSE lv END AS creature_value,
          strftime(least(dk, ds), '%Y-%m-%d') AS date_first, strftime(dk, '%Y-%m-%d') AS date_first_killed, strftime(dl, '%Y-%m-%d') AS date_last FROM k JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 11 <> 5""",
    "scalar_functions": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS words, p_name AS bare,
        upper(p_type[1]) || lower(p_type[2:]) AS profession, printf('2024-01-05 %02d', p_partkey % 24) AS hour, '2024-01-05 00' AS day_hour,
        printf('2024-01-05 %02d:00–%02d:00', p_partkey % 24, (p_partkey + 2) % 24) AS two_hours, '2024-01-05' AS day, '"' || p_name || ',""' || p_brand || '"' AS cell,
        CAST(((p_partkey % 12 + 1) % 12 + CASE WHEN p_partkey % 2 = 1 THEN 12 ELSE 0 END) * 3600 + (p_size % 60) * 60 + 5 AS BIGINT) AS seconds, p_partkey % 3 = 0 AS valid,
        CASE WHEN p_partkey > 0 THEN strftime(DATE '2001-01-01' + CAST(p_partkey AS INT), '%Y-%m-%d') END AS legacy, CAST(p_partkey AS VARCHAR) AS version,
        '"' || p_name || '''s"' AS quotes, true AS same FROM part""",
    "titlecase_name": "SELECT c_custkey, 'Sir ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || ['IV', 'Xx', 'Max', 'VIII'][c_custkey % 4 + 1] AS name FROM customer",
    "date_after": """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') > '6/' || (o_custkey % 28 + 1) || '/xx'
        ELSE CAST(o_orderdate AS DATE) > make_date([1995, 1997, 2000, 2001, 0][o_custkey % 5 + 1], 6, o_custkey % 28 + 1) END AS later FROM orders""",
}

ORACLES["stream_late"] = ORACLES["stream_hourly"]
ORACLES["kills_filtered_aliased"] = KILLS + """, al AS (
    SELECT DISTINCT p_type || ' ' || p_brand AS log_name, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS brand FROM part)
    SELECT k.character, k.creature, k.killed_count FROM k LEFT JOIN al ON al.log_name = k.creature AND al.brand % 11 = 5
    LEFT JOIN kbl ON kbl.name = CASE WHEN al.brand % 2 = 0 THEN 'Unseen ' ELSE '' END || k.creature
    WHERE (al.brand % 2 = 1) OR (lower(coalesce(family_canonical, '')) = 'economy' AND NOT coalesce(is_seasonal, false))"""
ORACLES["log_search_character"] = f"""WITH h AS (SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') AS path, CAST(turn AS BIGINT) AS line_no, role, CASE WHEN role = 'assistant' THEN role ELSE 'Unknown' END AS character_name
    FROM conversations WHERE {_NORM} LIKE '% de la %' AND NOT {_SPEECH})
    SELECT * FROM (SELECT path, line_no, character_name FROM h WHERE role = 'user' ORDER BY path DESC, line_no DESC LIMIT 25)
    UNION ALL SELECT '', count(*), character_name FROM h GROUP BY character_name"""
ORACLES["majority_vote_sources"] = """WITH d AS (SELECT DISTINCT source AS item, doc_id, unnest(string_split(text, ' ')) AS line FROM documents), w AS (SELECT * FROM d WHERE line <> ''), f AS (SELECT item, count(DISTINCT doc_id) AS files FROM w GROUP BY 1)
    SELECT item, line, files FROM w JOIN f USING (item) GROUP BY ALL HAVING count(*) >= ceil(files / 2.0)"""
ORACLES["import_trainers"] = f"""WITH meta(trainer, profession, multiplier, parts) AS (VALUES {_META}), t AS (SELECT o_custkey, ({_T})[o_orderkey % {_NT} + 1] AS trainer, count(*) AS ranks, max(o_orderdate) AS day
    FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
    SELECT replace(c_name, '#', ' ') AS character, trainer, ranks, CAST(1 AS BIGINT) AS modified_ranks, 'modifier' AS rank_mode, strftime(nullif(day, TIMESTAMP '2001-01-01'), '%Y-%m-%d') AS date_of_last_rank,
      CAST(multiplier AS DOUBLE) AS effective_multiplier FROM t JOIN meta USING (trainer) JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 11 <> 5"""
ORACLES["import_pets"] = """SELECT replace(c_name, '#', ' ') AS character, pet_name, coalesce(nullif(most, ''), pet_name) AS creature FROM (SELECT o_custkey, 'Pet ' || o_orderkey % 4 AS pet_name,
    min(CASE WHEN o_orderkey % 3 = 0 THEN 'Beast ' || o_orderkey % 5 ELSE '' END) AS most FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 11 <> 5"""
ORACLES["import_studies"] = """SELECT replace(c_name, '#', ' ') AS character, creature, lasty_type, finished, message_count FROM (SELECT o_custkey, 'Beast ' || o_orderkey % 6 AS creature,
    ['Movements', 'Befriend', 'Morph'][o_orderkey % 3 + 1] AS lasty_type, bool_or(o_orderkey % 2 = 0) AS finished, count(*) AS message_count FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
    JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 11 <> 5"""
ORACLES["import_report"] = f"""WITH c AS (SELECT *, c_custkey % 11 = 5 AS bad, c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders) AS related FROM customer), good AS (SELECT c_custkey AS o_custkey FROM c WHERE NOT bad)
    , o AS (SELECT orders.*, ({_T})[o_orderkey % {_NT} + 1] AS trainer FROM orders JOIN good USING (o_custkey))
    SELECT 'characters_imported' AS item, count(*) FILTER (NOT bad AND (related OR c_nationkey % 3 > 0)) AS n FROM c UNION ALL SELECT 'characters_skipped', count(*) FILTER (bad OR NOT (related OR c_nationkey % 3 > 0)) FROM c
    UNION ALL SELECT 'trainers_imported', count(DISTINCT (o_custkey, trainer)) FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT 'kills_imported', count(DISTINCT (o_custkey, o_orderpriority)) FROM o WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'pets_imported', count(DISTINCT (o_custkey, o_orderkey % 4)) FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT 'lastys_imported', count(DISTINCT (o_custkey, o_orderkey % 6)) FROM o WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'Skipped character with invalid name: bad/' || c_name, 1 FROM c WHERE bad AND related"""
UNREAD = PLAN.replace("FROM f WHERE i = 0", "FROM f WHERE i = 0 AND doc_id % 17 <> 3").replace("WHEN i = 2 THEN 'tail'", "WHEN doc_id % 17 = 3 THEN 'error' WHEN i = 2 THEN 'tail'").replace(
    "FROM f WHERE i > 0\n", "FROM f WHERE i > 0\n  UNION ALL SELECT path, 'error', 0, length FROM f WHERE i = 0 AND doc_id % 17 = 3\n")
ORACLES["scan_plan_messages"] = UNREAD + """SELECT CASE action WHEN 'duplicate' THEN 'info' WHEN 'changed' THEN 'warn' ELSE 'error' END AS level, CASE action
      WHEN 'duplicate' THEN 'Skipped duplicate file (same content already scanned): ' WHEN 'changed' THEN 'Log file changed unexpectedly (rotated/truncated); skipped — run Rescan Logs to reconcile: '
      ELSE 'Could not read file: ' END || path AS message, path AS file_path FROM plan WHERE action IN ('duplicate', 'changed', 'error')"""
ORACLES["scan_plan_report"] = UNREAD + """SELECT count(*) FILTER (action IN ('scan', 'tail')) AS files_scanned, count(*) FILTER (action IN ('skip', 'duplicate', 'changed')) AS files_skipped,
    count(*) FILTER (action = 'error') AS errors FROM plan"""
