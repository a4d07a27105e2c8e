"""Oracle SQL for the rendered log: what each event means, straight from the base tables.

Nothing is rendered or parsed here. `ln` has one row per log line with its expected event; `att` adds
the filled date and the active character.
"""

from __future__ import annotations

from questlog.functions.catalogs import CHECKPOINT_PHRASES
from questlog.plans.adapters import ORES, TRAINER_NAMES


def text_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_MINS = text_list([a for a, _ in CHECKPOINT_PHRASES.values()])
_MAXS = text_list([b for _, b in CHECKPOINT_PHRASES.values()])
_N = len(CHECKPOINT_PHRASES)
_T10 = text_list(TRAINER_NAMES[:10])
_PROF = text_list(["Fighter", "Healer", "Mystic", "Ranger", "Bloodmage", "Champion", "Bard"])
_TYPES = text_list(["Movements", "Befriend", "Morph"])

LOG = f"""
WITH ev AS (
  SELECT e.event_id AS e, e.user_id AS u, e.event_type AS t, e.k, floor(e.value)::BIGINT AS amt, floor(e.value / 2)::BIGINT AS half,
         date_trunc('second', e.ts) AS sts, p.p_name || ' ' || p.p_partkey AS part_creature,
         e.user_id % 10 = 9 AS loose,
         CASE WHEN e.user_id % 10 = 9 THEN '' ELSE 'Hero' || e.user_id END AS folder,
         printf('%04d:%02d:%02d %02d.%02d.%02d', year(e.ts), month(e.ts), ((day(e.ts) - 1) // 7) * 7 + 1,
                (e.user_id // 3600) % 24, (e.user_id // 60) % 60, e.user_id % 60) AS stem
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) e LEFT JOIN part p ON p.p_partkey = e.k
), raw AS (
  SELECT ev.*, s.sub, e * 4 + s.sub AS line_no,
         '/logs/' || CASE WHEN loose THEN '' ELSE folder || '/' END || 'CL Log ' || stem || '.txt' AS path,
         replace(replace(substr(stem, 1, 10), ':', '-') || substr(stem, 11), '.', ':') AS file_ts,
         k % 50 = 49 AND t IN ('click', 'view', 'signup') AS broken,
         'Beast ' || (e % 7) AS beast, 'Beast ' || (e % 5 + 7) AS other,
         ({_T10})[k % 10 + 1] AS tr, ({_TYPES})[k % 3 + 1] AS ty,
         ({_MINS})[e % {_N} + 1]::BIGINT AS pmin, ({_MAXS})[e % {_N} + 1]::BIGINT AS pmax,
         CASE WHEN k % 2 = 1 THEN 'HERO' || u ELSE 'Hero' || u END AS same
  FROM ev, (VALUES (0), (1), (2), (3)) s(sub)
  WHERE s.sub < CASE WHEN t <> 'error' THEN 1 WHEN k BETWEEN 64 AND 67 OR k = 69 OR k BETWEEN 92 AND 97 THEN 3
                     WHEN k = 68 THEN 4 WHEN k = 98 THEN 2 ELSE 1 END
), kinds AS (
  SELECT *, CASE WHEN k % 10 = 7 OR broken THEN NULL ELSE strftime(sts, '%Y-%m-%d %H:%M:%S') END AS own_ts,
    CASE WHEN broken THEN 'Ignored'
    WHEN t = 'click' THEN CASE
      WHEN k < 60 THEN 'SoloKill' WHEN k < 64 THEN 'FishCaught' WHEN k < 67 THEN 'FishingMiss' WHEN k < 75 THEN 'OreFound'
      WHEN k < 80 THEN 'WoodTaken' WHEN k < 83 THEN 'WoodUseless' WHEN k < 87 THEN 'CoinsPickedUp' WHEN k < 89 THEN 'CoinBalance'
      WHEN k = 89 THEN 'BellUsed' WHEN k = 90 THEN 'BellBroken' WHEN k = 91 THEN 'ChainBreak' WHEN k = 92 THEN 'ChainShatter'
      WHEN k = 93 THEN 'ChainSnap' WHEN k = 94 THEN 'ChainUsed' WHEN k = 95 THEN 'ShieldstoneUsed' WHEN k = 96 THEN 'ShieldstoneBroken'
      WHEN k = 97 THEN 'EtherealPortalOpened' WHEN k = 98 THEN 'EtherealPortalStoneUsed' ELSE 'EsteemGain' END
    WHEN t = 'view' THEN CASE
      WHEN k < 60 THEN 'AssistedKill' WHEN k < 75 THEN 'Fallen' WHEN k < 77 THEN 'Recovered' WHEN k = 77 THEN 'FirstDepart'
      WHEN k < 81 THEN 'Depart' WHEN k < 85 THEN 'KarmaReceived' WHEN k < 89 THEN 'KarmaGiven' WHEN k = 89 THEN 'ExperienceGain'
      WHEN k = 90 THEN 'EsteemGain' WHEN k < 93 THEN 'ClanningChange' WHEN k = 93 THEN 'Disconnect' WHEN k = 94 THEN 'Untrained'
      ELSE 'Ignored' END
    WHEN t = 'purchase' THEN CASE
      WHEN k < 70 THEN 'LootShare' WHEN k < 80 THEN 'StudyCharge' WHEN k < 95 THEN 'ApplyLearningRank' ELSE 'ProfessionAnnouncement' END
    WHEN t = 'signup' THEN CASE
      WHEN k < 10 THEN 'Login' WHEN k < 15 THEN 'Reconnect' WHEN k < 20 THEN 'Login' WHEN k < 95 THEN 'TrainerRank' ELSE 'Ignored' END
    ELSE CASE
      WHEN k < 20 THEN 'LastyBeginStudy' WHEN k < 35 THEN 'LastyProgress' WHEN k < 45 THEN 'StudyProgress' WHEN k < 50 THEN 'StudyAbandon'
      WHEN k < 60 THEN 'LastyFinished' WHEN k < 64 THEN 'LastyCompleted'
      WHEN k < 68 THEN CASE WHEN sub = 0 THEN 'ReflectListHeader' ELSE 'Ignored' END
      WHEN k = 68 THEN CASE sub WHEN 0 THEN 'ReflectListHeader' WHEN 2 THEN 'EsteemGain' ELSE 'Ignored' END
      WHEN k = 69 THEN CASE sub WHEN 0 THEN 'StudyProgress' WHEN 1 THEN 'ReflectListHeader' ELSE 'Ignored' END
      WHEN k < 80 THEN 'TrainerCheckpoint' WHEN k < 83 THEN 'TrainerGreetingWithUnknownCheckpoint' WHEN k < 86 THEN 'TrainerGreetingSimple'
      WHEN k < 89 THEN 'TrainerBow' WHEN k < 92 THEN 'TrainerCheckpointUnhailed'
      WHEN k < 98 THEN CASE sub WHEN 0 THEN 'TrainerGreetingSimple' WHEN 1 THEN 'TrainerBow' ELSE 'TrainerCheckpointUnhailed' END
      WHEN k = 98 THEN CASE sub WHEN 0 THEN 'TrainerGreetingSimple' ELSE 'TrainerCheckpointUnhailed' END
      ELSE 'TrainerCheckpoint' END
    END AS kind
  FROM raw
), ln AS (
  SELECT *,
    CASE WHEN kind IN ('SoloKill', 'AssistedKill') THEN ['killed', 'slaughtered', 'vanquished', 'dispatched'][k % 4 + 1] END AS verb,
    CASE WHEN kind IN ('SoloKill', 'AssistedKill', 'Fallen') THEN part_creature
         WHEN kind IN ('LastyBeginStudy', 'LastyProgress', 'StudyProgress', 'StudyAbandon', 'LastyFinished') THEN beast END AS creature,
    CASE WHEN kind = 'Fallen' AND k >= 70 THEN 'Stranger' WHEN kind = 'Fallen' THEN same
         WHEN kind = 'Recovered' THEN 'Hero' || u
         WHEN kind = 'Login' AND k >= 15 THEN 'ALT' || u || '  II' WHEN kind IN ('Login', 'Reconnect') THEN 'Hero' || u
         WHEN kind = 'ApplyLearningRank' AND k >= 92 THEN 'Stranger' WHEN kind = 'ApplyLearningRank' THEN same
         WHEN kind = 'ProfessionAnnouncement' AND k = 99 THEN 'Stranger' WHEN kind = 'ProfessionAnnouncement' THEN 'Hero' || u
         WHEN kind = 'TrainerCheckpoint' AND k = 99 THEN 'Stranger'
         WHEN kind IN ('TrainerCheckpoint', 'TrainerGreetingSimple', 'TrainerGreetingWithUnknownCheckpoint') THEN same
         WHEN kind IN ('ChainUsed', 'ClanningChange') THEN 'Stranger' END AS subject,
    CASE WHEN kind = 'LootShare' THEN part_creature WHEN kind = 'OreFound' THEN ({text_list(ORES)})[k % 5 + 1]
         WHEN kind = 'FishCaught' AND k = 60 THEN 'Mimic' WHEN kind = 'FishCaught' THEN 'Shiny Trout ' || k END AS item,
    CASE WHEN kind = 'LootShare' THEN ['fur', 'blood', 'mandible'][k % 3 + 1] END AS loot_type,
    CASE WHEN kind IN ('TrainerRank', 'ApplyLearningRank', 'LastyCompleted') OR kind LIKE 'TrainerCheckpoint%' OR kind LIKE 'TrainerGreeting%'
              OR kind = 'TrainerBow' THEN tr END AS trainer,
    CASE WHEN kind IN ('LastyBeginStudy', 'LastyProgress', 'LastyFinished') THEN ty
         WHEN kind = 'ReflectListHeader' AND k = 69 THEN 'Movements' WHEN kind = 'ReflectListHeader' THEN ty END AS lasty_type,
    CASE WHEN kind = 'LootShare' AND k < 50 THEN half WHEN kind IN ('LootShare', 'StudyCharge', 'CoinsPickedUp', 'CoinBalance') THEN amt
         WHEN kind = 'Depart' THEN e % 50 END::BIGINT AS amount,
    CASE WHEN kind = 'LootShare' THEN amt END AS worth,
    CASE WHEN kind LIKE 'TrainerCheckpoint%' THEN pmin END AS rank_min,
    CASE WHEN kind LIKE 'TrainerCheckpoint%' THEN pmax END AS rank_max,
    CASE WHEN kind = 'KarmaReceived' THEN k IN (81, 83) WHEN kind = 'KarmaGiven' THEN k < 87
         WHEN kind = 'ApplyLearningRank' THEN k < 85 OR k >= 92 WHEN kind = 'ClanningChange' THEN k = 91 END AS flag,
    CASE WHEN kind = 'ProfessionAnnouncement' THEN CASE k WHEN 98 THEN 'Ranger' WHEN 99 THEN 'Healer' ELSE ({_PROF})[e % 7 + 1] END END AS profession,
    CASE WHEN kind = 'Login' AND k >= 15 THEN 'Alt' || u || ' II' WHEN kind IN ('Login', 'Reconnect') THEN 'Hero' || u END AS welcome
  FROM kinds
), folders AS (
  SELECT folder, coalesce(first(welcome ORDER BY path, line_no) FILTER (welcome IS NOT NULL), folder) AS folder_character
  FROM ln WHERE NOT loose GROUP BY folder
), every_line AS (
  SELECT ln.*, f.folder_character,
    coalesce(last_value(own_ts IGNORE NULLS) OVER w, file_ts) AS date,
    coalesce(last_value(welcome IGNORE NULLS) OVER w, f.folder_character) AS character
  FROM ln LEFT JOIN folders f ON f.folder = ln.folder AND NOT ln.loose
  WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), att AS (
  SELECT *, lower(subject) = lower(character) AS self, row_number() OVER (ORDER BY loose, folder, path, line_no) AS seq
  FROM every_line WHERE character IS NOT NULL
)
"""

# Rank events as gated by the adapter's overrides.
GATED_X = """
, ranks AS (
  SELECT *, CASE
      WHEN trainer = 'Atkus' AND hero % 4 = 0 THEN false
      WHEN trainer = 'Regia' AND hero % 3 = 0 THEN date[1:10] > CASE WHEN hero % 2 = 0 THEN '2024-01-15' ELSE '2024-01-10' END
      ELSE true END AS counted
  FROM (SELECT *, CASE WHEN character LIKE 'Hero%' THEN CAST(character[5:] AS BIGINT) ELSE 1 END AS hero FROM att
        WHERE kind = 'TrainerRank' OR (kind = 'ApplyLearningRank' AND self))
)
"""

# Definition of a confirmed bow sequence: for each known phrase spoken, find the latest greeting or phrase
# of the trainer before it in the file; it must be a greeting, and a bow must lie in between.
BOWS_X = """
, steps AS (
  SELECT *, kind IN ('TrainerGreetingSimple', 'TrainerGreetingWithUnknownCheckpoint') AND self AS greets
  FROM att WHERE kind IN ('TrainerBow', 'TrainerCheckpointUnhailed')
     OR (kind IN ('TrainerGreetingSimple', 'TrainerGreetingWithUnknownCheckpoint') AND self)
), bows AS (
  SELECT p.* FROM steps p WHERE p.kind = 'TrainerCheckpointUnhailed' AND EXISTS (
    SELECT 1 FROM steps g WHERE g.path = p.path AND g.trainer = p.trainer AND g.greets AND g.line_no < p.line_no
      AND NOT EXISTS (SELECT 1 FROM steps m WHERE m.path = p.path AND m.trainer = p.trainer AND m.line_no > g.line_no
                      AND m.line_no < p.line_no AND (m.greets OR m.kind = 'TrainerCheckpointUnhailed'))
      AND EXISTS (SELECT 1 FROM steps b WHERE b.path = p.path AND b.trainer = p.trainer AND b.kind = 'TrainerBow'
                  AND b.line_no > g.line_no AND b.line_no < p.line_no))
), cps AS (
  SELECT character, trainer, rank_min, rank_max, date, seq FROM att WHERE kind = 'TrainerCheckpoint' AND self
  UNION ALL SELECT character, trainer, rank_min, rank_max, date, seq FROM bows
)
"""

# A progress line does not count while the last begin, finish or abandon of its creature is an abandon.
STUDIED_X = """
, controls AS (SELECT character, creature, kind, seq FROM att WHERE kind IN ('StudyAbandon', 'LastyBeginStudy', 'LastyFinished'))
, studied AS (
  SELECT a.* FROM att a
  WHERE a.kind IN ('StudyProgress', 'StudyAbandon', 'LastyBeginStudy', 'LastyFinished') OR (a.kind = 'LastyProgress' AND coalesce(
    (SELECT c.kind FROM controls c WHERE c.character = a.character AND c.creature = a.creature AND c.seq < a.seq ORDER BY c.seq DESC LIMIT 1), '')
    <> 'StudyAbandon')
)
"""

# Reflect lists: only the two list shapes that close properly, and the in-progress exclusion for Movements.
REFLECT_X = """
, lists AS (
  SELECT path, line_no AS header, lasty_type, date, CASE WHEN k = 69 THEN line_no + 1 ELSE line_no + 2 END AS closing, k, beast, other, e
  FROM every_line WHERE kind = 'ReflectListHeader' AND k <> 68
), owned AS (
  SELECT l.*, a.character, a.seq FROM lists l JOIN att a ON a.path = l.path AND a.line_no = l.closing
  JOIN att h ON h.path = l.path AND h.line_no = l.header
), newest AS (
  SELECT * FROM owned WHERE date <> '' QUALIFY row_number() OVER (PARTITION BY character, lasty_type ORDER BY date DESC, seq) = 1
), named AS (
  SELECT character, lasty_type, date, path, closing, unnest(CASE WHEN k = 69 THEN [beast, other] ELSE [beast, other, 'Beast X' || (e % 3)] END) AS creature
  FROM newest
), reflected AS (
  SELECT character, lasty_type, creature, date FROM named n
  WHERE NOT (lasty_type = 'Movements' AND EXISTS (SELECT 1 FROM att s WHERE s.kind = 'StudyProgress' AND s.path = n.path
             AND s.creature = n.creature AND s.line_no < n.closing))
)
"""

GATED, BOWS, STUDIED, REFLECT = LOG + GATED_X, LOG + BOWS_X, LOG + STUDIED_X, LOG + REFLECT_X

# Studies: completions finish the newest unfinished row, walked line by line; the lists come last.
LOG_STUDIES = (LOG + STUDIED_X + REFLECT_X).replace("WITH ev", "WITH RECURSIVE ev", 1) + """
, ok AS (SELECT character, creature, coalesce(lasty_type, 'Movements') AS ty, kind, seq, date FROM studied)
, steps AS (
  SELECT character, kind, creature || '|' || ty AS row_key, row_number() OVER (PARTITION BY character ORDER BY seq) AS i
  FROM (SELECT character, kind, creature, ty, seq FROM ok WHERE kind <> 'StudyAbandon' UNION ALL SELECT character, kind, '', '', seq FROM att WHERE kind = 'LastyCompleted')
), walk AS (
  SELECT character, 0::BIGINT AS i, []::VARCHAR[] AS open, []::VARCHAR[] AS seen, []::VARCHAR[] AS popped FROM (SELECT DISTINCT character FROM steps)
  UNION ALL
  SELECT w.character, s.i,
    CASE WHEN s.kind = 'LastyCompleted' THEN w.open[:len(w.open) - 1]
         WHEN s.kind = 'LastyFinished' THEN list_filter(w.open, lambda x: x <> s.row_key)
         WHEN list_contains(w.seen, s.row_key) THEN w.open ELSE list_append(w.open, s.row_key) END,
    CASE WHEN s.kind = 'LastyCompleted' OR list_contains(w.seen, s.row_key) THEN w.seen ELSE list_append(w.seen, s.row_key) END,
    CASE WHEN s.kind = 'LastyCompleted' AND len(w.open) > 0 THEN list_append(w.popped, w.open[len(w.open)]) ELSE w.popped END
  FROM walk w JOIN steps s ON s.character = w.character AND s.i = w.i + 1
), pops AS (
  SELECT character, unnest(popped) AS row_key FROM (SELECT character, popped FROM walk QUALIFY row_number() OVER (PARTITION BY character ORDER BY i DESC) = 1)
), lastctl AS (
  SELECT character, creature, last(kind ORDER BY seq) AS kind, max(seq) AS seq, last(date ORDER BY seq) AS date FROM ok WHERE kind IN ('StudyAbandon', 'LastyBeginStudy') GROUP BY ALL
), la AS (
  SELECT r.character, r.creature, r.lasty_type, r.message_count, r.first_seen, r.last_seen,
    r.fin OR EXISTS (SELECT 1 FROM pops p WHERE p.character = r.character AND p.row_key = r.creature || '|' || r.lasty_type) AS finished, r.completed,
    CASE WHEN c.kind = 'StudyAbandon' AND r.since < c.seq THEN c.date END AS abandoned
  FROM (SELECT character, creature, ty AS lasty_type, CAST(count(*) AS BIGINT) AS message_count, first(date ORDER BY seq) AS first_seen, last(date ORDER BY seq) AS last_seen,
          bool_or(kind = 'LastyFinished') AS fin, last(date ORDER BY seq) FILTER (kind = 'LastyFinished') AS completed, min(seq) AS since
        FROM ok WHERE kind <> 'StudyAbandon' GROUP BY character, creature, ty) r LEFT JOIN lastctl c USING (character, creature)
), listed AS (SELECT character, creature, lasty_type, count(*) AS n, max(date) AS day FROM reflected GROUP BY ALL
), whole AS (
  SELECT character, creature, lasty_type, CAST(coalesce(message_count, 0) + coalesce(n, 0) AS BIGINT) AS message_count, coalesce(first_seen, day) AS first_seen,
    coalesce(day, last_seen) AS last_seen, n IS NOT NULL OR coalesce(finished, false) AS finished, coalesce(completed, day) AS completed, abandoned
  FROM la FULL JOIN listed USING (character, creature, lasty_type)
)
"""

_SOLO = ["killed", "slaughtered", "vanquished", "dispatched"]
_HELP = ["assisted_kill_count", "assisted_slaughter_count", "assisted_vanquish_count", "assisted_dispatch_count"]
COUNTERS = ", ".join([f"CAST(count(*) FILTER (kind = 'SoloKill' AND verb = '{v}') AS BIGINT) AS {v}_count" for v in _SOLO] + [
    f"CAST(count(*) FILTER (kind = 'AssistedKill' AND verb = '{v}') AS BIGINT) AS {c}" for v, c in zip(_SOLO, _HELP)])
IS_KILL = "kind IN ('SoloKill', 'AssistedKill')"
DATES = ", ".join([f"min(date) FILTER ({IS_KILL} AND verb = '{v}') AS date_first_{v}, max(date) FILTER ({IS_KILL} AND verb = '{v}') AS date_last_{v}"
                   for v in _SOLO])


MESSAGES_X = """, msgs AS (
        SELECT 'warn' AS level, 'No timestamps in log lines — used filename date: ' || string_split(path, '/')[-1] AS message, path AS file_path
          FROM ln GROUP BY path HAVING count(own_ts) = 0
        UNION ALL SELECT 'warn', 'Unrecognized trainer checkpoint from ' || trainer || ' in ' || string_split(path, '/')[-1] || ': "There is nothing I can teach you."', path
          FROM att WHERE kind = 'TrainerGreetingWithUnknownCheckpoint' AND self
        UNION ALL SELECT 'info', 'Skipped ' || count(*) || ' rank(s) for ' || trainer || ' — override active: ' || string_split(path, '/')[-1], path
          FROM ranks WHERE NOT counted GROUP BY path, trainer
        UNION ALL SELECT 'warn', 'skipped: could not determine character (' || path || ')', path FROM ln WHERE loose GROUP BY path HAVING count(welcome) = 0)
"""

LOOT_X = f"""
, first_kill AS (SELECT character, creature, min(seq) AS since FROM att WHERE {IS_KILL} OR (kind = 'Fallen' AND self) GROUP BY ALL)
, bl AS (
  SELECT a.character, a.item AS creature, a.amount AS best_loot_value,
         a.item || ' ' || CASE loot_type WHEN 'mandible' THEN 'mandibles' ELSE loot_type END AS best_loot_item
  FROM att a JOIN first_kill f ON f.character = a.character AND f.creature = a.item AND a.seq > f.since
  WHERE a.kind = 'LootShare' AND a.amount > 0
  QUALIFY row_number() OVER (PARTITION BY a.character, a.item ORDER BY a.amount DESC, a.seq) = 1
)
"""


def counter_sql() -> str:
    """The plain counters, written out as conditions on the expected events."""
    n = lambda cond: f"CAST(count(*) FILTER ({cond}) AS BIGINT)"
    s = lambda what, cond: f"CAST(coalesce(sum({what}) FILTER ({cond}), 0) AS BIGINT)"
    loot = lambda t: f"kind = 'LootShare' AND loot_type = '{t}'"
    cols = {
        "deaths": n("kind = 'Fallen' AND self"), "esteem": n("kind = 'EsteemGain'"),
        "coins_picked_up": s("amount", "kind = 'CoinsPickedUp'"),
        "fur_coins": s("amount", loot("fur")), "fur_worth": s("worth", loot("fur")), "blood_coins": s("amount", loot("blood")),
        "blood_worth": s("worth", loot("blood")), "mandible_coins": s("amount", loot("mandible")),
        "mandible_worth": s("worth", loot("mandible")), "bounty_coins": "CAST(0 AS BIGINT)",
        "chest_coins": s("amount", "kind = 'StudyCharge'"), "bells_used": n("kind = 'BellUsed'"), "bells_broken": n("kind = 'BellBroken'"),
        "chains_used": n("kind = 'ChainUsed'"), "chains_broken": n("kind IN ('ChainBreak', 'ChainShatter', 'ChainSnap')"),
        "shieldstones_used": n("kind = 'ShieldstoneUsed'"), "shieldstones_broken": n("kind = 'ShieldstoneBroken'"),
        "ethereal_portals": n("kind IN ('EtherealPortalOpened', 'EtherealPortalStoneUsed')"),
        "eps_broken": n("kind = 'EtherealPortalStoneUsed'"), "ore_found": n("kind = 'OreFound'"),
        **{f"{o}_ore_found": n(f"kind = 'OreFound' AND item = '{o}'") for o in ("iron", "copper", "tin", "gold")},
        "wood_taken": n("kind = 'WoodTaken'"), "wood_useless": n("kind = 'WoodUseless'"), "fishing_attempts": n("kind = 'FishingMiss'"),
        "mimics_caught": n("kind = 'FishCaught' AND item = 'Mimic'"),
        "good_karma": n("kind = 'KarmaReceived' AND flag"), "bad_karma": n("kind = 'KarmaReceived' AND NOT flag"),
        "gave_good_karma": n("kind = 'KarmaGiven' AND flag"), "gave_bad_karma": n("kind = 'KarmaGiven' AND NOT flag"),
        "untraining_count": n("kind = 'Untrained'"),
    }
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


FIELDS = "creature, verb, subject, item, trainer, lasty_type, loot_type, amount, worth, rank_min, rank_max, flag"

ORACLES = {
    "filename_date": LOG + "SELECT DISTINCT path, file_ts FROM ln",
    "line_timestamp": LOG + "SELECT path, line_no, own_ts AS ts FROM ln",
    "ts_fallback": LOG + "SELECT path, line_no, date FROM every_line",
    "classify_lines": LOG + f"SELECT path, line_no, kind, {FIELDS}, profession FROM ln",
    "active_character": LOG + "SELECT path, line_no, character FROM att",
    "folder_character": LOG + "SELECT folder, folder_character FROM folders",
    "undetermined_files": LOG + "SELECT path FROM ln WHERE loose GROUP BY path HAVING count(welcome) = 0",
    "logins": LOG + """SELECT character, CAST(count(*) AS BIGINT) AS logins FROM (
        SELECT character FROM att WHERE kind = 'Login'
        UNION ALL SELECT folder_character FROM att WHERE NOT loose GROUP BY path, folder_character HAVING count(*) FILTER (kind = 'Login') = 0)
        GROUP BY character""",
    "start_date": LOG + """SELECT character, min(date) AS start_date FROM (
        SELECT character, date FROM att WHERE kind IN ('Login', 'Reconnect')
        UNION ALL SELECT folder_character, first(date ORDER BY line_no) FROM att WHERE NOT loose GROUP BY path, folder_character
                  HAVING count(*) FILTER (kind IN ('Login', 'Reconnect')) = 0) GROUP BY character""",
    "deaths": LOG + "SELECT character, CAST(count(*) AS BIGINT) AS deaths FROM att WHERE kind = 'Fallen' AND self GROUP BY character",
    "rank_gate": GATED + "SELECT path, line_no, character, trainer, counted FROM ranks",
    "rank_skips": GATED + "SELECT path, trainer, CAST(count(*) AS BIGINT) AS skipped FROM ranks WHERE NOT counted GROUP BY ALL",
    "bow_checkpoint": BOWS + "SELECT character, trainer, rank_min, rank_max, date, path, line_no FROM bows",
    "checkpoint_all": BOWS + "SELECT character, trainer, rank_min, rank_max, date FROM cps",
    "checkpoint_latest": BOWS + """SELECT character, trainer, rank_min, rank_max, date FROM cps
        QUALIFY row_number() OVER (PARTITION BY character, trainer ORDER BY date DESC, seq DESC) = 1""",
    "top_checkpoints": BOWS + """SELECT * FROM (SELECT character, trainer, max(rank_min) AS rank_min FROM cps GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY character ORDER BY rank_min DESC, trainer) <= 10""",
    "reflect_lists": REFLECT + "SELECT character, lasty_type, creature, date FROM reflected",
    "study_gate": STUDIED + "SELECT path, line_no, character, creature, kind FROM studied",
    "departs": LOG + """, d AS (SELECT * FROM att WHERE kind IN ('Depart', 'FirstDepart'))
        SELECT character, CAST(coalesce(max(amount) FILTER (seq = s), 0) + count(*) FILTER (kind = 'FirstDepart' AND seq > coalesce(s, -1)) AS BIGINT) AS departs
        FROM (SELECT d.*, (SELECT max(x.seq) FROM d x WHERE x.character = d.character AND x.kind = 'Depart') AS s FROM d) GROUP BY character""",
    "best_loot": LOG + LOOT_X + "SELECT * FROM bl",
    "kills_rollup": LOG + LOOT_X + f"""SELECT a.character, a.creature, {COUNTERS}, CAST(count(*) FILTER (kind = 'Fallen') AS BIGINT) AS killed_by_count,
        first(date ORDER BY seq) FILTER ({IS_KILL}) AS date_first, max(date) FILTER ({IS_KILL}) AS date_last, {DATES},
        CAST(coalesce(any_value(p.p_size), 0) AS BIGINT) AS creature_value, coalesce(any_value(bl.best_loot_value), 0) AS best_loot_value,
        coalesce(any_value(bl.best_loot_item), '') AS best_loot_item
        FROM att a LEFT JOIN part p ON p.p_name || ' ' || p.p_partkey = a.creature LEFT JOIN bl ON bl.character = a.character AND bl.creature = a.creature
        WHERE {IS_KILL} OR (kind = 'Fallen' AND self) GROUP BY ALL""",
    "kill_hourly": LOG + f"SELECT character, creature, date[1:13] AS hour, {COUNTERS} FROM att WHERE {IS_KILL} GROUP BY ALL",
    "character_counters": LOG + f"SELECT character, {counter_sql()} FROM att GROUP BY character",
    "fishing_catches": LOG + """SELECT character, string_agg(item || ':' || n, ' ' ORDER BY item) AS catches FROM (
        SELECT character, item, count(*) AS n FROM att WHERE kind = 'FishCaught' GROUP BY ALL) GROUP BY character""",
    "trainer_ranks": GATED + """SELECT character, trainer, CAST(count(*) FILTER (kind = 'TrainerRank') AS BIGINT) AS ranks,
        CAST(10 * count(*) FILTER (kind = 'ApplyLearningRank' AND flag) AS BIGINT) AS apply_learning_ranks,
        CAST(count(*) FILTER (kind = 'ApplyLearningRank' AND NOT flag) AS BIGINT) AS apply_learning_unknown_count,
        last(date ORDER BY seq) AS date_of_last_rank,
        CASE trainer WHEN 'Evus' THEN 1.1436 WHEN 'Swengus' THEN 1.0549 WHEN 'Gossamer' THEN 0.5 ELSE 1.0 END::DOUBLE AS effective_multiplier
        FROM ranks WHERE counted GROUP BY character, trainer""",
    "announced_profession": LOG + """SELECT character, last(profession ORDER BY seq) AS announced FROM att
        WHERE kind = 'ProfessionAnnouncement' AND self GROUP BY character""",
    "log_lastys": LOG_STUDIES + "SELECT * FROM whole",
    "updated_studies": LOG_STUDIES + "SELECT * FROM la",
    "scan_report": LOG + GATED_X + BOWS_X + STUDIED_X + """
        SELECT (SELECT count(DISTINCT character) FROM att) AS characters,
          (SELECT count(DISTINCT path) FROM att) AS files_scanned,
          (SELECT count(DISTINCT path) FROM ln) - (SELECT count(DISTINCT path) FROM att) AS files_skipped,
          (SELECT count(*) FROM ln WHERE path IN (SELECT path FROM att)) AS lines_parsed,
          (SELECT count(*) FROM att WHERE kind NOT IN ('Ignored', 'CoinBalance', 'ExperienceGain', 'ClanningChange', 'Disconnect', 'Recovered',
             'ReflectListHeader', 'TrainerGreetingSimple', 'TrainerGreetingWithUnknownCheckpoint', 'TrainerBow', 'TrainerCheckpointUnhailed',
             'TrainerRank', 'ApplyLearningRank', 'LastyProgress') AND (kind NOT IN ('Fallen', 'TrainerCheckpoint') OR self))
          + (SELECT count(*) FROM ranks WHERE counted) + (SELECT count(*) FROM bows)
          + (SELECT count(*) FROM studied WHERE kind = 'LastyProgress') AS events_found""",
    "process_log": LOG + GATED_X + MESSAGES_X + "SELECT level, message, file_path, (SELECT count(*) FROM msgs x WHERE x.level = msgs.level) AS of_level FROM msgs",
    "process_log_page": LOG + GATED_X + MESSAGES_X + """SELECT f.file_ts AS logged_at, message FROM msgs JOIN (SELECT DISTINCT path, file_ts FROM ln) f ON f.path = msgs.file_path
        WHERE level = 'warn' ORDER BY logged_at DESC, message DESC LIMIT 50""",
}
ORACLES |= {updated: ORACLES[scanned] for updated, scanned in {
    "updated_kills": "kills_rollup", "updated_hours": "kill_hourly", "updated_ranks": "trainer_ranks", "updated_counters": "character_counters", "updated_fishing": "fishing_catches",
    "updated_loot": "best_loot", "updated_departs": "departs", "updated_checkpoints": "checkpoint_all", "updated_professions": "announced_profession",
    "stream_ranks": "rank_gate", "stream_bows": "bow_checkpoint", "stream_study_gate": "study_gate"}.items()}
