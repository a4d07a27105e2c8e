"""The line grammar: ordered rules as data, compiled to column expressions.

A message becomes exactly one event; the first matching rule wins. Classification runs in two steps
so that each line pays for as few regular expressions as possible:

1. `rule` (an INT): guarded `rlike` tests in order. A guard is a cheap necessary condition (prefix or
   substring), so it never changes which rule wins; it only spares the expression.
2. the event fields: `regexp_extract` with the pattern of the winning rule only.

The tests are spread over several projections so that each generated method stays small enough for the
JIT compiler.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.functions.catalogs import CHECKPOINT_PHRASES

EVENT_FIELDS = {
    "subject": "string", "creature": "string", "verb": "string", "item": "string", "trainer": "string",
    "lasty_type": "string", "loot_type": "string", "text": "string", "amount": "bigint", "worth": "bigint",
    "rank_min": "bigint", "rank_max": "bigint", "flag": "boolean",
}

VERBS = ["killed", "slaughtered", "vanquished", "dispatched"]

# Verb stems of assisted kills, kinds of study, kinds of loot.
STEM_TO_VERB = {"kill": "killed", "slaughter": "slaughtered", "vanquish": "vanquished", "dispatch": "dispatched"}
STUDY_KINDS = {"ways": "Befriend", "movements": "Movements", "essence": "Morph"}
LOOT_KINDS = {"fur": "fur", "blood": "blood", "mandible": "mandible", "mandibles": "mandible"}


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str | None = None
    captures: dict[str, int] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)
    starts: str | None = None
    has: str | None = None


# The message patterns of the game, in the order in which they are tried.
SPOKEN = [
    Rule("KarmaReceived", r"^You (?:just )?received (?:anonymous )?(good|bad) karma", {"flag": 1}, starts="You "),
    Rule("KarmaGiven", r"^You gave (?:anonymous |signed )?(good|bad) karma to .+\.$", {"flag": 1}, starts="You gave "),
    Rule("ApplyLearningRank",
         r"Congratulations, (.+?)\. [Yy]ou should now understand much more of (.+?)['’]s teachings",
         {"subject": 1, "trainer": 2}, {"flag": True}, has="Congratulations, "),
    Rule("ApplyLearningRank",
         r"Congratulations, (.+?)\. [Yy]ou should now understand more of (.+?)['’]s teachings",
         {"subject": 1, "trainer": 2}, {"flag": False}, has="Congratulations, "),
    Rule("ProfessionAnnouncement",
         r'(?:thinks|says), "Congratulations go out to (.+), who has just passed the \w+ circle (\w+) test\.',
         {"subject": 1, "text": 2}, has="Congratulations go out to "),
    Rule("ProfessionAnnouncement",
         r'(?:thinks|says), "Congratulations to (.+), who has just become an? (\w+)\.',
         {"subject": 1, "text": 2}, has="Congratulations to "),
    Rule("Untrained", r'^Untrainus says, ".+, your mind is less cluttered now\."$', starts="Untrainus"),
]
GREETING = r'^(.+?) says(?:\s+in\s+\S+)?, "Hail, ([^."]+)\.\s+(.+)"$'
GREETING_SIMPLE = r'^(.+?) says(?:\s+in\s+\S+)?, "Hail, ([^."]+)\."$'
BOW = r"^(.+?) bows(?: deeply)?\.?$"
NPC_SPEECH = r'^(.+?) says(?:\s+in\s+\S+)?, "(.+)"$'
SYSTEM = [
    Rule("StudyCharge", r"^You have been charged (\d+) coins? for advanced studies\.$", {"amount": 1}),
    Rule("StudyProgress",
         r"^You are (?:currently studying|remembering your studies of) (?:the|an?) (.+), and have (.+) left to learn\.$",
         {"creature": 1, "text": 2}),
    Rule("StudyAbandon", r"^You abandon your study of (?:the|an?) (.+)\.$", {"creature": 1}),
    Rule("LastyBeginStudy", r"^You begin studying the (movements|ways|essence) of (?:the|an?) (.+)\.$",
         {"lasty_type": 1, "creature": 2}),
    Rule("LastyProgress", r"^You have .+ (?:left )?to learn about the (movements|ways|essence) of (?:the|an?) (.+)\.$",
         {"lasty_type": 1, "creature": 2}),
    Rule("LastyFinished", r"^You learn to befriend (?:the|an?) (.+)\.$", {"creature": 1}, {"lasty_type": "Befriend"}),
    Rule("LastyFinished", r"^You learn to assume the form of (?:the|an?) (.+)\.$", {"creature": 1}, {"lasty_type": "Morph"}),
    Rule("LastyFinished", r"^You learn to fight (?:the|an?) (.+) more effectively\.$", {"creature": 1},
         {"lasty_type": "Movements"}),
    Rule("LastyCompleted", r"^You have completed your training with (.+)\.$", {"trainer": 1}),
    Rule("ReflectListHeader", r"^You have studied the following creatures:$", {}, {"lasty_type": "Movements"}),
    Rule("ReflectListHeader", r"^You have learned to befriend the following creatures:$", {}, {"lasty_type": "Befriend"}),
    Rule("ReflectListHeader", r"^You have learned to assume the shape of the following creatures:$", {},
         {"lasty_type": "Morph"}),
    Rule("Ignored", r"^You sense healing energy from .+\.$"),
    Rule("Ignored", r"^The Sun (rises|sets)\.$"),
    Rule("Ignored", r"^You gain experience from your"),
    Rule("Ignored", r"^You can study up to \d+ creatures? concurrently\.$"),
]
CHATTER = [
    Rule("Ignored", r'^.+ (says|exclaims|yells|ponders|thinks|asks), "', has=', "'),
    Rule("Ignored", r"^\(.+ .+\)$", starts="("),
]
LIFE = [
    Rule("Login", r"^Welcome to Clan Lord, (.+)!$", {"subject": 1}, starts="Welcome "),
    Rule("Reconnect", r"^Welcome back, (.+)!$", {"subject": 1}, starts="Welcome "),
    Rule("SoloKill", r"^You (killed|slaughtered|vanquished|dispatched) ((?:an?|the) .+)\.$",
         {"verb": 1, "creature": 2}, starts="You "),
    Rule("AssistedKill", r"^You helped (kill|slaughter|vanquish|dispatch) ((?:an?|the) .+)\.$",
         {"verb": 1, "creature": 2}, starts="You helped "),
    Rule("Fallen", r"^(.+) has fallen to (?:an? )?(.+)\.$", {"subject": 1, "creature": 2}, has=" has fallen to "),
    Rule("Recovered", r"^(.+) is no longer fallen\.$", {"subject": 1}, has=" is no longer fallen"),
    Rule("FirstDepart", r"^This is the first time your spirit has departed your body\.$", starts="This is "),
    Rule("Depart", r"^Your spirit has departed your body (\d+) times?\.$", {"amount": 1}, starts="Your spirit"),
    Rule("CoinsPickedUp", r"^\* You pick up (\d+) coins?\.$", {"amount": 1}, starts="* You pick"),
    Rule("CoinBalance", r"^You have (\d+) coins?\.$", {"amount": 1}, starts="You have "),
    Rule("LootShare",
         r"^\* (?:.+) recovers? the (.+) (fur|blood|mandibles?), worth (\d+)c\. Your share is (\d+)c\.$",
         {"item": 1, "loot_type": 2, "worth": 3, "amount": 4}, starts="* "),
    Rule("LootShare", r"^\* You recover the (.+) (fur|blood|mandibles?), worth (\d+)c\.$",
         {"item": 1, "loot_type": 2, "worth": 3, "amount": 3}, starts="* You recover"),
]
THINGS = [
    Rule("BellBroken", r"^\* Your bell crumbles to dust\.$", starts="* Your bell"),
    Rule("BellUsed", r"^\* The bell rings soundlessly into the void, summoning", starts="* The bell"),
    Rule("ChainBreak", r"^Your chain breaks as you try to use it\.$", starts="Your chain"),
    Rule("ChainShatter", r"^A link in your chain shatters\.$", starts="A link"),
    Rule("ChainSnap", r"^Your chain snaps as you try to use it\.$", starts="Your chain"),
    Rule("ChainUsed", r"^You start dragging (.+)\.$", {"subject": 1}, starts="You start"),
    Rule("ShieldstoneUsed", r"^\* You activate your shieldstone\.$", starts="* You activate"),
    Rule("ShieldstoneBroken", r"^Your Shieldstone goes inert\.$", starts="Your Shieldstone"),
    Rule("EtherealPortalOpened", r"^You open an ethereal portal\.$", starts="You open"),
    Rule("EtherealPortalStoneUsed", r"^Your ethereal portal stone disappears into the ether\.$", starts="Your ethereal"),
    Rule("OreFound", r"^You found a lump of (.+) ore!$", {"item": 1}, starts="You found"),
    Rule("WoodTaken", r"^You take the wood\.$", starts="You take"),
    Rule("WoodUseless", r"^You find that the wood is useless\.$", starts="You find"),
    Rule("FishingMiss", r"^You feel a tug on your line, but the fish slips free\.$", starts="You feel"),
    Rule("FishingMiss", r"^You reel in an empty hook\.$", starts="You reel"),
    Rule("FishCaught", None, {}, {"item": "Mimic"}, starts="You reel in a friendly mimic"),
    Rule("FishCaught", r"^You reel in (?:a |an )?(.+?)[\.\!]*$", {"item": 1}, starts="You reel in "),
    Rule("EsteemGain", r"^\* You gain (?:experience and )?esteem\.$", starts="* You gain"),
    Rule("ExperienceGain", r"^\* You (grow more mindful|gain experience|gain morale)", starts="* You g"),
    Rule("ClanningChange", r"^(.+) is now Clanning\.$", {"subject": 1}, {"flag": True}, has=" is now Clanning"),
    Rule("ClanningChange", r"^(.+) is no longer Clanning\.$", {"subject": 1}, {"flag": False}, has=" is no longer Clanning"),
    Rule("Disconnect", r"^\*\*\* We are no longer connected to the Clan Lord game server\. \*\*\*$", starts="*** We"),
]
WELCOME_LOGIN = LIFE[0].pattern
WELCOME_BACK = LIFE[1].pattern

# Rule numbers of the steps that look a phrase up rather than match a pattern alone.
CHECKPOINT, UNKNOWN_CHECKPOINT, GREETED, BOWED, UNHAILED, SYSTEM_OTHER, NOTHING = 900, 901, 902, 903, 904, 950, 999


def java(pattern: str) -> str:
    """Flags under which Java reads a pattern as the reference grammar means it: '.' stops at LF only,
    classes are Unicode, '$' is the end of the text."""
    if pattern.endswith("$") and not pattern.endswith(r"\$"):
        pattern = pattern[:-1] + r"\z"
    return "(?dU)" + pattern


def sql(text: str) -> str:
    """A SQL string literal. Long chains are built as one SQL text: one call instead of hundreds."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _test(rule: Rule, text: str) -> str:
    parts = []
    if rule.starts:
        parts.append(f"startswith({text}, {sql(rule.starts)})")
    if rule.has:
        parts.append(f"contains({text}, {sql(rule.has)})")
    if rule.pattern:
        parts.append(f"{text} RLIKE {sql(java(rule.pattern))}")
    return " AND ".join(parts)


def _first(rules: list[Rule], base: int, text: str) -> Column:
    whens = " ".join(f"WHEN {_test(r, text)} THEN {base + i}" for i, r in enumerate(rules))
    return F.expr(f"CASE {whens} END")


def phrase_table(phrases: dict[str, tuple[int, int | None]], which: int) -> Column:
    pairs = []
    for text, bounds in phrases.items():
        pairs += [F.lit(text), F.lit(bounds[which]).cast("bigint")]
    return F.create_map(*pairs)


GROUPS = {"spoken": (SPOKEN, 100), "system": (SYSTEM, 200), "chatter": (CHATTER, 300), "life": (LIFE, 400), "things": (THINGS, 500)}


def classify(df: DataFrame, message: str = "message", trainer_messages: DataFrame | None = None,
             phrases: dict[str, tuple[int, int | None]] = CHECKPOINT_PHRASES) -> DataFrame:
    """Add `kind` and the event fields to every row of `df`.

    `trainer_messages(message, trainer)` is the catalogue of rank messages; without it no line is a rank.
    """
    keep = df.columns
    known = list(phrases)
    m, body = F.col("_m"), F.col("_body")
    out = df.withColumn("_m", S.ltrim_all(message))
    out = out.withColumn("_sys", m.startswith("¥") | m.startswith("•"))
    out = out.withColumn("_body", F.when(F.col("_sys"), S.trim_all(F.substring(m, 2, 1_000_000_000))))
    out = out.withColumn("_r1", F.when(m == "", F.lit(NOTHING)).otherwise(_first(SPOKEN, 100, "_m")))

    greet_phrase = F.regexp_extract(m, java(GREETING), 3)
    first_sentence = F.concat(F.substring_index(greet_phrase, ". ", 1), F.lit("."))
    out = out.withColumn("_phrase", F.when(
        F.col("_r1").isNull() & m.contains('"Hail, ') & m.rlike(java(GREETING)),
        F.when(greet_phrase.isin(known), greet_phrase)
        .when(greet_phrase.contains(". ") & first_sentence.isin(known), first_sentence).otherwise(F.concat(F.lit("?"), greet_phrase))
    ))
    spoken = F.regexp_extract(m, java(NPC_SPEECH), 2)
    out = out.withColumn("_r2", F.coalesce(
        F.col("_r1"),
        F.when(F.col("_phrase").startswith("?"), UNKNOWN_CHECKPOINT).when(F.col("_phrase").isNotNull(), CHECKPOINT),
        F.when(m.contains('"Hail, ') & m.rlike(java(GREETING_SIMPLE)), GREETED)
        .when(m.contains(" bows") & m.rlike(java(BOW)), BOWED)
        .when(m.contains(" says") & m.rlike(java(NPC_SPEECH)) & spoken.isin(known), UNHAILED),
    ))
    out = out.withColumn("_r3", F.coalesce(
        F.col("_r2"), F.when(F.col("_sys"), F.coalesce(_first(SYSTEM, 200, "_body"), F.lit(SYSTEM_OTHER))),
        _first(CHATTER, 300, "_m")))
    out = out.withColumn("_r4", F.coalesce(F.col("_r3"), _first(LIFE, 400, "_m")))
    out = out.withColumn("_rule", F.coalesce(F.col("_r4"), _first(THINGS, 500, "_m"), F.lit(NOTHING)))
    out = _trainer_of_message(out, trainer_messages)
    rule = F.col("_rule")

    def capture(column: str) -> Column:
        whens = []
        for name, (rules, base) in GROUPS.items():
            text = "_body" if name == "system" else "_m"
            for i, r in enumerate(rules):
                if column in r.captures:
                    value = f"regexp_extract({text}, {sql(java(r.pattern))}, {r.captures[column]})"
                elif column in r.constants and not isinstance(r.constants[column], bool):
                    value = sql(r.constants[column])
                else:
                    continue
                whens.append(f"WHEN {base + i} THEN {value}")
        return F.expr(f"CASE _rule {' '.join(whens)} END") if whens else F.lit(None).cast("string")

    greeted = rule.isin(CHECKPOINT, UNKNOWN_CHECKPOINT)
    fields = {c: capture(c) for c in EVENT_FIELDS if c not in ("rank_min", "rank_max", "flag")}
    fields["subject"] = F.when(greeted, F.regexp_extract(m, java(GREETING), 2)).when(
        rule == GREETED, F.regexp_extract(m, java(GREETING_SIMPLE), 2)).otherwise(fields["subject"])
    fields["trainer"] = (
        F.when(greeted, F.regexp_extract(m, java(GREETING), 1))
        .when(rule == GREETED, F.regexp_extract(m, java(GREETING_SIMPLE), 1))
        .when(rule == BOWED, F.regexp_extract(m, java(BOW), 1))
        .when(rule == UNHAILED, F.regexp_extract(m, java(NPC_SPEECH), 1))
        .when(rule == SYSTEM_OTHER, F.col("_trainer")).otherwise(fields["trainer"])
    )
    creature, verb = fields["creature"], fields["verb"]
    kills = [400 + i for i, r in enumerate(LIFE) if r.kind.endswith("Kill")]
    fields["creature"] = F.when(rule.isin(kills), S.strip_article(creature)).otherwise(creature)
    fields["verb"] = _recode(verb, STEM_TO_VERB)
    fields["lasty_type"] = _recode(fields["lasty_type"], STUDY_KINDS)
    fields["loot_type"] = _recode(fields["loot_type"], LOOT_KINDS)
    announced = [100 + i for i, r in enumerate(SPOKEN) if r.kind == "ProfessionAnnouncement"]
    fields["text"] = (
        F.when(rule.isin(announced), S.normalise_profession(fields["text"]))
        .when(rule == UNKNOWN_CHECKPOINT, F.substring("_phrase", 2, 120))
        .when(rule == SYSTEM_OTHER, F.when(F.col("_trainer").isNotNull(), body)).otherwise(fields["text"])
    )
    ore = [500 + i for i, r in enumerate(THINGS) if r.kind == "OreFound"]
    fish = [500 + i for i, r in enumerate(THINGS) if r.kind == "FishCaught" and r.pattern]
    item = fields["item"]
    fields["item"] = F.when(rule.isin(ore), F.lower(item)).when(
        rule.isin(fish), S.titlecase_words(S.trim_all(item))).otherwise(item)
    number_kinds = [base + i for rules, base in GROUPS.values() for i, r in enumerate(rules) if "amount" in r.captures]
    for c in ("amount", "worth"):
        has = F.when(rule.isin(number_kinds if c == "amount" else
                               [400 + i for i, r in enumerate(LIFE) if "worth" in r.captures]),
                     F.coalesce(fields[c].try_cast("bigint"), F.lit(0).cast("bigint")))
        fields[c] = has
    phrase = F.when(rule == UNHAILED, spoken).when(rule == CHECKPOINT, F.col("_phrase"))
    fields["rank_min"] = phrase_table(phrases, 0)[phrase]
    fields["rank_max"] = phrase_table(phrases, 1)[phrase]
    flags = []
    for rules, base in GROUPS.values():
        for i, r in enumerate(rules):
            if "flag" in r.constants:
                flags.append(f"WHEN {base + i} THEN {str(r.constants['flag']).lower()}")
            elif "flag" in r.captures:
                flags.append(f"WHEN {base + i} THEN regexp_extract(_m, {sql(java(r.pattern))}, {r.captures['flag']}) = 'good'")
    fields["flag"] = F.expr(f"CASE _rule {' '.join(flags)} END")

    by_kind: dict[str, list[int]] = {}
    for rules, base in GROUPS.values():
        for i, r in enumerate(rules):
            if r.kind != "Ignored":
                by_kind.setdefault(r.kind, []).append(base + i)
    by_kind |= {"TrainerCheckpoint": [CHECKPOINT], "TrainerGreetingWithUnknownCheckpoint": [UNKNOWN_CHECKPOINT],
                "TrainerGreetingSimple": [GREETED], "TrainerBow": [BOWED], "TrainerCheckpointUnhailed": [UNHAILED]}
    kind = F.when((rule == SYSTEM_OTHER) & F.col("_trainer").isNotNull(), F.lit("TrainerRank"))
    for name, ids in by_kind.items():
        kind = kind.when(rule.isin(ids), F.lit(name))
    return out.select(*keep, kind.otherwise(F.lit("Ignored")).alias("kind"),
                      *[fields[c].cast(t).alias(c) for c, t in EVENT_FIELDS.items()])


def _recode(c: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(c)


def message_key(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\z", "")


def _trainer_of_message(df: DataFrame, trainer_messages: DataFrame | None) -> DataFrame:
    """Exact catalogue text first, else the text with one final period added or removed.

    A left join with the catalogue, one row per text without its final period; lines that need no lookup never match.
    """
    if trainer_messages is None:
        return df.withColumn("_trainer", F.lit(None).cast("string"))
    body = F.col("_body")
    shorter, longer = F.expr("substring(_body, 1, length(_body) - 1)"), F.concat(body, F.lit("."))
    wanted = F.col("_rule") == SYSTEM_OTHER
    entries = trainer_messages.groupBy(F.col("message").alias("_cat")).agg(F.max("trainer").alias("_name"))
    # lines that need no lookup get scattered keys, so that they do not all meet in the partition of the NULL key
    scatter = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("_m"), F.lit(4096)).cast("string"))
    catalogue = entries.groupBy(message_key(F.col("_cat")).alias("_key")).agg(
        F.map_from_entries(F.collect_set(F.struct("_cat", "_name"))).alias("_variants"))  # at most two per key
    variants = F.col("_variants")
    found = F.coalesce(variants[body], F.when(body.endswith("."), variants[shorter]).otherwise(variants[longer]))
    return (df.withColumn("_key", F.coalesce(F.when(wanted, message_key(body)), scatter)).join(catalogue, "_key", "left")
            .withColumn("_trainer", F.when(wanted, found)))
