"""The driver's tables seen as game data.

`render_log` really writes log text (file names, timestamps in three shapes, every message of the
grammar) from `events`; the other adapters shape `lineitem`, `orders`, `part`, `events` and
`documents` as kills, ranks, a bestiary, studies and files.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questlog.functions import catalogs
from questlog.functions.grammar import EVENT_FIELDS, classify
from questlog.operators.attribution import attribute
from questlog.operators.scan import line_block, path_head
from questlog.session import materialise
from questlog.sources.logs import parse_lines

PHRASES = list(catalogs.CHECKPOINT_PHRASES)
PROFESSIONS = ["fighter", "HEALER", "Mystic", "ranger", "Bloodmage", "champion", "bard"]
ORES = ["iron", "copper", "tin", "gold", "mithril"]

# Trainers that appear in the adapters: (name, profession, multiplier, combo components).
TRAINERS: list[tuple[str, str | None, float, list[str]]] = [
    ("Atkus", "Fighter", 1.0, ["Aktur", "Balthus", "Regia"]),
    ("Darkus", "Fighter", 1.0, []), ("Balthus", "Fighter", 1.0, []), ("Regia", "Fighter", 1.0, []),
    ("Evus", "Fighter", 1.1436, ["Aktur", "Histia"]), ("Swengus", "Fighter", 1.0549, ["Balthus", "Regia"]),
    ("Histia", "Fighter", 1.0, []), ("Detha", "Fighter", 1.0, []), ("Troilus", "Fighter", 1.0, []),
    ("Gossamer", "Ranger", 0.5, []), ("Duvin Beastlore", "Ranger", 1.0, []), ("Gossamer Decay", "Ranger", 1.0, []),
    ("Bodrus", "Fighter", 1.0, []), ("Hardia", "Fighter", 1.0, []), ("Spiritus", "Fighter", 1.0, []),
    ("Aktur", "Fighter", 1.0, []), ("Atkia", "Fighter", 1.0, []), ("Darktur", "Fighter", 1.0, []),
    ("Angilsa", "Fighter", 0.85, []), ("Knox", "Fighter", 1.0, []), ("Heen", "Fighter", 1.0, []),
    ("Bangus Anmash", "Fighter", 1.2, []), ("Farly Buff", "Fighter", 1.0, []), ("Stedfustus", "Fighter", 1.0, []),
    ("Forvyola", "Fighter", 1.0, []), ("Anemia", "Fighter", 1.0, []), ("Rodnus", "Fighter", 1.0, []),
    ("Erthron", "Fighter", 1.0, []), ("Bloodblade", "Bloodmage", 1.0, []), ("Bloodblade Decay", "Bloodmage", 1.0, []),
    ("Champion Blade", "Champion", 1.0, []), ("Champion Blade Decay", "Champion", 1.0, []),
    ("Faustus", "Healer", 1.0, []), ("Sespus", "Mystic", 1.0, []), ("Dwarven", "Language", 1.0, []),
    ("Nobody", None, 1.0, []),
]
TRAINER_NAMES = [t[0] for t in TRAINERS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` in tasks of about ROWS_PER_TASK rows: a file of few row groups is few tasks, however long each row's work is. The number is given, as adaptive execution
    would put small rows together again."""
    return df.repartition(max(1, -(-df.count() // ROWS_PER_TASK)), key)


def pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


@cache  # the plan, not the data
def trainer_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, p, m, c) for n, p, m, c in TRAINERS],
        "trainer string, profession string, multiplier double, combo_components array<string>")


@cache  # the plan, not the data
def trainer_messages(spark: SparkSession) -> DataFrame:
    rows = [(f"You feel the lessons of {n}" + ("." if i % 2 == 0 else ""), n) for i, n in enumerate(TRAINER_NAMES[:10])]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{m}', '{n}')" for m, n in rows) + " AS t(message, trainer)")  # of known size


@cache  # the plan, not the data
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank overrides keyed on character and trainer, derived from `events`' users."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("character", F.concat(F.lit("Hero"), "user_id"))
    until = F.when(F.col("user_id") % 2 == 0, F.lit("1/15/24")).otherwise(F.lit("2024-01-10 00:00:00"))
    return u.filter("user_id % 4 = 0").select("character", F.lit("Atkus").alias("trainer"), F.lit("override").alias("rank_mode"),
                                              F.lit(None).cast("string").alias("override_date")).unionByName(
        u.filter("user_id % 3 = 0").select("character", F.lit("Regia").alias("trainer"), F.lit("override_until_date").alias("rank_mode"),
                                           until.alias("override_date"))).unionByName(
        u.filter("user_id % 5 = 0").select("character", F.lit("Evus").alias("trainer"), F.lit("modifier").alias("rank_mode"),
                                           F.lit("1/1/24").alias("override_date")))


# --- M1: the rendered log ----------------------------------------------------------------------------------

def _kx(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _messages() -> Column:
    """The message or messages of one event, an ARRAY<STRING>; the layout is described in README."""
    k, u, e = F.col("k"), F.col("user_id").cast("string"), F.col("event_id")
    amount, half = F.floor("value").cast("string"), F.floor(F.col("value") / 2).cast("string")
    hero = F.concat(F.lit("Hero"), u)
    same = F.when(k % 2 == 1, F.upper(hero)).otherwise(hero)
    creature = F.coalesce(F.col("creature"), F.lit("Rat"))
    article = pick(["a", "an", "the"], k % 3)
    beast = F.concat(F.lit("Beast "), (e % 7).cast("string"))
    other = F.concat(F.lit("Beast "), (e % 5 + 7).cast("string"))
    kind3 = pick(["movements", "ways", "essence"], k % 3)
    mark = pick(["¥", "•"], k % 2)
    phrase = pick(PHRASES, e % len(PHRASES))
    trainer = pick(TRAINER_NAMES[:10], k % 10)
    c = F.concat
    lit = F.lit
    click = (
        F.when(k < 60, c(lit("You "), pick(["killed", "slaughtered", "vanquished", "dispatched"], k % 4), lit(" "), article, lit(" "), creature, lit(".")))
        .when(k == 60, lit("You reel in a friendly mimic!"))
        .when(k < 64, c(lit("You reel in a shiny trout "), k.cast("string"), lit("!!")))
        .when(k < 66, lit("You feel a tug on your line, but the fish slips free."))
        .when(k == 66, lit("You reel in an empty hook."))
        .when(k < 75, c(lit("You found a lump of "), pick(ORES, k % 5), lit(" ore!")))
        .when(k < 80, lit("You take the wood.")).when(k < 83, lit("You find that the wood is useless."))
        .when(k < 87, c(lit("* You pick up "), amount, lit(" coins."))).when(k < 89, c(lit("You have "), amount, lit(" coins.")))
        .when(k == 89, lit("* The bell rings soundlessly into the void, summoning help.")).when(k == 90, lit("* Your bell crumbles to dust."))
        .when(k == 91, lit("Your chain breaks as you try to use it.")).when(k == 92, lit("A link in your chain shatters."))
        .when(k == 93, lit("Your chain snaps as you try to use it.")).when(k == 94, lit("You start dragging Stranger."))
        .when(k == 95, lit("* You activate your shieldstone.")).when(k == 96, lit("Your Shieldstone goes inert."))
        .when(k == 97, lit("You open an ethereal portal.")).when(k == 98, lit("Your ethereal portal stone disappears into the ether."))
        .otherwise(lit("* You gain esteem."))
    )
    view = (
        F.when(k < 60, c(lit("You helped "), pick(["kill", "slaughter", "vanquish", "dispatch"], k % 4), lit(" "), article, lit(" "), creature, lit(".")))
        .when(k < 70, c(same, lit(" has fallen to "), pick(["a ", "an ", ""], k % 3), creature, lit(".")))
        .when(k < 75, c(lit("Stranger has fallen to a "), creature, lit(".")))
        .when(k < 77, c(hero, lit(" is no longer fallen.")))
        .when(k == 77, lit("This is the first time your spirit has departed your body."))
        .when(k < 81, c(lit("Your spirit has departed your body "), (e % 50).cast("string"), lit(" times.")))
        .when(k == 81, lit("You just received good karma from Stranger.")).when(k == 82, lit("You received bad karma from Stranger."))
        .when(k == 83, lit("You received anonymous good karma.")).when(k == 84, lit("You just received anonymous bad karma."))
        .when(k < 87, lit("You gave anonymous good karma to Stranger.")).when(k < 89, lit("You gave signed bad karma to Stranger."))
        .when(k == 89, lit("* You grow more mindful.")).when(k == 90, lit("* You gain experience and esteem."))
        .when(k == 91, lit("Stranger is now Clanning.")).when(k == 92, lit("Stranger is no longer Clanning."))
        .when(k == 93, lit("*** We are no longer connected to the Clan Lord game server. ***"))
        .when(k == 94, c(lit('Untrainus says, "'), hero, lit(', your mind is less cluttered now."')))
        .when(k < 98, c(lit("Stranger says, \"You killed a "), creature, lit('."')))
        .when(k == 98, lit("(Stranger waves happily)")).otherwise(lit(""))
    )
    loot = pick(["fur", "blood", "mandibles"], k % 3)
    purchase = (
        F.when(k < 50, c(lit("* Stranger recovers the "), creature, lit(" "), loot, lit(", worth "), amount, lit("c. Your share is "), half, lit("c.")))
        .when(k < 70, c(lit("* You recover the "), creature, lit(" "), loot, lit(", worth "), amount, lit("c.")))
        .when(k < 80, c(mark, lit("You have been charged "), amount, lit(" coins for advanced studies.")))
        .when(k < 85, c(trainer, lit(" says, \"Congratulations, "), same, lit(". You should now understand much more of "), trainer, lit("’s teachings.\"")))
        .when(k < 92, c(trainer, lit(" says, \"Congratulations, "), same, lit(". you should now understand more of "), trainer, lit("'s teachings.\"")))
        .when(k < 95, c(trainer, lit(" says, \"Congratulations, Stranger. You should now understand much more of "), trainer, lit("'s teachings.\"")))
        .when(k < 98, c(lit("Honor thinks, \"Congratulations go out to "), hero, lit(", who has just passed the third circle "),
                        pick(PROFESSIONS, e % 7), lit(" test.\"")))
        .when(k == 98, c(lit("Honor says, \"Congratulations to "), hero, lit(", who has just become a Ranger.\"")))
        .otherwise(lit("Honor thinks, \"Congratulations to Stranger, who has just become a Healer.\""))
    )
    signup = (
        F.when(k < 10, c(lit("Welcome to Clan Lord, "), hero, lit("!"))).when(k < 15, c(lit("Welcome back, "), hero, lit("!")))
        .when(k < 20, c(lit("Welcome to Clan Lord, ALT"), u, lit("  II!")))
        .when(k < 95, c(mark, lit("You feel the lessons of "), trainer, pick([".", ""], F.floor(k / 10) % 2)))
        .when(k < 96, c(mark, lit("The Sun rises."))).when((k == 96) & (e % 2 == 0), c(mark, lit("Something else happens.")))
        .when(k < 98, c(mark, lit("You sense healing energy from Stranger."))).when(e % 2 == 0, c(mark, lit("You gain experience from your studies.")))
        .otherwise(c(mark, lit("You can study up to 3 creatures concurrently.")))
    )
    header = c(mark, pick(["You have studied the following creatures:", "You have learned to befriend the following creatures:",
                           "You have learned to assume the shape of the following creatures:"], k % 3))
    progress = c(mark, lit("You are currently studying the "), beast, lit(", and have much left to learn."))
    hail = c(trainer, lit(' says, "Hail, '), same, lit('."'))
    say = c(trainer, lit(' says in Sylvan, "'), phrase, lit('"'))
    error = (
        F.when(k < 20, F.array(c(mark, lit("You begin studying the "), kind3, lit(" of the "), beast, lit("."))))
        .when(k < 35, F.array(c(mark, lit("You have much left to learn about the "), kind3, lit(" of the "), beast, lit("."))))
        .when(k < 45, F.array(progress))
        .when(k < 50, F.array(c(mark, lit("You abandon your study of the "), beast, lit("."))))
        .when(k < 60, F.array(c(mark, pick(["You learn to fight the ", "You learn to befriend the ", "You learn to assume the form of the "], k % 3), beast,
                                pick([" more effectively.", ".", "."], k % 3))))
        .when(k < 64, F.array(c(mark, lit("You have completed your training with "), trainer, lit("."))))
        .when(k < 68, F.array(header, c(beast, lit(", "), other, lit(",")), c(lit("Beast X"), (e % 3).cast("string"), lit("."))))
        .when(k == 68, F.array(header, c(beast, lit(",")), lit("* You gain esteem."), c(other, lit("."))))
        .when(k == 69, F.array(progress, c(mark, lit("You have studied the following creatures:")), c(beast, lit(", "), other, lit("."))))
        .when(k < 80, F.array(c(trainer, lit(' says, "Hail, '), same, lit(". "), phrase, F.when(k % 2 == 0, lit(" Come again.")).otherwise(lit("")), lit('"'))))
        .when(k < 83, F.array(c(trainer, lit(' says, "Hail, '), same, lit('. There is nothing I can teach you."'))))
        .when(k < 86, F.array(hail)).when(k < 89, F.array(c(trainer, lit(" bows deeply."))))
        .when(k < 92, F.array(say))
        .when(k < 98, F.array(hail, c(trainer, lit(" bows.")), say))
        .when(k == 98, F.array(hail, say))
        .otherwise(F.array(c(trainer, lit(' says, "Hail, Stranger. '), phrase, lit('"'))))
    )
    t = F.col("event_type")
    return (F.when(t == "click", F.array(click)).when(t == "view", F.array(view)).when(t == "purchase", F.array(purchase))
            .when(t == "signup", F.array(signup)).when(t == "error", error))


def _stamp() -> Column:
    """'M/D/YY H:MM:SSa', the same in 24 hours, none, or one with an impossible date."""
    k, ts = F.col("k"), F.col("ts")
    date = F.concat_ws("/", F.month(ts).cast("string"), F.dayofmonth(ts).cast("string"), F.lpad((F.year(ts) % 100).cast("string"), 2, "0"))
    hour = F.hour(ts)
    rest = F.format_string(":%02d:%02d", F.minute(ts), F.floor(F.second(ts)).cast("int"))
    half_day = F.concat(((hour + 11) % 12 + 1).cast("string"), rest, F.when(hour < 12, F.lit("a")).otherwise(F.lit("p")))
    impossible = (k % 50 == 49) & F.col("event_type").isin("click", "view", "signup")
    return (F.when(k % 10 == 7, F.lit("")).when(impossible, F.lit("2/30/24 1:00:00p "))
            .when(k % 10 == 3, F.concat(date, F.lit(" "), hour.cast("string"), rest, F.lit(" ")))
            .otherwise(F.concat(date, F.lit(" "), half_day, F.lit(" "))))


@cache  # the plan, not the data
def render_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_no, loose, folder, path, line_no, content): one file per user and week; every tenth user is loose."""
    ev = _kx(spread(table(spark, sf_dir, "events"), "event_id"))
    part = table(spark, sf_dir, "part").filter("p_partkey < 100").select(F.col("p_partkey").cast("int").alias("k"), F.concat_ws(" ", "p_name", "p_partkey").alias("creature"))
    ev = ev.join(part, "k", "left")
    u = F.col("user_id")
    week = F.floor((F.dayofmonth("ts") - 1) / 7) * 7 + 1
    name = F.format_string("CL Log %04d:%02d:%02d %02d.%02d.%02d.txt", F.year("ts"), F.month("ts"), week,
                           F.floor(u / 3600) % 24, F.floor(u / 60) % 60, u % 60)
    loose = u % 10 == 9
    folder = F.when(loose, F.lit("")).otherwise(F.concat(F.lit("Hero"), u.cast("string")))
    path = F.concat(F.lit("/logs/"), F.when(loose, F.lit("")).otherwise(F.concat(folder, F.lit("/"))), name)
    rows = ev.select(F.lit(0).alias("root_no"), loose.alias("loose"), folder.alias("folder"), path.alias("path"), "event_id",
                     _stamp().alias("_stamp"), F.posexplode(_messages()).alias("_sub", "_message"))
    return rows.select("root_no", "loose", "folder", "path", (F.col("event_id") * 4 + F.col("_sub")).alias("line_no"),
                       F.concat("_stamp", "_message").alias("content"))


@cache  # written once per session: parsed lines are the first table of the ingest
def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(parse_lines(render_log(spark, sf_dir)))


@cache  # the plan, not the data
def attributed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(parsed_log(spark, sf_dir))


@cache  # written once per session: the event table is what all rollups read
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(ingest_log(spark, sf_dir))


def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render, parse, attribute and classify, from the tables to events."""
    return classify(attribute(materialise(parse_lines(render_log(spark, sf_dir)))), "message", trainer_messages(spark))


# --- event-shaped facts ------------------------------------------------------------------------------------

def as_events(df: DataFrame) -> DataFrame:
    """Complete rows (kind, character, date, line_no, some fields) to the shape of classified lines."""
    have = set(df.columns)
    out = df.withColumns({
        "root_no": F.lit(0), "loose": F.lit(False), "folder": F.lit(""), "path": F.lit("/facts/all"),
        **{c: F.lit(None).cast(t) for c, t in EVENT_FIELDS.items() if c not in have}})
    return out.withColumn("path_head", path_head()).withColumn("line_block", line_block())


@cache  # the plan, not the data
def kill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: every line item is a kill (or a death) of its customer's group of 30 by part type and brand."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_brand").alias("creature"))
    f = li.join(o, "l_orderkey").join(p, "l_partkey")
    who = F.concat(F.lit("Hero"), F.floor(F.col("o_custkey") / 30).cast("string"))
    n = F.col("l_linenumber")
    kind = F.when(n == 6, F.lit("Fallen")).when(F.col("l_linestatus") == "O", F.lit("AssistedKill")).otherwise(F.lit("SoloKill"))
    verb = F.when(n == 7, F.lit("dispatched")).when(F.col("l_returnflag") == "A", F.lit("killed")).when(
        F.col("l_returnflag") == "N", F.lit("slaughtered")).otherwise(F.lit("vanquished"))
    date = F.concat(F.to_date("l_shipdate").cast("string"), F.lit(" "), F.lpad((F.col("l_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    return as_events(f.select(who.alias("character"), who.alias("subject"), "creature", kind.alias("kind"),
                              F.when(n != 6, verb).alias("verb"), date.alias("date"),
                              # several items may share a number: the day makes the order total
                              ((F.col("l_orderkey") * 8 + n) * 10000 + F.datediff("l_shipdate", F.lit("1990-01-01"))).alias("line_no")))


@cache  # the plan, not the data
def loot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the first items of an order also yield loot, after their kill or (the third) before it; some shares are not above 0."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_quantity")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_brand").alias("item"))
    f = li.join(o, "l_orderkey").join(p, "l_partkey")
    who = F.concat(F.lit("Hero"), F.floor(F.col("o_custkey") / 30).cast("string"))
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    at = (F.col("l_orderkey") * 8 + n) * 10000 + F.datediff("l_shipdate", F.lit("1990-01-01")) + F.when(n == 3, -1).otherwise(5000)
    return as_events(f.select(who.alias("character"), F.lit("LootShare").alias("kind"), "item", (F.floor("l_quantity") - 5).cast("bigint").alias("amount"),
                              F.when(flag == "A", F.lit("fur")).when(flag == "N", F.lit("blood")).otherwise(F.lit("mandible")).alias("loot_type"),
                              F.to_date("l_shipdate").cast("string").alias("date"), at.alias("line_no")))


@cache  # the plan, not the data
def kill_bestiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bestiary of M2's creatures: value 20 x the largest size, family from the type, rarity text from the size."""
    p = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.max("p_size").alias("s"))
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    family = F.when(brand % 10 == 0, F.upper("p_type")).when(brand % 7 == 0, F.lit("Ethereal")).otherwise(F.initcap("p_type"))
    known = F.concat_ws(" ", "p_type", "p_brand")  # every eleventh brand is filed under a name no log uses
    return p.select(
        F.when(brand % 11 == 5, F.concat(F.lit("Unseen "), known)).otherwise(known).alias("name"), family.alias("family"), _rarity(F.col("s") + brand).alias("rarity"),
        (F.col("s") * 20).cast("bigint").alias("value"), (brand % 6 == 0).alias("is_seasonal"))


@cache  # the plan, not the data
def kill_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that logs use for the creatures filed otherwise: pointers for even brands, inline entries for odd ones."""
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    known, pointer = F.concat_ws(" ", "p_type", "p_brand"), brand % 2 == 0
    inline = F.struct(F.lit(7).cast("bigint").alias("value"), F.lit("Inline").alias("family"), F.lit("Rare").alias("rarity"))
    return p.filter(brand % 11 == 5).select(known.alias("log_name"), F.when(pointer, F.concat(F.lit("Unseen "), known)).alias("resolves_to"), F.when(~pointer, inline).alias("inline"))


RARITIES = ["Common", "Medium to rare", "Rare", "Unique boss", "Exotic", "GM only", "Extinct", "Uncommon and rare", "??"]


def _rarity(index: Column) -> Column:
    return pick(RARITIES, index % len(RARITIES))


@cache  # the plan, not the data
def rank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: every order is a rank line or an apply-learning line of its customer's group of 30."""
    o = table(spark, sf_dir, "orders")
    who = F.concat(F.lit("Hero"), F.floor(F.col("o_custkey") / 30).cast("string"))
    learning = F.col("o_orderstatus") == "O"
    return as_events(o.select(
        who.alias("character"), who.alias("subject"), pick(TRAINER_NAMES, F.col("o_orderkey") % len(TRAINER_NAMES)).alias("trainer"),
        F.when(learning, F.lit("ApplyLearningRank")).otherwise(F.lit("TrainerRank")).alias("kind"),
        F.when(learning, F.col("o_orderpriority") == "1-URGENT").alias("flag"),
        F.concat(F.to_date("o_orderdate").cast("string"), F.lit(" 12:00:00")).alias("date"), F.col("o_orderkey").alias("line_no")))


@cache  # the plan, not the data
def study_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: events as study lines on 50 creatures of the bestiary."""
    ev = _kx(table(spark, sf_dir, "events")).withColumn("b", F.col("k") % 50)
    part = table(spark, sf_dir, "part").filter("p_partkey < 50").select(F.col("p_partkey").cast("int").alias("b"), F.concat_ws(" ", "p_name", "p_partkey").alias("creature"))
    t = F.col("event_type")
    kind = (F.when(t == "click", F.lit("LastyBeginStudy")).when(t == "view", F.lit("LastyProgress")).when(t == "purchase", F.lit("LastyFinished"))
            .when(t == "error", F.lit("StudyAbandon")).when(F.col("k") < 50, F.lit("LastyCompleted")).otherwise(F.lit("StudyProgress")))
    typed = F.when(t.isin("click", "view", "purchase"), pick(["Movements", "Befriend", "Morph"], F.col("k") % 3))
    return as_events(ev.join(F.broadcast(part), "b", "left").select(  # 50 rows, estimated at the whole table
        F.concat(F.lit("Hero"), F.floor(F.col("user_id") / 5).cast("string")).alias("character"),
        kind.alias("kind"), F.when(kind != "LastyCompleted", F.col("creature")).alias("creature"), typed.alias("lasty_type"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").cast("string").alias("date"), F.col("event_id").alias("line_no")))


@cache  # the plan, not the data
def bestiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: parts as creatures."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    family = F.when(key % 10 == 0, F.upper("p_type")).when(key % 10 == 3, F.lit("Extinct")).otherwise(F.initcap("p_type"))
    return p.select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"), family.alias("family"), _rarity(F.col("p_size") + key).alias("rarity"),
                    F.col("p_size").cast("bigint").alias("value"), (key % 6 == 0).alias("is_seasonal"),
                    (key % 97).cast("bigint").alias("attack"), (key % 89).cast("bigint").alias("defense"), (key % 83).cast("bigint").alias("damage"),
                    (key % 79).cast("bigint").alias("health"), (key % 7).cast("double").alias("frames_per_swing"))


@cache  # the plan, not the data
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of M8: a pointer for every even part, an inline entry for every odd one."""
    key = F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", "p_partkey")
    pointer = key % 2 == 0
    inline = F.struct((key * 2).cast("bigint").alias("value"), F.lit("Odd").alias("family"), F.lit("Rare").alias("rarity"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.when(pointer, F.lit("Old ")).otherwise(F.lit("Odd ")), name).alias("log_name"),
        F.when(pointer, name).alias("resolves_to"), F.when(~pointer, inline).alias("inline"))


# --- characters, trainers with overrides, files, lines ------------------------------------------------------

def _group(key: Column | str) -> Column:
    return F.floor(F.col(key) / 30) if isinstance(key, str) else F.floor(key / 30)


@cache  # the plan, not the data
def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters: groups of 30 customers; the group's number decides what it is merged into."""
    c = table(spark, sf_dir, "customer").withColumn("n", _group("c_custkey"))
    g = c.groupBy("n").agg(
        F.sum(F.col("c_nationkey") % 3).alias("logins"), F.sum("c_nationkey").alias("deaths"), F.count("*").alias("departs"),
        F.sum(F.floor(F.col("c_acctbal"))).alias("coins_picked_up"), F.max("c_name").alias("start_date"))
    hero = lambda n: F.concat(F.lit("Hero"), n.cast("string"))
    n = F.col("n")
    into = F.when(n % 10 == 1, hero(n - 1)).when(n % 10 == 3, hero(n - 2))
    return g.select(hero(n).alias("character"), into.alias("merged_into"), "logins", "deaths", "departs", "coins_picked_up", "start_date",
                    pick(["Unknown", "Ranger", "Fighter", "Healer"], n % 4).alias("profession"))


@cache  # the plan, not the data
def rank_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("character", "([0-9]+)$", 1).cast("bigint")
    p = people(spark, sf_dir).select("character", n.alias("n"))
    row = lambda when, trainer, mode, date, mod: p.filter(when).select(
        "character", F.lit(trainer).alias("trainer"), F.lit(mode).alias("rank_mode"), F.lit(date).cast("string").alias("override_date"),
        mod.cast("bigint").alias("modified_ranks"))
    return row("n % 7 = 0", "Atkus", "override", None, F.col("n") + 1).unionByName(
        row("n % 5 = 0", "Regia", "override_until_date", "1/1/99", F.lit(3))).unionByName(
        row("n % 3 = 0", "Zeno", "modifier", None, F.lit(2)))


@cache  # the plan, not the data
def trainer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("character", "([0-9]+)$", 1).cast("bigint")
    return people(spark, sf_dir).filter(n % 4 == 0).select("character", F.lit("Evus").alias("trainer"), F.concat(F.lit("note "), "character").alias("notes"))


def lines_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: one file per conversation, one line per turn; the role is the character."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("path"), F.col("turn").alias("line_no"), F.col("text").alias("content"),
                    F.col("role").alias("character"), F.lit("").alias("date"))


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: conversations as (item, path, line): each conversation an item, each turn a file, each word a line."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("item"), F.col("turn").cast("string").alias("path"), F.explode(F.split("text", " ")).alias("line")).filter("line <> ''")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: documents as files of UTF-8 bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")).withColumn(
        "length", F.octet_length("content").cast("bigint"))


def text_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an earlier scan by doc_id: never seen, the same, a prefix, a changed prefix, or a legacy row."""
    f = text_files(spark, sf_dir).filter("doc_id % 5 <> 0")
    i = F.col("doc_id") % 5
    half = F.floor(F.col("length") / 2)
    prefix = F.substring(F.col("content"), F.lit(1), half.cast("int"))
    hash_ = F.when(i == 1, F.sha2("content", 256)).when(i == 2, F.sha2(prefix, 256)).otherwise(F.sha2(F.concat(prefix, F.lit("x").cast("binary")), 256))
    length = F.when(i == 1, F.col("length")).when(i.isin(2, 3), half).otherwise(0)
    return f.select("path", hash_.alias("content_hash"), length.cast("bigint").alias("byte_len"), F.lit("2024-01-01 00:00:00").alias("date_read"))
