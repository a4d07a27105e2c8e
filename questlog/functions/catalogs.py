"""Fixed values of the game: small tables that must be exactly these for results to be right.

Anything a user may extend (trainer messages, bestiary, aliases, creature values) is an input table,
see `questlog.sources.dimensions`; these are the defaults of parameters.
"""

from __future__ import annotations

# Phrase a trainer speaks -> (lowest rank, highest rank or None when open-ended).
CHECKPOINT_PHRASES: dict[str, tuple[int, int | None]] = {
    "You have much to learn.": (0, 9),
    "It is good to see you.": (10, 19),
    "Your persistence is paying off.": (20, 29),
    "You are progressing well.": (30, 39),
    "You are a good pupil of mine.": (40, 49),
    "You are one of my better pupils.": (50, 99),
    "You keep me on my toes.": (100, 149),
    "It is hard to find more to teach you.": (150, 199),
    "Teaching you is a challenge.": (200, 249),
    "There is not much more I can teach you.": (250, 299),
    "Teaching you has taught me much.": (300, 349),
    "You have attained tremendous skill.": (350, 399),
    "We are nearly equals.": (400, 449),
    "You may be proud of your accomplishment.": (450, 499),
    "You are becoming a master of our art.": (500, 549),
    "Your dedication is commendable.": (550, 599),
    "You show great devotion to your studies.": (600, 649),
    "You are a credit to our craft.": (650, 699),
    "Few indeed are your peers.": (700, 749),
    "Your devotion to the craft is exemplary.": (750, 799),
    "It is always good to greet a respected colleague.": (800, 899),
    "You are truly a grand master.": (900, 999),
    "Let us search for more we might learn together.": (1000, 1249),
    "Your persistence is an example to us all.": (1250, 1499),
    "Your skill astounds me.": (1500, 1749),
    "You have progressed further than most.": (1750, 1999),
    "You are nearly peerless.": (2000, 2249),
    "You are a model of dedication.": (2250, 2499),
    "You have achieved mastery.": (2500, 2749),
    "You are enlightened.": (2750, 2999),
    "Your command of our craft is inspiring.": (3000, 3249),
    "All commend your dedication to our craft.": (3250, 3499),
    "I marvel at your skill.": (3500, 3749),
    "You walk where few have tread.": (3750, 3999),
    "Few stones are unturned in your path.": (4000, 4249),
    "Your footsteps guide the dedicated.": (4250, 4499),
    "You chart a way through the unknown.": (4500, 4749),
    "Your path illuminates the wilderness.": (4750, 4999),
    "Your skill casts a long shadow.": (5000, 5249),
    "You are a luminary of our art.": (5250, 5499),
    "Your skill is a beacon to all.": (5500, 5749),
    "You feel you have much to learn.": (0, 9),
    "You feel tolerably skilled.": (10, 19),
    "You are becoming proficient.": (40, 49),
    "You have learned much.": (50, 99),
    "You have become skilled.": (100, 149),
    "You have become very skilled.": (150, 199),
    "Learning more is a challenge.": (200, 249),
    "You have attained great skill.": (250, 299),
    "You are becoming an expert.": (300, 349),
    "You are close to attaining mastery.": (400, 449),
    "You are becoming a master of your art.": (500, 549),
    "You are a credit to your craft.": (650, 699),
    "Your devotion to your craft is exemplary.": (750, 799),
    "Your expertise is unquestionable.": (800, 899),
    "Few if any are your equal.": (1000, 1249),
}

# Professions, and trainers whose ranks count against a specialisation.
SPECIALISATIONS = ["Ranger", "Bloodmage", "Champion"]
BASE_CLASSES = ["Fighter", "Healer", "Mystic"]
DECAY_TRAINERS = {"Gossamer Decay": "Ranger", "Bloodblade Decay": "Bloodmage", "Champion Blade Decay": "Champion"}

# Names under which two trainers appear in formulas.
FORMULA_NAMES = {"Bangus Anmash": "Bangus", "Farly Buff": "Farly"}

# Slaughter points per rank; others cost UNKNOWN_RANK_COST.
RANK_COSTS = {
    "Atkus": 21, "Darkus": 19, "Balthus": 18, "Regia": 18, "Evus": 24, "Swengus": 18, "Histia": 29, "Detha": 22,
    "Bodrus": 24, "Hardia": 30, "Troilus": 20, "Spiritus": 20, "Aktur": 22, "Atkia": 21, "Darktur": 20,
    "Angilsa": 10, "Knox": 12, "Heen": 20, "Bangus": 23, "Farly": 22, "Stedfustus": 25, "Forvyola": 23,
    "Anemia": 24, "Rodnus": 20, "Erthron": 29,
}
UNKNOWN_RANK_COST = 20

# What an untrained human starts with.
RACE_BASE = {
    "accuracy": 300, "damage_min": 100, "damage_max": 200, "balance": 5000, "balance_regen": 400, "health": 3000,
    "defense": 300, "health_regen": 100, "spirit": 800, "spirit_regen": 600,
}

# Points of each statistic per rank of a trainer.
STAT_COEFFICIENTS = {
    "accuracy": {"Atkus": 16, "Evus": 4, "Bodrus": 4, "Aktur": 25, "Atkia": 13, "Knox": -4, "Angilsa": -4, "Bangus": 2,
                 "Erthron": 3},
    "damage_min": {"Darkus": 6, "Evus": 1, "Bodrus": 1, "Knox": 11, "Angilsa": -1, "Erthron": 1, "Atkia": 3,
                   "Darktur": 10, "Bangus": 2},
    "damage_max": {"Darkus": 6, "Evus": 1, "Bodrus": 1, "Knox": 11, "Angilsa": -1, "Erthron": 1, "Atkia": 3,
                   "Darktur": 10, "Bangus": 3, "Hardia": 1},
    "balance": {"Balthus": 51, "Evus": 18, "Bodrus": 9, "Atkus": 15, "Darkus": 18, "Swengus": 30, "Knox": 18,
                "Angilsa": -18, "Bangus": 21, "Erthron": 15},
    "balance_regen": {"Regia": 15, "Evus": 4, "Bodrus": 3, "Atkus": 1, "Darkus": 1, "Swengus": 7, "Knox": -2,
                      "Angilsa": 26, "Forvyola": 8, "Bangus": 5, "Erthron": 3, "Atkia": 3, "Stedfustus": 6, "Anemia": 8},
    "health": {"Histia": 111, "Evus": 24, "Bodrus": 24, "Detha": 3, "Rodnus": 36, "Farly": 48, "Knox": -24,
               "Angilsa": -24, "Forvyola": 54, "Bangus": 6, "Erthron": 24, "Spiritus": 21, "Stedfustus": 54, "Anemia": 69},
    "defense": {"Detha": 19, "Evus": 1, "Bodrus": 1, "Hardia": 1, "Farly": 2, "Knox": -1, "Angilsa": -1, "Erthron": 7},
    "health_regen": {"Troilus": 6, "Farly": 4, "Bangus": 1, "Anemia": -1},
    "spirit": {"Spiritus": 9},
    "heal_receptivity": {"Rodnus": 2, "Spiritus": 1},
    "heen": {"Heen": 1},
}

# Study costs by type, ranger trainers, families that are not real families.
STUDY_COSTS = {"Movements": 5, "Befriend": 10, "Morph": 5}
RANGER_TRAINERS = {"points": "Duvin Beastlore", "quarter_points": "Gossamer"}
EXCLUDED_FAMILIES = ["--", "Uncategorized", "EXTINCT", "Extinct"]
UNSTUFFABLE_FAMILY = "Ethereal"

# Causes of death that are no creatures.
SELF_INFLICTED = ["blood magic", "lightning bolt"]

# Coin level thresholds.
COIN_LEVEL_MIN_KILLS = 5
COIN_LEVEL_MIN_VALUE = 50


def race_points() -> int:
    """Slaughter points of an untrained character; balance and health count a third, rounded down."""
    b = RACE_BASE
    return sum(v // 3 if k in ("balance", "health") else v for k, v in b.items())
