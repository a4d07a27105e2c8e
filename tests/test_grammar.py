"""Grammar cases: message, kind, some fields."""

import pytest

from questlog.functions.grammar import classify

CASES = [
    ("  You slaughtered a Large Vermine.", "SoloKill", {"creature": "Large Vermine", "verb": "slaughtered"}),
    ("You killed the Sky Lord.", "SoloKill", {"creature": "Sky Lord", "verb": "killed"}),
    ("You helped vanquish an Orga Anger.", "AssistedKill", {"creature": "Orga Anger", "verb": "vanquished"}),
    ("You killed Bob.", "Ignored", {}),
    ("Ann has fallen to the Beast.", "Fallen", {"subject": "Ann", "creature": "the Beast"}),
    ("Ann has fallen to a Rat.", "Fallen", {"creature": "Rat"}),
    ("* Ann recovers the Rat fur, worth 20c. Your share is 7c.", "LootShare", {"item": "Rat", "loot_type": "fur", "worth": 20, "amount": 7}),
    ("* You recover the Ant mandibles, worth 9c.", "LootShare", {"loot_type": "mandible", "worth": 9, "amount": 9}),
    ("* You recover the Ant mandible, worth 9c. Your share is 4c.", "LootShare", {"loot_type": "mandible", "amount": 4}),
    ('Ann says, "You killed a Rat."', "Ignored", {}),
    ("(Ann waves happily)", "Ignored", {}),
    ('Tutor says, "Congratulations, Ann. You should now understand much more of Sespus’s teachings."', "ApplyLearningRank",
     {"subject": "Ann", "trainer": "Sespus", "flag": True}),
    ('Tutor says, "Congratulations, Ann. you should now understand more of Sespus\'s teachings."', "ApplyLearningRank", {"flag": False}),
    ('Tutor says, "Hail, Ann. You have much to learn."', "TrainerCheckpoint", {"trainer": "Tutor", "subject": "Ann", "rank_min": 0, "rank_max": 9}),
    ('Tutor says in Sylvan, "Hail, Ann. We are nearly equals. Come back."', "TrainerCheckpoint", {"rank_min": 400}),
    ('Tutor says, "Hail, Ann. There is nothing I can teach you."', "TrainerGreetingWithUnknownCheckpoint", {"text": "There is nothing I can teach you."}),
    ('Tutor says, "Hail, Ann."', "TrainerGreetingSimple", {"subject": "Ann"}),
    ("Tutor bows deeply.", "TrainerBow", {"trainer": "Tutor"}),
    ("Tutor bows to Ann.", "Ignored", {}),
    ('Tutor says, "You are enlightened."', "TrainerCheckpointUnhailed", {"rank_min": 2750, "rank_max": 2999}),
    ("¥You feel stronger.", "TrainerRank", {"trainer": "Darkus"}),
    ("•  You feel stronger", "TrainerRank", {"trainer": "Darkus"}),
    ("¥You feel lighter.", "TrainerRank", {"trainer": "Atkus"}),
    ("You feel stronger.", "Ignored", {}),
    ("¥You begin studying the ways of the Maha.", "LastyBeginStudy", {"creature": "Maha", "lasty_type": "Befriend"}),
    ("¥You have much left to learn about the essence of a Maha.", "LastyProgress", {"lasty_type": "Morph"}),
    ("¥You learn to fight the Maha more effectively.", "LastyFinished", {"creature": "Maha", "lasty_type": "Movements"}),
    ("¥You have studied the following creatures:", "ReflectListHeader", {"lasty_type": "Movements"}),
    ("¥You are remembering your studies of the Maha, and have little left to learn.", "StudyProgress", {"creature": "Maha", "text": "little"}),
    ("¥You have been charged 100 coins for advanced studies.", "StudyCharge", {"amount": 100}),
    ("Welcome to Clan Lord, Ann!", "Login", {"subject": "Ann"}),
    ("Welcome back, Ann!", "Reconnect", {"subject": "Ann"}),
    ("You reel in a friendly mimic!", "FishCaught", {"item": "Mimic"}),
    ("You reel in an empty hook.", "FishingMiss", {}),
    ("You reel in an old boot..!", "FishCaught", {"item": "Old Boot"}),
    ("You found a lump of Iron ore!", "OreFound", {"item": "iron"}),
    ("You just received good karma from Ann.", "KarmaReceived", {"flag": True}),
    ("You gave anonymous bad karma to Ann.", "KarmaGiven", {"flag": False}),
    ("* You gain experience and esteem.", "EsteemGain", {}),
    ("* You gain experience.", "ExperienceGain", {}),
    ("Ann is no longer Clanning.", "ClanningChange", {"flag": False}),
    ('Honor thinks, "Congratulations to Ann, who has just become a BLOODMAGE."', "ProfessionAnnouncement", {"text": "Bloodmage"}),
    ("Your spirit has departed your body 99999999999999999999 times.", "Depart", {"amount": 0}),
    ("You take the wood.\u0085", "Ignored", {}),
    ("", "Ignored", {}),
]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_grammar(spark, broadcast):
    """With a catalogue that Spark may broadcast, and with one that it joins by a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    messages = spark.createDataFrame([("You feel stronger.", "Darkus"), ("You feel lighter", "Atkus")], "message string, trainer string")
    df = spark.createDataFrame([(i, m) for i, (m, *_) in enumerate(CASES)], "i int, message string")
    try:
        got = {r["i"]: r for r in classify(df, "message", messages).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wrong = []
    for i, (message, kind, fields) in enumerate(CASES):
        r = got[i]
        if r["kind"] != kind or any(r[k] != v for k, v in fields.items()):
            wrong.append((message, kind, fields, r))
    assert not wrong
