"""Readers on real files."""

import datetime
import json
import random

from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.sources import dimensions as D
from questlog.sources.logs import decode_lines, parse_lines, read_log_lines, read_logs
from questlog.operators.attribution import attribute, folder_character


def test_timestamps(spark):
    cases = {
        "1/2/24 1:02:03p hi": ("2024-01-02 13:02:03", "hi"), "12/31/99 12:00:00a x": ("2099-12-31 00:00:00", "x"),
        "12/31/09 12:00:00p x": ("2009-12-31 12:00:00", "x"), "1/2/24 23:59:59 ¥day": ("2024-01-02 23:59:59", "¥day"),
        "2/30/24 1:00:00p no": (None, "2/30/24 1:00:00p no"), "1/2/24 13:00:00p no": (None, "1/2/24 13:00:00p no"),
        "1/2/24 1:02:60p no": (None, "1/2/24 1:02:60p no"), "1/2/24 1:2:3a ": (None, "1/2/24 1:2:3a "), "1/2/24 10:20:30a ": ("2024-01-02 10:20:30", ""),
        "hello": (None, "hello"), "1/2/3/4 1:02:03p hi": (None, "1/2/3/4 1:02:03p hi"), "1/1/17 1:00:00a  ¥two": ("2017-01-01 01:00:00", " ¥two"),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", S.parse_line_ts("c").alias("p"))
    assert {r["c"]: (str(r["p"]["ts"]) if r["p"]["ts"] else None, r["p"]["message"]) for r in df.collect()} == cases


def test_filename_date(spark):
    cases = {"CL Log 2024:01:31 13.05.59.txt": "2024-01-31 13:05:59", "CL Log 2024_01_31 13.05.59": "2024-01-31 13:05:59",
             "CL Log notes.txt": None, "Other 2024:01:31 13.05.59": None, "CL Log 2024:01:31": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", S.filename_date("c").alias("d"))
    assert {r["c"]: r["d"] for r in df.collect()} == cases


def test_mixed_encodings(spark):
    mixed = b"\n\nplain\r\n" + "café utf8".encode() + b"\r\xa5You feel\n" + b"it\xd5s \x8e \xe9\n"
    clean = "\nfirst “quoted”\n\nlast".encode()
    df = spark.createDataFrame([("m", bytearray(mixed)), ("c", bytearray(clean)), ("e", bytearray(b""))], "path string, content binary")
    rows = sorted(decode_lines(df).collect())
    lines = {p: [r["content"] for r in rows if r["path"] == p] for p in "mce"}
    assert lines == {"m": ["plain", "café utf8", "¥You feel", "it’s é é"], "c": ["", "first “quoted”", "", "last"], "e": [""]}


def make_tree(root):
    day = "CL Log 2024:01:0{} 13.00.00.txt"
    files = {
        "logs/ann/" + day.format(2): "1/2/24 1:00:00p You killed a Rat.\n1/2/24 1:00:01p Welcome back, BOB iv!\n",
        "logs/ann/" + day.format(1): "1/1/24 1:00:00p Welcome to Clan Lord, ann marie!\nno stamp\n",
        "logs/zed/" + day.format(1)[:-4]: "1/1/24 1:00:00p You killed a Rat.\n" * 3,
        "logs/" + day.format(3): "x\n1/3/24 1:00:00p Welcome back, Loose!\n", "logs/" + day.format(4): "1/4/24 1:00:00p nobody\n",
        "logs/.hidden/" + day.format(1): "no", "logs/CL_Movies/" + day.format(1): "no", "logs/ann/deep/" + day.format(1): "no",
        "other/notes.txt": "no",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return str(root / "logs")  # seen from above, the loose files would make `logs` a character folder


def test_read_logs_and_split_reader_agree(spark, tmp_path):
    base = make_tree(tmp_path)
    files = read_logs(spark, base)
    got = {(r["path"].replace(base, ""), r["folder"], r["loose"]) for r in files.collect()}
    assert got == {("/ann/CL Log 2024:01:02 13.00.00.txt", "ann", False), ("/ann/CL Log 2024:01:01 13.00.00.txt", "ann", False),
                   ("/zed/CL Log 2024:01:01 13.00.00", "zed", False), ("/CL Log 2024:01:03 13.00.00.txt", "", True),
                   ("/CL Log 2024:01:04 13.00.00.txt", "", True)}
    whole = decode_lines(files.drop("length", "root")).select("path", "line_no", "content", "folder", "loose")
    split = read_log_lines(spark, base).select("path", "line_no", "content", "folder", "loose")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # many splits per file
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
        split = read_log_lines(spark, base).select("path", "line_no", "content", "folder", "loose")
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)


def test_attribution_of_a_tree(spark, tmp_path):
    lines = parse_lines(decode_lines(read_logs(spark, make_tree(tmp_path)).drop("length", "root")))
    rows = attribute(lines).select(F.element_at(F.split("path", "/"), -2).alias("d"), "line_no", "character", "date", "path").orderBy("path", "line_no").collect()
    assert [(r["d"], r["character"], r["date"]) for r in rows] == [
        ("logs", "Loose", "2024-01-03 13:00:00"),
        ("ann", "Ann Marie", "2024-01-01 13:00:00"), ("ann", "Ann Marie", "2024-01-01 13:00:00"),
        ("ann", "Ann Marie", "2024-01-02 13:00:00"), ("ann", "Bob Iv", "2024-01-02 13:00:01"),
        ("zed", "zed", "2024-01-01 13:00:00"), ("zed", "zed", "2024-01-01 13:00:00"), ("zed", "zed", "2024-01-01 13:00:00")]
    per_file = {r["path"].split("/")[-1]: r["folder_character"] for r in folder_character(lines, per_file=True).filter("folder = 'ann'").collect()}
    assert per_file == {"CL Log 2024:01:01 13.00.00.txt": "Ann Marie", "CL Log 2024:01:02 13.00.00.txt": "Bob Iv"}


def test_dimension_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({
        "¥ You feel stronger.": {"trainer": "Darkus", "profession": "Fighter"},
        "¥You feel quicker.": {"trainer": "Evus", "effective_rank_multiplier": 1.5, "combo_components": ["Darkus"]}, "¥x": {"note": 1}}))
    msgs = D.read_trainers(spark, str(tmp_path / "t.json"))
    assert sorted((r["message"], r["trainer"]) for r in msgs.collect()) == [("You feel quicker.", "Evus"), ("You feel stronger.", "Darkus")]
    assert {r["trainer"]: (r["multiplier"], r["combo_components"]) for r in D.trainer_meta(msgs).collect()} == {"Darkus": (1.0, []), "Evus": (1.5, ["Darkus"])}
    (tmp_path / "v.json").write_text(json.dumps({"Rat": 2, "Cobra": 305}))
    assert {r["name"]: r["value"] for r in D.read_values(spark, str(tmp_path / "v.json")).collect()} == {"Rat": 2, "Cobra": 305}
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "entries": [{"name": "Rat", "exp_taxidermy": 2, "family": "Vermine"}]}))
    r = D.read_bestiary_json(spark, str(tmp_path / "b.json")).collect()[0]
    assert (r["name"], r["value"], r["family"], r["version"]) == ("Rat", 2, "Vermine", "1")
    (tmp_path / "a.json").write_text(json.dumps([{"log_name": "Rats", "resolves_to": "Rat"}, {"log_name": "Odd", "inline": {"exp_taxidermy": 7}}]))
    rows = {r["log_name"]: (r["resolves_to"], r["inline"]["value"] if r["inline"] else None) for r in D.read_aliases(spark, str(tmp_path / "a.json")).collect()}
    assert rows == {"Rats": ("Rat", None), "Odd": (None, 7)}


def test_bestiary_xml(spark, tmp_path):
    cell = lambda n, v: f'<column name="{n}">{v}</column>'
    xml = '<?xml version="1.0"?><pma><database name="d"><table name="creatures">' + cell("name", "Dal&#039;Rat") + cell("exp_taxidermy", "x") + cell(
        "family", "NULL") + cell("attack", "65") + cell("is_seasonal", "1") + cell("framesperswing", "1.5") + '</table><table name="other">' + cell("name", "no") + "</table></database></pma>"
    (tmp_path / "d.xml").write_text(xml)
    rows = D.read_bestiary_xml(spark, str(tmp_path / "d.xml")).collect()
    assert [(r["name"], r["value"], r["family"], r["attack"], r["is_seasonal"], r["frames_per_swing"]) for r in rows] == [("Dal'Rat", 0, None, 65, True, 1.5)]


def test_legacy_date(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (None,), (86400.5,)], "z double").select(S.legacy_date("z").alias("d"))
    assert [r["d"] for r in df.collect()] == [None, None, None, "2001-01-02"]
    assert datetime.date(2001, 1, 2).isoformat() == "2001-01-02"


def test_tail_offsets_are_bytes_of_the_file(spark):
    """LF, CRLF and single-byte files: the lines from the old length on, and no others."""
    from questlog.operators.incremental import tail_lines, with_byte_offsets
    old = {"lf": "één\ntwo\n".encode(), "crlf": "één\r\ntwo\r\n".encode(), "mac": b"\n\r\xe9\xe9n\rtwo\r", "blank": "\n\nx\n".encode()}
    new = {k: v + "three\nfour\n".encode() for k, v in old.items()}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in new.items()], "path string, content binary")
    plan = spark.createDataFrame([(k, "tail", len(v)) for k, v in old.items()], "path string, action string, offset bigint")
    lines = with_byte_offsets(decode_lines(files, positions=True))
    got = {}
    for r in tail_lines(lines, plan).orderBy("line_no").collect():
        got.setdefault(r["path"], []).append(r["content"])
    assert got == {k: ["three", "four"] for k in old}


def test_csv_files_carry_their_header(spark, tmp_path):
    from questlog.sources.sinks import write_csv
    df = spark.createDataFrame([("a,b", 1, None), ('say "x"', 2, "y")], "name string, n int, note string")
    write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["name", "n", "note"] and {tuple(r) for r in back.collect()} == {("a,b", "1", None), ('say "x"', "2", "y")}


def plain_places(data: bytes):
    """(line_no, byte_pos, raw_len, raw text) by walking the bytes."""
    mark = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    out, at = [], mark
    while at < len(data):
        end = at
        while end < len(data) and data[end] not in b"\r\n":
            end += 1
        stop = end + (2 if data[end:end + 2] == b"\r\n" else 1 if end < len(data) else 0)
        out.append((len(out), at, stop - at, data[at:end]))
        at = stop
    return out


def test_byte_positions_of_the_split_reader(spark, tmp_path):
    rng = random.Random(3)
    words = [b"plain", "café".encode(), b"it\xd5s \x8e", b"", b"\xa5You feel", b"x" * 70]
    endings = {"lf": [b"\n"], "crlf": [b"\r\n"], "cr": [b"\r"], "mixed": [b"\n", b"\r\n", b"\r"]}
    data = {}
    for name, ends in endings.items():
        body = b"".join(rng.choice(words) + rng.choice(ends) for _ in range(24))
        data[f"CL Log {name}"] = body
        data[f"CL Log {name} open"] = body + b"no end"
        data[f"CL Log {name} marked"] = b"\xef\xbb\xbf" + body + b"no end"
        data[f"CL Log {name} marked closed"] = b"\xef\xbb\xbf" + body + b"end\n"
    data |= {"CL Log empty": b"", "CL Log blank": b"\n\n\n"}
    (tmp_path / "logs" / "ann").mkdir(parents=True)
    for name, body in data.items():
        (tmp_path / "logs" / "ann" / name).write_bytes(body)
    want = sorted((name, *line[:3]) for name, body in data.items() for line in plain_places(body))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "200"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_log_lines(spark, str(tmp_path / "logs"), positions=True).collect()
            assert sorted((r["path"].split("/")[-1], r["line_no"], r["byte_pos"], r["raw_len"]) for r in rows) == want
            texts = {(r["path"].split("/")[-1], r["line_no"]): r["content"] for r in rows}
            for name, body in data.items():
                for line_no, _, _, raw in plain_places(body):
                    try:
                        assert texts[name, line_no] == raw.decode()
                    except UnicodeDecodeError:
                        assert texts[name, line_no].isprintable() and len(texts[name, line_no]) == len(raw)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
