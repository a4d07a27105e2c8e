"""Log folders to log lines.

Two readers give the same lines (but for blank lines at the head of a file that is not valid UTF-8, which only the first one leaves out):

* `read_logs` + `decode_lines`: one row per file with its bytes, needed where files are hashed or
  compared with a manifest (incremental ingest);
* `read_log_lines`: the splittable text source, for folders whose files may be larger than a task
  should hold. Lines are numbered from split offsets, without a window over the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.functions.grammar import WELCOME_BACK, WELCOME_LOGIN, java
from questlog.operators.scan import LINE_BLOCK, line_block, path_head, prefix_scan
from questlog.session import materialise

LOG_GLOB = "CL Log *"
# File names hold colons, which Hadoop's checksum layer over the local disk cannot open; the raw layer can. The
# options touch these reads only, and only for file: paths.
READ_OPTIONS = {"recursiveFileLookup": "true", "pathGlobFilter": LOG_GLOB, "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
                "fs.file.impl.disable.cache": "true"}
SKIPPED_DIR = r"^(\..*|CL_Movies)$"

# Bytes of old Mac clients (read as Latin-1) and the characters they stand for. The range
# 0x80-0x9F holds accented letters; of the rest only the punctuation used in dialogue is remapped, and
# 0xA5 stays the yen sign that marks system messages.
MAC_BYTES = "".join(chr(b) for b in range(0x80, 0xA0)) + "\xaa\xc9\xd0\xd1\xd2\xd3\xd4\xd5"
MAC_CHARS = "ÄÅÇÉÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü" + "™…–—“”‘’"


def decode_line(raw: Column) -> Column:
    """One line of raw bytes (as an undecoded string): UTF-8 if valid, else the patched single-byte set."""
    return F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.translate(F.decode(raw.cast("binary"), "ISO-8859-1"), MAC_BYTES, MAC_CHARS))


LINE_END = r"(?<=\n)|(?<=\r)(?!\n)"


def decode_lines(files: DataFrame, positions: bool = False) -> DataFrame:
    """Rows of (…, content BINARY) to one row per line: (…, line_no BIGINT, content STRING).

    With `positions` also `raw_len`, the line's bytes in the file with its line end, and `head_len`, the bytes before the
    file's first line: what byte offsets are made of, whatever the encoding and the line ends.
    """
    rest = [c for c in files.columns if c != "content"]
    pieces = F.split(F.decode("content", "ISO-8859-1"), LINE_END)
    pieces = F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    cut = files.select(*rest, pieces.alias("_all"), F.is_valid_utf8(F.col("content").cast("string")).alias("_utf8"))
    # blank lines at the head of a file count only when the whole file is valid UTF-8
    first = F.array_position(F.transform("_all", lambda x: x.rlike(r"[^\r\n]")), True).cast("int")
    kept = F.when(F.col("_utf8") | (first <= 1), F.col("_all")).otherwise(F.slice("_all", first, F.size("_all") - first + 1))
    head = F.when(F.col("_utf8") | (first <= 1), F.lit(0)).otherwise(F.length(F.array_join(F.slice("_all", F.lit(1), first - 1), "")))
    exploded = cut.select(*rest, head.cast("bigint").alias("head_len"), F.posexplode(kept).alias("_pos", "_latin"))
    text = F.regexp_replace("_latin", r"[\r\n]+\z", "")
    return exploded.select(*rest, F.col("_pos").cast("bigint").alias("line_no"), decode_line(F.encode(text, "ISO-8859-1").cast("string")).alias("content"),
                           *([F.length("_latin").cast("bigint").alias("raw_len"), "head_len"] if positions else []))


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def locate(files: DataFrame, base: str, recursive: bool = True) -> DataFrame:
    """Add (root, folder, loose) to rows with a `path` below `base`; rows outside every log root go."""
    base = base.rstrip("/")
    files = files.filter(F.col("path").startswith(base + "/"))
    files = files.withColumn("_dir", _dir(F.col("path"))).withColumn("_up", _dir(F.col("_dir")))
    if not recursive:
        roots = None
    else:
        # a directory is a log root if one of its visible subdirectories holds logs, and no directory above is one
        below = files.select("_dir", "_up").distinct().filter(F.col("_dir").startswith(base + "/"))
        inner = F.split(F.expr(f"substring(_dir, {len(base) + 2})"), "/")
        candidates = below.filter(~F.exists(inner, lambda d: d.rlike(SKIPPED_DIR))).select(F.col("_up").alias("root")).distinct()
        parts = F.filter(F.split(F.expr(f"substring(root, {len(base) + 1})"), "/"), lambda d: d != "")
        above = candidates.select("root", F.explode(F.transform(
            F.sequence(F.lit(0), F.size(parts)),
            lambda n: F.concat_ws("/", F.lit(base), F.when(n > 0, F.array_join(F.slice(parts, 1, n), "/"))),
        )).alias("upper")).filter("upper <> root")
        shadowed = above.join(candidates.select(F.col("root").alias("upper")), "upper", "left_semi").select("root").distinct()
        roots = candidates.join(shadowed, "root", "left_anti")
    as_folder = files.filter(~_name(F.col("_dir")).rlike(SKIPPED_DIR)).withColumn("root", F.col("_up")).withColumn(
        "folder", _name(F.col("_dir"))).withColumn("loose", F.lit(False))
    as_loose = files.withColumn("root", F.col("_dir")).withColumn("folder", F.lit(None).cast("string")).withColumn(
        "loose", F.lit(True))
    every = as_folder.unionByName(as_loose).drop("_dir", "_up")
    if roots is None:
        return every.filter(F.col("root") == base)
    found = every.join(roots, "root", "left_semi")
    nothing = roots.agg(F.count("*").alias("_n"))  # without any root the given folder itself is one
    fallback = every.filter(F.col("root") == base).join(nothing, F.col("_n") == 0, "left_semi")
    return found.unionByName(fallback)


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:(//)?/", "/")


def list_logs(spark: SparkSession, base: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """(path, length, content) of every log below `base`; without content no file is opened."""
    files = spark.read.format("binaryFile").options(**READ_OPTIONS).load(base)
    columns = [_clean(F.col("path")).alias("path"), F.col("length")] + ([F.col("content")] if content else [])
    return files.select(*columns)


def read_logs(spark: SparkSession, bases: str | list[str], recursive: bool = True) -> DataFrame:
    """(root_no, root, folder, loose, path, length, content); `root_no` is the position in `bases`."""
    out = None
    for i, base in enumerate([bases] if isinstance(bases, str) else bases):
        part = locate(list_logs(spark, base, recursive), base, recursive).select(
            F.lit(i).alias("root_no"), "root", "folder", "loose", "path", "length", "content")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("folder", F.coalesce("folder", F.lit("")))


def read_log_lines(spark: SparkSession, base: str, recursive: bool = True, positions: bool = False) -> DataFrame:
    """Lines of the same files through the splittable text source.

    The source is read once and its rows are written with their place in the split, so numbers and lines come from one and the same reading.
    Inside a split rows come in file order: a line's place is its distance from the first line of its split plus the number of lines in earlier
    splits, two small aggregates instead of a sort.

    With `positions` also `byte_pos`, where the line starts in the file, and `raw_len`, its bytes with the line end: right for any
    encoding that keeps ASCII, LF, CRLF or CR line ends, a byte order mark, and a last line without an end. Files are cut at LF then, so one of CR ends
    only is read by one task.
    """
    reader = spark.read.options(**READ_OPTIONS)
    raw = materialise(
        (reader.option("lineSep", "\n") if positions else reader).text(base)
        .select(_clean(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_size").alias("_size"),
                F.monotonically_increasing_id().alias("_id"), F.col("value").cast("binary").alias("value")))
    lines = _placed(raw) if positions else _numbered(raw)
    located = locate(lines.select("path").distinct(), base, recursive).select(
        "path", F.lit(0).alias("root_no"), F.coalesce("folder", F.lit("")).alias("folder"), "loose")
    return lines.join(located, "path")


def _numbered(raw: DataFrame) -> DataFrame:
    splits = raw.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    splits = prefix_scan(splits, ["path"], ["_start"], {"_before": ("sum", F.col("_lines"))}, inclusive=False)
    return raw.join(splits.drop("_lines"), ["path", "_start"]).select(
        "path", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"), decode_line(F.col("value").cast("string")).alias("content"))


def _placed(raw: DataFrame) -> DataFrame:
    """(path, line_no, byte_pos, raw_len, content) of pieces that end at LF or at the end of the file."""
    latin = F.decode("value", "ISO-8859-1")
    cut = F.when(F.contains(latin, F.lit("\r")), F.split(latin, r"(?<=\r)")).otherwise(F.array(latin))
    # a carriage return before the line feed belongs to one line end with it
    cut = F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    rows = raw.withColumn("_cut", cut).withColumn("_len", F.octet_length("value").cast("bigint") + 1).withColumn("_block", F.floor(F.col("_id") / LINE_BLOCK))
    # the reader leaves out a byte order mark, and counts a line end after a last line that has none
    marks = raw.groupBy("path").agg(F.when(F.sum(F.octet_length("value") + 1) < F.max("_size"), F.lit(3)).otherwise(F.lit(0)).cast("bigint").alias("_mark"))
    rows = prefix_scan(rows, ["path"], ["_id"], {"_lines": ("sum", F.size("_cut")), "_bytes": ("sum", F.col("_len"))}, [["_start"], ["_block"]], inclusive=False, attach=marks)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("_lines", "_bytes", "_mark")})
    at = F.col("_bytes") + F.col("_mark")
    end = F.least(at + F.col("_len"), "_size")
    starts = F.transform("_cut", lambda _, i: F.aggregate(F.slice("_cut", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))
    starts = F.when(F.size("_cut") == 1, F.array(F.lit(0))).otherwise(starts)
    each = rows.select("path", "_lines", at.alias("_at"), end.alias("_end"), starts.alias("_starts"), F.posexplode("_cut").alias("_pos", "_text"))
    pos = F.col("_at") + F.element_at("_starts", F.col("_pos") + 1)
    after = F.when(F.col("_pos") + 1 == F.size("_starts"), F.col("_end")).otherwise(pos + F.length("_text"))
    text = F.encode(F.regexp_replace("_text", r"\r\z", ""), "ISO-8859-1").cast("string")
    return each.select("path", (F.col("_lines") + F.col("_pos")).alias("line_no"), pos.alias("byte_pos"), (after - pos).alias("raw_len"), decode_line(text).alias("content"))


def welcome_login(message: Column | str) -> Column:
    """Name on a login line, title-cased; NULL on other lines."""
    return _welcome(S.col(message), WELCOME_LOGIN)


def welcome_back(message: Column | str) -> Column:
    return _welcome(S.col(message), WELCOME_BACK)


def _welcome(m: Column, pattern: str) -> Column:
    return F.when(m.startswith("Welcome ") & m.rlike(java(pattern)), S.titlecase_name(F.regexp_extract(m, java(pattern), 1)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds `ts` (own, text), `message`, `welcome`, `login`, `file_ts`, `path_head`, `line_block`.

    All text work of attribution happens here, once; written as a table, the later scans read narrow columns.
    """
    # staged, so that the prefix is matched once per line
    staged = lines.withColumn("_prefix", S.stamp_prefix("content")).withColumn("_at", S.stamp_time("_prefix"))
    rest = F.expr("substring(content, length(_prefix) + 1)")
    return (
        staged.withColumn("ts", F.col("_at").cast("string"))
        .withColumn("message", F.when(F.col("_at").isNotNull(), rest).otherwise(F.col("content")))
        .drop("_prefix", "_at")
        .withColumn("login", welcome_login("message"))
        .withColumn("welcome", F.coalesce("login", welcome_back("message")))
        .withColumn("file_ts", S.filename_date(_name(F.col("path"))))
        .withColumn("path_head", path_head())
        .withColumn("line_block", line_block())
    )
