"""Scalar helpers as column expressions. None of them needs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names that legacy exports list by mistake as characters.
BUNDLE_DIRECTORIES = [
    "contents", "frameworks", "resources", "macos", "_codesignature", "helpers", "plugins",
    "xpcservices", "sparkle.framework", "versions", "current", "updater.app", "autoupdate.app",
    "sparkle_relaunchhelper.app",
]
LEGACY_EPOCH_OFFSET = 978307200  # fixed value: 2001-01-01 in Unix seconds

RARITY_ORDER = ["Common", "Medium", "Rare", "Unique", "Exotic", "GM Only", "Unknown"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def trim_all(c: Column | str) -> Column:
    """Trim every Unicode blank, not only U+0020."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def ltrim_all(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def titlecase_name(c: Column | str) -> Column:
    """First letter upper, rest lower, per word; Roman numerals stay as they are."""
    return F.array_join(
        F.transform(
            words(c),
            lambda w: F.when(w.rlike("^[IVXLCDM]+$"), w).otherwise(
                F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
            ),
        ),
        " ",
    )


def titlecase_words(c: Column | str) -> Column:
    """First letter of each word upper; the rest of the word is kept."""
    return F.array_join(
        F.transform(words(c), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))),
        " ",
    )


def strip_article(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "^(?:an|a|the) ", "")


def normalise_profession(c: Column | str) -> Column:
    low = F.lower(col(c))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1_000_000))


def normalise_quotes(c: Column | str) -> Column:
    return F.translate(col(c), "“”‘’", "\"\"''")


def iequals(a: Column | str, b: Column | str) -> Column:
    """Equality that ignores ASCII case only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(col(a), upper, lower) == F.translate(col(b), upper, lower)


def log_day(c: Column | str) -> Column:
    """(year, month, day) as one comparable number, from ISO text or M/D/YY; NULL if neither."""
    c = col(c)
    num = lambda part: part.try_cast("bigint")
    iso = num(F.substring(c, 1, 4)) * 10000 + num(F.substring(c, 6, 2)) * 100 + num(F.substring(c, 9, 2))
    month, rest = F.substring_index(c, "/", 1), F.substring_index(c, "/", -1)
    day = F.substring_index(F.substring_index(c, "/", 2), "/", -1)
    short = num(F.when(F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) > 2, F.split(c, "/").getItem(2)).otherwise(rest))
    year = F.when(short >= 90, 1900 + short).otherwise(2000 + short)
    return F.when((F.length(c) >= 10) & (F.substring(c, 5, 1) == "-"), iso).when(
        F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) >= 2, year * 10000 + num(month) * 100 + num(day))


def date_after(log_date: Column | str, cutoff: Column | str) -> Column:
    """Strictly later day; texts that are no dates compare as text."""
    a, b = log_day(log_date), log_day(cutoff)
    return F.when(a.isNotNull() & b.isNotNull(), a > b).otherwise(col(log_date) > col(cutoff))


def hour_bucket(c: Column | str) -> Column:
    c = col(c)
    return F.when((F.length(c) >= 13) & (F.substring(c, 11, 1) == " "), F.substring(c, 1, 13)).otherwise(
        F.concat(F.substring(c, 1, 10), F.lit(" 00"))
    )


def date_only(c: Column | str) -> Column:
    return F.substring_index(F.coalesce(col(c), F.lit("")), " ", 1)


def two_hour_window(start: Column | str) -> Column:
    """'YYYY-MM-DD HH:00' to 'YYYY-MM-DD HH:00-HH:00' (en dash), wrapping at midnight."""
    s = col(start)
    hour = F.regexp_extract(s, "^[^ ]* ([0-9]+)", 1).try_cast("int")
    label = F.format_string("%s %02d:00–%02d:00", F.substring_index(s, " ", 1), hour, (hour + 2) % 24)
    return F.when(hour.isNotNull(), label).otherwise(s)


def csv_cell(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.rlike('[," ]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def seconds_of_day(ts_text: Column | str) -> Column:
    """Seconds since midnight from a log time such as '1/2/24 3:04:05p'; NULL if malformed."""
    pattern = r" ([0-9]+):([0-9]+):([0-9]+)([ap]?)$"
    c = col(ts_text)
    g = lambda i: F.regexp_extract(c, pattern, i)
    h = g(1).try_cast("int")
    h24 = (
        F.when((g(4) == "a") & (h == 12), F.lit(0)).when((g(4) == "p") & (h != 12), h + 12).otherwise(h)
    )
    return F.when(c.rlike(pattern), h24 * 3600 + g(2).try_cast("int") * 60 + g(3).try_cast("int"))


def within_seconds(later: Column, earlier: Column, limit: int = 15) -> Column:
    """True if `later` follows `earlier` by at most `limit` seconds, over midnight as well."""
    return F.pmod(later - earlier, F.lit(86400)) <= limit


def valid_character_name(c: Column | str) -> Column:
    c = col(c)
    return (c != "") & ~c.rlike(r"[./\\]") & ~F.lower(c).isin(BUNDLE_DIRECTORIES)


def legacy_date(c: Column | str) -> Column:
    """Seconds since 2001-01-01 as 'YYYY-MM-DD'; 0, NaN and NULL give NULL."""
    c = col(c).cast("double")
    seconds = (c + LEGACY_EPOCH_OFFSET).cast("bigint")  # by day number, so the session's zone plays no part
    return F.when(c.isNotNull() & (c != 0) & ~F.isnan(c),
                  F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string"))


def version_from_filename(path: Column | str) -> Column:
    """The part between 'bestiary_' and the next '_' of the file name; eight zeros if there is none."""
    name = F.element_at(F.split(col(path), "/"), -1)
    found = F.regexp_extract(name, "^bestiary_([^_]*)", 1)
    return F.when(name.startswith("bestiary_"), found).otherwise(F.lit("00000000"))


def filename_date(name: Column | str) -> Column:
    """'CL Log 2024:01:31 13.05.59[.txt]' to '2024-01-31 13:05:59'; NULL if it does not look like one."""
    inner = F.regexp_replace(F.regexp_extract(col(name), r"(?s)^CL Log (.*)$", 1), r"\.txt$", "")
    date = F.translate(F.substring_index(inner, " ", 1), ":_", "--")
    time = F.translate(_after_blank(inner), ".", ":")
    ok = inner.contains(" ") & (F.octet_length(date) >= 8) & date.contains("-")
    return F.when(ok, F.concat(date, F.lit(" "), time))


def _after_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^[^ ]* ", "")


# Fixed pattern: month/day/year, clock with optional a or p, one blank.
LINE_TS = r"^\+?[0-9]+/\+?[0-9]+/[+-]?[0-9]+ \+?[0-9]+:\+?[0-9]+:\+?[0-9]+[ap]? "


def stamp_prefix(content: Column | str) -> Column:
    """The timestamp at the head of a line with the blank behind it, or ''. The one expression per line."""
    c = col(content)
    return F.when((F.octet_length(c) >= 16) & F.substring(c, 1, 1).between("+", "9"), F.regexp_extract(c, LINE_TS, 0)).otherwise(F.lit(""))


def stamp_time(prefix: Column | str) -> Column:
    """TIMESTAMP_NTZ of a timestamp prefix; NULL for '' and for dates that do not exist."""
    p = col(prefix)
    date, clock = F.substring_index(p, " ", 1), F.substring_index(F.substring_index(p, " ", 2), " ", -1)
    half = F.when(clock.endswith("a") | clock.endswith("p"), F.right(clock, F.lit(1))).otherwise(F.lit(""))
    digits = F.rtrim(clock, F.lit("ap"))
    d = lambda i: F.split_part(date, F.lit("/"), F.lit(i)).try_cast("int")
    t = lambda i: F.split_part(digits, F.lit(":"), F.lit(i)).try_cast("int")
    hour = F.when((half == "a") & (t(1) == 12), F.lit(0)).when((half == "p") & (t(1) != 12), t(1) + 12).otherwise(t(1))
    # second 60 would roll over in the calendar function, so it is refused first
    return F.when((p != "") & t(3).between(0, 59) & d(3).between(-1999, 7999),
                  F.try_make_timestamp_ntz(d(3) + 2000, d(1), d(2), hour, t(2), t(3).cast("decimal(16,6)")))


def parse_line_ts(content: Column | str) -> Column:
    """STRUCT<ts TIMESTAMP_NTZ, message>. A line without a valid stamp is all message."""
    c = col(content)
    prefix = stamp_prefix(c)
    stamp = stamp_time(prefix)
    return F.struct(stamp.alias("ts"), F.when(stamp.isNotNull(), F.substring(c, F.length(prefix) + 1, F.length(c))).otherwise(c).alias("message"))


def ts_text(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def canonical_rarity(raw: Column | str) -> Column:
    """Lowest bucket named in the text; 'uncommon' is removed first; a lone 'extinct' is Unique."""
    t = F.regexp_replace(F.lower(F.coalesce(col(raw), F.lit(""))), "uncommon", "")
    return (
        F.when(t.contains("common"), F.lit("Common"))
        .when(t.contains("medium"), F.lit("Medium"))
        .when(t.contains("rare"), F.lit("Rare"))
        .when(t.contains("unique") | t.contains("boss"), F.lit("Unique"))
        .when(t.contains("exotic"), F.lit("Exotic"))
        .when(t.contains("gm only"), F.lit("GM Only"))
        .when(t.contains("extinct"), F.lit("Unique"))
        .otherwise(F.lit("Unknown"))
    )


def verb_text(verbs: Column) -> Column:
    """MAP verb->count as 'verb:n verb:n', sorted by verb."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(verbs)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))),
        " ",
    )
