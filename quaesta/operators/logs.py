"""Log lines into entries: header detection, continuation grouping, named-field patterns.

Scale: the only unbounded key is the log file. Rows are windowed in blocks of line numbers
(`block_lines`), so a file holding a third of all rows is spread over many tasks; what a block
needs to know of the earlier ones (open entry, days passed) comes from a table with one row per
block. One shuffle of the parsed lines; the text itself is not shuffled by `log_entries`. The entries
of the blocks are written once, as both the result and the table of blocks come from them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaesta.common import durable

# Header layouts, tried in this order among those that may begin alike. Group names: Y M D
# date, h m s time, z zone, e epoch seconds, l level, c component, t message.
LAYOUTS: list[tuple[str, str]] = [
    ("logfmt", r"^time=(?<Y>\d{4})-(?<M>\d\d)-(?<D>\d\d)[T ](?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)?(?<z>Z|[+-]\d\d:?\d\d)?(?: level=(?<l>\w+))?(?: component=(?<c>\S+))?(?: (?:msg=)?(?<t>.*))?"),
    ("tensor", r"^(?<Y>\d{4})-(?<M>\d\d)-(?<D>\d\d) (?<h>\d\d):(?<m>\d\d):(?<s>\d\d)\.\d+: (?<l>[DIWEFC]) (?<c>[^\s:\]]+)(?::\d+)?\] ?(?<t>.*)"),
    ("dashed", r"^(?<Y>\d{4})-(?<M>\d\d)-(?<D>\d\d)[T ](?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)?(?<z>Z| ?[+-]\d\d:?\d\d)? - (?<c>\S+) - (?<l>[A-Za-z]+) - (?<t>.*)"),
    ("bracketed", r"^(?<Y>\d{4})-(?<M>\d\d)-(?<D>\d\d)[T ](?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)?(?<z>Z| ?[+-]\d\d:?\d\d)? \[(?<c>[^\]]*)\] (?<l>(?i:debug|info|warn|warning|error|critical|fatal|notice|trace))\b:? ?(?<t>.*)"),
    ("arrowed", r"^\[(?<Y>\d{4})-(?<M>\d\d)-(?<D>\d\d)[T ](?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)?(?<z>Z| ?[+-]\d\d:?\d\d)?\] >>> (?:(?<c>[^\s:]+): )?(?<t>.*)"),
    ("dated", r"^\[?(?<Y>\d{4})-(?<M>\d\d)-(?<D>\d\d)[T ](?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)?(?<z>Z| ?[+-]\d\d:?\d\d)?\]?(?=[\s:,]|$)[\s:,]*(?:\[?(?<l>DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL)\]?\b:? *)?(?<t>.*)"),
    ("dayfirst", r"^(?<D>\d\d)/(?<M>\d\d)/(?<Y>\d{4}) (?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)? \| (?<l>\w+) *\| (?<c>[^|]*?) *\| ?(?<t>.*)"),
    ("syslog", r"^(?<M>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +(?<D>\d{1,2}) (?<h>\d\d):(?<m>\d\d):(?<s>\d\d) \S+ (?<c>[^\s\[:]+)(?:\[\d+\])?: (?:(?<l>debug|info|notice|warning|warn|err|error|crit|critical|alert|emerg|fatal): )?(?<t>.*)"),
    ("glog", r"^(?<l>[DIWEFC])(?<M>\d\d)(?<D>\d\d) (?<h>\d\d):(?<m>\d\d):(?<s>\d\d)\.\d+ +\d+ (?<c>[^\s:\]]+)(?::\d+)?\] ?(?<t>.*)"),
    ("clock", r"^\[(?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)?\] (?:(?<l>DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL)\b:? *)?(?<t>.*)"),
    ("angled", r"^(?<h>\d\d):(?<m>\d\d):(?<s>\d\d)(?:[.,]\d+)? <(?<c>[^>]*)> ?(?<t>.*)"),
    ("epoch", r"^(?<e>\d{10})(?:\.\d+)? \[(?<l>\w+)\] (?:(?<c>[^\s:]+): )?(?<t>.*)"),
]
# How the lines of each group of layouts begin; a line is tried in its group alone.
GROUPS: list[tuple[str, list[str]]] = [
    (r"^\d{4}-", ["tensor", "dashed", "bracketed", "dated"]),
    (r"^\[\d", ["arrowed", "dated", "clock"]),
    (r"^time=", ["logfmt"]),
    (r"^\d\d/", ["dayfirst"]),
    (r"^\d\d:", ["angled"]),
    (r"^\d{10}", ["epoch"]),
    (r"^[DIWEFC]\d", ["glog"]),
    (r"^[JFMASOND][a-z]", ["syslog"]),
]
# Words and letters for each level.
LEVELS = {
    "DEBUG": ["d", "debug", "trace", "verbose"],
    "INFO": ["i", "info", "notice", "information"],
    "WARNING": ["w", "warn", "warning"],
    "ERROR": ["e", "err", "error", "severe"],
    "CRITICAL": ["c", "f", "crit", "critical", "fatal", "alert", "emerg", "panic"],
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
JSON_KEYS = {"time": ["ts", "@timestamp", "timestamp", "time"], "l": ["level", "severity", "lvl", "levelname"], "c": ["logger", "component", "name"], "t": ["msg", "message", "event"]}
_FIELDS = "YMDhmszelct"
_SEP, _MARK = "\u0001", "\u0002"
_NAME_TIME = r"_(\d{4})(\d\d)(\d\d)_(\d\d)(\d\d)(\d\d)(?:[_.]|$)"


def _cascade(names: list[str]) -> tuple[str, str]:
    """One pattern for several layouts, and the replacement that writes the fields in the order of
    _FIELDS, missing ones empty: each field is the group of whichever layout took part.

    Spark's regular expressions take group numbers. Messages may hold carriage returns and the like.
    """
    groups: dict[str, list[int]] = {n: [] for n in _FIELDS}
    n, parts = 0, []
    for name, pattern in LAYOUTS:
        if name in names:
            for g in re.findall(r"\(\?<([A-Za-z])>", pattern):
                n += 1
                groups[g].append(n)
            parts.append(re.sub(r"\(\?<[A-Za-z]>", "(", pattern).removeprefix("^"))
    refs = ["".join(f"${i}" for i in groups[g]) for g in _FIELDS]
    return rf"(?s)^(?:{'|'.join(parts)})\z", _MARK + _SEP.join(refs)


def header_fields(line: Column) -> Column:
    """The fields of a header line as one string, marked by U+0002 and joined by U+0001 in the order of
    _FIELDS; null or anything without the mark for other lines."""
    iso = r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,]\d+)?(Z| ?[+-]\d\d:?\d\d)?$"
    num = r"^(\d{10})(?:\.\d+)?$"
    first = lambda keys: F.coalesce(*[F.get_json_object(line, f"$['{k}']") for k in keys])
    stamp = first(JSON_KEYS["time"])
    stamp = F.when(stamp.rlike(iso), F.regexp_replace(stamp, iso, _SEP.join(["$1", "$2", "$3", "$4", "$5", "$6", "$7", ""]))).when(
        stamp.rlike(num), F.concat(F.lit(_SEP * 7), F.regexp_replace(stamp, num, "$1"))
    )
    rest = [F.coalesce(first(JSON_KEYS[n]), F.lit("")) for n in "lct"]
    raw = F.when(line.startswith("{"), F.when(line.rlike(r'"(?:@?timestamp|ts|time)"\s*:'), F.when(stamp.isNotNull(), F.concat(F.lit(_MARK), F.concat_ws(_SEP, stamp, *rest)))))
    for begins, names in GROUPS:
        raw = raw.when(line.rlike(begins), F.regexp_replace(line, *_cascade(names)))
    return raw


def with_header(lines: DataFrame, line: str = "line", out: str = "f") -> DataFrame:
    """lines with the fields of header lines, null for all other lines; each line is parsed once."""
    return lines.withColumn("__raw", header_fields(F.col(line))).withColumn(out, F.when(F.col("__raw").startswith(_MARK), F.substr("__raw", F.lit(2)))).drop("__raw")


def typed_header(fields: Column, log_file: Column) -> Column:
    """Struct of a header's `header_fields`: secs (UTC; null if the header has no date), tod (seconds of
    day, only where it has no date), level, component, message. Null if date or time is impossible."""
    parts = F.split(fields, _SEP, len(_FIELDS))
    f = {n: F.get(parts, i) for i, n in enumerate(_FIELDS)}
    n = lambda c: c.try_cast("int")
    file_part = lambda i: n(F.regexp_extract(log_file, _NAME_TIME, i))
    clock = F.when((n(f["h"]) < 24) & (n(f["m"]) < 60) & (n(f["s"]) < 61), n(f["h"]) * 3600 + n(f["m"]) * 60 + F.least(n(f["s"]), F.lit(59)))
    month = F.coalesce(n(f["M"]), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(f["M"])), F.lit(0)).cast("int"))
    date = lambda y: F.format_string("%04d-%02d-%02d", y, month, n(f["D"])).try_cast("date")
    year = F.coalesce(n(f["Y"]), file_part(1))
    own = date(year)
    start = F.format_string("%04d-%02d-%02d", file_part(1), file_part(2), file_part(3)).try_cast("date")
    # without a year, the header lies in the year after the file's if it would come half a year before the file
    late = f["Y"].eqNullSafe("") & (F.datediff(own, start) < -183)
    day = F.unix_date(F.when(late, date(year + 1)).otherwise(own)).cast("long")
    zone = F.regexp_extract(f["z"], r"([+-]\d\d):?\d\d", 1)
    minutes = n(F.regexp_extract(f["z"], r"[+-]\d\d:?(\d\d)", 1))
    offset = F.when(zone == "", 0).otherwise(n(zone) * 3600 + F.when(zone.startswith("-"), -60).otherwise(60) * minutes)
    secs = F.when(f["e"] != "", f["e"].try_cast("long")).when(f["D"] != "", day * 86400 + clock - offset)
    tod = F.when((f["e"] == "") & (f["D"] == ""), clock.cast("long"))
    level = F.lit("")
    for name, words in LEVELS.items():
        level = F.when(F.lower(f["l"]).isin(words), name).otherwise(level)
    return F.when(
        secs.isNotNull() | tod.isNotNull(),
        F.struct(secs.alias("secs"), tod.alias("tod"), level.alias("level"), f["c"].alias("component"), f["t"].alias("message")),
    )


def _stamp(secs: Column) -> Column:
    day, rest = F.floor(secs / 86400), F.pmod(secs, F.lit(86400))
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"),
        F.format_string(" %02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60),
    )


def _in_order(item: Column) -> Column:
    """Aggregate: texts of structs (order, text) joined by line feeds in their order; null if there are none."""
    got = F.array_sort(F.collect_list(item))
    return F.when(F.size(got) > 0, F.array_join(F.transform(got, lambda x: x["text"]), "\n"))


def log_entries(lines: DataFrame, block_lines: int = 50_000, message: bool = False) -> DataFrame:
    """One row per log entry: log_file, first_line, last_line, logged_at, level, component.

    `lines` needs log_file, line_no and line; other columns are ignored. A repeated (log_file,
    line_no) is one line. An entry reaches to the line before the next header of its file; lines
    before the first header belong to none. With message=True the message is added: the header's and,
    in line order, all further lines of the entry, joined by line feeds (a null line is empty).
    Defined cases: null or blank lines continue an entry; rows with null log_file or line_no are
    no lines of any file and are left out; headers without date in a file whose name states no
    date get a null logged_at; an empty table gives an empty result.
    """
    fields = F.col("f") if message else F.substring_index("f", _SEP, len(_FIELDS) - 1)
    rows = with_header(lines.filter(F.col("log_file").isNotNull() & F.col("line_no").isNotNull()).select("log_file", "line_no", "line")).select(
        "log_file", "line_no", F.floor(F.col("line_no") / block_lines).alias("block"), fields.alias("f"), *([F.col("line")] if message else [])
    )
    rows = rows.repartition("log_file", "block").groupBy("log_file", "block", "line_no").agg(F.max("f").alias("f"), *([F.max("line").alias("line")] if message else []))
    rows = rows.withColumn("h", typed_header(F.col("f"), F.col("log_file"))).drop("f")
    w = Window.partitionBy("log_file", "block").orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.withColumn("first_line", F.last(F.when(F.col("h").isNotNull(), F.col("line_no")), ignorenulls=True).over(so_far))
        .withColumn("prev_tod", F.last("h.tod", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("backs", F.sum(F.when(F.col("h.tod") < F.col("prev_tod"), 1).otherwise(0)).over(so_far))
    )
    entries = rows.groupBy("log_file", "block", "first_line").agg(
        F.max("line_no").alias("last_line"),
        F.max("h").alias("h"),
        F.min("backs").alias("backs"),
        *([_in_order(F.when(F.col("h").isNull(), F.struct("line_no", F.coalesce("line", F.lit("")).alias("text")))).alias("more")] if message else []),
    )
    entries = durable(entries)
    blocks = entries.groupBy("log_file", "block").agg(
        F.max("first_line").alias("last_header"),
        F.max(F.when(F.col("first_line").isNull(), F.col("last_line"))).alias("pre_last"),
        F.min_by("h.tod", F.when(F.col("h.tod").isNotNull(), F.col("first_line"))).alias("first_tod"),
        F.max_by("h.tod", F.when(F.col("h.tod").isNotNull(), F.col("first_line"))).alias("last_tod"),
        F.max("backs").alias("backs_inside"),
        *([F.max(F.when(F.col("first_line").isNull(), F.col("more"))).alias("pre_more")] if message else []),
    )
    wb = Window.partitionBy("log_file").orderBy("block")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    n = lambda i: F.regexp_extract("log_file", _NAME_TIME, i).try_cast("int")
    blocks = (
        blocks.withColumn("start_tod", (n(4) * 3600 + n(5) * 60 + n(6)).cast("long"))
        .withColumn("start_day", F.unix_date(F.format_string("%04d-%02d-%02d", n(1), n(2), n(3)).try_cast("date")))
        .withColumn("seg", F.coalesce(F.sum(F.when(F.col("last_header").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)))
        .withColumn("pre_max", F.max("pre_last").over(Window.partitionBy("log_file", "seg")))
        .withColumn("extension", F.lead("pre_max").over(wb))
        .withColumn("entry_back", F.when(F.col("first_tod") < F.coalesce(F.last("last_tod", ignorenulls=True).over(before), "start_tod"), 1).otherwise(0))
        .withColumn("days_before", F.coalesce(F.sum(F.col("backs_inside") + F.col("entry_back")).over(before), F.lit(0)) + F.col("entry_back"))
        .select("log_file", "block", "last_header", "extension", "days_before", "start_day", *(["seg", "pre_more"] if message else []))
    )
    if message:
        # what the blocks after an entry's own have of it before their first header
        tails = blocks.filter(F.col("pre_more").isNotNull()).groupBy("log_file", (F.col("seg") - 1).alias("seg")).agg(_in_order(F.struct("block", F.col("pre_more").alias("text"))).alias("tail"))
        blocks = blocks.drop("pre_more").join(tails, ["log_file", "seg"], "left")
    e = entries.filter(F.col("first_line").isNotNull()).join(blocks, ["log_file", "block"])
    secs = F.coalesce("h.secs", (F.col("start_day") + F.col("days_before") + F.col("backs")) * 86400 + F.col("h.tod"))
    return e.select(
        "log_file",
        "first_line",
        F.when(F.col("first_line") == F.col("last_header"), F.greatest("last_line", "extension")).otherwise(F.col("last_line")).alias("last_line"),
        _stamp(secs).alias("logged_at"),
        F.col("h.level").alias("level"),
        F.col("h.component").alias("component"),
        *([F.concat_ws("\n", "h.message", "more", F.when(F.col("first_line") == F.col("last_header"), F.col("tail"))).alias("message")] if message else []),
    )


def log_lines(lines: DataFrame, block_lines: int = 50_000) -> DataFrame:
    """Every line with the entry it belongs to (entry_line null before a file's first header).

    Lossless counterpart of `log_entries`: log_file, line_no, line, entry_line. A repeated
    (log_file, line_no) is one line; the greatest text is kept should its texts differ.
    """
    rows = with_header(lines.filter(F.col("log_file").isNotNull() & F.col("line_no").isNotNull()).select("log_file", "line_no", "line", F.floor(F.col("line_no") / block_lines).alias("block")))
    rows = rows.repartition("log_file", "block").groupBy("log_file", "block", "line_no").agg(F.max("line").alias("line"), F.max("f").alias("f"))
    rows = rows.withColumn("is_header", typed_header(F.col("f"), F.col("log_file")).isNotNull()).drop("f")
    w = Window.partitionBy("log_file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last(F.when(F.col("is_header"), F.col("line_no")), ignorenulls=True).over(w))
    wb = Window.partitionBy("log_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("log_file", "block").agg(F.max("own").alias("last_header"))
    blocks = blocks.withColumn("open", F.last("last_header", ignorenulls=True).over(wb)).drop("last_header")
    return rows.join(blocks, ["log_file", "block"]).select("log_file", "line_no", "line", F.coalesce("own", "open").alias("entry_line"))


def level_counts(entries: DataFrame) -> DataFrame:
    """Entries per component and level with the time span; partial aggregation before the shuffle."""
    return entries.groupBy("component", "level").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum(F.col("last_line") - F.col("first_line")).alias("n_more_lines"),
        F.min("logged_at").alias("first_at"),
        F.max("logged_at").alias("last_at"),
    )
