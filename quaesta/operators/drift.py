"""Schemas that drift between the files of a series: changes, renames, one unified table.

Records are profiled per (file, field) by partial aggregation (types, a sketch of the values, value
range), so what is compared between neighbouring files is one small row per field, however many
records a file has. The neighbouring file is found by blocks of time, so that a series holding a
third of all files is not ordered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaesta.common import durable, previous_in_order
from quaesta.functions.matching import assignment, name_similarity

CHANGES = "series string, file_name string, change string, field string, new_field string"
_TIME = r"_(\d{8}_\d{6})(?=[_.]|$)"


def json_type(value: Column) -> Column:
    """JSON type of a variant: string, number, boolean, array or object; null for JSON null."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t != "VOID", "number")
    )


def fields_of(records: DataFrame) -> DataFrame:
    """One row per record and top-level field: series, file_name, record_no, field, kind, value (text).

    A record that is null, no JSON object, or names a field twice has no fields.
    """
    r = records.filter(F.col("file_name").isNotNull()).select("series", "file_name", "record_no", F.try_parse_json("record").alias("__v"))
    r = r.filter(F.schema_of_variant("__v").startswith("OBJECT"))
    v = F.variant_get("__v", F.lit("$"), "map<string,variant>")
    r = r.select("series", "file_name", "record_no", F.explode(v).alias("field", "value"))
    return r.select("series", "file_name", "record_no", "field", json_type(F.col("value")).alias("kind"), F.col("value").cast("string").alias("value"))


def profiles(fields: DataFrame, buckets: int = 32) -> DataFrame:
    """One row per (series, file, field): kinds, sketch, low, high. Repeated records change nothing in it.

    The sketch is the least hash in each of `buckets` parts of the values' hashes: it never fills up,
    and two fields agree in a part if their least value there is the same.
    """
    number = F.regexp_replace("value", r'^"|"$', "").try_cast("double")
    h = F.xxhash64("value")
    part = fields.groupBy("series", "file_name", "field", "kind", F.when(F.col("value").isNotNull(), F.pmod(h, F.lit(buckets)).cast("int")).alias("bucket")).agg(
        F.min(h).alias("least"), F.min(number).alias("low"), F.max(number).alias("high")
    )
    part = part.groupBy("series", "file_name", "field").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "least"))).alias("s"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    # values of several types may share a part: the least of them counts
    least = F.array_sort(F.transform("s", lambda x: F.struct(x["bucket"], x["least"])))
    return part.select("series", "file_name", "field", "kinds", F.transform(F.filter(least, lambda x, i: (i == 0) | (F.get(least, i - 1)["bucket"] != x["bucket"])), lambda x: x["least"]).alias("sketch"), "low", "high")


def file_order(files: DataFrame) -> DataFrame:
    """series, file_name, previous: the file before in the series by the time in the name (then by name).

    A file without a time in its name comes before those with one.
    """
    t = F.coalesce(F.nullif(F.regexp_extract("file_name", _TIME, 1), F.lit("")), F.lit(""))
    f = files.select("series", "file_name", t.alias("at"))
    return previous_in_order(f, ["series"], "at", F.substring("at", 1, 11), "file_name", "previous").select("series", "file_name", "previous")


def _overlap(a: dict, b: dict) -> float:
    """Share of the smaller sketch that the other has too."""
    x, y = set(a["sketch"]), set(b["sketch"])
    return len(x & y) / max(1, min(len(x), len(y)))


def _value_similarity(a: dict, b: dict) -> float:
    """Agreement of two profiles: types, sketch overlap, and overlap of the value ranges."""
    if not len(a["kinds"]) or not len(b["kinds"]):
        return 0.5
    same = float(set(a["kinds"]) == set(b["kinds"]))
    overlap = _overlap(a, b)
    if pd.notna(a["low"]) and pd.notna(b["low"]):
        lo, hi = max(a["low"], b["low"]), min(a["high"], b["high"])
        span = max(a["high"], b["high"]) - min(a["low"], b["low"])
        overlap = max(overlap, 1.0 if span == 0 else max(0.0, (hi - lo) / span))
    return 0.5 * same + 0.5 * overlap


def _same_values(a: dict, b: dict, least: int = 8) -> float:
    """Agreement of values alone, 0 unless it says something: same types, `least` or more different
    values on both sides, and more than half of them shared."""
    if set(a["kinds"]) != set(b["kinds"]) or min(len(a["sketch"]), len(b["sketch"])) < least:
        return 0.0
    shared = _overlap(a, b)
    return shared if shared > 0.5 else 0.0


def match_fields(removed: list[dict], added: list[dict], threshold: float = 0.5) -> list[tuple[int, int]]:
    """Pairs (removed, added) that are the same field: maximum-weight matching on name and value similarity.

    Where the names have little in common, the values alone decide, if there are enough different ones.
    """

    def score(a: dict, b: dict) -> float:
        name = name_similarity(a["field"], b["field"])
        by_name = 0.0 if name < 0.45 else 0.75 * name + 0.25 * _value_similarity(a, b)
        return max(by_name, 0.9 * _same_values(a, b))

    flip = len(removed) > len(added)
    rows, cols = (added, removed) if flip else (removed, added)
    s = [[score(c, r) if flip else score(r, c) for c in cols] for r in rows]
    got = assignment([[-x if x >= threshold else 0.0 for x in row] for row in s])
    pairs = [(i, j) for i, j in enumerate(got) if j >= 0 and s[i][j] >= threshold]
    return [(j, i) for i, j in pairs] if flip else pairs


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            gone, new = [x for x in r.fields if not x["now"]], [x for x in r.fields if x["now"]]
            pairs = match_fields(gone, new) if gone and new else []
            out += [(r.series, r.file_name, "renamed", gone[i]["field"], new[j]["field"]) for i, j in pairs]
            out += [(r.series, r.file_name, "removed", x["field"], "") for i, x in enumerate(gone) if i not in {p[0] for p in pairs}]
            out += [(r.series, r.file_name, "added", x["field"], "") for j, x in enumerate(new) if j not in {p[1] for p in pairs}]
        yield pd.DataFrame(out, columns=["series", "file_name", "change", "field", "new_field"])


def schema_changes(records: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    """Every change of a top-level field against the previous file of the series (see CHANGES).

    change is added, removed, renamed or retyped. A file without any readable record has no fields:
    it is skipped, and the next file is compared with the one before. Fields whose values are all
    null have no type and are never retyped. The first file of a series has no changes. Rows with a
    null file_name are left out; a null series is a series of its own. `prof` are the records' profiles,
    if they are there already; they are written once, as they are compared with themselves.
    """
    prof = durable(profiles(fields_of(records))) if prof is None else prof
    order = file_order(prof.select("series", "file_name").distinct())
    same = lambda a, b: a.eqNullSafe(b)
    now = prof.join(order.filter("previous is not null").select(F.col("series").alias("s2"), F.col("file_name").alias("f2")), same(F.col("series"), F.col("s2")) & (F.col("file_name") == F.col("f2"))).drop("s2", "f2")
    nxt = order.filter("previous is not null").select(F.col("series").alias("s2"), F.col("file_name").alias("next_file"), "previous")
    before = prof.join(nxt, same(F.col("series"), F.col("s2")) & (F.col("file_name") == F.col("previous"))).select("series", F.col("next_file").alias("file_name"), "field", "kinds", "sketch", "low", "high")
    side = lambda d, flag: d.select("series", "file_name", "field", F.struct("kinds", "sketch", "low", "high").alias("p"), F.lit(flag).alias("now"))
    both = side(now, True).unionByName(side(before, False)).groupBy("series", "file_name", "field").agg(
        F.max(F.when(F.col("now"), F.col("p"))).alias("new"), F.max(F.when(~F.col("now"), F.col("p"))).alias("old")
    )
    retyped = both.filter((F.size("new.kinds") > 0) & (F.size("old.kinds") > 0) & (F.col("new.kinds") != F.col("old.kinds"))).select(
        "series", "file_name", F.lit("retyped").alias("change"), "field", F.lit("").alias("new_field")
    )
    p = F.coalesce("new", "old")
    one_sided = both.filter(F.col("new").isNull() | F.col("old").isNull()).groupBy("series", "file_name").agg(
        F.array_sort(F.collect_list(F.struct("field", F.col("new").isNotNull().alias("now"), p.kinds.alias("kinds"), p.sketch.alias("sketch"), p.low.alias("low"), p.high.alias("high")))).alias("fields")
    )
    return one_sided.mapInPandas(_changes, CHANGES).unionByName(retyped)


def _together(prof: DataFrame, pairs: list[tuple[str, str]]) -> dict[str, set[str]]:
    """Per name the names it shares a file with, among those linked to it by `pairs`."""
    if not pairs:
        return {}
    part: dict[str, set[str]] = {}
    for a, b in pairs:
        both = part.get(a, {a}) | part.get(b, {b})
        part.update(dict.fromkeys(both, both))
    linked = prof.sparkSession.createDataFrame([(u, min(p)) for u, p in part.items()], "field string, part string")
    sets = prof.join(F.broadcast(linked), "field").groupBy("series", "file_name", "part").agg(F.array_sort(F.collect_set("field")).alias("s"))
    sets = sets.filter(F.size("s") > 1).select("s").distinct()
    out: dict[str, set[str]] = {}
    for r in sets.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).filter("a < b").distinct().collect():
        out.setdefault(r["a"], set()).add(r["b"])
        out.setdefault(r["b"], set()).add(r["a"])
    return out


def canonical_names(changes: DataFrame, prof: DataFrame, limit: int = 10_000) -> dict[str, str]:
    """One name for each set of names joined by renames, the one used in most files.

    Names are schema, not data: they are read to the driver, and more than `limit` raise an error.
    Two names are joined only if no file has both; which of the renamed names occur together is found
    in Spark over all files, and only the distinct pairs (at most names squared) are read.
    """
    uses = {r["field"]: r["n"] for r in prof.groupBy("field").agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()}
    if len(uses) > limit:
        raise ValueError(f"more than {limit} field names")
    edges = changes.filter("change = 'renamed'").groupBy("field", "new_field").agg(F.count(F.lit(1)).alias("n")).collect()
    together = _together(prof, [(r["field"], r["new_field"]) for r in edges])
    root = {u: u for u in uses}
    members = {u: {u} for u in uses}
    for r in sorted(edges, key=lambda r: (-r["n"], r["field"], r["new_field"])):
        a, b = root[r["field"]], root[r["new_field"]]
        if a != b and not any(together.get(u, set()) & members[b] for u in members[a]):
            members[a] |= members.pop(b)
            for u in members[a]:
                root[u] = a
    best = {a: min(m, key=lambda u: (-uses[u], u)) for a, m in members.items()}
    return {u: best[root[u]] for u in uses}


def unified_records(records: DataFrame, fieldless: bool = False) -> DataFrame:
    """All records in one table: series, file_name, record_no, and a column for each canonical field.

    A column is double or boolean if all its non-null values are, otherwise the JSON text; a value
    that a record lacks is null. A repeated (file_name, record_no) is one record. Records without
    fields (null, unreadable, no object, '{}', a field named twice) are rows of nulls if `fieldless`,
    else left out; rows with a null file_name are left out.
    """
    fields = durable(fields_of(records))
    prof = durable(profiles(fields))
    names = canonical_names(schema_changes(records, prof), prof)
    kinds: dict[str, set[str]] = {}
    for r in prof.select("field", F.explode("kinds").alias("kind")).distinct().collect():
        kinds.setdefault(names[r["field"]], set()).add(r["kind"])
    canon = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]) if names else F.create_map(F.lit(""), F.lit(""))
    rows = fields.select("series", "file_name", "record_no", F.element_at(canon, F.col("field")).alias("name"), "value")
    rows = rows.groupBy("series", "file_name", "record_no", "name").agg(F.max("value").alias("value"))
    if fieldless:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(records.filter("file_name is not null").select("series", "file_name", "record_no", none.alias("name"), none.alias("value")))
    rows = rows.groupBy("series", "file_name", "record_no").agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))).alias("m"))
    cast = {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}
    cols, used = [], {"series", "file_name", "record_no"}
    for name in sorted(set(names.values())):
        c = F.try_element_at("m", F.lit(name))
        kind = cast.get(frozenset(kinds.get(name, ())))
        alias = name or "unnamed"
        while alias.lower() in used:  # clashing names, also those that differ in case only
            alias += "_field"
        used.add(alias.lower())
        cols.append((c.try_cast(kind) if kind else c).alias(alias))
    return rows.select("series", "file_name", "record_no", *cols)


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes by kind: number, and the number of files that show it first."""
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("file_name").alias("n_files"))
