"""Foreign JSON lines to normalised records, as one projection compiled from a profile."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import UNIX_LAYOUTS, parse_layout_us
from tidemark.sources.profiles import FieldMap, HeartbeatMatch, Profile

DEFAULT_SOURCE = "assessed-source"
INTEGER = "^-?[0-9]{1,38}$"
MAX_UINT64 = "18446744073709551615"
# The Unicode White_Space characters, trimmed from both ends of a line.
WHITE_SPACE = " \t\n\v\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def json_paths(dotted: str) -> list[str]:
    """JSONPath spellings of a dotted path; a numeric segment may be an array index or an object key."""
    options = []
    for segment in dotted.split("."):
        spelled = ["['" + segment + "']"]
        if segment.isdigit():
            spelled.insert(0, f"[{int(segment)}]")
        options.append(spelled)
    return ["$" + "".join(parts) for parts in product(*options)]


def with_fields(df: DataFrame, fields: dict[str, str], variant: str = "_json", raw: str = "value") -> DataFrame:
    """Adds ``<name>_kind`` and ``<name>_text`` for each dotted path: null when absent or JSON null.

    Numbers keep their source text; an object or array has the text "". Every path is read once: the steps
    are separate projections, so that no later expression evaluates an earlier one again.
    """
    spelled = [(name, i, path) for name, dotted in fields.items() if dotted for i, path in enumerate(json_paths(dotted))]
    places = {(name, i): f"_{name}_{i}" for name, i, _ in spelled}
    found = df.withColumns({f"{places[n, i]}_v": F.try_variant_get(variant, path, "variant") for n, i, path in spelled})
    kinds = found.withColumns({f"{places[n, i]}_k": F.schema_of_variant(F.col(f"{places[n, i]}_v")) for n, i, _ in spelled})
    scalars, raws, texts = {}, {}, {}
    for name, i, path in spelled:
        place = places[name, i]
        kind, value, source_text = F.col(f"{place}_k"), F.col(f"{place}_s"), F.col(f"{place}_r")
        is_container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        absent = kind.isNull() | (kind == "VOID")
        scalars[f"{place}_s"] = F.when(~absent & ~is_container, F.try_variant_get(f"{place}_v", "$", "string"))
        # A whole number of 64 bits has one spelling, but for zero (-0): the line is searched again for the other numbers only.
        spelt = kind.isin("STRING", "BOOLEAN") | ((kind == "BIGINT") & (value != "0"))
        raws[f"{place}_r"] = F.when(value.isNotNull() & ~spelt, F.get_json_object(raw, path))
        # Of repeated keys the last one counts, but the raw reader finds the first: it is believed only for the same number.
        # Integers are compared digit by digit, as doubles cannot tell neighbours beyond 2^53 apart.
        whole = source_text.rlike(INTEGER) & value.rlike(INTEGER)
        same_number = F.when(whole, source_text.try_cast("decimal(38,0)").eqNullSafe(value.try_cast("decimal(38,0)"))).otherwise(
            source_text.try_cast("double").eqNullSafe(value.try_cast("double")))
        texts[f"{place}_t"] = (
            F.when(absent, F.lit(None)).when(is_container, F.lit("")).when(source_text.isNull(), value).when(same_number, source_text).otherwise(value))
    shown = kinds.withColumns(scalars).withColumns(raws).withColumns(texts)
    out = {}
    for name, dotted in fields.items():
        mine = [places[n, i] for n, i, _ in spelled if n == name]
        null = F.lit(None).cast("string")
        out[f"{name}_kind"] = F.coalesce(*[F.when(F.col(f"{m}_k") != "VOID", F.col(f"{m}_k")) for m in mine]) if mine else null
        out[f"{name}_text"] = F.coalesce(*[F.col(f"{m}_t") for m in mine]) if mine else null
    return shown.withColumns(out).drop(*[f"{m}_{c}" for m in places.values() for c in "vksrt"])


def parse_uint64(kind: Column, text: Column) -> Column:
    """Exact unsigned 64-bit value of a number or string; null for anything else."""
    wide = F.when(text.rlike("^[0-9]+$"), F.ltrim(text, F.lit("0")))
    value = F.when(F.length(wide) <= 20, F.when(wide == "", F.lit("0")).otherwise(wide).try_cast("decimal(20,0)"))
    fits = value <= F.lit(MAX_UINT64).cast("decimal(20,0)")
    usable = (kind == "STRING") | (~kind.isin("BOOLEAN") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"))
    return F.when(usable & fits, value)


def mapped_string(fm: FieldMap | None, fallback: str, text: str) -> Column:
    if fm is None:
        return F.lit(fallback)
    if fm.const:
        return F.lit(fm.const)
    last = fm.default or fallback
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(last)) if fm.field else F.lit(last)


def heartbeat_flag(hm: HeartbeatMatch | None, text: str) -> Column:
    if hm is None or not hm.field:
        return F.lit(False)
    return F.coalesce(F.col(text).isin(hm.equals, *hm.types), F.lit(False))


def map_lines(lines: DataFrame, profile: Profile, max_line_bytes: int | None = None) -> DataFrame:
    """Adds ``malformed`` and the normalised fields to lines with a ``value`` column.

    Blank lines are dropped. A line over a byte cap, where the caller names one, or whose first JSON value is neither an object nor
    null, is malformed. Other columns of ``lines`` (input, file, position) pass through.
    """
    profile.validate()
    caps = profile.capabilities()
    stamp = profile.timestamp
    trimmed = lines.withColumn("value", F.btrim("value", F.lit(WHITE_SPACE))).where(F.col("value") != "")
    too_long = F.lit(False) if max_line_bytes is None else F.octet_length("value") > max_line_bytes
    parsed = trimmed.withColumn("_json", F.when(~too_long, F.try_parse_json("value")))
    # What parses and starts like an object or null is one; anything else is malformed.
    starts = F.col("value").startswith("{") | F.col("value").startswith("null")
    malformed = F.col("_json").isNull() | ~starts

    mapped = {"f_source": profile.source_id, "f_time": stamp, "f_seq": profile.sequence if caps.sequenced else None,
              "f_type": profile.event_type, "f_actor": profile.actor, "f_beat": profile.heartbeat}
    # Mappings that name the same field share one extraction.
    paths = {name: fm.field for name, fm in mapped.items() if fm is not None and fm.field}
    first = {}
    for name, dotted in paths.items():
        first.setdefault(dotted, name)
    fields = with_fields(parsed, {name: dotted for dotted, name in first.items()})
    column = {name: first[dotted] for name, dotted in paths.items()}
    kind = lambda name: f"{column.get(name, '_none')}_kind"
    text = lambda name: f"{column.get(name, '_none')}_text"

    time_us = F.lit(None).cast("bigint")
    if stamp is not None and stamp.field:
        wanted = F.col(kind("f_time")) != "BOOLEAN" if stamp.layout in UNIX_LAYOUTS else F.col(kind("f_time")) == "STRING"
        time_us = F.when(wanted, parse_layout_us(F.col(text("f_time")), stamp.layout))
    seq = F.lit(None).cast("decimal(20,0)")
    if "f_seq" in paths:
        seq = parse_uint64(F.col(kind("f_seq")), F.col(text("f_seq")))
    return fields.select(
        *lines.columns,
        malformed.alias("malformed"),
        mapped_string(profile.source_id, DEFAULT_SOURCE, text("f_source")).alias("source_id"),
        seq.alias("seq"),
        time_us.alias("time_us"),
        mapped_string(profile.event_type, "", text("f_type")).alias("type"),
        mapped_string(profile.actor, "", text("f_actor")).alias("actor"),
        heartbeat_flag(profile.heartbeat, text("f_beat")).alias("heartbeat"),
    )
