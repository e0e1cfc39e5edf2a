"""Checkpoint notes: text form, parsing, signature lines, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.hashing import base64_text

# Fixed value: a signature line starts with an em dash and a space.
SIGNATURE_PREFIX = "— "
_BODY_END = "\n\n"


def checkpoint_text(origin: Column, size: Column, root: Column, extensions: Column | None = None) -> Column:
    """Body of a checkpoint: origin, size, base64 root and extension lines, each ended by a newline."""
    head = F.concat(origin, F.lit("\n"), size.cast("string"), F.lit("\n"), base64_text(root), F.lit("\n"))
    if extensions is None:
        return head
    return F.concat(head, F.array_join(F.transform(extensions, lambda e: F.concat(e, F.lit("\n"))), ""))


def note_body(note: Column) -> Column:
    """The signed text: everything up to the last blank line, its newline included; null without one."""
    cut = F.length(note) - F.locate("\n\n", F.reverse(note)) - 1
    return F.when(F.contains(note, F.lit(_BODY_END)), F.substring(note, F.lit(1), cut + 1))


def note_signatures(note: Column) -> Column:
    """The lines after the last blank line; null when the block is missing or not ended by a newline."""
    cut = F.length(note) - F.locate("\n\n", F.reverse(note)) - 1
    block = F.substring(note, cut + 3, F.length(note))
    usable = F.contains(note, F.lit(_BODY_END)) & (block != "") & block.endswith("\n")
    return F.when(usable, F.split(F.rtrim(block, F.lit("\n")), "\n"))


def strict_base64(text: Column) -> Column:
    """Decoded bytes, or null for anything that is not padded standard base64."""
    return F.when(text.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(text))


def parse_body(text: Column) -> Column:
    """struct<origin, size decimal(20,0), root binary, extensions>; null when malformed."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    size_text = F.get(lines, F.lit(1))
    significant = F.ltrim(size_text, F.lit("0"))
    size = F.when(size_text.rlike("^[0-9]+$") & (F.length(significant) <= 20),
                  F.when(significant == "", F.lit("0")).otherwise(significant).try_cast("decimal(20,0)"))
    size = F.when(size <= F.lit("18446744073709551615").cast("decimal(20,0)"), size)
    root = strict_base64(F.get(lines, F.lit(2)))
    good = text.endswith("\n") & (F.size(lines) >= 3) & size.isNotNull() & (F.octet_length(root) == 32)
    return F.when(good, F.struct(
        F.get(lines, F.lit(0)).alias("origin"), size.alias("size"), root.alias("root"),
        F.slice(lines, 4, F.greatest(F.size(lines) - 3, F.lit(0))).alias("extensions")))


def parse_checkpoint(note: Column) -> Column:
    """Checkpoint of a signed note, signature unchecked."""
    return parse_body(note_body(note))


def signature_lines(note: Column) -> Column:
    """array<struct<key_name, key_id hex, signature>>; null when any line is malformed."""
    lines = note_signatures(note)

    def fields(line: Column) -> Column:
        rest = F.substring(line, len(SIGNATURE_PREFIX) + 1, 1 << 30)
        name = F.substring_index(rest, " ", 1)
        blob = strict_base64(F.substring(rest, F.length(name) + 2, F.length(rest)))
        return F.struct(
            name.alias("key_name"), F.lower(F.hex(F.substring(blob, 1, 4))).alias("key_id"),
            F.substring(blob, 5, 64).alias("signature"), F.octet_length(blob).alias("size"),
            (line.startswith(SIGNATURE_PREFIX) & F.contains(rest, F.lit(" "))).alias("shaped"))

    parsed = F.transform(lines, fields)
    return F.when(F.forall(parsed, lambda s: s["shaped"]), parsed)


def checkpoint_id(origin: Column, size: Column, root: Column) -> Column:
    """Citable identity: origin@size root=first 12 base64 characters."""
    return F.concat(origin, F.lit("@"), size.cast("string"), F.lit(" root="), F.substring(base64_text(root), 1, 12), F.lit("…"))


def next_key_name(name: Column) -> Column:
    """The name after a rotation: -g2 appended, or the generation of an existing -gN suffix raised."""
    generation = F.regexp_extract(name, r"-g[+]?([0-9]{1,18})$", 1).try_cast("bigint")
    base = F.regexp_replace(name, r"-g[+]?[0-9]{1,18}$", "")
    return F.when(generation >= 1, F.concat(base, F.lit("-g"), (generation + 1).cast("string"))
                  ).otherwise(F.concat(name, F.lit("-g2")))


def sanitize_source(source: Column) -> Column:
    return F.translate(source, "/ \\.", "____")


def short_hash(text: Column) -> Column:
    return F.when(F.length(text) <= 8, text).otherwise(F.concat(F.left(text, F.lit(4)), F.lit("…"), F.right(text, F.lit(4))))


def plural(n: Column, unit: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {unit}")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s")))
