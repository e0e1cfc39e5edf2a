r"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

White space of any kind and length is one space. Numbers, units after numbers and names (capitalised words inside a
sentence) become typed placeholders that keep their value as a slot; other tokens are words, and case is folded. Windows
of ``width`` tokens are hashed with slots reduced to their type and joined by hash, so a question asked again with other
numbers or names meets its template. Windows with names are also hashed with the names as words, so that a copy in other
capitals or with a name at the start of a line or sentence is met; a window counts if either form does. Matched windows on one
diagonal (document position minus item position) form an alignment, in which each value of a slot in the item stands for
one value in the document; windows that hold a slot of two values do not count. A document is contaminated by an item if
the windows of an alignment, or of neighbouring ones (words were put in or left out, up to as many as the item has), cover
at least ``coverage`` of the item's windows, or of those that have ``plain`` ordinary words besides their slots, or if
``verbatim`` words in a row are equal in both, whatever their share of the item.

Items shorter than ``width`` tokens are one window of their own length. Windows with fewer than ``plain`` words, and items
shorter than ``shortest``, would match anything of the kind: they are hashed with their values and met only by verbatim
copies. So every item with a token is in the index; one of a single word is met by every document with that word.

Documents meet the index by hashes alone first: windows of all forms, without their tokens, against the index's distinct
hashes. Only documents with a hit there, few of them, have their windows built in full. The work is linear in the length
of a text. Both forms of the index are written and measured; they are broadcast up to ``max_index`` hashes and
``MAX_BYTES`` bytes, and joined by a shuffle of both sides beyond. Hash joins give one row per matched window, never pairs
of documents.

Cases: null and empty texts match nothing; rows that repeat an id are one document, whose windows are united; null ids are
left out of the result and always kept by ``clean``; an empty table on either side gives no matches; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored_small, text_of, without_ids
from tidemark.sources.store import materialise

WIDTH, SHORTEST, PLAIN, COVERAGE, VERBATIM = 8, 4, 4, 0.3, 13
MAX_INDEX, MAX_BYTES = 1_000_000, 32 << 20
SLOT = "\x01"
# What Unicode calls white space, and the mark of slots; all of it is read as a space.
_BLANKS = SLOT + "\t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# Units that turn a number into a quantity.
UNITS = ("km cm mm m kg mg g lb oz l ml s ms min h hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal percent meters metres miles feet inches "
         "hours minutes seconds days weeks months years dollars euros pounds degrees").split()
_NUMBER = r"(?<![\p{L}\p{N}])\p{N}+(?:[.,:/]\p{N}+)*"
_UNIT = rf"({SLOT}N[^ ]+ )\s*((?i:{'|'.join(UNITS)})|[%€$£°])(?![\p{{L}}\p{{N}}])"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;:] \p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
_NOISE = rf"[^\p{{L}}\p{{N}}{SLOT}.,:/%€$£°]+|[.,:/%€$£°]+(?![\p{{N}}%€$£°])|(?<![\p{{N}}{SLOT}NU])[.,:/]+"


def _marked(text: Column) -> Column:
    """A text without noise: words, and slots as \\x01 + type (N, U, A) + value, with spaces between."""
    marked = F.regexp_replace(F.translate(text, _BLANKS, " " * len(_BLANKS)), _NUMBER, f" {SLOT}N$0 ")
    marked = F.regexp_replace(F.regexp_replace(marked, _UNIT, f"$1{SLOT}U$2 "), "  +", " ")
    marked = F.regexp_replace(marked, _NAME, f"{SLOT}A$0")
    return F.trim(F.regexp_replace(marked, _NOISE, " "))


def template_tokens(text: Column) -> Column:
    """Tokens of a text: words, slots as \\x01 + type (N, U, A) + value."""
    return F.filter(F.split(_marked(text), " +"), lambda t: t != "")


def _is_slot(token: Column) -> Column:
    return F.startswith(token, F.lit(SLOT))


def _value(token: Column) -> Column:
    return F.when(_is_slot(token), F.substring(token, 3, 1 << 30)).otherwise(token)


def _is_name(token: Column) -> Column:
    return F.startswith(token, F.lit(SLOT + "a"))


def template_windows(rows: DataFrame, id_col: str, text_col: str, widths: list[int], whole: bool, plain: int, shortest: int) -> DataFrame:
    """One row per window and form: id, at (position), template (hash), width, tokens (null where the window has no slot), open.

    The first form has names as words, and values too if there are fewer than ``plain`` words with them; the second, only of
    windows with names, has names as slots. ``open``: the window has ``plain`` ordinary words besides its slots. ``whole``: a row shorter than the largest width gives one window of all its
    tokens, if its length is in widths.
    """
    size = F.size("tokens")

    kinds = _kinds

    def words(i: Column, width: int, names: bool) -> Column:
        other = F.replace(kinds(i, width), F.lit("n"), F.lit(""))
        return F.length(other if names else F.replace(other, F.lit("a"), F.lit("")))

    def hashed(i: Column, width: int, of: str) -> Column:
        return F.xxhash64(F.lit(width), F.slice(of, i, F.lit(width)))

    def window(i: Column, width: int, template: Column, tokens: Column, is_open: Column) -> Column:
        return F.struct((i - 1).alias("at"), template.alias("template"), F.lit(width).alias("width"), tokens.alias("tokens"), is_open.alias("open"))

    def of(width: int) -> Column:
        here = (size >= width) if not whole else ((size == width) | ((size > width) & F.lit(width == max(widths))))
        starts = F.when(here, F.sequence(F.lit(1), size - (width - 1))).otherwise(F.array().cast("array<int>"))
        none = F.lit(None).cast("array<string>")
        least = plain if width >= shortest else width + 1  # no window has so many: only its exact form remains
        named = F.filter(starts, lambda i: F.contains(kinds(i, width), F.lit("a")) & (words(i, width, False) >= least))

        def simple(i: Column) -> Column:
            return window(i, width, hashed(i, width, "worded"), none, F.lit(width >= least))

        def slotted(i: Column) -> Column:
            template = F.when(words(i, width, True) >= least, hashed(i, width, "worded")).otherwise(hashed(i, width, "exact"))
            return window(i, width, template, F.slice("tokens", i, F.lit(width)), words(i, width, False) >= least)

        # Most windows have no slot, also in texts with some.
        mixed = F.transform(starts, lambda i: F.when(kinds(i, width) == "w" * width, simple(i)).otherwise(slotted(i)))
        names = F.transform(named, lambda i: window(i, width, hashed(i, width, "reduced"), F.slice("tokens", i, F.lit(width)), F.lit(True)))
        mixed = F.when(F.col("named"), F.concat(mixed, names)).otherwise(mixed)
        return F.when(F.col("slotted"), mixed).otherwise(F.transform(starts, simple))

    windows = of(widths[0]) if len(widths) == 1 else F.concat(*[of(w) for w in widths])
    return _coded(rows, id_col, text_col).select("id", F.explode(windows).alias("w")).select("id", "w.*")


def _kinds(i: Column, width: int) -> Column:
    """One letter per token of a window; taken from bytes, as a string would be walked from its start."""
    return F.substr("kinds", i, F.lit(width)).cast("string")


def _coded(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tokens, and per token its hash with names as words, with names as slots, with values, and its kind."""
    # Capitals have no "ß".
    base = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.replace(F.lower(_marked(text_of(text_col))), F.lit("ß"), F.lit("ss")).alias("marked"))
    base = base.select("id", F.contains("marked", F.lit(SLOT)).alias("slotted"), F.contains("marked", F.lit(SLOT + "a")).alias("named"), F.filter(F.split("marked", " +"), lambda t: t != "").alias("tokens"))
    # Generated rows keep the arrays from being computed once per window that reads them.
    coded = F.struct(
        "slotted", "named", "tokens",
        F.transform("tokens", lambda t: F.xxhash64(F.when(_is_slot(t), F.when(_is_name(t), _value(t)).otherwise(F.substring(t, 1, 2))).otherwise(t))).alias("worded"),
        F.when(F.col("named"), F.transform("tokens", lambda t: F.xxhash64(F.when(_is_slot(t), F.substring(t, 1, 2)).otherwise(t)))).alias("reduced"),
        F.when(F.col("slotted"), F.transform("tokens", lambda t: F.xxhash64(F.when(_is_name(t), _value(t)).otherwise(t)))).alias("exact"),
        F.when(F.col("slotted"), F.array_join(F.transform("tokens", lambda t: F.when(_is_slot(t), F.when(_is_name(t), F.lit("a")).otherwise(F.lit("n"))).otherwise(F.lit("w"))), "").cast("binary")).alias("kinds"))
    return base.select("id", F.explode(F.array(coded)).alias("c")).select("id", "c.*")


def with_hits(docs: DataFrame, id_col: str, text_col: str, widths: list[int], templates: DataFrame, max_rows: int) -> DataFrame:
    """The rows of docs that have a window, in any form, whose hash is among ``templates`` (one column, distinct)."""
    none = F.array().cast("array<int>")

    def of(width: int) -> Column:
        starts = F.when(F.size("tokens") >= width, F.sequence(F.lit(1), F.size("tokens") - (width - 1))).otherwise(none)
        slotted = F.when(F.col("slotted"), F.filter(starts, lambda i: _kinds(i, width) != "w" * width)).otherwise(none)
        def hashed(form: str, at: Column) -> Column:
            return F.transform(at, lambda i: F.xxhash64(F.lit(width), F.slice(form, i, F.lit(width))))

        return F.concat(hashed("worded", starts), hashed("exact", slotted), hashed("reduced", F.when(F.col("named"), slotted).otherwise(none)))

    hashes = of(widths[0]) if len(widths) == 1 else F.concat(*[of(w) for w in widths])
    hits = _coded(docs, id_col, text_col).select("id", F.explode(hashes).alias("template")).join(templates, "template", "left_semi")
    found = stored_small(hits.select(F.col("id").alias("_hit")).distinct(), "benchmark-met", max_rows)
    return docs.join(found, docs[id_col] == found["_hit"], "left_semi")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, shortest: int = SHORTEST, plain: int = PLAIN, coverage: float = COVERAGE,
                  verbatim: int = VERBATIM, max_index: int = MAX_INDEX) -> DataFrame:
    """One row per contaminated document and item: id, item, item_windows, matched, covered, same_values, start, end.

    ``start`` and ``end`` bound the passage in tokens of the document; ``same_values`` is false for a question asked again
    with other values. Of several passages the one that covers most stands, then one without gaps, then one with equal values, then the first.
    """
    items = materialise(template_windows(benchmark, item_col, item_text, list(range(1, width + 1)), True, plain, shortest), "benchmark-windows")
    # Which widths the benchmark needs: at most width values.
    used = sorted(r["width"] for r in items.select("width").distinct().collect()) or [width]
    sizes = items.groupBy(F.col("id").alias("item")).agg(
        F.countDistinct("at").alias("item_windows"), F.countDistinct(F.when(F.col("open"), F.col("at"))).alias("open_windows"),
        F.max(F.col("at") + F.col("width")).alias("item_size"))
    index = items.select(F.col("id").alias("item"), F.col("at").alias("item_at"), "template", F.col("tokens").alias("item_tokens"), F.col("open").alias("item_open"))
    in_bytes = F.lit(96) + F.coalesce(40 * F.size("item_tokens") + F.octet_length(F.array_join("item_tokens", "")), F.lit(0))
    index = F.broadcast(index) if (index.agg(F.sum(in_bytes.cast("bigint"))).first()[0] or 0) <= MAX_BYTES else index
    templates = stored_small(items.select("template").distinct(), "benchmark-index", max_index)
    docs = with_hits(docs, id_col, text_col, used, templates, max_index)
    # A window without tokens has no slot: where it meets names, they are equal as words.
    hits = template_windows(docs, id_col, text_col, used, False, plain, shortest).join(index, "template").select(
        "id", "item", "at", "item_at", "width", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_open",
        F.when(F.col("item_tokens").isNotNull(), F.coalesce("tokens", "item_tokens")).alias("tokens"), "item_tokens")
    values = [F.transform(c, _value) for c in ("tokens", "item_tokens")]
    hits = materialise(hits.withColumn("equal", F.coalesce(values[0] == values[1], F.lit(True))), "benchmark-hits")
    line = ["id", "item", "diagonal"]
    slots = hits.where("item_tokens is not null").select(*line, F.explode(F.arrays_zip(F.col("tokens").alias("d"), F.col("item_tokens").alias("i"))).alias("s"))
    slots = slots.where(_is_slot(F.col("s.i"))).select(*line, F.col("s.i").alias("slot"), _value(F.col("s.d")).alias("value"))
    bad = slots.groupBy(*line, "slot").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high")
    bad = bad.groupBy(*line).agg(F.collect_set("slot").alias("bad"))
    counted = hits.join(bad, line, "left").where(~F.coalesce(F.arrays_overlap("item_tokens", "bad"), F.lit(False))).join(sizes, "item")
    # Passages: one diagonal, or those that lie as far apart as the item is long; the two grids of twice that width hold them all.
    reach = F.col("item_size")
    grids = F.array(*[F.struct(F.lit(k).alias("grid"), place.cast("bigint").alias("place")) for k, place in enumerate((
        F.col("diagonal"), F.floor(F.col("diagonal") / (2 * reach)), F.floor((F.col("diagonal") + reach) / (2 * reach))))])
    passages = counted.withColumn("passage", F.explode(grids)).groupBy("id", "item", "passage", "item_windows", "open_windows").agg(
        F.countDistinct("item_at").alias("matched"), F.countDistinct(F.when(F.col("item_open"), F.col("item_at"))).alias("matched_open"),
        F.min("equal").alias("same_values"), F.min("at").alias("start"), F.max(F.col("at") + F.col("width")).alias("end"))
    covered = F.greatest(F.col("matched") / F.col("item_windows"), F.expr("try_divide(matched_open, open_windows)"))
    columns = ["id", "item", "item_windows", "matched", "covered", "same_values", "start", "end", "together"]
    kept = passages.withColumn("covered", covered).withColumn("together", F.col("passage.grid") == 0).where(F.col("covered") >= coverage).select(*columns)
    # Words in a row that are equal in both texts, whatever their share of the item.
    more = max(1, verbatim - width + 1) - 1
    runs = hits.where("equal").groupBy(*line).agg(F.sort_array(F.collect_set("item_at")).alias("places"))
    starts = F.filter("places", lambda p, k: F.get("places", k + more) == p + more)
    runs = runs.withColumn("starts", starts).where(F.size("starts") > 0).join(sizes.where(F.col("item_size") >= verbatim), "item")
    first, last = F.element_at("starts", 1), F.element_at("starts", -1)
    runs = runs.select("id", "item", "item_windows", F.size("places").cast("bigint").alias("matched"), (F.size("places") / F.col("item_windows")).alias("covered"),
                       F.lit(True).alias("same_values"), (F.col("diagonal") + first).alias("start"), (F.col("diagonal") + last + more + width).alias("end"),
                       F.lit(True).alias("together"))
    kept = kept.unionByName(runs)
    best = kept.groupBy("id", "item").agg(
        F.max(F.struct("covered", "together", "same_values", (-F.col("start")).alias("earlier"), "end", "matched", "item_windows")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.item_windows", "b.matched", "b.covered", "b.same_values",
                       (-F.col("b.earlier")).alias("start"), "b.end")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs without the contaminated documents."""
    return without_ids(docs, contamination(docs, benchmark, id_col, text_col, **rule).select(id_col), id_col, "contaminated")
