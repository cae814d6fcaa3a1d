"""Questions of a conversation as standalone search queries: entities, abbreviations, pronouns, lexical form, variants.

Everything of one text is a Column.  What needs earlier turns is an as-of state:
the best entity of all earlier turns of a conversation, kept by a running
minimum in slices of turns, so that no conversation is ever gathered in a row or
sorted as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.storage import materialize

WORD = r"(?U)\w+"
ENTITY = "struct<type:string,value:string,confidence:double>"
PRONOUN = rf"(?iU)\b({'|'.join(L.PRONOUNS)})\b"
FIRST_PRONOUN = rf"(?isU)^(.*?)\b(?:{'|'.join(L.PRONOUNS)})\b"
SFS = r"(?U)\b(\d{4}:\d+)\b"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """The words of the lower-case text, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def with_value(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once a row: in the functions of ``filter`` or ``transform`` an outer expression is computed for every element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def entity(kind: str, value: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(confidence).alias("confidence"))


def _number(kind: str, sure: float, value: Column) -> Column:
    return entity(kind, value, sure)


def entities(text) -> Column:
    """Entities of a text as (type, value, confidence): numbers by pattern, then laws as words, then authorities anywhere."""
    t = _col(text)
    numbers = [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), partial(_number, kind, sure)) for kind, p, sure in L.ENTITY_PATTERNS]
    laws = F.transform(F.array_intersect(F.array(*(F.lit(n.lower()) for n in L.LAW_NAMES)), words(t)), lambda n: entity("lag", F.upper(n), L.LAW_CONFIDENCE))
    names = F.array(*(F.lit(n) for n in L.AUTHORITIES))
    bodies = F.transform(with_value(F.lower(t), lambda low: F.filter(names, lambda n: F.contains(low, F.lower(n)))), lambda n: entity("myndighet", n, L.AUTHORITY_CONFIDENCE))
    return F.coalesce(F.concat(*numbers, laws, bodies), F.array().cast(f"array<{ENTITY}>"))


def abbreviation_table(spark) -> DataFrame:
    """abbreviation and full_name, a later name for the same abbreviation winning."""
    return spark.createDataFrame(list(dict(L.ABBREVIATIONS).items()), "abbreviation string, full_name string")


def _dictionary() -> Column:
    return F.array(*(F.struct(F.lit(a).alias("a"), F.lit(f).alias("f"), F.lit(rf"(?iU)\b{a}\b").alias("p")) for a, f in dict(L.ABBREVIATIONS).items()))


def full_name(abbreviation) -> Column:
    """The full name of an abbreviation: as written, else whatever its case; null if unknown."""
    a, names = _col(abbreviation), dict(L.ABBREVIATIONS)
    pick = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    upper = {k.upper(): v for k, v in reversed(names.items())}  # the first of equal ones wins
    return F.coalesce(F.try_element_at(pick(names), a), F.try_element_at(pick(upper), F.upper(a)))


def _near(t: Column) -> Column:
    """The dictionary's entries that may stand in a text as words: patterns are tried for these alone.

    One with other signs than letters, or in a text with letters whose lower
    case is not that of their capitals, need only stand in it somewhere.
    """
    odd = F.contains(t, F.lit("ſ")) | F.contains(t, F.lit("ı")) | F.contains(t, F.lit("İ"))
    once = F.struct(F.lower(t).alias("low"), words(t).alias("held"), odd.alias("odd"))
    whole = lambda d: F.regexp_like(d.a, F.lit(r"(?U)^\w+$"))
    return with_value(once, lambda x: F.filter(_dictionary(), lambda d: F.when(whole(d) & ~x.odd, F.array_contains(x.held, F.lower(d.a))).otherwise(F.contains(x.low, F.lower(d.a)))))


def detected_abbreviations(text) -> Column:
    """The abbreviations that stand in a text as words, in the dictionary's order."""
    t = _col(text)
    return F.transform(F.filter(_near(t), lambda d: F.regexp_like(t, d.p)), lambda d: d.a)


def expand_abbreviations(text) -> Column:
    """(t, found): every abbreviation whose full name is not in the text yet, followed by it in brackets; one after the other."""
    t = F.coalesce(_col(text), F.lit(""))
    start = F.struct(t.alias("t"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, d: Column) -> Column:
        new = F.regexp_like(acc.t, d.p) & ~F.contains(F.lower(acc.t), F.lower(d.f))
        longer = F.regexp_replace(acc.t, d.p, F.concat(d.a, F.lit(" ("), d.f, F.lit(")")))
        return F.struct(F.when(new, longer).otherwise(acc.t).alias("t"), F.when(new, F.concat(acc.found, F.array(d.a))).otherwise(acc.found).alias("found"))

    return F.aggregate(_near(t), start, step)


def needs_rewrite(text) -> Column:
    """Whether a text has a pronoun, or three words at most and no entity."""
    t = _col(text)
    short = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")) <= 3
    return t.rlike(PRONOUN) | (short & (F.size(entities(t)) == 0))


def best_entity(found) -> Column:
    """(place in the priority, -confidence, index, value) of the entity that stands for a pronoun; null for none."""
    ranks = F.create_map(*(F.lit(x) for i, k in enumerate(L.ENTITY_PRIORITY) for x in (k, i)))
    return F.array_min(F.transform(_col(found), lambda e, i: F.struct(F.coalesce(F.try_element_at(ranks, e["type"]), F.lit(99)).alias("p"), (-e.confidence).alias("c"), i.alias("i"), e.value.alias("v"))))


def replace_pronoun(text, value) -> Column:
    """The text with its first pronoun replaced; unchanged without a value or a pronoun."""
    t, v = _col(text), _col(value)
    return F.when(v.isNotNull(), F.regexp_replace(t, F.lit(FIRST_PRONOUN), F.concat(F.lit("$1"), v))).otherwise(t)


def running_min(df: DataFrame, key: str, order: str, value: Column, name: str, slice_size: int = 1024) -> DataFrame:
    """``df`` with the minimum of ``value`` over the earlier rows of the key, by the whole number ``order``.

    A key's rows are cut into slices of the order; a slice's edge is the minimum
    of the slices before it, so a long key is many groups.
    """
    rows = df.withColumn("_s", F.floor(F.col(order) / slice_size)).withColumn("_v", value)
    edges = rows.groupBy(key, "_s").agg(F.min("_v").alias("_m"))
    earlier = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.min("_m").over(earlier).alias("_edge"))
    inside = Window.partitionBy(key, "_s").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_in", F.min("_v").over(inside)).join(edges, F.col(key).eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_t")))
    return met.withColumn(name, F.least("_edge", "_in")).drop("_s", "_v", "_in", "_k", "_t", "_edge")


def decontextualized(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``turns`` with ``needs`` and ``standalone``: the first pronoun replaced by the best entity of all earlier turns.

    The best is the one of the first type in the priority, then the surest, then
    the latest; within a turn the first.  Entities are found once and written
    without the texts.
    """
    thin = materialize(turns.select(conv, turn, best_entity(entities(text)).alias("_b")), "best_entities")
    value = F.when(F.col("_b").isNotNull(), F.struct(F.col("_b.p"), F.col("_b.c"), (-F.col(turn)).alias("n"), F.col("_b.i"), F.col("_b.v")))
    best = running_min(thin, conv, turn, value, "_best").where("_best IS NOT NULL")
    best = best.select(F.col(conv).alias("_k"), F.col(turn).alias("_t"), F.col("_best.v").alias("_v")).dropDuplicates(["_k", "_t"])  # the same for all rows of a turn
    met = turns.join(best, F.col(conv).eqNullSafe(F.col("_k")) & F.col(turn).eqNullSafe(F.col("_t")), "left").withColumn("needs", needs_rewrite(text))
    return met.withColumn("standalone", F.when(F.col("needs"), replace_pronoun(text, "_v")).otherwise(F.col(text))).drop("_k", "_t", "_v")


def lexical_query(text, found) -> Column:
    """Values of the entities, then the words of the text that are no stop words and not among them."""
    values = F.transform(_col(found), lambda e: e.value)
    kept = F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*L.LEXICAL_STOPWORDS))
    low = F.transform(values, F.lower)
    return F.array_join(F.concat(values, F.array_except(kept, low)), " ")


def rewritten(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``turns`` with needs, standalone, expanded, found, entities, must_include and lexical.

    Abbreviations that were expanded count as laws where no entity has their very spelling.
    Both steps are written once: later columns use their values many times.
    """
    out = decontextualized(turns, conv, turn, text).withColumn("_x", expand_abbreviations("standalone"))
    out = materialize(out, "standalone").withColumn("expanded", F.col("_x.t")).withColumn("found", F.col("_x.found")).drop("_x").withColumn("_e", entities("expanded"))
    spelled = F.transform("_e", lambda e: e.value)
    named = F.transform(F.array_except("found", spelled), lambda a: entity("lag", a, L.NAMED_LAW_CONFIDENCE))
    out = out.withColumn("entities", F.concat("_e", named)).drop("_e")
    must = F.transform(F.filter("entities", lambda e: e["type"].isin("lag", "sfs") & (e.confidence >= 0.9)), lambda e: e.value)
    return materialize(out.withColumn("must_include", must).withColumn("lexical", lexical_query("expanded", "entities")), "rewritten")


def keywords(text) -> Column:
    """Words of a paraphrase: longer than two characters and no stop words, repeats kept."""
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*L.PARAPHRASE_STOPWORDS))


def paraphrase(text, found) -> Column:
    """A question as keywords, by pattern; else the first law with known context; else the keywords of a short text; else null."""
    t = _col(text)
    low = F.trim(F.lower(t))
    case = None
    for pattern, to in L.QUESTION_PATTERNS:
        value = F.trim(F.regexp_replace(low, pattern, to))
        case = F.when(low.rlike(pattern), value) if case is None else case.when(low.rlike(pattern), value)
    context = F.create_map(*(F.lit(x) for pair in L.CONTEXT_WORDS for x in pair))
    known = F.filter(_col(found), lambda e: (e["type"] == "lag") & F.map_contains_key(context, F.upper(e.value)))
    law = F.try_element_at(known, F.lit(1))
    joined = F.array_join(keywords(t), " ")
    by_law = F.when(F.size(known) > 0, F.concat_ws(" ", law.value, F.try_element_at(context, F.upper(law.value)), joined))
    short = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")) <= 5
    return F.coalesce(case, by_law, F.when(short & (joined != ""), joined))


def variants(text, lexical, found, most: int = 3) -> Column:
    """A query, its lexical form and its paraphrase, without repeats, at most so many: (type, query)."""
    t, lex = _col(text), F.trim(_col(lexical))
    pair = lambda kind, q: F.struct(F.lit(kind).alias("type"), q.alias("query"))
    first = F.array(pair("semantic", t))
    second = F.when((lex != "") & (lex != t), F.array(pair("lexical", lex))).otherwise(F.array().cast("array<struct<type:string,query:string>>"))
    other = paraphrase(t, found)
    both = F.concat(first, second)
    third = F.when(other.isNotNull() & (other != "") & ~F.exists(both, lambda v: v["query"] == other), F.array(pair("paraphrase", other))).otherwise(F.array().cast("array<struct<type:string,query:string>>"))
    return F.slice(F.concat(both, third), 1, most)


def no_new_numbers(text, variants_of, found) -> Column:
    """Whether no variant but the first has a statute number that neither the text nor its entities have."""
    allowed = F.concat(F.regexp_extract_all(_col(text), F.lit(SFS), F.lit(1)), F.transform(F.filter(_col(found), lambda e: e["type"] == "sfs"), lambda e: e.value))
    new = F.flatten(F.transform(F.slice(_col(variants_of), 2, 1 << 20), lambda v: F.regexp_extract_all(v["query"], F.lit(SFS), F.lit(1))))
    return F.size(F.array_except(new, allowed)) == 0


def no_new_entities(rewrites: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", standalone: str = "standalone") -> DataFrame:
    """(conv, turn, grounded): whether every entity of a standalone query stands in its text or in an earlier turn.

    Each conversation's entities meet their first turn by a join on (conversation, value);
    the entities of a row are written once, without its texts.
    """
    low = lambda c: F.transform(entities(c), lambda e: F.lower(e.value))
    held = rewrites.select(conv, turn, text, standalone, low(text).alias("_held"))
    new = F.when(F.col(standalone).eqNullSafe(F.col(text)), F.array().cast("array<string>")).otherwise(F.array_except(low(standalone), "_held"))
    once = materialize(held.select(conv, turn, F.array_distinct("_held").alias("_held"), new.alias("_new")), "held_entities")
    first = once.select(conv, turn, F.explode("_held").alias("value")).groupBy(conv, "value").agg(F.min(turn).alias("_since"))
    added = once.select(conv, turn, F.explode("_new").alias("value"))
    met = added.join(first, [conv, "value"], "left").groupBy(conv, turn).agg(F.max((F.col("_since").isNull() | (F.col("_since") >= F.col(turn))).cast("int")).alias("_bad"))
    return once.select(conv, turn).join(met, [conv, turn], "left").select(conv, turn, (F.coalesce("_bad", F.lit(0)) == 0).alias("grounded"))
