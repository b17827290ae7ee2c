"""Free typing to the entry of a canonical list, by token repair and soft TF-IDF.

Texts fold to phrases (lower-case words, digits that stand for letters undone), and only distinct phrases and distinct tokens are worked on.
Each distinct token is repaired once against the list's vocabulary: equal words, words within edit distance (found through shared
deletions, so no pair is looked at that shares none), words begun or abbreviated, and tokens that run several words together or are
halves of one. The corrected tokens of a phrase are then combined: an entry scores the soft TF-IDF mass of its words that the phrase
has, in any order, over the mass of all its words, lowered by the mass of list words in the phrase that are not the entry's. An entry
above ``LEAST`` is met through one of its weightiest words, because the others alone cannot reach it: the postings of common words
are never read, and no list is too long. The best entry is meant if it stands alone; equally good ones stay as alternatives that a
second value may settle.

Edge cases: null and blank values name nobody; a value that names someone not on the list gives 0; so do equal scores that nothing
settles; words of an entry's town or sector never count against it; repeated rows give one result; an empty list maps everything to 0;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import case_folded, decomposed

#: The least score of an entry that is meant.
LEAST = 0.42
#: The score of an entry of which a phrase has all words that name it and no other.
NAMED = 0.7
#: Scores closer than this are equally good.
MARGIN = 0.02
#: Letters up to which words meet in shared deletions; beyond, in shared pieces.
LONG = 38
#: From this many different entries beside it on, a value without any word of the list is a placeholder and names nobody.
PLACEHOLDER_ENTRIES = 3
#: Phrases that name nobody even in tables too small to show it.
PLACEHOLDERS = ("n a", "na", "none", "null", "unknown", "tbc", "misc")

# Digits typed for letters.
DIGITS, LETTERS = "013457", "oieast"
# Company forms and articles, which name nobody by themselves.
COMPANY_FORMS = ("co", "company", "corp", "inc", "limited", "llp", "ltd", "plc", "the", "and", "sons")
# How a descriptor prints a day.
DAY = r"^\d{1,2}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\d*$"

ALTS = "array<struct<ws: array<struct<w: string, g: double>>, sim: double>>"


def tokens(text: Column) -> Column:
    """Lower-case words without accents; digits in a word of at least as many letters become letters, other words
    with digits and days drop out."""
    folded = F.regexp_replace(case_folded(decomposed(text)), r"[’'`]", "")
    words = F.split(folded, r"[^\p{L}\p{N}]+")
    letters = lambda w: F.length(F.regexp_replace(w, r"\p{N}", ""))
    spelled = F.transform(words, lambda w: F.when(w.rlike(r"\p{N}"), F.when((2 * letters(w) >= F.length(w)) & ~w.rlike(DAY), F.translate(w, DIGITS, LETTERS))).otherwise(w))
    return F.filter(spelled, lambda w: w.isNotNull() & (w != "") & ~w.rlike(r"\p{N}"))


def phrase(text: Column) -> Column:
    """The tokens of a text in one string; '' when it has none."""
    return F.coalesce(F.concat_ws(" ", tokens(text)), F.lit(""))


def deletions(word: str, twice: int) -> Column:
    """The distinct strings that a word leaves with one letter deleted, or up to two from a length of `twice` on."""
    one = "transform(sequence(1, length({0})), i -> concat(substr({0}, 1, i - 1), substr({0}, i + 1)))"
    two = f"flatten(transform({one.format(word)}, w -> {one.format('w')}))"
    return F.expr(f"array_distinct(concat(array({word}), {one.format(word)}, if(length({word}) >= {twice}, {two}, CAST(array() AS array<string>))))")


def segments(length: str, pick: str) -> str:
    """SQL for the three pieces into which a form of `length` letters is cut: of two edits one leaves a piece whole. `pick` maps ``i, start, size``."""
    return f"transform(array(0, 1, 2), i -> named_struct('i', i, 'start', i * ({length} div 3) + 1, 'size', if(i < 2, {length} div 3, {length} - 2 * ({length} div 3)), 'whole', {length}))".join(["transform(", f", s -> {pick})"])


def repairs(words: DataFrame, forms: DataFrame, longest: int) -> DataFrame:
    """``token, form, dist``: the forms within reach of each distinct token, swapped neighbours counting one.

    Reach: none below four letters, one edit below six, two from then on; tokens more than two letters longer than the `longest` form
    reach none. Short forms and tokens meet in shared deletions, longer ones in shared pieces.
    """
    left = words.select("token").where(f"length(token) BETWEEN 3 AND {longest + 2}").distinct()
    right = forms.where("length(form) > 3").select("form").distinct()
    near = left.where(f"length(token) <= {LONG + 2}").select("token", F.explode(deletions("token", 6)).alias("_key")).join(right.where(f"length(form) <= {LONG}").select("form", F.explode(deletions("form", 6)).alias("_key")), "_key")
    if longest > LONG:
        key = "concat_ws(':', s.whole, s.i, substr({0}, s.start + {1}, s.size))"
        mine = segments("whole", "transform(sequence(-2, 2), d -> if(s.start + d > 0, " + key.format("token", "d") + ", ''))")
        long_left = left.where(f"length(token) > {LONG - 2}").withColumn("whole", F.explode(F.expr("sequence(length(token) - 2, length(token) + 2)"))).select("token", F.explode(F.expr(f"array_distinct(flatten({mine}))")).alias("_key"))
        long_right = right.where(f"length(form) > {LONG}").select("form", F.explode(F.expr(segments("length(form)", key.format("form", "0")))).alias("_key"))
        near = near.unionByName(long_left.join(long_right, "_key"))
    near = near.select("token", "form").distinct()
    swap = "levenshtein(token, form, 2) = 2 AND length(token) = length(form) AND array_sort(split(token, '')) = array_sort(split(form, ''))"
    near = near.withColumn("dist", F.expr(f"if({swap}, 1, levenshtein(token, form, 2))"))
    return near.where("dist >= 0 AND dist <= if(length(form) < 6, 1, 2)")


def shortened(words: DataFrame, common: DataFrame) -> DataFrame:
    """``token, form, sim``: tokens of three letters or more that begin a word or keep some of its letters in order, the first among them."""
    short = words.select("token").where("length(token) > 2").distinct().withColumn("_key", F.substring("token", 1, 1)).withColumn("_next", F.substring("token", 2, 1))
    long = common.select("form", F.substring("form", 1, 1).alias("_key"), F.explode(F.expr("array_distinct(split(substr(form, 2), ''))")).alias("_next"))
    kept = F.expr("aggregate(split(token, ''), 1, (p, c) -> if(p = 0, 0, coalesce(nullif(locate(c, form, p), 0) + 1, 0))) > 0")
    met = short.join(long, ["_key", "_next"]).where("length(token) < length(form)").where(kept)
    return met.select("token", "form", F.when(F.expr("startswith(form, token)"), 0.9).otherwise(0.85).alias("sim"))


class CanonicalList:
    """The list's entries, vocabulary and postings as tables of any size."""

    def __init__(self, entries: DataFrame, least: float = LEAST) -> None:
        rows = entries.where("merchant IS NOT NULL AND merchant_id IS NOT NULL").select(F.col("merchant_id").cast("bigint").alias("merchant_id"), F.array_distinct(tokens(F.col("merchant"))).alias("names"), F.array_union(F.coalesce(tokens(F.col("sector")), F.array().cast("array<string>")), F.coalesce(tokens(F.col("town")), F.array().cast("array<string>"))).alias("aside"))
        rows = rows.where("size(names) > 0").distinct().checkpoint()
        n = max(rows.count(), 1)
        each = rows.select("merchant_id", "names", "aside", F.explode("names").alias("w"))
        #: Squared inverse document frequency of every word of an entry.
        self.weights = each.groupBy("w").agg(F.count_distinct("merchant_id", "names").alias("df")).select("w", "df", F.pow(F.log(1 + F.lit(float(n)) / F.col("df")), 2).alias("g")).checkpoint()
        held = each.join(self.weights, "w").groupBy("merchant_id", "names", "aside").agg(F.array_sort(F.collect_list(F.struct((-F.col("g")).alias("neg"), "w"))).alias("_ws"))
        held = held.select("merchant_id", "names", "aside", F.transform("_ws", lambda x: F.struct(x["w"].alias("w"), (-x["neg"]).alias("g"))).alias("ws"))
        # What names an entry: its words but for those of its sector or town and of very many entries; all words where nothing else is left.
        usual = math.log(1 + n / max(n**0.5, 5.0)) ** 2
        forms = ", ".join(f"'{w}'" for w in COMPANY_FORMS)
        telling = F.expr(f"transform(filter(ws, x -> NOT array_contains(aside, x.w) AND NOT array_contains(array({forms}), x.w) AND x.g > {usual} + 1e-9), x -> x.w)")
        held = held.withColumn("own", telling).withColumn("own", F.expr("if(size(own) = 0, names, own)"))
        held = held.withColumn("mass", F.expr("aggregate(ws, 0D, (a, x) -> a + x.g)"))
        # The words without which the rest of the entry stays below the least score.
        needed = F.expr(f"transform(filter(transform(ws, (x, i) -> named_struct('w', x.w, 'rest', aggregate(slice(ws, i + 1, size(ws)), 0D, (a, y) -> a + y.g))), x -> x.rest >= {least} * mass), x -> x.w)")
        self.postings = held.select("merchant_id", "names", "aside", "own", "ws", "mass", F.explode(F.array_union(needed, "own")).alias("w")).checkpoint()
        # Words, all words of an entry in one, and all but one in one.
        joined = F.expr("""filter(concat(transform(names, x -> named_struct('form', x, 'words', array(x))),
            array(named_struct('form', array_join(names, ''), 'words', names)),
            transform(names, (x, i) -> named_struct('form', array_join(filter(names, (y, j) -> j <> i), ''), 'words', filter(names, (y, j) -> j <> i)))), f -> f.form <> '')""")
        aside = rows.select(F.explode("aside").alias("form")).select("form", F.array("form").alias("words"))
        #: ``form, words``: every spelling that stands for words of the list.
        self.forms = rows.select(F.inline(joined)).unionByName(aside).distinct().checkpoint()
        self.longest = self.forms.agg(F.max(F.length("form"))).first()[0] or 0
        #: Words of very many entries, and with those of sectors and towns the words that people shorten.
        self.frequent = self.weights.where(F.col("df") >= max(n**0.5, 5.0)).select(F.col("w").alias("form"))
        self.common = self.frequent.unionByName(aside.select("form")).where("length(form) > 3").distinct().checkpoint()

    def readings(self, words: DataFrame) -> DataFrame:
        """``token, alts``: what each distinct token may stand for, as weighted words with a similarity."""
        words = words.select("token").distinct()
        exact = words.join(self.forms.withColumnRenamed("form", "token"), "token").withColumn("sim", F.lit(1.0)).checkpoint()
        open_words = words.join(exact, "token", "left_anti")
        fixed = repairs(open_words, self.forms, self.longest).join(self.forms, "form").select("token", "words", F.expr("1 - dist / length(form)").alias("sim")).checkpoint()
        # A shortened word or a half is no longer than the longest form.
        open_words = open_words.where(f"length(token) <= {2 * self.longest + 1}")
        short = shortened(open_words.where(f"length(token) < {self.longest}"), self.common).select("token", F.array("form").alias("words"), "sim")
        # Words run together, one of them repaired and the other whole or shortened.
        loose = open_words.join(fixed.where("sim >= 0.85"), "token", "left_anti").where(f"length(token) BETWEEN 6 AND {2 * self.longest + 1}")
        parts = loose.select("token", F.explode(F.expr("transform(sequence(3, length(token) - 3), k -> named_struct('a', substr(token, 1, k), 'b', substr(token, k + 1)))")).alias("p"))
        parts = parts.select("token", F.explode(F.array(F.struct(F.col("p.a").alias("part"), F.col("p.b").alias("rest")), F.struct(F.col("p.b").alias("part"), F.col("p.a").alias("rest")))).alias("p")).select("token", "p.*")
        pieces = parts.select(F.col("part").alias("token")).distinct()
        whole = pieces.join(self.forms.where("length(form) > 2").withColumnRenamed("form", "token"), "token").withColumn("sim", F.lit(1.0))
        sure = whole.unionByName(shortened(pieces, self.common).select("token", F.array("form").alias("words"), "sim")).withColumnRenamed("token", "part").checkpoint()
        halves = parts.join(sure, "part").checkpoint()
        rests = halves.select(F.col("rest").alias("token")).distinct()
        known = rests.join(self.forms.withColumnRenamed("form", "token"), "token").withColumn("sim", F.lit(1.0))
        near = repairs(rests.join(known, "token", "left_anti"), self.forms, self.longest).where("dist = 1").join(self.forms, "form").select("token", "words", F.expr("1 - dist / length(form)").alias("sim"))
        other = known.unionByName(near).select(F.col("token").alias("rest"), F.col("words").alias("more"), F.col("sim").alias("other"))
        glued = halves.join(other, "rest").select("token", F.array_union("words", "more").alias("words"), F.expr("least(sim, other) - 0.02").alias("sim"))
        found = exact.unionByName(fixed).unionByName(short).unionByName(glued)
        return self.weighed(found).groupBy("token").agg(F.collect_list(F.struct("ws", "sim")).alias("alts"))

    def weighed(self, found: DataFrame) -> DataFrame:
        """``token, ws, sim``: each alternative once, with the weights of its words; words of towns and sectors alone weigh nothing."""
        best = found.groupBy("token", F.array_sort("words").alias("words")).agg(F.max("sim").alias("sim"))
        each = best.select("token", "words", "sim", F.explode("words").alias("w")).join(self.weights, "w", "left")
        return each.groupBy("token", "words").agg(F.max("sim").alias("sim"), F.collect_list(F.struct("w", F.coalesce("g", F.lit(0.0)).alias("g"))).alias("ws")).drop("words")


def phrase_readings(phrases: DataFrame, held: CanonicalList) -> DataFrame:
    """``phrase, reads``: the readings of a phrase's tokens, and of neighbours that only together may be a word."""
    words = phrases.where("phrase <> ''").select("phrase", F.posexplode(F.split("phrase", " ")).alias("pos", "token"))
    read = held.readings(words).join(F.broadcast(held.frequent.select(F.col("form").alias("token"), F.lit(True).alias("usual"))), "token", "left").checkpoint()
    sure = F.expr("usual IS NULL AND exists(alts, a -> a.sim >= 0.95)")
    mine = words.join(read, "token", "left").select("phrase", "pos", "token", F.coalesce("alts", F.array().cast(ALTS)).alias("alts"), F.coalesce(sure, F.lit(False)).alias("sure"))
    whole = mine.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "sure", "alts"))).alias("ts")).checkpoint()
    # Neighbours of which none is surely a word of the list, two and three at a time, with their places.
    tied = F.expr("""concat(
        filter(transform(ts, (t, i) -> if(NOT t.sure AND NOT coalesce(get(ts, i + 1).sure, true), named_struct('token', concat(t.token, get(ts, i + 1).token), 'first', i, 'last', i + 1), NULL)), x -> x IS NOT NULL),
        filter(transform(ts, (t, i) -> if(NOT t.sure AND NOT coalesce(get(ts, i + 1).sure, true) AND NOT coalesce(get(ts, i + 2).sure, true), named_struct('token', concat(t.token, get(ts, i + 1).token, get(ts, i + 2).token), 'first', i, 'last', i + 2), NULL)), x -> x IS NOT NULL))""")
    pairs = whole.select("phrase", F.inline(tied))
    met = pairs.select("token").distinct()
    exact = met.join(held.forms.withColumnRenamed("form", "token"), "token").select("token", "words", F.lit(0.98).alias("sim"))
    near = repairs(met, held.forms, held.longest).join(held.forms, "form").select("token", "words", F.expr("0.98 - dist / length(form)").alias("sim"))
    each = held.weighed(exact.unionByName(near))
    extra = pairs.join(each, "token").groupBy("phrase").agg(F.collect_list(F.struct("first", "last", F.struct("ws", "sim").alias("alt"))).alias("more"))
    # A token may also stand for its part of such a joined word.
    own = F.expr("""filter(transform(ts, (t, i) -> named_struct('top', coalesce(array_max(transform(t.alts, a -> a.sim)), 0D),
        'alts', concat(t.alts, transform(filter(coalesce(more, array()), m -> i BETWEEN m.first AND m.last), m -> m.alt)))), r -> size(r.alts) > 0)""")
    return whole.join(extra, "phrase", "left").select("phrase", own.alias("reads")).where("size(reads) > 0")


def match_phrases(phrases: DataFrame, entries: DataFrame) -> DataFrame:
    """For every phrase that has words of the list: ``merchant_id`` (0 for none) and ``choices`` (equally good ids)."""
    held = CanonicalList(entries)
    reads = phrase_readings(phrases.select("phrase").distinct(), held).checkpoint()
    words = reads.select("phrase", "reads", F.explode(F.expr("array_distinct(transform(flatten(transform(flatten(transform(reads, r -> r.alts)), a -> a.ws)), x -> x.w))")).alias("w"))
    # An entry needs one of the words that name it, not only words that many share.
    met = words.join(held.postings, "w").where(F.expr("exists(reads, r -> exists(r.alts, a -> exists(a.ws, x -> array_contains(own, x.w))))"))
    hits = F.expr("""transform(ws, e -> named_struct('own', array_contains(own, e.w), 'g', e.g, 'sim',
        coalesce(array_max(transform(filter(flatten(transform(reads, r -> r.alts)), x -> exists(x.ws, y -> y.w = e.w)), x -> x.sim)), 0D)))""")
    has = F.expr("aggregate(_hits, 0D, (a, h) -> a + h.g * h.sim)")
    # Of each token the reading that speaks least against the entry, among its best ones.
    against = F.expr("""aggregate(filter(reads, r -> r.top > 0), 0D, (a, r) -> a + coalesce(array_min(transform(filter(r.alts, x -> x.sim >= r.top - 0.1),
        x -> x.sim * aggregate(x.ws, 0D, (b, y) -> b + if(array_contains(names, y.w) OR array_contains(aside, y.w), 0D, y.g)))), 0D))""")
    scored = met.withColumn("_hits", hits).withColumn("_has", has).withColumn("_against", against)
    # A phrase with nothing but what names an entry names all entries of that name alike, whatever else they are called.
    name_only = F.expr("NOT exists(_hits, h -> NOT h.own AND h.sim > 0)")
    named = F.expr(f"{NAMED} * _has / aggregate(filter(_hits, h -> h.own), 0D, (a, h) -> a + h.g)")
    scored = scored.withColumn("score", F.when(name_only, named).otherwise(F.expr("_has / mass")) * F.expr("pow(_has / (_has + _against), 2)")).where(F.col("score") >= LEAST)
    each = scored.groupBy("phrase", "merchant_id").agg(F.max("score").alias("score")).groupBy("phrase").agg(F.collect_list(F.struct("score", "merchant_id")).alias("_s"))
    choices = F.expr(f"array_sort(transform(filter(_s, x -> x.score >= array_max(_s).score - {MARGIN}), x -> x.merchant_id))")
    found = reads.select("phrase").join(each.select("phrase", choices.alias("choices")), "phrase", "left")
    return found.select("phrase", F.coalesce(F.expr("if(size(choices) = 1, choices[0], 0L)"), F.lit(0).cast("bigint")).alias("merchant_id"), F.coalesce("choices", F.array().cast("array<bigint>")).alias("choices"))


def meant_merchants(events: DataFrame, groups: DataFrame, entries: DataFrame, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """``row_kind, row_key, merchant_id`` for each distinct event and group; 0 for none of the list."""
    e = events.where("event_id IS NOT NULL").select("event_id", phrase(F.col("merchant")).alias("m_phrase"), phrase(F.col("description")).alias("d_phrase")).dropDuplicates(["event_id"]).checkpoint()
    g = groups.where("group_id IS NOT NULL").select("group_id", phrase(F.col("example")).alias("x_phrase")).dropDuplicates(["group_id"])
    phrases = e.select(F.explode(F.array("m_phrase", "d_phrase")).alias("phrase")).union(g.select("x_phrase")).distinct()
    matched = match_phrases(phrases, entries).checkpoint()

    def side(name: str) -> DataFrame:
        return matched.select(F.col("phrase").alias(f"{name}_phrase"), F.struct("merchant_id", "choices").alias(name))

    both = e.join(side("m"), "m_phrase", "left").join(side("d"), "d_phrase", "left")
    # A value without words of the list names somebody unless it stands beside several entries, as placeholders do.
    beside = both.where("m IS NULL AND m_phrase <> '' AND d.merchant_id > 0").select("m_phrase", "d.merchant_id").distinct().groupBy("m_phrase").agg(F.count(F.lit(1)).alias("_n"))
    vague = beside.where(F.col("_n") >= PLACEHOLDER_ENTRIES).select("m_phrase", F.lit(True).alias("_vague"))
    nobody = (F.col("m_phrase") == "") | F.col("m_phrase").isin(*placeholders) | F.coalesce("_vague", F.lit(False))
    meant = F.expr("""CASE
        WHEN m.merchant_id > 0 THEN m.merchant_id
        WHEN size(m.choices) > 1 THEN CASE
          WHEN array_contains(m.choices, d.merchant_id) THEN d.merchant_id
          WHEN size(array_intersect(m.choices, d.choices)) = 1 THEN array_intersect(m.choices, d.choices)[0] ELSE 0L END""" + """
        WHEN _nobody THEN d.merchant_id ELSE 0L END""")
    decided = both.join(vague, "m_phrase", "left").withColumn("_nobody", nobody & F.col("m").isNull())
    found = decided.select(F.lit("event").alias("row_kind"), F.col("event_id").alias("row_key"), F.coalesce(meant, F.lit(0).cast("bigint")).alias("merchant_id"))
    grouped = g.join(side("x"), "x_phrase", "left").select(F.lit("group").alias("row_kind"), F.col("group_id").alias("row_key"), F.coalesce("x.merchant_id", F.lit(0).cast("bigint")).alias("merchant_id"))
    return found.unionByName(grouped)
